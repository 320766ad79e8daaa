"""Zero-fill: pair every group with every label, observed or not."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def label_slots(labels: DataFrame, name: str) -> DataFrame:
    """Give each distinct label its own integer, with few gaps.

    Labels are numbered inside hash buckets, so no task has to see all of them.
    """
    distinct = labels.select(name).where(F.col(name).isNotNull()).distinct()
    bucketed = distinct.withColumn("bucket", F.pmod(F.xxhash64(name), F.lit(BUCKETS)))
    order = Window.partitionBy("bucket").orderBy(name)
    slot = F.col("bucket") + BUCKETS * (F.row_number().over(order) - 1)
    return bucketed.select(name, slot.cast("long").alias("slot"))


def with_every_label(groups: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """One row per group and label, through an equality join on label numbers."""
    slots = label_slots(labels, name)
    last = slots.select(F.max("slot")).scalar()
    return (
        groups.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .join(slots, "slot")
        .drop("slot")
    )


def label_difference(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Labels found on one side only, with the side that has them."""
    a, b = left.select(name).distinct(), right.select(name).distinct()
    return (
        a.exceptAll(b)
        .withColumn("only_in", F.lit("left"))
        .unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))
    )
