"""Small helpers that let operators carry any input columns without name clashes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as one struct ``row``, beside working columns of the operator's own."""
    row = F.struct(*[named(c) for c in df.columns]) if df.columns else F.lit(None)
    return df.select(row.alias("row"), *[value.alias(name) for name, value in columns.items()])


def unpacked(df: DataFrame, columns: Iterable[str], **results: Column) -> DataFrame:
    """The packed row's ``columns`` again, with ``results`` in place of equal names."""
    kept = [F.col("row")[c].alias(c) for c in columns if c not in results]
    return df.select(*kept, *[value.alias(name) for name, value in results.items()])


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, so that nothing else of a table is read or can clash."""
    return df.select(*[named(c) for c in columns])
