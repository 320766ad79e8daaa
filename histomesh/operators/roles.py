"""Binding source columns to the canonical roles."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Coordinate column pairs, in order of preference.
COORDINATE_PAIRS = (
    ("x_centroid", "y_centroid"),
    ("centroid_x", "centroid_y"),
    ("x", "y"),
)
IMAGE_PAIR = ("imagecol", "imagerow")


@dataclass(frozen=True)
class Roles:
    """Names of the source columns that play each role; ``None`` means absent."""

    sample_id: str | None = "sample_id"
    cell_id: str | None = "cell_id"
    condition: str | None = "condition"
    cell_type: str | None = "cell_type"
    cell_type_broad: str | None = None
    compartment: str | None = "spatial_domain"
    region: str | None = None

    def bound(self) -> dict[str, str]:
        return {role: name for role, name in asdict(self).items() if name is not None}


def column(name: str):
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def missing_columns(df: DataFrame, names) -> list[str]:
    return [name for name in names if name not in df.columns]


def bind_roles(df: DataFrame, roles: Roles, keep_others: bool = True) -> DataFrame:
    """Rename role columns to their canonical names and make them text."""
    bound = roles.bound()
    absent = missing_columns(df, bound.values())
    if absent:
        raise KeyError(f"missing required columns: {', '.join(absent)}")
    chosen = [column(name).cast("string").alias(role) for role, name in bound.items()]
    if keep_others:
        taken = set(bound.values()) | set(bound)
        chosen += [column(name) for name in df.columns if name not in taken]
    return df.select(*chosen)


def coordinate_pair(columns, images: bool = False) -> tuple[str, str] | None:
    """The first complete pair of coordinate columns."""
    pairs = COORDINATE_PAIRS + ((IMAGE_PAIR,) if images else ())
    return next((pair for pair in pairs if set(pair) <= set(columns)), None)


def with_coordinates(df: DataFrame, images: bool = False) -> DataFrame:
    """Put the chosen pair into ``x`` and ``y`` as doubles."""
    pair = coordinate_pair(df.columns, images)
    if pair is None:
        raise ValueError("the table has no complete pair of coordinate columns")
    others = [column(name) for name in df.columns if name not in ("x", "y", *pair)]
    return df.select(
        *others, F.col(pair[0]).cast("double").alias("x"), F.col(pair[1]).cast("double").alias("y")
    )


def embedding_array(df: DataFrame, keys=("sample_id", "cell_id"), name: str = "embedding") -> DataFrame:
    """All numeric columns, in table order, as one array column."""
    numeric = [
        field.name
        for field in df.schema.fields
        if isinstance(field.dataType, T.NumericType) and field.name not in keys
    ]
    present = [key for key in keys if key in df.columns]
    return df.select(*present, F.array(*[column(c).cast("double") for c in numeric]).alias(name))


def stamp_source(df: DataFrame, sample_id: str, condition: str) -> DataFrame:
    """Give every row of a single-sample source its sample and condition."""
    return df.withColumns(
        {"sample_id": F.lit(str(sample_id)), "condition": F.lit(str(condition))}
    )


def stamp_from_sheet(df: DataFrame, sheet: DataFrame) -> DataFrame:
    """Take the condition of every row from the sample sheet."""
    return df.drop("condition").join(sheet.select("sample_id", "condition"), "sample_id")
