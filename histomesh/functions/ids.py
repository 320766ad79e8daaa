"""Expressions over cell and sample identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the tail that repeated merging of objects appends to a cell id.
MERGE_SUFFIX = "(_[0-9]+)+$"


def text(name: str | Column) -> Column:
    """Any value as text, with null as the empty string."""
    column = F.col(name) if isinstance(name, str) else name
    return F.coalesce(column.cast("string"), F.lit(""))


def is_blank(name: str | Column) -> Column:
    """Null, empty or only spaces."""
    column = F.col(name) if isinstance(name, str) else name
    return column.isNull() | (F.trim(column.cast("string")) == "")


def global_id(sample: str = "sample_id", cell: str = "cell_id") -> Column:
    """``<sample>:<cell>``, for display and export only; joins use both columns."""
    return F.concat_ws(":", F.col(sample).cast("string"), F.col(cell).cast("string"))


def after_colon(name: str) -> Column:
    """Everything behind the first colon, or empty text if there is none."""
    column = F.col(name)
    cut_at = F.instr(column, ":")
    return F.when(cut_at > 0, F.substring(column, cut_at + 1, F.length(column))).otherwise(F.lit(""))


def without_merge_suffix(name: str) -> Column:
    return F.regexp_replace(F.col(name), MERGE_SUFFIX, "")


def merge_depth(name: str) -> Column:
    """How many ``_<integer>`` groups :func:`without_merge_suffix` takes away."""
    suffix = F.regexp_extract(F.col(name), MERGE_SUFFIX, 0)
    return F.length(suffix) - F.length(F.replace(suffix, F.lit("_"), F.lit("")))


def joined_list(name: str) -> Column:
    """A list value as ``;``-separated text."""
    return F.array_join(F.col(name), ";")
