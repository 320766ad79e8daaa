"""Principal components of sparse rows: outer products added up per task, then row by row.

A task adds the outer product of every sparse row into the rows of the Gram matrix it has met,
in memory of a fixed size; what does not fit is handed on at once. Rows of one index are
summed where they meet. Nothing is made dense but sums, and centring is a second Gram matrix,
that of the groups' means.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.lineage import cut, small, spread

#: Bytes of Gram rows a task holds before it hands them on.
HELD = 256 << 20


def sparse_rows(entries: DataFrame, keys: list[str], count: int = 0) -> DataFrame:
    """Entries ``(*keys, ix, x)`` as one sparse row per key: ``ix`` ascending, repeats added up.

    If their ``count`` is told, parts are bounded by it, as grouping takes a multiple of what is moved.
    """
    dealt = spread(entries.repartition(*keys), count, *keys) if keys else entries.coalesce(1)
    summed = dealt.groupBy(*keys, "ix").agg(F.sum("x").alias("x"))
    pairs = summed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ix", "x"))).alias("pairs"))
    return pairs.select(*keys, F.col("pairs.ix").alias("ix"), F.col("pairs.x").alias("x"))


def gram(rows: DataFrame, size: int, held: int = HELD) -> DataFrame:
    """``(i, row)`` of the sum of ``x xᵀ`` over sparse rows ``(ix, x)`` of ``size`` places.

    Places that no row touches have no Gram row.
    """
    most = max(held // (8 * max(size, 1)), 1)

    def outer(batches):
        slot = np.full(size, -1, np.int64)
        places, sums = [], np.zeros((min(most, size), size))

        def handed_on():
            for k in range(0, len(places), 64):
                some = places[k : k + 64]
                flat = pa.array(sums[k : k + len(some)].ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, size * len(some) + 1, size), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), lists], names=["i", "row"])
            slot[places] = -1
            sums[: len(places)] = 0
            places.clear()

        for batch in batches:
            ix, x = batch.column("ix"), batch.column("x")
            for k in range(batch.num_rows):
                at, value = ix[k].values.to_numpy(), x[k].values.to_numpy()
                for low in range(0, len(at), most):
                    some, own = at[low : low + most], value[low : low + most]
                    new = some[slot[some] < 0]
                    if len(places) + len(new) > len(sums):
                        yield from handed_on()
                        new = some
                    slot[new] = np.arange(len(places), len(places) + len(new))
                    places.extend(new.tolist())
                    sums[np.ix_(slot[some], at)] += np.outer(own, value)
        yield from handed_on()

    parts = rows.select("ix", "x").mapInArrow(outer, "i int, row array<double>")
    summed = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("row"))
    return summed.select("i", vector_to_array("row").alias("row"))


def _matrix(found: DataFrame, size: int) -> np.ndarray:
    """Gram rows as one matrix; ``size`` is bounded by the caller."""
    out = np.zeros((size, size))
    for row in found.toLocalIterator():
        out[row["i"]] = row["row"]
    return out


def principal_axes(entries: DataFrame, groups: DataFrame, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` axes of rows centred within their group, and the variances along them.

    ``entries(sample_id, cell_id, ix, x)`` are the non-zero values, ``groups(sample_id, members)``
    the number of rows, also empty ones, of every group. The largest loading of each axis is
    positive. The matrix of ``size`` squared, however many rows, is what the driver holds.
    """
    n = groups.agg(F.sum("members")).first()[0] or 0
    whole = _matrix(gram(sparse_rows(entries, ["sample_id", "cell_id"], entries.count()), size), size)
    sums = entries.groupBy("sample_id", "ix").agg(F.sum("x").alias("x")).join(groups, "sample_id")
    means = sums.select("sample_id", "ix", (F.col("x") / F.sqrt("members")).alias("x"))
    whole -= _matrix(gram(sparse_rows(means, ["sample_id"]), size), size)
    values, axes = np.linalg.eigh((whole + whole.T) / 2)
    axes, values = axes[:, ::-1][:, :k], values[::-1][:k]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return axes, np.maximum(values, 0) / max(n - 1, 1)


def projected(entries: DataFrame, cells: DataFrame, axes: np.ndarray) -> DataFrame:
    """Every cell's place along the ``axes``, centred within its sample, as ``embedding``.

    Sparse entries meet the loadings of their place; sums combine before they are shuffled.
    Cells without entries get their sample's centre subtracted like all others.
    """
    keys, k = ["sample_id", "cell_id"], axes.shape[1]
    spark = entries.sparkSession
    loadings = small(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(axes)], "ix int, v array<double>"))
    parts = [F.sum(F.col("x") * F.col("v")[j]).alias(f"s{j}") for j in range(k)]
    names = [f"s{j}" for j in range(k)]
    own = entries.join(loadings, "ix").groupBy(*keys).agg(*parts)
    every = cut(cells.select(*keys).join(own, keys, "left").na.fill(0.0, names))
    centres = every.groupBy("sample_id").agg(*[F.avg(name).alias(f"m{name}") for name in names])
    placed = every.join(small(centres), "sample_id")
    return placed.select(*keys, F.array(*[F.col(name) - F.col(f"m{name}") for name in names]).alias("embedding"))
