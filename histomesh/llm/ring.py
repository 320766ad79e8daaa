"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, natively.

The ring is cut into a fixed number of cells; every shard owns the cells from each of its
virtual nodes to the next one. A key falls into a cell by its hash. Shards have exact
capacities (their sum is the number of rows, two capacities differ by one at most). Rows
reach the owner of their cell first; what a full shard cannot take continues clockwise to the
next virtual node, hop by hop, until all are placed. So counts of any two shards differ by one
at most, and only overflowing rows leave their place on the ring.

The walk needs only the number of rows per cell, a table whose size is the fixed number of
cells however many rows there are. A row then finds its shard from its rank in its cell.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histomesh.llm.frames import packed, unpacked

CELLS = 1 << 16


def owners(shards: int, nodes: int, cells: int = CELLS) -> list[int]:
    """The shard that owns each cell; ``nodes`` virtual nodes for every shard."""
    at: dict[int, tuple[bytes, int]] = {}
    for shard in range(shards):
        for node in range(nodes):
            digest = hashlib.sha256(f"{shard}/{node}".encode()).digest()
            place = int.from_bytes(digest[:8], "big") % cells
            at[place] = min(at.get(place, (b"\xff" * 33, 0)), (digest, shard))
    owner = at[max(at)][1]
    found = []
    for cell in range(cells):
        owner = at[cell][1] if cell in at else owner
        found.append(owner)
    return found


def walk(counts: dict[int, int], ring: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Where the rows of every cell go: (cell, first rank, last rank + 1, shard, first slot)."""
    total = sum(counts.values())
    room = [total // shards + (shard < total % shards) for shard in range(shards)]
    used = [0] * shards
    starts = [cell for cell in range(len(ring)) if ring[cell] != ring[cell - 1]] or [0]
    next_start, upcoming = {}, starts[0]
    for cell in range(len(ring) - 1, -1, -1):
        next_start[cell] = upcoming
        if ring[cell] != ring[cell - 1]:
            upcoming = cell
    waiting = [(cell, 0, n, cell) for cell, n in sorted(counts.items()) if n]
    placed = []
    while waiting:
        onward = []
        for cell, first, end, place in waiting:
            shard = ring[place]
            taken = min(end - first, room[shard] - used[shard])
            if taken:
                placed.append((cell, first, first + taken, shard, used[shard]))
                used[shard] += taken
            if first + taken < end:
                onward.append((cell, first + taken, end, next_start[place]))
        waiting = onward
    return placed


def ring_shards(
    docs: DataFrame,
    key: Column,
    tie: Column,
    shards: int = 40,
    nodes: int = 128,
    cells: int = CELLS,
) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (0, 1, … within the shard).

    ``key`` decides the place on the ring, ``tie`` the order of rows with equal keys. Null and
    repeated keys share a cell and are placed row by row; equal rows are interchangeable. Fewer
    rows than shards leave some shards empty; an empty table gives an empty table. Input
    columns named shard or slot are replaced.
    """
    columns, spark = docs.columns, docs.sparkSession
    rows = packed(docs, hash=F.xxhash64(key), tie=tie).withColumn("cell", F.pmod("hash", F.lit(cells)).cast("int"))
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = walk(counts, owners(shards, nodes, cells), shards)
    by_cell: dict[int, list[list[int]]] = {}
    for cell, *where in placed:
        by_cell.setdefault(cell, []).append(where)
    text = json.dumps([{"c": cell, "w": where} for cell, where in by_cell.items()])
    kind = "array<struct<c:int,w:array<array<bigint>>>>"
    plan = spark.range(1).select(F.explode(F.from_json(F.lit(text), kind)).alias("p")).select("p.c", "p.w")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("hash", "tie")).cast("long") - 1
    rows = rows.withColumn("rank", rank).join(F.broadcast(plan), F.col("cell") == F.col("c"))
    mine = F.filter("w", lambda w: (w[0] <= F.col("rank")) & (F.col("rank") < w[1]))[0]
    rows = rows.withColumn("mine", mine)
    return unpacked(
        rows,
        columns,
        shard=F.col("mine")[2].cast("int"),
        slot=F.col("mine")[3] + F.col("rank") - F.col("mine")[0],
    )
