"""Delaunay neighbour graph without a geometry library.

Two cells are neighbours if some circle through both holds no other cell. The
centres of those circles form a line; every other cell rules out part of it, so
an edge is a pair of bounds and the test is a join with a ``min`` and a ``max``.

1. Each location is compared with its nearest others, as far as it has seen all. An
   empty circle whose diameter is no longer than that cannot hold anything else, so
   what is accepted there is final. A location whose edges lie between such circles all
   around is complete: it has no other edges, and nothing about them is moved. This
   settles the interior.
2. What remains are sides between two incomplete locations whose third corner is not
   certain. A side with a known corner has a finite circle, and what lies inside is found
   by an equi-join on grid cells of its size. Sides with an open or very wide circle lie
   along the outline. For them points are packed into about sqrt(n) boxes of sqrt(n)
   points a sample, and each looks into boxes that it reaches. Every third corner gives
   new edges, whose outer sides are looked up next, until they meet complete locations.

Cells on one spot count once: the smallest id has the edges. Where four or more
cells lie on one empty circle, all their connections are kept.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histomesh.functions.geometry import FLAT, Bend
from histomesh.lineage import cut, landed, small
from histomesh.operators.neighbors import Frame, locations, nearest_lists, with_reach, within_reach

# Circles up to this many times wider than their side are searched on a grid.
WIDEST = 8.0
# In thirds of k: how many others a reach covers at least, how many nearest of them are compared at
# first, and how many at most where those do not settle a location.
LOOK, FIRST, MOST = 5, 5, 9
# Relative width within which bounds count as equal.
TIE = 1e-9
INFINITY = float("inf")
SIDE = ["sample_id", "a", "b"]


def delaunay_edges(cells: DataFrame, k: int = 12, max_edge: float | None = None) -> DataFrame:
    """Directed edges of the Delaunay graph of every sample.

    ``k`` only moves work between the two steps. ``max_edge`` leaves out longer
    edges; the default keeps the graph whole.
    """
    if k < 3:
        raise ValueError("k must be at least 3")
    cells = cells.select("sample_id", "cell_id", "x", "y")
    sites = cut(with_reach(locations(cells), Frame(cells), LOOK * k // 3))
    stars = landed(_stars(sites, k), "stars")
    # Few locations are incomplete; only sides between two of them are looked up.
    unsettled = small(stars.where("NOT complete").select("sample_id", "site"))
    parts = [landed(_merged(_between(_told(stars), unsettled)), "sides")]
    waiting = parts[0].where("not closed")
    if not waiting.isEmpty():
        points = cut(_packed(sites))
        boxes = cut(_boxes(points))
    while not waiting.isEmpty():
        parts.append(landed(_merged(_between(_outward(waiting, points, boxes), unsettled)), "sides"))
        opened = parts[-1].where("not closed")
        # Few sides are new: the large parts are scanned, and not shuffled if a count proves it.
        closed = reduce(DataFrame.unionByName, parts).where("closed").select(*SIDE)
        closed = small(closed.join(small(opened.select(*SIDE)), SIDE, "left_semi"))
        waiting = cut(opened.join(closed, SIDE, "left_anti"))
    sides = reduce(DataFrame.unionByName, parts).select(*SIDE, "ax", "ay", "bx", "by").distinct()
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    between = sides.select("sample_id", F.col("a").alias("src"), F.col("b").alias("dst"), length.alias("dist"))
    settled = stars.where("complete").select("sample_id", F.col("site").alias("src"), F.inline("star"))
    back = settled.where("doubtful").select("sample_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")
    back = back.join(unsettled.withColumnRenamed("site", "src"), ["sample_id", "src"], "left_semi")
    edges = settled.drop("doubtful").unionByName(back).unionByName(between)
    return edges if max_edge is None else edges.where(F.col("dist") <= max_edge)


def _between(sides: DataFrame, unsettled: DataFrame) -> DataFrame:
    """Sides between two incomplete locations: all others are in the stars of complete ones."""
    for end in ("a", "b"):
        sides = sides.join(unsettled.withColumnRenamed("site", end), ["sample_id", end], "left_semi")
    return sides


def _merged(sides: DataFrame) -> DataFrame:
    """One row per directed side, with everything known about it."""
    return sides.groupBy(*SIDE, "ax", "ay", "bx", "by").agg(
        F.bool_or("closed").alias("closed"), F.min("bound").alias("bound")
    )


def _tolerance(*values: Column) -> Column:
    return F.lit(TIE) * sum((F.abs(v) for v in values), F.lit(0.0))


def _stars(sites: DataFrame, k: int) -> DataFrame:
    """Per location what its near locations say of its edges, final or not.

    A location is ``complete`` if each of its edges lies between two circles that it has seen whole: there
    is a triangle on both sides of each, and no other edge can pass. Its edges are its ``star``; whether the
    far end may be incomplete is ``doubtful``. ``met`` are pairs of its neighbours that may both be
    incomplete and share an empty circle with it, the first of them with it on the left.

    Others give ``edges`` that are final themselves, by numbers of ``others``: bounds of the offset and the
    corners that set them. ``tied`` tells whether one of the edges fits one circle only. It is
    :class:`Bend` for all corners of a batch of locations at once, so nothing is moved; locations near each
    other come in one batch, where they know of each other whether they are complete.
    """
    flat, tie, infinity, look, first_few, most = FLAT, TIE, INFINITY, LOOK * k // 3, FIRST * k // 3, MOST * k // 3
    lists = nearest_lists(sites, sites.select("sample_id", F.col("site").alias("dst"), "x", "y"), most + 1)
    lists = lists.select("sample_id", "site", "x", "y", "reach2", "near")
    kind = {field.name: field.dataType.simpleString() for field in lists.schema}
    key = kind["site"]
    shape = (
        f"sample_id {kind['sample_id']}, site {key}, x double, y double, seen2 double, complete boolean, tied boolean, "
        f"others array<struct<id:{key},x:double,y:double,doubtful:boolean>>, "
        "edges array<struct<no:int,low:double,high:double,left_no:int,right_no:int>>, "
        f"star array<struct<dst:{key},dist:double,doubtful:boolean>>, "
        f"met array<struct<a:struct<id:{key},x:double,y:double>,b:struct<id:{key},x:double,y:double>>>"
    )

    def circles(ox, oy, real):
        """Offsets that the corner ``c`` leaves to circles on the edge to ``b``, to its left and right."""
        bx, by, cx, cy = ox[:, :, None], oy[:, :, None], ox[:, None, :], oy[:, None, :]
        length2 = ox * ox + oy * oy
        length = np.sqrt(length2)[:, :, None]
        turn = bx * cy - by * cx
        power = cx * (cx - bx) + cy * (cy - by)
        level = np.abs(turn) <= flat * length * np.sqrt(length2)[:, None, :]
        other = real[:, None, :] & ~np.eye(ox.shape[1], dtype=bool)
        offset = length * power / (2.0 * turn)
        uneven, ahead = other & ~level, turn > 0
        left = np.where(uneven & ahead, offset, infinity)
        right = np.where(uneven & ~ahead, offset, -infinity)
        return left, right, (other & level & (power < 0)).any(2)

    def bounds(ox, oy, real, seen2):
        left, right, blocked = circles(ox, oy, real)
        low, high = right.max(2), left.min(2)
        slack = tie * (np.abs(low) + np.abs(high))
        fits = real & ~blocked & ((low <= high) | (low - high <= slack))
        known = (np.abs(low) < infinity) & (np.abs(high) < infinity)
        tied = (fits & known & (np.abs(high - low) <= slack)).any(1)
        d2, seen2 = ox * ox + oy * oy, seen2[:, None]
        whole = known & (d2 + 4 * np.maximum(low * low, high * high) < seen2 * (1 - 4 * tie))
        complete = fits.any(1) & (whole | ~fits).all(1)
        smallest = np.maximum(np.minimum(0.0, high), low)
        accepted = fits & (d2 + 4 * smallest * smallest <= seen2)
        corner = [np.where(np.abs(bound) < infinity, side, -1) for bound, side in ((high, left.argmin(2)), (low, right.argmax(2)))]
        return np.where(complete[:, None], fits, accepted), low, high, *corner, tied, complete

    def corners(ox, oy, real, edge, high, doubtful):
        """Pairs of edges ``(row, b, c)`` with doubtful ends and c on the circle that ends the offsets left of b."""
        left = circles(ox, oy, real)[0]
        limit = high + 4 * tie * np.abs(high) + 1e-12 * np.sqrt(ox * ox + oy * oy)
        ends = edge & doubtful
        return np.nonzero((left <= limit[:, :, None]) & (left < infinity) & ends[:, :, None] & ends[:, None, :])

    def portions(rows, width):
        """So many rows at a time that what is compared for them stays in the processor's cache."""
        step = max(1, 2**14 // width**2)
        return [rows[low : low + step] for low in range(0, len(rows), step)]

    def lists_of(rows, n, values):
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), values)

    def found(batch):
        """The stars of a batch of one sample."""
        n, near = batch.num_rows, batch["near"]
        starts, others = near.offsets.to_numpy(), near.flatten()
        # The nearest is the location itself.
        first, sizes, nth = starts[:-1, None] - starts[0] + 1, np.diff(starts) - 1, np.arange(most)
        real = nth < sizes[:, None]
        at = np.where(real, first + nth, -1)
        ids = others.field("dst")
        x, y, reach2 = [batch[c].to_numpy() for c in ("x", "y", "reach2")]
        far_x, far_y = [np.append(others.field(c).to_numpy(), np.nan) for c in ("tx", "ty")]
        ox, oy = far_x[at] - x[:, None], far_y[at] - y[:, None]
        # A list that is cut ends at its last; one shorter than any reach holds all other locations of its sample.
        seen2 = np.where(sizes == most, ox[:, -1] ** 2 + oy[:, -1] ** 2, np.where(sizes < look, infinity, reach2))
        edge = np.zeros((n, most), bool)
        low, high, left, right = [np.zeros((n, most), kind) for kind in (float, float, int, int)]
        tied, complete = np.zeros(n, bool), np.zeros(n, bool)
        for width in dict.fromkeys((min(first_few, most), most)):
            # A list that is cut has seen as far as its last.
            cut_off = real[:, width - 1] if width < most else np.zeros(n, bool)
            far2 = np.where(cut_off, ox[:, width - 1] ** 2 + oy[:, width - 1] ** 2, seen2)
            for p in portions(np.flatnonzero(~complete), width):
                some = (p, slice(width))
                edge[some], low[some], high[some], left[some], right[some], tied[p], complete[p] = bounds(ox[some], oy[some], real[some], far2[p])
        here = pc.fill_null(pc.index_in(ids, value_set=batch["site"]), -1).to_numpy()
        doubtful = np.append(~((here >= 0) & complete[here]), True)
        wavering = doubtful[at]
        row, no = np.nonzero(edge & complete[:, None])
        place = at[row, no]
        star = pa.StructArray.from_arrays(
            [ids.take(pa.array(place)), pa.array(np.hypot(ox[row, no], oy[row, no])), pa.array(doubtful[place])], names=["dst", "dist", "doubtful"]
        )
        some = np.flatnonzero(complete & ((edge & wavering).sum(1) > 1))
        degree = edge[some].sum(1).max(initial=1)
        spoke = np.argsort(~edge[some], axis=1, kind="stable")[:, :degree]
        pairs = []
        for p in portions(np.arange(len(some)), degree):
            to = some[p, None], spoke[p]
            i, b, c = corners(ox[to], oy[to], real[to], edge[to], high[to], wavering[to])
            pairs.append((some[p][i], spoke[p][i, b], spoke[p][i, c]))
        of, b, c = [np.concatenate(z) for z in zip(*pairs)] if pairs else [np.zeros(0, np.int64)] * 3
        ends = [
            pa.StructArray.from_arrays([ids.take(pa.array(e)), pa.array(far_x[e]), pa.array(far_y[e])], names=["id", "x", "y"]) for e in (at[of, b], at[of, c])
        ]
        met = pa.StructArray.from_arrays(ends, names=["a", "b"])
        open_row, open_no = np.nonzero(edge & ~complete[:, None])
        numbers = [pa.array(z.astype(np.int32), mask=z < 0) for z in (open_no, left[open_row, open_no], right[open_row, open_no])]
        edges = pa.StructArray.from_arrays(
            [numbers[0], pa.array(low[open_row, open_no]), pa.array(high[open_row, open_no]), *numbers[1:]], names=["no", "low", "high", "left_no", "right_no"]
        )
        listed, listed_no = np.nonzero(real & ~complete[:, None])
        place = at[listed, listed_no]
        rest = pa.StructArray.from_arrays(
            [ids.take(pa.array(place)), pa.array(far_x[place]), pa.array(far_y[place]), pa.array(doubtful[place])], names=["id", "x", "y", "doubtful"]
        )
        return pa.RecordBatch.from_arrays(
            [*[batch[c] for c in ("sample_id", "site", "x", "y")], pa.array(seen2), pa.array(complete), pa.array(tied),
             lists_of(listed, n, rest), lists_of(open_row, n, edges), lists_of(row, n, star), lists_of(of, n, met)],
            names=["sample_id", "site", "x", "y", "seen2", "complete", "tied", "others", "edges", "star", "met"],
        )

    def run(batches):
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch["near"]), 1))
            if not batch.num_rows:
                continue
            sample = batch["sample_id"]
            changes = pc.not_equal(sample.slice(1), sample.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            starts = [0, *(1 + np.flatnonzero(changes)), batch.num_rows]
            with np.errstate(all="ignore"):
                for low, high in zip(starts, starts[1:]):
                    yield found(batch.slice(low, high - low))

    return lists.mapInArrow(run, shape)


def _near_sides(sites: DataFrame, k: int) -> DataFrame:
    """Accepted edges among near locations that may both be incomplete, and the sides of their triangles."""
    return _told(_stars(sites, k))


def _told(stars: DataFrame) -> DataFrame:
    """The sides between incomplete locations that stars tell of."""
    p = F.struct(F.col("site").alias("id"), "x", "y")
    yes, no, unknown = F.lit(True), F.lit(False), F.lit(INFINITY)

    def around(edge: Column) -> Column:
        q, left, right = [F.get("others", edge[number]) for number in ("no", "left_no", "right_no")]
        d2 = F.pow(q["x"] - F.col("x"), F.lit(2.0)) + F.pow(q["y"] - F.col("y"), F.lit(2.0))

        # An edge that fits one circle only is the diagonal of four or more cells on
        # that circle. The second step, which finds all of them, takes over there.
        def certain(offset: Column) -> Column:
            """The corner is known, and so is everything else on its circle."""
            return ~F.col("tied") & (d2 + 4 * offset * offset < F.col("seen2") * (1 - 4 * TIE))

        low, high = edge["low"], edge["high"]
        return F.concat(_triangle_sides(p, q, left, high, certain(high)), _triangle_sides(q, p, right, -low, certain(low)))

    known = F.transform(F.filter("others", lambda o: ~o["doubtful"]), lambda o: o["id"])
    own = F.filter(
        F.flatten(F.transform("edges", around)),
        lambda side: ~F.array_contains(known, side["a"]) & ~F.array_contains(known, side["b"]),
    )
    opposite = F.flatten(F.transform("met", lambda m: F.array(_directed(m["a"], m["b"], yes, unknown), _directed(m["b"], m["a"], no, unknown))))
    some = stars.where((F.size("edges") > 0) | (F.size("met") > 0))
    return some.select("sample_id", F.inline(F.concat(own, opposite)))


def _directed(a: Column, b: Column, closed: Column, bound: Column) -> Column:
    return F.struct(
        a["id"].alias("a"),
        b["id"].alias("b"),
        a["x"].alias("ax"),
        a["y"].alias("ay"),
        b["x"].alias("bx"),
        b["y"].alias("by"),
        closed.alias("closed"),
        bound.alias("bound"),
    )


def _triangle_sides(
    a: Column, b: Column, corner: Column, bound: Column, certain: Column, alone: Column | None = None
) -> Column:
    """The side a-b; and if its corner is certain, all sides of the triangle.

    The triangle lies to the left of a-b, b-corner and corner-a, and closes them
    if nothing else is on its circle. What lies to the left of the reversed sides
    is open until something else closes it.
    """
    closed = F.lit(True) if alone is None else alone
    no, unknown = F.lit(False), F.lit(INFINITY)
    own = F.array(_directed(a, b, certain, bound))
    around = F.array(
        _directed(b, corner, closed, unknown),
        _directed(corner, a, closed, unknown),
        _directed(corner, b, no, unknown),
        _directed(a, corner, no, unknown),
    )
    return F.when(certain & corner.isNotNull(), F.concat(own, around)).otherwise(own)


def _packed(sites: DataFrame) -> DataFrame:
    """Points with a box number: stretches of the Z-order curve, along which ``sid`` counts."""
    largest = sites.groupBy("sample_id").count().agg(F.max("count")).first()[0]
    per_box = max(32, math.isqrt(largest))
    task, row = F.shiftright("sid", 33), F.col("sid").bitwiseAND(F.lit(2**33 - 1))
    box = F.shiftleft(task, 32) + F.floor(row / per_box)
    return sites.select("sample_id", box.alias("box"), F.struct(F.col("site").alias("id"), "x", "y").alias("c"))


def _boxes(points: DataFrame) -> DataFrame:
    return points.groupBy("sample_id", "box").agg(
        F.min("c.x").alias("x1"),
        F.max("c.x").alias("x2"),
        F.min("c.y").alias("y1"),
        F.max("c.y").alias("y2"),
        F.min("c").alias("sample_point"),
    )


def _corner_offset(corner: str) -> Column:
    """Where the circle through a side and a point to its left is centred."""
    b = Bend(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    c = (F.col(f"{corner}.x") - F.col("ax"), F.col(f"{corner}.y") - F.col("ay"))
    end = F.col(f"{corner}.id").isin(F.col("a"), F.col("b"))
    return F.when(~end & (b.side(*c) == 1), b.offset(*c))


def _reaches(bound: Column) -> Column:
    """Can the box hold a point on the left inside the circle with this offset?"""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length = F.sqrt(dx * dx + dy * dy)
    turn_y = F.when(dx > 0, F.col("y2")).otherwise(F.col("y1"))
    turn_x = F.when(dy > 0, F.col("x1")).otherwise(F.col("x2"))
    on_left = dx * (turn_y - F.col("ay")) - dy * (turn_x - F.col("ax")) > 0
    middle_x = (F.col("ax") + F.col("bx")) / 2 - bound * dy / length
    middle_y = (F.col("ay") + F.col("by")) / 2 + bound * dx / length
    gap_x = F.greatest(F.col("x1") - middle_x, F.lit(0.0), middle_x - F.col("x2"))
    gap_y = F.greatest(F.col("y1") - middle_y, F.lit(0.0), middle_y - F.col("y2"))
    radius2 = length * length / 4 + bound * bound
    inside = gap_x * gap_x + gap_y * gap_y <= radius2 * (1 + 4 * TIE)
    return on_left & ((bound == INFINITY) | inside)


def _finite() -> Column:
    """Sides whose circle is known and not much wider than they are long."""
    length2 = F.pow(F.col("bx") - F.col("ax"), F.lit(2.0)) + F.pow(F.col("by") - F.col("ay"), F.lit(2.0))
    return (F.abs("bound") < INFINITY) & (F.col("bound") * F.col("bound") <= WIDEST * WIDEST * length2)


def _circle_corners(sides: DataFrame, points: DataFrame) -> DataFrame:
    """Third corners from the points inside the circle of each side, found on a grid."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length2 = dx * dx + dy * dy
    sources = sides.withColumns(
        {
            "x": (F.col("ax") + F.col("bx")) / 2 - F.col("bound") * dy / F.sqrt(length2),
            "y": (F.col("ay") + F.col("by")) / 2 + F.col("bound") * dx / F.sqrt(length2),
            "reach2": (length2 / 4 + F.col("bound") * F.col("bound")) * (1 + 16 * TIE),
            "copies": F.lit(1),
        }
    )
    targets = points.select("sample_id", F.col("c.id").alias("dst"), F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    inside = within_reach(small(sources, 50_000), targets)
    inside = inside.withColumn("c", F.struct(F.col("dst").alias("id"), F.col("tx").alias("x"), F.col("ty").alias("y")))
    inside = inside.withColumn("offset", _corner_offset("c")).where("offset IS NOT NULL")
    best = F.min("offset").over(Window.partitionBy(*SIDE))
    ranked = inside.withColumn("best", best)
    return ranked.where(F.col("offset") <= _limit()).select(*SIDE, "ax", "ay", "bx", "by", "best", "c")


def _limit() -> Column:
    return F.col("best") + _tolerance(F.col("best"), F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))


def _box_corners(sides: DataFrame, points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Third corners of sides with an open or very wide circle, from the boxes it reaches."""
    per_side = Window.partitionBy(*SIDE)
    candidates = (
        sides.join(boxes, "sample_id")
        .where(_reaches(F.col("bound")))
        .withColumn("bound", F.least("bound", F.min(_corner_offset("sample_point")).over(per_side)))
        .where(_reaches(F.col("bound")))
        .drop("sample_point")
    )
    candidates = small(candidates)
    nearest = (
        candidates.join(points, ["sample_id", "box"])
        .groupBy(*SIDE)
        .agg(F.min(_corner_offset("c")).alias("best"))
        .where("best is not null")
    )
    return (
        candidates.join(nearest, SIDE)
        .where(_reaches(_limit()))
        .join(points, ["sample_id", "box"])
        .where(_corner_offset("c") <= _limit())
        .select(*SIDE, "ax", "ay", "bx", "by", "best", "c")
    )


def _outward(waiting: DataFrame, points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Close every waiting side: find its third corners, or that it has none."""
    sides = waiting.select(*SIDE, "ax", "ay", "bx", "by", "bound")
    near = _circle_corners(sides.where(_finite()), points)
    corners = near.unionByName(_box_corners(sides.where(~_finite()), points, boxes))
    corners = corners.withColumn("alone", F.count(F.lit(1)).over(Window.partitionBy(*SIDE)) == 1)
    end = {
        name: F.struct(
            F.col(name).alias("id"), F.col(f"{name}x").alias("x"), F.col(f"{name}y").alias("y")
        )
        for name in ("a", "b")
    }
    found = corners.select(
        "sample_id",
        F.inline(
            _triangle_sides(end["a"], end["b"], F.col("c"), F.col("best"), F.lit(True), F.col("alone"))
        ),
    )
    settled = sides.withColumn("closed", F.lit(True))
    return found.unionByName(settled)
