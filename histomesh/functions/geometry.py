"""Planar geometry as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CURVE_BITS = 26
# Relative sine below which three points count as lying on one line.
FLAT = 1e-12


def is_finite(name: str) -> Column:
    column = F.col(name)
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) != float("inf"))


def squared_distance(ax, ay, bx, by) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def _spread(value: Column) -> Column:
    """Put a zero bit between the bits of a 26-bit integer."""
    masks = (
        (16, 0x0000FFFF0000FFFF),
        (8, 0x00FF00FF00FF00FF),
        (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333),
        (1, 0x5555555555555555),
    )
    for step, mask in masks:
        value = value.bitwiseOR(F.shiftleft(value, step)).bitwiseAND(F.lit(mask))
    return value


def curve_cell(value: Column, origin: float, width: float) -> Column:
    """Position along one axis of the square frame, as a 26-bit integer."""
    if not width:
        return F.lit(0).cast("long")
    return ((value - origin) * (float(2**CURVE_BITS - 1) / width)).cast("long")


def curve_position(gx: Column, gy: Column) -> Column:
    """Position on a Z-order curve, from two 26-bit integers."""
    return _spread(gx).bitwiseOR(F.shiftleft(_spread(gy), 1))


def grid_exponent(length: Column) -> Column:
    """Smallest e with 2**e >= length, up to rounding of the logarithm."""
    return F.ceil(F.log2(length)).cast("int")


def grid_index(value: Column, exponent: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), exponent)).cast("long")


class Bend:
    """Where circles through the origin and (bx, by) meet a third point.

    The centres of these circles lie on the perpendicular bisector; ``offset``
    is the signed distance from the midpoint to the centre of the one that also
    passes through (cx, cy), positive to the left of the direction of b.
    """

    def __init__(self, bx: Column, by: Column):
        self.bx, self.by = bx, by
        self.length = F.sqrt(bx * bx + by * by)

    def cross(self, cx: Column, cy: Column) -> Column:
        return self.bx * cy - self.by * cx

    def power(self, cx: Column, cy: Column) -> Column:
        """Negative inside the circle that has b as its diameter."""
        return cx * (cx - self.bx) + cy * (cy - self.by)

    def side(self, cx: Column, cy: Column) -> Column:
        """1 to the left of b, -1 to the right, 0 on the line."""
        turn = self.cross(cx, cy)
        flat = F.abs(turn) <= F.lit(FLAT) * self.length * F.sqrt(cx * cx + cy * cy)
        return F.when(flat, 0).when(turn > 0, 1).otherwise(-1)

    def offset(self, cx: Column, cy: Column) -> Column:
        return self.length * self.power(cx, cy) / (F.lit(2.0) * self.cross(cx, cy))
