"""Boxes as column expressions. A box is a tuple of four columns (x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", names: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1")) -> Box:
    """The columns of a box by their common prefix."""
    return tuple(F.col(prefix + n) for n in names)


def literal(*v: float) -> Box:
    return tuple(F.lit(float(x)) for x in v)


def width(b: Box) -> Column:
    return b[2] - b[0]


def height(b: Box) -> Column:
    return b[3] - b[1]


def area(b: Box) -> Column:
    return width(b) * height(b)


def checked(c: Column, n: int = 4) -> Column:
    """An array column that has to have n elements."""
    return F.when(F.assert_true(F.size(c) == n, F.lit(f"must have {n} elements")).isNull(), c)


def rescale(b: Box, frame: Box, onto: Box) -> Box:
    """A box of one frame in the units of another (origins aren't moved)."""
    sx, sy = width(frame) / width(onto), height(frame) / height(onto)
    return b[0] / sx, b[1] / sy, b[2] / sx, b[3] / sy


def rescale_int(b: Box, size: tuple[Column, Column], onto: tuple[Column, Column]) -> Box:
    """A box of one size in whole units of another, cut towards 0."""
    s = [onto[0] / size[0], onto[1] / size[1]]
    return tuple((v * s[i % 2]).cast("int") for i, v in enumerate(b))


def intersection_pct(a: Box, b: Box) -> Column:
    """Share of a's area that b covers; 0 where they are apart or a has no area."""
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w < 0) | (h < 0) | (area(a) == 0), F.lit(0.0)).otherwise(w * h / area(a))


def intersects(a: Box, b: Box) -> Column:
    """Whether the insides of two boxes meet."""
    return (a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1])


def adjacent(a: Box, b: Box, tolerance: float = 5) -> Column:
    """Whether b stands right of a on the same line."""
    return (F.abs(a[1] - b[1]) < tolerance) & (F.abs(a[3] - b[3]) < tolerance) & (b[0] - a[2] < tolerance) & (b[0] > a[0])


def unnormalize(b: Box, w: Column, h: Column) -> Box:
    """A box in thousandths of a page, in its units."""
    return w * (b[0] / 1000), h * (b[1] / 1000), w * (b[2] / 1000), h * (b[3] / 1000)


def closure(prefix: str = "", out: str | None = None) -> list[Column]:
    """Aggregates for the smallest box around a group's boxes."""
    out = prefix if out is None else out
    return [F.min(f"{prefix}x0").alias(f"{out}x0"), F.min(f"{prefix}y0").alias(f"{out}y0"), F.max(f"{prefix}x1").alias(f"{out}x1"), F.max(f"{prefix}y1").alias(f"{out}y1")]


def floored(b: Box, divisor: float) -> Box:
    return tuple(F.floor(v / divisor) * divisor for v in b)


def corners(b: Box) -> Column:
    """The polygon of a box, clockwise from the top left."""
    return F.array(F.array(b[0], b[1]), F.array(b[2], b[1]), F.array(b[2], b[3]), F.array(b[0], b[3]))


def polygon_box(p: Column) -> Box:
    """The box of a polygon from its first three corners, sides in order."""
    x0, y0, x1, y1 = p[0][0], p[0][1], p[1][0], p[2][1]
    return F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)


def clamp_polygon(p: Column, bounds: Box) -> Column:
    return F.transform(p, lambda c: F.array(F.greatest(F.least(c[0], bounds[2]), bounds[0]), F.greatest(F.least(c[1], bounds[3]), bounds[1])))


def margin_pct(a: Box, b: Box, margin: float = 0.0) -> Column:
    """Like intersection_pct, with b made smaller by a whole share of the smaller width."""
    m = F.floor(F.least(width(a), width(b)) * margin) if margin else F.lit(0)
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2] - m) - F.greatest(a[0], b[0] + m))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3] - m) - F.greatest(a[1], b[1] + m))
    return F.when(area(a) == 0, F.lit(0.0)).otherwise(w * h / area(a))


def from_center(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return cx - 0.5 * w, cy - 0.5 * h, cx + 0.5 * w, cy + 0.5 * h


def half_even(c: Column) -> Column:
    """Round half to even."""
    return F.rint(c)
