"""Box arithmetic as column expressions.  A box is four columns or a struct x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box_of(column: str | Column) -> Box:
    c = F.col(column) if isinstance(column, str) else column
    return c["x1"], c["y1"], c["x2"], c["y2"]


def box_struct(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def area(b: Box) -> Column:
    zero = F.lit(0)
    return F.greatest(b[2] - b[0], zero) * F.greatest(b[3] - b[1], zero)


def intersection(a: Box, b: Box) -> Column:
    return area((F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])))


def box_iou(a: Box, b: Box) -> Column:
    """Overlap over union; 0 without overlap or without any area."""
    shared = intersection(a, b)
    return F.when(shared > 0, ratio(shared, area(a) + area(b) - shared)).otherwise(F.lit(0.0))


def tight_box_iou(box: Box, tight: Box | None, empty: Column) -> Column:
    """IoU with a mask's tight box, whose far edges are not widened; an empty mask scores 1."""
    return F.when(empty, F.lit(1.0)).otherwise(box_iou(box, tight))


def sanitize_box(b: Box, width: Column, height: Column) -> Column:
    """Corners put in order and clamped to the image; null if nothing is left."""
    clamp = lambda v, top: F.least(F.greatest(v, F.lit(0)), top)
    x1, x2 = (clamp(f(b[0], b[2]), width) for f in (F.least, F.greatest))
    y1, y2 = (clamp(f(b[1], b[3]), height) for f in (F.least, F.greatest))
    return F.when((x2 > x1) & (y2 > y1), box_struct(x1, y1, x2, y2))


def scale_by_mode(value: Column, side: Column, mode: Column, largest: Column) -> Column:
    """A coordinate in pixels.

    auto: unit coordinates if the box's largest is at most 1.5, else pixels.
    norm1: unit; norm1000: thousandths of a fixed 512 side; norm1000_image:
    thousandths of the image's side; real: pixels.
    """
    unit = value * side
    return (
        F.when(mode == "norm1", unit)
        .when(mode == "norm1000", value * F.lit(0.512))
        .when(mode == "norm1000_image", value / F.lit(1000.0) * side)
        .when((mode == "auto") & (largest <= 1.5), unit)
        .otherwise(value.cast("double"))
    )


def scale_box(b: Box, width: Column, height: Column, rows_first: bool = False) -> Column:
    """A box in thousandths as pixels of an image; rows_first: its corners are given as y, x."""
    x1, y1, x2, y2 = (b[1], b[0], b[3], b[2]) if rows_first else b
    return box_struct(scale_thousandths(x1, width), scale_thousandths(y1, height), scale_thousandths(x2, width), scale_thousandths(y2, height))


def to_square(b: Box, width: Column, height: Column, side: int = 512) -> Column:
    """A box of an image in a square one, in single precision."""
    put = lambda v, old: (v * F.lit(float(side)) / old).cast("float")
    return box_struct(put(b[0], width), put(b[1], height), put(b[2], width), put(b[3], height))


def slice_iou(iou: Column, known: Column) -> Column:
    """An overlap to three digits; 0 where the slice has no mask or does not exist."""
    return F.when(F.coalesce(known, F.lit(False)), F.bround(iou, 3)).otherwise(F.lit(0.0))


def overlap_class(pred: Column, truth: Column) -> Column:
    """A pixel's class in an overlap map: hit, missed, false or none."""
    return F.when(pred & truth, "hit").when(truth, "missed").when(pred, "false").otherwise("none")


def blend(value: Column, color: Column, share: float = 0.45) -> Column:
    """A channel's value under a translucent color, cut down to a whole number."""
    return F.least(F.greatest((value * F.lit(1 - share) + color * F.lit(share)), F.lit(0.0)), F.lit(255.0)).cast("int")


def scale_thousandths(value: Column, side: Column) -> Column:
    return value / F.lit(1000.0) * side


def center(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / F.lit(2.0), (b[1] + b[3]) / F.lit(2.0)


def too_small(b: Box, least_area: int = 20, least_side: int = 3) -> Column:
    w, h = b[2] - b[0], b[3] - b[1]
    return (w * h < least_area) | (w < least_side) | (h < least_side)


def resize_box(b: Box, width: Column, height: Column, new_width: int, new_height: int, thousandths: bool = False) -> Column:
    """Box in another image size, rounded half to even and clamped; optionally in thousandths."""

    def put(v: Column, old: Column, new: int) -> Column:
        pixel = F.least(F.greatest(F.rint(v * F.lit(float(new)) / old), F.lit(0.0)), F.lit(float(new)))
        return (F.rint(pixel / F.lit(float(new)) * 1000) if thousandths else pixel).cast("int")

    return box_struct(put(b[0], width, new_width), put(b[1], height, new_height), put(b[2], width, new_width), put(b[3], height, new_height))


def shift_box(b: Box, share: float, width: Column, height: Column) -> Column:
    """A failed annotation: both corners moved by a share of the sides, kept inside the image."""
    dx, dy = (F.floor((hi - lo) * F.lit(share)).cast("int") for lo, hi in ((b[0], b[2]), (b[1], b[3])))
    inside = lambda v, top: F.least(v, top - 1)
    return box_struct(inside(b[0] + dx, width), inside(b[1] + dy, height), inside(b[2] + dx, width), inside(b[3] + dy, height))


def jitter_box(b: Box, share: float, width: Column, height: Column, u: tuple[Column, Column, Column, Column]) -> Column:
    """Each corner moved by up to a share of its side; u are four uniform numbers in [0, 1).

    Corners are cut to whole pixels and clipped one after the other, so that
    the second lies beyond the first wherever the image has room for it.
    """
    w, h = b[2] - b[0], b[3] - b[1]
    move = lambda v, side, r: (v + (r * 2 - 1) * side * F.lit(share)).cast("int")
    clip = lambda v, low, high: F.least(F.greatest(v, low), high)
    x1 = clip(move(b[0], w, u[0]), F.lit(0), width - 1)
    y1 = clip(move(b[1], h, u[1]), F.lit(0), height - 1)
    x2 = clip(move(b[2], w, u[2]), x1 + 1, width - 1)
    y2 = clip(move(b[3], h, u[3]), y1 + 1, height - 1)
    return box_struct(x1, y1, x2, y2)


def dice(shared: Column, a: Column, b: Column) -> Column:
    """2 shared / (a + b); 1 if both are empty."""
    return F.when((a == 0) & (b == 0), F.lit(1.0)).otherwise(ratio(2 * shared, a + b))


def mask_iou(shared: Column, a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b == 0), F.lit(1.0)).otherwise(ratio(shared, a + b - shared))
