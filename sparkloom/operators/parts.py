"""Connected parts of masks, flat and in depth, over the graph of their runs.

No mask is made dense.  Runs of all masks of a batch lie on one line, a
stretch of it for each pixel column with a gap behind columns, slices and
masks; the runs that touch one in the next column, or in the next slice, are
those that meet it when it is moved by a fixed distance.  Labels settle by
hooking and jumping, parts are sums over labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .masks import SIDE


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of a line in order, those that overlap or touch as one."""
    order = np.lexsort((end, start))
    start, end = start[order], end[order]
    far = np.maximum.accumulate(end) if len(end) else end
    new = np.flatnonzero(np.r_[len(start) > 0, start[1:] > far[:-1]])
    return start[new], np.maximum.reduceat(end, new) if len(new) else end


def meeting(start: np.ndarray, end: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of stretches, in order and apart, where i moved by shift overlaps j."""
    low, high = np.searchsorted(end, start + shift, "right"), np.searchsorted(start, end + shift, "left")
    n = np.maximum(high - low, 0)
    i = np.repeat(np.arange(len(start)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + low[i]


def settled(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least of 0..n-1 that pairs i, j connect each with."""
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def run_parts(mask: np.ndarray, z: np.ndarray, x: np.ndarray, y: np.ndarray, length: np.ndarray, height: int) -> dict[str, np.ndarray]:
    """Parts of many masks from their runs: mask, part (by first pixel, slice by slice and row by row), box and pixels.

    Pixels connect to the four beside them and to those of the same place in
    the slices before and after.  Runs may overlap.
    """
    names = ("mask", "part", "x1", "y1", "x2", "y2", "z1", "z2", "pixels")
    if not len(mask):
        return {k: np.zeros(0, np.int64) for k in names}
    tall, left, first = height + 1, int(x.min()), int(z.min())
    wide, deep = int(x.max()) - left + 2, int(z.max()) - first + 2
    at = ((mask * deep + z - first) * wide + x - left) * tall + y
    start, end = merged(at, at + length)
    i, j = (np.concatenate(p) for p in zip(meeting(start, end, tall), meeting(start, end, wide * tall), strict=True))
    label = settled(len(start), i, j)
    order = np.argsort(label, kind="stable")
    begin = np.flatnonzero(np.diff(label[order], prepend=-1))
    column, y = start[order] // tall, start[order] % tall
    n = (end - start)[order]
    stack, x = column // wide, column % wide + left
    mask, z = stack // deep, stack % deep + first
    low, high = (lambda v: np.minimum.reduceat(v, begin)), (lambda v: np.maximum.reduceat(v, begin))
    # a part's first pixel: its least slice, row and column, in this order
    place = low((z * tall + y) * (left + wide) + x)
    out = {"mask": mask[begin], "x1": low(x), "y1": low(y), "x2": high(x), "y2": high(y + n - 1), "z1": low(z), "z2": high(z), "pixels": np.add.reduceat(n, begin)}
    order = np.lexsort((place, out["mask"]))
    out = {k: v[order] for k, v in out.items()}
    fresh = np.flatnonzero(np.diff(out["mask"], prepend=-1))
    out["part"] = np.arange(len(order)) - np.repeat(fresh, np.diff(np.r_[fresh, len(order)]))
    return {k: out[k] for k in names}


def _parts(runs: DataFrame, keys: list[str], depth: str | None, height: int, columns: list[str]) -> DataFrame:
    z = F.col(depth).cast("bigint") if depth else F.lit(0).cast("bigint")
    row = F.struct(z.alias("z"), F.col("start").cast("bigint").alias("start"), F.col("length").cast("bigint").alias("length"))
    d = runs.groupBy(*keys).agg(F.collect_list(row).alias("_runs"))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in d.select(*keys).dtypes), *(f"{c} bigint" for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_runs")
            own, offsets = lists.flatten(), lists.offsets.to_numpy()
            z, start, length = (own.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("z", "start", "length"))
            mask = np.repeat(np.arange(len(lists)), np.diff(offsets))
            found = run_parts(mask, z, start // height, start % height, length, height)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(found["mask"])) for k in keys), *(pa.array(found[c]) for c in columns)], names=[*keys, *columns])

    return d.select(*keys, "_runs").mapInArrow(run, schema)


def component_boxes(runs: DataFrame, keys: list[str], height: int = SIDE) -> DataFrame:
    """part, x1, y1, x2, y2 of the 4-connected parts of each mask, numbered by first pixel row after row."""
    return _parts(runs, keys, None, height, ["part", "x1", "y1", "x2", "y2"])


def volume_components(runs: DataFrame, keys: list[str], slice_key: str, height: int = SIDE) -> DataFrame:
    """part, x1, y1, x2, y2, z1, z2, pixels of the 6-connected parts of each volume of stacked masks."""
    return _parts(runs, keys, slice_key, height, ["part", "x1", "y1", "x2", "y2", "z1", "z2", "pixels"])
