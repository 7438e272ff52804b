"""Binary masks as runs of pixels, column after column.

A run table has the mask's key columns, start and length, and may have
columns: then a run repeats in that many pixel columns (a strip), so that a
box is one row.  An absent mask has no rows.  The runs of one mask do not
overlap.  Set algebra of two masks is one shuffle by key: their runs, tagged
by side, follow each other in the order of keys; nothing is collected.  One
run table with a column side (0 true, 1 predicted) may stand for both masks;
the second table is None then.  Numeric kernels that no expression covers run
as Arrow functions over batches of masks (`strips`); runs are not exploded
before a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import dice, mask_iou, ratio
from . import strips

SIDE = 512


def box_runs(boxes: DataFrame, keys: list[str], height: int = SIDE) -> DataFrame:
    """Runs of filled boxes x1, y1, x2, y2, edges included: one for each pixel column."""
    x = F.explode(F.sequence("x1", "x2")).alias("x")
    d = boxes.select(*keys, "y1", "y2", x)
    return d.select(*keys, (F.col("x") * height + F.col("y1")).alias("start"), (F.col("y2") - F.col("y1") + 1).alias("length"))


def box_strips(boxes: DataFrame, keys: list[str], height: int = SIDE) -> DataFrame:
    """The same as a run table with columns: one row for each box."""
    return boxes.select(*keys, (F.col("x1") * height + F.col("y1")).alias("start"), (F.col("y2") - F.col("y1") + 1).alias("length"), (F.col("x2") - F.col("x1") + 1).alias("columns"))


def _columns(runs: DataFrame) -> Column:
    return F.col("columns").cast("bigint") if "columns" in runs.columns else F.lit(1).cast("bigint")


def mask_areas(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(F.sum(F.col("length") * _columns(runs)).cast("bigint").alias("area"))


def tight_boxes(runs: DataFrame, keys: list[str], height: int = SIDE) -> DataFrame:
    """Area and tight box of each mask; runs do not cross pixel columns."""
    x, y, more = F.floor(F.col("start") / height), F.col("start") % height, _columns(runs)
    return runs.groupBy(*keys).agg(
        F.sum(F.col("length") * more).cast("bigint").alias("area"), F.min(x).cast("bigint").alias("x1"), F.min(y).cast("bigint").alias("y1"),
        F.max(x + more - 1).cast("bigint").alias("x2"), F.max(y + F.col("length") - 1).cast("bigint").alias("y2"),
    )


def _tagged(runs: DataFrame, keys: list[str], side: Column | int = 0, *more: Column) -> DataFrame:
    side = F.lit(side) if isinstance(side, int) else side.cast("int")
    r = F.struct(side.alias("side"), F.col("start").cast("bigint").alias("start"), F.col("length").cast("bigint").alias("length"), _columns(runs).alias("columns"), *more)
    return runs.select(*keys, r.alias("r"))


def _swept(a: DataFrame, b: DataFrame | None, keys: list[str]) -> DataFrame:
    """The runs of both masks of every key: structs of side, start, length and columns."""
    return _tagged(a, keys, F.col("side")) if b is None else _tagged(a, keys, 0).unionByName(_tagged(b, keys, 1))


def _ordered(d: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows r in the order of keys, the first of each key marked: whole keys in whole partitions, sorted, however long the lists would be."""
    return d.withColumn("_first", F.row_number().over(W.partitionBy(*keys).orderBy(*order, "r.side")) == 1)


def _whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of `_ordered` rows cut where a key begins; the last key of a batch waits for the rest of its rows."""
    held: list[pa.RecordBatch] = []
    for batch in parts:
        first = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
        if len(first):
            held.append(batch.slice(0, first[-1]))
            if any(b.num_rows for b in held):
                yield pa.concat_batches(held)
            held = []
        held.append(batch.slice(first[-1]) if len(first) else batch)
    if held:
        yield pa.concat_batches(held)


def _grouped(d: DataFrame, keys: list[str], schema: str, run, *order: str) -> DataFrame:
    """keys with columns of `schema` from all rows r of each, which come in the order asked for: run(values, how many of them each key has), as for `_kernel`."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(parts):
            first = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
            yield from _stretches([batch.column(k).take(pa.array(first)) for k in keys], [*keys, *names], batch.column("r"), np.diff(first, append=batch.num_rows), run)

    out = _with(schema, d.select(*keys))
    names = T.StructType.fromDDL(schema).fieldNames()
    return _ordered(d, keys, *order).mapInArrow(batches, out)


def _kernel(d: DataFrame, column: str, schema: str, run) -> DataFrame:
    """d with columns of `schema` instead of a list column: run(values, lengths of the lists) gives them for a stretch of rows."""
    keys = [c for c in d.columns if c != column]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            yield from _stretches([batch.column(k) for k in keys], [*keys, *names], *strips.lists(batch.column(column)), run)

    out = _with(schema, d.select(*keys))
    names = T.StructType.fromDDL(schema).fieldNames()
    return d.mapInArrow(batches, out)


def _stretches(keys: list[pa.Array], names: list[str], values: pa.Array, counts: np.ndarray, run) -> Iterator[pa.RecordBatch]:
    """Results of run for stretches of rows."""
    edge = np.r_[0, np.cumsum(counts)]
    for i, j in strips.chunks(counts):
        own = run(values.slice(edge[i], edge[j] - edge[i]), counts[i:j])
        # results are columns of the same rows, or the row of each result and its columns
        at, columns = own if isinstance(own, tuple) else (None, own)
        left = [k.slice(i, j - i) for k in keys]
        left = left if at is None else [c.take(pa.array(at)) for c in left]
        yield pa.RecordBatch.from_arrays([*left, *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], names=names)


def _row_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


_AREAS = "gt_area bigint, pred_area bigint, shared bigint"


def shared_areas(a: DataFrame, b: DataFrame | None, keys: list[str], height: int = SIDE) -> DataFrame:
    """Pixels that masks of the same key share, for keys where they share any."""
    return _overlaps(a, b, keys, height).select(*keys, "shared").filter("shared > 0")


def _overlaps(truth: DataFrame, pred: DataFrame | None, keys: list[str], height: int) -> DataFrame:
    def run(values: pa.Array, counts: np.ndarray) -> list:
        return list(strips.overlap(*strips.read(values, _row_of(counts), height), len(counts)))

    return _grouped(_swept(truth, pred, keys), keys, _AREAS, run)


def mask_scores(truth: DataFrame, pred: DataFrame | None, keys: list[str], height: int = SIDE) -> DataFrame:
    """Dice, IoU, precision and recall for every key of either side; a missing side is an empty mask.

    height counts where a run table has columns.
    """
    return _measures(_overlaps(truth, pred, keys, height), keys)


def _measures(d: DataFrame, keys: list[str]) -> DataFrame:
    g, p, s = (F.col(c) for c in ("gt_area", "pred_area", "shared"))
    return d.select(*keys, g, p, s, dice(s, g, p).alias("dice"), mask_iou(s, g, p).alias("iou"), ratio(s, p).alias("precision"), ratio(s, g).alias("recall"))


RUNS = "array<struct<start:bigint,length:bigint>>"


STRIPS = "array<struct<start:bigint,length:bigint,columns:bigint>>"


def combine(a: DataFrame, b: DataFrame | None, keys: list[str], how: str, height: int = SIDE) -> DataFrame:
    """Runs of the pixels in both masks (and), either (or), one (xor), only the first (minus) or only the second (less).

    They have columns if those of either mask do.
    """
    wide = "columns" in a.columns or b is not None and "columns" in b.columns

    def run(values: pa.Array, counts: np.ndarray) -> tuple:
        (out,) = strips.combined(*strips.read(values, _row_of(counts), height), how)
        return _as_runs(out, wide, height)

    return _grouped(_swept(a, b, keys), keys, _runs_schema(wide), run)


def _runs_schema(wide: bool) -> str:
    return "start bigint, length bigint" + (", columns bigint" if wide else "")


def _as_runs(s: strips.Strips, wide: bool, height: int) -> tuple[np.ndarray, list[np.ndarray]]:
    if wide:
        return s.plane, [s.x * height + s.y, s.n, s.w]
    at, start, length = strips.runs(s, height)
    return at, [start, length]


def differences(truth: DataFrame, pred: DataFrame | None, keys: list[str], height: int = SIDE) -> DataFrame:
    """keys, missed, n_missed, false and n_false: the strips that a prediction lacks and that it has too much, and their pixels, for every key of either side."""

    def run(values: pa.Array, counts: np.ndarray) -> list:
        out = []
        for s in strips.combined(*strips.read(values, _row_of(counts), height), "minus", "less"):
            parts = pa.StructArray.from_arrays([pa.array(v) for v in (s.x * height + s.y, s.n, s.w)], names=["start", "length", "columns"])
            out += [strips.listed(parts, np.bincount(s.plane, minlength=len(counts))), strips.areas(s, len(counts))]
        return out

    return _grouped(_swept(truth, pred, keys), keys, f"missed {STRIPS}, n_missed bigint, false {STRIPS}, n_false bigint", run)


def sampled_dice(cases: DataFrame, truth: DataFrame, pred: DataFrame | None, key_z: str, height: int = SIDE) -> DataFrame:
    """(rec, r_dice, r_key_dice) of each case: see `rewards.dice_rewards`.

    A case is one more row among its record's runs, so that samples look
    their slices up where the masks meet; no slice is joined by itself.
    """
    whole = lambda c: F.col(c).cast("bigint")
    none = F.lit(None).cast("bigint")
    runs = _swept(truth, pred, ["rec", "z"]).select("rec", F.struct("r.*", whole("z").alias("z"), F.lit(None).cast("array<bigint>").alias("sampled"), none.alias("key")).alias("r"))
    asked = F.struct(F.lit(2).alias("side"), *(none.alias(c) for c in ("start", "length", "columns", "z")), F.col("sampled").cast("array<bigint>").alias("sampled"), whole(key_z).alias("key"))
    d = runs.unionByName(cases.filter("rec IS NOT NULL").select("rec", asked.alias("r")))

    def run(values: pa.Array, counts: np.ndarray) -> tuple:
        row = _row_of(counts)
        # a run without z is on no slice that could be asked for; cases have none either
        known = np.flatnonzero(values.field("z").is_valid())
        case = np.flatnonzero(values.field("side").to_numpy(zero_copy_only=False) == 2)
        runs, at = values.take(pa.array(known)), row[case]
        zs, z = np.unique(runs.field("z").to_numpy(zero_copy_only=False), return_inverse=True)
        # slices in order; one without runs is not among them
        slices, plane = np.unique(row[known] * max(len(zs), 1) + z, return_inverse=True)
        g, p, both = strips.overlap(*strips.read(runs, plane, height), len(slices))
        score = np.where(g + p > 0, 2 * both / np.maximum(g + p, 1), 1.0)

        def found(rows: np.ndarray, z: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            """Which of these slices have a mask, and where."""
            valid = z.is_valid().to_numpy(zero_copy_only=False)
            z = z.fill_null(0).to_numpy(zero_copy_only=False)
            if not len(slices):
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            place = np.minimum(np.searchsorted(zs, z), len(zs) - 1)
            code = rows * len(zs) + place
            spot = np.minimum(np.searchsorted(slices, code), len(slices) - 1)
            hit = np.flatnonzero(valid & (zs[place] == z) & (slices[spot] == code))
            return hit, spot[hit]

        asked = values.take(pa.array(case))
        drawn, sizes = strips.lists(asked.field("sampled").fill_null([]))
        of = _row_of(sizes)
        hit, spot = found(at[of], drawn)
        n = np.bincount(of[hit], minlength=len(case))
        mean = np.bincount(of[hit], score[spot], len(case)) / np.maximum(n, 1)
        key = np.zeros(len(case))
        hit, spot = found(at, asked.field("key"))
        key[hit] = np.where(g[spot] > 0, score[spot], 0)
        return at, [mean, key]

    return _grouped(d, ["rec"], "r_dice double, r_key_dice double", run)


def volume_scores(slices: DataFrame, keys: list[str]) -> DataFrame:
    """The same over the stacked slices of a volume."""
    v = slices.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("gt_area", "pred_area", "shared")), F.count("*").alias("n_slices"), F.avg("dice").alias("mean_dice"))
    g, p, s = (F.col(c) for c in ("gt_area", "pred_area", "shared"))
    return v.select(*keys, "n_slices", "mean_dice", dice(s, g, p).alias("dice"), ratio(s, p).alias("precision"), ratio(s, g).alias("recall"))


def case_scores(truth: DataFrame, pred: DataFrame | None, annotated: DataFrame | None, keys: list[str], slice_key: str, height: int = SIDE) -> tuple[DataFrame, DataFrame]:
    """Measures of the annotated slices, and of the volumes of these slices stacked in order.

    annotated: keys and slice_key of the slices that have a true mask, None for
    those with a run of one; a slice without a predicted mask is scored against
    an empty one, predicted masks of other slices do not count.  Both tables
    have dice, precision, recall and hd95, which is null where only one of the
    masks is empty.
    """
    both = [*keys, slice_key]
    d = _swept(truth, pred, both)
    if annotated is not None:
        # a slice that is annotated is one more row among the runs
        d = d.unionByName(annotated.select(*both, F.struct(F.lit(2).alias("side"), *(F.lit(None).cast("bigint").alias(c) for c in ("start", "length", "columns"))).alias("r")))
    mark = 0 if annotated is None else 2

    def scored(values: pa.Array, counts: np.ndarray) -> tuple:
        runs, plane, (row,) = _annotated(values, [_row_of(counts)], mark)
        s, side = strips.read(runs, plane, height)
        return row, [*strips.overlap(s, side, len(row)), _finite(strips.distances_95(s, side, len(row)))]

    slices = _measures(_grouped(d, both, f"{_AREAS}, hd95 double", scored), [*both, "hd95"])
    stacked = d.select(*keys, F.struct("r.*", F.col(slice_key).alias("z")).alias("r"))
    return slices, _volumes(stacked, keys, mark, height)


def _annotated(values: pa.Array, slices: list[np.ndarray], mark: int) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
    """Runs on slices that have a row of side `mark`, the number of each run's slice, and of these slices in order what identifies them.

    slices: columns of numbers that change where a slice begins.
    """
    new = np.zeros(len(values), bool)
    new[:1] = True
    for v in slices:
        new[1:] |= v[1:] != v[:-1]
    at = np.cumsum(new) - 1
    side = values.field("side").to_numpy(zero_copy_only=False)
    base = np.bincount(at[side == mark], minlength=int(new.sum())) > 0
    runs = np.flatnonzero(base[at] & (side < 2))
    first = np.flatnonzero(new)[base]
    return values.take(pa.array(runs)), (np.cumsum(base) - 1)[at[runs]], [v[first] for v in slices]


def _finite(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=~np.isfinite(values))


def _volumes(stacked: DataFrame, keys: list[str], mark: int, height: int) -> DataFrame:
    """Measures of volumes from runs with their slice z, which follow each other in its order."""

    def run(values: pa.Array, counts: np.ndarray) -> tuple:
        # equal neighbours are one slice, whatever the type of z
        z = values.field("z").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        runs, plane, (of, _) = _annotated(values, [_row_of(counts), z], mark)
        at, rows, depths = np.unique(of, return_inverse=True, return_counts=True)
        n, depth = len(at), int(depths.max(initial=0)) + 2
        # the slices of a row are planes next to each other, with an empty one on either side
        place = rows * depth + strips.within(depths) + 1
        s, side = strips.read(runs, place[plane], height)
        g, p, both = (v[place] for v in strips.overlap(s, side, n * depth))
        each = np.where(g + p > 0, 2 * both / np.maximum(g + p, 1), 1.0)
        total = [np.bincount(rows, v, n).astype(np.int64) for v in (g, p, both)]
        return at, [*total, depths.astype(np.int64), np.bincount(rows, each, n) / np.maximum(depths, 1), _finite(strips.distances_95(s, side, n, depth))]

    d = _grouped(stacked, keys, f"{_AREAS}, n_slices bigint, mean_dice double, hd95 double", run, "r.z")
    g, p, s = (F.col(c) for c in ("gt_area", "pred_area", "shared"))
    return d.select(*keys, g, p, s, dice(s, g, p).alias("dice"), mask_iou(s, g, p).alias("iou"), ratio(s, p).alias("precision"), ratio(s, g).alias("recall"), "n_slices", "mean_dice", "hd95")


def run_counts(runs: DataFrame, keys: list[str], pixels: int, height: int = SIDE) -> DataFrame:
    """Alternating lengths of background and mask, the uncompressed run-length form."""
    run = lambda values, counts: [strips.listed(*_alternating(values, counts, pixels, height))]
    return _grouped(_tagged(runs, keys), keys, "counts array<bigint>", run)


def run_texts(runs: DataFrame, keys: list[str], pixels: int, height: int = SIDE) -> DataFrame:
    """The same as compressed texts."""
    run = lambda values, counts: [pa.array(strips.compressed(*_alternating(values, counts, pixels, height)), pa.string())]
    return _grouped(_tagged(runs, keys), keys, "counts string", run)


def _alternating(values: pa.Array, counts: np.ndarray, pixels: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Alternating lengths of all masks, and how many each has."""
    s, _ = strips.read(values, _row_of(counts), height)
    row, start, length = strips.runs(s, height)
    # a background stretch before each run, and one after the last if there is room
    first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    gap = start - np.where(first, 0, np.r_[0, (start + length)[:-1]])
    last = np.flatnonzero(np.r_[first[1:], True][: len(row)])
    tail = pixels - (start + length)[last]
    size = np.bincount(row, minlength=len(counts)) * 2
    out = np.empty(2 * len(row), np.int64)
    out[::2], out[1::2] = gap, length
    room = np.flatnonzero(tail > 0)
    size[row[last[room]]] += 1
    return np.insert(out, 2 * last[room] + 2, tail[room]), size


def counts_to_runs(counts: DataFrame, keys: list[str], height: int = SIDE) -> DataFrame:
    """Runs from alternating lengths, cut at pixel columns."""

    def run(values: pa.Array, sizes: np.ndarray) -> tuple:
        row, begin, length = _cut_counts(values.to_numpy(zero_copy_only=False).astype(np.int64), sizes, np.full(len(sizes), height))
        return row, [begin, length]

    return _kernel(counts.select(*keys, "counts"), "counts", "start bigint, length bigint", run)


def _cut_counts(length: np.ndarray, sizes: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of the runs of alternating lengths, cut at the pixel columns of each row's height."""
    end = np.cumsum(length)
    before = np.r_[0, end][np.cumsum(sizes) - sizes]
    row = _row_of(sizes)
    on = np.flatnonzero((strips.within(sizes) % 2 == 1) & (length > 0))
    row, start, length = row[on], (end - length)[on] - before[row[on]], length[on]
    tall = height[row]
    top = start // tall
    k = (start + length - 1) // tall - top + 1
    of = np.repeat(np.arange(len(k)), k)
    column, tall = top[of] + strips.within(k), tall[of]
    begin = np.maximum(start[of], column * tall)
    return row[of], begin, np.minimum((start + length)[of], (column + 1) * tall) - begin


def texts_to_runs(d: DataFrame, wide: bool = False) -> DataFrame:
    """d with runs (wide: strips) instead of counts, compressed texts; each row has its own height."""
    keys = [c for c in d.columns if c != "counts"]

    def run(texts: pa.Array, height: np.ndarray) -> tuple:
        row, start, n = _cut_counts(*strips.expanded(texts.to_pylist()), height)
        if not wide:
            return row, [start, n]
        # runs alike in columns next to each other are one strip
        tall = height[row]
        same = (row[1:] == row[:-1]) & (n[1:] == n[:-1]) & (start[1:] == start[:-1] + tall[1:])
        first = np.flatnonzero(np.r_[True, ~same]) if len(row) else np.zeros(0, np.int64)
        return row[first], [start[first], n[first], np.diff(first, append=len(row))]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            size = np.array([len(t) for t in batch.column("counts").to_pylist()], np.int64)
            for i, j in strips.chunks(size):
                part = batch.slice(i, j - i)
                at, columns = run(part.column("counts"), part.column("height").to_numpy(zero_copy_only=False).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(at)) for k in keys), *(pa.array(c) for c in columns)], names=[*keys, *names])

    out = _with(_runs_schema(wide), d.select(*keys))
    names = T.StructType.fromDDL(_runs_schema(wide)).fieldNames()
    return d.filter("counts IS NOT NULL AND height IS NOT NULL").select(*keys, "counts").mapInArrow(batches, out)


def dense(starts: np.ndarray, lengths: np.ndarray, width: int, height: int) -> np.ndarray:
    """A mask as a height x width array, from runs column after column."""
    edge = np.zeros(width * height + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return (np.cumsum(edge)[:-1] > 0).reshape(width, height).T


def surface(mask: np.ndarray) -> np.ndarray:
    """Mask pixels with a neighbour outside, the image's edge included."""
    inner = mask.copy()
    for axis in range(mask.ndim):
        for shift in (1, -1):
            near = np.roll(mask, shift, axis)
            edge = [slice(None)] * mask.ndim
            edge[axis] = 0 if shift == 1 else -1
            near[tuple(edge)] = False
            inner &= near
    return mask & ~inner


def squared_distances(points: np.ndarray) -> np.ndarray:
    """Squared distance of each cell of an array to the nearest true one, axis by axis.

    Along an axis a cell takes the least of its neighbours' values plus the
    squared step; steps end once they cannot lower the largest value left.
    """
    d = np.where(points, 0.0, np.inf)
    for axis in range(points.ndim):
        own = np.moveaxis(d, axis, 0)
        best = own.copy()
        for step in range(1, len(own)):
            if step * step >= best.max(initial=0):
                break
            np.minimum(best[step:], own[:-step] + step * step, out=best[step:])
            np.minimum(best[:-step], own[step:] + step * step, out=best[:-step])
        d = np.moveaxis(best, 0, axis)
    return d


def hausdorff_95(a: np.ndarray, b: np.ndarray) -> float:
    """95th percentile of the distances from either surface to the other, in any dimension; inf if one mask is empty."""
    return surface_distance(np.argwhere(surface(a)), np.argwhere(surface(b)))


def surface_points(runs: np.ndarray, flat: bool) -> np.ndarray:
    """Surface pixels (depth, column, row) of a mask from its runs (depth, column, first row, length).

    A pixel is inside if its neighbours in all directions are in the mask; a
    flat mask has no neighbours in depth.
    """
    if not runs.size:
        return np.zeros((0, 3), np.int64)
    n = runs[3]
    first = np.repeat(np.arange(len(n)), n)
    z, x = runs[0][first], runs[1][first]
    y = runs[2][first] + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
    low = np.array([z.min(), x.min(), y.min()])
    z, x, y = z - low[0] + 1, x - low[1] + 1, y - low[2] + 1
    rows, columns = y.max() + 2, x.max() + 2
    code = np.sort((z * columns + x) * rows + y)
    inside = np.ones(len(code), bool)
    for step in (1, rows) if flat else (1, rows, rows * columns):
        for other in (code + step, code - step):
            inside &= code[np.minimum(np.searchsorted(code, other), len(code) - 1)] == other
    edge = code[~inside]
    return np.stack([edge // rows // columns, edge // rows % columns, edge % rows], axis=1) + low - 1


#: Pairs of a point and a run of points up to which their distances are taken one by one, and in one step.
PAIRS, STEP_PAIRS = 50_000_000, 500_000


def _point_runs(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points as runs along their last axis: the other coordinates, first and last place."""
    points = points[np.lexsort(points.T[::-1])]
    step = np.diff(points, axis=0)
    first = np.flatnonzero(np.r_[True, (step[:, :-1] != 0).any(axis=1) | (step[:, -1] != 1)])
    last = np.r_[first[1:], len(points)] - 1
    return points[first, :-1], points[first, -1], points[last, -1]


def _nearest_run(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distance of each point to the nearest of the others, which go as runs."""
    at, low, high = _point_runs(others)
    out, size = np.empty(len(points)), max(1, STEP_PAIRS // len(low))
    for i in range(0, len(points), size):
        x = points[i : i + size]
        y = x[:, -1:]
        d = np.maximum(np.maximum(low - y, y - high), 0) ** 2
        for axis in range(at.shape[1]):
            d += (x[:, axis : axis + 1] - at[:, axis]) ** 2
        out[i : i + size] = d.min(axis=1)
    return out


def surface_distance(p: np.ndarray, q: np.ndarray) -> float:
    """95th percentile of the distances of either set of points to the other; 0 if both are empty, inf if one is.

    Many points go through a transform of the box around them.
    """
    if not len(p) or not len(q):
        return 0.0 if len(p) == len(q) else float("inf")
    if max(len(p) * len(_point_runs(q)[1]), len(q) * len(_point_runs(p)[1])) > PAIRS:
        low, high = np.minimum(p.min(axis=0), q.min(axis=0)), np.maximum(p.max(axis=0), q.max(axis=0))
        at = [tuple((x - low).T) for x in (p, q)]
        on = [np.zeros(high - low + 1, bool) for _ in range(2)]
        for grid, place in zip(on, at, strict=True):
            grid[place] = True
        far = np.concatenate([squared_distances(on[1])[at[0]], squared_distances(on[0])[at[1]]])
    else:
        far = np.concatenate([_nearest_run(p, q), _nearest_run(q, p)])
    return float(np.percentile(np.sqrt(far), 95))


def dilate(mask: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        grown = mask.copy()
        grown[1:] |= mask[:-1]
        grown[:-1] |= mask[1:]
        grown[:, 1:] |= mask[:, :-1]
        grown[:, :-1] |= mask[:, 1:]
        mask = grown
    return mask


def erode(mask: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        mask = mask & ~surface(mask)
    return mask


def _with(schema: str, keys: DataFrame) -> str:
    return ", ".join([*(f"{n} {t}" for n, t in keys.dtypes), schema])


def hausdorff(truth: DataFrame, pred: DataFrame | None, keys: list[str], height: int = SIDE) -> DataFrame:
    """hd95 of each key's two masks; null and undefined = true where one is empty."""

    def run(values: pa.Array, counts: np.ndarray) -> list:
        far = strips.distances_95(*strips.read(values, _row_of(counts), height), len(counts))
        return [_finite(far), ~np.isfinite(far)]

    return _grouped(_swept(truth, pred, keys), keys, "hd95 double, undefined boolean", run)


def _mapped(runs: DataFrame, keys: list[str], change, height: int) -> DataFrame:
    """Runs of change(strips, seed of each mask) for all masks of a batch; a seed hangs on the key alone."""
    wide = "columns" in runs.columns

    def run(values: pa.Array, counts: np.ndarray) -> tuple:
        return _as_runs(change(*_seeded(values, counts, height)), wide, height)

    return _grouped(_tagged(runs, keys, 0, _seed(keys)), keys, _runs_schema(wide), run)


def _seed(keys: list[str]) -> Column:
    return F.xxhash64(*keys).alias("seed")


def _seeded(values: pa.Array, counts: np.ndarray, height: int) -> tuple[strips.Strips, np.ndarray]:
    seeds = values.field("seed").to_numpy(zero_copy_only=False)[np.cumsum(counts) - counts] & (1 << 63) - 1
    return strips.read(values, _row_of(counts), height)[0], seeds


#: What becomes of all masks of a batch: from their strips and seeds, width and height.
Change = Callable[[strips.Strips, np.ndarray, int, int], strips.Strips]


def changed_areas(runs: DataFrame, keys: list[str], changes: dict[str, Change], width: int = SIDE, height: int = SIDE) -> DataFrame:
    """keys and the pixels of each mask after each change, by name, from one pass; masks that a change leaves none of count as 0."""

    def run(values: pa.Array, counts: np.ndarray) -> list:
        s, seed = _seeded(values, counts, height)
        return [strips.areas(change(s, seed, width, height), len(counts)) for change in changes.values()]

    return _grouped(_tagged(runs, keys, 0, _seed(keys)), keys, ", ".join(f"{name} bigint" for name in changes), run)


def _times(s: strips.Strips, grow: np.ndarray, shrink: np.ndarray, width: int, height: int) -> strips.Strips:
    """Each mask grown or shrunk as many times as asked for it."""
    for times, step in ((grow, strips.dilated), (shrink, strips.eroded)):
        for i in range(int(times.max(initial=0))):
            on = times[s.plane] > i
            s = strips.joined(s.take(~on), step(s.take(on), width, height))
    return s


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of a dense mask's runs, none across pixel columns."""
    flat = np.zeros((mask.shape[1], mask.shape[0] + 2), np.int8)
    flat[:, 1:-1] = mask.T
    step = np.diff(flat, axis=1)
    column, row = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    return column * mask.shape[0] + row, end - row


def morphed(times: int, grow: bool) -> Change:
    """Masks grown or shrunk by `times` pixels in the four directions."""
    on = lambda seed, yes: np.full(len(seed), times if yes else 0)
    return lambda s, seed, width, height: _times(s, on(seed, grow), on(seed, not grow), width, height)


def as_simulated(s: strips.Strips, seed: np.ndarray, width: int, height: int) -> strips.Strips:
    even = seed % 2 == 0
    return _times(s, np.where(even, 1 + seed // 2 % 3, 0), np.where(even, 0, 1 + seed // 2 % 2), width, height)


def as_corrected(s: strips.Strips, seed: np.ndarray, width: int, height: int) -> strips.Strips:
    return _times(s, seed % 2, np.zeros_like(seed), width, height)


def morph(runs: DataFrame, keys: list[str], times: int, grow: bool, width: int = SIDE, height: int = SIDE) -> DataFrame:
    """Runs of the masks grown or shrunk by `times` pixels in the four directions."""
    change = morphed(times, grow)
    return _mapped(runs, keys, lambda s, seed: change(s, seed, width, height), height)


def simulated(runs: DataFrame, keys: list[str], width: int = SIDE, height: int = SIDE) -> DataFrame:
    """Masks as a segmenter might give them: half grown by 1 to 3 pixels, half shrunk by 1 or 2, by a hash of the key."""
    return _mapped(runs, keys, lambda s, seed: as_simulated(s, seed, width, height), height)


def corrected(runs: DataFrame, keys: list[str], width: int = SIDE, height: int = SIDE) -> DataFrame:
    """True masks as they come back from a correction: as they are, or grown by a pixel, by a hash of the key."""
    return _mapped(runs, keys, lambda s, seed: as_corrected(s, seed, width, height), height)


def to_compressed(counts: list[int] | np.ndarray) -> str:
    """Alternating lengths as the compressed text of the usual run-length files.

    From the fourth on a length is written as its difference from the one two
    before; each number goes out in groups of five bits, the lowest first, with
    a sixth that says whether more follow, as characters from "0" on.
    """
    out = []
    for i, c in enumerate(counts):
        value = int(c) - (int(counts[i - 2]) if i > 2 else 0)
        more = True
        while more:
            low, value = value & 31, value >> 5
            more = value != (-1 if low & 16 else 0)
            out.append(chr(48 + (low | (32 if more else 0))))
    return "".join(out)


def from_compressed(text: str) -> list[int]:
    """Alternating lengths from the compressed text."""
    counts: list[int] = []
    value = shift = 0
    for char in text:
        bits = ord(char) - 48
        value |= (bits & 31) << shift
        shift += 5
        if not bits & 32:
            if bits & 16:
                value -= 1 << shift
            counts.append(value + (counts[-2] if len(counts) > 2 else 0))
            value = shift = 0
    return counts


@F.pandas_udf(T.StringType())
def compress_counts(counts: pd.Series) -> pd.Series:
    known = counts.notna().to_numpy()
    own = counts[known]
    sizes = np.array([len(c) for c in own], np.int64)
    out = pd.Series([None] * len(counts), index=counts.index, dtype=object)
    out[known] = strips.compressed(np.concatenate(own.to_list()) if sizes.sum() else np.zeros(0, np.int64), sizes)
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def expand_counts(texts: pd.Series) -> pd.Series:
    known = texts.notna().to_numpy()
    values, sizes = strips.expanded(texts[known].to_list())
    out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
    out[known] = pd.Series(np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else [], index=texts.index[known], dtype=object)
    return out
