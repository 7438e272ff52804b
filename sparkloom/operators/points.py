"""Points on the pixels where a prediction errs, drawn without replacement and without making the pixels.

A mask stays an array of runs.  A pixel's rank is its place among the mask's
pixels in run order; running sums of run lengths turn a rank into a pixel, so
a draw costs the mask's runs, whatever the pixels in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import strips
from .masks import SIDE, differences

#: Points on missed and on false pixels at most.
MISSED, FALSE = 3, 2


def pixels(runs: Column) -> Column:
    """Pixels of an array of runs."""
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda n, r: n + r["length"])


def draw_ranks(n: Column, k: int, seed: int, *key: Column) -> Column:
    """k different numbers of 0..n-1, ascending, or all of them if there are no more; the key alone decides which.

    Every set of k is as likely as any other: the i-th number is drawn from
    the first n - k + i + 1; one that is there already gives way to the last
    of these.
    """
    text = lambda i: F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in key), i.cast("string"))
    number = lambda i: F.conv(F.substring(F.md5(text(i).cast("binary")), 1, 15), 16, 10).cast("bigint")

    def step(out: Column, i: Column) -> Column:
        last = n - k + i
        drawn = F.pmod(number(i), last + 1)
        return F.array_append(out, F.when(F.array_contains(out, drawn), last).otherwise(drawn))

    none = F.array().cast("array<bigint>")
    few = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(none)
    return F.when(n <= k, few).otherwise(F.array_sort(F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), none, step))) if k else none


def pixels_at(runs: Column, ranks: Column) -> Column:
    """The pixels of these ranks in an array of ordered runs."""
    # the ranks are part of the state: a lambda would compute them anew for each run
    begin = F.struct(F.lit(0).cast("bigint").alias("before"), ranks.alias("ranks"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        after = s["before"] + r["length"]
        here = F.filter(s["ranks"], lambda k: (k >= s["before"]) & (k < after))
        return F.struct(after.alias("before"), s["ranks"].alias("ranks"), F.concat(s["out"], F.transform(here, lambda k: r["start"] + k - s["before"])).alias("out"))

    return F.aggregate(runs, begin, step)["out"]


def error_points(truth: DataFrame, pred: DataFrame, keys: list[str], seed: int = 42, missed: int = MISSED, false: int = FALSE, height: int = SIDE) -> DataFrame:
    """keys, points [[x, y], ...] and labels of each key of either run table.

    Up to `missed` pixels of the truth that the prediction lacks (label 1),
    then up to `false` that it has too much (label 0); all of them where
    there are no more.  Equal masks have no points.  A missing side is an
    empty mask.  Both masks meet in one shuffle by the keys.
    """
    d = differences(truth, pred, keys, height)
    ranks = lambda side, k, label: draw_ranks(F.col(f"n_{side}"), k, seed, *(F.col(c) for c in keys), F.lit(label))
    d = d.select(*keys, "missed", "false", ranks("missed", missed, 1).alias("r1"), ranks("false", false, 0).alias("r0"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spots = batch.num_rows, []
            for side, rank in (("missed", "r1"), ("false", "r0")):
                values, counts = strips.lists(batch.column(side))
                start, length, columns = (values.field(k).to_numpy(zero_copy_only=False) for k in ("start", "length", "columns"))
                own = strips.cut(np.repeat(np.arange(n), counts), start, length, columns, height)
                drawn, size = strips.lists(batch.column(rank))
                row = np.repeat(np.arange(n), size)
                spots.append((row, *strips.pixels_of_ranks(own, n, row, drawn.to_numpy(zero_copy_only=False))))
            row = np.concatenate([s[0] for s in spots])
            order = np.argsort(row, kind="stable")
            x, y = (np.concatenate([s[k] for s in spots])[order].astype(np.int32) for k in (1, 2))
            label = np.repeat(np.array([1, 0], np.int32), [len(s[0]) for s in spots])[order]
            each = np.bincount(row, minlength=n)
            points = strips.listed(strips.listed(np.stack([x, y], axis=1).ravel(), np.full(len(x), 2)), each)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), points, strips.listed(label, each)], names=[*keys, "points", "labels"])

    fields = ", ".join(f"`{n}` {t}" for n, t in d.select(*keys).dtypes)
    return d.mapInArrow(run, f"{fields}, points array<array<int>>, labels array<int>")
