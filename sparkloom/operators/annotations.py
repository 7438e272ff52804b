"""The annotation layer: numbering, splits, look-ups and sampling of slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import hash_order, hash_uniform, int_linspace


#: Ranges that numbered keys are cut into, and keys looked at for each cut.
RANGES, CUT_KEYS = 256, 32


def range_cuts(keys: DataFrame, key: str, ranges: int = RANGES) -> list:
    """Some `ranges` keys in order that cut all keys into ranges of about the same number.

    They come from a bounded sample by hash, so a rerun finds the same; what
    is numbered does not hang on them.
    """
    n = keys.count()
    share = min(1.0, ranges * CUT_KEYS / max(n, 1))
    few = keys.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share * (1 << 30))
    place = F.row_number().over(W.orderBy(key))  # some thousands of keys, whatever their number
    step = max(1, int(n * share) // ranges)
    return [r[0] for r in few.withColumn("place", place).filter(F.col("place") % step == 0).orderBy(key).select(key).collect()] if n > ranges * CUT_KEYS else []


def running_totals(keys: DataFrame, key: str, size: str | Column) -> DataFrame:
    """keys with `before`: the sum of size over all smaller keys, in code-point order; keys are distinct.

    Keys are cut into ranges; only the ranges' totals are summed up in one
    place, and each range is numbered by itself.
    """
    cuts = range_cuts(keys.select(key), key)
    bounds = F.array(*(F.lit(c) for c in cuts)) if cuts else F.array().cast(f"array<{dict(keys.dtypes)[key]}>")
    d = keys.withColumn("_size", (F.col(size) if isinstance(size, str) else size).cast("bigint")).withColumn("_range", F.size(F.filter(bounds, lambda c: c <= F.col(key))))
    ranges = d.groupBy("_range").agg(F.sum("_size").alias("_all"))
    upto = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    ranges = ranges.select("_range", F.coalesce(F.sum("_all").over(upto), F.lit(0)).alias("_from"))
    own = W.partitionBy("_range").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_own", F.coalesce(F.sum("_size").over(own), F.lit(0))).join(F.broadcast(ranges), "_range")
    return d.withColumn("before", F.col("_from") + F.col("_own")).drop("_size", "_range", "_own", "_from")


def ordered_annotations(expressions: DataFrame, restart: str | None = None) -> DataFrame:
    """anno_id: the place of (vid, eid) in code-point order of vid, then by eid as a number, from 0.

    Volumes are counted first and their totals are summed up in order; the
    rows themselves are numbered within their volume.  restart: a column of
    few values, such as a split, in each of which numbering starts anew.
    """
    own = F.row_number().over(W.partitionBy("vid").orderBy(F.col("eid").try_cast("bigint"), "eid")) - 1
    if restart is None:
        starts = running_totals(expressions.groupBy("vid").agg(F.count("*").alias("n")), "vid", "n").select("vid", "before")
        return expressions.withColumn("own", own).join(starts, "vid").withColumn("anno_id", (F.col("before") + F.col("own")).cast("bigint")).drop("before", "own")
    parts = [r[0] for r in expressions.select(restart).distinct().orderBy(restart).collect()]
    out = [ordered_annotations(expressions.filter(F.col(restart).eqNullSafe(F.lit(p)))) for p in parts]
    whole = out[0] if out else expressions.withColumn("anno_id", F.lit(0).cast("bigint"))
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def key_split(rows: DataFrame, key: str, share: float) -> DataFrame:
    """split: train for the first floor(n * share) distinct keys in order, val for the others."""
    keys = rows.select(key).distinct()
    n = keys.agg(F.count("*").alias("n"))
    split = running_totals(keys, key, F.lit(1)).crossJoin(F.broadcast(n))  # n is a single row
    split = split.select(key, F.when(F.col("before") < F.floor(F.col("n") * F.lit(share)), "train").otherwise("val").alias("split"))
    return rows.join(split, key)


def exact_split(rows: DataFrame, keys: list[str], share: float, seed: int, cells: int = 4096) -> DataFrame:
    """split: train for exactly max(1, floor(n * share)) rows, the first in the order of a hash of the keys.

    The last row that is taken is found in one cell of the hash's histogram,
    so that no more than that cell is put in order.
    """
    ranked = rows.withColumn("_hash", hash_uniform(seed, "exact", *keys)).withColumn("_cell", F.floor(F.col("_hash") * cells))
    counts = sorted((r[0], r[1]) for r in ranked.groupBy("_cell").count().collect())
    most, seen = max(1, int(sum(n for _, n in counts) * share)), 0
    for cell, n in counts:
        if seen + n >= most:
            break
        seen += n
    else:
        return ranked.withColumn("split", F.lit("train")).drop("_hash", "_cell")
    edge = ranked.filter(F.col("_cell") == cell).select("_hash", *keys).orderBy("_hash", *keys).limit(most - seen).agg(F.max(F.struct("_hash", *keys)).alias("_cut"))
    d = ranked.crossJoin(F.broadcast(edge))  # a single row
    return d.withColumn("split", F.when(F.struct("_hash", *keys) <= F.col("_cut"), "train").otherwise("val")).drop("_hash", "_cell", "_cut")


def hash_split(rows: DataFrame, keys: list[str], share: float, seed: int) -> DataFrame:
    """split by a hash of the keys: the share holds on average, and each row's side is its own."""
    return rows.withColumn("split", F.when(hash_uniform(seed, "split", *keys) < share, "train").otherwise("val"))


def random_subset(rows: DataFrame, keys: list[str], k: int, seed: int) -> DataFrame:
    """Exactly k rows (all, if fewer), the first in the order of a hash of the keys."""
    return rows.withColumn("h", hash_order(seed, *keys)).orderBy("h", *keys).limit(k).drop("h")


def lookup_last(rows: DataFrame, table: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their entry of the table, the last one of equal keys, and the rows without."""
    rest = [c for c in table.columns if c not in (*keys, order)]
    last = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("m")).select(*keys, "m.*")
    return rows.join(last, keys), rows.join(last.select(*keys), keys, "left_anti")


def dimension_lookup(rows: DataFrame, column: str, table: DataFrame, name: str, order: str) -> DataFrame:
    """label_pos: the first entry of the table whose name equals the column, whatever the case."""
    first = table.groupBy(F.lower(name).alias("low")).agg(F.min(order).alias("label_pos"))
    return rows.join(first, F.lower(rows[column]) == F.col("low"), "left").drop("low")


def sampled_slices(first: Column, last: Column, n: int = 10) -> Column:
    """n slices from first to last, evenly spaced; some repeat if the range is short."""
    return int_linspace(first, last, n)


def trend(peak: Column, n: int = 10) -> Column:
    """Where along the stack the largest slice lies."""
    middle = n // 2
    return F.when(F.abs(peak - (middle - 1)) <= 1, "symmetric").when(peak >= middle, "upper").otherwise("lower")


def valid_slices(masks: Column) -> Column:
    """Places of an array's entries that are not null, in order."""
    return F.filter(F.transform(masks, lambda m, i: F.when(m.isNotNull(), i)), lambda i: i.isNotNull())


def missing_slices(masks: Column) -> Column:
    """Places of an array's null entries, in order."""
    return F.filter(F.transform(masks, lambda m, i: F.when(m.isNull(), i)), lambda i: i.isNotNull())


def in_categories(category: Column, organs: bool = True) -> Column:
    """Whether a caption's category is one that records are made for."""
    return category.isin("organ", "lesion", "cyst") if organs else category.isin("lesion", "cyst")


def labelled(rows: DataFrame, label: str, mask: str, masks: int | Column) -> DataFrame:
    """Rows whose label is not the background and whose mask index exists among `masks`."""
    return rows.filter((F.lower(label) != "background") & (F.col(mask) >= 0) & (F.col(mask) < masks))


def key_or_middle(areas: Column, sampled: Column) -> Column:
    """The slice of the largest area; without any, the middle sampled slice, or 0 if none is sampled."""
    n = F.size(sampled)
    middle = F.when(n > 0, F.get(sampled, F.floor(n / 2).cast("int"))).otherwise(F.lit(0))
    return F.when(F.array_max(areas) > 0, F.get(sampled, key_place(areas))).otherwise(middle)


def overridden(base: Column, over: Column) -> Column:
    """Two maps as one; a key of both has the second's value."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def key_place(areas: Column) -> Column:
    """Place of the largest area, the first of equal ones."""
    return -F.array_max(F.transform(areas, lambda a, i: F.struct(a.alias("a"), (-i).alias("i"))))["i"]
