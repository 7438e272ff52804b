"""Integer sampling, ordered folds and reproducible noise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_linspace(a: Column, b: Column, n: int) -> Column:
    """n whole numbers from a to b, evenly spaced and cut down, the last exactly b."""
    step = (b - a).cast("double") / F.lit(float(n - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, b.cast("int")).otherwise(F.floor(i * step + a).cast("int")))


def round_linspace(last: Column, n: Column) -> Column:
    """n places from 0 to last, evenly spaced and rounded half to even."""
    step = F.coalesce(F.try_divide(last.cast("double"), (n - 1).cast("double")), F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == F.greatest(n - 1, F.lit(1)), last.cast("int")).otherwise(F.rint(i * step).cast("int")))


def positives_first(positive: Column, negative: Column, most: int) -> Column:
    """Up to `most` frames in order: evenly spaced positives, then negatives to fill up."""
    pick = lambda from_, n: F.transform(round_linspace(F.size(from_) - 1, n), lambda i: F.get(from_, i))
    n_pos = F.least(F.size(positive), F.lit(most))
    n_neg = F.least(F.size(negative), F.lit(most) - n_pos)
    empty = F.array().cast("array<int>")
    return F.array_sort(F.concat(F.when(n_pos > 0, pick(positive, n_pos)).otherwise(empty), F.when(n_neg > 0, pick(negative, n_neg)).otherwise(empty)))


def spiral(n: int) -> Column:
    """0..n-1 by distance from the middle, the lower first: 5, 4, 6, 3, 7 and so on for ten."""
    return F.array(*(F.lit(i) for i in sorted(range(n), key=lambda i: abs(i - n // 2))))


def upsample(n: int, target: int) -> list[int]:
    """Slice numbers for a deeper stack: whole repeats, then the first ones again."""
    return [i for i in range(n) for _ in range(target // n)] + list(range(target % n))


def upsampled(places: Column, target: int) -> Column:
    """Places of a deeper stack as a column: each one in whole repeats, then the first ones again."""
    n = F.size(places)
    each = F.flatten(F.transform(places, lambda p: F.array_repeat(p, F.floor(F.lit(target) / n).cast("int"))))
    return F.when(n >= target, F.slice(places, 1, target)).when(n > 0, F.concat(each, F.slice(places, F.lit(1), (F.lit(target) % n).cast("int")))).otherwise(places)


def hash_uniform(seed: int, salt: str, *key: str) -> Column:
    """A number in [0, 1) that depends on the key alone: 28 bits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in key), F.lit(salt))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28))


def hash_order(seed: int, *key: str) -> Column:
    """A text whose order shuffles the keys reproducibly."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)).cast("binary"))


def ordered(column: Column) -> Column:
    """The group's structs as one array in the order of their first fields."""
    return F.array_sort(F.collect_list(column))


def let(value: Column, then) -> Column:
    """then(value), with the value made once: an expression inside a lambda, or used twice, would be computed anew each time."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
