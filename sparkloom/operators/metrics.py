"""Detection and segmentation measures over match and case tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import ratio

THRESHOLDS = tuple(0.5 + 0.05 * i for i in range(10))


def detection_summary(matches: DataFrame, gt: DataFrame, pr: DataFrame, threshold: float) -> DataFrame:
    """One row: counts, precision, recall, F1 at an IoU, and mean IoU per match and per true box."""
    m = matches.agg(F.count("*").alias("matched"), F.count_if(F.col("iou") >= threshold).alias("tp"), F.coalesce(F.sum("iou"), F.lit(0.0)).alias("iou_sum"))
    n = gt.agg(F.count("*").alias("n_gt")).crossJoin(pr.agg(F.count("*").alias("n_pr")))
    s = m.crossJoin(n)  # single rows
    p, r = ratio(F.col("tp"), F.col("n_pr")), ratio(F.col("tp"), F.col("n_gt"))
    s = s.withColumn("precision", p).withColumn("recall", r)
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return s.select("n_gt", "n_pr", "matched", "tp", "precision", "recall", f1.alias("f1"), ratio(F.col("iou_sum"), F.col("matched")).alias("mean_iou"), ratio(F.col("iou_sum"), F.col("n_gt")).alias("mean_iou_gt"))


def _harmonic_rest(n: Column) -> Column:
    """H(n) - ln(n) - Euler's constant, for n of 16 and more to 1e-14."""
    r = 1 / n
    return r * (0.5 - r * (1 / 12 - r * r * (1 / 120 - r * r * (1 / 252 - r * r / 240))))


def harmonic_gap(u: Column, t: Column) -> Column:
    """1/(u+1) + ... + 1/(u+t) without adding up: sixteen terms at either end, a series between."""
    u, t = u.cast("double"), t.cast("double")
    begin, end = u + 16, u + t + 16
    own = lambda n: sum((1 / (n + i) for i in range(1, 17)), F.lit(0.0))
    return F.log1p(t / begin) + _harmonic_rest(end) - _harmonic_rest(begin) + own(u) - own(u + t)


def _precision_sum(n_gt: Column, n_pr: Column) -> Column:
    """From columns matched and hits: the sum over hits k of k / (unmatched + k), over the true boxes."""
    missed = F.greatest(n_pr - F.col("matched"), F.lit(0))
    total = F.col("hits") - F.when(missed > 0, missed * harmonic_gap(missed, F.col("hits"))).otherwise(0.0)
    return F.when(n_gt == 0, F.when(n_pr == 0, 1.0).otherwise(0.0)).otherwise(total / n_gt)


def _hits(matches: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    hits = F.array(*(F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("iou") >= t).alias("hits")) for t in thresholds))
    return matches.agg(F.count("*").alias("matched"), hits.alias("t")).select("matched", F.explode("t").alias("t")).select("matched", "t.*")


def average_precision(matches: DataFrame, n_gt: int, n_pr: int, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, ap): unmatched predictions come first in the ranking, then matches by rising rank.

    The sum over hits k of k / (unmatched + k), over the true boxes, in closed
    form: hits - unmatched (H(unmatched + hits) - H(unmatched)).  This is not
    the usual average precision: misses never fall behind hits.
    """
    return _hits(matches, thresholds).select("threshold", _precision_sum(F.lit(n_gt), F.lit(n_pr)).alias("ap"))


def average_precision_of(matches: DataFrame, gt: DataFrame, pr: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """The same with the boxes counted in the same plan."""
    n = gt.agg(F.count("*").alias("n_gt")).crossJoin(pr.agg(F.count("*").alias("n_pr")))
    d = _hits(matches, thresholds).crossJoin(F.broadcast(n))  # a single row
    return d.select("threshold", _precision_sum(F.col("n_gt"), F.col("n_pr")).alias("ap"))


#: Rank error of the first look at a quantile, as a share of the rows.
LOOK = 1e-4


def quantiles(rows: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """by and a column for each name: exact quantiles of the values that are not null, with interpolation.

    For a few large groups.  An approximate look brackets each quantile; then
    only the distinct values in the brackets, some ten-thousandths of the rows,
    are counted and ranked.
    """
    v = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    bounds = [min(max(s + d * 4 * LOOK, 0.0), 1.0) for s in shares.values() for d in (-1, 1)]
    look = v.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", bounds, int(1 / LOOK)).alias("_b"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    names, points = list(shares), list(shares.values())
    # few rows have no room between the ranks: then the bracket is everything
    wide = F.col("_n") < 100 / LOOK / 100
    brackets = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(s).alias("share"), F.when(wide, F.col("_least")).otherwise(F.get("_b", F.lit(2 * i))).alias("lo"), F.when(wide, F.col("_most")).otherwise(F.get("_b", F.lit(2 * i + 1))).alias("hi")) for i, (n, s) in enumerate(zip(names, points, strict=True))))
    each = look.select(*by, "_n", F.explode(brackets).alias("q")).select(*by, "_n", "q.*")
    met = v.join(F.broadcast(each.select(*(F.col(c).alias(f"_{c}") for c in by), "_n", "name", "share", "lo", "hi")), _equal(by), "inner") if by else v.crossJoin(F.broadcast(each))
    counted = met.filter(F.col("_v") <= F.col("hi")).groupBy(*by, "_n", "name", "share", F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    below = F.sum("_c").over(W.partitionBy(*by, "name").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    place = F.col("share") * (F.col("_n") - 1)
    ranked = counted.withColumn("_upto", below).withColumn("_from", F.col("_upto") - F.col("_c")).filter(F.col("_v").isNotNull())
    at = lambda k: F.max(F.when((F.col("_from") <= k) & (k < F.col("_upto")), F.col("_v")))
    low, high = at(F.floor(place)), at(F.ceil(place))
    q = ranked.groupBy(*by, "name", "share", "_n").agg(low.alias("a"), high.alias("b"))
    q = q.withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * (place - F.floor(place)))
    return q.groupBy(*by).agg(*(F.max(F.when(F.col("name") == n, F.col("x"))).alias(n) for n in names))


def _equal(by: list[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out


def precision_recall_curve(ranked_hits: DataFrame) -> DataFrame:
    """Running precision, recall and the envelope of precision; rows: grp, rank, hit, n_gt."""
    upto = W.partitionBy("grp").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    d = ranked_hits.withColumn("tp", F.sum(F.col("hit").cast("int")).over(upto))
    d = d.withColumn("precision", F.col("tp") / F.col("rank")).withColumn("recall", ratio(F.col("tp"), F.col("n_gt")))
    return d.withColumn("envelope", F.max("precision").over(upto))


def summary(rows: DataFrame, value: str, by: list[str], few: bool = False) -> DataFrame:
    """Count, mean, population deviation, extremes, median and 95th percentile of the finite values.

    few: the groups are few and large, so that no task should hold one's values.
    """
    finite = ~(F.isnan(value) | (F.abs(F.col(value)) == float("inf")))
    v = F.when(finite, F.col(value))
    measures = [F.count(v).alias("n"), F.count_if(~finite).alias("n_inf"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most")]
    if not few:
        return rows.groupBy(*by).agg(*measures, F.median(v).alias("median"), F.percentile(v, F.lit(0.95)).alias("p95"))
    return with_quantiles(rows.groupBy(*by).agg(*measures), rows.withColumn("_value", v), "_value", by, {"median": 0.5, "p95": 0.95})


def with_quantiles(groups: DataFrame, rows: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """groups, a row for each group, with the quantiles of the groups' rows."""
    q = quantiles(rows, value, by, shares).select(*(F.col(c).alias(f"_{c}") for c in by), *shares)
    d = groups.join(F.broadcast(q), _equal(by), "left") if by else groups.crossJoin(F.broadcast(q))  # a row for each of few groups
    return d.drop(*(f"_{c}" for c in by))


def latency(rows: DataFrame, seconds: str, error: str) -> DataFrame:
    """One row: predictions, their mean latency, and those that could not be read."""
    return rows.agg(F.count("*").alias("n"), F.avg(seconds).alias("mean_latency"), F.count_if(F.col(error).isNotNull()).alias("parse_failures"))
