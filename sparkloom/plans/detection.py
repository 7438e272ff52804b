"""Queries on boxes: matching, detection measures, offsets, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.arrays import hash_uniform
from ..operators import corrections, matching, metrics
from .fixtures import GT, LR, PR, plain, view

THRESHOLD = 0.5


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, GT), view(spark, sf_dir, PR)


def pair_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.pair_iou(*_boxes(spark, sf_dir)).select("rec", "g", "p", F.round("iou", 6).alias("iou"))


def _global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.greedy_global(matching.pair_iou(*_boxes(spark, sf_dir)))


def greedy_match_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _global(spark, sf_dir).select("rec", "g", "p", F.round("iou", 6).alias("iou"))


def greedy_match_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = matching.greedy_sequential(matching.pair_iou(*_boxes(spark, sf_dir)), THRESHOLD)
    return d.groupBy("rec").agg(F.count("*").alias("n_pr"), F.count_if("hit").alias("tp"), F.round(F.sum(F.when(F.col("hit"), F.col("iou")).otherwise(0.0)), 6).alias("iou_sum"))


def detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.detection_summary(_global(spark, sf_dir), *_boxes(spark, sf_dir), THRESHOLD)
    return d.select("n_gt", "n_pr", "matched", "tp", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "mean_iou", "mean_iou_gt")))


def _ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision_of(_global(spark, sf_dir), *_boxes(spark, sf_dir))


def ap_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ap(spark, sf_dir).select(F.round("threshold", 2).alias("threshold"), F.round("ap", 6).alias("ap"))


def map_50_95(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = lambda t: F.max(F.when(F.abs(F.col("threshold") - t) < 1e-9, F.col("ap")))
    return _ap(spark, sf_dir).agg(F.round(F.avg("ap"), 6).alias("map"), F.round(near(0.5), 6).alias("ap50"), F.round(near(0.75), 6).alias("ap75"))


def nearest_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.nearest_centers(*_boxes(spark, sf_dir)).select("rec", "p", "g", "dx", "dy", F.round("distance", 6).alias("distance"))


def offset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = matching.nearest_centers(*_boxes(spark, sf_dir))
    each = [f(c).alias(f"{n}_{c}") for c in ("dx", "dy") for n, f in (("most", F.max), ("least", F.min))]
    out = d.agg(F.count("*").alias("n"), F.round(F.avg("dx"), 6).alias("mean_dx"), F.round(F.avg("dy"), 6).alias("mean_dy"), *each)
    for c in ("dx", "dy"):
        out = metrics.with_quantiles(out, d, c, [], {f"median_{c}": 0.5})
    return out


def sanitize_scale_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pr = view(spark, sf_dir, PR)
    box = g.sanitize_box((F.col("x2") - 420, F.col("y1"), F.col("x1") - 400, F.col("y2")), F.lit(380).cast("bigint"), F.lit(380).cast("bigint"))
    d = pr.withColumn("b", box).filter("b is not null").select("rec", "p", "b.*")
    scaled = [F.round(g.scale_by_mode(F.col(c), F.lit(512), F.lit(m), F.greatest("x2", "y2")), 6).alias(f"{m}_{c}") for m in ("auto", "norm1000", "norm1000_image") for c in ("x1", "y2")]
    return d.select("rec", "p", "x1", "y1", "x2", "y2", *scaled)


def small_box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, GT)
    b = g.resize_box((F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), F.lit(512.0), F.lit(512.0), 64, 64)
    d = d.withColumn("b", b)
    return d.filter(~g.too_small(g.box_of("b"))).select("rec", "g", *(F.col(f"b.{c}").cast("bigint").alias(c) for c in ("x1", "y1", "x2", "y2")))


def jitter_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, side = view(spark, sf_dir, GT), F.lit(512).cast("bigint")
    u = tuple(hash_uniform(42, f"jitter{i}", "rec", "g") for i in range(4))
    b = g.jitter_box((F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), 0.05, side, side, u)
    return gt.withColumn("b", b).select("rec", "g", *(F.col(f"b.{c}").cast("bigint").alias(c) for c in ("x1", "y1", "x2", "y2")))


def inject_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = view(spark, sf_dir, GT)
    side = F.lit(420).cast("bigint")
    b = g.shift_box((F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), 0.30, side, side)
    d = gt.withColumn("b", b)
    iou = g.box_iou((F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), g.box_of("b"))
    return d.select("rec", "g", *(F.col(f"b.{c}").cast("bigint").alias(c) for c in ("x1", "y1", "x2", "y2")), F.round(iou, 6).alias("iou"), (iou < 0.75).alias("redo"))


def redrawn_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First boxes with one failure in every second record, and what their review draws again."""
    side = F.lit(512).cast("bigint")
    d = corrections.corrected_boxes(view(spark, sf_dir, GT), "rec", "g", side, side, fail=F.col("rec") % 2 == 0)
    boxes = [F.col(f"{b}.{c}").alias(f"{b}_{c}") for b in ("first", "final") for c in ("x1", "y1", "x2", "y2")]
    return d.select("rec", "g", "failed", F.round("iou", 6).alias("iou"), "redrawn", *boxes)


_IOU = """CASE WHEN greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) > 0 THEN
  CAST(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS DOUBLE) /
  ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))
  ELSE 0.0 END"""
_PAIRS = f"WITH RECURSIVE {plain(LR)}, pairs AS (SELECT a.rec, a.g, b.p, {_IOU} AS iou FROM gt a JOIN pr b USING (rec))"
GLOBAL_SQL = f"""{_PAIRS},
cand AS (SELECT rec, g, p, iou, row_number() OVER (PARTITION BY rec ORDER BY iou DESC, g, p) AS k FROM pairs),
r AS (SELECT rec, 0::BIGINT AS k, []::BIGINT[] AS gs, []::BIGINT[] AS ps, false AS hit, 0::BIGINT AS g, 0::BIGINT AS p, 0.0::DOUBLE AS iou FROM cand WHERE k = 1
  UNION ALL SELECT c.rec, c.k, CASE WHEN NOT list_contains(gs, c.g) AND NOT list_contains(ps, c.p) THEN list_append(gs, c.g) ELSE gs END,
    CASE WHEN NOT list_contains(gs, c.g) AND NOT list_contains(ps, c.p) THEN list_append(ps, c.p) ELSE ps END,
    NOT list_contains(gs, c.g) AND NOT list_contains(ps, c.p), c.g, c.p, c.iou FROM r JOIN cand c ON c.rec = r.rec AND c.k = r.k + 1),
m AS (SELECT rec, g, p, iou FROM r WHERE hit)"""
_AP = f"""{GLOBAL_SQL}, t AS (SELECT 0.5::DOUBLE + 0.05::DOUBLE * unnest(range(10)) AS threshold),
n AS (SELECT (SELECT count(*) FROM gt) AS ng, (SELECT count(*) FROM pr) AS np, (SELECT count(*) FROM m) AS nm),
h AS (SELECT threshold, (SELECT count(*) FROM m WHERE iou >= threshold) AS hits FROM t),
ap AS (SELECT threshold, coalesce(list_sum(list_transform(range(1, hits + 1), lambda k: k::DOUBLE / (greatest(np - nm, 0) + k))), 0) / ng AS ap FROM h, n)"""
_NEAR = f"""WITH {plain(LR)}, d AS (SELECT a.rec, b.p, a.g, (b.x1 + b.x2) / 2.0 - (a.x1 + a.x2) / 2.0 AS dx, (b.y1 + b.y2) / 2.0 - (a.y1 + a.y2) / 2.0 AS dy FROM gt a JOIN pr b USING (rec)),
o AS (SELECT rec, p, g, dx, dy, sqrt(dx * dx + dy * dy) AS distance, row_number() OVER (PARTITION BY rec, p ORDER BY sqrt(dx * dx + dy * dy), g) AS k FROM d)"""
_U = lambda i: f"(('0x' || substr(md5(concat_ws('|', '42', rec, g, 'jitter{i}')), 1, 7))::BIGINT::DOUBLE / {1 << 28}.0)"
_MOVE = lambda v, s, i: f"trunc({v} + ({_U(i)} * 2 - 1) * ({s}) * 0.05)::BIGINT"

# a box's four moved corners as a struct, the second ones beyond the first
_MOVED = lambda v, s, name, i, share: f"trunc({v} + ((('0x' || substr(md5(concat_ws('|', '42', rec, g, '{name}{i}')), 1, 7))::BIGINT::DOUBLE / {1 << 28}.0) * 2 - 1) * ({s}) * {share})::BIGINT"
_LOW = lambda v, s, name, i, share: f"least(greatest({_MOVED(v, s, name, i, share)}, 0), 511)"
_JITTERED = lambda name, share: (
    f"{{'x1': {_LOW('x1', 'x2 - x1', name, 0, share)}, 'y1': {_LOW('y1', 'y2 - y1', name, 1, share)}, 'x2': least(greatest({_MOVED('x2', 'x2 - x1', name, 2, share)}, {_LOW('x1', 'x2 - x1', name, 0, share)} + 1), 511), "
    f"'y2': least(greatest({_MOVED('y2', 'y2 - y1', name, 3, share)}, {_LOW('y1', 'y2 - y1', name, 1, share)} + 1), 511)}}"
)

SQL = {
    "pair_iou": f"{_PAIRS} SELECT rec, g, p, round(iou, 6) AS iou FROM pairs",
    "greedy_match_global": f"{GLOBAL_SQL} SELECT rec, g, p, round(iou, 6) AS iou FROM m",
    "greedy_match_sequential": f"""{_PAIRS}, seq AS (SELECT rec, p, dense_rank() OVER (PARTITION BY rec ORDER BY p) AS k, g, iou FROM pairs),
      r AS (SELECT DISTINCT rec, 0::BIGINT AS k, []::BIGINT[] AS used, 0::BIGINT AS tp, 0.0::DOUBLE AS s FROM seq
        UNION ALL SELECT rec, k, CASE WHEN best.iou >= {THRESHOLD} THEN list_append(used, best.g) ELSE used END, tp + CASE WHEN best.iou >= {THRESHOLD} THEN 1 ELSE 0 END,
          s + CASE WHEN best.iou >= {THRESHOLD} THEN best.iou ELSE 0 END
        FROM (SELECT r.rec, r.k + 1 AS k, r.used, r.tp, r.s, (SELECT max_by({{'g': q.g, 'iou': q.iou}}, (q.iou, -q.g)) FROM seq q WHERE q.rec = r.rec AND q.k = r.k + 1 AND q.iou > 0 AND NOT list_contains(r.used, q.g)) AS best
          FROM r WHERE EXISTS (SELECT 1 FROM seq q WHERE q.rec = r.rec AND q.k = r.k + 1)))
      SELECT rec, max(k)::BIGINT AS n_pr, max(tp)::BIGINT AS tp, round(max(s), 6) AS iou_sum FROM r GROUP BY rec""",
    "detection_summary": f"""{GLOBAL_SQL}, n AS (SELECT (SELECT count(*) FROM gt) AS n_gt, (SELECT count(*) FROM pr) AS n_pr, (SELECT count(*) FROM m) AS matched,
      (SELECT count(*) FROM m WHERE iou >= {THRESHOLD}) AS tp, (SELECT sum(iou) FROM m) AS s), q AS (SELECT *, tp::DOUBLE / n_pr AS p, tp::DOUBLE / n_gt AS r FROM n)
      SELECT n_gt, n_pr, matched, tp, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, round(s / matched, 6) AS mean_iou, round(s / n_gt, 6) AS mean_iou_gt FROM q""",
    "ap_curve": f"{_AP} SELECT round(threshold, 2)::DOUBLE AS threshold, round(ap, 6) AS ap FROM ap",
    "map_50_95": f"{_AP} SELECT round(avg(ap), 6) AS map, round(max(CASE WHEN abs(threshold - 0.5) < 1e-9 THEN ap END), 6) AS ap50, round(max(CASE WHEN abs(threshold - 0.75) < 1e-9 THEN ap END), 6) AS ap75 FROM ap",
    "nearest_offsets": f"{_NEAR} SELECT rec, p, g, dx::DOUBLE AS dx, dy::DOUBLE AS dy, round(distance, 6) AS distance FROM o WHERE k = 1",
    "offset_stats": f"""{_NEAR} SELECT count(*) AS n, round(avg(dx), 6) AS mean_dx, round(avg(dy), 6) AS mean_dy, median(dx)::DOUBLE AS median_dx, max(dx)::DOUBLE AS most_dx, min(dx)::DOUBLE AS least_dx,
      median(dy)::DOUBLE AS median_dy, max(dy)::DOUBLE AS most_dy, min(dy)::DOUBLE AS least_dy FROM o WHERE k = 1""",
    "sanitize_scale_boxes": f"""WITH {plain(LR)}, s AS (SELECT rec, p, least(greatest(least(x2 - 420, x1 - 400), 0), 380) AS x1, least(greatest(least(y1, y2), 0), 380) AS y1,
      least(greatest(greatest(x2 - 420, x1 - 400), 0), 380) AS x2, least(greatest(greatest(y1, y2), 0), 380) AS y2 FROM pr)
      SELECT rec, p, x1, y1, x2, y2, round(CASE WHEN greatest(x2, y2) <= 1.5 THEN x1 * 512 ELSE x1 END::DOUBLE, 6) AS auto_x1, round(CASE WHEN greatest(x2, y2) <= 1.5 THEN y2 * 512 ELSE y2 END::DOUBLE, 6) AS auto_y2,
      round(x1 * 0.512::DOUBLE, 6) AS norm1000_x1, round(y2 * 0.512::DOUBLE, 6) AS norm1000_y2, round(x1 / 1000.0::DOUBLE * 512, 6) AS norm1000_image_x1, round(y2 / 1000.0::DOUBLE * 512, 6) AS norm1000_image_y2
      FROM s WHERE x2 > x1 AND y2 > y1""",
    "small_box_filter": f"""WITH {plain(LR)}, s AS (SELECT rec, g, least(greatest(round_even(x1 * 64.0 / 512.0, 0), 0), 64)::BIGINT AS x1, least(greatest(round_even(y1 * 64.0 / 512.0, 0), 0), 64)::BIGINT AS y1,
      least(greatest(round_even(x2 * 64.0 / 512.0, 0), 0), 64)::BIGINT AS x2, least(greatest(round_even(y2 * 64.0 / 512.0, 0), 0), 64)::BIGINT AS y2 FROM gt)
      SELECT * FROM s WHERE NOT ((x2 - x1) * (y2 - y1) < 20 OR x2 - x1 < 3 OR y2 - y1 < 3)""",
    "jitter_boxes": f"""WITH {plain(LR)}, a AS (SELECT rec, g, least(greatest({_MOVE('x1', 'x2 - x1', 0)}, 0), 511) AS u1, least(greatest({_MOVE('y1', 'y2 - y1', 1)}, 0), 511) AS v1,
      {_MOVE('x2', 'x2 - x1', 2)} AS u2, {_MOVE('y2', 'y2 - y1', 3)} AS v2 FROM gt)
      SELECT rec, g, u1 AS x1, v1 AS y1, least(greatest(u2, u1 + 1), 511) AS x2, least(greatest(v2, v1 + 1), 511) AS y2 FROM a""",
    "redrawn_boxes": f"""WITH {plain(LR)}, o AS (SELECT *, rec % 2 = 0 AND row_number() OVER (PARTITION BY rec ORDER BY md5(concat_ws('|', '42', rec, g)), g) = 1 AS failed FROM gt),
      j AS (SELECT *, {_JITTERED('jitter', 0.05)} AS first, {_JITTERED('again', 0.02)} AS second FROM o),
      b AS (SELECT rec, g, failed, first, second, CASE WHEN failed THEN least(x1 + floor((x2 - x1) * 0.30::DOUBLE)::BIGINT, 511) ELSE first.x1 END AS x1, CASE WHEN failed THEN least(y1 + floor((y2 - y1) * 0.30::DOUBLE)::BIGINT, 511) ELSE first.y1 END AS y1,
        CASE WHEN failed THEN least(x2 + floor((x2 - x1) * 0.30::DOUBLE)::BIGINT, 511) ELSE first.x2 END AS x2, CASE WHEN failed THEN least(y2 + floor((y2 - y1) * 0.30::DOUBLE)::BIGINT, 511) ELSE first.y2 END AS y2 FROM j),
      q AS (SELECT b.*, {_IOU} AS iou FROM gt a JOIN b USING (rec, g))
      SELECT rec, g, failed, round(iou, 6) AS iou, iou < 0.75 AS redrawn, x1 AS first_x1, y1 AS first_y1, x2 AS first_x2, y2 AS first_y2, {", ".join(f"CASE WHEN iou < 0.75 THEN second.{c} ELSE {c} END AS final_{c}" for c in ("x1", "y1", "x2", "y2"))} FROM q""",
    "inject_failure": f"""WITH {plain(LR)}, b AS (SELECT rec, g, least(x1 + floor((x2 - x1) * 0.30::DOUBLE)::BIGINT, 419) AS x1, least(y1 + floor((y2 - y1) * 0.30::DOUBLE)::BIGINT, 419) AS y1,
      least(x2 + floor((x2 - x1) * 0.30::DOUBLE)::BIGINT, 419) AS x2, least(y2 + floor((y2 - y1) * 0.30::DOUBLE)::BIGINT, 419) AS y2 FROM gt), q AS (SELECT b.*, {_IOU} AS iou FROM gt a JOIN b USING (rec, g))
      SELECT rec, g, x1, y1, x2, y2, round(iou, 6) AS iou, iou < 0.75 AS redo FROM q""",
}

QUERIES = {name: globals()[name] for name in SQL}
