"""Queries on training records: texts, validators, consistency checks and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import matching, metrics, records, trajectory
from .detection import GLOBAL_SQL
from .fixtures import ANNOS, CALLS, GT, LR, PR, plain, view

_CASE = f"""WITH {ANNOS} SELECT o_orderkey AS rec, caption, CAST(o_custkey % 40 AS INT) AS a, o_orderkey AS k FROM an"""


def spatial_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, _CASE)
    ords = F.sequence(F.lit(0), F.lit(9))
    d = d.select("rec", "caption", F.transform(ords, lambda i: F.col("a") + 3 * i).alias("sampled"), F.transform(ords, lambda i: ((F.col("k") * 7 + i * 13) % 5).cast("int")).alias("areas"))
    return d.select("rec", records.spatial_text(F.col("caption"), F.col("sampled"), F.col("areas")).alias("cot"))


def review_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = matching.greedy_global(matching.pair_iou(view(spark, sf_dir, GT), view(spark, sf_dir, PR)))
    d = d.withColumn("iou", F.floor(F.col("iou") * 100) / 100)
    g = d.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct(F.col("g").alias("z"), F.col("iou")))).alias("b"))
    return g.select("rec", records.review_text(F.col("b")).alias("review"))


def validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, f"WITH {CALLS} SELECT rec, pos, name, z, delta FROM calls WHERE name <> 'scroll'")
    d, last = d.withColumn("last", F.max("pos").over(W.partitionBy("rec"))), F.col("last")
    name = F.when((F.col("pos") == last) & (F.col("rec") % 2 == 0), "finish_bbox_annotation").when(F.col("name") == "get_slice", "add_bbox").otherwise(F.col("name"))
    call = F.when(F.col("name") == "malformed", F.lit("{bad")).otherwise(F.format_string('{"name": "%s", "arguments": {"bbox": [1, 2, %d, 9]}}', name, F.col("z")))
    keep = d.withColumn("content", call).filter((F.col("name") != "malformed") | (F.col("rec") % 5 == 0)).filter((F.col("name") == "get_slice") | (F.col("pos") == last) | (F.col("rec") % 3 == 0))
    calls = keep.select("rec", "pos", F.lit("tool_call").alias("role"), "content")
    answers = keep.filter("name = 'get_slice'").select("rec", (F.col("pos") * 1000).alias("pos"), F.lit("tool_response").alias("role"), F.lit("<image> ok").alias("content"))
    images = keep.groupBy("rec").agg(F.count_if(F.col("name") == "get_slice").alias("images"))
    return records.validate_records(calls.unionByName(answers), images).groupBy("reason").agg(F.count("*").alias("n"))


def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = view(spark, sf_dir, GT)
    m = matching.greedy_global(matching.pair_iou(gt, view(spark, sf_dir, PR)))
    rank = F.row_number().over(W.partitionBy("grp").orderBy(F.desc("iou"), "rec", "g"))
    n = gt.groupBy((F.col("rec") % 7).alias("grp")).agg(F.count("*").alias("n_gt"))
    d = m.withColumn("grp", F.col("rec") % 7).withColumn("rank", rank).withColumn("hit", F.col("iou") >= 0.5).join(n, "grp")
    c = metrics.precision_recall_curve(d.select("grp", "rank", "hit", "n_gt"))
    return c.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.sum("precision"), 4).alias("precision"), F.round(F.max("recall"), 6).alias("recall"), F.round(F.sum("envelope"), 4).alias("envelope"))


def source_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, f"WITH {LR} SELECT rec, g AS z, x1 + y1 AS v FROM gt")
    b = view(spark, sf_dir, f"WITH {LR} SELECT rec, p AS z, x1 + y1 + CASE WHEN p % 3 = 0 THEN 1 ELSE 0 END AS v FROM pr")
    return records.compare_sources(a, b, ["rec", "z"], "v").groupBy("verdict").agg(F.count("*").alias("n"))


def key_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "SELECT o_custkey AS grp, o_orderkey % 9 AS place FROM {orders}")
    return records.gaps(d, "grp", "place", 8)


def loss_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("loss", F.when(F.col("turn") % 5 == 0, False))
    return d.groupBy("role").agg(F.count_if(records.in_loss(F.col("role"), F.col("loss"))).alias("scored"), F.count("*").alias("n"))


def expand_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "SELECT o_orderkey AS id, CAST(o_custkey % 4 AS INT) AS k FROM {orders}")
    out = trajectory.expand_placeholders(F.array(F.lit(5), F.lit(-1), F.lit(6), F.lit(-1), F.lit(-1)), -1, F.array(F.col("k"), F.lit(2)))
    return d.select("id", F.array_join(out.cast("array<string>"), ",").alias("ids"))


def fill_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "SELECT n_nationkey AS id, n_name FROM {nation}")
    out = text.wrap_placeholders(F.lit("see <bbox> and <bbox>, not <bbox>."), "<bbox>", F.array("n_name", F.lit("[1]")))
    return d.select(F.col("id").cast("bigint").alias("id"), out.alias("text"))


def answer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN concat('so <answer> ', p_brand, ' </answer>') ELSE p_brand END AS reply, p_brand AS truth FROM {part}")
    return d.groupBy(records.answers_match(F.col("reply"), F.col("truth")).alias("score")).agg(F.count("*").alias("n"))


def sample_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_size > 10")
    key = F.md5(F.concat(F.lit("42|"), F.col("p_partkey").cast("string")).cast("binary"))
    return d.orderBy(key, "p_partkey").limit(50).select("p_partkey", "p_name")


SQL = {
    "spatial_text": f"""WITH {plain(ANNOS)}, od AS (SELECT o_orderkey AS rec, caption, (o_custkey % 40)::INT + 3 * i AS z, (o_orderkey * 7 + i * 13) % 5 AS area, i FROM an, (SELECT unnest(range(10)) AS i)),
      g AS (SELECT rec, caption, list(z ORDER BY i) FILTER (area > 0) AS has, list(z ORDER BY i) FILTER (area = 0) AS non, arg_max(i, (area, -i)) AS p, arg_max(z, (area, -i)) AS key FROM od GROUP BY ALL)
      SELECT rec, 'Global spatial analysis:' || chr(10) || chr(10) || 'Target: ' || caption || chr(10) || chr(10) || 'Target visible at Z=' || has[1] || '~' || has[-1] || ' (' || len(has) || ' of 10 sampled slices contain the target). Z=' || key ||
        ' has the largest cross-section (key slice). Cross-sectional area trend: ' || CASE WHEN abs(p - 4) <= 1 THEN 'gradually increases from both ends toward the middle — near-symmetric ellipsoid'
        WHEN p >= 5 THEN 'continuously grows from bottom to top — lesion skewed toward upper slices' ELSE 'largest at the bottom, shrinking upward — lesion skewed toward lower slices' END || '.' || chr(10) ||
        CASE WHEN non IS NULL THEN '' ELSE 'Z=[' || array_to_string(non, ', ') || '] — target not visible on these slices, skipping annotation.' || chr(10) END || chr(10) || 'Proceeding to annotate all target-containing slices:' AS cot FROM g""",
    "review_text": f"""{GLOBAL_SQL}, q AS (SELECT rec, g, floor(iou * 100) / 100 AS iou FROM m), f AS (SELECT rec, count(*) AS n, string_agg(g::VARCHAR, ', ' ORDER BY g) AS zs FROM q WHERE iou < 0.75 GROUP BY rec),
      t AS (SELECT rec, string_agg('  Z=' || g || CASE WHEN iou < 0.75 THEN ': FAIL (IoU=' || format('{{:.2f}}', iou) || ' < 0.75) — re-annotating.' ELSE ': PASS (IoU=' || format('{{:.2f}}', iou) || ')' END, chr(10) ORDER BY g) AS body FROM q GROUP BY rec)
      SELECT rec, 'Review complete. Checking bbox quality:' || chr(10) || body || CASE WHEN n IS NULL THEN '' ELSE chr(10) || chr(10) || 'Correcting ' || n || ' slice(s): Z=[' || zs || '].' END AS review FROM t LEFT JOIN f USING (rec)""",
    "validate_records": f"""WITH {plain(CALLS)}, c AS (SELECT *, max(pos) OVER (PARTITION BY rec) AS last FROM calls WHERE name <> 'scroll'),
      k AS (SELECT rec, pos, name = 'get_slice' AS asked, CASE WHEN name = 'malformed' THEN NULL WHEN pos = last AND rec % 2 = 0 THEN 'finish_bbox_annotation' WHEN name = 'get_slice' THEN 'add_bbox' ELSE name END AS name, z FROM c
        WHERE (name <> 'malformed' OR rec % 5 = 0) AND (name = 'get_slice' OR pos = last OR rec % 3 = 0)),
      g AS (SELECT rec, count(*) FILTER (name IS NULL) AS bad, count(*) FILTER (name NOT IN ('add_bbox', 'finish_bbox_annotation')) AS other, count(*) FILTER (name = 'add_bbox' AND z <= 1) AS wrong, count(*) AS calls,
        count(*) FILTER (asked) AS answers, count(*) FILTER (name = 'add_bbox') AS boxes, max({{'pos': pos, 'name': name}}).name AS last FROM k GROUP BY rec),
      v AS (SELECT CASE WHEN bad > 0 THEN 'tool call is not JSON' WHEN other > 0 THEN 'unknown tool' WHEN wrong > 0 THEN 'box corners' WHEN calls <> answers + 1 AND boxes <> answers THEN 'responses missing'
        WHEN last IS DISTINCT FROM 'finish_bbox_annotation' THEN 'finish is not last' ELSE 'ok' END AS reason FROM g)
      SELECT reason, count(*) AS n FROM v GROUP BY reason""",
    "pr_curve": f"""{GLOBAL_SQL}, c AS (SELECT rec % 7 AS grp, iou, row_number() OVER w AS rank, sum(CASE WHEN iou >= 0.5 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp FROM m WINDOW w AS (PARTITION BY rec % 7 ORDER BY iou DESC, rec, g)),
      n AS (SELECT rec % 7 AS grp, count(*) AS n_gt FROM gt GROUP BY ALL), p AS (SELECT grp, rank, tp / rank::DOUBLE AS p, tp / n_gt::DOUBLE AS r, max(tp / rank::DOUBLE) OVER (PARTITION BY grp ORDER BY rank) AS e FROM c JOIN n USING (grp))
      SELECT grp, count(*) AS n, round(sum(p), 4) AS precision, round(max(r), 6) AS recall, round(sum(e), 4) AS envelope FROM p GROUP BY grp""",
    "source_consistency": f"""WITH {plain(LR)}, a AS (SELECT rec, g AS z, x1 + y1 AS v FROM gt), b AS (SELECT rec, p AS z, x1 + y1 + CASE WHEN p % 3 = 0 THEN 1 ELSE 0 END AS v FROM pr)
      SELECT CASE WHEN a.v IS NULL THEN 'only second' WHEN b.v IS NULL THEN 'only first' WHEN a.v = b.v THEN 'equal' ELSE 'different' END AS verdict, count(*) AS n FROM a FULL JOIN b USING (rec, z) GROUP BY ALL""",
    "key_continuity": "WITH q AS (SELECT o_custkey AS grp, o_orderkey % 9 AS place FROM orders) SELECT grp, count(DISTINCT place) AS found, 9 - count(DISTINCT place) AS missing, count(*) - count(DISTINCT place) AS repeated FROM q GROUP BY grp",
    "loss_scope": "SELECT role, count(*) FILTER (coalesce(CASE WHEN turn % 5 = 0 THEN false END, role IN ('assistant', 'tool_call'))) AS scored, count(*) AS n FROM conversations GROUP BY role",
    "expand_media": "SELECT o_orderkey AS id, '5,' || repeat('-1,', (o_custkey % 4)::INT) || '6,-1,-1,-1' AS ids FROM orders",
    "fill_placeholders": "SELECT n_nationkey::BIGINT AS id, 'see ' || n_name || ' and [1], not <bbox>.' AS text FROM nation",
    "answer_match": "SELECT 1.0::DOUBLE AS score, count(*) AS n FROM part",
    "sample_records": "SELECT p_partkey, p_name FROM part WHERE p_size > 10 ORDER BY md5('42|' || p_partkey), p_partkey LIMIT 50",
}

QUERIES = {name: globals()[name] for name in SQL}
