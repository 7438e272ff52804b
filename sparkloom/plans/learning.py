"""Queries on vectors and scores: similarity, contrastive, ranking and token losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import losses as lo
from .fixtures import LR, plain, view


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lo.even_odd_pairs(_vectors(spark, sf_dir), "vec_id", "embedding")
    return d.withColumn("y", F.when(F.col("pair") % 3 == 0, 1).otherwise(0))


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, a, b = _pairs(spark, sf_dir), F.col("a"), F.col("b")
    return d.select("pair", F.round(lo.cosine(a, b), 6).alias("cosine"), F.round(lo.euclidean(a, b), 6).alias("l2"), F.round(lo.manhattan(a, b), 6).alias("l1"))


def contrastive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _pairs(spark, sf_dir).withColumn("d", 1 - lo.cosine(F.col("a"), F.col("b")))
    mse = (1 - F.col("d") - F.col("y")) * (1 - F.col("d") - F.col("y"))
    return d.agg(F.count("*").alias("n"), F.round(F.avg(lo.contrastive(F.col("d"), F.col("y"))), 6).alias("contrastive"), F.round(F.avg(mse), 6).alias("cosine_mse"))


def online_contrastive(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _pairs(spark, sf_dir).select((1 - lo.cosine(F.col("a"), F.col("b"))).alias("d"), "y")
    return lo.online_contrastive(d).select(F.round("loss", 6).alias("loss"), "hard_positives", "hard_negatives")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every even vector of a batch of 64 against the batch's odd ones; its own partner is the positive."""
    d = _vectors(spark, sf_dir).withColumn("batch", F.floor(F.col("vec_id") / 64)).withColumn("pair", F.floor(F.col("vec_id") / 2))
    q = d.filter("vec_id % 2 = 0").select("batch", F.col("pair").alias("query"), F.col("embedding").alias("a"))
    k = d.filter("vec_id % 2 = 1").select("batch", F.col("pair").alias("doc"), F.col("embedding").alias("b"))
    return q.join(k, "batch").select("query", "doc", lo.cosine(F.col("a"), F.col("b")).alias("sim"), (F.col("query") == F.col("doc")).alias("positive"))


def infonce_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lo.info_nce(_scores(spark, sf_dir)).select("query", F.round("loss", 6).alias("loss"))


def infonce_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lo.info_nce(_scores(spark, sf_dir), margin=0.1).select("query", F.round("loss", 6).alias("loss"))


_SCORED = "SELECT doc_id, source, quality, CAST(n_chars AS DOUBLE) / 1000.0 - 2 AS logit FROM {labels} JOIN {documents} USING (doc_id)"


def pointwise_bce(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, _SCORED)
    return d.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(lo.bce_with_logits(F.col("logit"), F.col("quality"))), 6).alias("bce"))


def listwise_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lo.groups_from_labels(view(spark, sf_dir, _SCORED), "source", "doc_id", "quality")
    return lo.listwise(d.filter("grp > 0"), ["source", "grp"], "logit", "quality").select("source", "grp", F.col("size").cast("bigint").alias("size"), F.round("loss", 6).alias("loss"))


def channel_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, _SCORED).groupBy("source").agg(F.avg("logit").alias("m"))
    return d.agg(F.count("*").alias("channels"), F.round(F.avg("m"), 6).alias("mean"))


_TOKENS = f"""WITH {LR} SELECT rec, rn AS pos, CASE WHEN l_partkey % 5 = 0 THEN 'begin' WHEN l_partkey % 5 = 1 THEN 'end' ELSE 'token' END AS kind, CASE WHEN l_suppkey % 6 = 0 THEN -100 ELSE 1 END AS label,
  CAST(l_partkey % 37 AS DOUBLE) / 8.0 AS loss FROM bx"""


def span_weighted_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lo.span_weighted(lo.spans(view(spark, sf_dir, _TOKENS), "begin", "end"))
    return d.select("rec", F.round("ce", 6).alias("ce"), F.round("weighted", 6).alias("weighted"), F.round(lo.smooth_l1(F.col("ce") / 100), 6).alias("smooth"))


_P = """WITH p AS (SELECT a.vec_id // 2 AS pair, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b, CASE WHEN (a.vec_id // 2) % 3 = 0 THEN 1 ELSE 0 END AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
c AS (SELECT *, 1 - list_cosine_similarity(a, b) AS d FROM p)"""
_S = """WITH s AS (SELECT q.vec_id // 2 AS query, k.vec_id // 2 AS doc, list_cosine_similarity(q.embedding::DOUBLE[], k.embedding::DOUBLE[]) AS sim FROM embeddings q JOIN embeddings k ON q.vec_id // 64 = k.vec_id // 64 WHERE q.vec_id % 2 = 0 AND k.vec_id % 2 = 1),
t AS (SELECT *, max(CASE WHEN query = doc THEN sim END) OVER (PARTITION BY query) AS pos FROM s)"""
_D = plain(_SCORED)

SQL = {
    "cosine_pairs": f"{_P} SELECT pair, round(1 - d, 6) AS cosine, round(list_distance(a, b), 6) AS l2, round(list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))), 6) AS l1 FROM c",
    "contrastive_loss": f"{_P} SELECT count(*) AS n, round(avg(0.5 * (y * d * d + (1 - y) * greatest(0.5 - d, 0) * greatest(0.5 - d, 0))), 6) AS contrastive, round(avg((1 - d - y) * (1 - d - y)), 6) AS cosine_mse FROM c",
    "online_contrastive": f"""{_P}, e AS (SELECT CASE WHEN count(*) FILTER (y = 1) > 1 THEN max(d) FILTER (y = 1) ELSE avg(d) FILTER (y = 0) END AS under, CASE WHEN count(*) FILTER (y = 0) > 1 THEN min(d) FILTER (y = 0) ELSE avg(d) FILTER (y = 1) END AS over FROM c)
      SELECT round(coalesce(sum(CASE WHEN y = 1 AND d > over THEN d * d WHEN y = 0 AND d < under THEN pow(greatest(0.5 - d, 0), 2) END), 0), 6) AS loss, count(*) FILTER (y = 1 AND d > over) AS hard_positives, count(*) FILTER (y = 0 AND d < under) AS hard_negatives FROM c, e""",
    "infonce_batch": f"{_S} SELECT query, round(ln(sum(exp(sim * 10 - pos * 10))), 6) AS loss FROM t WHERE pos IS NOT NULL GROUP BY query",
    "infonce_masked": f"{_S} SELECT query, round(ln(sum(exp(sim * 10 - pos * 10))), 6) AS loss FROM t WHERE pos IS NOT NULL AND (query = doc OR sim <= pos + 0.1) GROUP BY query",
    "pointwise_bce": f"WITH q AS ({_D}) SELECT source, count(*) AS n, round(avg(greatest(logit, 0) - logit * quality + ln(1 + exp(-abs(logit)))), 6) AS bce FROM q GROUP BY source",
    "listwise_rerank": f"""WITH q AS ({_D}), g AS (SELECT *, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS grp FROM q)
      SELECT source, grp, count(*) AS size, round(ln(sum(exp(logit))) - max(CASE WHEN quality = 1 THEN logit END), 6) AS loss FROM g WHERE grp > 0 GROUP BY source, grp HAVING count(*) >= 2""",
    "channel_mean": f"WITH q AS ({_D}), m AS (SELECT avg(logit) AS m FROM q GROUP BY source) SELECT count(*) AS channels, round(avg(m), 6) AS mean FROM m",
    "span_weighted_ce": f"""WITH t AS ({plain(_TOKENS)}), l AS (SELECT *, last_value(CASE WHEN kind <> 'token' THEN kind END IGNORE NULLS) OVER (PARTITION BY rec ORDER BY pos) AS last FROM t),
      s AS (SELECT *, CASE WHEN last = 'begin' AND kind = 'token' THEN 3.0 ELSE 1.0 END::DOUBLE AS w FROM l WHERE label <> -100), r AS (SELECT rec, avg(loss) AS ce, sum(loss * w) / sum(w) AS weighted FROM s GROUP BY rec)
      SELECT rec, round(ce, 6) AS ce, round(weighted, 6) AS weighted, round(CASE WHEN ce / 100 < 0.1 THEN 0.5 * (ce / 100) * (ce / 100) / 0.1::DOUBLE ELSE ce / 100 - 0.05::DOUBLE END, 6)::DOUBLE AS smooth FROM r""",
}

QUERIES = {name: globals()[name] for name in SQL}
