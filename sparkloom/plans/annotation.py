"""Queries on annotations and text: numbering, splits, look-ups, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import annotations as an
from ..operators import matching
from .fixtures import ANNOS, CALLS, LR, TEXTS, plain, view

SEED = 42


def _annos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, f"WITH {ANNOS} SELECT * FROM an")


def ordered_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.ordered_annotations(_annos(spark, sf_dir)).select("vid", "eid", "anno_id")


def key_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.key_split(_annos(spark, sf_dir), "vid", 0.9).groupBy("vid", "split").agg(F.count("*").alias("n"))


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.hash_split(_annos(spark, sf_dir), ["eid"], 0.9, SEED).select("eid", "split")


def random_k_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.random_subset(_annos(spark, sf_dir), ["eid"], 150, SEED).select("eid", "vid")


def classify_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, f"{_CAPTIONS} SELECT * FROM cp")
    return d.select("id", text.classify_caption(F.col("caption")).alias("category"), text.slug(F.col("caption"), 12).alias("slug"))


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, f"{_CAPTIONS} SELECT * FROM cp").withColumn("category", text.classify_caption(F.col("caption")))
    d = an.hash_split(d, ["id"], 0.8, SEED)
    return d.rollup("split").agg(F.count("*").alias("n"), *(F.count_if(F.col("category") == c).alias(c) for c in ("lesion", "cyst", "organ", "other"))).withColumn("split", F.coalesce("split", F.lit("all")))


def slice_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, f"WITH {ANNOS} SELECT o_orderkey AS id, CAST(o_custkey % 60 AS INT) AS a, CAST(o_custkey % 60 + o_orderkey % 39 AS INT) AS b FROM an")
    return d.select("id", F.array_join(an.sampled_slices(F.col("a"), F.col("b")).cast("array<string>"), ",").alias("z"))


def frame_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, f"WITH {ANNOS} SELECT o_orderkey AS id, CAST(o_orderkey % 23 AS INT) AS n FROM an")
    pos = F.filter(F.sequence(F.lit(0), F.lit(22)), lambda i: i < F.col("n"))
    neg = F.filter(F.sequence(F.lit(0), F.lit(22)), lambda i: i >= F.col("n"))
    return d.select("id", F.array_join(arrays.positives_first(pos, neg, 8).cast("array<string>"), ",").alias("frames"))


def key_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, f"WITH {LR} SELECT rec, g, CAST((x2 - x1) * (y2 - y1) AS BIGINT) AS area FROM gt")
    best = F.max(F.struct("area", (-F.col("g")).alias("k")))
    d = d.groupBy("rec").agg(best.alias("b"))
    peak = (-F.col("b.k")) % 10
    return d.select("rec", (-F.col("b.k")).alias("key_g"), F.col("b.area").alias("area"), an.trend(peak).alias("trend"))


def caption_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit, _ = _lookup(spark, sf_dir)
    return hit.select("rec", "caption", "eid")


def lookup_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, miss = _lookup(spark, sf_dir)
    return miss.groupBy("caption").agg(F.count("*").alias("n"))


def _lookup(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    table = view(spark, sf_dir, f"WITH {ANNOS} SELECT vid, caption, eid, o_orderkey FROM an WHERE o_orderkey % 2 = 0")
    rows = view(spark, sf_dir, f"WITH {ANNOS} SELECT o_orderkey AS rec, vid, caption FROM an")
    return an.lookup_last(rows, table, ["vid", "caption"], "o_orderkey")


def dimension_lookup_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) WHEN p_partkey % 3 = 1 THEN concat(lower(substr(p_type, 1, 1)), substr(p_type, 2)) ELSE 'NONE' END AS name FROM {part}")
    table = view(spark, sf_dir, "SELECT p_partkey AS pos, p_type AS label FROM {part}")
    return an.dimension_lookup(rows, "name", table, "label", "pos").select("id", "label_pos")


def caption_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "SELECT n_nationkey AS id, n_name, r_name FROM {nation} LEFT JOIN {region} ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
    known = F.create_map(*(F.lit(x) for k in range(0, 25, 4) for x in (f"NATION_{k}", f"term {k}")))
    caption = F.coalesce(F.try_element_at(known, F.col("n_name")), F.try_element_at(known, F.col("r_name")), F.lower("r_name"), F.format_string("the %s region", F.col("n_name")))
    return d.select(F.col("id").cast("bigint").alias("id"), caption.alias("caption"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, f"WITH {TEXTS} SELECT * FROM tx")


def _show(boxes) -> F.Column:
    return F.array_join(F.transform(boxes, lambda b: F.format_string("%.2f,%.2f,%.2f,%.2f", b["x1"], b["y1"], b["x2"], b["y2"])), ";")


def parse_boxes_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = text.plain_boxes(F.col("text"))
    return _texts(spark, sf_dir).select("id", F.size(b).cast("bigint").alias("n"), _show(b).alias("boxes"))


def parse_boxes_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _texts(spark, sf_dir).withColumn("b", text.cascade_boxes(F.col("text")))
    return d.select("id", _show("b").alias("boxes"), F.coalesce(text.parse_error(F.col("text"), F.col("b")), F.lit("")).alias("error"))




def parse_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"))
    first = F.concat(F.lit('I look at it. <tool_call>{"name": "get_slice", "arguments": {"z_index": '), (F.col("id") % 10).cast("string"), F.lit("}}</tool_call>"))
    broken = F.when(F.col("id") % 3 == 0, "<tool_call>{broken</tool_call>").otherwise("")
    finish = F.when(F.col("id") % 2 == 0, '\n<tool_call>\n{"name": "finish", "arguments": {}}\n</tool_call>').otherwise("")
    d = ev.withColumn("text", F.concat(first, broken, finish)).withColumn("calls", text.tool_calls(F.col("text")))
    name = F.array_join(F.transform("calls", lambda c: F.get_json_object(c, "$.name")), ",")
    return d.select("id", F.size("calls").cast("bigint").alias("n"), name.alias("names"), F.get_json_object(F.get("calls", F.lit(0)), "$.arguments.z_index").cast("bigint").alias("z"), text.reasoning(F.col("text")).alias("cot"))


def parse_sampled_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'Sampled Z = 3' ELSE concat('Sampled Z list (', CAST(o_custkey AS STRING), '): [', CAST(o_custkey % 50 AS STRING), ', ', CAST(o_custkey % 50 + 7 AS STRING), '] Z=', CAST(o_custkey % 9 AS STRING), ':') END AS text FROM {orders}")
    z = text.sampled_slices(F.col("text"))
    marked = F.array_join(text.marked_slices(F.col("text")).cast("array<string>"), ",")
    return d.select("id", F.coalesce(F.array_join(z.cast("array<string>"), ","), F.lit("none")).alias("z"), marked.alias("marked"))


def vid_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN concat('/data/case_', CAST(c_custkey AS STRING), '_image/00001.jpg') ELSE concat('/r/out/v', CAST(c_custkey AS STRING), '_z012_', CASE WHEN c_custkey % 2 = 0 THEN 'raw' ELSE 'bbox' END, '.png') END AS path FROM {customer}")
    return d.select("id", text.volume_of_render(F.col("path")).alias("vid"), text.parent_folder(F.col("path")).alias("folder"), text.volume_id(F.col("path"), F.col("id")).alias("name"))


def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "SELECT p_partkey AS id, concat(p_name, ' / ', p_brand, '!') AS t FROM {part}")
    return d.select("id", text.slug(F.col("t")).alias("slug"), F.format_string("z%03d", (F.col("id") % 120).cast("int")).alias("tag"), text.count_of(F.col("t"), "r").alias("n_r"))


def json_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("v", F.try_parse_json("props"))
    return d.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.try_variant_get("v", "$.k", "bigint")).alias("sum_k"), F.count_if(F.try_variant_get("v", "$.none", "bigint").isNull()).alias("missing"))


def fifo_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "SELECT conv_id AS rec, turn AS pos, role FROM {conversations}")
    m = m.groupBy("rec", "pos").agg(F.max("role").alias("role"))
    return matching.fifo_pairs(m, "user", "assistant")


def final_box_per_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, f"WITH {CALLS} SELECT rec, pos, z, delta FROM calls WHERE name = 'add_bbox'")
    return matching.last_per_key(d, ["rec", "z"], "pos")


def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return d.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("bigint")).alias("chars"), F.sum(text.count_of(F.col("text"), "en")).alias("marks"))


def tool_call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, f"WITH {CALLS} SELECT * FROM calls")
    n = d.groupBy("rec", "name").agg(F.count("*").alias("n"))
    return n.groupBy("name").agg(F.sum("n").alias("total"), F.count("*").alias("records"), F.round(F.avg("n"), 6).alias("mean"))


def token_budget_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    words = F.size(F.filter(F.split("text", "[ \n]"), lambda w: w != ""))
    scope = F.sum(F.when(F.col("role") == "assistant", words).otherwise(0)).cast("bigint")
    g = d.groupBy("conv_id").agg(F.sum(words).cast("bigint").alias("tokens"), scope.alias("loss_tokens"))
    return g.filter(F.col("tokens") <= 400)


def correction_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, f"WITH {LR} SELECT rec, rn, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS label FROM bx")
    key = F.md5(F.concat_ws("|", F.lit(str(SEED)), F.col("rec").cast("string"), F.col("rn").cast("string")).cast("binary"))
    k = F.row_number().over(W.partitionBy("rec", "label").orderBy(key, "rn"))
    return d.withColumn("k", k).filter(F.col("k") <= F.when(F.col("label") == 1, 3).otherwise(2)).select("rec", "rn", "label")


_CAPTIONS = """WITH cp AS (SELECT p_partkey AS id, CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN 'Non-malignant cyst' WHEN 1 THEN 'renal ORGAN filtering' WHEN 2 THEN 'fluid pouch'
  WHEN 3 THEN concat('bone ', p_name) WHEN 4 THEN 'kidney tumor' WHEN 5 THEN 'a pair of organs' ELSE p_type END AS caption FROM {part})"""
_CAT = "CASE " + " ".join(f"WHEN regexp_matches(lower(caption), '{'|'.join(words)}') THEN '{name}'" for name, words in text.KEYWORDS.items()) + " ELSE 'other' END"
_HASH = lambda keys, salt: f"('0x' || substr(md5(concat_ws('|', '{SEED}', {keys}, '{salt}')), 1, 7))::BIGINT::DOUBLE / {1 << 28}.0"
_SLUG = lambda c, n: f"CASE WHEN trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'x' ELSE substr(trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-'), 1, {n}) END"
_BOX = text.UNSIGNED_BOX
_FMT = "format('{:.2f},{:.2f},{:.2f},{:.2f}', "
_AN = f"WITH {plain(ANNOS)}"
_LOOK = f"""{_AN}, t AS (SELECT vid, caption, arg_max(eid, o_orderkey) AS eid FROM an WHERE o_orderkey % 2 = 0 GROUP BY ALL), q AS (SELECT o_orderkey AS rec, vid, caption FROM an)"""

SQL = {
    "ordered_annotations": f"{_AN} SELECT vid, eid, row_number() OVER (ORDER BY vid, eid::BIGINT) - 1 AS anno_id FROM an",
    "key_split": f"{_AN}, k AS (SELECT vid, row_number() OVER (ORDER BY vid) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT vid FROM an)) SELECT vid, CASE WHEN p <= floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split, count(*) AS n FROM an JOIN k USING (vid) GROUP BY ALL",
    "hash_split": f"{_AN} SELECT eid, CASE WHEN {_HASH('eid', 'split')} < 0.9 THEN 'train' ELSE 'val' END AS split FROM an",
    "random_k_subset": f"{_AN} SELECT eid, vid FROM an ORDER BY md5(concat_ws('|', '{SEED}', eid)), eid LIMIT 150",
    "classify_text": f"{plain(_CAPTIONS)} SELECT id, {_CAT} AS category, {_SLUG('caption', 12)} AS slug FROM cp",
    "category_counts": f"""{plain(_CAPTIONS)}, q AS (SELECT {_CAT} AS category, CASE WHEN {_HASH('id', 'split')} < 0.8 THEN 'train' ELSE 'val' END AS split FROM cp)
      SELECT coalesce(split, 'all') AS split, count(*) AS n, count(*) FILTER (category = 'lesion') AS lesion, count(*) FILTER (category = 'cyst') AS cyst, count(*) FILTER (category = 'organ') AS organ, count(*) FILTER (category = 'other') AS other FROM q GROUP BY ROLLUP (split)""",
    "slice_sampling": f"""{_AN}, q AS (SELECT o_orderkey AS id, (o_custkey % 60)::INT AS a, (o_custkey % 60 + o_orderkey % 39)::INT AS b FROM an)
      SELECT id, array_to_string(list_transform(range(10), lambda i: CASE WHEN i = 9 THEN b ELSE floor(i * ((b - a) / 9.0::DOUBLE) + a)::INT END), ',') AS z FROM q""",
    "frame_sampling": f"""{_AN}, q AS (SELECT o_orderkey AS id, (o_orderkey % 23)::INT AS n FROM an), c AS (SELECT *, least(n, 8) AS np, least(23 - n, 8 - least(n, 8)) AS nn FROM q)
      SELECT id, array_to_string(list_sort(list_transform(range(np), lambda i: CASE WHEN np > 1 AND i = np - 1 THEN n - 1 ELSE round_even(i * ((n - 1)::DOUBLE / greatest(np - 1, 1)), 0)::INT END) ||
        list_transform(range(nn), lambda i: n + CASE WHEN nn > 1 AND i = nn - 1 THEN 22 - n ELSE round_even(i * ((22 - n)::DOUBLE / greatest(nn - 1, 1)), 0)::INT END)), ',') AS frames FROM c""",
    "key_slice": f"""WITH {plain(LR)}, q AS (SELECT rec, g, ((x2 - x1) * (y2 - y1))::BIGINT AS area, row_number() OVER (PARTITION BY rec ORDER BY (x2 - x1) * (y2 - y1) DESC, g) AS k FROM gt)
      SELECT rec, g AS key_g, area, CASE WHEN abs(g % 10 - 4) <= 1 THEN 'symmetric' WHEN g % 10 >= 5 THEN 'upper' ELSE 'lower' END AS trend FROM q WHERE k = 1""",
    "caption_lookup_join": f"{_LOOK} SELECT rec, caption, eid FROM q JOIN t USING (vid, caption)",
    "lookup_miss": f"{_LOOK} SELECT caption, count(*) AS n FROM q ANTI JOIN t USING (vid, caption) GROUP BY ALL",
    "dimension_lookup_ci": "WITH q AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) WHEN p_partkey % 3 = 1 THEN concat(lower(substr(p_type, 1, 1)), substr(p_type, 2)) ELSE 'NONE' END AS name FROM part) SELECT id, (SELECT min(p_partkey) FROM part WHERE lower(p_type) = lower(name)) AS label_pos FROM q",
    "caption_fallback": "SELECT n_nationkey::BIGINT AS id, coalesce(CASE WHEN n_nationkey % 4 = 0 THEN 'term ' || n_nationkey END, lower(r_name), 'the ' || n_name || ' region') AS caption FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'",
    "parse_boxes_regex": f"""WITH {plain(TEXTS)}, q AS (SELECT id, {', '.join(f"regexp_extract_all(text, '{_BOX}', {i}) AS a{i}" for i in (1, 2, 3, 4))} FROM tx)
      SELECT id, len(a1)::BIGINT AS n, array_to_string(list_transform(range(1, len(a1) + 1), lambda i: {_FMT}a1[i]::DOUBLE, a2[i]::DOUBLE, a3[i]::DOUBLE, a4[i]::DOUBLE)), ';') AS boxes FROM q""",
    "parse_boxes_cascade": f"""WITH {plain(TEXTS)}, c AS (SELECT id, id % 6 AS k, (regexp_extract_all(text, '\\d+'))[1]::DOUBLE AS v FROM tx)
      SELECT id, CASE k WHEN 1 THEN {_FMT}v, 1.0, (regexp_extract_all(text, '\\d+'))[3]::DOUBLE, 4.0) || ';5.00,6.50,7.00,8.00' WHEN 2 THEN {_FMT}v, 2.0, (regexp_extract_all(text, '\\d+'))[3]::DOUBLE, 9.0)
        WHEN 3 THEN {_FMT}(regexp_extract_all(text, '\\d+'))[2]::DOUBLE, 1.0, 999.0, 7.0) ELSE '' END AS boxes, CASE WHEN k IN (0, 5) THEN 'no_bbox_parsed' ELSE '' END AS error FROM c JOIN tx USING (id)""",
    "parse_tool_calls": """SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n, CASE WHEN event_id % 2 = 0 THEN 'get_slice,finish' ELSE 'get_slice' END AS names, event_id % 10 AS z, 'I look at it.' AS cot FROM events""",
    "parse_sampled_z": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'none' ELSE (o_custkey % 50) || ',' || (o_custkey % 50 + 7) END AS z, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE (o_custkey % 9)::VARCHAR END AS marked FROM orders",
    "vid_from_path": """WITH q AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '/data/case_' || c_custkey || '_image/00001.jpg' ELSE '/r/out/v' || c_custkey || '_z012_' || CASE WHEN c_custkey % 2 = 0 THEN 'raw' ELSE 'bbox' END || '.png' END AS path FROM customer)
      SELECT id, regexp_extract(path, '/([^/]+?)_z\\d+_(raw|bbox|mask|refined)\\.png$', 1) AS vid, split_part(path, '/', -2) AS folder, trim(regexp_replace(regexp_replace(replace(path, '/', '_'), '\\.npy$', ''), '[^\\w-]', '_', 'g'), '_') AS name FROM q""",
    "slugify": f"""WITH q AS (SELECT p_partkey AS id, p_name || ' / ' || p_brand || '!' AS t FROM part) SELECT id, {_SLUG('t', 40)} AS slug, format('z{{:03d}}', (id % 120)::INT) AS tag, (len(t) - len(replace(t, 'r', '')))::BIGINT AS n_r FROM q""",
    "json_args": "SELECT event_type, count(*) AS n, sum((props::JSON->>'k')::BIGINT)::BIGINT AS sum_k, count(*) AS missing FROM events GROUP BY ALL",
    "fifo_pairing": """WITH RECURSIVE m AS (SELECT conv_id AS rec, turn AS pos, max(role) AS role FROM conversations GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY pos) AS k FROM m WHERE role IN ('user', 'assistant')),
      r AS (SELECT DISTINCT rec, 0::BIGINT AS k, []::BIGINT[] AS q, NULL::BIGINT AS ask_pos, NULL::BIGINT AS answer_pos FROM s
        UNION ALL SELECT s.rec, s.k, CASE WHEN role = 'user' THEN list_append(q, pos) WHEN len(q) > 0 THEN q[2:] ELSE q END, CASE WHEN role = 'assistant' AND len(q) > 0 THEN q[1] END, CASE WHEN role = 'assistant' AND len(q) > 0 THEN pos END FROM r JOIN s ON s.rec = r.rec AND s.k = r.k + 1)
      SELECT rec, ask_pos, answer_pos FROM r WHERE ask_pos IS NOT NULL""",
    "final_box_per_z": f"WITH {plain(CALLS)} SELECT rec, z, max(pos) AS pos, arg_max(delta, pos) AS delta FROM calls WHERE name = 'add_bbox' GROUP BY rec, z",
    "role_counts": "SELECT role, count(*) AS n, sum(len(text))::BIGINT AS chars, sum((len(text) - len(replace(text, 'en', ''))) // 2)::BIGINT AS marks FROM conversations GROUP BY ALL",
    "tool_call_stats": f"WITH {plain(CALLS)}, n AS (SELECT rec, name, count(*) AS n FROM calls GROUP BY ALL) SELECT name, sum(n)::BIGINT AS total, count(*) AS records, round(avg(n), 6) AS mean FROM n GROUP BY ALL",
    "token_budget_filter": """WITH q AS (SELECT conv_id, role, len(list_filter(regexp_split_to_array(text, '[ \\n]'), lambda w: w <> '')) AS n FROM conversations)
      SELECT conv_id, sum(n)::BIGINT AS tokens, sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END)::BIGINT AS loss_tokens FROM q GROUP BY ALL HAVING sum(n) <= 400""",
    "correction_points": f"""WITH {plain(LR)}, q AS (SELECT rec, rn, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS label FROM bx), k AS (SELECT *, row_number() OVER (PARTITION BY rec, label ORDER BY md5(concat_ws('|', '{SEED}', rec, rn)), rn) AS k FROM q)
      SELECT rec, rn, label FROM k WHERE k <= CASE WHEN label = 1 THEN 3 ELSE 2 END""",
}

QUERIES = {name: globals()[name] for name in SQL}
