"""Queries on tool-call traces: pointers, histories, gates, rewards, plans and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agent, reinforcement, replay, rewards, trajectory
from ..sources import writers
from ..streaming.executor import shared_folder
from .fixtures import ANNOS, CALL_ROWS, CALLS, LR, MOVES, dealt, plain, view


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent.pointer_steps(view(spark, sf_dir, CALL_ROWS))


def pointer_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select("rec", "pos", "name", F.coalesce("ptr", F.lit(-1)).alias("ptr"), "clamped", "ok")


def history_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = agent.histories(_steps(spark, sf_dir))
    return d.select("rec", "pos", *(F.size(c).cast("bigint").alias(f"n_{c}") for c in ("visited", "annotated", "unvisited")))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executed calls on ten slices: few of them are asked for, so that boxes and propagations repeat on slices seen before."""
    calls = dealt(view(spark, sf_dir, f"WITH {MOVES} SELECT * FROM mv"), "rec").withColumns({"box": F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)), "refined": F.col("z") / 10.0})
    ten = lambda f: F.transform(F.sequence(F.lit(0), F.lit(9)), f)
    tight = ten(lambda i: F.struct(*(F.lit(v).alias(k) for k, v in (("x1", 1), ("y1", 2), ("x2", 3), ("y2", 4)))))
    cases = calls.select("rec").distinct().select("rec", F.sequence(F.lit(0), F.lit(9)).alias("sampled"), tight.alias("tight"), ten(lambda i: F.when(i % 3 < 2, F.lit(0.5))).alias("dices"))
    return replay.states(calls, cases)


def overlay_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).filter("decision").select("rec", "pos", "ptr", "changed")


def revisit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _states(spark, sf_dir).filter("decision")
    return d.groupBy("rec").agg(F.count_if("again").alias("revisits"), F.count_if(F.col("again") & ~F.col("changed")).alias("unchanged"), F.count_if("clamped").alias("clamped"))


def gate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = agent.gate_violations(view(spark, sf_dir, CALL_ROWS))
    return d.select("rec", F.size("violations").cast("bigint").alias("n"), F.array_join("violations", ",").alias("violations"))


def validate_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent.validate_traces(view(spark, sf_dir, CALL_ROWS))


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reward components of each trace; slices with an even number stand for lesions."""
    steps = _states(spark, sf_dir)
    even = F.array(*(F.lit(i) for i in range(0, 10, 2)))
    odd = F.array(*(F.lit(i) for i in range(1, 10, 2)))
    drawn = F.array_sort(F.collect_set(F.when(F.col("ok") & (F.col("name") == "add_bbox"), F.col("ptr"))))
    gain = rewards.clipped_gain((F.col("z") / 20.0), (F.col("z") / 20.0 + F.col("delta") / 10.0))
    points = F.sum(F.when(F.col("ok") & (F.col("name") == "add_point"), gain).otherwise(0.0))
    box = F.avg(F.when(F.col("ok") & (F.col("name") == "add_bbox"), F.col("z") / 10.0))
    style = F.coalesce(F.sum(F.when(F.col("decision"), rewards.move_style())), F.lit(0.0))
    g = steps.groupBy("rec").agg(drawn.alias("drawn"), points.alias("r_dice_gain"), F.coalesce(box, F.lit(0.0)).alias("r_bbox_iou"), F.count_if(F.col("name") != "malformed").alias("n"), style.alias("r_nav_style"))
    g = g.withColumn("r_coverage", rewards.coverage(F.col("drawn"), even, odd)).withColumn("r_efficiency", rewards.efficiency(F.col("n")))
    return g.drop("drawn")


def reward_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _components(spark, sf_dir)
    return d.select("rec", *(F.round(c, 6).alias(c) for c in ("r_nav_style", "r_coverage", "r_dice_gain", "r_bbox_iou", "r_efficiency")))


def reward_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _components(spark, sf_dir).withColumn("r_dice", (F.col("rec") % 11) / 10.0).withColumn("r_key_dice", (F.col("rec") % 7) / 6.0)
    gate = F.when(F.col("rec") % 4 == 0, 0).otherwise(1)
    return d.select("rec", F.round(rewards.combined(gate, F.lit(1.0)), 6).alias("reward"), F.round(rewards.combined(gate, F.lit(0.5), soft=True), 6).alias("soft_reward"))


def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice")
    return rewards.group_advantage(d, "o_custkey", "o_totalprice").select("o_orderkey", F.round("advantage", 6).alias("advantage"))


def countdown_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "SELECT n_nationkey, n_regionkey FROM {nation}")
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    answer = F.when(n % 3 == 0, F.format_string("I try. <answer>(%d + %d) * 2</answer>", n, r)).when(n % 3 == 1, F.format_string("<answer>%d - %d * 2</answer>", n, r)).otherwise(F.format_string("<answer>__import__('os')</answer>"))
    d = d.select(n.cast("bigint").alias("id"), answer.alias("answer"), F.array(n, r, F.lit(2)).alias("numbers"), ((n + r) * 2).alias("target"))
    return rewards.countdown_reward(d).select("id", "reward")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, f"WITH {ANNOS} SELECT o_orderkey AS rec, CAST(o_custkey % 40 AS INT) AS a FROM an")
    ords = F.sequence(F.lit(0), F.lit(9))
    area = F.transform(ords, lambda i: ((F.col("rec") * 7 + i * 13) % 5).cast("int"))
    dice = F.transform(ords, lambda i: ((F.col("rec") * 3 + i * 7) % 10) / 10.0)
    return d.select("rec", F.transform(ords, lambda i: F.col("a") + 3 * i).alias("sampled"), area.alias("areas"), dice.alias("dices"))


def navigation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = trajectory.navigation_plans(_cases(spark, sf_dir))
    return d.groupBy("rec").agg(*(F.count_if(F.col("op") == op).alias(op) for op in ("get_slice", "scroll", "add_bbox", "add_point", "run_medsam2", "finish")), F.sum(F.coalesce("ordinal", F.lit(0))).cast("bigint").alias("ordinals"))


def trajectory_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = trajectory.plan_messages(trajectory.navigation_plans(_cases(spark, sf_dir)))
    return d.select("rec", "n_messages", F.substring_index("content", "\n", 2).alias("head"), F.substring_index("content", "\n", -1).alias("tail"))


def merged_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, f"WITH {CALLS} SELECT rec, pos, CASE WHEN name = 'get_slice' THEN 'assistant' WHEN name = 'scroll' THEN 'tool_call' WHEN name = 'add_bbox' THEN 'tool_response' ELSE 'user' END AS role, name AS content FROM calls")
    m = trajectory.merge_turns(d)
    return m.groupBy("rec").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"), F.sum(F.length("content").cast("bigint")).alias("chars"))


def grounding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, f"WITH {LR} SELECT rec, g, x1, y1, x2, y2 FROM gt")
    box = F.array_join(F.array(*(F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2"))), ",")
    g = d.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("g", box.alias("b")))).alias("b"))
    slots = F.array_join(F.transform("b", lambda _: F.lit("<ref-object><bbox>")), ", ")
    return g.select("rec", F.size("b").cast("bigint").alias("n_boxes"), F.array_join(F.transform("b", lambda x: x["b"]), ";").alias("bbox"), F.concat(F.lit("Found: "), slots, F.lit(".")).alias("answer"))


def rl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _cases(spark, sf_dir)
    pick = lambda on: F.filter(F.transform("areas", lambda a, i: F.when((a > 0) == on, i)), lambda i: i.isNotNull())
    d = d.withColumn("lesion", pick(True)).withColumn("other", pick(False))
    key = F.get("sampled", -F.array_max(F.transform("areas", lambda a, i: F.struct(a, (-i).alias("i"))))["i"])
    show = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    text = F.concat(F.lit("Sampled Z list (10): ["), F.array_join(F.col("sampled").cast("array<string>"), ", "), F.lit("]"))
    return d.select("rec", text.alias("prompt"), show("lesion").alias("lesion_ordinals"), show("other").alias("non_lesion_ordinals"), key.alias("oracle_key_z"))


def _rl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a prompt each, some unreadable, against the annotations of two thirds of the volumes."""
    d = view(spark, sf_dir, f"WITH {ANNOS} SELECT o_orderkey AS rec, vid, caption, o_custkey AS c FROM an")
    sampled = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (F.col("c") % 40 + 3 * i).cast("string")), ", ")
    named = F.when(F.col("rec") % 5 > 0, F.concat(F.lit('The target structure is: "'), "caption", F.lit('". '))).otherwise("")
    content = F.concat(named, F.lit("Sampled Z list (10): ["), sampled, F.lit("]"))
    image = F.concat(F.lit("/data/renders/"), F.when(F.col("rec") % 7 > 0, F.concat("vid", F.lit("_z003_raw.png"))).otherwise("scan.png"))
    message = F.struct(F.lit("user").alias("role"), content.alias("content"))
    entries = d.select("rec", F.array(message, F.struct(F.lit("assistant").alias("role"), F.lit("done").alias("content"))).alias("messages"), F.array(F.lit("/data/x.jpg"), image).alias("images"))
    areas = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda z: F.when((F.col("c") + z) % 6 > 0, (F.col("c") * 7 + z * 13) % 5).cast("bigint"))
    return reinforcement.rl_records(entries, d.filter("c % 3 <> 1").select("vid", "caption", F.col("rec").alias("anno_id"), areas.alias("areas")))


def rl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    show = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    d = _rl(spark, sf_dir)
    known = F.col("reason").isNull()
    return d.select("rec", F.coalesce("reason", F.lit("")).alias("reason"), "anno_id", F.size("messages").alias("n_messages"), *(F.when(known, show(c)).alias(c) for c in ("sampled_z", "lesion_ordinals", "non_lesion_ordinals")), F.when(known, F.col("oracle_key_z")).alias("oracle_key_z"))


def rl_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the same, told while they are written, and what the files hold."""
    folder = shared_folder(spark, "rl")
    counts = writers.write_sifted(_rl(spark, sf_dir), folder, reinforcement.REASONS)
    back = spark.read.schema("anno_id long, oracle_key_z long, images array<string>").json(folder)
    told = (F.lit(counts[k]).alias(name) for k, name in (("read", "n_read"), ("written", "n_written"), (reinforcement.UNREADABLE, "n_unreadable"), (reinforcement.UNKNOWN, "n_unknown"), ("other", "n_other")))
    return back.agg(F.count("*").alias("n_rows"), F.sum("anno_id").alias("anno_ids"), F.sum("oracle_key_z").alias("key_zs"), F.count_if(F.size("images") > 0).alias("with_images")).select(*told, "n_rows", "anno_ids", "key_zs", "with_images")


POINTER_SQL = f"""WITH RECURSIVE {plain(CALLS)}, r AS (SELECT DISTINCT rec, 0::BIGINT AS pos, '' AS name, 0 AS z, 0 AS delta, NULL::INT AS prev, NULL::INT AS ptr, false AS clamped, false AS ok FROM calls
  UNION ALL SELECT c.rec, c.pos, c.name, c.z, c.delta, r.ptr, CASE WHEN c.name = 'get_slice' THEN c.z WHEN c.name = 'scroll' AND r.ptr IS NOT NULL AND c.delta <> 0 THEN least(9, greatest(0, r.ptr + c.delta)) ELSE r.ptr END,
    coalesce(c.name = 'scroll' AND c.delta <> 0 AND (r.ptr + c.delta < 0 OR r.ptr + c.delta > 9), false),
    CASE WHEN c.name = 'scroll' THEN r.ptr IS NOT NULL AND c.delta <> 0 WHEN c.name IN ('add_bbox', 'add_point') THEN coalesce(r.ptr = c.z, false) ELSE c.name <> 'malformed' END
  FROM r JOIN calls c ON c.rec = r.rec AND c.pos = r.pos + 1), s AS (SELECT * FROM r WHERE pos > 0)"""
_NAV = f"""WITH RECURSIVE {plain(MOVES)}, r AS (SELECT DISTINCT rec, 0::BIGINT AS pos, '' AS name, 0 AS z, 0 AS delta, NULL::INT AS prev, NULL::INT AS ptr, false AS clamped, false AS ok, false AS decision, false AS changed, false AS again,
    list_transform(range(10), lambda i: 'raw') AS overlay, list_transform(range(10), lambda i: NULL::VARCHAR) AS shown, []::INT[] AS seen FROM mv
  UNION ALL SELECT rec, pos, name, z, delta, prev, ptr, clamped, ok, decision, decision AND shown[ptr + 1] IS DISTINCT FROM overlay[ptr + 1], decision AND list_contains(seen, ptr),
    list_transform(range(10), lambda i: CASE WHEN ok AND name = 'add_bbox' AND i = prev THEN 'bbox' WHEN ok AND name = 'add_point' AND i = prev THEN 'refined_mask' WHEN name = 'run_medsam2' AND i % 3 < 2 THEN 'mask' ELSE overlay[i + 1] END),
    CASE WHEN name IN ('get_slice', 'scroll') AND ptr IS NOT NULL THEN list_transform(range(10), lambda i: CASE WHEN i = ptr THEN overlay[i + 1] ELSE shown[i + 1] END) ELSE shown END,
    CASE WHEN ok AND name IN ('get_slice', 'scroll') THEN list_append(seen, ptr) ELSE seen END
  FROM (SELECT c.*, r.ptr AS prev, CASE WHEN c.name = 'get_slice' THEN c.z WHEN c.name = 'scroll' AND c.delta <> 0 AND r.ptr IS NOT NULL THEN least(9, greatest(0, r.ptr + c.delta)) ELSE r.ptr END AS ptr,
      coalesce(c.name = 'scroll' AND c.delta <> 0 AND (r.ptr + c.delta < 0 OR r.ptr + c.delta > 9), false) AS clamped, c.name = 'get_slice' OR (c.name = 'scroll' AND r.ptr IS NOT NULL) AS decision,
      CASE WHEN c.name = 'scroll' THEN r.ptr IS NOT NULL AND c.delta <> 0 WHEN c.name IN ('add_bbox', 'add_point') THEN coalesce(r.ptr = c.z, false) ELSE c.name <> 'malformed' END AS ok, r.overlay, r.shown, r.seen
    FROM r JOIN mv c ON c.rec = r.rec AND c.pos = r.pos + 1)),
s AS (SELECT * FROM r WHERE pos > 0), v AS (SELECT * FROM s WHERE decision)"""
_REW = f"""{_NAV}, st AS (SELECT rec, sum(CASE WHEN name = 'scroll' THEN CASE WHEN clamped THEN -0.02 WHEN abs(delta) <= 2 THEN 0.01 ELSE 0 END
  ELSE CASE WHEN prev IS NULL OR abs(ptr - prev) >= 3 THEN 0.01 ELSE 0 END + CASE WHEN again AND NOT changed THEN -0.05 ELSE 0 END END::DOUBLE) AS r_nav_style FROM v GROUP BY rec),
g AS (SELECT rec, count(DISTINCT ptr) FILTER (ok AND name = 'add_bbox' AND ptr % 2 = 0) AS e, count(DISTINCT ptr) FILTER (ok AND name = 'add_bbox' AND ptr % 2 = 1) AS o,
  coalesce(sum(least(0.3::DOUBLE, greatest(0::DOUBLE, (z / 20.0::DOUBLE + delta / 10.0::DOUBLE) - z / 20.0::DOUBLE))) FILTER (ok AND name = 'add_point'), 0) AS r_dice_gain,
  coalesce(avg(z / 10.0::DOUBLE) FILTER (ok AND name = 'add_bbox'), 0) AS r_bbox_iou, count(*) FILTER (name <> 'malformed') AS n FROM s GROUP BY rec),
w AS (SELECT rec, coalesce(r_nav_style, 0) AS r_nav_style, e / 5.0::DOUBLE - 0.5::DOUBLE * o AS r_coverage, r_dice_gain, r_bbox_iou, -0.01::DOUBLE * greatest(n - 45, 0) AS r_efficiency FROM g LEFT JOIN st USING (rec))"""
_CASE = f"""WITH {plain(ANNOS)}, cs AS (SELECT o_orderkey AS rec, (o_custkey % 40)::INT AS a FROM an),
od AS (SELECT rec, a, unnest(range(10)) AS i FROM cs), oa AS (SELECT *, a + 3 * i AS z, (rec * 7 + i * 13) % 5 AS area, (rec * 3 + i * 7) % 10 / 10.0::DOUBLE AS dice FROM od)"""
_ADV = "(o_totalprice - avg(o_totalprice) OVER w) / nullif(stddev_pop(o_totalprice) OVER w, 0)"

_RL = f"""WITH {plain(ANNOS)}, e AS (SELECT o_orderkey AS rec, vid, caption, o_custkey AS c, o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AS readable FROM an),
k AS (SELECT vid, caption, max(rec) AS anno_id FROM e WHERE c % 3 <> 1 GROUP BY ALL), j AS (SELECT e.*, k.anno_id FROM e LEFT JOIN k ON readable AND e.vid = k.vid AND e.caption = k.caption),
z AS (SELECT rec, c, i, (c % 40 + 3 * i)::INT AS z FROM (SELECT rec, c, unnest(range(10)) AS i FROM e)), a AS (SELECT *, CASE WHEN (c + z) % 6 > 0 THEN (c * 7 + z * 13) % 5 ELSE 0 END AS area FROM z WHERE z < 60 UNION ALL SELECT *, 0 FROM z WHERE z >= 60),
g AS (SELECT rec, string_agg(z::VARCHAR, ',' ORDER BY i) AS zs, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (area > 0), '') AS l, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (area = 0), '') AS o, arg_max(z, (area, -i)) FILTER (area > 0) AS key FROM a GROUP BY rec),
q AS (SELECT j.rec, CASE WHEN NOT readable THEN '{reinforcement.UNREADABLE}' WHEN anno_id IS NULL THEN '{reinforcement.UNKNOWN}' ELSE '' END AS reason, anno_id, zs, l, o, key FROM j JOIN g USING (rec))"""

SQL = {
    "rl_records": f"""{_RL} SELECT rec, reason, anno_id, 1 AS n_messages, CASE WHEN reason = '' THEN zs END AS sampled_z, CASE WHEN reason = '' THEN l END AS lesion_ordinals, CASE WHEN reason = '' THEN o END AS non_lesion_ordinals,
      CASE WHEN reason = '' THEN key END AS oracle_key_z FROM q""",
    "rl_files": f"""{_RL} SELECT count(*) AS n_read, count(*) FILTER (reason = '') AS n_written, count(*) FILTER (reason = '{reinforcement.UNREADABLE}') AS n_unreadable, count(*) FILTER (reason = '{reinforcement.UNKNOWN}') AS n_unknown, 0::BIGINT AS n_other,
      count(*) FILTER (reason = '') AS n_rows, sum(anno_id)::BIGINT AS anno_ids, sum(CASE WHEN reason = '' THEN key END)::BIGINT AS key_zs, 0::BIGINT AS with_images FROM q""",
    "pointer_fold": f"{POINTER_SQL} SELECT rec, pos, name, coalesce(ptr, -1) AS ptr, clamped, ok FROM s",
    "history_sets": f"""{POINTER_SQL}, k AS (SELECT * FROM s WHERE ok), h AS (SELECT a.rec, a.pos, count(DISTINCT b.ptr) FILTER (b.name IN ('get_slice', 'scroll')) AS n_visited, count(DISTINCT b.ptr) FILTER (b.name = 'add_bbox') AS n_annotated
      FROM k a JOIN k b ON a.rec = b.rec AND b.pos <= a.pos GROUP BY ALL) SELECT rec, pos, n_visited, n_annotated, 10 - n_visited AS n_unvisited FROM h""",
    "overlay_change": f"{_NAV} SELECT rec, pos, ptr, changed FROM v",
    "revisit_flags": f"{_NAV} SELECT rec, count(*) FILTER (again) AS revisits, count(*) FILTER (again AND NOT changed) AS unchanged, count(*) FILTER (clamped) AS clamped FROM v GROUP BY rec",
    "gate_violations": f"""WITH RECURSIVE {plain(CALLS)}, r AS (SELECT DISTINCT rec, 0::BIGINT AS pos, NULL::INT AS ptr, false AS seen, []::VARCHAR[] AS v, 0 AS ends, 0::BIGINT AS last FROM calls
      UNION ALL SELECT c.rec, c.pos, CASE WHEN c.name = 'get_slice' THEN c.z WHEN c.name = 'scroll' AND r.ptr IS NOT NULL THEN least(9, greatest(0, r.ptr + c.delta)) ELSE r.ptr END, r.seen OR c.name = 'get_slice',
        CASE WHEN c.name = 'scroll' AND NOT r.seen THEN list_append(v, 'scroll_before_first_get_slice') WHEN c.name IN ('add_bbox', 'add_point') AND coalesce(r.ptr <> c.z, true) THEN list_append(v, c.name || '_z_mismatch_at_' || (c.pos - 1)) ELSE v END,
        ends + CASE WHEN c.name = 'finish' THEN 1 ELSE 0 END, CASE WHEN c.name = 'finish' THEN c.pos ELSE last END FROM r JOIN calls c ON c.rec = r.rec AND c.pos = r.pos + 1),
      e AS (SELECT rec, arg_max(v, pos) AS v, arg_max(ends, pos) AS ends, arg_max(last, pos) AS last, max(pos) AS n FROM r GROUP BY rec),
      f AS (SELECT rec, v || ['run_medsam2_count=0'] || CASE WHEN ends <> 1 THEN ['finish_count=' || ends] WHEN last <> n THEN ['finish_not_last'] ELSE [] END AS v FROM e)
      SELECT rec, len(v)::BIGINT AS n, array_to_string(v, ',') AS violations FROM f""",
    "validate_trajectory": f"""WITH {plain(CALLS)}, l AS (SELECT *, last_value(CASE WHEN name IN ('get_slice', 'scroll', 'run_medsam2') THEN {{'name': name, 'z': z}} END IGNORE NULLS) OVER w AS moved
      FROM calls WINDOW w AS (PARTITION BY rec ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      g AS (SELECT rec, count(*) FILTER (name = 'malformed') AS bad, count(*) FILTER (name = 'run_medsam2') AS runs, count(*) FILTER (name = 'scroll' AND delta = 0) AS still,
        count(*) FILTER (name IN ('add_bbox', 'add_point') AND moved.name = 'get_slice' AND moved.z <> z) AS blind, count(*) FILTER (name = 'finish') AS ends,
        arg_min(name, pos) FILTER (name IN ('get_slice', 'scroll')) AS first, arg_max(name, pos) AS last FROM l GROUP BY rec)
      SELECT rec, CASE WHEN bad > 0 THEN 'malformed call' WHEN runs > 1 THEN 'run_medsam2 more than once' WHEN still > 0 THEN 'scroll by 0' WHEN first <> 'get_slice' THEN 'first navigation is not get_slice'
        WHEN blind > 0 THEN 'annotation of a slice not viewed' WHEN ends <> 1 THEN 'not one finish' WHEN last <> 'finish' THEN 'finish is not last' ELSE 'ok' END AS reason FROM g""",
    "reward_components": f"{_REW} SELECT rec, " + ", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in ("r_nav_style", "r_coverage", "r_dice_gain", "r_bbox_iou", "r_efficiency")) + " FROM w",
    "reward_combined": f"""{_REW}, t AS (SELECT rec, rec % 4 <> 0 AS gate, 0.7::DOUBLE * ((rec % 11) / 10.0::DOUBLE) + 0.3::DOUBLE * ((rec % 7) / 6.0::DOUBLE) + r_efficiency AS base,
      0.20::DOUBLE * r_bbox_iou + 0.15::DOUBLE * r_dice_gain + 0.10::DOUBLE * r_coverage + 0.05::DOUBLE * r_nav_style AS shaped FROM w)
      SELECT rec, round(CASE WHEN gate THEN base + shaped ELSE 0 END, 6)::DOUBLE AS reward, round((base + 0.5 * shaped) * CASE WHEN gate THEN 1 ELSE 0.1 END, 6)::DOUBLE AS soft_reward FROM t""",
    "group_advantage": f"SELECT o_orderkey, round({_ADV}, 6) AS advantage FROM orders WINDOW w AS (PARTITION BY o_custkey)",
    "countdown_reward": "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 3 = 0 THEN 1.0 WHEN n_nationkey % 3 = 1 AND n_nationkey - n_regionkey * 2 = (n_nationkey + n_regionkey) * 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM nation",
    "navigation_plan": f"""{_CASE}, k AS (SELECT rec, arg_max(i, (area, -i)) AS key FROM oa GROUP BY rec)
      SELECT rec, 9::BIGINT AS get_slice, 16::BIGINT AS scroll, count(*) FILTER (area > 0) AS add_bbox, count(*) FILTER (dice < 0.7) AS add_point, 1::BIGINT AS run_medsam2, 1::BIGINT AS finish,
        (25 + 45 + 45 + sum(CASE WHEN area > 0 THEN i ELSE 0 END) + sum(CASE WHEN dice < 0.7 THEN i ELSE 0 END) + max(key))::BIGINT AS ordinals FROM oa JOIN k USING (rec) GROUP BY rec""",
    "trajectory_messages": f"""{_CASE} SELECT rec, (25 + 2 + count(*) FILTER (area > 0) + count(*) FILTER (dice < 0.7))::BIGINT AS n_messages,
      '{{"name": "get_slice", "arguments": {{"z_index": ' || max(a + 15) || '}}}}' || chr(10) || '{{"name": "scroll", "arguments": {{"delta": -2}}}}' AS head, '{{"name": "finish", "arguments": {{}}}}' AS tail FROM oa GROUP BY rec""",
    "merged_turns": f"""WITH {plain(CALLS)}, t AS (SELECT rec, pos, CASE WHEN name IN ('get_slice', 'scroll') THEN 'assistant' ELSE 'user' END AS role, len(name) + CASE name WHEN 'scroll' THEN 25 WHEN 'add_bbox' THEN 33 ELSE 0 END AS n FROM calls),
      i AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY rec ORDER BY pos) = role THEN 0 ELSE 1 END AS new FROM t)
      SELECT rec, sum(new)::BIGINT AS turns, (count(*) FILTER (new = 1 AND role = 'assistant')) AS assistant_turns, sum(n + 1 - new)::BIGINT AS chars FROM i GROUP BY rec""",
    "grounding_rows": f"""WITH {plain(LR)} SELECT rec, count(*) AS n_boxes, string_agg(x1 || ',' || y1 || ',' || x2 || ',' || y2, ';' ORDER BY g) AS bbox, 'Found: ' || string_agg('<ref-object><bbox>', ', ') || '.' AS answer FROM gt GROUP BY rec""",
    "rl_rows": f"""{_CASE} SELECT rec, 'Sampled Z list (10): [' || string_agg(z::VARCHAR, ', ' ORDER BY i) || ']' AS prompt, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (area > 0), '') AS lesion_ordinals,
      coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (area = 0), '') AS non_lesion_ordinals, arg_max(z, (area, -i))::INT AS oracle_key_z FROM oa GROUP BY rec""",
}

QUERIES = {name: globals()[name] for name in SQL}
