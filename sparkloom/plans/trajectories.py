"""Queries on whole training records: builders, validators, replay, rewards of masks, grounding rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wording
from ..operators import annotations as an
from ..operators import builders, grounding, masks, records, registry, replay, rewards
from .fixtures import ANNOS, CALLS, LR, SIDES, dealt, plain, view

# cases with ten slices: areas, boxes and Dice values by formula
_CASES = f"""WITH {ANNOS} SELECT o_orderkey AS rec, vid, caption AS priority, CAST(o_custkey % 40 AS INT) AS a FROM an"""


def _ten(value) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(9)), value)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec, a = F.col("rec"), F.col("a")
    ints = lambda *v: F.array(*(x.cast("int") if isinstance(x, Column) else F.lit(x) for x in v))

    # what several fields need is made first: entries of an array are not compiled, and would compute it for each of them
    base = _ten(lambda i: F.struct(i.alias("i"), ((rec * 7 + i * 13) % 5 * 100).cast("int").alias("area"), (((rec + i * 3) % 50 + 50) / 100.0).alias("iou"), ((rec * 3 + i * 7) % 10 / 10.0).alias("dice"), (a + 3 * i).alias("z")))

    def entry(x: Column) -> Column:
        i, z, area, iou, dice = (x[c] for c in ("i", "z", "area", "iou", "dice"))
        shows = area > 0
        return F.struct(
            z.alias("z"), F.lpad(z.cast("string"), 5, "0").alias("frame"), area.alias("area"), F.when(shows, ints(10 + i, 20 + i, 50 + i + area / 100, 60 + i)).alias("box"),
            F.when(shows & (iou < 0.75), ints(11 + i, 20 + i, 50 + i, 61 + i)).alias("again"), F.when(shows, iou).alias("iou"), F.when(shows & (iou < 0.75), F.lit(0.9375)).alias("iou_again"),
            F.when(shows, dice).alias("dice"), F.when(shows & (dice < 0.7), F.lit(0.95)).alias("fixed"), F.when(shows, F.array(ints(30 + i, 40), ints(31, 41 + i))).alias("points"), F.when(shows, ints(1, 0)).alias("labels"),
        )

    category = F.when(rec % 4 == 0, "organ").when(rec % 4 == 1, "lesion").when(rec % 4 == 2, "cyst").otherwise("other")
    caption = F.concat(F.lower("priority"), F.lit(" kidney"))
    return dealt(view(spark, sf_dir, _CASES), "rec").select(
        "rec", "vid", caption.alias("caption"), category.alias("category"), F.lit("/data/JPEGImages").alias("root"), F.lit("/data/renders").alias("renders"), a.alias("first"), (a + 27).alias("last"), F.lit(28).alias("n_slices"), F.transform(base, entry).alias("o")
    )


def _told(built: DataFrame, form: str) -> DataFrame:
    """A record as its opening, its last analysis, its numbers and the validator's verdict."""
    spoken = F.filter("messages", lambda m: m["role"] == "assistant")
    d = records.validate_entries(built, form, "verdict")
    return d.select(
        "rec", F.size("messages").cast("bigint").alias("n_messages"), F.size("images").cast("bigint").alias("n_images"), F.get("messages", F.lit(0))["content"].alias("opening"),
        F.element_at(spoken, -1)["content"].alias("closing"), F.element_at("images", -1).alias("last_image"), F.size(F.array_distinct(F.transform("messages", lambda m: m["role"]))).cast("bigint").alias("roles"), "reason",
    )


def box_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(builders.box_records(_cases(spark, sf_dir), judged=True), "boxes")


def mask_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(builders.mask_records(_cases(spark, sf_dir), judged=True), "masks")


def navigation_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(builders.navigation_records(_cases(spark, sf_dir), judged=True), "navigation")


def broken_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation records with one thing broken each, by the reason that the validator finds."""
    d = builders.navigation_records(_cases(spark, sf_dir))
    kind = F.col("rec") % 7
    m = F.col("messages")
    swap = lambda old, new: F.transform(m, lambda x: F.struct(x["role"].alias("role"), F.replace(x["content"], F.lit(old), F.lit(new)).alias("content")))
    broken = (
        F.when(kind == 0, m).when(kind == 1, F.slice(m, 1, F.size(m) - 1)).when(kind == 2, swap('"name": "scroll"', '"name": "move"')).when(kind == 3, swap('"delta": 1}', '"delta": 0}'))
        .when(kind == 4, swap('"name": "get_slice", ', '"name": "get_slice"; ')).when(kind == 5, F.filter(m, lambda x: ~x["content"].contains('"name": "run_medsam2"')))
        .otherwise(F.filter(m, lambda x: ~(x["content"].contains('"status": "propagation_complete"'))))
    )
    images = F.when(kind == 6, F.slice("images", 1, F.size("images") - 10)).otherwise(F.col("images"))
    d = records.validate_entries(d.withColumn("messages", broken).withColumn("images", images), "navigation")
    return d.groupBy(kind.alias("kind"), "reason").agg(F.count("*").alias("n"))


# --- replay ------------------------------------------------------------------

# error events are runs of the propagation or malformed calls
_REPLAY = f"""WITH {CALLS} SELECT rec, pos, CASE WHEN name = 'malformed' AND z % 2 = 0 THEN 'run_medsam2' ELSE name END AS name, z + 3 AS z, delta,
  CASE WHEN name = 'add_bbox' THEN ARRAY(CAST(10 + z AS INT), 20, CAST(40 + z AS INT), 60) END AS box, CASE WHEN name = 'add_point' THEN CAST(z AS DOUBLE) / 10.0 END AS refined FROM calls"""


def replayed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    calls = dealt(view(spark, sf_dir, _REPLAY), "rec")
    tight = lambda i: F.when(i % 2 == 0, F.struct((10 + i).alias("x1"), F.lit(20).alias("y1"), (40 + i + i % 3).alias("x2"), F.lit(60).alias("y2")))
    cases = calls.select("rec").distinct().select("rec", _ten(lambda i: i + 3).alias("sampled"), _ten(tight).alias("tight"), _ten(lambda i: F.when(i % 3 < 2, i / 20.0)).alias("dices"))
    return calls, cases


def told_steps(d: DataFrame) -> DataFrame:
    """Steps with what their responses say."""
    error = F.coalesce(F.get_json_object("response", "$.error"), F.lit(""))
    shown = F.coalesce(F.size(F.from_json(F.get_json_object("response", "$.history.visited_ordinals"), "array<int>")), F.lit(-1))
    dice = F.get_json_object("response", "$.dice_with_gt").cast("double")
    return d.select("rec", "pos", "name", F.coalesce("ptr", F.lit(-1)).alias("ptr"), "ok", "clamped", "images", error.alias("error"), shown.alias("visited"), F.round("iou", 3).alias("iou"), dice.alias("dice"))


def executor_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told_steps(replay.navigate(*replayed(spark, sf_dir)))


def executor_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = replay.telemetry(replay.states(*replayed(spark, sf_dir)))
    return d.select("rec", "num_turns", "n_add_bbox", "n_add_point", "n_run_medsam2", "n_finish", "boundary_clamp_count", F.round("r_bbox_iou", 6).alias("r_bbox_iou"))


def annotation_executor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of the form without navigation, by tool."""
    calls, cases = replayed(spark, sf_dir)
    d = replay.annotate(calls.filter(F.col("name").isin("add_bbox", "run_medsam2", "add_point", "finish", "scroll")), cases)
    number = F.coalesce(F.get_json_object("response", "$.iou_with_gt"), F.get_json_object("response", "$.dice_with_gt"), F.get_json_object("response", "$.slices[4].dice_with_gt")).cast("double")
    return d.groupBy("name").agg(F.count("*").alias("n"), F.sum("images").cast("bigint").alias("images"), F.round(F.sum(number), 4).alias("total"), F.count_if(F.get_json_object("response", "$.error").isNotNull()).alias("errors"))


def abort_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, _ = replayed(spark, sf_dir)
    requests = calls.select("rec").distinct()
    d = replay.abort_rows(requests, requests.filter("rec % 3 <> 0"), "timeout")
    return d.select("rec", "r_dice", "gate", F.array_join("gate_violations", ",").alias("violations"), "num_turns", "finished")


# --- rewards of masks -----------------------------------------------------------


def mask_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices 1 to 6 of each record with the first twice; the key slice is 2, or 9, which few records have."""
    runs = masks.box_strips(view(spark, sf_dir, SIDES), ["rec", "z", "side"])
    cases = view(spark, sf_dir, f"WITH {LR} SELECT DISTINCT rec FROM bx")
    cases = cases.select("rec", F.array(*(F.lit(z).cast("bigint") for z in (1, 1, 2, 3, 4, 5, 6))).alias("sampled"), F.when(F.col("rec") % 5 == 0, 9).otherwise(2).cast("bigint").alias("key_z"))
    return rewards.dice_rewards(cases, runs, None).select("rec", F.round("r_dice", 6).alias("r_dice"), F.round("r_key_dice", 6).alias("r_key_dice"))


def named_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards by name over reported components, some missing or unreadable, and their weighted sum."""
    d = view(spark, sf_dir, "SELECT o_orderkey AS id, o_custkey FROM {orders}")
    k = F.col("id")
    infos = {
        "r_dice": F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, F.lit("bad")).otherwise((k % 10 / 10.0).cast("string")), "r_key_dice": k % 4 / 4.0, "r_bbox_iou": k % 3 / 3.0, "r_dice_gain": k % 2 / 4.0,
        "r_coverage": F.lit(0.5), "r_nav_style": F.lit(0.1), "r_efficiency": F.lit(-0.05), "gate": F.when(k % 6 == 0, F.lit(None)).otherwise(k % 4),
    }
    d = registry.with_rewards(d.select("id", *(v.alias(n) for n, v in infos.items())), ["phase3_combined", "phase3_dice", "phase3_format_gate"], [1.0, 0.5, 0.25])
    return d.select("id", *(F.round(c, 6).alias(c) for c in ("phase3_combined", "phase3_dice", "phase3_format_gate", "reward")), F.isnan(rewards.reward_or_nan(F.when(k % 9 > 0, k), F.lit(1.0))).alias("unreported"))


# --- grounding rows -----------------------------------------------------------------

_VIDEOS = "SELECT o_custkey AS vid, max(o_orderkey) AS k FROM {orders} GROUP BY o_custkey"


def _videos(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A video for each customer, an expression for each order, and its boxes on a frame of twelve."""
    frames = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.format_string("%05d", i))
    v = view(spark, sf_dir, _VIDEOS).select(F.concat(F.lit("v"), F.col("vid").cast("string")).alias("vid"), F.when(F.col("vid") % 10 == 0, "val").otherwise("train").alias("split"), frames.alias("frames"))
    b = view(spark, sf_dir, "SELECT o_custkey, o_orderkey AS k, o_orderpriority AS caption FROM {orders} WHERE o_custkey % 4 <> 3")
    b = b.select(F.concat(F.lit("v"), F.col("o_custkey").cast("string")).alias("vid"), F.col("k").cast("string").alias("eid"), (F.col("k") % 12).cast("int").alias("place"), "caption", F.col("k").alias("order"), F.explode(F.sequence(F.lit(0), (F.col("k") % 2).cast("int"))).alias("part"))
    box = F.array(F.col("place"), F.col("part"), F.col("place") + 9, F.col("part") + 9)
    return v, b.withColumn("box", box)


def grounding_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos, boxes = _videos(spark, sf_dir)
    d = grounding.image_rows(grounding.chosen_frames(videos, boxes, most=3, negatives=True), boxes, "/data/JPEGImages")
    return d.select("vid", "split", "place", F.get("messages", F.lit(1))["content"].alias("asked"), F.get("messages", F.lit(2))["content"].alias("answer"), F.get("images", F.lit(0)).alias("image"), F.size("objects.ref").cast("bigint").alias("n_ref"), F.size("objects.bbox").cast("bigint").alias("n_bbox"))


def grounding_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without negatives: the frames with boxes, and the middle frame of videos without any."""
    videos, boxes = _videos(spark, sf_dir)
    d = grounding.chosen_frames(videos, boxes)
    return d.groupBy("split", "positive").agg(F.count("*").alias("n"), F.sum("place").cast("bigint").alias("places"))


def grounding_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos, boxes = _videos(spark, sf_dir)
    expressions = view(spark, sf_dir, "SELECT concat('v', CAST(o_custkey AS STRING)) AS vid, CAST(o_orderkey AS STRING) AS eid, o_orderpriority AS caption FROM {orders}").join(videos, "vid")
    d = grounding.video_rows(expressions, boxes, "/data/JPEGImages", "Find the target in {n_frames} frames.", 4)
    return d.select("vid", "eid", "channel", F.get("messages", F.lit(1))["content"].alias("asked"), F.get("messages", F.lit(2))["content"].alias("answer"), F.size(F.get("videos", F.lit(0))).cast("bigint").alias("n_frames"), F.size("objects.bbox").cast("bigint").alias("n_bbox"))


# --- annotation helpers ------------------------------------------------------------


def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, f"WITH {ANNOS} SELECT eid FROM an")
    return an.exact_split(d, ["eid"], 0.8, 42).groupBy("split").agg(F.count("*").alias("n"))


def numbered_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, f"WITH {ANNOS} SELECT vid, eid, CASE WHEN o_custkey % 3 = 0 THEN 'val' ELSE 'train' END AS split FROM an")
    return an.ordered_annotations(d, restart="split").select("split", "vid", "eid", "anno_id")


def slice_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices with and without a mask, usable expressions, and their key slices."""
    d = view(spark, sf_dir, f"WITH {ANNOS} SELECT o_orderkey AS rec, caption FROM an")
    m = _ten(lambda i: F.when((F.col("rec") + i * 5) % 7 < 3, F.lit("m")))
    area = _ten(lambda i: F.when(F.col("rec") % 11 == 0, 0).otherwise((F.col("rec") * 7 + i * 13) % 5))
    category = F.when(F.col("rec") % 4 == 0, "organ").when(F.col("rec") % 4 == 1, "lesion").when(F.col("rec") % 4 == 2, "cyst").otherwise("other")
    d = d.withColumn("m", m).withColumn("category", category)
    d = d.select("rec", an.valid_slices(F.col("m")).alias("valid"), an.missing_slices(F.col("m")).alias("missing"), "category", an.key_or_middle(area, _ten(lambda i: i * 2)).alias("key_z"))
    d = d.filter(an.in_categories(F.col("category")) & (F.size("valid") >= builders.LEAST_SLICES))
    show = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return d.select("rec", show("valid").alias("valid"), show("missing").alias("missing"), F.col("key_z").cast("bigint").alias("key_z"), an.in_categories(F.col("category"), organs=False).alias("no_organ"))


def tool_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of each tool in each form's signatures."""
    rows = [(form, registry.tools_json(form)) for form in registry.FORMS]
    d = spark.createDataFrame(rows, "form string, tools string")
    call = F.from_json("tools", "array<struct<function: struct<name: string, parameters: struct<required: array<string>>>>>")
    d = d.select("form", F.explode(call).alias("t"))
    return d.select("form", F.col("t.function.name").alias("name"), F.array_join("t.function.parameters.required", ",").alias("required"))


_OD = f"""WITH {plain(ANNOS)}, cs AS (SELECT o_orderkey AS rec, vid, lower(caption) || ' kidney' AS caption, (o_custkey % 40)::INT AS a FROM an), oe AS (SELECT *, unnest(range(10)) AS i FROM cs),
od AS (SELECT *, a + 3 * i AS z, (rec * 7 + i * 13) % 5 * 100 AS area, ((rec + i * 3) % 50 + 50) / 100.0::DOUBLE AS iou, (rec * 3 + i * 7) % 10 / 10.0::DOUBLE AS dice FROM oe),
g AS (SELECT rec, vid, caption, a, list(z ORDER BY i) AS zs, count(*) FILTER (area > 0) AS nb, count(*) FILTER (area > 0 AND iou < 0.75) AS na, count(*) FILTER (area > 0 AND dice < 0.7) AS np,
  list(z ORDER BY i) FILTER (area > 0 AND iou < 0.75) AS za, list(z ORDER BY i) FILTER (area > 0 AND dice < 0.7) AS zp, max(z) FILTER (area > 0) AS zb,
  string_agg('  Z=' || z || CASE WHEN iou < 0.75 THEN ': FAIL (IoU=' || format('{{:.2f}}', iou) || ' < 0.75) — re-annotating.' ELSE ': PASS (IoU=' || format('{{:.2f}}', iou) || ')' END, chr(10) ORDER BY i) FILTER (area > 0) AS review
  FROM od GROUP BY ALL),
t AS (SELECT *, CASE rec % 4 WHEN 0 THEN 'annotate the organ structure' WHEN 1 THEN 'annotate all lesion regions' WHEN 2 THEN 'annotate all cyst regions' ELSE 'annotate the target structure' END AS task,
  chr(10) || array_to_string(list_transform(zs, lambda z: 'Z=' || z || ': <image>'), chr(10)) AS lines FROM g)"""
_SQL_TEXT = lambda t, **c: "'" + re.sub(r"\{(\w+)\}", lambda m: f"' || {c[m[1]]} || '", t.replace("'", "''")) + "'"
_LIST = lambda c: f"'[' || array_to_string({c}, ', ') || ']'"
_PNG = lambda z, s: f"'/data/renders/' || vid || '_z' || lpad({z}::VARCHAR, 3, '0') || '_{s}.png'"

_REPLAY_SQL = f"""WITH RECURSIVE {plain(CALLS)}, c AS (SELECT rec, pos, CASE WHEN name = 'malformed' AND z % 2 = 0 THEN 'run_medsam2' ELSE name END AS name, z, delta FROM calls),
r AS (SELECT DISTINCT rec, 0::BIGINT AS pos, '' AS name, 0 AS z, 0 AS delta, NULL::INT AS prev, NULL::INT AS ptr, false AS clamped, false AS ok, 0 AS seen FROM c
  UNION ALL SELECT c.rec, c.pos, c.name, c.z, c.delta, r.ptr, CASE WHEN c.name = 'get_slice' THEN c.z WHEN c.name = 'scroll' AND r.ptr IS NOT NULL AND c.delta <> 0 THEN least(9, greatest(0, r.ptr + c.delta)) ELSE r.ptr END,
    coalesce(c.name = 'scroll' AND c.delta <> 0 AND (r.ptr + c.delta < 0 OR r.ptr + c.delta > 9), false),
    CASE WHEN c.name = 'scroll' THEN r.ptr IS NOT NULL AND c.delta <> 0 WHEN c.name IN ('add_bbox', 'add_point') THEN coalesce(r.ptr = c.z, false) ELSE c.name <> 'malformed' END,
    r.seen + CASE WHEN c.name = 'get_slice' OR (c.name = 'scroll' AND r.ptr IS NOT NULL AND c.delta <> 0) THEN 1 ELSE 0 END FROM r JOIN c ON c.rec = r.rec AND c.pos = r.pos + 1),
s AS (SELECT *, CASE WHEN ok AND name = 'add_bbox' THEN CASE WHEN z % 2 = 0 THEN round_even(1200 / (1200 + 40 * (z % 3))::DOUBLE, 3) ELSE 0 END END AS iou FROM r WHERE pos > 0)"""

SQL = {
    "box_trajectories": f"""{_OD} SELECT rec, (1 + 1 + 2 * nb + CASE WHEN na > 0 THEN 1 + 2 * na ELSE 0 END + 2)::BIGINT AS n_messages, (10 + nb + na)::BIGINT AS n_images, {_SQL_TEXT(wording.BOX_PROMPT, caption='caption', task='task')} || lines AS opening,
      CASE WHEN na > 0 THEN {_SQL_TEXT(wording.BOXES_CORRECTED, zs=_LIST('za'), n='nb')} ELSE 'Review complete. Checking bbox quality:' || chr(10) || review || {_SQL_TEXT(wording.BOXES_DONE, n='nb')} END AS closing,
      CASE WHEN na > 0 THEN {_PNG('za[-1]', 'corr')} ELSE {_PNG('zb', 'init')} END AS last_image, 4::BIGINT AS roles, 'ok' AS reason FROM t WHERE nb > 0""",
    "mask_trajectories": f"""{_OD} SELECT rec, (2 + 2 * nb + CASE WHEN na > 0 THEN 1 + 2 * na ELSE 0 END + 4 + 2 * np + 2)::BIGINT AS n_messages, (20 + nb + na + np)::BIGINT AS n_images, {_SQL_TEXT(wording.MASK_PROMPT, caption='caption', task='task')} || lines AS opening,
      CASE WHEN np > 0 THEN {_SQL_TEXT(wording.POINTS_DONE, zs=_LIST('zp'), better='np', n='np')} ELSE {_SQL_TEXT(wording.NO_POINTS, n='10')} END AS closing,
      CASE WHEN np > 0 THEN {_PNG('zp[-1]', 'mask_corr')} ELSE {_PNG('zs[-1]', 'mask_init')} END AS last_image, 4::BIGINT AS roles, 'ok' AS reason FROM t WHERE nb > 0""",
    "navigation_trajectories": f"""{_OD} SELECT rec, (1 + 6 + 2 * 25 + 2 * nb + 2 + 2 * np + 1)::BIGINT AS n_messages, (25 + 10 + nb + np)::BIGINT AS n_images,
      {_SQL_TEXT(wording.NAVIGATION_PROMPT, caption='caption', task='task', sampled=_LIST('zs'), first='a', last='(a + 27)')} AS opening,
      CASE WHEN np > 0 THEN {_SQL_TEXT(wording.SWEEP_REFINED, n='np', zs=_LIST('zp'), better='np')} ELSE {_SQL_TEXT(wording.SWEEP_PASSED)} END AS closing,
      CASE WHEN np > 0 AND zp[-1] = zs[-1] THEN {_PNG('zs[-1]', 'refined')} ELSE {_PNG('zs[-1]', 'mask')} END AS last_image, 4::BIGINT AS roles, 'ok' AS reason FROM t WHERE nb > 0""",
    "broken_entries": f"""{_OD}, k AS (SELECT rec % 7 AS kind FROM t WHERE nb > 0) SELECT kind, CASE kind WHEN 0 THEN 'ok' WHEN 1 THEN 'finish is not last' WHEN 2 THEN 'unknown tool' WHEN 3 THEN 'scroll by 0'
      WHEN 4 THEN 'tool call is not JSON' WHEN 5 THEN 'not one run_medsam2' ELSE 'responses missing' END AS reason, count(*) AS n FROM k GROUP BY ALL""",
    "executor_steps": f"""{_REPLAY_SQL} SELECT rec, pos, name, coalesce(ptr, -1) AS ptr, ok, clamped, CASE WHEN ok AND name IN ('get_slice', 'scroll', 'add_bbox', 'add_point') THEN 1 WHEN name = 'run_medsam2' THEN 7 ELSE 0 END AS images,
      CASE WHEN ok THEN '' WHEN name = 'scroll' AND prev IS NULL THEN 'pointer not initialized — call get_slice first' WHEN name = 'scroll' THEN 'scroll delta must not be 0'
        WHEN name IN ('add_bbox', 'add_point') THEN 'must view slice Z=' || (z + 3) || ' before ' || name || ' (current Z=' || coalesce((prev + 3)::VARCHAR, 'None') || ')' ELSE 'unknown tool: malformed' END AS error,
      CASE WHEN ok AND name IN ('get_slice', 'scroll') THEN seen ELSE -1 END AS visited, iou, CASE WHEN ok AND name = 'add_point' THEN z / 10.0::DOUBLE END AS dice FROM s""",
    "executor_telemetry": f"""{_REPLAY_SQL} SELECT rec, count(*) AS num_turns, count(DISTINCT CASE WHEN ok AND name = 'add_bbox' THEN ptr END) AS n_add_bbox, count(*) FILTER (name = 'add_point') AS n_add_point,
      count(*) FILTER (name = 'run_medsam2') AS n_run_medsam2, count(*) FILTER (name = 'finish') AS n_finish, count(*) FILTER (clamped) AS boundary_clamp_count, round(coalesce(avg(iou), 0), 6)::DOUBLE AS r_bbox_iou FROM s GROUP BY rec""",
    "annotation_executor": f"""WITH {plain(CALLS)}, c AS (SELECT CASE WHEN name = 'malformed' AND z % 2 = 0 THEN 'run_medsam2' ELSE name END AS name, z FROM calls)
      SELECT name, count(*) AS n, sum(CASE WHEN name IN ('add_bbox', 'add_point') THEN 1 WHEN name = 'run_medsam2' THEN 10 ELSE 0 END)::BIGINT AS images,
        round(sum(CASE WHEN name = 'add_bbox' AND z % 2 = 0 THEN round_even(1200 / (1200 + 40 * (z % 3))::DOUBLE, 3) WHEN name = 'add_bbox' THEN 0 WHEN name = 'run_medsam2' THEN 0.2 WHEN name = 'add_point' THEN CASE WHEN z % 2 = 0 THEN z / 10.0 ELSE 0 END END::DOUBLE), 4) AS total,
        count(*) FILTER (name = 'scroll') AS errors FROM c WHERE name IN ('add_bbox', 'run_medsam2', 'add_point', 'finish', 'scroll') GROUP BY name""",
    "abort_rows": "SELECT DISTINCT user_id AS rec, 0.0::DOUBLE AS r_dice, 0 AS gate, 'timeout' AS violations, 0::BIGINT AS num_turns, false AS finished FROM events WHERE user_id % 3 = 0",
    "mask_rewards": f"""WITH {plain(LR)}, a AS (SELECT rec, g AS z, x1, y1, x2, y2 FROM gt), b AS (SELECT rec, p AS z, x1, y1, x2, y2 FROM pc),
      q AS (SELECT rec, z, coalesce((a.x2 - a.x1 + 1) * (a.y2 - a.y1 + 1), 0) AS ga, coalesce((b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1), 0) AS pa,
        CASE WHEN a.x1 IS NULL OR b.x1 IS NULL THEN 0 ELSE greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1) END AS sh FROM a FULL JOIN b USING (rec, z)),
      s AS (SELECT rec, z, ga, 2 * sh / (ga + pa)::DOUBLE AS dice FROM q), e AS (SELECT DISTINCT rec FROM bx),
      m AS (SELECT rec, sum(dice * CASE WHEN z = 1 THEN 2 ELSE 1 END) / sum(CASE WHEN z = 1 THEN 2 ELSE 1 END) AS d FROM s WHERE z BETWEEN 1 AND 6 GROUP BY rec), k AS (SELECT rec, dice FROM s WHERE z = CASE WHEN rec % 5 = 0 THEN 9 ELSE 2 END AND ga > 0)
      SELECT rec, round(coalesce(d, 0), 6)::DOUBLE AS r_dice, round(coalesce(dice, 0), 6)::DOUBLE AS r_key_dice FROM e LEFT JOIN m USING (rec) LEFT JOIN k USING (rec)""",
    "named_rewards": """WITH q AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 10 / 10.0 END::DOUBLE AS d, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_orderkey % 4 END::DOUBLE AS gate FROM orders),
      c AS (SELECT *, CASE WHEN gate > 0 THEN 0.7::DOUBLE * d + 0.3::DOUBLE * (id % 4 / 4.0::DOUBLE) + 0.2::DOUBLE * (id % 3 / 3.0::DOUBLE) + 0.15::DOUBLE * (id % 2 / 4.0::DOUBLE) + 0.05 + 0.005 - 0.05 ELSE 0 END AS r FROM q)
      SELECT id, round(r, 6)::DOUBLE AS phase3_combined, round(d, 6) AS phase3_dice, gate AS phase3_format_gate, round(r + 0.5 * d + 0.25 * gate, 6)::DOUBLE AS reward, id % 9 = 0 AS unreported FROM c""",
    "grounding_images": """WITH v AS (SELECT DISTINCT o_custkey AS c FROM orders), b AS (SELECT o_custkey AS c, (o_orderkey % 12)::INT AS place, o_orderkey AS k, o_orderpriority AS caption, 1 + o_orderkey % 2 AS parts FROM orders WHERE o_custkey % 4 <> 3),
      p AS (SELECT c, list_sort(list(DISTINCT place)) AS ps FROM b GROUP BY c), h AS (SELECT c, CASE WHEN len(ps) > 3 THEN [ps[1], ps[round_even((len(ps) - 1) / 2.0, 0)::INT + 1], ps[-1]] ELSE ps END AS ps FROM p),
      f AS (SELECT v.c, unnest(range(12))::INT AS place, ps FROM v LEFT JOIN h USING (c)), w AS (SELECT c, place, ps IS NOT NULL AND list_contains(ps, place) AS pos FROM f WHERE ps IS NOT NULL OR place = 6),
      g AS (SELECT c, place, count(DISTINCT caption) AS nr, sum(parts)::BIGINT AS nb FROM b GROUP BY ALL)
      SELECT 'v' || w.c AS vid, CASE WHEN w.c % 10 = 0 THEN 'val' ELSE 'train' END AS split, w.place, '<image>This image is slice ' || (w.place + 1) || ' out of 12 from an MRI volume. Identify and localize ' ||
        CASE WHEN pos THEN array_to_string(list_transform(range(nr), lambda i: '<ref-object>'), ' and ') ELSE 'pathological' END || ' regions in this slice.' AS asked, CASE WHEN pos THEN repeat('<bbox>', nb) ELSE 'No match for the target.' END AS answer,
        '/data/JPEGImages/v' || w.c || '/' || lpad(w.place::VARCHAR, 5, '0') || '.jpg' AS image, CASE WHEN pos THEN nr ELSE 0 END AS n_ref, CASE WHEN pos THEN nb ELSE 0 END AS n_bbox FROM w LEFT JOIN g ON w.c = g.c AND w.place = g.place""",
    "grounding_middle": """WITH v AS (SELECT DISTINCT o_custkey AS c FROM orders), b AS (SELECT DISTINCT o_custkey AS c, o_orderkey % 12 AS place FROM orders WHERE o_custkey % 4 <> 3), u AS (SELECT c, place, true AS positive FROM b UNION ALL SELECT c, 6, false FROM v WHERE c % 4 = 3)
      SELECT CASE WHEN c % 10 = 0 THEN 'val' ELSE 'train' END AS split, positive, count(*) AS n, sum(place)::BIGINT AS places FROM u GROUP BY ALL""",
    "grounding_videos": """SELECT 'v' || o_custkey AS vid, o_orderkey::VARCHAR AS eid, CASE WHEN o_custkey % 4 <> 3 THEN 'grounding' ELSE 'negative' END AS channel, '<video>Find the target in ' || CASE WHEN o_custkey % 4 <> 3 THEN 4 ELSE 12 END || ' frames.' AS asked,
      CASE WHEN o_custkey % 4 = 3 THEN 'No match for the target.' ELSE 'Frame ' || list_position(list_sort([(o_orderkey % 12)::INT] || list_transform([0, 5, 10], lambda i: CASE WHEN i >= o_orderkey % 12 THEN i + 1 ELSE i END::INT)), (o_orderkey % 12)::INT) - 1 || ': <bbox>' || CASE WHEN o_orderkey % 2 = 1 THEN ' and <bbox>' ELSE '' END END AS answer,
      CASE WHEN o_custkey % 4 <> 3 THEN 4 ELSE 12 END::BIGINT AS n_frames, CASE WHEN o_custkey % 4 <> 3 THEN 1 + o_orderkey % 2 ELSE 0 END::BIGINT AS n_bbox FROM orders""",
    "exact_split": "WITH n AS (SELECT count(*) AS n FROM orders) SELECT unnest(['train', 'val']) AS split, unnest([floor(n * 0.8::DOUBLE)::BIGINT, n - floor(n * 0.8::DOUBLE)::BIGINT]) AS n FROM n",
    "numbered_by_split": f"WITH {plain(ANNOS)}, q AS (SELECT vid, eid, CASE WHEN o_custkey % 3 = 0 THEN 'val' ELSE 'train' END AS split FROM an) SELECT split, vid, eid, row_number() OVER (PARTITION BY split ORDER BY vid, eid::BIGINT) - 1 AS anno_id FROM q",
    "slice_places": """WITH q AS (SELECT o_orderkey AS rec, list_filter(range(10), lambda i: (o_orderkey + i * 5) % 7 < 3) AS v, list_filter(range(10), lambda i: (o_orderkey + i * 5) % 7 >= 3) AS m,
      list_transform(range(10), lambda i: (o_orderkey * 7 + i * 13) % 5) AS a FROM orders WHERE o_orderkey % 4 <> 3)
      SELECT rec, array_to_string(v, ',') AS valid, array_to_string(m, ',') AS missing, CASE WHEN rec % 11 = 0 THEN 10 ELSE 2 * (list_position(a, list_max(a)) - 1) END::BIGINT AS key_z, rec % 4 <> 0 AS no_organ FROM q WHERE len(v) >= 3""",
    "tool_signatures": """SELECT * FROM (VALUES ('boxes', 'add_bbox', 'z_index,bbox'), ('boxes', 'finish_bbox_annotation', ''), ('masks', 'add_bbox', 'z_index,bbox'), ('masks', 'run_medsam2', 'key_z,bbox'), ('masks', 'add_point', 'z_index,points,labels'),
      ('masks', 'finish_3d_segmentation', ''), ('navigation', 'get_slice', 'z_index'), ('navigation', 'scroll', 'delta'), ('navigation', 'add_bbox', 'z_index,bbox'), ('navigation', 'run_medsam2', 'key_z,bbox'), ('navigation', 'add_point', 'z_index,points,labels'),
      ('navigation', 'finish_3d_segmentation', '')) AS t(form, name, required)""",
}

QUERIES = {name: globals()[name] for name in SQL}
