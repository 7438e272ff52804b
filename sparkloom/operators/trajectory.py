"""Assembly of training records: navigation plans, messages, grounding and RL rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The tour's first scrolls, the jump from which a step is a get_slice, the Dice to pass.
EXPLORE, JUMP, DICE_PASS = (-2, 1, 2, 1), 3, 0.70


def navigation_rows(slices: int = 10) -> list[tuple[int, str, str, int, int | None]]:
    """(seq, phase, op, ordinal, delta) of the navigation that every trajectory makes."""
    rows: list[tuple[str, str, int, int | None]] = []
    at = slices // 2
    rows.append(("A", "get_slice", at, None))
    for d in EXPLORE:
        at += d
        rows.append(("A", "scroll", at, d))
    for o in sorted(range(slices), key=lambda i: abs(i - slices // 2)):
        if o != at:
            far = abs(o - at) >= JUMP
            rows.append(("B", "get_slice" if far else "scroll", o, None if far else o - at))
            at = o
        rows.append(("B", "visit", o, None))
    rows.append(("C", "get_slice", 0, None))
    rows.append(("C", "visit", 0, None))
    for o in range(1, slices):
        rows.append(("C", "scroll", o, 1))
        rows.append(("C", "visit", o, None))
    return [(i * 10, *r) for i, r in enumerate(rows)]


def navigation_plans(cases: DataFrame, slices: int = 10) -> DataFrame:
    """(rec, seq, phase, op, ordinal, z, delta) of each case's trajectory.

    cases: rec, sampled (array of slices), areas and dices (arrays by
    ordinal).  The constant tour meets the cases; visits become annotations
    where the slice shows the target, or points where its mask is poor.
    """
    plan = cases.sparkSession.createDataFrame(navigation_rows(slices), "seq int, phase string, op string, ordinal int, delta int")
    d = cases.crossJoin(F.broadcast(plan))  # the tour has a fixed number of rows
    at = lambda a: F.get(F.col(a), F.col("ordinal"))
    visit = F.when((F.col("phase") == "B") & (at("areas") > 0), "add_bbox").when((F.col("phase") == "C") & (F.coalesce(at("dices"), F.lit(1.0)) < DICE_PASS), "add_point")
    d = d.withColumn("op", F.when(F.col("op") == "visit", visit).otherwise(F.col("op"))).filter("op is not null")
    nav = d.select("rec", "seq", "phase", "op", "ordinal", at("sampled").alias("z"), "delta")
    first_c = min(r[0] for r in navigation_rows(slices) if r[1] == "C")
    key = -F.array_max(F.transform("areas", lambda a, i: F.struct(a.alias("a"), (-i).alias("i"))))["i"]
    run = cases.select("rec", F.lit(first_c - 5).alias("seq"), F.lit("B").alias("phase"), F.lit("run_medsam2").alias("op"), key.alias("ordinal"), F.get("sampled", key).alias("z"), F.lit(None).cast("int").alias("delta"))
    last = max(r[0] for r in navigation_rows(slices)) + 5
    end = cases.select("rec", F.lit(last).alias("seq"), F.lit("C").alias("phase"), F.lit("finish").alias("op"), F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("int").alias("z"), F.lit(None).cast("int").alias("delta"))
    return nav.unionByName(run).unionByName(end)


def call_json(op: Column, z: Column, delta: Column) -> Column:
    """A tool call as it stands in a message."""
    args = F.when(op == "scroll", F.concat(F.lit('{"delta": '), delta.cast("string"), F.lit("}"))).when(op.isin("get_slice", "add_bbox", "add_point"), F.concat(F.lit('{"z_index": '), z.cast("string"), F.lit("}")))
    args = F.when(op == "run_medsam2", F.concat(F.lit('{"key_z": '), z.cast("string"), F.lit("}"))).otherwise(F.coalesce(args, F.lit("{}")))
    return F.concat(F.lit('{"name": "'), op, F.lit('", "arguments": '), args, F.lit("}"))


def plan_messages(plans: DataFrame) -> DataFrame:
    """(rec, n_messages, content): the calls of a trajectory as one array of messages, joined for inspection."""
    m = plans.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("seq", call_json(F.col("op"), F.col("z"), F.col("delta")).alias("content")))).alias("m"))
    return m.select("rec", F.size("m").cast("bigint").alias("n_messages"), F.array_join(F.transform("m", lambda x: x["content"]), "\n").alias("content"))


def merge_turns(messages: DataFrame, form: str = "tags", tools: Column | None = None) -> DataFrame:
    """(rec, turn, role, content): neighbouring assistant and tool_call messages as one assistant turn.

    form tags: calls stand in <tool_call> tags, a tool_response is a user turn
    in <tool_response> tags; form react: a call is an Action and its Action
    Input, a response an Observation.  tools: a text that opens each record as
    a system turn 0.  messages: rec, pos, role, content.
    """
    own = F.when(F.col("role") == "tool_call", "assistant").when(F.col("role") == "tool_response", "user").otherwise(F.col("role"))
    if form == "react":
        call = F.concat(F.lit("Action: "), F.get_json_object("content", "$.name"), F.lit("\nAction Input: "), F.coalesce(F.get_json_object("content", "$.arguments"), F.lit("{}")))
        answer = F.concat(F.lit("Observation: "), F.col("content"))
    else:
        tag = lambda t: F.concat(F.lit(f"<{t}>\n"), F.col("content"), F.lit(f"\n</{t}>"))
        call, answer = tag("tool_call"), tag("tool_response")
    text = F.when(F.col("role") == "tool_call", call).when(F.col("role") == "tool_response", answer).otherwise(F.col("content"))
    at = W.partitionBy("rec").orderBy("pos")
    d = messages.select("rec", "pos", own.alias("role"), text.alias("content"))
    d = d.withColumn("new", F.coalesce((F.lag("role").over(at) != F.col("role")).cast("int"), F.lit(1)))
    d = d.withColumn("turn", F.sum("new").over(at))
    g = d.groupBy("rec", "turn").agg(F.first("role").alias("role"), F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("c"))
    out = g.select("rec", "turn", "role", F.array_join(F.transform("c", lambda x: x["content"]), "\n").alias("content"))
    if tools is None:
        return out
    opening = messages.select("rec").distinct().select("rec", F.lit(0).cast("bigint").alias("turn"), F.lit("system").alias("role"), tools.alias("content"))
    return opening.unionByName(out)


def media_tokens(t: Column, h: Column, w: Column, merge: int = 2) -> Column:
    """Tokens of an image or a video of a grid t x h x w, merged in squares."""
    return F.floor(t * h * w / (merge * merge)).cast("int")


def audio_tokens(frames: Column) -> Column:
    """Tokens of a sound: its frames halved twice, rounded as convolutions of stride two do."""
    half = F.floor((frames - 1) / 2) + 1
    return (F.floor((half - 2) / 2) + 1).cast("int")


def expand_aligned(ids: Column, labels: Column, weights: Column, media: int, sizes: Column) -> Column:
    """(ids, labels, weights) with the k-th media id repeated sizes[k] times, and what belongs to it as often."""
    rows = F.transform(ids, lambda x, i: F.struct(x.alias("id"), F.get(labels, i).alias("label"), F.get(weights, i).alias("weight"), F.size(F.filter(F.slice(ids, 1, i), lambda y: y == media)).alias("k")))
    times = lambda r: F.when(r["id"] == media, F.coalesce(F.get(sizes, r["k"]), F.lit(1))).otherwise(F.lit(1))
    return F.flatten(F.transform(rows, lambda r: F.array_repeat(F.struct(r["id"].alias("id"), r["label"].alias("label"), r["weight"].alias("weight")), times(r))))


def expand_placeholders(ids: Column, media: int, sizes: Column) -> Column:
    """Token ids with the k-th media id repeated sizes[k] times."""
    begin = F.struct(F.lit(0).alias("k"), F.array().cast("array<int>").alias("out"))
    step = lambda s, x: F.struct(
        (s["k"] + (x == media).cast("int")).alias("k"),
        F.concat(s["out"], F.array_repeat(x, F.when(x == media, F.coalesce(F.get(sizes, s["k"]), F.lit(1))).otherwise(F.lit(1)))).alias("out"),
    )
    return F.aggregate(ids, begin, step)["out"]
