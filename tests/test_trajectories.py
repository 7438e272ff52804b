"""Whole records against plain Python versions; replay, rewards and rows by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text, wording
from sparkloom.operators import agent, builders, grounding, losses, masks, matching, records, registry, replay, rewards, trajectory
from sparkloom.sources import readers
from sparkloom.streaming import executor

SCHEMA = (
    "rec int, vid string, caption string, category string, root string, renders string, first int, last int, n_slices int, "
    "o array<struct<z:int,frame:string,area:int,box:array<int>,again:array<int>,iou:double,iou_again:double,dice:double,fixed:double,points:array<array<int>>,labels:array<int>>>"
)


def case(rec=1, **changes):
    """Ten slices from 40 on, three apart; the first shows nothing, the fourth has a poor box and a poor mask."""
    rows = []
    for i in range(10):
        z = 40 + 3 * i
        if i == 0:
            rows.append((z, f"{z:05d}", 0, None, None, None, None, None, None, None, None))
            continue
        bad = i == 3
        rows.append((z, f"{z:05d}", 1000 - 50 * abs(i - 6), [10, 20, 50 + i, 60], [11, 20, 50, 61] if bad else None, 0.5625 if bad else 0.9, 0.93751 if bad else None, 0.6 if bad else 0.875, 0.951 if bad else None, [[30, 40], [5, 6]], [1, 0]))
    base = {"rec": rec, "vid": "v1", "caption": "kidney tumor", "category": "lesion", "root": "/d", "renders": "/r", "first": 40, "last": 67, "n_slices": 28, "o": rows}
    base.update(changes)
    return tuple(base.values())


@pytest.fixture(scope="module")
def cases(spark):
    good = case(2, o=[r if r[0] != 49 else (49, "00049", 850, [10, 20, 53, 60], None, 0.9, None, 0.9, None, [[1, 2]], [1]) for r in case()[-1]])
    return spark.createDataFrame([case(), good, case(3, n_slices=2), case(4, o=[(*r[:2], 0, *[None] * 8) for r in case()[-1]])], SCHEMA)


def told(row, role):
    return [m["content"] for m in row["messages"] if m["role"] == role]


def call(name, **arguments):
    return json.dumps({"name": name, "arguments": arguments})


def test_box_records(cases):
    got = {r["rec"]: r for r in records.validate_entries(builders.box_records(cases), "boxes").collect()}
    assert set(got) == {1, 2} and {r["reason"] for r in got.values()} == {"ok"}
    r, o = got[1], [dict(zip(("z", "frame", "area", "box", "again", "iou"), x, strict=False)) for x in case()[-1]]
    shown = [x for x in o if x["box"]]
    assert told(r, "tool_call") == [call("add_bbox", z_index=x["z"], bbox=x["box"]) for x in shown] + [call("add_bbox", z_index=49, bbox=[11, 20, 50, 61]), call("finish_bbox_annotation")]
    assert told(r, "tool_response") == [json.dumps({"z_index": x["z"], "bbox_image": "<image>", "iou_with_gt": round(x["iou"], 3)}) for x in shown] + [json.dumps({"z_index": 49, "bbox_image": "<image>", "iou_with_gt": 0.938})]
    said = told(r, "assistant")
    assert "Z=58 has the largest cross-section (key slice)" in said[0] and "Target visible at Z=43~67 (9 of 10" in said[0] and "Z=[40] — target not visible on these slices" in said[0]
    assert "  Z=49: FAIL (IoU=0.56 < 0.75) — re-annotating." in said[1] and said[1].endswith("\n\nCorrecting 1 slice(s): Z=[49].")
    assert said[2] == "Corrections applied to Z=[49]. All 9 lesion slices now annotated and verified. Finalising annotation."
    assert r["images"][0] == "/d/v1/00040.jpg" and r["images"][10] == "/r/v1_z043_init.png" and r["images"][-1] == "/r/v1_z049_corr.png"
    assert told(r, "user")[0].endswith("\n\n" + "\n".join(f"Z={x['z']}: <image>" for x in o)) and '"kidney tumor"' in told(r, "user")[0]
    assert told(got[2], "assistant")[-1].endswith("\n\nAll 9 lesion slices annotated and verified. Finalising annotation.") and len(told(got[2], "assistant")) == 2


def test_mask_records(cases):
    got = {r["rec"]: r for r in records.validate_entries(builders.mask_records(cases), "masks").collect()}
    r = got[1]
    assert {x["reason"] for x in got.values()} == {"ok"}
    run = json.loads(told(r, "tool_response")[10])
    assert run["status"] == "propagation_complete" and run["key_z"] == 58 and [s["dice_with_gt"] for s in run["slices"]] == [-1.0, 0.875, 0.875, 0.6, *[0.875] * 6]
    said = told(r, "assistant")
    assert said[2] == "Corrections applied. All 9 lesion slices verified.\n\nBbox annotation complete. Initiating 3D segmentation seeded from key slice Z=58 (largest cross-section, bbox [10, 20, 56, 60])."
    assert said[3].split("\n")[:5] == ["MedSAM2 segmentation review:", "  Z=40: no GT (skip)", "  Z=43: PASS (Dice=0.88)", "  Z=46: PASS (Dice=0.88)", "  Z=49: FAIL (Dice=0.60 < 0.7) — adding correction points."]
    assert said[4] == "Point corrections applied to Z=[49]. 1/1 slices improved. 3D segmentation complete. Finalising."
    assert told(r, "tool_call")[-2] == call("add_point", z_index=49, points=[[30, 40], [5, 6]], labels=[1, 0])
    assert told(got[2], "assistant")[-1] == "All 10 sampled slices meet the Dice ≥ 0.7 threshold. 3D segmentation complete. Finalising."


def plain_navigation(o):
    """Calls and answers of the tour, step by step."""
    out, visited, done, at = [], [], set(), None

    def look(i, masked):
        visited.append(i)
        x = o[i]
        has = bool(x[3]) and (masked or i in done)
        overlays = {"has_bbox": has, "has_mask": masked, "has_refined_mask": False}
        if has:
            overlays["bbox"] = x[3]
        if masked:
            overlays["mask_dice"] = x[7] if x[7] is not None else 0.0
        out.append(("tool_response", json.dumps({
            "z_index": x[0], "ordinal": i, "slice_image": "<image>", "sampled_z_list": [y[0] for y in o], "overlays": overlays, "boundary": {"at_start": i == 0, "at_end": i == 9, "clamped": False},
            "history": {"visited_ordinals": list(visited), "annotated_ordinals": sorted(done), "unvisited_ordinals": [k for k in range(10) if k not in visited]},
        })))

    def move(i, jump, masked=False):
        nonlocal at
        out.append(("tool_call", call("get_slice", z_index=o[i][0]) if jump else call("scroll", delta=i - at)))
        at = i
        look(i, masked)

    move(5, True)
    for i in (3, 4, 6, 7):
        move(i, False)
    for i in (5, 4, 6, 3, 7, 2, 8, 1, 9, 0):
        if i != at:
            move(i, abs(i - at) >= 3)
        if o[i][2] > 0:
            out.append(("tool_call", call("add_bbox", z_index=o[i][0], bbox=o[i][3])))
            out.append(("tool_response", json.dumps({"z_index": o[i][0], "bbox_image": "<image>", "iou_with_gt": round(o[i][5], 3)})))
            done.add(i)
    key = max(range(10), key=lambda i: (o[i][2], -i))
    out.append(("tool_call", call("run_medsam2", key_z=o[key][0], bbox=o[key][3])))
    out.append(("tool_response", json.dumps({"status": "propagation_complete", "key_z": o[key][0], "slices": [{"z_index": x[0], "ordinal": i, "mask_image": "<image>", "dice_with_gt": -1.0 if x[7] is None else x[7]} for i, x in enumerate(o)]})))
    for i in range(10):
        move(i, i == 0, True)
        if o[i][7] is not None and o[i][7] < 0.7:
            out.append(("tool_call", call("add_point", z_index=o[i][0], points=o[i][9], labels=o[i][10])))
            out.append(("tool_response", json.dumps({"z_index": o[i][0], "mask_image": "<image>", "dice_with_gt": round(o[i][8], 3)})))
    return [*out, ("tool_call", call("finish_3d_segmentation"))]


def test_navigation_records(cases):
    got = {r["rec"]: r for r in records.validate_entries(builders.navigation_records(cases), "navigation").collect()}
    assert {x["reason"] for x in got.values()} == {"ok"} and set(got) == {1, 2}
    r, o = got[1], case()[-1]
    assert [(m["role"], m["content"]) for m in r["messages"] if m["role"].startswith("tool")] == plain_navigation(o)
    said = told(r, "assistant")
    assert len(said) == 6 and said[1].split("\n")[1] == "  ord 3 (Z=49): area=850 px² (lesion)" and "Tentative key slice: Z=58 (ord 6)" in said[1]
    assert said[3].startswith("Phase B complete. Annotated 9/10") and said[5] == "Sweep complete. Refined 1 slice(s) via add_point (Z=[49]); 1 improved above threshold. Segmentation finalised."
    assert told(got[2], "assistant")[5] == wording.SWEEP_PASSED
    assert told(r, "user")[0].endswith("ordinal 0 → 9): [40, 43, 46, 49, 52, 55, 58, 61, 64, 67]\nLesion Z range in the full volume: Z=40~67.")
    images = r["images"]
    assert images[:6] == [f"/r/v1_z{z:03d}_raw.png" for z in (55, 49, 52, 58, 61, 55)] and images.count("/r/v1_z049_refined.png") == 1 and sum(i.endswith("_mask.png") for i in images) == 20
    steps = [(json.loads(c)["name"], json.loads(c)["arguments"]) for c in told(r, "tool_call")]
    assert [n for n, _ in steps].count("scroll") == 16 and [n for n, _ in steps].count("get_slice") == 9


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        (lambda m: m[:-1], "finish is not last"), (lambda m: [x for x in m if x[0] != "tool_call"], "no tool calls"), (lambda m: [("tool_call", "{"), *m], "tool call is not JSON"),
        (lambda m: [("tool_call", '{"name": "zoom", "arguments": {}}'), *m], "unknown tool"), (lambda m: [m[0], ("tool_call", call("scroll", delta=1)), ("tool_response", "{}"), *m[1:]], "first navigation is not get_slice"),
        (lambda m: [(r, c.replace('"bbox": [10, 20, 56, 60]}}', '"bbox": [10, 20, 10, 60]}}')) for r, c in m], "box corners"), (lambda m: [(r, c.replace('"labels": [1, 0]', '"labels": [1]')) for r, c in m], "points and labels"),
        (lambda m: [*m[:2], ("tool_call", call("get_slice", z_index=40)), ("tool_response", "{}"), ("tool_call", call("add_point", z_index=43, points=[[1, 2]], labels=[1])), ("tool_response", "{}"), *m[2:]], "annotation of a slice not viewed"),
        (lambda m: [m[0], *m[2:], ("user", "<image>")], "image count"),
    ],
)
def test_entries_with_one_thing_broken(spark, cases, change, reason):
    row = builders.navigation_records(cases.filter("rec = 1")).first()
    broken = change([(m["role"], m["content"]) for m in row["messages"]])
    marks = sum(c.count("<image>") for _, c in broken) + (reason == "image count")
    d = spark.createDataFrame([(broken, ["i"] * marks)], "messages array<struct<role:string,content:string>>, images array<string>")
    assert records.validate_entries(d, "navigation").first()["reason"] == reason


def test_replay_of_a_built_record(spark, cases):
    """The executor answers a built record's calls as the record does."""
    row = builders.navigation_records(cases.filter("rec = 1")).first()
    o = case()[-1]
    rows = []
    for i, c in enumerate(told(row, "tool_call")):
        name, a = (x := json.loads(c))["name"], x["arguments"]
        rows.append((1, i, name, a.get("z_index", a.get("key_z")), a.get("delta"), a.get("bbox"), 0.951 if name == "add_point" else None))
    calls = spark.createDataFrame(rows, "rec int, pos long, name string, z int, delta int, box array<int>, refined double")
    tight = [None if x[3] is None else tuple(x[3]) for x in o]
    known = spark.createDataFrame([(1, [x[0] for x in o], tight, [0.0 if x[7] is None else x[7] for x in o])], "rec int, sampled array<int>, tight array<struct<x1:int,y1:int,x2:int,y2:int>>, dices array<double>")
    steps = replay.navigate(calls, known).orderBy("pos").collect()
    assert len(steps) == len(rows) and all(s["ok"] for s in steps)
    for s, want in zip(steps, [*told(row, "tool_response"), None], strict=True):
        if want is None:
            assert s["response"] is None
            continue
        a, b = json.loads(s["response"]), json.loads(want)
        if "iou_with_gt" in b:  # boxes are replayed against themselves
            assert a == {**b, "iou_with_gt": 1.0}
        elif "slices" in b:
            assert [x["dice_with_gt"] for x in a["slices"]] == [max(x["dice_with_gt"], 0.0) for x in b["slices"]]
        else:
            assert a == b
    t = replay.telemetry(replay.navigate(calls, known)).first()
    assert (t["n_add_bbox"], t["n_add_point"], t["n_run_medsam2"], t["n_finish"], t["key_z_chosen"], t["r_bbox_iou"]) == (9, 1, 1, 1, 58, 1.0) and t["r_dice_gain"] == pytest.approx(0.3)


def test_replay_errors(spark):
    rows = [("scroll", 0, 1), ("get_slice", 99, 0), ("get_slice", 5, 0), ("scroll", 0, 0), ("add_bbox", 7, 0), ("zoom", 0, 0), ("scroll", 0, 9), ("finish", 0, 0), ("get_slice", 5, 0)]
    calls = spark.createDataFrame([(1, i, n, z, d, [0, 0, 4, 4], None) for i, (n, z, d) in enumerate(rows)], "rec int, pos long, name string, z int, delta int, box array<int>, refined double")
    known = spark.createDataFrame([(1, [3, 5, 7], [None] * 3, [None] * 3)], "rec int, sampled array<int>, tight array<struct<x1:int,y1:int,x2:int,y2:int>>, dices array<double>")
    got = replay.navigate(calls, known).orderBy("pos").collect()
    answers = [json.loads(r["response"]) if r["response"] else None for r in got]
    assert [a.get("error") if a else None for a in answers] == [
        "pointer not initialized — call get_slice first", "z_index not in sampled set", None, "scroll delta must not be 0", "must view slice Z=7 before add_bbox (current Z=5)", "unknown tool: zoom", None, None
    ]
    assert answers[1]["sampled_z_list"] == [3, 5, 7] and answers[6]["boundary"] == {"at_start": False, "at_end": True, "clamped": True} and answers[6]["history"]["visited_ordinals"] == [1, 2]
    assert [r["decision"] for r in got] == [False, False, True, True, False, False, True, False]


def test_traces_with_points(spark):
    rows = [(1, 0, "get_slice", 3), (1, 1, "add_point", 4), (1, 2, "finish", 0), (2, 0, "get_slice", 3), (2, 1, "run_medsam2", 3), (2, 2, "add_point", 4), (2, 3, "finish", 0), (3, 0, "get_slice", 3), (3, 1, "run_medsam2", 3), (3, 2, "run_medsam2", 3), (3, 3, "finish", 0)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "rec int, pos long, name string, z int, delta int")
    assert {r["rec"]: r["reason"] for r in agent.validate_traces(d).collect()} == {1: "annotation of a slice not viewed", 2: "ok", 3: "run_medsam2 more than once"}


def test_coverage_counts_false_slices(spark):
    a = lambda *v: F.array(*map(F.lit, v))
    none = F.array().cast("array<int>")
    got = spark.range(1).select(
        rewards.coverage(a(1, 2, 8, 9), a(1, 2, 3, 4), a(7, 8, 9)).alias("two"), rewards.coverage(a(8), none, a(7, 8, 9)).alias("none"), rewards.coverage(none, a(1), a(9)).alias("nothing")
    ).first()
    assert list(got) == pytest.approx([0.5 - 1.0, 1.0 - 0.5, 0.0])


def test_rewards_with_missing_parts(spark):
    d = spark.createDataFrame([("0.5", None, 1), ("bad", 0.5, 1), ("0.5", 0.5, None)], "r_dice string, r_key_dice double, gate int")
    d = d.select("*", *(F.lit(0.0).alias(c) for c in ("r_bbox_iou", "r_dice_gain", "r_coverage", "r_nav_style", "r_efficiency")))
    assert [r["r"] for r in d.select(rewards.combined(F.col("gate"), F.lit(1.0)).alias("r")).collect()] == pytest.approx([0.35, 0.15, 0.0])
    assert [r["reward"] for r in registry.with_rewards(d, ["phase3_dice", "phase3_key_dice"], [2.0, 1.0]).collect()] == pytest.approx([1.0, 0.5, 1.5])


def test_dice_of_sampled_slices(spark):
    run = lambda rec, z, start, n: (rec, z, start, n)
    truth = spark.createDataFrame([run(1, 3, 0, 4), run(1, 5, 0, 2)], "rec long, z long, start long, length long")
    pred = spark.createDataFrame([run(1, 3, 2, 4), run(1, 9, 0, 2)], truth.schema)
    cases = spark.createDataFrame([(1, [3, 3, 5, 9, 7], 3), (2, [3], None), (1, [7], 9)][:2], "rec long, sampled array<int>, key_z int")
    got = {r["rec"]: (r["r_dice"], r["r_key_dice"]) for r in rewards.dice_rewards(cases, truth, pred).collect()}
    assert got[1] == pytest.approx(((0.5 + 0.5 + 0 + 0) / 4, 0.5)) and got[2] == (0.0, 0.0)


def test_grounding_rows(spark):
    videos = spark.createDataFrame([("a", "train", [f"{i:05d}" for i in range(6)]), ("b", "val", ["00000", "00001", "00002"])], "vid string, split string, frames array<string>")
    boxes = spark.createDataFrame([("a", 1, "cyst", 2, 0, [1, 2, 3, 4]), ("a", 1, "kidney", 1, 0, [0, 0, 9, 9]), ("a", 1, "cyst", 2, 1, [5, 5, 8, 8]), ("a", 4, "kidney", 1, 0, [0, 0, 7, 7])], "vid string, place int, caption string, order int, part int, box array<int>")
    got = {(r["vid"], r["place"]): r for r in grounding.image_rows(grounding.chosen_frames(videos, boxes), boxes, "/j/").collect()}
    assert set(got) == {("a", 1), ("a", 4), ("b", 1)}
    r = got["a", 1]
    assert r["messages"][1]["content"] == "<image>This image is slice 2 out of 6 from an MRI volume. Identify and localize <ref-object> and <ref-object> regions in this slice."
    assert r["messages"][2]["content"] == "<bbox><bbox><bbox>" and r["objects"]["ref"] == ["kidney", "cyst"] and r["objects"]["bbox"] == [[0, 0, 9, 9], [1, 2, 3, 4], [5, 5, 8, 8]] and r["images"] == ["/j/a/00001.jpg"]
    assert got["b", 1]["messages"][2]["content"] == wording.GROUNDING_NONE and got["b", 1]["objects"]["bbox"] == []
    assert grounding.chosen_frames(videos, boxes, negatives=True).filter("vid = 'a'").count() == 6
    many = spark.createDataFrame([("a", i, "k", 1, 0, [0, 0, 1, 1]) for i in range(6)], boxes.schema)
    assert [x["place"] for x in grounding.chosen_frames(videos, many, most=3).filter("vid = 'a'").orderBy("place").collect()] == [0, 2, 5]


def test_mixed_box_lists(spark):
    one = lambda t: spark.range(1).select(text.json_boxes(F.lit(t)).alias("b")).first()["b"]
    assert [tuple(b) for b in one('x [{"bbox_2d": [1, 2, 3, 4], "label": "a"}, [5, 6, 7, 8.5]] y')] == [(1, 2, 3, 4), (5, 6, 7, 8.5)]
    assert one('[{"label": "a"}]') is None and one("[1, 2, 3, 4]") is None and one("no list") is None and one('[[1, 2, 3, "x"]]') is None


def test_numbers_out_of_range(spark):
    row = spark.range(1).select(text.sampled_slices(F.lit("Sampled Z list (2): [1, x, 99999999999]")).alias("a"), text.marked_slices(F.lit("Z=4 Z=99999999999")).alias("b"), text.sampled_slices(F.lit("none")).alias("c")).first()
    assert list(row) == [[1], [4], None]


def test_segments_and_spans(spark):
    row = spark.range(1).select(losses.loss_weights(F.lit("<think>\n</think>a <answer>b</answer> c"), [(r"<think>\s*</think>", 0.0), ("<answer>.*?</answer>", 2.0)]).alias("s")).first()
    assert [(p["text"], p["weight"]) for p in row["s"]] == [("<think>\n</think>", 0.0), ("a ", 1.0), ("<answer>b</answer>", 2.0), (" c", 1.0)]


def test_react_and_tool_turns(spark):
    m = spark.createDataFrame([(1, 0, "user", "go"), (1, 1, "assistant", "I look."), (1, 2, "tool_call", call("scroll", delta=1)), (1, 3, "tool_response", "{}"), (1, 4, "assistant", "done")], "rec int, pos long, role string, content string")
    got = [(r["turn"], r["role"], r["content"]) for r in trajectory.merge_turns(m, form="react", tools=F.lit("tools")).orderBy("turn").collect()]
    assert got == [(0, "system", "tools"), (1, "user", "go"), (2, "assistant", 'I look.\nAction: scroll\nAction Input: {"delta":1}'), (3, "user", "Observation: {}"), (4, "assistant", "done")]


def test_groups_of_embeddings(spark):
    d = spark.createDataFrame([("b", i, x) for i, x in enumerate([0, 1, 0, 0, 0, 0, 1, 0])], "b string, pos int, label int")
    got = [(r["grp"], r["role"], r["place"]) for r in losses.embedding_groups(d, "pos", "label", "b", negatives=2).orderBy("pos").collect()]
    assert got == [(1, "anchor", -2), (1, "positive", -1), (1, "negative", 0), (1, "negative", 1), (2, "anchor", -2), (2, "positive", -1), (2, "negative", 0)]


def test_wrapped_captions(spark):
    row = spark.createDataFrame([("word " * 30,), (None,)], "t string").select(text.wrapped("t").alias("w")).collect()
    assert max(map(len, row[0]["w"].split("\n"))) <= 60 and row[1]["w"] is None


def test_tools_and_losses_by_name(spark):
    tools = json.loads(registry.tools_json("navigation", {"scroll": "Move."}))
    assert [t["function"]["name"] for t in tools] == list(registry.FORMS["navigation"]) and tools[1]["function"]["description"] == "Move."
    assert tools[4]["function"]["parameters"]["properties"]["points"] == {"type": "array", "items": {"type": "array", "items": {"type": "integer"}}}
    d = spark.createDataFrame([(2.0, 1, False, None, None), (4.0, 1, True, 10.0, 60.0), (9.0, -100, True, None, None)], "loss double, label int, in_span boolean, coord double, truth double")
    assert registry.LOSSES["cross_entropy"](d).first()["loss"] == 3.0
    assert registry.LOSSES["mri_bbox"](d).first()["loss"] == pytest.approx((2 + 12) / 4 + 0.05 * 0.5 * 0.05**2 / 0.1)
    args = spark.range(1).select(registry.arguments_of(F.lit(call("add_point", z_index=3, points=[[1, 2]], labels=[1])), "add_point").alias("a")).first()["a"]
    assert args["points"] == [[1, 2]] and args["z_index"] == 3


def test_shared_folder_is_asked_for():
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        executor.shared_folder(Session(), "x")


def test_context_and_rendered_masks(spark):
    assert spark.range(1).select(records.context_bounded(F.lit(100), 200, F.lit(2), 84).alias("x")).first()["x"] is False
    ranked = matching.ranked(spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "k string, v int"), ["k"], ["v"])
    assert {(r["k"], r["v"]): r["rank"] for r in ranked.collect()} == {("a", 1): 1, ("a", 2): 2, ("b", 5): 1}
    assert isinstance(masks.dense(np.array([0]), np.array([2]), 2, 2), np.ndarray) and readers.AXES["axial"] == 2
