"""Hand fixtures and properties of the operators."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import arrays, geometry, text
from sparkloom.operators import agent, annotations, losses, masks, matching, metrics, parts, replay, rewards, trajectory
from sparkloom.sources import readers, volumes, writers


def one(spark, column, **values):
    d = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return d.select(column.alias("x")).first()[0]


def test_slices(spark):
    assert one(spark, arrays.int_linspace(F.lit(40), F.lit(70), 10)) == [40, 43, 46, 50, 53, 56, 60, 63, 66, 70]
    assert one(spark, arrays.int_linspace(F.lit(47), F.lit(55), 10)) == [47, 47, 48, 49, 50, 51, 52, 53, 54, 55]
    assert one(spark, arrays.spiral(10)) == [5, 4, 6, 3, 7, 2, 8, 1, 9, 0]
    assert arrays.upsample(3, 8) == [0, 0, 1, 1, 2, 2, 0, 1]


def test_numbering_is_by_code_point(spark):
    d = spark.createDataFrame([("0000_1_image", "2"), ("0000_1_image", "10"), ("0000_10_image", "0")], "vid string, eid string")
    got = {(r["vid"], r["eid"]): r["anno_id"] for r in annotations.ordered_annotations(d).collect()}
    assert got == {("0000_10_image", "0"): 0, ("0000_1_image", "2"): 1, ("0000_1_image", "10"): 2}


@pytest.mark.parametrize(("caption", "kind"), [("non-malignant cyst", "lesion"), ("renal organ filtering", "organ"), ("fluid pouch", "cyst"), ("bone", "other")])
def test_captions(spark, caption, kind):
    assert one(spark, text.classify_caption(F.lit(caption))) == kind


def test_iou(spark):
    box = lambda *v: tuple(F.lit(x) for x in v)
    assert one(spark, geometry.box_iou(box(0, 0, 10, 10), box(5, 0, 15, 10))) == pytest.approx(1 / 3)
    assert one(spark, geometry.box_iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    assert one(spark, geometry.dice(F.lit(0), F.lit(0), F.lit(0))) == 1 and one(spark, geometry.dice(F.lit(0), F.lit(0), F.lit(5))) == 0


def boxes(mask):
    """Boxes of a mask's connected parts, each pixel being a run."""
    y, x = np.nonzero(mask)
    found = parts.run_parts(np.zeros_like(x), np.zeros_like(x), x, y, np.ones_like(x), len(mask))
    return list(zip(*(found[c].tolist() for c in ("x1", "y1", "x2", "y2")), strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=40), st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=40))
def test_surfaces(a, b):
    m = [np.zeros((10, 10), bool) for _ in range(2)]
    for mask, points in zip(m, (a, b), strict=True):
        for y, x in points:
            mask[y, x] = True
    d = masks.hausdorff_95(*m)
    assert d >= 0 and d == masks.hausdorff_95(m[1], m[0]) and masks.hausdorff_95(m[0], m[0]) == 0
    assert masks.dilate(m[0]).sum() >= m[0].sum() >= masks.erode(m[0]).sum()
    assert 1 <= len(boxes(m[0])) <= m[0].sum()


def test_empty_masks():
    none, some = np.zeros((4, 4), bool), np.eye(4, dtype=bool)
    assert masks.hausdorff_95(none, none) == 0 and masks.hausdorff_95(none, some) == float("inf")
    assert boxes(none) == [] and boxes(some) == [(0, 0, 0, 0), (1, 1, 1, 1), (2, 2, 2, 2), (3, 3, 3, 3)]


def test_average_precision(spark):
    m = spark.createDataFrame([(0.9,), (0.6,)], "iou double")
    assert metrics.average_precision(m, 2, 3, (0.5,)).first()["ap"] == pytest.approx((1 / 2 + 2 / 3) / 2)
    empty = m.limit(0)
    assert metrics.average_precision(empty, 0, 0, (0.5,)).first()["ap"] == 1 and metrics.average_precision(empty, 0, 2, (0.5,)).first()["ap"] == 0


@pytest.mark.parametrize(("value", "plain", "cascade", "error"), [("[1,2,3,4] and [5, 6.5, 7, 8]", 2, 2, None), ("boxes: [1,2,3,4]", 1, 0, "no_bbox_parsed"), ("No match for the target.", 0, 0, None), ('[{"bbox_2d": [1, 2, 3, 4]}]', 1, 1, None)])
def test_box_texts(spark, value, plain, cascade, error):
    boxes = text.cascade_boxes(F.lit(value))
    assert one(spark, F.size(text.plain_boxes(F.lit(value)))) == plain and one(spark, F.size(boxes)) == cascade
    assert one(spark, text.parse_error(F.lit(value), boxes)) == error


def calls(spark, *steps):
    return spark.createDataFrame([(1, i, *s) for i, s in enumerate(steps)], "rec long, pos long, name string, z int, delta int")


def test_pointer(spark):
    got = agent.pointer_steps(calls(spark, ("scroll", 0, 1), ("get_slice", 7, 0), ("scroll", 0, 5), ("scroll", 0, 0), ("get_slice", 12, 0))).orderBy("pos").collect()
    assert [(r["ptr"], r["clamped"], r["ok"]) for r in got] == [(None, False, False), (7, False, True), (9, True, True), (9, False, False), (9, False, False)]


def test_overlay_state_of_looks(spark):
    """A look compares what is drawn now with what its slice's last look showed: a state, not a count."""
    names = ["get_slice", "add_bbox", "get_slice", "add_bbox", "get_slice", "run_medsam2", "get_slice", "add_point", "get_slice", "get_slice", "scroll", "add_bbox", "get_slice", "get_slice"]
    at = [4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 0, 4, 99, 4]
    d = spark.createDataFrame([(1, i, n, z, 0, [1, 2, 3, 4], 0.5) for i, (n, z) in enumerate(zip(names, at, strict=True))], "rec long, pos long, name string, z int, delta int, box array<int>, refined double")
    cases = spark.createDataFrame([(1, [4, 5], [None, None], [0.5, None])], "rec long, sampled array<int>, tight array<struct<x1:int,y1:int,x2:int,y2:int>>, dices array<double>")
    got = replay.states(d, cases).orderBy("pos").collect()
    # a box again is the same state, propagation and points change it; a look that fails has seen the slice in view
    assert [(r["pos"], r["changed"]) for r in got if r["decision"]] == [(0, True), (2, True), (4, False), (6, True), (8, True), (9, False), (10, False), (13, False)]
    assert [r["again"] for r in got if r["decision"]] == [False] + [True] * 7
    assert rewards.navigation_style(replay.states(d, cases).filter("decision")).first()[1] == pytest.approx(0.01 - 0.05 * 3 + 0.01)


def test_gate(spark):
    got = agent.gate_violations(calls(spark, ("scroll", 0, 1), ("get_slice", 3, 0), ("run_medsam2", 3, 0), ("finish", 0, 0))).first()
    assert got["violations"] == ["scroll_before_first_get_slice"]


def test_plan(spark):
    d = spark.createDataFrame([(1, list(range(10)), [1] * 10, [0.9] * 10)], "rec long, sampled array<int>, areas array<int>, dices array<double>")
    plan = trajectory.navigation_plans(d)
    n = {r["op"]: r["n"] for r in plan.groupBy("op").agg(F.count("*").alias("n")).collect()}
    assert n == {"get_slice": 9, "scroll": 16, "add_bbox": 10, "run_medsam2": 1, "finish": 1}
    steps = agent.pointer_steps(plan.select("rec", F.col("seq").cast("long").alias("pos"), F.col("op").alias("name"), "z", "delta"))
    nobody = F.array_repeat(F.lit(None), 10)
    cases = d.select("rec", "sampled", nobody.cast("array<struct<x1:int,y1:int,x2:int,y2:int>>").alias("tight"), nobody.cast("array<double>").alias("dices"))
    moves = replay.states(steps.withColumns({"box": F.lit(None).cast("array<int>"), "refined": F.lit(None).cast("double")}), cases).filter("decision")
    assert rewards.navigation_style(moves).first()["r_nav_style"] == pytest.approx(0.14)
    assert agent.gate_violations(steps).first()["violations"] == []


def test_rewards(spark):
    a = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, rewards.coverage(a(3, 4, 9), a(3, 4, 5), a(9))) == pytest.approx(2 / 3 - 0.5)
    assert one(spark, rewards.efficiency(F.lit(50))) == pytest.approx(-0.05)
    d = spark.range(1).select(*(F.lit(1.0).alias(c) for c in ("r_dice", "r_key_dice", "r_bbox_iou", "r_dice_gain", "r_coverage", "r_nav_style")), F.lit(0.0).alias("r_efficiency"))
    got = d.select(rewards.combined(F.lit(1), F.lit(1.0)), rewards.combined(F.lit(0), F.lit(1.0)), rewards.combined(F.lit(0), F.lit(1.0), soft=True)).first()
    assert list(got) == pytest.approx([1.5, 0, 0.15])
    assert rewards.arithmetic("(1 + 2) * 3") == 9 and rewards.arithmetic("2 ** 9") is None and rewards.arithmetic("1/0") is None


def test_losses(spark):
    assert one(spark, losses.contrastive(F.lit(0.2), F.lit(0))) == pytest.approx(0.045)
    assert one(spark, losses.smooth_l1(F.lit(0.05))) == pytest.approx(0.0125) and one(spark, losses.smooth_l1(F.lit(0.2))) == pytest.approx(0.15)
    d = spark.createDataFrame([("a", i, x) for i, x in enumerate([1, 0, 0, 0, 1, 0, 0])], "k string, pos int, label int")
    assert sorted(r[1] for r in losses.groups_from_labels(d, "k", "pos", "label").groupBy("grp").count().collect()) == [3, 4]


def test_sequential_matching(spark):
    pairs = spark.createDataFrame([(1, 0, 0, 0.6), (1, 1, 0, 0.6), (1, 0, 1, 0.9), (1, 1, 1, 0.0)], "rec long, g long, p long, iou double")
    got = matching.greedy_sequential(pairs, 0.5).orderBy("p").collect()
    assert [(r["g"], r["hit"]) for r in got] == [(0, True), (None, False)]


def test_records(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"images": ["a.png"], "tools": "x"}\n\n{"images": [{"path": "b.png"}]}\nbroken\n')
    d = readers.read_records(spark, str(path), "tools string, images array<string>", numbered=True)
    rows = d.orderBy("line").select("line", readers.image_paths(F.col("images")).alias("i")).collect()
    assert [(r["line"], r["i"]) for r in rows] == [(0, ["a.png"]), (2, ["b.png"]), (3, None)]
    assert readers.read_records(spark, str(path), "tools string", most=2).count() == 1
    assert readers.read_records(spark, str(path), "tools string").count() == 3


def test_metadata_and_volumes(spark, tmp_path):
    meta = {"videos": {"v1": {"expressions": {"0": {"exp": "kidney", "obj_id": "1"}}, "frames": ["00000"], "height": 4, "width": 5}}}
    (tmp_path / "m.json").write_text(json.dumps(meta))
    assert readers.read_expressions(spark, str(tmp_path / "m.json")).first()["caption"] == "kidney"
    np.save(tmp_path / "v.npy", np.arange(24.0).reshape(2, 3, 4))
    v = volumes.read_volumes(spark, str(tmp_path), level=12, width=24, axis="coronal").orderBy("z").collect()
    assert len(v) == 2 and v[0]["pixels"][:2] == [0.0, 10.0] and (v[1]["height"], v[1]["width"]) == (3, 4)


def test_metric_rows(spark):
    d = spark.createDataFrame([("a", 0.12345, float("inf"))], "k string, x double, y double")
    assert tuple(writers.metrics_rows(d).first()) == ("a", "0.1235", "")


def test_chat_forms(spark):
    d = spark.createDataFrame([("do", "this", "done")], "instruction string, input string, output string")
    assert [tuple(m) for m in readers.normalize_chat(d).first()["messages"]] == [("user", "do\nthis"), ("assistant", "done")]


def test_registry(spark):
    r = readers.Registry()
    r.register("n", lambda s: s.range(50))
    assert r.load(spark, "n#7").count() == 7 and r.load(spark, "n").count() == 50
