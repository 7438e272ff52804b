"""Masks meet in the order of their keys: nothing is collected, sorted twice or joined again, and tasks follow the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import masks, rewards, strips
from sparkloom.plans import fixtures, segmentation, trajectories
from sparkloom.sources import readers, writers
from tests.conftest import SF


def rows(d):
    return sorted(map(str, d.collect()))


def plan(d, capsys):
    capsys.readouterr()
    d.explain()
    return capsys.readouterr().out


def table(spark, seed, some):
    """Random masks of some keys, many runs each."""
    r = np.random.default_rng(seed)
    out = [(k, *map(int, run)) for k in some for run in zip(*masks.runs_of(r.random((8, 11)) < 0.4), strict=True)]
    return spark.createDataFrame(out, "k long, start long, length long")


def test_masks_are_not_collected(spark, capsys):
    a, b = table(spark, 1, range(5)), table(spark, 2, range(3, 9))
    calls = [lambda f=f: f(a, b, ["k"], height=8) for f in (masks.mask_scores, masks.hausdorff, masks.differences)]
    calls += [lambda: masks.run_counts(a, ["k"], 88, 8), lambda: masks.morph(a, ["k"], 1, True, 11, 8)]
    for call in calls:
        assert "collect_list" not in plan(call(), capsys)
    together = [rows(call()) for call in calls]
    assert [len(x) for x in together[:4]] == [9, 9, 9, 5]
    # masks that lie in several batches
    for size in (1, 3, 50):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert [rows(call()) for call in calls] == together
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_both_sides_in_one_table(spark, capsys):
    a, b = table(spark, 3, range(4)), table(spark, 4, range(2, 7))
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    for f in (masks.mask_scores, masks.hausdorff, masks.differences):
        assert rows(f(both, None, ["k"], height=8)) == rows(f(a, b, ["k"], height=8))
    apart = [fixtures.view(spark, SF, q).withColumn("side", F.lit(k)) for k, q in enumerate((segmentation._TRUE, segmentation._PRED))]
    columns = ["rec", "z", "side", "x1", "y1", "x2", "y2"]
    assert rows(fixtures.view(spark, SF, fixtures.SIDES).select(columns)) == rows(apart[0].unionByName(apart[1]).select(columns))
    for query in (segmentation.mask_dice_slice, segmentation.mask_dice_volume, segmentation.hd95):
        assert plan(query(spark, SF), capsys).count("FileScan") == 1


def test_tasks_follow_the_rows(spark, monkeypatch):
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    for most in (500, 250):
        monkeypatch.setattr(fixtures, "TASK_ROWS", most)
        for query in (segmentation.mask_dice_slice, segmentation.simulated_masks):
            assert query(spark, SF).rdd.getNumPartitions() == -(-n // most)


@pytest.mark.parametrize("query", [segmentation.mask_morphology, segmentation.simulated_masks])
def test_areas_of_changes_from_one_pass(spark, capsys, query):
    told = plan(query(spark, SF), capsys)
    assert "Join" not in told and told.count("MapInArrow") == 1


def test_areas_of_changes_are_those_of_their_masks(spark):
    a = table(spark, 5, range(60))
    changes = {"grown": masks.morphed(2, True), "shrunk": masks.morphed(1, False), "simulated": masks.as_simulated, "corrected": masks.as_corrected}
    got = {r["k"]: r for r in masks.changed_areas(a, ["k"], changes, 11, 8).collect()}
    for name, d in (("grown", masks.morph(a, ["k"], 2, True, 11, 8)), ("shrunk", masks.morph(a, ["k"], 1, False, 11, 8)), ("simulated", masks.simulated(a, ["k"], 11, 8)), ("corrected", masks.corrected(a, ["k"], 11, 8))):
        assert {k: r[name] for k, r in got.items() if r[name]} == {r["k"]: r["area"] for r in masks.mask_areas(d, ["k"]).collect()}
    assert len(got) == 60 and any(r["shrunk"] == 0 for r in got.values())


def test_rewards_without_joins(spark, capsys):
    """Samples repeated, missing and unknown; a key slice without a true mask; cases without masks, masks without a case."""
    assert "Join" not in plan(trajectories.mask_rewards(spark, SF), capsys)
    box = "rec long, z long, start long, length long, columns long"
    truth = spark.createDataFrame([(1, 1, 0, 4, 2), (1, 2, 0, 4, 1), (2, -7, 0, 2, 1), (4, 1, 0, 2, 1), (5, None, 0, 2, 1)], box)
    pred = spark.createDataFrame([(1, 1, 0, 4, 1), (1, 3, 0, 4, 1), (2, -7, 0, 2, 1), (2, 9, 0, 2, 1)], box)
    cases = spark.createDataFrame([(1, [1, 1, 2, 8, None], 1), (2, [-7, 9], 9), (3, [1], 1), (4, None, 1), (5, [1], None), (None, [1], 1)], "rec long, sampled array<long>, key_z long")
    got = {r["rec"]: (r["r_dice"], r["r_key_dice"]) for r in rewards.dice_rewards(cases, truth, pred).collect()}
    assert got == {1: (pytest.approx((2 / 3 + 2 / 3 + 0) / 3), pytest.approx(2 / 3)), 2: (0.5, 0.0), 3: (0.0, 0.0), 4: (0.0, 0.0), 5: (0.0, 0.0)}


def test_masks_are_read_as_strips(spark, tmp_path, capsys):
    """A box is one row when it is read again; masks of unlike heights come from one scan."""
    boxes = lambda h: masks.box_strips(spark.createDataFrame([(h, z, 2, z, 5, z + 3) for z in range(4)], "anno_id long, z long, x1 long, y1 long, x2 long, y2 long"), ["anno_id", "z"], h)
    for h in (8, 9):
        writers.write_masks(boxes(h), str(tmp_path / f"height={h}"), h, 11)
    d = readers.read_masks(spark, str(tmp_path / "height=*"), wide=True)
    assert rows(d.select("anno_id", "z", "start", "length", "columns")) == rows(boxes(8).unionByName(boxes(9)))
    assert {(r["anno_id"], r["height"], r["width"]) for r in d.collect()} == {(8, 8, 11), (9, 9, 11)}
    single = readers.read_masks(spark, str(tmp_path / "height=*"))
    assert single.count() == 4 * d.count() and rows(masks.mask_areas(single, ["anno_id", "z"])) == rows(masks.mask_areas(d, ["anno_id", "z"]))
    assert "Union" not in plan(d, capsys)
    own = table(spark, 7, range(6)).select(F.col("k").alias("anno_id"), F.col("k").alias("z"), "start", "length")
    writers.write_masks(own, str(tmp_path / "random"), 8, 11)
    assert rows(readers.read_masks(spark, str(tmp_path / "random")).select(own.columns)) == rows(own)


def test_distances_of_masks_with_both_sides_only(monkeypatch):
    r = np.random.default_rng(9)
    images = [[r.random((9, 12)) < p for p in (0.3, 0.0, 0.5, 0.0, 0.6)], [r.random((9, 12)) < p for p in (0.4, 0.5, 0.0, 0.0, 0.2)]]
    parts = []
    for own in images:
        for k, m in enumerate(own):
            start, n = masks.runs_of(m)
            parts.append(strips.cut(np.full(len(start), k), start, n, np.ones_like(start), 9))
    side = np.repeat([0, 1], [sum(len(p.x) for p in parts[:5]), sum(len(p.x) for p in parts[5:])])
    seen, surface = set(), strips.surface
    monkeypatch.setattr(strips, "surface", lambda s, deep=False: seen.update(s.plane.tolist()) or surface(s, deep))
    want = pytest.approx([masks.hausdorff_95(x, y) for x, y in zip(*images, strict=True)])
    for few in (16, 0):
        monkeypatch.setattr(strips, "FEW_STRIPS", few)
        assert strips.distances_95(strips.joined(*parts), side, 5) == want
    assert seen == {0, 4}
