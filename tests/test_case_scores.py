"""volumes come from one pass over their runs, and only the pixels that may hold the percentile are measured."""

import numpy as np
import pytest

from sparkloom.operators import masks, strips
from sparkloom.plans import segmentation
from tests.conftest import SF


@pytest.mark.parametrize("query", [segmentation.case_metrics, segmentation.slice_metrics])
def test_runs_meet_in_one_pass(spark, capsys, query):
    query(spark, SF).explain()
    plan = capsys.readouterr().out
    assert "collect_list" not in plan and plan.count("FileScan") == 1 and plan.count("MapInArrow") == 1


def test_few_pixels_are_measured(monkeypatch):
    """Boxes in four slices of 200 records: about one pixel in ten is near the percentile."""
    rows, depth = 200, 6
    r = np.random.default_rng(3)
    plane = (np.arange(rows)[:, None] * depth + np.arange(1, 5)).ravel()
    box = lambda: strips.Strips(plane, r.integers(0, 400, len(plane)), r.integers(0, 400, len(plane)), r.integers(20, 40, len(plane)), r.integers(20, 40, len(plane)))
    s, side = strips.joined(box(), box()), np.repeat([0, 1], len(plane))
    pixels = []
    least = strips._Met.least

    def counted(self, plane, x, low, high=None):
        pixels.append(0 if high is not None else len(x))
        return least(self, plane, x, low, high)

    monkeypatch.setattr(strips._Met, "least", counted)
    got = strips.distances_95(s, side, rows, depth)
    assert 0 < sum(pixels) < (s.n * s.w).sum() / 5

    def plain(row):
        inside = np.zeros((2, depth, 450, 450), bool)
        for p, x, y, n, w, k in zip(*s, side, strict=True):
            if p // depth == row:
                inside[k, p % depth, x : x + w, y : y + n] = True
        edge = inside.copy()
        for axis in (1, 2, 3):
            for step in (1, -1):
                edge &= np.roll(inside, step, axis)
        a, b = (np.argwhere(m & ~e) for m, e in zip(inside, edge, strict=True))
        d = [np.concatenate([((q[i : i + 500, None] - o[None]) ** 2).sum(axis=2).min(axis=1) for i in range(0, len(q), 500)]) for q, o in ((a, b), (b, a))]
        return np.percentile(np.sqrt(np.concatenate(d)), 95)

    assert [got[i] for i in (0, 77)] == pytest.approx([plain(0), plain(77)], rel=1e-12)


def test_ranks_on_both_surfaces_and_next_to_them():
    """All but some pixels of the surfaces are shared, so that the percentile lies at 0, between 0 and more, or above."""
    for more in range(8):
        a = np.zeros((1, 1, 12, 12), bool)
        a[..., 1:11, 1:11] = True
        b = a.copy()
        b[..., 11, 1 : 1 + more] = True
        parts = [strips.Strips(np.zeros(12, int), np.arange(12), m.argmax(axis=1), m.sum(axis=1), np.ones(12, int)) for m in (a[0, 0], b[0, 0])]
        parts = [p.take(p.n > 0) for p in parts]
        points = [np.argwhere(masks.surface(m[0, 0].T)).astype(float) for m in (a, b)]
        d = np.sqrt(((points[0][:, None] - points[1][None]) ** 2).sum(axis=2))
        got = strips.distances_95(strips.joined(*parts), np.repeat([0, 1], [len(p.x) for p in parts]), 1)
        assert got[0] == pytest.approx(np.percentile(np.r_[d.min(axis=1), d.min(axis=0)], 95))


def test_slices_without_runs_count_where_they_are_annotated(spark):
    run = "rec long, z string, start long, length long"
    truth = spark.createDataFrame([(1, "b", 0, 4), (1, "a", 8, 4), (2, "c", 0, 2)], run)
    pred = spark.createDataFrame([(1, "b", 2, 4), (1, "x", 0, 4), (3, "a", 0, 1)], run)
    annotated = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, "d"), (2, "c"), (4, "e")], "rec long, z string")
    slices, volumes = masks.case_scores(truth, pred, annotated, ["rec"], "z", 8)
    assert {(r["rec"], r["z"]): (r["dice"], r["hd95"] is None) for r in slices.collect()} == {(1, "a"): (0, True), (1, "b"): (0.5, False), (1, "d"): (1, False), (2, "c"): (0, True), (4, "e"): (1, False)}
    assert {r["rec"]: (r["n_slices"], r["gt_area"], r["pred_area"], r["shared"], r["hd95"] is None) for r in volumes.collect()} == {1: (3, 8, 4, 2, False), 2: (1, 2, 0, 0, True), 4: (1, 0, 0, 0, False)}
    slices, volumes = masks.case_scores(truth, pred, None, ["rec"], "z", 8)
    assert {(r["rec"], r["z"]) for r in slices.collect()} == {(1, "a"), (1, "b"), (2, "c")} and {r["rec"]: r["n_slices"] for r in volumes.collect()} == {1: 2, 2: 1}
