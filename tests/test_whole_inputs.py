"""Queries and operators take all of their input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import masks
from sparkloom.plans import fixtures, segmentation
from tests.conftest import SF


def test_hd95_takes_all_masks(spark):
    got = {(r["rec"], r["z"]): r for r in segmentation.hd95(spark, SF).collect()}
    assert set(got) == {tuple(r) for r in segmentation.mask_iou(spark, SF).select("rec", "z").collect()}
    true, pred = ({(r["rec"], r["z"]): r for r in fixtures.view(spark, SF, q).collect()} for q in (segmentation._TRUE, segmentation._PRED))
    for key in sorted(got)[:: len(got) // 40]:
        if key not in true or key not in pred:
            assert got[key]["hd95"] is None and got[key]["undefined"]
            continue
        edges = []
        for b in (true[key], pred[key]):
            y, x = np.mgrid[b["y1"] : b["y2"] + 1, b["x1"] : b["x2"] + 1]
            edge = (y == b["y1"]) | (y == b["y2"]) | (x == b["x1"]) | (x == b["x2"])
            edges.append(np.stack([y[edge], x[edge]], axis=1).astype(float))
        d = np.sqrt(((edges[0][:, None] - edges[1][None]) ** 2).sum(axis=2))
        assert got[key]["hd95"] == pytest.approx(np.percentile(np.r_[d.min(axis=1), d.min(axis=0)], 95), abs=1e-6)


def test_surface_at_the_image_edge():
    a, b = np.zeros((2, 9, 9), bool)
    a[0:5, 0:5], b[3:9, 2:9] = True, True
    far = [np.pad(m, 7) for m in (a, b)]
    assert masks.hausdorff_95(a, b) == masks.hausdorff_95(*far)


def test_components_take_all_records(spark):
    got = segmentation.connected_components(spark, SF)
    want = fixtures.view(spark, SF, segmentation._TRUE).select("rec").distinct()
    assert got.select("rec").distinct().count() == want.count() and got.filter(F.col("x2") - F.col("x1") < 5).count() == 0
