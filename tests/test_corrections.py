"""Boxes that are drawn again after their review."""

from pyspark.sql import functions as F

from sparkloom.operators import corrections


def test_one_failure_a_record_is_redrawn(spark):
    rows = [(r, k, 20 + 3 * k, 30 + r, 80 + 5 * k, 100 + 2 * r) for r in range(20) for k in range(5)]
    d = spark.createDataFrame(rows, "rec long, k long, x1 long, y1 long, x2 long, y2 long")
    side = F.lit(400).cast("bigint")
    got = corrections.corrected_boxes(d, "rec", "k", side, side, fail=F.col("rec") < 15).collect()
    again = corrections.corrected_boxes(d.repartition(7), "rec", "k", side, side, fail=F.col("rec") < 15).collect()
    assert sorted(got) == sorted(again)
    failed = [r for r in got if r["failed"]]
    assert sorted(r["rec"] for r in failed) == list(range(15)) and len({r["k"] for r in failed}) > 1
    for r in got:
        assert r["redrawn"] == (r["iou"] < 0.75) and (r["redrawn"] or r["final"] == r["first"])
        if r["failed"]:  # a shift by 0.3 of both sides leaves 0.49 of the area, an overlap of a third
            assert r["redrawn"] and 0.3 < r["iou"] < 0.36
        else:
            assert not r["redrawn"]
        assert all(abs(r["final"][c] - r[c]) <= 0.051 * (r["x2"] - r["x1"] + r["y2"] - r["y1"]) + 1 for c in ("x1", "y1", "x2", "y2"))
        if r["redrawn"]:
            assert all(abs(r["final"][c] - r[c]) <= 0.02 * max(r["x2"] - r["x1"], r["y2"] - r["y1"]) + 1 for c in ("x1", "y1", "x2", "y2"))
