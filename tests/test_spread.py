"""Queries that are heavy for each row run on all cores, however small their files are."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.arrays import let
from sparkloom.operators import replay
from sparkloom.plans import traces, trajectories
from tests.conftest import SF


@pytest.mark.parametrize("name", ["box_trajectories", "mask_trajectories", "navigation_trajectories"])
def test_records_are_built_by_many_tasks(spark, name):
    assert getattr(trajectories, name)(spark, SF).rdd.getNumPartitions() >= 16


@pytest.mark.parametrize("query", [trajectories.executor_steps, traces.overlay_change])
def test_traces_are_folded_by_many_tasks(spark, query):
    assert query(spark, SF).rdd.getNumPartitions() >= 16


def test_let_binds_a_value(spark):
    d = spark.range(3).select(let(F.col("id") * 2, lambda x: let(x + 1, lambda y: F.struct(x.alias("x"), y.alias("y")))).alias("r"))
    assert [tuple(r["r"]) for r in d.collect()] == [(0, 1), (2, 3), (4, 5)]


@pytest.mark.parametrize("query", [traces.reward_components, traces.reward_combined, trajectories.executor_telemetry])
def test_traces_are_folded_once_by_batches(spark, capsys, query):
    """One fold serves all components, and it runs over batches of records instead of call by call in each row."""
    query(spark, SF).explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 1 and "aggregate(" not in plan


def test_records_of_a_batch_do_not_touch_each_other(spark):
    """Records of unlike lengths, finished and not, without slices and with a slice twice, give alone what they give together."""
    calls = [(rec, p, ("get_slice", "add_bbox", "run_medsam2", "scroll", "add_point", "finish", "scroll")[(p + rec) % 7], 10 * (1 + p % 2), 1 - 2 * (p % 2), [1, 2, 30, 40], 0.5 + p / 100) for rec in range(9) for p in range(3 * rec)]
    cases = [(rec, [[10, 20], [], [10, 20, 10], None][rec % 4], [(1, 2, 30, 41), None], [0.25, None]) for rec in range(9)]
    calls = spark.createDataFrame(calls, "rec long, pos long, name string, z int, delta int, box array<int>, refined double")
    cases = spark.createDataFrame(cases, "rec long, sampled array<int>, tight array<struct<x1:int,y1:int,x2:int,y2:int>>, dices array<double>")
    key = lambda x: x[:2]
    together = sorted(replay.navigate(calls, cases).collect(), key=key)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        assert together == sorted(replay.navigate(calls, cases).collect(), key=key) and len({x["rec"] for x in together}) == 8
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
