"""The executor as a stream against the batch fold."""

import datetime as dt
import json
import random

from sparkloom.operators import replay
from sparkloom.streaming import executor

CALLS = "rec long, pos long, name string, z int, delta int, box array<int>, refined double, ts timestamp"
CASES = "rec long, sampled array<int>, tight array<struct<x1:int,y1:int,x2:int,y2:int>>, dices array<double>"
TOOLS = ["get_slice"] * 4 + ["scroll"] * 4 + ["add_bbox"] * 5 + ["add_point"] * 5 + ["run_medsam2", "zoom"]
START = dt.datetime(2024, 5, 1, 12)


def trace(r, rec, n, ends):
    rows, z = [], 0
    for i in range(n):
        name = r.choice(TOOLS)
        z = z if name in ("add_bbox", "add_point") and r.random() < 0.8 else r.choice([10, 20, 30, 40, 99])
        box = [r.randrange(20), r.randrange(20), 20 + r.randrange(20), 20 + r.randrange(20)] if name == "add_bbox" else None
        refined = r.choice([0.5, 0.61251, 0.97, None]) if name == "add_point" else None
        rows.append((rec, i, name, z, r.randint(-3, 3), box, refined))
    if ends:
        rows[r.randrange(n // 2, n)] = (rec, n // 2, "finish", None, None, None, None)
    return [(*x[:1], i, *x[2:], START + dt.timedelta(seconds=60 * rec + i)) for i, x in enumerate(rows)]


def cases_of(spark, recs):
    rows = [(k, [10, 20, 30, 40], [(1, 2, 30, 40), None, (5, 5, 25, 25), (0, 0, 9, 9)], [0.51349, None, 0.25, 0.0]) for k in recs]
    return spark.createDataFrame(rows, CASES)


def test_shuffled_batches_give_the_batch_fold(spark):
    r = random.Random(4)
    rows = [x for k in range(1, 13) for x in trace(r, k, 30, k % 3 > 0)]
    calls, cases = spark.createDataFrame(rows, CALLS), cases_of(spark, range(1, 13))
    events = executor.replay_calls(calls, cases, batches=4).cache()
    columns = [*replay.STEP_COLUMNS, "images", "response"]
    got = sorted(events.filter("event = 'step'").select(columns).collect(), key=lambda x: x[:2])
    want = sorted(replay.navigate(calls, cases).select(columns).collect(), key=lambda x: x[:2])
    assert got == want and len(got) > 200
    # overlays repeat and change in both ways, and every kind of call was answered
    assert {(x["again"], x["changed"]) for x in got if x["decision"]} == {(False, True), (True, True), (True, False)}
    assert {x["name"] for x in got if x["ok"]} == {*TOOLS, "finish"} - {"zoom"} and {x["gain"] for x in got} > {None, 0.0}
    gone = executor.aborted(events).collect()
    assert sorted(x["rec"] for x in gone) == [3, 6, 9, 12] and all(x["gate_violations"] == ["timeout"] and not x["finished"] for x in gone)


def test_calls_wait_for_those_before_them(spark):
    """A missing position holds back all after it; the record is given up; repeated positions count once."""
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [(1, 0, "get_slice", 10, 0, None, None, at(0)), (1, 2, "scroll", 0, 1, None, None, at(2)), (1, 3, "finish", 0, 0, None, None, at(3))]
    rows += [(2, 0, "get_slice", 20, 0, None, None, at(0)), (2, 0, "get_slice", 20, 0, None, None, at(1)), (2, 1, "finish", 0, 0, None, None, at(1)), (2, 2, "scroll", 0, 1, None, None, at(2)), (3, None, "finish", 0, 0, None, None, at(0))]
    rows += [(9, 0, "finish", 0, 0, None, None, at(0))]  # a record without a case
    events = executor.replay_calls(spark.createDataFrame(rows, CALLS), cases_of(spark, [1, 2, 3])).collect()
    assert sorted((x["rec"], x["pos"], x["ptr"]) for x in events if x["event"] == "step") == [(1, 0, 0), (2, 0, 1), (2, 1, 1)]
    assert sorted(x["rec"] for x in events if x["event"] == "abort") == [1, 3]


def test_silence_is_told_by_event_time(spark):
    """A record that goes on within the silence lives, one that does not is over before its next call."""
    folder = executor.shared_folder(spark, "test")
    at = lambda s: START + dt.timedelta(seconds=s)
    batches = [
        [(1, 0, "get_slice", 10, 0, None, None, at(0)), (2, 0, "get_slice", 20, 0, None, None, at(0))],
        [(1, 1, "scroll", 0, 1, None, None, at(50))], [(1, 2, "scroll", 0, 1, None, None, at(100))],
        [(1, 3, "finish", 0, 0, None, None, at(150)), (2, 1, "finish", 0, 0, None, None, at(150))], [(7, 0, "finish", 0, 0, None, None, at(9000))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, CALLS).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(folder).withWatermark("ts", "1 second")
    events = executor.run_stream(executor.execute_stream(stream, cases_of(spark, [1, 2]), silence=60_000)).select("event", "rec", "pos").collect()
    assert sorted(tuple(x) for x in events if x["event"] == "step" and x["rec"] == 1) == [("step", 1, i) for i in range(4)]
    assert [tuple(x) for x in events if x["rec"] == 2 or x["event"] == "abort"] == [("step", 2, 0), ("abort", 2, None)]


def test_state_is_read_and_written_once_a_batch():
    """Whatever a record's calls, waiting ones among them, a micro-batch costs it one read and one write of state, and one timer for its life."""
    told = []

    class Handle:
        value = None

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def get(self):
            told.append("get")
            return self.value

        def update(self, value):
            told.append("update")
            self.value = value

        def registerTimer(self, ms):  # noqa: N802
            told.append("timer")

    class Times:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return -1

    call = lambda pos, **x: executor.Row(pos=pos, ms=pos, call=json.dumps({"places": [0], "truth": True, "size": 2, "z": 10, **x}))
    run = executor.RecordExecutor(1000, 0, executor.KNOBS)
    run.init(Handle())
    first = list(run.handleInputRows((1,), iter([call(p, name="get_slice") for p in range(30, 0, -1)]), Times()))
    assert not first and told == ["get", "update", "timer"]
    # the first call frees those that waited; one that comes again is not taken twice
    (row,) = run.handleInputRows((1,), iter([call(0, name="get_slice"), call(5, name="finish")]), Times())
    assert [x["pos"] for x in json.loads(row.steps)] == list(range(31)) and told[3:] == ["get", "update"]
