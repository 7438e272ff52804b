"""The executor of tool calls as a stateful stream.

One key is one record.  Its state is one value, read once and written once in
a micro-batch: the next position, the slice in view, and what the record
remembers, namely slices (overlay, what their last look showed, box, Dice),
the slices visited and annotated, and the calls that came before their turn.
A call is executed when all before it were, whatever the micro-batches they
come in.  An event-time timer follows the record's last call: when it fires,
it is set anew if calls came since, else a record without a finish ends in an
abort row, and the state of every record goes.  A record's case is met before
and after the state: calls bring what they need of it, steps are joined to it.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.wording import score
from ..operators import replay
from ..operators.replay import FINISH
from ..operators.rewards import KNOBS, RewardKnobs

STEP = (
    "pos bigint, name string, z int, delta int, prev int, ptr int, ok boolean, clamped boolean, decision boolean, changed boolean, again boolean, called array<int>, gain double, fix double, "
    "shown string, shown_box array<int>, shown_dice double, shown_refined double, visited array<int>, annotated array<int>"
)
#: A record's steps of one micro-batch go out as one text, as its calls come in as texts: a worker's row costs by its columns.
OUTPUT = "event string, rec bigint, steps string"
#: A call as it waits: places are the ordinals of its slice, truth says whether the first has a true mask; rounds come with propagations.
_CALL = ("name", "z", "delta", "box", "refined", "rounded", "places", "truth", "size", "rounds")


def _number(value: float | str | None) -> float | None:
    """A double of `to_json`, which quotes those that are no numbers."""
    return None if value is None else float(value)


class RecordExecutor(StatefulProcessor):
    """Executes the calls of one record in the order of their positions; see `execute_stream`."""

    def __init__(self, silence: int, first: int, knobs: RewardKnobs):
        self.silence, self.first, self.clip = silence, first, knobs.gain_clip

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # memory: JSON of slices, visited, annotated and waiting
        self.at = handle.getValueState("at", "next bigint, ptr int, done boolean, last bigint, memory string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        met = self.at.get()
        turn, self.ptr, done, last, memory = met or (self.first, None, False, -1, None)
        if not done and met and last + self.silence <= timerValues.getCurrentWatermarkInMs():
            # it was over before these calls came
            done, memory = True, None
            yield self._abort(key[0])
        came = {}
        for row in rows:
            last = max(last, row.ms)
            if not done and row.pos is not None and row.pos >= turn:
                came.setdefault(row.pos, row.call)
        if came:
            slices, self.seen, self.drawn, waiting = json.loads(memory) if memory else ([], [], [], [])
            self.known = {i: v for i, v in slices}
            # a position that waits already counts as it came first
            calls, steps = came | dict(waiting), []
            while not done and turn in calls:
                call = json.loads(calls.pop(turn))
                steps.append(self._step(turn, *map(call.get, _CALL)))
                turn, done = turn + 1, call.get("name") in FINISH
            if steps:
                yield Row(event="step", rec=key[0], steps=json.dumps(steps))
            memory = None if done else json.dumps([list(self.known.items()), self.seen, self.drawn, list(calls.items())])
        self.at.update((turn, self.ptr, done, last, memory))
        if not met:
            self.handle.registerTimer(last + self.silence)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        met = self.at.get()
        if met and met[3] + self.silence > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(met[3] + self.silence)
            return
        self.at.clear()
        if not (met and met[2]):
            yield self._abort(key[0])

    def _abort(self, rec: int) -> Row:
        return Row(event="abort", rec=rec, steps=None)

    def _step(self, pos: int, name: str, z: int, delta: int, box: list, refined: float, rounded: float, places: list, truth: bool, size: int, rounds: list) -> dict:
        """One call on the state in memory: what tells it, with what a look shows."""
        refined, rounded = _number(refined), _number(rounded)
        prev, known = self.ptr, self.known
        found = places[0] if places else None
        look, clamped, ptr = False, False, prev
        if name == "get_slice":
            look = found is not None
            ptr = found if look else prev
        elif name == "scroll" and prev is not None and delta:
            look, ptr = True, min(max(prev + delta, 0), size - 1)
            clamped = ptr != prev + delta
        here = prev is not None and prev in (places or ())
        drawn, corrected, spread = name == "add_bbox" and here, name == "add_point" and here, name == "run_medsam2"
        decision = look or (name == "scroll" and prev is not None)
        at = lambda i, k: known[i][k] if i in known else ("raw" if k == 0 else None)
        gain = None
        if name == "add_point":
            shown = None if found is None else at(found, 4)
            old = 0.0 if found is None or not truth else next((x for x in (shown, at(found, 3)) if x is not None), 0.0)
            new = (refined or 0.0) if corrected else (old if shown is None else shown)
            gain = min(max(new - old, 0.0), self.clip)
        # only looks tell what the slice shows
        met = {k: at(ptr, c) for k, c in (("shown", 0), ("shown_box", 2), ("shown_dice", 3), ("shown_refined", 4))} | {"visited": [*self.seen, ptr], "annotated": list(self.drawn)} if look else {}
        out = dict(
            pos=pos, name=name, z=z, delta=delta, prev=prev, ptr=ptr, ok=look or drawn or corrected or spread or name in FINISH,
            clamped=clamped, decision=decision, changed=decision and at(ptr, 1) != at(ptr, 0), again=decision and ptr in self.seen, called=box if drawn else None, gain=gain, fix=refined,
            **met,
        )
        self.ptr = ptr
        own = lambda i: known.setdefault(i, ["raw", None, None, None, None])
        if look:
            self.seen.append(ptr)
        if name in ("get_slice", "scroll") and ptr is not None:
            own(ptr)[1] = at(ptr, 0)
        if drawn:
            own(prev)[0], own(prev)[2] = "bbox", box
            if prev not in self.drawn:
                self.drawn.append(prev)
        if corrected:
            own(prev)[0], own(prev)[4] = "refined_mask", rounded
        if spread:
            for i, dice in enumerate(rounds or ()):
                if dice is not None and i < size:
                    own(i)[0], own(i)[3] = "mask", _number(dice)
        return {k: v for k, v in out.items() if v is not None}


def execute_stream(calls: DataFrame, cases: DataFrame, silence: int = 3_600_000, first: int = 0, knobs: RewardKnobs = KNOBS) -> DataFrame:
    """event (step or abort), then the columns of `replay.navigate`, for a stream of calls.

    calls: a stream of rec, pos, name, z, delta, box, refined and ts, with a
    watermark on ts; cases: a table as `replay.navigate` takes it.  Positions
    count from `first`; a position that comes again, or after the finish, is
    ignored.  A record whose last call is `silence` milliseconds under the
    watermark is over: without a finish it gives one abort row with nothing
    but rec, and calls that still waited for one before them are dropped.
    """
    return _answered(_told(calls, cases, silence, first, knobs), cases)


def _told(calls: DataFrame, cases: DataFrame, silence: int, first: int, knobs: RewardKnobs) -> DataFrame:
    """The rows of `OUTPUT` for a stream of calls."""
    here = F.filter(F.transform("sampled", lambda v, i: F.when(v == F.col("z"), i)), lambda i: i.isNotNull())
    fixed = cases.select(F.col("rec").cast("bigint").alias("rec"), "sampled", "tight", "dices")
    own = calls.select(F.col("rec").cast("bigint").alias("rec"), "pos", "name", "z", "delta", "box", "refined", "ts").join(fixed, "rec")
    own = own.withColumns({"places": here, "rounded": score(F.col("refined")), "size": F.size("sampled")})
    own = own.withColumn("truth", F.get("tight", F.get("places", F.lit(0))).isNotNull()).withColumn("rounds", F.when(F.col("name") == "run_medsam2", F.transform("dices", lambda v: score(v))))
    # nulls in rounds stay; those of other fields are left out
    own = own.select("rec", "pos", F.unix_millis("ts").alias("ms"), F.to_json(F.struct(*_CALL)).alias("call"), "ts")
    return own.groupBy("rec").transformWithState(RecordExecutor(silence, first, knobs), OUTPUT, "Append", "EventTime")


def _answered(told: DataFrame, cases: DataFrame) -> DataFrame:
    """Steps with their responses, which need the record's case and no state."""
    steps = F.from_json("steps", f"array<struct<{re.sub(r'(\w+) (\w)', r'\1: \2', STEP)}>>", {"mode": "FAILFAST"})
    told = told.select("event", "rec", F.explode_outer(steps).alias("s")).select("event", "rec", "s.*")
    d = told.join(cases.select(F.col("rec").cast("bigint").alias("rec"), "sampled", "tight", "dices"), "rec", "left")
    iou = F.when(F.col("ok") & (F.col("name") == "add_bbox"), replay.call_iou(F.col("called"), F.get("tight", F.col("prev"))))
    return replay.answered(d.withColumn("iou", iou), "event")


def aborted(events: DataFrame, reason: str = "timeout") -> DataFrame:
    """The zero rows (see `replay.abort_rows`) of the records that a stream has given up."""
    lost = events.filter("event = 'abort'").select("rec")
    return replay.abort_rows(lost, lost.limit(0), reason)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which all executors share; it goes away with the driver's JVM.

    Only a local master may do without that setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return folder


def run_stream(stream: DataFrame) -> DataFrame:
    """All that a stream gives for what its sources hold now, from a Parquet sink."""
    spark = stream.sparkSession
    out, store = shared_folder(spark, "stream"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    # state of this kind needs the store with column families
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(store)
        else:
            spark.conf.set(store, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def replay_calls(calls: DataFrame, cases: DataFrame, batches: int = 3, first: int = 0) -> DataFrame:
    """Events of a finished table of calls, as `execute_stream` takes them, played in batches that mix all positions.

    A last call of nobody, later than all, moves the watermark past the others,
    so that every record without a finish is given up.
    """
    spark = calls.sparkSession
    folder, known = (shared_folder(spark, name) for name in ("calls", "cases"))
    # each micro-batch reads as many files as there are cores, and the cases once made
    files = spark.sparkContext.defaultParallelism
    calls.withColumn("rec", F.col("rec").cast("bigint")).repartition(batches * files, F.xxhash64("rec", "pos")).write.mode("append").parquet(folder)
    cases.write.mode("append").parquet(known)
    calls, cases = spark.read.schema(calls.withColumn("rec", F.col("rec").cast("bigint")).schema).parquet(folder), spark.read.schema(cases.schema).parquet(known)
    ms = F.unix_millis("ts")
    edge = calls.agg(F.min("rec").alias("rec"), F.min(ms).alias("least"), F.max(ms).alias("most")).first()
    span = (edge["most"] or 0) - (edge["least"] or 0)
    # once the batches are through, the watermark passes the last call's silence
    last = {"rec": F.lit((edge["rec"] or 0) - 1), "ts": F.timestamp_millis(F.lit((edge["most"] or 0) + span + 60_000))}
    end = spark.range(1).select(*((last[c] if c in last else F.lit(None)).cast(t).alias(c) for c, t in calls.dtypes))
    end.write.mode("append").parquet(folder)
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", files).parquet(folder)
    # the batches are out of order by as much as the whole table spans
    stream = stream.withWatermark("ts", f"{span + 1000} milliseconds")
    # responses are made of what the sink holds, and only where they are asked for
    return _answered(run_stream(_told(stream, cases, 1000, first, KNOBS)), cases)
