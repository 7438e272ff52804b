"""Queries on streams: the executor of tool calls and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import executor
from . import trajectories
from .fixtures import CALLS, plain, view


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replayed calls as a stream, in batches that mix all positions."""
    calls, cases = trajectories.replayed(spark, sf_dir)
    times = view(spark, sf_dir, f"WITH {CALLS} SELECT user_id AS rec, CAST(pos AS BIGINT) AS pos, CAST(ts AS TIMESTAMP) AS ts FROM ev")
    return executor.replay_calls(calls.join(times, ["rec", "pos"]), cases, first=1)


def stream_executor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of calls; same steps as the batch fold."""
    return trajectories.told_steps(_events(spark, sf_dir).filter("event = 'step'"))


def stream_aborts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that fall silent without a finish."""
    d = executor.aborted(_events(spark, sf_dir))
    return d.select("rec", "r_dice", "gate", F.array_join("gate_violations", ",").alias("violations"), "num_turns", "finished")


def windowed_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each kind in windows of an hour: the same expression serves streams with a watermark."""
    d = spark.read.parquet(f"{sf_dir}/events.parquet")
    g = d.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "total")


SQL = {
    "stream_executor": trajectories.SQL["executor_steps"],
    "stream_aborts": f"""WITH {plain(CALLS)} SELECT rec, 0.0::DOUBLE AS r_dice, 0 AS gate, 'timeout' AS violations, 0::BIGINT AS num_turns, false AS finished FROM calls GROUP BY rec HAVING count(*) FILTER (name = 'finish') = 0""",
    "windowed_activity": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}

QUERIES = {name: globals()[name] for name in SQL}
