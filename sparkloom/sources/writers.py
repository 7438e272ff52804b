"""Writers for records, metrics and split datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.masks import run_texts


def write_split_records(d: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines, a folder for each split."""
    d.write.mode("overwrite").partitionBy(split).json(path)


def metrics_rows(d: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles as texts with fixed digits; infinite and missing ones empty."""
    text = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), "").otherwise(F.format_string(f"%.{digits}f", c))
    return d.select(*(text(c).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes))


def write_metrics(d: DataFrame, path: str, digits: int = 4) -> None:
    metrics_rows(d, digits).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_records(d: DataFrame, path: str) -> None:
    """JSON lines, such as the results of cases or the predictions of images; absent fields are left out."""
    d.write.mode("overwrite").json(path)


def write_sifted(d: DataFrame, path: str, reasons: tuple[str, ...], reason: str = "reason") -> dict[str, int]:
    """Writes the rows without a reason as JSON lines; returns how many were read, written, and skipped by reason.

    Counts are observed while the rows are written, so nothing is computed
    twice and the counts are those of the files; a write that fails gives
    none.  Reasons beyond `reasons` count as `other`.
    """
    seen, why = Observation(), F.col(reason)
    named = [F.count_if(why == r).alias(r) for r in reasons]
    other = F.count_if(why.isNotNull() & ~F.coalesce(why.isin(*reasons), F.lit(False))).alias("other")
    told = d.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(why.isNull()).alias("written"), *named, other)
    write_records(told.filter(why.isNull()).drop(reason), path)
    return seen.get


def write_masks(runs: DataFrame, path: str, height: int, width: int, keys: tuple[str, str] = ("anno_id", "z")) -> None:
    """Masks as Parquet rows (anno_id, z, size, counts) with compressed run lengths; runs: the keys, start, length."""
    d = run_texts(runs, list(keys), height * width, height)
    d.select(*keys, F.array(F.lit(height), F.lit(width)).alias("size"), "counts").write.mode("overwrite").parquet(path)


def metadata_lines(expressions: DataFrame) -> DataFrame:
    """(vid, video): a JSON text for each video with its expressions, frames, height and width.

    expressions: vid, eid, caption, obj_id, frames, img_h, img_w.
    """
    each = F.struct("eid", F.struct(F.col("caption").alias("exp"), "obj_id").alias("e"))
    g = expressions.groupBy("vid").agg(F.array_sort(F.collect_list(each)).alias("e"), F.first("frames").alias("frames"), F.first("img_h").alias("height"), F.first("img_w").alias("width"))
    video = F.struct(F.map_from_entries("e").alias("expressions"), "frames", "height", "width")
    return g.select("vid", F.to_json(video).alias("video"))


def write_metadata(expressions: DataFrame, path: str) -> None:
    """The metadata of videos as JSON lines (vid, video)."""
    metadata_lines(expressions).write.mode("overwrite").json(path)


def split_totals(expressions: DataFrame, split: str = "split") -> DataFrame:
    """Videos, expressions, and expressions with any mask (n_masks over 0) of each split and in all."""
    g = expressions.rollup(split).agg(F.count_distinct("vid").alias("videos"), F.count("*").alias("expressions"), F.count_if(F.col("n_masks") > 0).alias("with_masks"))
    return g.withColumn(split, F.coalesce(F.col(split), F.lit("all")))


def outcome_counts(d: DataFrame, split: str, outcome: str, outcomes: list[str]) -> DataFrame:
    """Rows of each outcome by split and in all."""
    return d.rollup(split).agg(F.count("*").alias("n"), *(F.count_if(F.col(outcome) == o).alias(o) for o in outcomes)).withColumn(split, F.coalesce(F.col(split), F.lit("all")))
