"""First annotations with one failure, their review, and the boxes that are drawn again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import hash_order, hash_uniform
from ..functions.geometry import box_iou, box_of, jitter_box, shift_box

#: The overlap at which a box passes its review, the first and the second jitter, and a failure's shift.
PASS, FIRST, SECOND, SHIFT = 0.75, 0.05, 0.02, 0.30


def corrected_boxes(boxes: DataFrame, record: str, key: str, width: Column, height: Column, seed: int = 42, fail: Column | None = None) -> DataFrame:
    """Each box as it is drawn first, its review, and as it is drawn in the end.

    boxes: record, key and the true x1, y1, x2, y2.  A box is drawn with
    jitter; in records where fail holds (all by default) one box, chosen by
    its hash, is shifted instead.  One that overlaps the true box by less than
    PASS is drawn again with a smaller jitter.  Adds failed, first, iou (of
    the first), redrawn and final (a struct as first is; equal to it where the
    box passes).  Noise hangs on record and key alone.
    """
    true = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    order = F.struct(hash_order(seed, record, key).alias("h"), F.col(key).alias("k"))
    fails = F.coalesce(fail, F.lit(False)) if fail is not None else F.lit(True)
    chosen = boxes.filter(fails).groupBy(record).agg(F.min(order)["k"].alias("_chosen"))
    noise = lambda name: tuple(hash_uniform(seed, f"{name}{i}", record, key) for i in range(4))
    d = boxes.join(chosen, record, "left").withColumn("failed", F.coalesce(F.col("_chosen") == F.col(key), F.lit(False)))
    whole = lambda b: F.struct(*(b[c].cast("bigint").alias(c) for c in ("x1", "y1", "x2", "y2")))
    first = F.when(F.col("failed"), whole(shift_box(true, SHIFT, width, height))).otherwise(whole(jitter_box(true, FIRST, width, height, noise("jitter"))))
    d = d.withColumn("first", first).withColumn("iou", box_iou(true, box_of("first"))).withColumn("redrawn", F.col("iou") < PASS)
    final = F.when(F.col("redrawn"), whole(jitter_box(true, SECOND, width, height, noise("again")))).otherwise(F.col("first"))
    return d.withColumn("final", final).drop("_chosen")
