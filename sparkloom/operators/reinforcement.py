"""Prompts for reinforcement learning from supervised records, by looking up each record's annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

UNREADABLE, UNKNOWN = "prompt or images name no caption, slices or volume", "no annotation of this volume and caption"
REASONS = (UNREADABLE, UNKNOWN)


def _places(areas: Column, sampled: Column, lesion: bool) -> Column:
    """Ordinals of the sampled slices that have a mask, or of the others."""
    has = lambda z: F.when(z >= 0, F.coalesce(F.get(areas, z) > 0, F.lit(False))).otherwise(F.lit(False))
    return F.filter(F.transform(sampled, lambda z, i: F.when(has(z) == F.lit(lesion), i)), lambda i: i.isNotNull())


def rl_records(entries: DataFrame, annos: DataFrame, data_root: str = "") -> DataFrame:
    """One row for each entry: its prompt alone with what a rollout is scored by, or the reason why it is skipped.

    entries: messages (array of role and content; the first is the prompt) and
    images (paths, of which the first rendered one names the volume); other
    columns are kept.  annos: vid, caption, anno_id and areas (pixels of each
    slice's mask, by slice; null or 0 without one); of rows that share vid and
    caption the one of the largest anno_id counts.  Adds vid, caption,
    anno_id, data_root, sampled_z, lesion_ordinals, non_lesion_ordinals,
    oracle_key_z (the sampled slice of the largest mask, the first of equal
    ones; null without any) and reason, which is null where nothing is
    missing; such a row's messages are its prompt and its images are none.
    """
    prompt = F.get("messages", F.lit(0))["content"]
    own = entries.select("*", text.caption_of(prompt).alias("caption"), text.sampled_slices(prompt).alias("sampled_z"), text.first_volume(F.col("images")).alias("vid"))
    readable = F.col("caption").isNotNull() & F.col("vid").isNotNull() & (F.coalesce(F.size("sampled_z"), F.lit(0)) > 0)
    # what cannot be looked up has no key: its rows do not meet in one partition of the join
    own = own.withColumn("_key", F.when(readable, F.struct("vid", "caption")))
    known = annos.groupBy("vid", "caption").agg(F.max_by(F.struct("anno_id", "areas"), "anno_id").alias("_anno"))
    known = known.select(F.struct("vid", "caption").alias("_key"), "_anno")
    d = own.filter("_key is not null").join(known, "_key", "left").unionByName(own.filter("_key is null"), allowMissingColumns=True)
    areas, z = F.col("_anno.areas"), F.col("sampled_z")
    lesion = _places(areas, z, True)
    best = F.array_max(F.transform(lesion, lambda i: F.struct(F.get(areas, F.get(z, i)).cast("bigint").alias("area"), (-i).alias("i"))))
    reason = F.when(F.col("_key").isNull(), F.lit(UNREADABLE)).when(F.col("_anno").isNull(), F.lit(UNKNOWN))
    kept = [c for c in entries.columns if c not in ("messages", "images")]
    return d.select(
        *kept, F.slice("messages", 1, 1).alias("messages"), F.array().cast("array<string>").alias("images"), "vid", "caption", F.col("_anno.anno_id").alias("anno_id"), F.lit(data_root).alias("data_root"), "sampled_z",
        lesion.alias("lesion_ordinals"), _places(areas, z, False).alias("non_lesion_ordinals"), F.get(z, -best["i"]).alias("oracle_key_z"), reason.alias("reason"),
    )
