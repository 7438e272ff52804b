"""Grounding rows of images and videos from annotated boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wording as w
from ..functions.arrays import positives_first, round_linspace
from ..functions.wording import fill

MESSAGES = "array<struct<role:string,content:string>>"
BOXES = "array<array<int>>"


def positive_frames(boxes: DataFrame, keys: list[str], place: str) -> DataFrame:
    """keys and `positive`: the distinct places of a group's boxes, in order."""
    return boxes.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col(place).cast("int"))).alias("positive"))


def thinned(places: Column, most: int | None) -> Column:
    """All places, or `most` of them evenly spaced from the first to the last."""
    if most is None:
        return places
    at = F.transform(round_linspace(F.size(places) - 1, F.lit(most)), lambda i: F.get(places, i))
    return F.when(F.size(places) > most, at).otherwise(places)


def chosen_frames(videos: DataFrame, boxes: DataFrame, most: int | None = None, negatives: bool = False) -> DataFrame:
    """(vid, split, frame, place, n_frames, positive): the frames that become rows.

    videos: vid, split, frames (names in order); boxes: vid, place and more.
    The frames with a box of any expression, `most` of them evenly spaced if
    there are more; with negatives all other frames too.  A video without any
    box gives its middle frame.
    """
    found = positive_frames(boxes, ["vid"], "place")
    d = videos.join(found, "vid", "left").withColumn("n_frames", F.size("frames"))
    keep = thinned(F.coalesce("positive", F.array().cast("array<int>")), most)
    none = F.coalesce(F.size("positive"), F.lit(0)) == 0
    places = F.sequence(F.lit(0), F.col("n_frames") - 1)
    rows = F.transform(places, lambda i: F.struct(i.alias("place"), F.array_contains(keep, i).alias("positive")))
    wanted = F.filter(rows, lambda r: F.when(none, r["place"] == F.floor(F.col("n_frames") / 2)).otherwise(r["positive"] | F.lit(negatives)))
    d = d.filter("n_frames > 0").select("vid", "split", "frames", "n_frames", F.explode(wanted).alias("r"))
    return d.select("vid", "split", F.get("frames", F.col("r.place")).alias("frame"), F.col("r.place").alias("place"), "n_frames", F.col("r.positive").alias("positive"))


def _chat(user: Column, answer: Column) -> Column:
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(one("system", F.lit(w.GROUNDING_SYSTEM)), one("user", user), one("assistant", answer)).cast(MESSAGES)


def image_rows(frames: DataFrame, boxes: DataFrame, root: str) -> DataFrame:
    """(vid, split, place, messages, images, objects) of the chosen frames.

    boxes: vid, place, caption, order (of the expression), part and box (array
    of four).  A frame asks for each caption once, in the order of their first
    boxes, and answers with all boxes; one without boxes has no match.
    """
    each = F.array_sort(F.collect_list(F.struct("order", "part", "caption", "box")))
    g = boxes.groupBy("vid", F.col("place").cast("int").alias("place")).agg(each.alias("b"))
    d = frames.join(g, ["vid", "place"], "left")
    b = F.when(F.col("positive"), F.coalesce(F.col("b"), F.expr("filter(b, x -> false)"))).otherwise(None)
    d = d.withColumn("b", b)
    captions = F.array_distinct(F.transform("b", lambda x: x["caption"]))
    some = F.coalesce(F.size("b"), F.lit(0)) > 0
    number = {"slice": F.col("place") + 1, "slices": F.col("n_frames")}
    asked = F.array_join(F.transform(captions, lambda _: F.lit("<ref-object>")), " and ")
    positive = _chat(fill(w.GROUNDING_ASK, what=asked, **number), F.array_join(F.transform("b", lambda _: F.lit("<bbox>")), ""))
    negative = _chat(fill(w.GROUNDING_ASK, what="pathological", **number), F.lit(w.GROUNDING_NONE))
    objects = F.struct(
        F.when(some, captions).otherwise(F.array().cast("array<string>")).alias("ref"), F.when(some, F.transform("b", lambda x: x["box"])).otherwise(F.array().cast(BOXES)).alias("bbox")
    )
    path = F.concat(F.lit(root.rstrip("/") + "/"), "vid", F.lit("/"), "frame", F.lit(".jpg"))
    return d.select("vid", "split", "place", F.when(some, positive).otherwise(negative).alias("messages"), F.array(path).alias("images"), objects.alias("objects"))


def video_rows(expressions: DataFrame, boxes: DataFrame, root: str, prompt: str, most: int) -> DataFrame:
    """(vid, eid, split, messages, videos, objects, channel): one row for each expression of a video.

    expressions: vid, eid, split, caption, frames; boxes: vid, eid, place,
    part, box.  Up to `most` frames, those with boxes first; without any box
    all frames and no match.  prompt: asked of {n_frames} frames.
    """
    place = F.col("place").cast("int")
    each = F.array_sort(F.collect_list(F.struct(place.alias("place"), "part", "box")))
    d = expressions.join(boxes.groupBy("vid", "eid").agg(each.alias("b")), ["vid", "eid"], "left")
    some = F.coalesce(F.size("b"), F.lit(0)) > 0
    positive = F.array_sort(F.array_distinct(F.transform("b", lambda x: x["place"])))
    every = F.sequence(F.lit(0), F.size("frames") - 1)
    d = d.withColumn("at", F.when(some, positives_first(positive, F.array_except(every, positive), most)).otherwise(every))
    own = lambda i: F.filter("b", lambda x: x["place"] == i)
    lines = F.transform("at", lambda i, k: F.when(F.size(own(i)) > 0, F.concat(F.lit("Frame "), k.cast("string"), F.lit(": "), F.array_join(F.transform(own(i), lambda _: F.lit("<bbox>")), " and "))))
    kept = F.flatten(F.transform("at", own))
    user = F.concat(F.lit("<video>"), fill(prompt, n_frames=F.size("at")))
    answer = F.when(some, F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")).otherwise(w.GROUNDING_NONE)
    objects = F.struct(
        F.when(some, F.transform(kept, lambda _: F.col("caption"))).otherwise(F.array().cast("array<string>")).alias("ref"),
        F.when(some, F.transform(kept, lambda x: x["box"])).otherwise(F.array().cast(BOXES)).alias("bbox"),
    )
    paths = F.transform("at", lambda i: F.concat(F.lit(root.rstrip("/") + "/"), F.col("vid"), F.lit("/"), F.get("frames", i), F.lit(".jpg")))
    channel = F.when(some, "grounding").otherwise("negative")
    return d.select("vid", "eid", "split", _chat(user, answer).alias("messages"), F.array(paths).alias("videos"), objects.alias("objects"), channel.alias("channel"))
