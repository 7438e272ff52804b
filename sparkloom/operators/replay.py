"""Execution of recorded tool calls: responses, errors, state and telemetry.

Models stay outside: what they gave stands in the tables.  calls: rec, pos,
name, z (of run_medsam2 the key slice), delta, box (array of four), refined
(Dice of the mask that add_point gave).  cases: rec, sampled (slices in
order), tight (true boxes by ordinal, null where no mask is true) and dices
(of the propagated masks by ordinal, null where there is none).

A trajectory's state hangs on all its calls so far, so it is a fold over the
record's ordered calls; one shuffle by record brings them together, and the
records of an Arrow batch are folded side by side (`execution`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wording as w
from ..functions.arrays import ordered
from ..functions.geometry import box_iou, box_of
from ..functions.wording import fields, fill, listed, quoted, score
from . import execution, strips
from .rewards import KNOBS, RewardKnobs

FINISH = ("finish", "finish_3d_segmentation")
NAVIGATION = ("get_slice", "scroll")

#: What a step is known by; the rest of it is what its answer needs.
STEP_COLUMNS = ("rec", "pos", "name", "z", "delta", "prev", "ptr", "ok", "clamped", "decision", "changed", "again", "iou", "gain")


def call_iou(box: Column, tight: Column) -> Column:
    """Overlap of a called box [x1, y1, x2, y2] with a slice's true tight box, to three digits; 0 without a mask."""
    own = tuple(F.get(box, F.lit(i)) for i in range(4))
    return F.when(tight.isNull() | box.isNull(), F.lit(0.0)).otherwise(score(box_iou(own, box_of(tight))))


def _look() -> Column:
    """What a look at a slice answers: its overlays, the stack's ends, and the history."""
    flag = lambda c: F.when(c, "true").otherwise("false")
    sampled, place = F.col("sampled"), F.col("ptr")
    state, box = F.col("shown"), F.col("shown_box")
    masked, refined = state.isin("mask", "refined_mask"), state == "refined_mask"
    overlays = F.concat_ws(
        ", ", fill('"has_bbox": {a}, "has_mask": {b}, "has_refined_mask": {c}', a=flag(box.isNotNull()), b=flag(masked), c=flag(refined)), F.when(box.isNotNull(), fill('"bbox": {box}', box=listed(box))),
        F.when(masked, fill('"mask_dice": {d}', d=F.coalesce("shown_dice", F.lit(0.0)))), F.when(refined, fill('"refined_dice": {d}', d=F.coalesce("shown_refined", F.lit(0.0)))),
    )
    left = F.array_except(F.sequence(F.lit(0), F.size(sampled) - 1), "visited")
    return fields(
        z_index=F.get(sampled, place), ordinal=place, slice_image=quoted("<image>"), sampled_z_list=listed(sampled), overlays=F.concat(F.lit("{"), overlays, F.lit("}")),
        boundary=fields(at_start=flag(place == 0), at_end=flag(place == F.size(sampled) - 1), clamped=flag(F.col("clamped"))),
        history=fields(visited_ordinals=listed(F.col("visited")), annotated_ordinals=listed(F.array_sort("annotated")), unvisited_ordinals=listed(left)),
    )


def _error(text: Column, **more: Column) -> Column:
    return fields(error=quoted(text), **more)


#: What a step's answer needs of the state that it met, of looks alone: what the slice shows, and the slices visited and annotated.
MET = "fix double, shown string, shown_box array<int>, shown_dice double, shown_refined double, visited array<int>, annotated array<int>"


def _folded(calls: DataFrame, cases: DataFrame, knobs: RewardKnobs, met: bool) -> DataFrame:
    """Each step up to a record's finish; met: with the case's columns and the state that its answer needs."""
    own = {"pos": "bigint", "name": "string", "z": "int", "delta": "int", "box": "array<int>", "refined": "double"}
    call = F.struct(*(F.col(c).cast(t).alias(c) for c, t in own.items()), score(F.col("refined")).alias("rounded"))
    seq = calls.groupBy("rec").agg(ordered(call).alias("s"))
    d = cases.join(seq, "rec").select("rec", "sampled", "tight", "dices", F.transform("dices", lambda v: score(v)).alias("rounds"), "s")
    kept = ["rec", "sampled", "tight", "dices"] if met else ["rec"]
    truth = d.schema["tight"].dataType.elementType.simpleString()
    steps = (
        "pos bigint, name string, z int, delta int, prev int, ptr int, ok boolean, clamped boolean, decision boolean, changed boolean, again boolean, "
        f"gain double, called array<int>, truth {truth}" + (f", {MET}" if met else "")
    )

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            values, counts = strips.lists(batch.column("s"))
            edge = np.r_[0, np.cumsum(counts)]
            for i, j in execution.stretches(counts, batch.column("sampled")):
                case = batch.slice(i, j - i)
                of, columns = execution.fold(values.slice(edge[i], edge[j] - edge[i]), counts[i:j], *(case.column(c) for c in ("sampled", "tight", "rounds")), knobs.gain_clip, met)
                at = pa.array(of)
                yield pa.RecordBatch.from_arrays([*(case.column(c).take(at) for c in kept), *columns.values()], names=[*kept, *columns])

    told = d.mapInArrow(batches, ", ".join([*(f"{c} {t}" for c, t in d.select(*kept).dtypes), steps]))
    iou = F.when(F.col("ok") & (F.col("name") == "add_bbox"), call_iou(F.col("called"), F.col("truth")))
    return told.withColumn("iou", iou).drop("called", "truth")


def _answer() -> Column:
    """The response to a step of `_folded`; null to a finish."""
    name, z, sampled, ok = F.col("name"), F.col("z"), F.col("sampled"), F.col("ok")
    jump, scroll, box, point, run = (name == k for k in ("get_slice", "scroll", "add_bbox", "add_point", "run_medsam2"))
    known = lambda i: F.get("dices", i).isNotNull()
    entry = lambda v, i: fields(z_index=v, ordinal=i, mask_image=F.when(known(i), '"<image>"').otherwise("null"), dice_with_gt=F.when(known(i), F.when(F.get("tight", i).isNull(), F.lit(0.0)).otherwise(score(F.get("dices", i)))).otherwise(F.lit(-1.0)))
    current = F.coalesce(F.get(sampled, F.col("prev")).cast("string"), F.lit("None"))
    return (
        F.when(ok & (jump | scroll), _look())
        .when(ok & box, fields(z_index=z, bbox_image=quoted("<image>"), iou_with_gt=F.col("iou")))
        .when(ok & run, fields(status=quoted("propagation_complete"), key_z=z, slices=listed(F.transform(sampled, entry))))
        .when(ok & point, fields(z_index=z, mask_image=quoted("<image>"), dice_with_gt=F.coalesce(score(F.col("fix")), F.lit(0.0))))
        .when(jump, _error(F.lit(w.ERRORS["get_slice"]), sampled_z_list=listed(sampled)))
        .when(scroll & F.col("prev").isNull(), _error(F.lit(w.ERRORS["unset"])))
        .when(scroll, _error(F.lit(w.ERRORS["still"])))
        .when(box | point, _error(fill(w.ERRORS["elsewhere"], z=z, name=name, current=current)))
        .when(~name.isin(*FINISH), _error(fill(w.ERRORS["unknown"], name=name)))
    )


def answered(steps: DataFrame, *more: str) -> DataFrame:
    """Steps that carry their case and what a look shows, a batch's or a stream's, with images and response instead."""
    ok, name = F.col("ok"), F.col("name")
    one = ok & (name.isin(*NAVIGATION) | name.isin("add_bbox", "add_point"))
    images = F.when(one, F.lit(1)).when(ok & (name == "run_medsam2"), F.size(F.filter("dices", lambda v: v.isNotNull()))).otherwise(F.lit(0))
    return steps.select(*more, *STEP_COLUMNS, images.alias("images"), _answer().alias("response"))


def states(calls: DataFrame, cases: DataFrame, knobs: RewardKnobs = KNOBS) -> DataFrame:
    """Steps of each record up to its finish, without responses; see `navigate`."""
    return _folded(calls, cases, knobs, False).select(*STEP_COLUMNS)


def navigate(calls: DataFrame, cases: DataFrame, knobs: RewardKnobs = KNOBS) -> DataFrame:
    """Steps of each record up to its finish, with the response to each call.

    A slice that is not sampled, a scroll before any look or by 0, and an
    annotation of another slice than the one in view are answered by an error
    and change nothing; so is an unknown tool.  decision: the call counts as a
    move; changed: the slice's overlay (raw, bbox, mask or refined_mask) is
    not what its last look showed; again: the slice was seen before; iou,
    gain: of boxes and points.
    """
    return answered(_folded(calls, cases, knobs, True))


def annotate(calls: DataFrame, cases: DataFrame) -> DataFrame:
    """Responses of the form without navigation, where every call stands alone: (rec, pos, name, images, response).

    A finish is not answered.  The responses of a turn follow after all its
    calls; `answer_order` gives that order.
    """
    d = calls.join(cases, "rec")
    place = F.array_position("sampled", F.col("z")).cast("int") - 1
    entry = lambda v, i: fields(z_index=v, mask_image=quoted("<image>"), dice_with_gt=F.coalesce(score(F.get(F.col("dices"), i)), F.lit(0.0)))
    refined = F.when(F.get("tight", place).isNull(), F.lit(0.0)).otherwise(F.coalesce(score(F.col("refined")), F.lit(0.0)))
    name = F.col("name")
    response = (
        F.when(name == "add_bbox", fields(z_index=F.col("z"), bbox_image=quoted("<image>"), iou_with_gt=call_iou(F.col("box"), F.get("tight", place))))
        .when(name == "run_medsam2", fields(status=quoted("propagation_complete"), key_z=F.col("z"), slices=listed(F.transform("sampled", entry))))
        .when(name == "add_point", fields(z_index=F.col("z"), mask_image=quoted("<image>"), dice_with_gt=refined))
        .when(~name.isin(*FINISH), _error(fill(w.ERRORS["unknown"], name=name)))
    )
    images = F.when(name.isin("add_bbox", "add_point"), 1).when(name == "run_medsam2", F.size("sampled")).otherwise(0)
    return d.select("rec", "pos", "name", images.alias("images"), response.alias("response"))


def answer_order(turn: str = "turn", pos: str = "pos", role: str = "role") -> list[Column]:
    """Order of a conversation in which a turn's answers follow all its calls."""
    return [F.col(turn), (F.col(role) == "tool_response").cast("int"), F.col(pos)]


def telemetry(steps: DataFrame) -> DataFrame:
    """Counts of each record's replay, and its navigation, box and point measures as arrays of its calls."""
    moves = F.count_if(F.col("decision") & F.col("clamped"))
    still = F.count_if(F.col("decision") & F.col("again") & ~F.col("changed") & (F.col("name") == "get_slice"))
    return steps.groupBy("rec").agg(
        F.count("*").alias("num_turns"), F.count_distinct(F.when(F.col("ok") & (F.col("name") == "add_bbox"), F.col("ptr"))).alias("n_add_bbox"), F.count("gain").alias("n_add_point"),
        F.count_if(F.col("name") == "run_medsam2").alias("n_run_medsam2"), F.count_if(F.col("name").isin(*FINISH)).alias("n_finish"), moves.alias("boundary_clamp_count"),
        still.alias("revisit_no_change_count"), F.max_by(F.when(F.col("name") == "run_medsam2", F.col("z")), F.when(F.col("name") == "run_medsam2", F.col("pos"))).alias("key_z_chosen"),
        F.coalesce(F.avg("iou"), F.lit(0.0)).alias("r_bbox_iou"), F.coalesce(F.sum("gain"), F.lit(0.0)).alias("r_dice_gain"),
    )


def abort_rows(requests: DataFrame, done: DataFrame, reason: str) -> DataFrame:
    """Rows of zeros, with the reason as gate violation, for requests that no rollout came back for."""
    zero = lambda *names: [F.lit(0.0).alias(n) for n in names]
    none = lambda *names: [F.lit(0).cast("bigint").alias(n) for n in names]
    missing = requests.join(done.select("rec"), "rec", "left_anti")
    return missing.select(
        "rec", *zero("r_dice", "r_key_dice", "r_bbox_iou", "r_dice_gain", "r_coverage", "r_nav_style", "r_efficiency"), F.lit(0).alias("gate"), F.array(F.lit(reason)).alias("gate_violations"),
        *none("num_turns", "n_add_bbox", "n_add_point", "n_run_medsam2", "n_finish", "parsed_call_count"), F.lit(False).alias("finished"),
    )

