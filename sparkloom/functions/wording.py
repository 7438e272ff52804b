"""Texts of training records, and JSON as it stands in their messages.

Templates are filled by `fill`; a name in braces is a column of the caller's.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds that the texts name, and the wording of records.
SLICES, IOU_PASS, DICE_PASS = 10, 0.75, 0.7

TASKS = {"organ": "annotate the organ structure", "lesion": "annotate all lesion regions", "cyst": "annotate all cyst regions"}
OTHER_TASK = "annotate the target structure"

TRENDS = {
    "symmetric": "gradually increases from both ends toward the middle — near-symmetric ellipsoid",
    "upper": "continuously grows from bottom to top — lesion skewed toward upper slices",
    "lower": "largest at the bottom, shrinking upward — lesion skewed toward lower slices",
}

BOX_PROMPT = (
    "Task: Examine the following 10 MRI slices sampled uniformly from a 3D volume. The target structure is: \"{caption}\". "
    "For each slice that contains the target, {task} by calling add_bbox with the precise 2-D bounding box [x1, y1, x2, y2] in pixel coordinates. "
    "After all slices are annotated and reviewed, call finish_bbox_annotation to complete.\n"
)
MASK_PROMPT = (
    "Task: Examine the following 10 MRI slices sampled uniformly from a 3D volume. The target structure is: \"{caption}\". "
    "For each slice containing the target, {task} using add_bbox. After bbox review, call run_medsam2 to generate the 3D segmentation, "
    "then refine any poorly-segmented slices with add_point. Conclude with finish_3d_segmentation.\n"
)
NAVIGATION_PROMPT = (
    "Task: Perform 3D segmentation on an MRI volume. The target structure is: \"{caption}\". For each slice containing the target, {task} using add_bbox. "
    "You will read slices ONE AT A TIME — use get_slice(z) to jump to any sampled Z, or scroll(delta) to move by delta positions within the sampled list. "
    "Adjacent moves (|delta| ≤ 2) should use scroll; jumps of 3+ should use get_slice. After all lesion slices are annotated, call run_medsam2(key_z, bbox) "
    "exactly once to propagate the mask through the volume, then scroll through the masks and call add_point on any slice below Dice 0.70. "
    "Conclude with finish_3d_segmentation.\n\nSampled Z list (10 values, ordinal 0 → 9): {sampled}\nLesion Z range in the full volume: Z={first}~{last}."
)

SPATIAL = (
    "Global spatial analysis:\n\nTarget: {caption}\n\nTarget visible at Z={low}~{high} ({seen} of {n} sampled slices contain the target). "
    "Z={key} has the largest cross-section ({key_note}). Cross-sectional area trend: {trend}.\n{missed}\nProceeding to annotate all target-containing slices:"
)
KEY_NOTES = {"boxes": "key slice", "masks": "key slice for MedSAM2 seeding"}
MISSED = {"boxes": "Z={missed} — target not visible on these slices, skipping annotation.\n", "masks": "Z={missed} — target not visible, skipping annotation.\n"}

REVIEW_HEAD = {"boxes": "Review complete. Checking bbox quality:", "masks": "Bbox review:"}
REVIEW_FAIL = {"boxes": "  Z={z}: FAIL (IoU={iou} < 0.75) — re-annotating.", "masks": "  Z={z}: FAIL (IoU={iou})"}
REVIEW_PASS = "  Z={z}: PASS (IoU={iou})"
REVIEW_TAIL = {"boxes": "\n\nCorrecting {n} slice(s): Z={zs}.", "masks": "\n\nRe-annotating {n} slice(s): Z={zs}."}
BOXES_CORRECTED = "Corrections applied to Z={zs}. All {n} lesion slices now annotated and verified. Finalising annotation."
BOXES_DONE = "\n\nAll {n} lesion slices annotated and verified. Finalising annotation."

SEED_AFTER_CORRECTION = "Corrections applied. All {n} lesion slices verified.\n\n"
SEED = "Bbox annotation complete. Initiating 3D segmentation seeded from key slice Z={key} (largest cross-section, bbox {box})."
MASK_HEAD = "MedSAM2 segmentation review:"
MASK_NO_TRUTH = "  Z={z}: no GT (skip)"
MASK_FAIL = "  Z={z}: FAIL (Dice={dice} < 0.7) — adding correction points."
MASK_PASS = "  Z={z}: PASS (Dice={dice})"
MASK_TAIL = "\n\nAdding point corrections for Z={zs}."
POINTS_DONE = "Point corrections applied to Z={zs}. {better}/{n} slices improved. 3D segmentation complete. Finalising."
NO_POINTS = "All {n} sampled slices meet the Dice ≥ 0.7 threshold. 3D segmentation complete. Finalising."

EXPLORE_OPEN = (
    "Starting Phase A (exploration). I have no image yet — only the sampled Z list. I'll open from the middle slice to locate the likely key (largest cross-section), "
    "then probe the ±2 neighborhood with scroll to build an initial spatial model."
)
EXPLORE_HEAD = "Phase A complete. Cross-section summary across probed ordinals:"
EXPLORE_LINE = "  ord {i} (Z={z}): area={area} px² ({tag})"
EXPLORE_TAIL = "\n\nTentative key slice: Z={key} (ord {ordinal}). Moving to Phase B — full annotation walk covering all 10 sampled slices."
WALK_OPEN = "Entering Phase B — spiral walk outward from the middle, annotating every sampled slice and switching to get_slice for jumps of 3+ ordinals."
WALK_DONE = (
    "Phase B complete. Annotated {n}/10 lesion-containing slices via add_bbox; {rest} slice(s) had no visible target. "
    "Confirmed key slice: Z={key} (ord {ordinal}) — largest cross-section. Initiating 3D segmentation with run_medsam2."
)
SWEEP_OPEN = (
    "MedSAM2 propagation complete. Entering Phase C — scroll-based mask review. I'll sweep from the lowest sampled Z (ord 0) forward via scroll(+1), "
    "inspecting each per-slice Dice and calling add_point on any slice below 0.70."
)
SWEEP_PASSED = "Sweep complete. All 10 sampled slices met Dice ≥ 0.7. Segmentation finalised."
SWEEP_REFINED = "Sweep complete. Refined {n} slice(s) via add_point (Z={zs}); {better} improved above threshold. Segmentation finalised."

GROUNDING_SYSTEM = "You are a medical imaging assistant specializing in MRI analysis."
GROUNDING_ASK = "<image>This image is slice {slice} out of {slices} from an MRI volume. Identify and localize {what} regions in this slice."
GROUNDING_NONE = "No match for the target."

#: Errors as they stand in a response's JSON, whose letters are ASCII.
ERRORS = {
    "get_slice": "z_index not in sampled set",
    "unset": "pointer not initialized \\u2014 call get_slice first",
    "still": "scroll delta must not be 0",
    "elsewhere": "must view slice Z={z} before {name} (current Z={current})",
    "unknown": "unknown tool: {name}",
}


def fill(template: str, **columns: Column | str) -> Column:
    """The template as text with its names in braces replaced."""
    parts = re.split(r"\{(\w+)\}", template)
    out = [F.lit(p) if i % 2 == 0 else text(columns[p]) for i, p in enumerate(parts) if p]
    return F.concat(*out) if out else F.lit("")


def text(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value.cast("string")


def listed(values: Column) -> Column:
    """[1, 2, 3]; nulls stand as null."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: x.cast("string")), ", ", "null"), F.lit("]"))


def fields(**columns: Column | str) -> Column:
    """A JSON object of values that are JSON already, with spaces after commas and colons."""
    pairs = [F.concat(F.lit(f'"{name}": '), text(value)) for name, value in columns.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))


def quoted(value: Column | str) -> Column:
    return F.concat(F.lit('"'), text(value), F.lit('"'))


def tool_call(name: str | Column, arguments: Column | None = None) -> Column:
    return fields(name=quoted(name), arguments=arguments if arguments is not None else "{}")


def score(value: Column, digits: int = 3) -> Column:
    """A number rounded half to even, as Python writes it."""
    return F.bround(value.cast("double"), digits)
