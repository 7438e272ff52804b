"""Reward components of replayed traces and their combination."""

from __future__ import annotations

import ast
import operator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .masks import sampled_dice


@dataclass(frozen=True)
class RewardKnobs:
    """The published defaults of the reward's constants."""

    gain_clip: float = 0.3
    false_positive: float = 0.5
    nav_reward: float = 0.01
    clamp_penalty: float = 0.02
    revisit_penalty: float = 0.05
    efficiency_rate: float = 0.01
    efficiency_cap: int = 45
    dice: float = 0.7
    key_dice: float = 0.3
    iou: float = 0.20
    gain: float = 0.15
    coverage: float = 0.10
    nav: float = 0.05
    soft_gate: float = 0.1


KNOBS = RewardKnobs()


def navigation_style(navigation: DataFrame, knobs: RewardKnobs = KNOBS) -> DataFrame:
    """(rec, r_nav_style) from moves: the rows of `replay.states` that are decisions."""
    return navigation.groupBy("rec").agg(F.sum(move_style(knobs)).alias("r_nav_style"))


def move_style(knobs: RewardKnobs = KNOBS) -> Column:
    """What one move adds to r_nav_style."""
    step = F.abs(F.col("delta"))
    jump = F.when(F.col("prev").isNull(), F.lit(99)).otherwise(F.abs(F.col("ptr") - F.col("prev")))
    scroll = F.when(F.col("clamped"), F.lit(-knobs.clamp_penalty)).when(step <= 2, F.lit(knobs.nav_reward)).otherwise(F.lit(0.0))
    far = F.when(jump >= 3, F.lit(knobs.nav_reward)).otherwise(F.lit(0.0))
    again = F.when(F.col("again") & ~F.col("changed"), F.lit(-knobs.revisit_penalty)).otherwise(F.lit(0.0))
    return F.when(F.col("name") == "scroll", scroll).otherwise(far + again)


def coverage(annotated: Column, lesion: Column, other: Column, knobs: RewardKnobs = KNOBS) -> Column:
    """Recall on lesion slices (1 without any) less a penalty for each other slice annotated."""
    hit = lambda s: F.size(F.array_intersect(annotated, s)).cast("double")
    recall = F.when(F.size(lesion) == 0, F.lit(1.0)).otherwise(hit(lesion) / F.size(lesion))
    return recall - knobs.false_positive * hit(other)


def dice_rewards(cases: DataFrame, truth: DataFrame, pred: DataFrame | None, key_z: str = "key_z") -> DataFrame:
    """(rec, r_dice, r_key_dice) from the run tables of true and final masks, keyed by rec and z.

    cases: rec, sampled and the key slice.  r_dice is the mean Dice over the
    sampled slices that either side has a mask of, repeated slices counted
    each time; r_key_dice that of the key slice, if it has a true mask.  Both
    are 0 where nothing counts.
    """
    return sampled_dice(cases, truth, pred, key_z).select("rec", "r_dice", "r_key_dice")


def efficiency(calls: Column, knobs: RewardKnobs = KNOBS) -> Column:
    return -knobs.efficiency_rate * F.greatest(calls - knobs.efficiency_cap, F.lit(0))


def clipped_gain(before: Column, after: Column, knobs: RewardKnobs = KNOBS) -> Column:
    return F.least(F.greatest(after - before, F.lit(0.0)), F.lit(knobs.gain_clip))


def combined(gate: Column, s: Column, soft: bool = False, knobs: RewardKnobs = KNOBS) -> Column:
    """The whole reward from columns r_dice, r_key_dice, r_bbox_iou, r_dice_gain, r_coverage, r_nav_style, r_efficiency.

    A missing or unreadable component counts as 0, as does the gate.
    """
    c = lambda name: safe(F.col(name))
    gate = safe(gate)
    shaped = knobs.iou * c("r_bbox_iou") + knobs.gain * c("r_dice_gain") + knobs.coverage * c("r_coverage") + knobs.nav * c("r_nav_style")
    total = knobs.dice * c("r_dice") + knobs.key_dice * c("r_key_dice") + s * shaped + c("r_efficiency")
    return F.when(gate > 0, total).otherwise(total * knobs.soft_gate if soft else F.lit(0.0))


COMPONENTS = ("r_dice", "r_key_dice", "r_bbox_iou", "r_dice_gain", "r_coverage", "r_nav_style", "r_efficiency")


def safe(value: Column, default: float = 0.0) -> Column:
    """A number from whatever a rollout reported; the default where it is none."""
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(default))


def reward_or_nan(infos: Column, reward: Column) -> Column:
    """The reward where a rollout reported anything, else not a number."""
    return F.when(infos.isNull(), F.lit(float("nan"))).otherwise(reward)


def weighted_sum(weights: dict[str, float]) -> Column:
    """The weighted sum of reward columns; one that is null or not a number adds nothing."""
    out = F.lit(0.0)
    for name, weight in weights.items():
        out = out + F.lit(float(weight)) * F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0))
    return out


def group_advantage(rows: DataFrame, group: str, reward: str) -> DataFrame:
    """advantage: the reward's distance from its group's mean in population deviations; null if all are equal."""
    w = W.partitionBy(group)
    return rows.withColumn("advantage", F.try_divide(F.col(reward) - F.avg(reward).over(w), F.stddev_pop(reward).over(w)))


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}


def arithmetic(text: str | None) -> float | None:
    """Value of a formula of numbers, + - * / and brackets; null for anything else."""

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -value(node.operand)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        raise ValueError

    try:
        return float(value(ast.parse(text or "", mode="eval").body))
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None


def countdown_reward(rows: DataFrame) -> DataFrame:
    """rows (answer text, numbers array, target) with reward: 1 if the answer uses the numbers once each and hits the target."""
    @F.pandas_udf("double")
    def value(formulas: pd.Series) -> pd.Series:
        return formulas.map(arithmetic)

    formula = F.trim(F.regexp_extract("answer", r"(?s)<answer>(.*?)</answer>", 1))
    used = F.array_sort(F.transform(F.regexp_extract_all(formula, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("bigint")))
    fits = formula.rlike(r"^[\d+\-*/().\s]+$") & (used == F.array_sort(F.col("numbers").cast("array<bigint>")))
    d = rows.withColumn("formula", formula).withColumn("fits", fits).withColumn("value", value("formula"))
    good = F.col("fits") & (F.abs(F.col("value") - F.col("target")) < 1e-5)
    return d.withColumn("reward", F.when(F.coalesce(good, F.lit(False)), 1.0).otherwise(0.0)).drop("formula", "fits", "value")
