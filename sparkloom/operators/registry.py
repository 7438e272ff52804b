"""Named rewards, losses and tool signatures."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import losses, rewards

#: A reward of a rollout's row, as a column of its reported components.
REWARDS: dict[str, Callable[[], Column]] = {}

#: A loss of a table, as a table with its value; the columns it reads stand in its docstring.
LOSSES: dict[str, Callable[..., DataFrame]] = {}


def register_reward(name: str, column: Callable[[], Column]) -> None:
    REWARDS[name] = column


def register_loss(name: str, loss: Callable[..., DataFrame]) -> None:
    LOSSES[name] = loss


def _component(name: str) -> Callable[[], Column]:
    return lambda: rewards.safe(F.col(name))


# The names under which rewards are asked for.
for _name in ("dice", "key_dice", "bbox_iou", "dice_gain", "coverage", "nav_style", "efficiency"):
    register_reward(f"phase3_{_name}", _component(f"r_{_name}"))
register_reward("phase3_format_gate", _component("gate"))
register_reward("phase3_combined", lambda: rewards.combined(F.col("gate"), F.lit(1.0)))


def with_rewards(rows: DataFrame, names: list[str], weights: list[float] | None = None) -> DataFrame:
    """rows with a column for each named reward and, with weights, their weighted sum as `reward`."""
    d = rows.select("*", *(REWARDS[n]().alias(n) for n in names))
    return d if weights is None else d.withColumn("reward", rewards.weighted_sum(dict(zip(names, weights, strict=True))))


def _pair_mean(value: Callable[[], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda pairs: pairs.agg(F.avg(value()).alias("loss"))


# The names under which losses are asked for.
register_loss("cosine_similarity", _pair_mean(lambda: (1 - F.col("d") - F.col("y")) * (1 - F.col("d") - F.col("y"))))
register_loss("contrastive", _pair_mean(lambda: losses.contrastive(F.col("d"), F.col("y"))))
register_loss("online_contrastive", lambda pairs: losses.online_contrastive(pairs).select("loss"))
register_loss("infonce", lambda scores, **k: losses.info_nce(scores, **k).agg(F.avg("loss").alias("loss")))
register_loss("reranker", _pair_mean(lambda: losses.bce_with_logits(F.col("logit"), F.col("label"))))
register_loss("listwise_reranker", lambda rows: losses.listwise(rows, ["grp"], "logit", "label").agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss")))
register_loss("cross_entropy", lambda tokens: tokens.filter("label <> -100").agg(F.avg("loss").alias("loss")))
register_loss("mri_bbox", lambda tokens: losses.box_weighted(tokens))

_INT = T.IntegerType()
_BOX = T.ArrayType(_INT)

#: The arguments of each tool.
TOOLS: dict[str, T.StructType] = {
    "get_slice": T.StructType([T.StructField("z_index", _INT, False)]),
    "scroll": T.StructType([T.StructField("delta", _INT, False)]),
    "add_bbox": T.StructType([T.StructField("z_index", _INT, False), T.StructField("bbox", _BOX, False)]),
    "run_medsam2": T.StructType([T.StructField("key_z", _INT, False), T.StructField("bbox", _BOX, False)]),
    "add_point": T.StructType([T.StructField("z_index", _INT, False), T.StructField("points", T.ArrayType(_BOX), False), T.StructField("labels", T.ArrayType(_INT), False)]),
    "finish_bbox_annotation": T.StructType(),
    "finish_3d_segmentation": T.StructType(),
}

FORMS = {
    "boxes": ("add_bbox", "finish_bbox_annotation"),
    "masks": ("add_bbox", "run_medsam2", "add_point", "finish_3d_segmentation"),
    "navigation": ("get_slice", "scroll", "add_bbox", "run_medsam2", "add_point", "finish_3d_segmentation"),
}


def _schema(kind: T.DataType) -> dict:
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: _schema(f.dataType) for f in kind}, "required": [f.name for f in kind if not f.nullable]}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": _schema(kind.elementType)}
    return {"type": {"int": "integer", "bigint": "integer", "double": "number", "string": "string", "boolean": "boolean"}[kind.simpleString()]}


def tools_json(form: str, descriptions: dict[str, str] | None = None) -> str:
    """The signatures of a form's tools, as they stand in a record's tools."""
    texts = descriptions or {}
    calls = [{"name": n, **({"description": texts[n]} if n in texts else {}), "parameters": _schema(TOOLS[n])} for n in FORMS[form]]
    return json.dumps([{"type": "function", "function": c} for c in calls])


def arguments_of(content: Column, tool: str) -> Column:
    """The arguments of a tool call's JSON as a struct; its fields are null where the JSON does not fit."""
    return F.from_json(F.get_json_object(content, "$.arguments"), TOOLS[tool])
