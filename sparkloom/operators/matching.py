"""Matching of predicted to true boxes, record by record.

Every record's candidates meet by its key; the greedy choice is a fold over
the record's ordered candidates, so nothing is matched across records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import ordered
from ..functions.geometry import box_iou, box_of, center

_BOX = ("x1", "y1", "x2", "y2")


def pair_iou(gt: DataFrame, pr: DataFrame) -> DataFrame:
    """(rec, g, p, iou) for every true and predicted box of a record."""
    a = gt.select("rec", "g", F.struct(*_BOX).alias("a"))
    b = pr.select("rec", "p", F.struct(*_BOX).alias("b"))
    return a.join(b, "rec").select("rec", "g", "p", box_iou(box_of("a"), box_of("b")).alias("iou"))


def greedy_global(pairs: DataFrame) -> DataFrame:
    """One-to-one matches by falling IoU (ties: g, p).  There is no floor: pairs without overlap match too."""
    c = pairs.groupBy("rec").agg(ordered(F.struct((-F.col("iou")).alias("k"), "g", "p", "iou")).alias("c"))
    match = "array<struct<g:bigint,p:bigint,iou:double>>"
    free = lambda s, x: ~F.exists(s, lambda m: (m["g"] == x["g"]) | (m["p"] == x["p"]))
    put = lambda s, x: F.when(free(s, x), F.concat(s, F.array(F.struct(x["g"].alias("g"), x["p"].alias("p"), x["iou"].alias("iou"))).cast(match))).otherwise(s)
    return c.select("rec", F.explode(F.aggregate("c", F.array().cast(match), put)).alias("m")).select("rec", "m.*")


def greedy_sequential(pairs: DataFrame, threshold: float) -> DataFrame:
    """(rec, p, g, iou, hit): each prediction in order takes the best true box still free.

    A hit needs an overlap and an IoU of the threshold.  Only hits use up a box.
    """
    order = F.transform(ordered(F.struct("g", "iou")), lambda x: x)
    by_p = pairs.groupBy("rec", "p").agg(order.alias("c"))
    seq = by_p.groupBy("rec").agg(ordered(F.struct("p", "c")).alias("s"))
    state = "struct<used:array<bigint>,out:array<struct<p:bigint,g:bigint,iou:double,hit:boolean>>>"

    def step(s, x):
        open_ = F.filter(x["c"], lambda c: ~F.array_contains(s["used"], c["g"]) & (c["iou"] > 0))
        best = F.array_max(F.transform(open_, lambda c: F.struct(c["iou"].alias("iou"), (-c["g"]).alias("g"))))
        hit = F.coalesce(best["iou"] >= threshold, F.lit(False))
        row = F.struct(x["p"].alias("p"), (-best["g"]).alias("g"), F.coalesce(best["iou"], F.lit(0.0)).alias("iou"), hit.alias("hit"))
        used = F.when(hit, F.concat(s["used"], F.array(-best["g"]))).otherwise(s["used"])
        return F.struct(used.alias("used"), F.concat(s["out"], F.array(row)).alias("out")).cast(state)

    begin = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<p:bigint,g:bigint,iou:double,hit:boolean>>").alias("out")).cast(state)
    return seq.select("rec", F.explode(F.aggregate("s", begin, step)["out"]).alias("m")).select("rec", "m.*")


def nearest_centers(gt: DataFrame, pr: DataFrame) -> DataFrame:
    """(rec, p, g, dx, dy, distance) to the true box of the nearest centre; the first one on ties."""
    a = gt.select("rec", "g", F.struct(*_BOX).alias("a"))
    b = pr.select("rec", "p", F.struct(*_BOX).alias("b"))
    (ax, ay), (bx, by) = center(box_of("a")), center(box_of("b"))
    d = a.join(b, "rec").select("rec", "p", "g", (bx - ax).alias("dx"), (by - ay).alias("dy"))
    near = F.min(F.struct(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("distance"), "g", "dx", "dy"))
    return d.groupBy("rec", "p").agg(near.alias("n")).select("rec", "p", "n.g", "n.dx", "n.dy", "n.distance")


def fifo_pairs(messages: DataFrame, asks: str, answers: str) -> DataFrame:
    """(rec, ask_pos, answer_pos): the k-th answer belongs to the k-th ask.

    messages: rec, pos, role.  An answer that comes while no ask is open is
    dropped and answers nothing later.
    """
    both = messages.filter(F.col("role").isin(asks, answers))
    seq = both.groupBy("rec").agg(ordered(F.struct("pos", "role")).alias("s"))
    state = "struct<open:array<bigint>,out:array<struct<ask_pos:bigint,answer_pos:bigint>>>"

    def step(s, x):
        ask = x["role"] == asks
        pair = F.array(F.struct(F.get(s["open"], F.lit(0)).alias("ask_pos"), x["pos"].cast("bigint").alias("answer_pos")))
        fits = ~ask & (F.size(s["open"]) > 0)
        rest = F.when(ask, F.concat(s["open"], F.array(x["pos"].cast("bigint")))).when(fits, F.slice(s["open"], 2, F.size(s["open"]))).otherwise(s["open"])
        return F.struct(rest.alias("open"), F.when(fits, F.concat(s["out"], pair)).otherwise(s["out"]).alias("out")).cast(state)

    begin = F.struct(F.array().cast("array<bigint>").alias("open"), F.array().cast("array<struct<ask_pos:bigint,answer_pos:bigint>>").alias("out")).cast(state)
    return seq.select("rec", F.explode(F.aggregate("s", begin, step)["out"]).alias("m")).select("rec", "m.*")


def last_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row that comes last for each key: later entries overwrite earlier ones."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("m")).select(*keys, f"m.{order}", *(f"m.{c}" for c in rest))


def ranked(rows: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order) if by else W.orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w))
