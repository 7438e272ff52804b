"""Replay and judgement of tool-call traces.

A trace is the calls of a record in order: rec, pos, name, z, delta.  The
slice pointer saturates at both ends, which no running sum can express; it is
a fold over the record's ordered calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import ordered

STEP = "struct<pos:bigint,name:string,z:int,delta:int,ptr:int,clamped:boolean,ok:boolean>"


def pointer_steps(calls: DataFrame, slices: int = 10) -> DataFrame:
    """Each call with the pointer after it, whether it was clamped, and whether the call was valid.

    get_slice sets the pointer if z is sampled (0 <= z < slices); scroll moves
    it unless it is unset or delta is 0; both leave it alone otherwise.
    add_bbox and add_point are valid on the slice that is viewed.
    """
    seq = calls.groupBy("rec").agg(ordered(F.struct("pos", "name", "z", "delta")).alias("s"))
    begin = F.struct(F.lit(None).cast("int").alias("ptr"), F.array().cast(f"array<{STEP}>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        target = s["ptr"] + x["delta"]
        moved = F.least(F.greatest(target, F.lit(0)), F.lit(slices - 1))
        jump, scroll = x["name"] == "get_slice", x["name"] == "scroll"
        known = (x["z"] >= 0) & (x["z"] < slices)
        can = s["ptr"].isNotNull() & (x["delta"] != 0)
        ptr = F.when(jump & known, x["z"]).when(scroll & can, moved).otherwise(s["ptr"])
        clamped = scroll & can & F.coalesce(moved != target, F.lit(False))
        ok = F.when(jump, known).when(scroll, can).when(x["name"].isin("add_bbox", "add_point"), F.coalesce(s["ptr"] == x["z"], F.lit(False))).otherwise(x["name"] != "malformed")
        row = F.struct(x["pos"].alias("pos"), x["name"].alias("name"), x["z"].alias("z"), x["delta"].alias("delta"), ptr.alias("ptr"), clamped.alias("clamped"), ok.alias("ok"))
        return F.struct(ptr.alias("ptr"), F.concat(s["out"], F.array(row.cast(STEP))).alias("out"))

    return seq.select("rec", F.explode(F.aggregate("s", begin, step)["out"]).alias("m")).select("rec", "m.*")


def _sofar(order: str = "pos") -> W:
    return W.partitionBy("rec").orderBy(order).rowsBetween(W.unboundedPreceding, 0)


def histories(steps: DataFrame, slices: int = 10) -> DataFrame:
    """Visited, annotated and still unvisited slices after each valid step."""
    d = steps.filter("ok")
    visited = F.array_sort(F.collect_set(F.when(F.col("name").isin("get_slice", "scroll"), F.col("ptr"))).over(_sofar()))
    annotated = F.array_sort(F.collect_set(F.when(F.col("name") == "add_bbox", F.col("ptr"))).over(_sofar()))
    d = d.withColumn("visited", visited).withColumn("annotated", annotated)
    return d.withColumn("unvisited", F.array_except(F.sequence(F.lit(0), F.lit(slices - 1)), "visited"))


def gate_violations(calls: DataFrame, slices: int = 10) -> DataFrame:
    """(rec, violations): all rules that a trace breaks, in call order, then those on its whole."""
    seq = calls.groupBy("rec").agg(ordered(F.struct("pos", "name", "z", "delta")).alias("s"))
    begin = F.struct(
        F.lit(None).cast("int").alias("ptr"), F.lit(False).alias("seen"), F.lit(0).alias("i"), F.lit(0).alias("runs"), F.lit(0).alias("ends"),
        F.lit(-1).alias("end"), F.array().cast("array<string>").alias("out"),
    )

    def step(s: Column, x: Column) -> Column:
        name, known = x["name"], (x["z"] >= 0) & (x["z"] < slices)
        ptr = F.when((name == "get_slice") & known, x["z"]).when((name == "scroll") & s["ptr"].isNotNull(), F.least(F.greatest(s["ptr"] + x["delta"], F.lit(0)), F.lit(slices - 1)))
        why = (
            F.when((name == "scroll") & ~s["seen"], F.lit("scroll_before_first_get_slice"))
            .when(name.isin("add_bbox", "add_point") & ~F.coalesce(s["ptr"] == x["z"], F.lit(False)), F.concat(name, F.lit("_z_mismatch_at_"), s["i"].cast("string")))
            .when((name == "run_medsam2") & ~known, F.lit("run_medsam2_key_z_not_in_sampled"))
        )
        return F.struct(
            F.coalesce(ptr, s["ptr"]).alias("ptr"), (s["seen"] | (name == "get_slice")).alias("seen"), (s["i"] + 1).alias("i"),
            (s["runs"] + (name == "run_medsam2").cast("int")).alias("runs"), (s["ends"] + (name == "finish").cast("int")).alias("ends"),
            F.when(name == "finish", s["i"]).otherwise(s["end"]).alias("end"), F.when(why.isNotNull(), F.concat(s["out"], F.array(why))).otherwise(s["out"]).alias("out"),
        )

    d = seq.select("rec", F.aggregate("s", begin, step).alias("f"))
    runs = F.when(F.col("f.runs") != 1, F.concat(F.lit("run_medsam2_count="), F.col("f.runs").cast("string")))
    ends = F.when(F.col("f.ends") != 1, F.concat(F.lit("finish_count="), F.col("f.ends").cast("string"))).when(F.col("f.end") != F.col("f.i") - 1, F.lit("finish_not_last"))
    whole = F.filter(F.array(runs, ends), lambda x: x.isNotNull())
    return d.select("rec", F.concat("f.out", whole).alias("violations"))


def first_failure(rules: list[tuple[Column, str]]) -> Column:
    """The reason of the first rule that is broken, ok if none is."""
    out = F.lit("ok")
    for broken, reason in reversed(rules):
        out = F.when(broken, reason).otherwise(out)
    return out


def validate_traces(steps: DataFrame) -> DataFrame:
    """(rec, reason) by the look-then-write rules of a trace, the first broken one.

    An annotation, box or point, must be on the slice that the last move went
    to, if that was a get_slice; a scroll or a propagation since then lifts
    the rule.
    """
    moves = ("get_slice", "scroll", "run_medsam2")
    first = F.min(F.when(F.col("name").isin("get_slice", "scroll"), F.struct("pos", "name")))["name"]
    last = F.max(F.struct("pos", "name"))["name"]
    seen = W.partitionBy("rec").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    moved = F.last(F.when(F.col("name").isin(*moves), F.struct("name", "z")), ignorenulls=True).over(seen)
    d = steps.withColumn("moved", moved)
    wrong = F.col("name").isin("add_bbox", "add_point") & (F.col("moved.name") == "get_slice") & (F.col("moved.z") != F.col("z"))
    g = d.groupBy("rec").agg(
        F.count_if(F.col("name") == "malformed").alias("bad"), F.count_if(F.col("name") == "run_medsam2").alias("runs"), F.count_if((F.col("name") == "scroll") & (F.col("delta") == 0)).alias("still"),
        F.count_if(wrong).alias("blind"), F.count_if(F.col("name") == "finish").alias("ends"), first.alias("first"), last.alias("last"),
    )
    rules = [
        (F.col("bad") > 0, "malformed call"), (F.col("runs") > 1, "run_medsam2 more than once"), (F.col("still") > 0, "scroll by 0"),
        (F.coalesce(F.col("first") != "get_slice", F.lit(False)), "first navigation is not get_slice"), (F.col("blind") > 0, "annotation of a slice not viewed"),
        (F.col("ends") != 1, "not one finish"), (F.col("last") != "finish", "finish is not last"),
    ]
    return g.select("rec", first_failure(rules).alias("reason"))
