"""Mixing sources to target weights by hash-threshold histograms.

A document has a 60-bit hash; a source's budget beyond whole copies is met by
the documents under a hash threshold.  The threshold is found from a
histogram of words by source and leading hash digits: the bucket in which the
budget runs out is refined by the next digits, and only its rows are read on.
The final pass is a filter on the hash; documents are never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch, read

#: Weights of the sources in code-point order, repeated; null comes last.
WEIGHTS = (1, 2, 3)

#: No document is taken more often than this.
MOST_COPIES = 3

#: Bits that one level of the histogram resolves, and levels; together the hash.
DIGIT_BITS, LEVELS = 12, 5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_hash(*columns: str) -> Column:
    """60 bits that depend on the row's values alone."""
    key = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target for each source of (source, source_size).

    All sizes are shared out by weight; a target stops at `most` times its
    source's size and the excess is shared anew.  That ends at one level c
    with target = min(most * size, c * weight): sources in the order of
    most * size / weight are full until the level of the rest is lower.
    Exact sums of whole numbers come first, one division at the end.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    s = sizes.withColumn("weight", w)
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("full_at", F.col("cap") / F.col("weight"))
    before = W.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", left / share)
    # the first source that its level does not fill sets the level of all after it
    s = s.withColumn("c", F.min(F.when(F.col("level") < F.col("full_at"), F.struct(F.col("full_at"), F.col("level")))).over(whole)["level"])
    target = F.when(F.col("c").isNull() | (F.col("full_at") <= F.col("c")), F.col("cap").cast("double")).otherwise(F.col("c") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def find_thresholds(slim: DataFrame, scratch: Scratch, weights: tuple[int, ...], most: int) -> DataFrame:
    """For each source s: source_size, target, whole copies, the hash `top` at which its
    budget runs out, the words of that hash and how many of them fit.

    slim: source, size, h.
    """
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, most)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("copies", copies).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    plan = scratch.save(plan, "targets")

    # state: a source's open hash range [lo, lo + width) and the budget left for it
    state = plan.filter(F.col("budget") > 0).select("source", F.lit(0).cast("long").alias("lo"), "budget")
    for level in range(LEVELS):
        shift = DIGIT_BITS * (LEVELS - 1 - level)
        digit = F.shiftright(F.col("h"), shift) if shift else F.col("h")
        p = F.shiftright(F.col("h"), shift + DIGIT_BITS) if level else F.lit(0).cast("long")
        rows = slim.select("source", "size", digit.alias("digit"), p.alias("prefix"))
        own = state.select(F.col("source").alias("s"), "lo", "budget")
        rows = rows.join(own, _same(F.col("source"), F.col("s")) & (F.col("prefix") == F.col("lo")))
        hist = rows.groupBy("source", "digit").agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
        up_to = W.partitionBy("source").orderBy("digit")
        hist = hist.withColumn("before", F.sum("words").over(up_to) - F.col("words"))
        # the last bucket that starts within the budget; with none over it, the last of all
        last = F.max(F.when(F.col("before") <= F.col("budget"), F.struct("digit", "before", "words", "budget")))
        state = hist.groupBy("source").agg(last.alias("b"))
        state = state.select("source", F.col("b.digit").alias("lo"), (F.col("b.budget") - F.col("b.before")).alias("budget"), F.col("b.words").alias("words"))
        state = scratch.save(state, f"level{level}")
    # lo is now one hash, of which the words that fit are taken
    edge = state.select(F.col("source").alias("s"), F.col("lo").alias("top"), F.least(F.col("budget"), F.col("words").cast("double")).alias("fits"), "words")
    plan = plan.join(edge, _same(plan["source"], edge["s"]), "left")
    return scratch.save(plan.select(F.col("source").alias("s"), "source_size", "target", "copies", "top", "fits", "words"), "thresholds")


def _taken() -> Column:
    part = F.floor(F.col("size") * F.col("fits") / F.col("words"))
    more = F.when(F.col("h") < F.col("top"), F.col("size")).when((F.col("h") == F.col("top")) & (F.col("words") > 0), part).otherwise(0)
    return (F.col("size") * F.col("copies") + more).cast("long")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: docs with each row as often as `mix_sources` takes it.

    A part of a copy is a row with the text's first words, joined by one
    space, and n_chars of that, if docs has the column.  Rows without words
    are not in the mix.  Columns are those of docs.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    marks = F.struct(word_count(docs["text"]).alias("size"), order_hash("doc_id", "text").alias("h"))
    slim = scratch.save(docs.select("source", marks.alias("m")).select("source", "m.size", "m.h"), "sizes")
    plan = find_thresholds(slim, scratch, weights, most)
    plan = plan.select("s", F.struct("copies", "top", "fits", "words").alias("_plan"))
    row = F.struct(*(docs[c] for c in docs.columns)).alias("_row")
    out = docs.select(row, marks.alias("_marks")).join(plan, _same(F.col("_row.source"), F.col("s")))
    out = out.select("_row", "_marks.*", "_plan.*").select("_row", "size", _taken().alias("taken")).filter("taken > 0")
    full, rest = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), full.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    out = out.select("_row", F.explode(copies).alias("first"))
    begin = F.array_join(F.slice(F.regexp_extract_all(F.col("_row.text"), F.lit(WORD), F.lit(0)), 1, F.col("first").cast("int")), " ")
    text = F.when(F.col("first") > 0, begin).otherwise(F.col("_row.text"))
    own = {"text": text}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("first") > 0, F.length(begin).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return out.select(*(own.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """How many words of each document the mix takes.

    docs: doc_id, text, source; other columns are ignored.  Returns doc_id,
    size (words of the text; a null text has none), source_size, target, and
    taken, `most` times size at the most.  Every document is taken
    floor(target / source_size) times, and once more if its hash is under the
    source's threshold; of the one document at the threshold its first words
    fill the budget.  Equal rows share a hash and are taken alike.  A null
    source is a source.  A source without words has target 0.  An empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    slim = scratch.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_hash("doc_id", "text").alias("h")), "sizes")
    plan = find_thresholds(slim, scratch, weights, most)
    out = slim.join(plan, _same(slim["source"], plan["s"]))
    return out.select("doc_id", "size", "source_size", "target", _taken().alias("taken"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))


#: DuckDB: the same thresholds by sorting all hashes.
OP10_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
a AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
b AS (SELECT *, source_size * {MOST_COPIES} AS cap, source_size * {MOST_COPIES} / weight AS full_at FROM a),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
      FROM b WINDOW o AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT arg_min(level, full_at) AS c FROM l WHERE level < full_at),
t AS (SELECT source, source_size, CASE WHEN c IS NULL OR full_at <= c THEN cap::DOUBLE ELSE c * weight END AS target FROM l, c),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t),
e AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
f AS (SELECT e.*, sum(words) OVER (PARTITION BY e.source ORDER BY h) - words AS before, target - copies * source_size AS budget
      FROM e JOIN u ON e.source IS NOT DISTINCT FROM u.source),
g AS (SELECT source, h, words, least(budget - before, words::DOUBLE) AS fits FROM f)
SELECT d.doc_id, d.size, u.source_size, u.target, (d.size * u.copies + CASE WHEN fits >= words THEN d.size
         WHEN fits > 0 THEN floor(d.size * fits / words) ELSE 0 END)::BIGINT AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.h = g.h
"""
