"""Filter interaction audit: what each filter removes in every order of filters.

The orders form a trie whose edges are filters.  It is walked depth-first
over persisted survivors: a state is the set of filters applied so far, so
prefixes that hold the same filters in another order share one state, which
is made and counted once.  A state's rows are counted by the filters still to
come, which gives the removals at all its outgoing edges; 2^n states and
n * 2^(n-1) edges stand for the n! orders.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read

#: A separator of words, as a regular expression.
BETWEEN = r"[\x20\x09-\x0D]+"

EDGE_SCHEMA = "part string, kept long, removed array<struct<filter: int, n: long, lost: array<long>>>, state int"


def _counted(rows: DataFrame, left: list[int], marks: int) -> DataFrame:
    """part, kept (rows of it), removed: what each filter in left would take from it, and the marked rows among those."""
    lost = lambda i: ", ".join(f"count_if(f{i} AND m{k})" for k in range(marks))
    taken = ", ".join(f"named_struct('filter', {i}, 'n', count_if(f{i}), 'lost', cast(array({lost(i)}) AS array<bigint>))" for i in left)
    return rows.groupBy("part").agg(F.count("*").alias("kept"), F.expr(f"array({taken})").alias("removed"))


def _walk(rows: DataFrame, filters: int, marks: int, scratch: Scratch) -> DataFrame:
    """Counts of every state: part, kept, removed, state (bits of the filters applied)."""
    full, seen = (1 << filters) - 1, set()

    def visit(state: int, survivors: DataFrame) -> None:
        seen.add(state)
        left = [i for i in range(filters) if not state >> i & 1]
        if len(left) > 1:
            survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        scratch.save(_counted(survivors, left, marks), f"states/state={state}")
        for i in left:
            after = state | 1 << i
            if after not in seen and after != full:
                visit(after, survivors.filter(~F.col(f"f{i}")))
        survivors.unpersist()

    visit(0, rows)
    return rows.sparkSession.read.schema(EDGE_SCHEMA).parquet(f"{scratch.root}/states")


def audit_filters(docs: DataFrame, filters: dict[str, Column], part: Column, lost: dict[str, Column] | None = None) -> DataFrame:
    """Removals of filters in every order of them, for each part of docs.

    filters: a failure condition for each name (one character; null passes);
    part: a string (null: empty); lost: conditions (null: false) of rows whose
    loss is counted.  Returns part, filter_order, step (from 1), kept (rows
    after the step), removed (at it), redundant (rows that fail the filter
    and went before), unique_fails (rows that fail it alone), one column for
    each of lost (such rows removed at the step), shapley (removed by the
    step's filter, summed over all orders).  Every part has all orders and
    steps, with zeros where nothing is left.  Repeated rows count each for
    itself.  An empty table has no parts and gives an empty result.
    """
    lost, names = lost or {}, list(filters)
    scratch = Scratch(docs.sparkSession, "filter_audit")
    flag = lambda c: F.coalesce(c, F.lit(False))
    fails = [flag(c).alias(f"f{i}") for i, c in enumerate(filters.values())]
    rows = docs.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), *fails, *(flag(c).alias(f"m{k}") for k, c in enumerate(lost.values())))
    states = _walk(scratch.save(rows, "rows"), len(names), len(lost), scratch)
    return _orders(docs.sparkSession, states, names, list(lost))


def _orders(spark: SparkSession, states: DataFrame, names: list[str], lost: list[str]) -> DataFrame:
    """The result's rows from the counts of all states."""
    n = len(names)
    full, all_edges = (1 << n) - 1, [(s, i) for s in range((1 << n) - 1) for i in range(n) if not s >> i & 1]
    edges = states.select("part", "state", "kept", F.inline("removed")).withColumnRenamed("n", "removed")
    # a part that has no rows in a state has all its edges none the less
    grid = F.array(*(F.struct(F.lit(s).alias("state"), F.lit(i).alias("filter")) for s, i in all_edges))
    parts = states.filter("state = 0").select("part", F.inline(grid))
    none = F.array(*(F.lit(0).cast("long") for _ in lost)) if lost else F.array().cast("array<long>")
    edges = parts.join(edges, ["part", "state", "filter"], "left").select(
        "part", "state", "filter", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "removed")), F.coalesce("lost", none).alias("lost")
    )
    # an edge at depth d lies on d! * (n - 1 - d)! orders
    depth = F.bit_count(F.col("state"))
    orders_of = F.element_at(F.array(*(F.lit(factorial(d) * factorial(n - 1 - d)) for d in range(n))), depth + 1)
    all_but = F.element_at(F.array(*(F.lit(full - (1 << i)) for i in range(n))), F.col("filter") + 1)
    whole = edges.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("state") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("state") == all_but, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * orders_of).alias("shapley"),
    )
    steps = [
        ("".join(names[i] for i in order), k + 1, sum(1 << i for i in order[:k]), order[k])
        for order in permutations(range(n)) for k in range(n)
    ]
    steps = spark.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    out = edges.join(whole, ["part", "filter"]).join(F.broadcast(steps), ["state", "filter"])
    counts = {"kept": F.col("kept") - F.col("removed"), "removed": F.col("removed"), "redundant": F.col("fails") - F.col("removed"), "unique_fails": F.col("unique_fails")}
    counts |= {name: F.col("lost")[k] for k, name in enumerate(lost)} | {"shapley": F.col("shapley")}
    return out.select("part", "filter_order", "step", *(c.alias(name) for name, c in counts.items()))


def with_copies(facts: DataFrame) -> DataFrame:
    """facts (doc_id, digest and others) with copy: whether a smaller doc_id has the same digest anywhere.

    The least id of each digest meets the rows by digest and id together, so
    that the copies of one text spread over all partitions.  A null doc_id is
    no copy and makes none.
    """
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    return facts.join(first, ["digest", "doc_id"], "left").withColumn("copy", F.col("doc_id").isNotNull() & F.col("first").isNull())


def base_filters() -> dict[str, Column]:
    """Failure conditions of the query's five filters on n_words, n_distinct, n_upper, n_points, marked and copy."""
    return {
        "A": F.col("n_words") < 200,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * F.col("n_upper") > 2 * F.col("n_points"),
        "D": F.col("marked"),
        "E": F.col("copy"),
    }


def text_facts(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, n_words, n_distinct, n_upper, n_points and marked of every whole text (null: empty), and its SHA-256."""
    t = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(t, BETWEEN), "")
    d = docs.select(*keep, t.alias("_text"), words.alias("_words"))
    return d.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.length("_text").cast("long").alias("n_points"),
        F.col("_text").rlike("[#$%&*|]").alias("marked"),
        F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("digest"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five text filters on documents in all 120 orders; see `audit_filters`.

    A doc_id is good or toxic if any of its labels says so; a null doc_id has
    no label.  Null texts are empty ones.
    """
    docs = read(spark, sf_dir, "documents")
    facts = Scratch(spark, "filter_facts").save(text_facts(docs, "doc_id", "source"), "facts")
    labels = read(spark, sf_dir, "labels").filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    rows = with_copies(facts).join(labels, "doc_id", "left")
    return audit_filters(rows, base_filters(), F.col("source"), {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})


OP11_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
    FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
    SELECT part,
           (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
           + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
           + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask,
           coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
    FROM d JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
g AS (SELECT part, mask, count(*) AS n, count_if(good) AS n_good, count_if(toxic) AS n_toxic FROM f GROUP BY part, mask),
i AS (SELECT unnest(range(5))::INT AS i),
orders AS (
    SELECT a.i AS a, b.i AS b, c.i AS c, d.i AS d, e.i AS e,
           concat(chr(65 + a.i), chr(65 + b.i), chr(65 + c.i), chr(65 + d.i), chr(65 + e.i)) AS filter_order
    FROM i a, i b, i c, i d, i e
    WHERE (1 << a.i) | (1 << b.i) | (1 << c.i) | (1 << d.i) | (1 << e.i) = 31),
steps AS (
    SELECT filter_order, 1 AS step, 1 << a AS own, 0 AS before FROM orders
    UNION ALL SELECT filter_order, 2, 1 << b, 1 << a FROM orders
    UNION ALL SELECT filter_order, 3, 1 << c, (1 << a) | (1 << b) FROM orders
    UNION ALL SELECT filter_order, 4, 1 << d, (1 << a) | (1 << b) | (1 << c) FROM orders
    UNION ALL SELECT filter_order, 5, 1 << e, 31 - (1 << e) FROM orders),
counted AS (
    SELECT part, filter_order, step, own,
           sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN mask & before > 0 AND mask & own > 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN n_good ELSE 0 END) AS good_lost,
           sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN n_toxic ELSE 0 END) AS toxic_lost
    FROM g, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""
