"""Embedding, reranking and token losses as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return norm(d)


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def even_odd_pairs(rows: DataFrame, position: str, vector: str) -> DataFrame:
    """(pair, a, b): rows 2i and 2i + 1, in one shuffle; a last row without a partner is left out."""
    pair = F.floor(F.col(position) / 2).alias("pair")
    side = lambda k: F.max(F.when(F.col(position) % 2 == k, F.col(vector)))
    d = rows.groupBy(pair).agg(side(0).alias("a"), side(1).alias("b"))
    return d.filter(F.col("a").isNotNull() & F.col("b").isNotNull())


def contrastive(distance: Column, label: Column, margin: float = 0.5) -> Column:
    near = F.greatest(margin - distance, F.lit(0.0))
    return 0.5 * (label * distance * distance + (1 - label) * near * near)


def online_contrastive(pairs: DataFrame, margin: float = 0.5) -> DataFrame:
    """Sum of the hard pairs' losses; pairs: d, y.

    A negative is hard if nearer than the farthest positive (than the mean
    negative, with one positive at most); a positive if farther than the
    nearest negative (than the mean positive, likewise).
    """
    pos, neg = F.when(F.col("y") == 1, F.col("d")), F.when(F.col("y") == 0, F.col("d"))
    edges = pairs.agg(
        F.when(F.count(pos) > 1, F.max(pos)).otherwise(F.avg(neg)).alias("under"),
        F.when(F.count(neg) > 1, F.min(neg)).otherwise(F.avg(pos)).alias("over"),
    )
    d = pairs.crossJoin(F.broadcast(edges))  # a single row
    far = F.greatest(margin - F.col("d"), F.lit(0.0))
    hard_pos, hard_neg = (F.col("y") == 1) & (F.col("d") > F.col("over")), (F.col("y") == 0) & (F.col("d") < F.col("under"))
    return d.agg(
        F.coalesce(F.sum(F.when(hard_pos, F.col("d") * F.col("d")).when(hard_neg, far * far)), F.lit(0.0)).alias("loss"),
        F.count_if(hard_pos).alias("hard_positives"), F.count_if(hard_neg).alias("hard_negatives"),
    )


def info_nce(scores: DataFrame, temperature: float = 0.1, margin: float | None = None, negatives: int | None = None, in_group: bool = False) -> DataFrame:
    """(query, loss) from rows query, doc, sim, positive (one for each query) and, if looked at, kind and place.

    With a margin, documents more similar than the positive by over it are
    taken for unlabelled matches and left out.  kind says what a row compares:
    qd (as without the column), qq or dd, blocks that add to the denominators.
    place numbers a query's own negatives; in_group leaves only those, and
    `negatives` no more than the first so many of them.
    """
    d = scores if "place" in scores.columns else scores.withColumn("place", F.lit(None).cast("int"))
    if in_group:
        d = d.filter(F.col("positive") | F.col("place").isNotNull())
    if negatives is not None:
        d = d.filter(F.col("positive") | F.col("place").isNull() | (F.col("place") < negatives))
    own = d.groupBy("query").agg(F.max(F.when(F.col("positive"), F.col("sim"))).alias("pos"))
    d = d.join(own, "query").filter("pos is not null")
    if margin is not None:
        d = d.filter(F.col("positive") | (F.col("sim") <= F.col("pos") + margin))
    d = d.select("query", "pos", (F.col("sim") / temperature).alias("logit"))
    top = d.groupBy("query").agg(F.max("logit").alias("top"))
    d = d.join(top, "query")
    return d.groupBy("query").agg((F.first("top") + F.log(F.sum(F.exp(F.col("logit") - F.col("top")))) - F.first("pos") / temperature).alias("loss"))


def score_blocks(queries: DataFrame, docs: DataFrame, batch: str, own: bool = True, with_queries: bool = False, with_docs: bool = False) -> DataFrame:
    """(query, doc, kind, sim, positive) of each batch: queries against documents and, if asked, queries against
    the other queries (qq), and a query's positive document against the other documents (dd).

    queries: batch, query, v; docs: batch, doc, v, of (the query that it is
    the positive of, null for negatives).  A batch is bounded.
    """
    q = queries.select(F.col(batch).alias("batch"), "query", F.col("v").alias("a"))
    d = docs.select(F.col(batch).alias("batch"), "doc", "of", F.col("v").alias("b"))
    out = q.join(d, "batch").select("query", "doc", F.lit("qd").alias("kind"), cosine(F.col("a"), F.col("b")).alias("sim"), F.coalesce(F.col("of") == F.col("query"), F.lit(False)).alias("positive"))
    if with_queries:
        other = q.select("batch", F.col("query").alias("doc"), F.col("a").alias("b"))
        out = out.unionByName(q.join(other, "batch").filter("query <> doc").select("query", "doc", F.lit("qq").alias("kind"), cosine(F.col("a"), F.col("b")).alias("sim"), F.lit(False).alias("positive")))
    if with_docs:
        first = d.filter("of is not null").select("batch", F.col("of").alias("query"), F.col("doc").alias("mine"), F.col("b").alias("a"))
        rows = first.join(d.select("batch", "doc", "b"), "batch").filter("mine <> doc")
        out = out.unionByName(rows.select("query", "doc", F.lit("dd").alias("kind"), cosine(F.col("a"), F.col("b")).alias("sim"), F.lit(False).alias("positive")))
    return out


def embedding_groups(rows: DataFrame, position: str, label: str, by: str | None = None, negatives: int | None = None) -> DataFrame:
    """grp, place and role of rows in the order anchor, positive, negatives: a label 1 is a group's positive.

    The row before a positive is its anchor.  Of more than `negatives`
    negatives the first stay.  by: a column whose values are batches.
    """
    at = W.partitionBy(by).orderBy(position) if by else W.orderBy(position)
    after = F.lead(label).over(at)
    d = rows.withColumn("_anchor", F.coalesce(after == 1, F.lit(False))).withColumn("grp", F.sum(F.col("_anchor").cast("int")).over(at))
    keys = [by, "grp"] if by else ["grp"]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(position)) - 3
    role = F.when(place == -2, "anchor").when(place == -1, "positive").otherwise("negative")
    d = d.withColumn("place", place).withColumn("role", role).drop("_anchor")
    return d if negatives is None else d.filter(F.col("place") < negatives)


def bce_with_logits(logit: Column, label: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def groups_from_labels(rows: DataFrame, by: str, position: str, label: str) -> DataFrame:
    """grp: a new group starts at every label 1."""
    return rows.withColumn("grp", F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).over(W.partitionBy(by).orderBy(position)))


def listwise(rows: DataFrame, keys: list[str], logit: str, label: str, temperature: float = 1.0) -> DataFrame:
    """Softmax loss of the labelled row in each group of two rows or more."""
    d = rows.withColumn("z", F.col(logit) / temperature)
    w = W.partitionBy(*keys)
    d = d.withColumn("top", F.max("z").over(w))
    g = d.groupBy(*keys).agg(F.count("*").alias("size"), F.max(F.when(F.col(label) == 1, F.col("z"))).alias("target"), (F.first("top") + F.log(F.sum(F.exp(F.col("z") - F.col("top"))))).alias("lse"))
    return g.filter((F.col("size") >= 2) & F.col("target").isNotNull()).select(*keys, "size", (F.col("lse") - F.col("target")).alias("loss"))


def smooth_l1(d: Column, beta: float = 0.1) -> Column:
    a = F.abs(d)
    return F.when(a < beta, 0.5 * a * a / beta).otherwise(a - 0.5 * beta)


def spans(tokens: DataFrame, begin: str, end: str) -> DataFrame:
    """in_span: between a begin and the next end, neither included; rows rec, pos, kind, label (-100 is outside)."""
    last = F.last(F.when(F.col("kind").isin(begin, end), F.col("kind")), ignorenulls=True).over(W.partitionBy("rec").orderBy("pos"))
    inside = (last == begin) & ~F.col("kind").isin(begin, end) & (F.col("label") != -100)
    return tokens.withColumn("in_span", F.coalesce(inside, F.lit(False)))


def span_weighted(tokens: DataFrame, weight: float = 3.0) -> DataFrame:
    """(rec, ce, weighted): mean token loss, and with tokens in spans counted `weight` times; columns loss, label, in_span."""
    live = tokens.filter("label <> -100")
    w = F.when(F.col("in_span"), F.lit(weight)).otherwise(F.lit(1.0))
    return live.groupBy("rec").agg(F.avg("loss").alias("ce"), (F.sum(F.col("loss") * w) / F.sum(w)).alias("weighted"))


def box_weighted(tokens: DataFrame, weight: float = 3.0, share: float = 0.05) -> DataFrame:
    """One row: token loss with tokens in box spans counted `weight` times, and a share of the coordinates' smooth-L1.

    tokens: loss, label, in_span, and coord, truth: a coordinate token's
    predicted and true value in thousandths, null elsewhere.
    """
    live = tokens.filter("label <> -100")
    w = F.when(F.col("in_span"), F.lit(weight)).otherwise(F.lit(1.0))
    near = F.avg(smooth_l1((F.col("coord") - F.col("truth")) / 1000.0))
    return live.agg((F.sum(F.col("loss") * w) / F.sum(w) + share * F.coalesce(near, F.lit(0.0))).alias("loss"))


def loss_weights(content: Column, rules: list[tuple[str, float]], rest: float = 1.0) -> Column:
    """An array of (text, weight): a message cut where a rule's pattern matches, first rules first.

    A matched stretch has its rule's weight, what lies between the rest's.
    """
    none = F.lit(None).cast("double").alias("weight")

    def splitter(pattern: str, weight: float):
        def split(piece: Column) -> Column:
            hits = F.regexp_extract_all(piece["text"], F.lit(f"({pattern})"), F.lit(1))
            between = F.split(F.regexp_replace(piece["text"], pattern, "\u0000"), "\u0000", -1)
            parts = F.transform(between, lambda t, i: F.array(F.struct(t.alias("text"), none), F.struct(F.get(hits, i).alias("text"), F.lit(weight).cast("double").alias("weight"))))
            return F.when(piece["weight"].isNotNull(), F.array(piece)).otherwise(F.filter(F.flatten(parts), lambda p: p["text"].isNotNull() & (p["text"] != "")))

        return split

    cut = F.array(F.struct(content.alias("text"), none))
    for pattern, weight in rules:
        cut = F.flatten(F.transform(cut, splitter(pattern, weight)))
    return F.transform(cut, lambda p: F.struct(p["text"].alias("text"), F.coalesce(p["weight"], F.lit(rest)).alias("weight")))
