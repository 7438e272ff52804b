"""Learned decision lists over document statistics, in DataFrame functions alone.

Statistics of a text are computed inside its row; nothing is exploded or
shuffled.  Rules are learned by sequential covering on a bounded sample of
labelled rows: a rule grows by the threshold condition of the highest
information gain until it covers no good document of the growing part, is cut
back to the conditions that serve best on the pruning part, and the documents
it covers are set aside for the next.  Only histograms of the sample reach
the driver.  The list becomes one ordered CASE expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, read

#: Words of a window in the repetition count, and the base limits.
REPEAT_WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

SYMBOLS, SPACES, UPPER = "#*$%&|<>", " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Labelled documents of each class in the sample, about; thresholds tried for each statistic.
SAMPLE_DOCUMENTS, CUTS = 4000, 32

#: Conditions of a rule at most; least share of bad documents among those a rule covers, and least documents.
CONDITIONS, PRECISION, COVER = 3, 0.9, 5

RATES = ("word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "exclaim_rate", "distinct_rate", "line_words", "n_words")


def _count(text: Column, signs: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, signs, ""))).cast("long")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where the optimizer copies the whole."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(hashes: Column) -> Column:
    """Words that lie in windows which occur twice or more, from the words' hashes."""
    k = REPEAT_WINDOW

    def twins(ranked: Column) -> Column:
        """Starts of windows that have an equal one beside them in order, ascending."""
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        own = F.transform(ranked, lambda x, i: F.when(same(x, F.get(ranked, i - 1)) | same(x, F.get(ranked, i + 1)), x["i"]))
        return F.array_sort(F.filter(own, lambda x: x.isNotNull()))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(starts, i + 1) - x, F.lit(k))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def counted(windows: Column) -> Column:
        ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # only texts with two equal windows are looked at further
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(_let(ranked, twins), covered))

    windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (k - 1)), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(k))))
    return F.when(F.size(hashes) < k, F.lit(0)).otherwise(_let(windows, counted))


def text_statistics(docs: DataFrame) -> DataFrame:
    """docs with the whole-text statistics of each text; a null text counts as empty."""

    def words(w: Column) -> Column:
        of = lambda h: F.struct(F.size(h).alias("n"), F.size(F.array_distinct(h)).alias("distinct"), _repeated(h).alias("repeated"))
        return _let(F.transform(w, lambda x: F.xxhash64(x)), of)

    text = F.coalesce(F.col("text"), F.lit(""))
    filled = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    lines = _let(filled, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("equal")))
    d = docs.withColumn("_words", _let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), words)).withColumn("_lines", lines)
    d = d.select(
        *(docs[c] for c in docs.columns),
        F.col("_words.n").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).alias("n_symbols"),
        F.col("_lines.equal").cast("long").alias("n_dup_lines"),
        F.col("_words.repeated").cast("long").alias("n_repeat_words"),
        F.col("_lines.n").cast("long").alias("n_lines"),
        _count(text, UPPER).alias("n_upper"),
        _count(text, "!").alias("n_exclaims"),
        F.col("_words.distinct").cast("long").alias("n_distinct"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def with_rates(stats: DataFrame) -> DataFrame:
    """The statistics that rules look at, as doubles without nulls."""
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    pairs = {
        "word_length": ("word_chars", "n_words"),
        "symbol_rate": ("n_symbols", "word_chars"),
        "dup_line_rate": ("n_dup_lines", "n_lines"),
        "repeat_rate": ("n_repeat_words", "n_words"),
        "upper_rate": ("n_upper", "word_chars"),
        "exclaim_rate": ("n_exclaims", "n_words"),
        "distinct_rate": ("n_distinct", "n_words"),
        "line_words": ("n_words", "n_lines"),
    }
    return stats.withColumn("rates", F.struct(*(rate(*p).alias(r) for r, p in pairs.items()), F.col("n_words").cast("double").alias("n_words")))


#: A condition: statistic, True for at least and False for under, threshold.
Condition = tuple[str, bool, float]


def condition_column(c: Condition) -> Column:
    value = F.col(f"rates.{c[0]}")
    return value >= c[2] if c[1] else value < c[2]


def rule_column(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & condition_column(c)
    return out


def _histogram(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """For each statistic the bad and good rows between its cuts, in one aggregation."""
    place = lambda r: F.size(F.filter(F.array(*(F.lit(x) for x in cuts[r])), lambda t: t <= F.col(f"rates.{r}")))
    used = [r for r in RATES if cuts[r]]
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), place(r).alias("at")) for r in used)))
    counted = rows.select("bad", each.alias("e")).groupBy("e.rate", "e.at").agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
    out = {r: [(0, 0)] * (len(cuts[r]) + 1) for r in used}
    for r in counted.collect():
        out[r["rate"]][r["at"]] = (int(r["bad"]), int(r["n"]) - int(r["bad"]))
    return out


def _information(p: float, n: float) -> float:
    return math.log2(p / (p + n)) if p else 0.0


def best_condition(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[Condition | None, int, int]:
    """The condition of the highest gain on the rows, and the bad and good rows it leaves."""
    best: tuple = (0.0, None, 0, 0)
    for rate, cells in _histogram(rows, cuts).items():
        bad, good = sum(c[0] for c in cells), sum(c[1] for c in cells)
        low_bad = low_good = 0
        for i, cut in enumerate(cuts[rate]):
            low_bad, low_good = low_bad + cells[i][0], low_good + cells[i][1]
            for above, p, n in ((True, bad - low_bad, good - low_good), (False, low_bad, low_good)):
                gain = p * (_information(p, n) - _information(bad, good)) if p else 0.0
                if gain > best[0] + 1e-9:
                    best = (gain, (rate, above, cut), p, n)
    return best[1], best[2], best[3]


def learn_rules(sample: DataFrame) -> list[list[Condition]]:
    """Ordered rules for rejecting, from rows with rates, bad (0 or 1) and part (0: grow, 1: grow, 2: prune)."""
    shares = [i / CUTS for i in range(1, CUTS)]
    points = sample.select(*(F.percentile_approx(f"rates.{r}", shares, 10_000).alias(r) for r in RATES)).first()
    cuts = {r: sorted(set(points[r] or [])) for r in RATES}
    rules: list[list[Condition]] = []
    if not any(cuts.values()):
        return rules
    rest = sample
    while True:  # each rule takes COVER rows or more out of the sample
        rows, rule = rest.filter("part < 2"), []
        while len(rule) < CONDITIONS:
            new, p, n = best_condition(rows, cuts)
            if new is None:
                break
            rule.append(new)
            rows = rows.filter(condition_column(new))
            if not n:
                break
        if not rule:
            break
        # prune: the leading conditions that are worth most on the rows not grown on
        worth = []
        for k in range(1, len(rule) + 1):
            hit = rule_column(rule[:k])
            worth += [F.sum(F.when(hit & (F.col("part") == 2), 1).otherwise(0)), F.sum(F.when(hit & (F.col("part") == 2), F.col("bad")).otherwise(0))]
            worth += [F.sum(F.when(hit, 1).otherwise(0)), F.sum(F.when(hit, F.col("bad")).otherwise(0))]
        found = [x or 0 for x in rest.select(*(w.alias(f"w{i}") for i, w in enumerate(worth))).first()]
        value = lambda k: (found[4 * k + 1] + 1) / (found[4 * k] + 2)  # noqa: E731, B023
        keep = max(range(len(rule)), key=lambda k: (value(k), -k))
        covered, bad = found[4 * keep + 2], found[4 * keep + 3]
        rule = rule[: keep + 1]
        if covered < COVER or bad < PRECISION * covered:
            break
        rules.append(rule)
        rest = rest.filter(~rule_column(rule))
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Rates of about `sample` labelled documents of each class that pass the base limits.

    The sampled labels, some `2 * sample` rows whatever the input, are broadcast.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sizes = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    share = F.when(F.col("quality") == 1, F.lit(min(1.0, sample / max(1, sizes.get(1, 0))))).otherwise(F.lit(min(1.0, sample / max(1, sizes.get(0, 0)))))
    few = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * sample)
    few = scratch.save(few, "labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    rows = scratch.save(with_rates(text_statistics(rows)), "rated").filter(~F.col("base_failed"))
    part = F.pmod(F.xxhash64(F.lit(1), F.col("doc_id")), F.lit(3))
    return scratch.save(rows.select("rates", (1 - F.col("quality")).alias("bad"), part.alias("part")), "sample")


def apply_rules(stats: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """stats with rule, the number of the first rule that covers a row (null: none), and kept."""
    rule = F.lit(None).cast("int")
    for i in range(len(rules) - 1, -1, -1):
        rule = F.when(rule_column(rules[i]), F.lit(i + 1)).otherwise(rule)
    rated = with_rates(stats).withColumn("rule", rule)
    return rated.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop("rates")


def judge_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """doc_id, the statistics of its text, base_failed, rule and kept.

    docs: doc_id, text; labels: doc_id, quality (1 good, 0 bad; of several the
    lowest counts, null ones do not).  A null text counts as empty and fails
    the base limits.  Without labels no rule is learned and the base limits
    decide.  Equal rows get equal results.  Long texts are read whole.  Other
    columns are ignored.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rules = learn_rules(labelled_sample(docs, labels, scratch, sample))
    return apply_rules(text_statistics(docs.select("doc_id", "text")), rules).drop("text")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
