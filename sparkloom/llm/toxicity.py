"""Toxicity by a weighted lexicon.

Words are folded: case, accents, compatibility forms, look-alike letters of
other scripts, digits and signs put for letters, marks between letters.  The
lexicon holds folded words and word beginnings, each with the log of how much
more often documents labelled toxic have it; it is learned from a bounded
sample of labelled rows.  Exception phrases, a lexicon word with the word
before or after it, are those that the clean documents of the sample have and
the toxic ones do not: inside them the word does not count.  One Aho-Corasick
automaton finds both in a text.  The weights found, in all and against the
text's length, go through a logistic curve fitted on the same sample.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunks, read, row_crc, split_words

#: Documents with this remainder of crc32(doc_id) are not learned from.
FOLDS, HELD_OUT = 4, 2

#: Labelled documents of each class in the sample, about.
SAMPLE_DOCUMENTS = 3000

#: Lengths of word beginnings in the lexicon, and its entries at most, the surest first; sf0.1 has 10.
BEGINNINGS = (4, 5, 6)
LEXICON = 20_000

#: The least log odds of an entry, also less DEVIATIONS standard errors, and its least toxic documents.
LEAST_WEIGHT, LEAST_SURE, DEVIATIONS, LEAST_DOCUMENTS = 2.5, 1.0, 2.33, 4

#: Exception phrases at most, the commonest first, and the least clean documents of one.
EXCEPTIONS, LEAST_CLEAN = 20_000, 3

#: Cells to the unit in which a sample's features are counted for the fit.
GRID = 64

THRESHOLD = 0.3

# Letters that look like a Latin one, and signs put for letters.
HOMOGLYPHS = {
    ord(pair[0]): pair[1]
    for pair in (
        "аa вb еe кk мm нh оo рp сc тt уy хx іi јj ѕs ԁd һh ԛq ԝw ɡg "
        "αa βb εe ιi κk νv οo ρp τt υu χx ωw ϲc ıi łl øo đd ðd þp ɑa ɩi"
    ).split()
}
SIGNS = str.maketrans("0134578@$", "oieastbas")


def fold(word: str) -> str:
    """A word's folded form, only letters and digits; may be empty."""
    w = word.lower()
    if not w.isascii():
        w = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)).lower().translate(HOMOGLYPHS)
    if w.isalpha():
        return w
    end = len(w)
    while end and not w[end - 1].isalnum():
        end -= 1
    kept = "".join(c for c in w[:end] if c.isalnum() or c in "@$")
    return kept.translate(SIGNS) if any(c.isalpha() for c in kept) else kept


@functools.lru_cache(maxsize=300_000)
def _folded(word: str) -> str:
    return fold(word)


def folded_texts(texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Folded words of each text, each between single spaces, and their numbers."""
    offsets, codes, words = split_words(texts)
    folded = np.array([_folded(w) for w in words.to_pylist()], object)
    lines = [f" {' '.join(folded[codes[a:b]].tolist())} " for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return lines, np.diff(offsets)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that have a word, " word ", or a beginning, " wor"."""
    found: tuple[Counter, Counter] = (Counter(), Counter())
    for part in chunks(batches):
        lines, _ = folded_texts(part.column("text"))
        for line, toxic in zip(lines, part.column("toxic").to_pylist(), strict=True):
            words = set(line.split())
            own = {f" {w} " for w in words}
            for n in BEGINNINGS:
                own |= {f" {w[:n]}" for w in words if len(w) > n}
            found[toxic].update(own)
    listed = list(found[0].keys() | found[1].keys())
    columns = [pa.array(listed, pa.string()), *(pa.array([c[x] for x in listed], pa.int64()) for c in found)]
    yield pa.RecordBatch.from_arrays(columns, names=["entry", "clean", "toxic"])


class Lexicon:
    """Weighted entries and exception phrases in one automaton, with the curve of the score."""

    def __init__(self, weights: dict[str, float], exceptions: set[str], curve: np.ndarray):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve

    def __reduce__(self):
        return Lexicon, (self.weights, self.exceptions, self.curve)

    @functools.cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        found.make_automaton()
        return found

    def hits(self, line: str) -> dict[int, float]:
        """Start of each word that counts, and its heaviest entry's weight."""
        words: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(line) if self.weights else ():
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif weight > words.get(start, 0.0):
                words[start] = weight
        for a, b in spared:
            for start in [s for s in words if a <= s < b]:
                del words[start]
        return words

    def features(self, line: str, n: int) -> tuple[float, float]:
        total = sum(self.hits(line).values())
        return float(np.log1p(total)), float(np.log1p(100 * total / max(n, 1)))

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] + features @ self.curve[1:])))


def _phrases(lexicon: Lexicon):
    """Documents of each class that have a lexicon word with a neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for part in chunks(batches):
            lines, _ = folded_texts(part.column("text"))
            for line, toxic in zip(lines, part.column("toxic").to_pylist(), strict=True):
                own = set()
                for start in lexicon.hits(line):
                    end = line.index(" ", start + 1)
                    before = line.rfind(" ", 0, start)
                    after = line.find(" ", end + 1)
                    if before >= 0:
                        own.add(line[before : end + 1])
                    if after >= 0:
                        own.add(line[start : after + 1])
                found[toxic].update(own)
        listed = list(found[0].keys() | found[1].keys())
        columns = [pa.array(listed, pa.string()), *(pa.array([c[x] for x in listed], pa.int64()) for c in found)]
        yield pa.RecordBatch.from_arrays(columns, names=["entry", "clean", "toxic"])

    return run


def _measured(lexicon: Lexicon):
    """Features of a sample as a histogram: cells with their rows and the features' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            lines, n = folded_texts(part.column("text"))
            x = np.array([lexicon.features(*z) for z in zip(lines, n.tolist(), strict=True)]).reshape(-1, 2)
            cell = np.rint(x * GRID).astype(np.int64)
            columns = [pa.array(cell[:, 0]), pa.array(cell[:, 1]), part.column("toxic"), pa.array(x[:, 0]), pa.array(x[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "toxic", "a", "b"])

    return run


def fit_curve(x: np.ndarray, toxic: np.ndarray, share: float, count: np.ndarray) -> np.ndarray:
    """Intercept and slopes of a ridge logistic fit, set to the share of toxic rows among all; rows count `count` times."""
    design = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(design.shape[1]), np.diag([1e-6, 1e-2, 1e-2])
    n1, n0 = max((count * toxic).sum(), 1), max((count * (1 - toxic)).sum(), 1)
    shift = np.log(max(share, 1e-6) / max(1 - share, 1e-6)) - np.log(n1 / n0)

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float((count * (np.logaddexp(0, z) - toxic * z)).sum() + b @ ridge @ b / 2)

    for _ in range(50):  # Newton steps, halved while they do not lower the loss
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (count * (p * (1 - p) + 1e-9))[:, None]) + ridge, design.T @ (count * (toxic - p)) - ridge @ beta)
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return beta + np.r_[shift, 0, 0]


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS, entries_most: int = LEXICON, exceptions_most: int = EXCEPTIONS) -> Lexicon:
    """Lexicon, exceptions and curve from about `sample` labelled documents of each class.

    The sampled labels, twice `sample` rows or so whatever the input, are
    broadcast; what reaches the driver is bounded by the lexicon's size and
    the cells of a histogram, however often a document is repeated.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Lexicon({}, set(), np.array([-3.0, 0.0, 0.0]))
    share = sizes[1] / (sizes[0] + sizes[1])
    most = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample / sizes[1]))).otherwise(F.lit(min(1.0, sample / sizes[0])))
    few = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < most * (1 << 20))
    few = scratch.save(few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * sample), "labels")
    rows = scratch.save(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "toxic"), "sample")
    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Lexicon({}, set(), np.array([-3.0, 0.0, 0.0]))
    schema = "entry string, clean long, toxic long"
    entries = rows.mapInArrow(_features, schema).groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    weight = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    entries = entries.withColumn("weight", weight).withColumn("sure", weight - DEVIATIONS * error)
    top = entries.filter((F.col("toxic") >= LEAST_DOCUMENTS) & (F.col("weight") >= LEAST_WEIGHT) & (F.col("sure") >= LEAST_SURE))
    top = top.orderBy(F.desc("sure"), "entry").limit(entries_most).select("entry", "weight").collect()
    lexicon = Lexicon({r[0]: r[1] for r in top}, set(), np.zeros(3))
    phrases = rows.mapInArrow(_phrases(lexicon), schema).groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    phrases = phrases.filter((F.col("clean") >= LEAST_CLEAN) & (F.col("toxic") == 0))
    spared = {r[0] for r in phrases.orderBy(F.desc("clean"), "entry").limit(exceptions_most).collect()}
    lexicon = Lexicon(lexicon.weights, spared, np.zeros(3))
    cells = rows.mapInArrow(_measured(lexicon), "i long, j long, toxic int, a double, b double").groupBy("i", "j", "toxic")
    seen = np.array([tuple(r) for r in cells.agg(F.avg("a"), F.avg("b"), F.count("*")).orderBy("i", "j", "toxic").collect()], float)
    return Lexicon(lexicon.weights, spared, fit_curve(seen[:, 3:5], seen[:, 2], share, seen[:, 5]))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every document.

    docs: doc_id, text; labels: doc_id, toxic (0 or 1).  Labels of documents
    whose crc32(doc_id) leaves the remainder held_out are not learned from;
    of several labels of a document the highest counts, null ones do not.  A
    null or empty text has the score of a text without lexicon words.
    Without both classes among the labels all scores are alike and low.
    Long texts are read whole.  Equal texts have equal scores, rows that
    repeat a doc_id each their own.  Other columns are ignored.  An empty
    table gives an empty result.
    """
    fold = row_crc() % folds == held_out
    lexicon = learn_lexicon(docs, labels.filter(~fold))
    state = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = state.value
        for part in chunks(batches):
            lines, n = folded_texts(part.column("text"))
            score = own.scores(np.array([own.features(*z) for z in zip(lines, n.tolist(), strict=True)]).reshape(-1, 2))
            columns = [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", fold.alias("held_out"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "toxic"))
