"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
A word's probability is the sum, over all its segmentations into pieces, of
the products of their probabilities; a forward pass gives it without listing
them.  Piece probabilities are learned by expectation-maximisation: a
forward-backward pass over the words of a bounded sample gives each piece's
expected count.  A text's words are taken as independent.

Words are runs of letters in lower case, opened by the vocabulary's mark for
the start of a word.  Words up to QUICK characters go through the pass many at
once; longer ones, as in scripts without spaces, one by one in logarithms, so
that no length is too long.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, read, row_crc, split_words

#: Documents with this remainder of crc32(doc_id) are not learned from.
FOLDS, HELD_OUT = 5, 0

#: Documents of each language in the sample that pieces are learned from, about.
SAMPLE_DOCUMENTS = 400

#: Rounds of expectation-maximisation, pseudo-count of every piece in every language.
EM_ROUNDS, PRIOR = 3, 0.05

#: Probability of a letter that is no piece, in every language.
UNKNOWN = 1e-7

#: Characters up to which products stay in range, with each one's share in the scale for that.
QUICK, SCALE = 49, 1e4

#: Words whose probabilities a worker keeps at hand, and words that go through one pass together.
CACHE_WORDS, PASS_WORDS = 200_000, 20_000

START, UNDETERMINED = "▁", "und"

_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary_pieces(path: str) -> list[str]:
    """The letter pieces of a public vocabulary, with or without the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in pieces if p.removeprefix(START).isalpha() or p == START})


def letter_runs(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Runs of letters in each word: offsets, and the runs."""
    marked = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}]+", " "), " ")
    lists = pc.split_pattern(marked, " ")
    offsets, runs = lists.offsets.to_numpy().astype(np.int64), lists.values
    full = pc.greater(pc.binary_length(runs), 0)
    keep = full.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(keep)])[offsets], runs.filter(full)


class Segmenter:
    """Forward and backward passes over words, many of one length at once."""

    def __init__(self, pieces: list[str], probability: np.ndarray):
        """probability: pieces x languages."""
        self.pieces, self.probability = pieces, probability
        self.longest = max(map(len, pieces), default=1)
        self.by_length = {}
        hashes = self._hash([p for p in pieces])
        for n in sorted({len(p) for p in pieces}):
            at = np.array([i for i, p in enumerate(pieces) if len(p) == n])
            order = np.argsort(hashes[at])
            self.by_length[n] = hashes[at][order], at[order]
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.scores = np.zeros((0, self.probability.shape[1]))

    @staticmethod
    def _hash(words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.uint64)
        for i, w in enumerate(words):
            h = 0
            for c in w:
                h = (h * int(_BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
            out[i] = h
        return out

    def _spans(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) for words of one length, by ascending end."""
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64)
        prefix = np.zeros((len(words), n + 1), np.uint64)
        for i in range(n):
            prefix[:, i + 1] = prefix[:, i] * _BASE + codes[:, i]
        power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)])
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                if end - start not in self.by_length:
                    continue
                known, piece = self.by_length[end - start]
                h = prefix[:, end] - prefix[:, start] * power[end - start]
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                rows = np.flatnonzero(known[at] == h)
                if len(rows):
                    yield start, end, rows, piece[at[rows]]

    def forward(self, words: list[str], keep: bool = True) -> tuple[np.ndarray, list]:
        """Scaled sums over the segmentations of each word's beginnings, and the spans met if they are kept."""
        n = len(words[0])
        f = np.zeros((n + 1, len(words), self.probability.shape[1]))
        f[0] = 1
        spans, at = [], 0
        for start, end, rows, piece in self._spans(words):
            while at < end:  # a letter may always stand alone
                at += 1
                f[at] += f[at - 1] * (UNKNOWN * SCALE)
            if keep:
                spans.append((start, end, rows, piece))
            f[end, rows] += f[start, rows] * self.probability[piece] * SCALE ** (end - start)
        while at < n:
            at += 1
            f[at] += f[at - 1] * (UNKNOWN * SCALE)
        return f, spans

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces, for a single language."""
        f, spans = self.forward(words)
        n = len(words[0])
        b = np.zeros_like(f)
        b[n] = 1
        out, at = np.zeros(len(self.pieces)), n
        for start, end, rows, piece in sorted(spans, key=lambda s: -s[1]):
            while at > end:
                at -= 1
                b[at] += b[at + 1] * (UNKNOWN * SCALE)
            step = self.probability[piece] * SCALE ** (end - start)
            weight = f[start, rows] * step * b[end, rows] / f[n, rows]
            np.add.at(out, piece, weight[:, 0] * counts[rows])
            b[start, rows] += b[end, rows] * step
        return out

    @functools.cached_property
    def log_pieces(self) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log(self.probability)

    def long_forward(self, word: str) -> tuple[np.ndarray, list[tuple[list[int], list[int]]]]:
        """Logs of the sums over the segmentations of a word's beginnings, and for each end the spans' starts and pieces."""
        codes, n = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64), len(word)
        spans: list[tuple[list[int], list[int]]] = [([], []) for _ in range(n + 1)]
        for size, (known, piece) in self.by_length.items():
            if size > n:
                continue
            h = np.zeros(n - size + 1, np.uint64)
            for i in range(size):
                h = h * _BASE + codes[i : n - size + 1 + i]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for start in np.flatnonzero(known[at] == h).tolist():
                spans[start + size][0].append(start)
                spans[start + size][1].append(int(piece[at[start]]))
        f = np.zeros((n + 1, self.probability.shape[1]))
        for end in range(1, n + 1):
            start, piece = spans[end]
            f[end] = f[end - 1] + np.log(UNKNOWN)
            if start:
                f[end] = np.logaddexp(f[end], np.logaddexp.reduce(f[start] + self.log_pieces[piece], axis=0))
        return f, spans

    def long_expected(self, word: str) -> np.ndarray:
        """Expected counts of the pieces in one word, for a single language."""
        f, spans = self.long_forward(word)
        f, n, p = f[:, 0], len(word), self.log_pieces[:, 0]
        b = np.full(n + 1, -np.inf)
        b[n] = 0.0
        out = np.zeros(len(self.pieces))
        for end in range(n, 0, -1):
            b[end - 1] = np.logaddexp(b[end - 1], b[end] + np.log(UNKNOWN))
            start, piece = spans[end]
            if start:
                np.add.at(out, piece, np.exp(f[start] + p[piece] + b[end] - f[n]))
                b[start] = np.logaddexp(b[start], b[end] + p[piece])
        return out

    def log_probability(self, words: list[str]) -> np.ndarray:
        """Natural log of each marked word's probability in each language."""
        out = np.zeros((len(words), self.probability.shape[1]))
        length = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(length > QUICK).tolist():
            out[i] = self.long_forward(words[i])[0][-1]
        for n in np.unique(length[length <= QUICK]).tolist():
            alike = np.flatnonzero(length == n)
            for at in np.array_split(alike, -(-len(alike) // PASS_WORDS)):
                f, _ = self.forward([words[i] for i in at], keep=False)
                out[at] = np.log(f[-1]) - n * np.log(SCALE)
        return out

    def text_scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text in each language, and its number of words."""
        offsets, codes, words = split_words(texts)
        edge, runs = letter_runs(words)
        if len(self.known) > CACHE_WORDS:
            self._forget()
        at = pc.index_in(runs, value_set=self.known)
        if at.null_count:
            new = runs.filter(at.is_null()).unique()
            self.scores = np.concatenate([self.scores, self.log_probability([START + r for r in new.to_pylist()])])
            self.known = pa.concat_arrays([self.known, new])
            at = pc.index_in(runs, value_set=self.known)
        by_run = np.concatenate([np.zeros((1, self.scores.shape[1])), np.cumsum(self.scores[at.to_numpy(zero_copy_only=False)], axis=0)])
        by_word = by_run[edge[1:]] - by_run[edge[:-1]]
        total = np.concatenate([np.zeros((1, by_word.shape[1])), np.cumsum(by_word[codes], axis=0)])
        runs_to = np.concatenate([[0], np.cumsum(np.diff(edge)[codes])])
        return total[offsets[1:]] - total[offsets[:-1]], runs_to[offsets[1:]] - runs_to[offsets[:-1]]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches):
        langs = part.column("lang").dictionary_encode()
        offsets, codes, words = split_words(part.column("text"))
        edge, runs = letter_runs(words)
        listed = runs.to_pylist()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            own = np.flatnonzero(np.repeat(langs.indices.to_numpy() == i, np.diff(offsets)))
            count = np.bincount(codes[own], minlength=len(words))
            seen: dict[str, int] = {}
            for w in np.flatnonzero(count).tolist():
                for r in listed[edge[w] : edge[w + 1]]:
                    seen[r] = seen.get(r, 0) + int(count[w])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])


def learn_pieces(docs: DataFrame, pieces: list[str], sample: int = SAMPLE_DOCUMENTS) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and pieces x languages probabilities.

    docs: text and a lang that is not null.  About `sample` documents of each
    language are learned from, those under a threshold of a hash of the text.
    What reaches the driver is bounded by languages times vocabulary.
    """
    spark = docs.sparkSession
    sizes = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((len(pieces), 0))
    share = F.element_at(F.create_map(*(x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, sample / sizes[lang]))))), F.col("lang"))
    few = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    words = few.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition("lang", "word").cache()
    table = np.full((len(pieces), len(langs)), 1 / max(1, len(pieces)))
    schema = "lang string, piece int, n double"
    try:
        for _ in range(EM_ROUNDS):
            state = spark.sparkContext.broadcast((pieces, langs, table))

            def expected(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
                pieces, langs, table = state.value
                for batch in batches:
                    for i, lang in enumerate(langs):
                        own = batch.filter(pc.equal(batch.column("lang"), lang))
                        marked = [START + w for w in own.column("word").to_pylist()]
                        if not marked:
                            continue
                        model, n = Segmenter(pieces, table[:, i : i + 1]), own.column("n").to_numpy()
                        length, total = np.fromiter(map(len, marked), np.int64, len(marked)), np.zeros(len(pieces))
                        for k in np.flatnonzero(length > QUICK).tolist():
                            total += model.long_expected(marked[k]) * n[k]
                        for size in np.unique(length[length <= QUICK]).tolist():
                            at = np.flatnonzero(length == size)
                            total += model.expected([marked[k] for k in at], n[at])
                        hit = np.flatnonzero(total)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(total[hit])], names=["lang", "piece", "n"])

            rows = words.mapInArrow(expected, schema).groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
            count = np.full(table.shape, PRIOR)
            np.add.at(count, (rows["piece"].to_numpy(), rows["lang"].map(langs.index).to_numpy(dtype=np.int64)), rows["n"].to_numpy())
            table = count / count.sum(axis=0)
    finally:
        words.unpersist()
    return langs, table


def identify(docs: DataFrame, vocabulary: str, folds: int = FOLDS, held_out: int = HELD_OUT, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """docs with held_out, lang_pred and score.

    vocabulary: path of a piece vocabulary on the driver.  Learned from the
    text and lang of documents with a lang whose crc32(doc_id) leaves another
    remainder than `held_out`; predictions use the text alone.  score is the
    predicted language's share among the learned ones' likelihoods.  A null
    text, one without letters, and any text where no language was learned,
    are `und` with score 0.  Equal likelihoods give the first language in
    code-point order.  Equal rows get equal results.  Long texts are read
    whole.  Columns of docs of these three names are replaced.  An empty table
    gives an empty result.
    """
    fold = row_crc() % folds == held_out
    taught = docs.filter(~fold & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    pieces = vocabulary_pieces(vocabulary)
    langs, table = learn_pieces(taught, pieces, sample)
    state = docs.sparkSession.sparkContext.broadcast(Segmenter(pieces, table))
    source = docs.select(*(docs[c] for c in docs.columns if c not in ("held_out", "lang_pred", "score")), fold.alias("held_out"))
    kinds = T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = kinds.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            if langs:
                total, n = state.value.text_scores(part.column("text"))
                best = total.argmax(axis=1)
                share = 1 / np.exp(np.minimum(total - total.max(axis=1, keepdims=True), 0)).sum(axis=1)
                known = n > 0
                pred = [langs[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                score = np.where(known, share, 0.0)
            else:
                pred, score = [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=names)

    return source.mapInArrow(run, kinds)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "lang_pred", "score")
