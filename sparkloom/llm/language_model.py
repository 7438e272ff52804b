"""Language-model scores by deleted interpolation.

P(w | v) = a[b] c(vw)/c(v) + b[b] c(w)/N + c[b] / (V + 1), where b is the
bucket of the context's frequency c(v), a power of two.  The maximum-likelihood
counts come from all training documents.  The weights of each bucket are
learned by expectation-maximisation on held-out counts: the documents of every
block are scored with the block's own counts deleted from the totals, and what
the estimates then are is kept as a histogram of bounded size: each cell of
half an octave has its tokens' number and the means of the estimates' logs, so
that rounding enters only in the second order.

Counts are gathered by hash block: a block of documents sends each distinct
key once, the key's owner sums them up, and the blocks that sent it get the
total back, told by its place.  Nothing grows with the corpus in one task or on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_SCHEMA, Scratch, block_count, bucket_order, chunks, hash_chunks, join_hashes, key_totals, mix, read, row_crc, split_words, unpack_counts, with_block, word_hashes

#: Documents with this remainder of crc32(doc_id) are not learned from.
FOLDS, HELD_OUT = 7, 2

#: Context buckets, the last of them open, and histogram cells for each estimate at two to the octave, down to 2^-63.
BUCKETS, CELLS = 40, 128

EM_ROUNDS = 60

_END, _BEGIN = (mix(np.array([x], np.uint64))[0] for x in (0x656E64, 0x626567696E))
_PAIR = np.uint64(0xA0761D6478BD642F)


class _Tokens:
    """A slice of documents as one row of token keys, each document closed by an end."""

    def __init__(self, texts: pa.Array):
        offsets, codes, words = split_words(texts, lower=True)
        self.edge = offsets + np.arange(len(offsets))
        self.word = np.insert(word_hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64), offsets[1:], _END)
        before = np.r_[_BEGIN, self.word[:-1]]
        before[self.edge[:-1]] = _BEGIN
        self.before = before
        self.pair = join_hashes(before ^ _PAIR, self.word)
        self.size = np.diff(self.edge)


def _block_tokens(docs: pa.Table) -> Iterator[tuple[pa.RecordBatch, _Tokens]]:
    for part in chunks(docs.combine_chunks().to_batches()):
        yield part, _Tokens(part.column("text"))


class _Block:
    """A block's documents with the places of their tokens among its distinct keys."""

    def __init__(self, docs: pa.Table):
        self.parts = list(_block_tokens(docs))
        self.keys, self.at = zip(*(np.unique(np.concatenate([getattr(t, name) for _, t in self.parts]), return_inverse=True) for name in ("word", "pair")), strict=True)
        self.size = np.concatenate([t.size for _, t in self.parts])
        self.edge = np.concatenate([[0], np.cumsum(self.size)])
        self.held_out = np.concatenate([p.column("held_out").to_numpy(zero_copy_only=False) for p, _ in self.parts])
        self.learn = np.repeat(~self.held_out, self.size)

    def counts(self, totals: pa.Table, buckets: int, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Training counts of each token, of its context and of the pair."""
        totals = totals.sort_by("bucket")
        kinds, found = totals.column("kind").to_numpy(), []
        data, sizes = totals.column("totals").to_pylist(), totals.column("size").to_pylist()
        for kind, (keys, at) in enumerate(zip(self.keys, self.at, strict=True)):
            own = np.concatenate([unpack_counts(data[i], sizes[i]) for i in np.flatnonzero(kinds == kind)])
            placed = np.empty(len(keys), np.int64)
            placed[bucket_order(keys, buckets)[1]] = own
            found.append(placed[at])
        context = np.r_[0, found[0][:-1]]
        context[self.edge[:-1]] = documents
        return found[0], context, found[1]


def _counts(buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        number, block = docs.column("block")[0].as_py(), _Block(docs)
        tables = []
        for kind, (keys, at) in enumerate(zip(block.keys, block.at, strict=True)):
            tables.append(hash_chunks(number, keys, np.bincount(at, block.learn, len(keys)).astype(np.int64), buckets, kind=kind))
        return pa.concat_tables(tables)

    return run


def context_bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _log(p: np.ndarray) -> np.ndarray:
    """Logs to base 2; 0 for an estimate of zero, which has a cell of its own."""
    return np.log2(np.where(p > 0, p, 1.0))


def _cell(p: np.ndarray) -> np.ndarray:
    """Histogram cell of an estimate: 0 for zero, else by half octaves."""
    return np.where(p > 0, np.clip(np.rint(-2 * _log(p)), 0, CELLS - 2) + 1, 0).astype(np.int64)


def _deleted(buckets: int, documents: int, tokens: int):
    def run(docs: pa.Table, totals: pa.Table) -> pa.Table:
        block = _Block(docs)
        word, context, pair = block.counts(totals, buckets, documents)
        own_word, own_pair = (np.bincount(at, block.learn, len(keys)).astype(np.int64)[at] for keys, at in zip(block.keys, block.at, strict=True))
        own_context = np.r_[0, own_word[:-1]]
        own_context[block.edge[:-1]] = int((~block.held_out).sum())
        left = pair - own_pair
        context = context - own_context
        high = left / np.maximum(context, 1)
        low = (word - own_word) / max(tokens - int(block.learn.sum()), 1)
        code = (context_bucket(context) * CELLS + _cell(high)) * CELLS + _cell(low)
        cell, at, n = np.unique(code[block.learn], return_inverse=True, return_counts=True)
        logs = [np.bincount(at, _log(p)[block.learn], len(cell)) for p in (high, low)]
        return pa.table([pa.array(cell, pa.int64()), pa.array(n, pa.int64()), *(pa.array(x, pa.float64()) for x in logs)], names=["cell", "n", "high", "low"])

    return run


def learn_weights(cells: list[tuple[int, int, float, float]], vocabulary: int) -> np.ndarray:
    """Weights of pair, word and uniform estimate in each context bucket, by EM.

    cells: (cell, tokens, sums of the logs of pair and word estimate) of the
    deleted estimates.  A bucket without tokens takes the weights of the next
    lower one that has some.  A context that was never seen has no pair
    estimate, so its weight there is zero and the others add up to one.
    """
    weights = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    code, n, high, low = (np.array(x) for x in zip(*cells, strict=True)) if cells else (np.zeros(0),) * 4
    code, n = code.astype(np.int64), n.astype(np.float64)
    bucket = code // CELLS // CELLS
    estimate = lambda cell, logs: np.where(cell > 0, 2.0 ** (logs / np.maximum(n, 1)), 0.0)
    p = np.stack([estimate(code // CELLS % CELLS, high), estimate(code % CELLS, low), np.full(len(code), 1 / (vocabulary + 1))], axis=1)
    for _ in range(EM_ROUNDS):
        post = p * weights[bucket]
        post *= (n / np.maximum(post.sum(axis=1), 1e-300))[:, None]
        for b in np.unique(bucket):
            share = post[bucket == b].sum(axis=0) + [0, 0.5, 0.5]  # no weight of a sure event is zero
            weights[b] = share / share.sum()
    seen = set(bucket.tolist())
    for b in range(1, BUCKETS):
        if b not in seen:
            weights[b] = weights[b - 1] if b > 1 or 0 in seen else weights[b]
    weights[0] = [0, *(weights[0][1:] / weights[0][1:].sum())]
    return weights if vocabulary else np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))


def _scores(buckets: int, documents: int, tokens: int, vocabulary: int, weights: np.ndarray):
    def run(docs: pa.Table, totals: pa.Table) -> pa.Table:
        block = _Block(docs)
        word, context, pair = block.counts(totals, buckets, documents)
        w = weights[context_bucket(context)]
        p = w[:, 0] * (pair / np.maximum(context, 1)) + w[:, 1] * (word / max(tokens, 1)) + w[:, 2] / (vocabulary + 1)
        base = np.log10((word + 1) / (tokens + vocabulary + 1))
        total = lambda x: np.add.reduceat(x, block.edge[:-1])
        ids = pa.chunked_array([part.column("doc_id") for part, _ in block.parts])
        columns = [ids, pa.array(block.held_out), block.size, total((word > 0).astype(np.int64)), total(base), total(np.log10(p))]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def interpolated_scores(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """Log10 probability of each text under a model of all training documents.

    Tokens are the lower-cased (A-Z) words and one end.  Returns doc_id,
    held_out (crc32 of doc_id has the remainder held_out), n_tokens, n_known
    (tokens that training has), train_tokens, base_score (add-one words) and
    score (the mixture, whose probabilities of all words after a context, the
    unknown one among them, add up to one).

    A null or empty text is one end.  Equal rows count each for itself.  A
    null doc_id counts as the empty text in the fold.  Other columns are
    ignored.  Without training documents both scores rest on the uniform
    part.  Long texts are read whole.  An empty table gives an empty result.
    """
    scratch, blocks = Scratch(docs.sparkSession, "language_model"), block_count(docs)
    fold = (row_crc() % folds) == held_out
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", fold.alias("held_out"))
    parts = with_block(source, blocks, scratch, extra=True).select("doc_id", "text", "block", "extra.held_out")
    first = parts.groupBy("block").applyInArrow(_counts(blocks), CHUNK_SCHEMA)
    totals = scratch.save(key_totals(first, (1, 1)), "totals")
    sums = totals.filter("kind = 0 and block is null").agg(F.sum("n_keys"), F.sum("n_counts")).first()
    vocabulary, tokens = int(sums[0] or 0), int(sums[1] or 0)
    documents = source.filter(~F.col("held_out")).count()
    known = totals.filter("block is not null").select("kind", "bucket", "block", "totals", "size").groupBy("block")
    cells = parts.groupBy("block").cogroup(known).applyInArrow(_deleted(blocks, documents, tokens), "cell long, n long, high double, low double")
    cells = scratch.save(cells.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))), "cells")
    weights = learn_weights([tuple(r) for r in cells.orderBy("cell").collect()], vocabulary)
    out = parts.groupBy("block").cogroup(known).applyInArrow(
        _scores(blocks, documents, tokens, vocabulary, weights), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_scores(read(spark, sf_dir, "documents"))
