"""Ranked lexical search by dual-sorted wavelet trees, one for each shard of documents.

A shard's postings stand term after term in one sequence of document places,
those of a term by falling impact.  A wavelet tree over the sequence halves
the places at every level and keeps the order, so a term's postings inside
any interval of places are one range of that interval's node, and its first
entry has the largest impact there: postings are navigable by document and
sorted by impact at once.  A search goes down the tree best-first: a node's
bound is the sum of its terms' first impacts, the best node is split in two,
and documents leave the queue in the order of their exact scores.  It ends
when no bound can reach the best k known, those of earlier shards included.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, chunks, read, split_words

#: One term, as a Java and Python regular expression: ASCII letters and digits and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: A leaf of a shard's tree has two to the power of this documents; they are scored together.
LEAF_BITS = 5

#: Rows that a search returns for each item.
TOP = 10

#: UTF-8 bytes of text in one shard.
SHARD_BYTES = 12 << 20

#: Terms of the items that one pass over the documents looks for; more items make more passes.
PASS_TERMS = 1 << 18

#: Share of length normalisation in hundredths, and the scale of impacts.
LENGTH_SHARE, SCALE = 90, 1_000_000_000

#: Bytes that end a term, mapped to a space, and A-Z to a-z; all others stay.
_PLAIN = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes(range(256)).lower())


def plain(texts: pa.Array) -> pa.Array:
    """Texts with their terms as lower-case (A-Z) words between spaces, byte by byte; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    _, offsets, data = texts.buffers()
    data = pa.py_buffer(data.to_pybytes().translate(_PLAIN)) if data else data
    return pa.LargeStringArray.from_buffers(len(texts), offsets, data)


def term_hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term)


def _postings(texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text, and place of the term in known, text and frequency of each posting of a known term."""
    offsets, codes, words = split_words(plain(texts))
    size = np.diff(offsets)
    if not len(words) or not len(known):
        return size, *np.zeros((3, 0), np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    at = np.where(known[at] == hashes, at, -1)[codes]
    row = np.repeat(np.arange(len(size)), size)[at >= 0]
    pair, tf = np.unique(at[at >= 0] * len(size) + row, return_counts=True)
    return size, pair // max(len(size), 1), pair % max(len(size), 1), tf


class WaveletTree:
    """Postings of a shard, by term and falling impact, under a wavelet tree over document places 0..docs-1.

    term, doc, impact: one entry for each posting.  Level by level the
    sequence is split into the lower and the upper half of each node's
    places, in the order that it has, down to leaves of a few documents.
    left[d] counts the entries that go to lower halves before each place of
    level d, impacts[d] are the impacts in the level's order, low the places
    inside the leaves.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int):
        order = np.lexsort((doc, -impact, term))
        term, doc, impact = term[order], doc[order].astype(np.int64), impact[order]
        self.terms, first = np.unique(term, return_index=True)
        self.starts = np.r_[first, len(term)].astype(np.int64)
        self.depth = max(max(docs - 1, 0).bit_length() - LEAF_BITS, 0)
        doc, low = doc >> LEAF_BITS, doc & ((1 << LEAF_BITS) - 1)
        # one entry more: a span that is empty at the end has a first one too
        self.left, self.impacts, self.begins = [], [np.append(impact, 0)], []
        for d in range(self.depth):
            node, upper = doc >> (self.depth - d), doc >> (self.depth - d - 1) & 1
            self.left.append(np.r_[0, np.cumsum(1 - upper)].astype(np.int32))
            self.begins.append(np.searchsorted(node, np.arange(1 << d)))
            order = np.argsort(node * 2 + upper, kind="stable")
            doc, low, impact = doc[order], low[order], impact[order]
            self.impacts.append(np.append(impact, 0))
        self.begins.append(np.searchsorted(doc, np.arange(1 << self.depth)))
        self.low = low

    def ranges(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For terms that have postings: their places in `terms`, and where their postings start (first row) and end."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        found = np.flatnonzero(self.terms[at] == terms)
        return found, np.stack([self.starts[at[found]], self.starts[at[found] + 1]])

    def halves(self, level: int, node: int, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The spans of a node's terms in its lower and in its upper half, on the next level."""
        rank, begin, below = self.left[level], self.begins[level][node], self.begins[level + 1]
        lower = rank[spans]
        return lower + (below[2 * node] - rank[begin]), spans - lower + (below[2 * node + 1] - begin + rank[begin])

    def bound(self, level: int, spans: np.ndarray, weights: np.ndarray) -> int:
        """What a document of the node scores at most: its terms' first impacts."""
        return int(np.dot(self.impacts[level][spans[0]] * (spans[1] > spans[0]), weights))

    def leaf(self, node: int, spans: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of a leaf's documents."""
        size = spans[1] - spans[0]
        at = np.repeat(spans[1] - np.cumsum(size), size) + np.arange(size.sum())
        scores = np.zeros(1 << LEAF_BITS, np.int64)
        np.add.at(scores, self.low[at], self.impacts[self.depth][at] * np.repeat(weights, size))
        return (node << LEAF_BITS) + np.arange(len(scores)), scores

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int = 0) -> list[tuple[int, int]]:
        """The k best (score, doc) with scores above 0 and not under least, best first, equal ones by doc."""
        found, spans = self.ranges(terms)
        out: list[tuple[int, int]] = []
        w, least = weights[found], max(least, 1)
        heap = [(-self.bound(0, spans, w), 0, 0, spans)]
        # of equal bounds the higher node comes first, as it may hold a smaller place; then the smaller place
        while heap and len(out) < k and -heap[0][0] >= least:
            bound, level, node, spans = heappop(heap)
            if level > self.depth:
                out.append((-bound, node))
            elif level == self.depth:
                places, scores = self.leaf(node, spans, w)
                for i in np.flatnonzero(scores >= least).tolist():
                    heappush(heap, (-int(scores[i]), level + 1, int(places[i]), None))
            else:
                for side, part in enumerate(self.halves(level, node, spans)):
                    best = self.bound(level + 1, part, w)
                    if best >= least:
                        heappush(heap, (-best, level + 1, 2 * node + side, part))
        return out


class Items:
    """Items of one pass: distinct term hashes (ascending) and for each item the places of its terms among them."""

    def __init__(self, ids: list, terms: list[list[str]]):
        hashes = [np.unique(np.fromiter(map(term_hash, t), np.uint64, len(t))) for t in terms]
        self.ids, self.known = ids, np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        self.terms = [np.searchsorted(self.known, h) for h in hashes]


def _counts(items: Broadcast) -> Callable:
    """For rows with text: term (null for the sums), docs with it or with any, all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items.value.known
        df, docs, total = np.zeros(len(known), np.int64), 0, 0
        for part in chunks(batches):
            size, term, _, _ = _postings(part.column("text"), known)
            df += np.bincount(term, minlength=len(known))
            docs, total = docs + int((size > 0).sum()), total + int(size.sum())
        held = np.flatnonzero(df)
        columns = [pa.array([None, *held.tolist()], pa.int64()), pa.array([docs, *df[held].tolist()], pa.int64()), pa.array([total] + [0] * len(held), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "docs", "total"])

    return run


def impacts(tf: np.ndarray, length: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Impact of a frequency in a document of so many terms, in whole numbers."""
    if len(length) and LENGTH_SHARE * int(length.max()) * docs >= 1 << 62:  # beyond 64 bits: as Python's whole numbers
        m = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * int(n) * docs // total for n in length], np.int64)
    else:
        m = 100 - LENGTH_SHARE + LENGTH_SHARE * length * docs // max(total, 1)
    return SCALE * tf // (1000 * tf + 8 * m)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _best(items: Broadcast, weights: Broadcast, docs: int, total: int, k: int, shard_bytes: int) -> Callable:
    """For rows (doc_id, text): the k best of this task's shards for each item, as (item, doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, w = items.value, weights.value
        best: list[list[tuple]] = [[] for _ in queries.ids]  # heaps: (score, -place by id) least first
        for part in chunks(batches, most=shard_bytes):
            ids = part.column("doc_id")
            order = pc.sort_indices(pa.table([ids], names=["doc_id"]), sort_keys=[("doc_id", "ascending")], null_placement="at_end")
            part, ids = part.take(order), ids.take(order).to_pylist()
            size, term, doc, tf = _postings(part.column("text"), queries.known)
            tree = WaveletTree(term, doc, impacts(tf, size[doc], docs, total), len(ids))
            for i, terms in enumerate(queries.terms):
                have = best[i]
                for score, place in tree.search(terms, w[terms], k, have[0][0] if len(have) == k else 0):
                    key = (score, ids[place] is not None, -(ids[place] or 0))
                    if len(have) < k:
                        heappush(have, key)
                    elif key > have[0]:
                        heapreplace(have, key)
        rows = [(i, -d if there else None, s) for i, have in enumerate(best) for s, there, d in have]
        columns = [pa.array([queries.ids[r[0]] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

    return run


def search_documents(docs: DataFrame, items: DataFrame, k: int = TOP, pass_terms: int = PASS_TERMS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The k documents of the highest scores for each item: item_id, rank, doc_id, score.

    docs: doc_id, text; items: item_id, text; other columns are ignored.
    Terms are maximal runs of ASCII letters, digits and characters beyond
    ASCII, A-Z lower-cased; null has none.  The score of a document sums, over
    an item's distinct terms, the term's weight times its impact there, in
    whole numbers; documents of score 0 are not returned.  Equal scores go by
    ascending doc_id, null ids last.  Rows that share an item_id, null among
    them, are one item with the terms of all; rows that share a doc_id are
    documents of their own.  Items without terms, empty tables: no rows.
    Long texts are read whole; one longer than a shard is a shard.

    Items are dealt by a hash of their id to passes of about `pass_terms`
    terms, so what a pass holds on the driver and sends to the executors is
    bounded; each pass reads the documents twice, once for the statistics.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lexical_search")
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))
    terms = scratch.save(terms.distinct().groupBy("item_id").agg(F.collect_set("term").alias("terms")), "items")
    passes = -(-int(terms.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0) // pass_terms)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    for i in range(passes):
        rows = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i).sort("item_id").collect()
        own = Items([r["item_id"] for r in rows], [r["terms"] for r in rows])
        sent = spark.sparkContext.broadcast(own)
        counts = texts.select("text").mapInArrow(_counts(sent), "term long, docs long, total long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total"))
        counts = {r["term"]: r for r in counts.collect()}  # a row for each term of the pass
        if None not in counts or not counts[None]["total"]:
            continue
        n, total = counts[None]["docs"], counts[None]["total"]
        weights = np.array([weight(n, counts[t]["docs"] if t in counts else 0) for t in range(len(own.known))], np.int64)
        best = texts.mapInArrow(_best(sent, spark.sparkContext.broadcast(weights), n, total, k, shard_bytes), "item_id long, doc_id long, score long")
        found.append(scratch.save(best, f"best{i}"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    # Spark keeps the k first of each item in every task before it shuffles
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item; see `search_documents`."""
    return search_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH terms AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM documents),
d AS (SELECT r, doc_id, len(t)::BIGINT AS n, t FROM terms WHERE len(t) > 0),
s AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nl FROM d),
p AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM d) GROUP BY r, doc_id, n, term),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
q AS (
    SELECT DISTINCT item_id,
           unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
w AS (SELECT item_id, term, floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2 * df + 1)))::BIGINT AS w FROM q JOIN f USING (term), s),
x AS (
    SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nl))))::BIGINT AS score
    FROM w JOIN p USING (term), s GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10
"""
