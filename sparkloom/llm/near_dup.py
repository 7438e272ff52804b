"""SimHash near-duplicates, completed by MinHash bands, at a similarity of word shingles.

Texts of equal shingle sets are one class.  The classes' SimHash fingerprints
go through the Gray-order index of `simhash`; the links that it finds are
verified by the Jaccard similarity of the whole shingle sets.  Texts of a
similarity of 0.8 differ in ten bits of 64 on average, which no index over 64
bits finds without comparing most pairs.  So MinHash bands propose the pairs
that the index has left apart, whatever a bucket's size.  Inside bounded nodes
parity bitmaps bound how much two sets differ, which rules out nearly all
pairs under the threshold and none over it: first the closest pairs that
connect what may be connected are verified, then what is still apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmaps import Bounds, bit_count_of, node_pairs, parities, whole_nodes
from .common import Scratch, chunks, join_hashes, keep_rows, mix, ngram_hashes, row_marks, split_words, trimmed, word_hashes
from .components import connected_components
from .simhash import bit_fingerprints, fingerprint_links, stars

SHINGLE_WORDS, SIMILARITY = 5, 0.8

#: Bits in which the fingerprints of the index's links differ at most.
DISTANCE = 3

#: Bands and rows of a band: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8^5)^30 = 0.99999.
BANDS, ROWS = 30, 5

#: Hash values behind the bands.
VALUES = BANDS * ROWS

#: Bits of a class's parity bitmap for each shingle: with four a pair of similarity under 0.79 is ruled out as a rule.
TOKEN_BITS = 4

#: Classes of a bucket that one task compares with each other, or with as many others.
NODE_CLASSES = 1024

#: UTF-8 bytes of text that one numpy pass handles together.
MARK_BYTES = 1 << 20

SEED = 20_240_603


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the edges between texts.

    Words are lower-cased (A-Z); fewer than `shingle` words make one shingle, none make none.
    """
    offsets, codes, words = split_words(texts, lower=True)
    h = word_hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    grams = ngram_hashes(h, shingle, SEED)
    inside = np.arange(len(grams)) + shingle <= offsets[1:][row[: len(grams)]]
    short = np.flatnonzero((size > 0) & (size < shingle))
    whole = [ngram_hashes(h[offsets[i] : offsets[i + 1]], int(size[i]), SEED + int(size[i])) for i in short]
    grams, row = np.concatenate([grams[inside], *whole]), np.concatenate([row[: len(grams)][inside], short])
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(len(size) + 1))


def set_keys(grams: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A hash of each set; zero for the empty one."""
    out, full = np.zeros(len(edge) - 1, np.uint64), np.flatnonzero(np.diff(edge))
    if len(full):
        out[full] = mix(np.add.reduceat(mix(grams ^ np.uint64(SEED)), edge[full]) + np.diff(edge)[full].astype(np.uint64))
    return out


def min_hashes(grams: np.ndarray, edge: np.ndarray, values: int = VALUES, seed: int = SEED) -> np.ndarray:
    """The least hash of each set that is not empty under each of many hash functions: sets x values."""
    start = edge[:-1][np.diff(edge) > 0]
    out = np.zeros((len(start), values), np.uint64)
    odd = np.random.default_rng(seed).integers(0, 1 << 64, (2, values), np.uint64) | np.uint64(1)
    for i in range(values if len(start) else 0):
        out[:, i] = np.minimum.reduceat((grams ^ odd[0, i]) * odd[1, i], start)
    return out


def band_keys(least: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of least hashes: sets x bands."""
    out = np.zeros((len(least), least.shape[1] // rows), np.uint64)
    for i in range(least.shape[1]):
        out[:, i // rows] = join_hashes(out[:, i // rows], least[:, i])
    return out


def _marks(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, most=MARK_BYTES):
            grams, edge = shingle_sets(part.column("text"), shingle)
            full = np.diff(edge) > 0
            least = min_hashes(grams, edge)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(full)] * BANDS, pa.int32()), pa.array(band_keys(least).ravel().view(np.int64)))
            columns = [part.column("doc_id"), part.column("row1"), part.column("row2"), pa.array(set_keys(grams, edge).view(np.int64)), pa.array(np.diff(edge), pa.int64())]
            columns += [pa.array(bit_fingerprints(grams, edge).view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row1", "row2", "key", "n", "fp", "bands"])

    return run


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A parity bitmap, and the bands cut to 32 bits, for rows (key, grams)."""
    for batch in batches:
        sets = batch.column("grams")
        grams, edge = sets.flatten().to_numpy().view(np.uint64), sets.offsets.to_numpy().astype(np.int64)
        edge = edge - edge[0]
        size = bit_count_of(np.diff(edge), TOKEN_BITS)
        bits = [parities(mix(grams[a:b].copy()), int(n)).tobytes() for a, b, n in zip(edge[:-1], edge[1:], size, strict=True)]
        bands = band_keys(min_hashes(grams, edge)).astype(np.uint32)
        columns = [batch.column("key"), pa.array(bits, pa.binary()), pa.array([r.tobytes() for r in bands], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "bits", "bands"])


def _tree(n: int, label: np.ndarray, i: np.ndarray, j: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """Places of the pairs, best first, that connect what all pairs connect; label says what is connected already."""
    comp, kept = np.unique(label, return_inverse=True)[1], []
    order = np.lexsort((j, i, -agree))
    i, j = i[order], j[order]
    while True:
        live = np.flatnonzero(comp[i] != comp[j])
        if not len(live):
            return order[np.unique(np.concatenate([np.zeros(0, np.int64), *kept]))]
        # each part takes its best pair
        ends = np.concatenate([comp[i[live]], comp[j[live]]])
        at = np.concatenate([live, live])
        first = np.lexsort((at, ends))
        best = np.unique(at[first][np.r_[True, np.diff(ends[first]) != 0]])
        kept.append(best)
        comp = stars(n, comp[i[best]], comp[j[best]])[comp]


def _compare(bounds: Bounds, tree: bool):
    """For rows (band, hash, a, b, side, key, n, label, bits, bands) sorted by node: pairs of different labels that may be similar.

    The bitmaps' bound rules out no similar pair.  In a node of two chunks
    only pairs across them are compared.  With tree: the closest pairs that
    connect what all that may be similar do; else all of these, each in the
    first band that it shares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes in whole_nodes(batches, ["band", "hash", "a", "b"], 4 * NODE_CLASSES):
            for node in nodes:
                if node.num_rows < 2:
                    continue
                side, key, n, label = (node.column(c).to_numpy() for c in ("side", "key", "n", "label"))
                i, j, differ = node_pairs(side, n, label, np.zeros(len(key), np.int64), node.column("bits").to_pylist(), bounds)
                if tree and len(i):
                    keep = _tree(len(key), label, i, j, -differ)
                else:
                    bands = np.frombuffer(b"".join(node.column("bands").to_pylist()), np.uint32).reshape(-1, BANDS)
                    keep = (bands[i] == bands[j]).argmax(axis=1) == node.column("band")[0].as_py()
                x, y = key[i[keep]], key[j[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y), pa.int64()), pa.array(np.maximum(x, y), pa.int64())], names=["a", "b"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, most=MARK_BYTES):
            grams, edge = shingle_sets(part.column("text"), shingle)
            lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(grams.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(set_keys(grams, edge).view(np.int64)), lists], names=["key", "grams"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    d = pairs.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("key").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return d.filter(shared / (F.size("ga") + F.size("gb") - shared) >= similarity).select("a", "b")


def _alike(m: Column, n: Column, similarity: float) -> Column:
    """Sets of more unequal sizes cannot be so similar."""
    return F.least(m, n) >= similarity * F.greatest(m, n) - 1e-9


def _index_pairs(classes: DataFrame, scratch: Scratch, similarity: float) -> DataFrame:
    """Pairs (a, b) of set keys that the Gray-order index links; each fingerprint's least class stands for it."""
    least = scratch.save(classes.groupBy("fp").agg(F.min(F.struct("key", "n")).alias("least")).select("fp", "least.*"), "prints")
    links = fingerprint_links(least.select("fp"), DISTANCE, scratch)
    a, b = (least.select(F.col("fp").alias(s), F.col("key").alias(f"k{s}"), F.col("n").alias(f"n{s}")) for s in "ab")
    near = links.join(a, "a").join(b, "b").filter(_alike(F.col("na"), F.col("nb"), similarity)).select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    same = classes.join(least.select("fp", F.col("key").alias("a"), F.col("n").alias("na")), "fp").filter((F.col("a") != F.col("key")) & _alike(F.col("na"), F.col("n"), similarity))
    return near.unionByName(same.select("a", F.col("key").alias("b"))).distinct()


def _compared(rest: DataFrame, signatures: DataFrame, similarity: float, tree: bool) -> DataFrame:
    """Pairs (a, b) of the buckets' classes with different labels that may be similar; see `_compare`.

    A bucket's classes are dealt to chunks, and each two chunks of a bucket to
    a node, so that no task holds more than two chunks of one.
    """
    sizes = rest.groupBy("band", "hash").agg(F.ceil(F.count("*") / NODE_CLASSES).cast("int").alias("chunks"))
    d = rest.join(sizes, ["band", "hash"]).withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    nodes = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least("chunk", k).alias("a"), F.greatest("chunk", k).alias("b")))
    d = d.withColumn("node", F.explode(nodes)).select("band", "hash", "node.a", "node.b", F.col("chunk").alias("side"), "key", "n", "label").join(signatures, "key")
    at, part = ["band", "hash", "a", "b"], Fraction(similarity).limit_denominator(10_000)
    bounds = Bounds(part.numerator, part.denominator)
    return d.repartition(*at).sortWithinPartitions(*at).select(*at, "side", "key", "n", "label", "bits", "bands").mapInArrow(trimmed(_compare(bounds, tree)), "a long, b long")


def _links(docs: DataFrame, marked: DataFrame, scratch: Scratch, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) between set keys that connect all verified pairs."""
    spark = docs.sparkSession
    classes = scratch.save(marked.filter("n > 0").groupBy("key").agg(F.min("n").alias("n"), F.min("fp").alias("fp")), "distinct")
    first = scratch.save(_index_pairs(classes, scratch, similarity), "index")
    bands = marked.filter("n > 0").select("key", "n", F.posexplode("bands").alias("band", "hash")).distinct()
    bands = scratch.save(bands, "bands")
    shared = bands.groupBy("band", "hash").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least <> most")
    shared = scratch.save(shared.select("band", "hash"), "shared")
    found = scratch.save(bands.join(shared, ["band", "hash"], "left_semi"), "candidates")
    scratch.drop("bands")
    wanted = found.select("key").union(first.select("a")).union(first.select("b")).distinct()
    sets = docs.select("text").mapInArrow(trimmed(_sets(shingle)), "key long, grams array<long>")
    sets = scratch.save(sets.join(wanted, "key", "left_semi").dropDuplicates(["key"]), "sets")
    links = scratch.save(_verified(first, sets, similarity), "links-index")

    def apart(name: str) -> DataFrame:
        """The candidates of buckets whose classes are not all connected yet, with their labels."""
        labels = connected_components(links, Scratch(spark, "near_dup_labels")).select(F.col("node").alias("key"), "label")
        d = found.join(labels, "key", "left").select("band", "hash", "key", "n", F.coalesce("label", "key").alias("label"))
        open_ = d.groupBy("band", "hash").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("band", "hash")
        return scratch.save(d.join(open_, ["band", "hash"], "left_semi"), name)

    rest = apart("rest-0")
    signatures = sets.join(rest.select("key").distinct(), "key", "left_semi").mapInArrow(trimmed(_signatures), "key long, bits binary, bands binary")
    signatures = scratch.save(signatures, "signatures")
    pairs = _compared(rest, signatures, similarity, tree=True).distinct().join(first, ["a", "b"], "left_anti")
    tried = scratch.save(pairs, "tree")
    links = links.unionByName(scratch.save(_verified(tried, sets, similarity), "links-tree"))
    pairs = _compared(apart("rest-1"), signatures, similarity, tree=False).join(first.unionByName(tried), ["a", "b"], "left_anti")
    return links.unionByName(scratch.save(_verified(scratch.save(pairs, "leftovers"), sets, similarity), "links-rest"))


def _marked(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, row1, row2 (the row's hash), key and label (of its group) of every row."""
    scratch = Scratch(docs.sparkSession, "near_dup")
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", row_marks(docs).alias("m")).select("doc_id", "text", "m.*")
    schema = "doc_id long, row1 long, row2 long, key long, n long, fp long, bands array<long>"
    marked = scratch.save(source.mapInArrow(trimmed(_marks(shingle)), schema), "marks")
    labels = connected_components(_links(docs, marked, scratch, shingle, similarity), Scratch(docs.sparkSession, "near_dup_labels"))
    classes = marked.select("key").distinct().join(labels.select(F.col("node").alias("key"), "label"), "key", "left")
    classes = scratch.save(classes.select("key", F.coalesce("label", "key").alias("label")), "classes")
    return marked.join(classes, "key").select("doc_id", "row1", "row2", "key", "label")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, key (a hash of the shingle set), label and component_id, the smallest doc_id of the linked documents.

    Documents link at a Jaccard similarity of `similarity` or more over
    distinct shingles of lower-cased (A-Z) words; a shorter text is one
    shingle, and texts without words, null ones among them, link to each other
    only.  A null doc_id is no component_id unless its component has no other.
    Rows that repeat a doc_id count each by its text.  Other columns are
    ignored.  An empty table gives an empty result.
    """
    marked = _marked(docs, shingle, similarity)
    least = marked.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return marked.join(least, "label").select("doc_id", "key", "label", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each linked group: that of the smallest doc_id.

    A null doc_id comes last; of rows that share the smallest id, one chosen
    by a hash of the row stays, the same in every run.  Rows of one doc_id
    whose texts do not link are in different groups, and each may stay.

    A pair is found by chance: one of similarity 0.8 that the index has not
    found shares no band with a probability of 1e-5 and is then missed, more
    similar ones with less.  Pairs that meet are never lost.
    """
    return keep_rows(docs, _marked(docs, shingle, similarity))
