"""N-gram Jaccard join by prefix filters under several global token orders.

Two sets of a similarity t share a token among the first n - ceil(t n) + 1 of
each under any order of all tokens.  Three orders are used, and a pair has to
pass every one before its sets are intersected:

* by hash.  With twice that prefix a linked set shares half of it, so sets
  whose hash prefix is mostly their own leave before anything else is done;
* by a second hash, on the pairs that are left;
* rarest first, by exact counts over the sets that are left.  Its prefixes
  are the keys on which pairs meet.

Texts of equal sets are one class.  Only what connects classes is looked for:
each key's classes are held against its first one; keys whose classes are not
all connected by that are compared in bounded nodes, where a parity bitmap of
each set gives a lower bound of the difference: first the best pairs that
connect what may be connected, then, in what is still apart, all pairs that
the bound cannot rule out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmaps import Bounds, bit_count_of, folded, node_pairs, parities, whole_nodes
from .common import Scratch, bucket_order, chunks, mix, pack, pack_counts, pack_sorted, read, unpack_counts, unpack_sorted
from .components import connected_components
from .near_dup import _tree, set_keys, shingle_sets

SHINGLE_WORDS = 3

#: Similarity as a fraction: two sets link when DEN * intersection >= NUM * union.
NUM, DEN = 90, 100

#: Tokens in one packed row, and in one hash bucket of the token space.
PACK_TOKENS, BUCKET_TOKENS = 1 << 20, 1 << 21

#: Fewest buckets, so that small inputs still spread over a cluster.
LEAST_BUCKETS = 96

#: Classes of a key that one task compares with each other, or with as many others.
NODE_CLASSES = 1024

#: UTF-8 bytes of text that one numpy pass handles together.
TEXT_BYTES = 1 << 20

SECOND = np.uint64(0x5851F42D4C957F2D)


def _rows(shingle: int, bounds: Bounds) -> Callable:
    """For rows (doc_id, h, text): doc_id, h, key and size of the set, and its long prefix by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, most=TEXT_BYTES):
            grams, edge = shingle_sets(part.column("text"), shingle)
            n = np.diff(edge)
            ends = edge[:-1] + bounds.long_prefix(n) * (n > 0)
            pre = [pack(grams[a:b]) for a, b in zip(edge[:-1], ends, strict=True)]
            columns = [part.column("doc_id"), part.column("h"), pa.array(set_keys(grams, edge).view(np.int64)), pa.array(n, pa.int64()), pa.array(pre, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "key", "n", "grams"])

    return run


def _sets(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, most=TEXT_BYTES):
            grams, edge = shingle_sets(part.column("text"), shingle)
            sets = [pack(grams[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            columns = [pa.array(set_keys(grams, edge).view(np.int64)), pa.array(np.diff(edge), pa.int64()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "grams"])

    return run


PACK_SCHEMA = "pack long, keys binary, sizes binary, lengths binary, grams binary"


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (key, n, grams): rows of many classes each, named by their first key."""
    keys, sizes, grams, held = [], [], [], 0

    def packed() -> pa.RecordBatch:
        lengths = np.array([len(g) // 8 for g in grams], np.int64)
        columns = [pa.array([keys[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in (pack(np.array(keys, np.int64)), pack(np.array(sizes, np.int64)), pack(lengths), b"".join(grams)))]
        return pa.RecordBatch.from_arrays(columns, names=["pack", "keys", "sizes", "lengths", "grams"])

    for batch in batches:
        for key, n, g in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "grams")), strict=True):
            keys.append(key), sizes.append(n), grams.append(g)
            held += len(g) // 8
            if held >= PACK_TOKENS:
                yield packed()
                keys, sizes, grams, held = [], [], [], 0
    if keys:
        yield packed()


def _tokens(grams: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A pack's distinct tokens by bucket, ascending in each, their buckets and counts, and all its tokens' places among them."""
    token, back, count = np.unique(np.frombuffer(grams, np.uint64), return_inverse=True, return_counts=True)
    bucket, order = bucket_order(token, buckets)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return token[order], bucket, count[order], place[back]


def _sent(buckets: int) -> Callable:
    """For packs: a row for each bucket with the pack's distinct tokens there and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, grams in zip(batch.column("pack").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                token, bucket, count, _ = _tokens(grams, buckets)
                first = np.flatnonzero(np.diff(bucket, prepend=-1))
                spans = list(zip(first, [*first[1:], len(bucket)], strict=True))
                columns = [pa.array(bucket[first], pa.int32()), pa.array([name] * len(first), pa.int64())]
                columns += [pa.array([how(x[a:b]) for a, b in spans], pa.binary()) for how, x in ((pack_sorted, token), (pack_counts, count))]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "pack", "tokens", "counts"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    """Of one bucket: for each pack the totals of its tokens over all packs, in the order sent."""
    tokens = [unpack_sorted(x) for x in table.column("tokens").to_pylist()]
    counts = [unpack_counts(x, len(t)) for x, t in zip(table.column("counts").to_pylist(), tokens, strict=True)]
    _, back = np.unique(np.concatenate(tokens), return_inverse=True)
    total = np.bincount(back, np.concatenate(counts)).astype(np.int64)[back]
    parts = np.split(total, np.cumsum([len(t) for t in tokens])[:-1])
    columns = [table.column("pack").combine_chunks(), table.column("bucket").combine_chunks(), pa.array([pack_counts(x) for x in parts], pa.binary()), pa.array([len(x) for x in parts], pa.int64())]
    return pa.table(columns, names=["pack", "bucket", "totals", "size"])


def _with_totals(packs: DataFrame, buckets: int, use: Callable, schema: str) -> DataFrame:
    """use(keys, sizes, lengths, grams, totals of the grams) for each pack; a total counts the classes with a token.

    A pack sends a token once with its count and gets totals back by place, so
    a token of all classes has no more entries in its bucket than there are packs.
    """
    totals = packs.select("pack", "grams").mapInArrow(_sent(buckets), "bucket int, pack long, tokens binary, counts binary")
    totals = totals.groupBy("bucket").applyInArrow(_summed, "pack long, bucket int, totals binary, size long")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        parts = sorted(zip(*(right.column(c).to_pylist() for c in ("bucket", "totals", "size")), strict=True))
        total = np.concatenate([np.zeros(0, np.int64), *(unpack_counts(t, n) for _, t, n in parts)])
        place = _tokens(row["grams"], buckets)[3]
        keys, sizes, lengths = (np.frombuffer(row[c], np.int64) for c in ("keys", "sizes", "lengths"))
        return use(keys, sizes, lengths, np.frombuffer(row["grams"], np.uint64), total[place])

    return packs.groupBy("pack").cogroup(totals.groupBy("pack")).applyInArrow(run, schema)


def _alive(bounds: Bounds) -> Callable:
    """Classes that share as many tokens of their long prefix as a linked one does."""

    def use(keys: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, grams: np.ndarray, totals: np.ndarray) -> pa.Table:
        shared = np.add.reduceat((totals > 1).astype(np.int64), np.r_[0, np.cumsum(lengths)[:-1]])
        keep = shared >= bounds.shared(sizes)
        return pa.table([pa.array(keys[keep]), pa.array(sizes[keep])], names=["key", "n"])

    return use


def _rare_prefixes(bounds: Bounds) -> Callable:
    """For each class the tokens, rarest first, of its prefix that other classes have too; none if too few are shared."""

    def use(keys: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, grams: np.ndarray, totals: np.ndarray) -> pa.Table:
        row = np.repeat(np.arange(len(keys)), lengths)
        order = np.lexsort((grams, totals, row))  # rows stay together
        token, total, start = grams[order], totals[order], np.r_[0, np.cumsum(lengths)[:-1]]
        own = np.add.reduceat((total == 1).astype(np.int64), start)
        live = sizes - own >= bounds.overlap(sizes)
        at = np.arange(len(token)) - start[row]
        keep = live[row] & (total > 1) & (at < bounds.prefix(sizes)[row])
        count = np.bincount(row[keep], minlength=len(keys))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(token[keep].view(np.int64)))
        return pa.table([pa.array(keys), pa.array(sizes), lists], names=["key", "n", "tokens"]).filter(pa.array(count > 0))

    return use


def _sketches(bounds: Bounds) -> Callable:
    """For rows (key, n, grams): the parity bitmap, and 32 bits of each token of the two hash orders' prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, first, second = [], [], []
            for n, data in zip(batch.column("n").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                grams = np.frombuffer(data, np.uint64)
                p = int(bounds.prefix(np.int64(n)))
                bits.append(pack(parities(mix(grams.copy()), int(bit_count_of(np.int64(n))))))
                first.append(pack((grams[:p] >> np.uint64(32)).astype(np.uint32)))
                second.append(pack((np.sort(mix(grams ^ SECOND))[:p] >> np.uint64(32)).astype(np.uint32)))
            columns = [batch.column("key"), batch.column("n"), *(pa.array(x, pa.binary()) for x in (bits, first, second))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "bits", "first", "second"])

    return run


def _passing(bounds: Bounds) -> Callable:
    """Pairs (a, b) that may link by the bitmap's bound and meet in the prefixes of both hash orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            keep = []
            for i in range(batch.num_rows):
                u, v = (np.frombuffer(x[c][i], np.uint64) for c in ("bits_a", "bits_b"))
                while len(u) > len(v):
                    u = folded(u)
                while len(v) > len(u):
                    v = folded(v)
                meets = not bounds.apart(x["n_a"][i], x["n_b"][i], int(np.bitwise_count(u ^ v).sum()))
                keep.append(meets and all(np.intersect1d(np.frombuffer(x[f"{c}_a"][i], np.uint32), np.frombuffer(x[f"{c}_b"][i], np.uint32)).size for c in ("first", "second")))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sifted(pairs: DataFrame, sketches: DataFrame, bounds: Bounds) -> DataFrame:
    side = lambda s: sketches.select(F.col("key").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "bits", "first", "second")))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_passing(bounds), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, bounds: Bounds) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets link."""
    side = lambda s: sets.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("grams").alias(f"grams_{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            shared = [np.intersect1d(np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64), assume_unique=True).size for u, v in zip(x["grams_a"], x["grams_b"], strict=True)]
            n = np.array(x["n_a"], np.int64) + np.array(x["n_b"], np.int64)
            keep = np.array(shared, np.int64) * (bounds.den + bounds.num) >= n * bounds.num
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _compare(tree: bool, bounds: Bounds) -> Callable:
    """For nodes: pairs (a, b) that may link; with tree only the closest that connect what all of them connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes in whole_nodes(batches, ["token", "x", "y"], 4 * NODE_CLASSES):
            for node in nodes:
                if node.num_rows < 2:
                    continue
                chunk, key, n, label, before = (node.column(c).to_numpy() for c in ("chunk", "key", "n", "label", "before"))
                i, j, differ = node_pairs(chunk, n, label, before, node.column("bits").to_pylist(), bounds)
                if tree and len(i):
                    keep = _tree(len(key), label, i, j, -differ)
                    i, j = i[keep], j[keep]
                a, b = np.minimum(key[i], key[j]), np.maximum(key[i], key[j])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _compared(rest: DataFrame, sketches: DataFrame, tree: bool, bounds: Bounds) -> DataFrame:
    """Pairs from the open keys' classes; each two chunks of a key are a node, so no task holds more than two."""
    sizes = rest.groupBy("token").agg(F.ceil(F.count("*") / NODE_CLASSES).cast("int").alias("chunks"))
    d = rest.join(sizes, "token").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    nodes = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least("chunk", k).alias("x"), F.greatest("chunk", k).alias("y")))
    d = d.withColumn("node", F.explode(nodes)).select("token", "node.x", "node.y", "chunk", "key", "n", "label", "before").join(sketches.select("key", "bits"), "key")
    at = ["token", "x", "y"]
    return d.repartition(*at).sortWithinPartitions(*at).mapInArrow(_compare(tree, bounds), "a long, b long").distinct()


def _links(docs: DataFrame, rows: DataFrame, scratch: Scratch, shingle: int, bounds: Bounds) -> DataFrame:
    """Links (a, b) between set keys that connect all linked classes."""
    spark = docs.sparkSession
    buckets = lambda tokens: max(LEAST_BUCKETS, -(-tokens // BUCKET_TOKENS))
    tokens = lambda df: int(df.agg(F.sum(F.octet_length("grams").cast("long")) / 8).first()[0] or 0)

    classes = rows.filter("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("grams").alias("grams"))
    packs = scratch.save(classes.mapInArrow(_packs, PACK_SCHEMA), "prefix-packs")
    alive = scratch.save(_with_totals(packs, buckets(tokens(packs)), _alive(bounds), "key long, n long"), "alive")
    scratch.drop("prefix-packs")
    # one row of each class that is left has its text read again
    chosen = rows.join(alive.select("key"), "key", "left_semi").groupBy("key").agg(F.min("h").alias("h")).select("h")
    texts = docs.select("text", F.xxhash64("doc_id", "text").alias("h")).join(chosen, "h", "left_semi").select("text")
    sets = texts.mapInArrow(_sets(shingle), "key long, n long, grams binary").dropDuplicates(["key"])
    sets = scratch.save(sets.join(alive.select("key"), "key", "left_semi"), "sets")
    packs = scratch.save(sets.mapInArrow(_packs, PACK_SCHEMA), "packs")
    prefixes = scratch.save(_with_totals(packs, buckets(tokens(packs)), _rare_prefixes(bounds), "key long, n long, tokens array<long>"), "prefixes")
    scratch.drop("packs")

    keys = prefixes.select("key", "n", "tokens", F.posexplode("tokens").alias("pos", "token"))
    keys = keys.select("token", "key", "n", F.when(F.col("pos") > 0, F.get("tokens", F.col("pos") - 1)).otherwise(0).alias("before"))
    # a key of one class finds nothing; one whose classes all have the same key before has nothing to add
    groups = keys.groupBy("token").agg(F.min("key").alias("hub"), F.max("key").alias("most"), F.min("before").alias("low"), F.max("before").alias("high"))
    groups = scratch.save(groups.filter("hub <> most AND (low <> high OR low = 0)").select("token", "hub"), "groups")
    keys = scratch.save(keys.join(groups, "token"), "keys")
    sketches = sets.join(keys.select("key").distinct(), "key", "left_semi").mapInArrow(_sketches(bounds), "key long, n long, bits binary, first binary, second binary")
    sketches = scratch.save(sketches, "sketches")

    stars = scratch.save(keys.filter("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct(), "stars")
    links = scratch.save(_verified(scratch.save(_sifted(stars, sketches, bounds), "star-pairs"), sets, bounds), "star-links")

    def open_keys(name: str) -> DataFrame:
        """The rows of keys whose classes are not all connected yet, with their labels."""
        labels = connected_components(links, Scratch(spark, "jaccard_labels")).select(F.col("node").alias("key"), "label")
        d = keys.join(labels, "key", "left").select("token", "key", "n", "before", F.coalesce("label", "key").alias("label"))
        still = d.groupBy("token").agg(F.min("label").alias("u"), F.max("label").alias("v")).filter("u <> v").select("token")
        return scratch.save(d.join(still, "token", "left_semi"), name)

    tried = stars
    for name, tree in (("tree", True), ("rest", False)):
        found = _compared(open_keys(f"open-{name}"), sketches, tree, bounds).join(tried, ["a", "b"], "left_anti")
        found = scratch.save(found, f"{name}-pairs")
        tried = tried.unionByName(found)
        links = links.unionByName(scratch.save(_verified(_sifted(found, sketches, bounds), sets, bounds), f"{name}-links"))
    return links


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE_WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    A document's set are the distinct shingles of `shingle` words of its
    lower-cased (A-Z) whole text; fewer words are one shingle, none (null
    texts too) make an empty set, which links with nothing.  Documents link
    when den * intersection >= num * union (num / den over a half).
    component_id is the smallest doc_id that links reach, the row's own at
    least; null where it and all it reaches have none.  Repeated rows and
    rows of one doc_id count each by its text.  Other columns are ignored.
    An empty table gives an empty result.  Shingles and whole sets are told
    apart by 64-bit hashes.
    """
    if not den >= num > den // 2:
        raise ValueError("the similarity has to be over a half and at most one")
    scratch, bounds = Scratch(docs.sparkSession, "jaccard"), Bounds(num, den)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    marked = docs.withColumn("h", F.xxhash64("doc_id", "text")).mapInArrow(_rows(shingle, bounds), "doc_id long, h long, key long, n long, grams binary")
    marked = scratch.save(marked, "rows")
    labels = connected_components(_links(docs, marked, scratch, shingle, bounds), Scratch(docs.sparkSession, "jaccard_labels"))
    least = marked.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    least = least.join(labels.select(F.col("node").alias("key"), "label"), "key", "left").select("key", F.coalesce("label", "key").alias("label"), "least")
    by_label = least.groupBy("label").agg(F.min("least").alias("component_id"))
    named = scratch.save(least.join(by_label, "label").select("key", "component_id"), "components")
    out = marked.filter("n > 0").select("doc_id", "key", "n").join(named, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(marked.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at a Jaccard similarity of 0.9 over three-word shingles; see `jaccard_components`."""
    return jaccard_components(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
    FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM t a JOIN t b USING (t) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 90 * (na + nb - c)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(least(doc_id, b), doc_id) AS component_id FROM s LEFT JOIN least ON doc_id = a
"""
