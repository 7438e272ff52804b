"""Shared helpers: table reading, scratch tables, Arrow word splitting, n-gram hashes.

Words are the maximal runs of characters outside space and U+0009..U+000D,
the same set everywhere in this package; a null text has no words.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A Java and Python regular expression for one word.
WORD = r"[^\x20\x09-\x0D]+"

#: UTF-8 bytes of text that one numpy pass inside a task handles together.
CHUNK_BYTES = 3 << 20

#: Target UTF-8 bytes of text in one hash block of documents.
BLOCK_BYTES = 6 << 20

#: Fewest hash blocks, so that small inputs still spread over a cluster, and their number from which they grow.
MIN_BLOCKS, MOST_BLOCKS = 96, 2_000_000

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def row_crc(column: str = "doc_id") -> Column:
    """CRC-32 of a column's text; of the empty text where it is null."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Parquet tables in the folder that all executors share.

    The folder is the session's spark.checkpoint.dir.  Where it is unset, a
    local master gets a temporary one and any other master an error, since
    executors do not see each other's disks.

    Each write cuts the lineage: a lost executor costs only the step at hand.
    Shuffle files of a step go away when its table is written.  The folder
    goes away when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._delete(self.root, at_exit=True)

    def _delete(self, path: str, at_exit: bool = False) -> None:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if at_exit:
            fs.mkdirs(place)
            fs.deleteOnExit(place)
        else:
            fs.delete(place, True)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")


def trimmed(run: Callable) -> Callable:
    """A map over Arrow batches after which the Python worker gives its free memory back.

    Workers stay for the next stages; what the allocators keep of a stage
    would count beside what these need.
    """

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return kept


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def row_marks(docs: DataFrame) -> Column:
    """Two hashes, row1 and row2, of a row's columns but for maps and variants: equal rows have equal ones."""
    own = [docs[f"`{f.name}`"] for f in docs.schema if _hashable(f.dataType)]
    return F.struct(F.xxhash64(F.lit(1), *own).alias("row1"), F.xxhash64(F.lit(2), *reversed(own)).alias("row2"))


def keep_rows(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """docs with the first row of each label: the smallest doc_id, then the least hash; null ids last.

    marked: doc_id, row1, row2 and label of every row of docs.  Equal rows
    have one hash and stand for one another.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row1", "row2")
    first = marked.groupBy("label").agg(F.min(order).alias("w")).select("w.row1", "w.row2").distinct()
    again = marked.groupBy("row1", "row2").agg(F.count("*").alias("n")).filter("n > 1").select("row1", "row2")
    first = first.join(again.withColumn("again", F.lit(True)), ["row1", "row2"], "left")
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"), row_marks(docs).alias("_mark")).select("_row", "_mark.*")
    single = rows.join(first.filter("again is null").select("row1", "row2"), ["row1", "row2"], "left_semi")
    equal = rows.join(first.filter("again").select("row1", "row2"), ["row1", "row2"], "left_semi").dropDuplicates(["row1", "row2"])
    return single.unionByName(equal).select("_row.*")


def block_bytes(total: int) -> int:
    """Bytes of text in a block: more as the input grows, so that a key of all blocks has a bounded number of entries."""
    return min(max(BLOCK_BYTES, total // MOST_BLOCKS), 4 * BLOCK_BYTES)


def block_count(docs: DataFrame) -> int:
    """Hash blocks for these documents: their number follows the bytes of text."""
    total = int(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    return max(MIN_BLOCKS, -(-total // block_bytes(total)))


def with_block(docs: DataFrame, blocks: int, scratch: Scratch, extra: bool = False) -> DataFrame:
    """doc_id, text and a block number that depends on nothing but the two.

    With extra, all other columns ride along in one struct of that name, so
    that no name of theirs can clash.  Equal rows of more text than a block
    holds would fall into one; they are dealt out to several, and what they
    are dealt out to is written down, so that every later step sees the same.
    """
    own = F.xxhash64("doc_id", "text")
    rest = [docs[f"`{c}`"] for c in docs.columns if c not in ("doc_id", "text")]
    more = [F.struct(*rest).alias("extra")] if extra and rest else []
    block = lambda *salt: F.pmod(F.xxhash64("doc_id", "text", *salt), F.lit(blocks)).cast("int").alias("block")
    sizes = docs.select(own.alias("h"), F.octet_length("text").cast("long").alias("bytes")).groupBy("h").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    heavy = scratch.save(sizes.filter((F.col("bytes") > BLOCK_BYTES) & (F.col("n") > 1)), "heavy")
    if not heavy.head(1):
        return docs.select("doc_id", "text", block(), *more)
    shares = heavy.select("h", F.ceil(F.col("bytes") / BLOCK_BYTES).alias("shares"))
    salted = docs.select("doc_id", "text", own.alias("h"), F.monotonically_increasing_id().alias("place"), *more).join(shares, "h", "left")
    salt = F.coalesce(F.pmod(F.col("place"), F.col("shares")), F.lit(0))
    salted = salted.select("doc_id", "text", F.when(salt == 0, block()).otherwise(block(salt)).alias("block"), *(["extra"] if more else []))
    return scratch.save(salted, "blocks")


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text; one longer text is a batch of its own.

    They are copies: some of Arrow's string kernels misread a slice's offset.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.take(pa.array(np.arange(a, b)))


def split_words(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of many texts: row offsets, a code for each word, and the distinct words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = pc.not_equal(pc.binary_length(flat), 0)
    keep = full.to_numpy(zero_copy_only=False)
    if not keep.all():
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        flat = flat.filter(full)
    coded = flat.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _B
    x ^= x >> np.uint64(27)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the ordered pair."""
    return mix(a * _A + b)


def ngram_hashes(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of every k consecutive entries, by doubling; empty when there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, width = mix(h ^ np.uint64(seed)), 1
    out, done = None, 0
    while True:
        if k & 1:
            out = power if out is None else join_hashes(out[: len(power) - done], power[done:])
            done += width
        k >>= 1
        if not k:
            return out[:n]
        power, width = join_hashes(power[:-width], power[width:]), width * 2


def pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte plane by byte plane: what is alike comes together."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """One byte for each count; those of 255 and more follow at the end in full."""
    large = counts >= 255
    return pack(np.where(large, 255, counts).astype(np.uint8)) + pack(counts[large].astype(np.int64))


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, np.int64, offset=n) if len(data) > n else 0
    return counts


def bucket_order(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys by hash bucket, ascending in each: their buckets, and the order."""
    bucket = (keys % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    return bucket[order], order


def hash_chunks(block: int, keys: np.ndarray, counts: np.ndarray, buckets: int, keys2: np.ndarray | None = None, kind: int = 0) -> pa.Table:
    """A block's keys and counts, packed into one row for each hash bucket of the key space.

    Keys are ascending.  Those of different kinds are counted apart.
    """
    bucket, order = bucket_order(keys, buckets)
    starts = np.flatnonzero(np.r_[len(keys) > 0, np.diff(bucket) != 0])
    ends = np.r_[starts[1:], len(keys)].astype(int)

    spans = [order[a:b] for a, b in zip(starts, ends, strict=False)]
    cut = lambda x, how: pa.array([how(x[i]) if x is not None else b"" for i in spans], pa.binary())
    kinds, blocks = (pa.array([x] * len(starts), pa.int32()) for x in (kind, block))
    columns = [kinds, pa.array(bucket[starts], pa.int32()), blocks, cut(keys, pack_sorted), cut(keys2, pack), cut(counts, pack_counts)]
    return pa.table(columns, names=["kind", "bucket", "block", "keys", "keys2", "counts"])


CHUNK_SCHEMA = "kind int, bucket int, block int, keys binary, keys2 binary, counts binary"
TOTAL_SCHEMA = "kind int, bucket int, block int, totals binary, size long, n_keys long, n_counts long"


def unpack(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def unpack_keys(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [unpack_sorted(x) for x in column.to_pylist()]


def _group_totals(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Entries of a bucket's chunks in key order: (chunk sizes, order, key, key2 or none, totals, sums by key)."""
    keys = unpack_keys(table.column("keys"))
    sizes = np.array([len(k) for k in keys], np.int64)
    key, key2 = np.concatenate(keys), np.concatenate(unpack(table.column("keys2")))
    count = np.concatenate([unpack_counts(x, n) for x, n in zip(table.column("counts").to_pylist(), sizes.tolist(), strict=True)])
    two = len(key2) == len(key)
    order = np.lexsort((key2, key)) if two else np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    new = np.diff(key) != 0
    if two:
        key2 = key2[order]
        new |= np.diff(key2) != 0
    starts = np.flatnonzero(np.r_[len(key) > 0, new])
    sums = np.add.reduceat(count, starts) if len(starts) else count
    return sizes, order, key, key2, np.repeat(sums, np.diff(np.r_[starts, len(key)])), sums


def repeated_keys(packed: DataFrame, least: int = 2) -> DataFrame:
    """For each block, packed, its keys whose counts over all blocks come to `least`.

    One group is one hash bucket of the key space.  A block sends a key once,
    so a very common key has no more entries here than there are blocks.
    """

    def run(table: pa.Table) -> pa.Table:
        sizes, order, key, key2, total, _ = _group_totals(table)
        block = np.repeat(table.column("block").to_numpy(), sizes)[order]
        good = np.flatnonzero(total >= least)
        good = good[np.argsort(block[good], kind="stable")]
        at = block[good]
        cuts = np.flatnonzero(np.r_[len(at) > 0, np.diff(at) != 0])
        spans = [good[a:b] for a, b in zip(cuts, np.r_[cuts[1:], len(at)].astype(int), strict=False)]
        second = [pack(key2[i]) if len(key2) == len(key) else b"" for i in spans]
        columns = [pa.array(at[cuts], pa.int32()), pa.array([pack_sorted(key[i]) for i in spans], pa.binary()), pa.array(second, pa.binary())]
        return pa.table(columns, names=["block", "keys", "keys2"])

    return packed.groupBy("kind", "bucket").applyInArrow(run, "block int, keys binary, keys2 binary")


def key_totals(packed: DataFrame, least: tuple[int, ...]) -> DataFrame:
    """For each chunk the totals of its keys over all blocks, in the chunk's order.

    A block that makes its chunks again can tell the totals by their places,
    so no key travels back.  Totals of kind k under least[k] are zero.  A row
    with a null block has the number of a group's keys that stay and the sum
    of their totals.
    """

    def run(table: pa.Table) -> pa.Table:
        kind, bucket = (table.column(c)[0].as_py() for c in ("kind", "bucket"))
        sizes, order, _, _, total, sums = _group_totals(table)
        placed = np.empty_like(total)
        placed[order] = np.where(total >= least[kind], total, 0)
        parts = np.split(placed, np.cumsum(sizes)[:-1])
        kept, n = sums[sums >= least[kind]], len(parts)
        columns = [
            pa.array([kind] * (n + 1), pa.int32()),
            pa.array([bucket] * (n + 1), pa.int32()),
            pa.array([*table.column("block").to_pylist(), None], pa.int32()),
            pa.array([*map(pack_counts, parts), None], pa.binary()),
            pa.array([*map(len, parts), None], pa.int64()),
            pa.array([None] * n + [len(kept)], pa.int64()),
            pa.array([None] * n + [int(kept.sum())], pa.int64()),
        ]
        return pa.table(columns, names=["kind", "bucket", "block", "totals", "size", "n_keys", "n_counts"])

    return packed.groupBy("kind", "bucket").applyInArrow(run, TOTAL_SCHEMA)


def places(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each x in known, which is sorted; -1 where it is not."""
    if not len(known):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, at, -1)
