"""Approximate nearest neighbours with a hash-prefix forest.

A tree gives every vector a long string of hash bits, the signs of projections
on random directions, and keeps the strings of a block of vectors as one
sorted array.  A query descends each tree by binary search to its longest
matching prefix, which varies from tree to tree and query to query, and then
all trees ascend together, one bit at a time, until enough candidates share a
prefix with the query in some tree.  Candidates are scored by exact cosine.

Vectors are dealt into blocks of bounded size.  Each block's forest is built
once, in the task that has its vectors, and the queries are streamed past it;
the best few of each block are merged by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read

#: Trees in the forest and bits of a hash string.
TREES, BITS = 64, 48

#: The ascent stops once candidates number this share of a block, or all of it.
#: Near-random vectors of 64 dimensions need as much: at 0.55 the recall is 0.96 to 0.99 for 500 to 10,000 of them.
SHARE = 0.55

#: Vectors in a block at most, and numbers in it; queries that are looked up together.
BLOCK_ROWS, BLOCK_VALUES, QUERY_ROWS = 20_000, 8_000_000, 256

SEED = 20_240_601


def directions(dimensions: int, trees: int, bits: int) -> np.ndarray:
    """The same random directions in every task."""
    return np.random.default_rng(SEED).standard_normal((dimensions, trees * bits)).astype(np.float32)


def _strings(x: np.ndarray, planes: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """Hash strings as numbers: one row for each tree."""
    weights = np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
    signs = (x.astype(np.float32) @ planes > 0).reshape(len(x), trees, bits)
    return (signs * weights).sum(axis=2, dtype=np.uint64).T


class PrefixForest:
    """Sorted hash strings of one block of unit vectors."""

    def __init__(self, units: np.ndarray, trees: int = TREES, bits: int = BITS):
        self.bits = bits
        self.planes = directions(units.shape[1], trees, bits)
        strings = np.concatenate([_strings(x, self.planes, trees, bits) for x in np.array_split(units, max(1, len(units) // 2000))], axis=1)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)
        self.count = len(units)

    def candidates(self, queries: np.ndarray, least: int, group: np.ndarray | None = None) -> list[np.ndarray]:
        """For each query the rows that share a prefix with it in some tree.

        The common depth is the greatest at which `least` rows do, or zero,
        where all rows do.  With a group number for each row, groups are counted.
        """
        trees = len(self.sorted)
        strings = _strings(queries, self.planes, trees, self.bits)
        low = np.empty((self.bits + 1, trees, len(queries)), np.int64)
        high = np.empty_like(low)
        for depth in range(self.bits + 1):
            shift = np.uint64(self.bits - depth)
            start = (strings >> shift) << shift
            stop = start + ((np.uint64(1) << shift) - np.uint64(1))
            for t in range(trees):
                low[depth, t] = np.searchsorted(self.sorted[t], start[t], "left")
                high[depth, t] = np.searchsorted(self.sorted[t], stop[t], "right")
        spans = (high - low).sum(axis=1)
        found = []
        for q in range(len(queries)):
            seen, n = np.zeros(self.count, bool), 0
            # no more rows than the spans hold: start where they could suffice
            depth = int(np.flatnonzero(spans[:, q] >= min(least, self.count))[-1])
            for d in range(depth, -1, -1):
                for t in range(trees):
                    seen[self.order[t, low[d, t, q] : high[d, t, q]]] = True
                n = int(seen.sum()) if group is None else len(np.unique(group[seen]))
                if n >= least:
                    break
            found.append(np.flatnonzero(seen))
        return found


def _matrix(columns: list[pa.Array]) -> np.ndarray:
    """Vectors as rows, each divided by a power of two so that no square over- or underflows; cosines do not change."""
    flat = np.concatenate([np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.float64) for c in columns])
    x = flat.reshape(sum(len(c) for c in columns), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


class _Block:
    """The vectors of one block with their forest."""

    def __init__(self, columns: list[pa.Array], ids: np.ndarray, k: int, share: float, trees: int, bits: int):
        self.x, self.ids, self.k = _matrix(columns), ids, k
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.unit = self.x / self.norm[:, None]
        self.forest = PrefixForest(self.unit, trees, bits)
        self.distinct, self.group = np.unique(ids, return_inverse=True)
        self.single = len(self.distinct) == len(ids)
        self.least = max(k + 1, int(share * len(self.distinct)))

    def search(self, columns: list[pa.Array], own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query id, vec_id, score) of the k nearest rows found for each query, one row for each vec_id."""
        y = _matrix(columns)
        norm = np.sqrt((y * y).sum(axis=1))
        unit = y / norm[:, None]
        for i, rows in enumerate(self.forest.candidates(unit, self.least, None if self.single else self.group)):
            rows = rows[self.ids[rows] != own[i]]
            near = self.unit[rows] @ unit[i]
            if len(rows) > 4 * self.k:  # ties at the edge stay in
                best = near
                if not self.single:  # the edge is that of the nearest rows of k vec_ids
                    best = np.full(len(self.distinct), -np.inf)
                    np.maximum.at(best, self.group[rows], near)
                edge = np.partition(best, -min(self.k, len(best)))[-min(self.k, len(best))] - 1e-9
                rows = rows[near >= edge]
            score = (self.x[rows] * y[i]).sum(axis=1) / (self.norm[rows] * norm[i])
            best = np.lexsort((self.ids[rows], -score))
            if not self.single:
                best = best[np.sort(np.unique(self.ids[rows[best]], return_index=True)[1])]
            best = best[: self.k]
            yield np.full(len(best), own[i]), self.ids[rows[best]], score[best]


def _search(k: int, share: float, trees: int, bits: int):
    """For rows (dim, block, query, vec_id, v) sorted by block, vectors before queries: the nearest in each block."""
    names = ["query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: list[tuple[pa.Array, np.ndarray]] = []
        block: _Block | None = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "block", "query")])
            cuts = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                dim, number, query = keys[:, a].tolist()
                part = batch.slice(a, b - a)
                if (dim, number) != at:
                    at, held, block = (dim, number), [], None
                ids = part.column("vec_id").to_numpy()
                if not query:
                    held.append((part.column("v"), ids))
                    continue
                if not held and block is None:
                    continue
                if block is None:
                    block, held = _Block([v for v, _ in held], np.concatenate([i for _, i in held]), k, share, trees, bits), []
                for q in range(0, len(ids), QUERY_ROWS):
                    found = list(block.search([part.column("v").slice(q, QUERY_ROWS)], ids[q : q + QUERY_ROWS]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)

    return run


def usable(column: str) -> F.Column:
    """True for a vector without null or non-finite parts and with a length over zero."""
    bad = F.exists(column, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(column, lambda e: e != 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, share: float = SHARE, trees: int = TREES, bits: int = BITS) -> DataFrame:
    """The k rows of vectors with the largest cosine found for each query.

    Both tables have vec_id and embedding; other columns are ignored.  A row
    of the query's own vec_id is no candidate.  Returns query_id, rank (from
    1, ties to the smaller vec_id), vec_id and score, the cosine in double
    precision on the given vectors.  Null, zero, non-finite vectors, and null
    ids, take no part; vectors of another dimension than a query's are not
    compared with it.  Of rows that share a vec_id the nearest counts, of
    queries that share one too.  Components of any size are compared without
    overflow.  A query without candidates has no rows, an empty table gives
    none.
    """
    part = lambda df: df.select(df["vec_id"].cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable("v")).withColumn("dim", F.size("v"))
    x, y = part(vectors).dropDuplicates(["vec_id", "v"]), part(queries).dropDuplicates(["vec_id", "v"])
    n, widest = x.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    blocks = max(1, -(-n // max(1, min(BLOCK_ROWS, BLOCK_VALUES // widest))))
    x = x.select("dim", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("query"), "vec_id", "v")
    y = y.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("query"), "vec_id", "v")
    met = x.unionByName(y).repartition("dim", "block").sortWithinPartitions("dim", "block", "query")
    found = met.mapInArrow(_search(k, share, trees, bits), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
