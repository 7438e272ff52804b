"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that differ in at most `distance` bits agree in one of
distance + 1 disjoint bit ranges.  The index's uppermost nodes are these
shared masked patterns: Spark deals distinct fingerprints out to them.  A node
with too many members is divided again by the same rule on the bits that its
pattern leaves open, until it is small; a pattern of almost all bits has few
members whatever the data.  Within a node the members are sorted by the rank
of their fingerprint in the reflected Gray code, consecutive ones form groups,
groups form higher groups, and each keeps the bits that all below it share.
A query goes down this tree and adds up its differences on shared bits; a
whole group is pruned once they exceed the distance.

A node gives back a star for each of its connected parts, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunks, keep_rows, read, row_marks
from .components import connected_components

SHINGLE_WORDS, DISTANCE, SEED = 3, 2, 42

#: Members of an index node above which it is divided.
NODE_MEMBERS = 2048

#: Members of the lowest groups in Gray order, and groups under a higher one.
LEAF, FAN = 16, 8

_LANES = np.uint64(0x0101010101010101)


def _bit_counts(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row the number of its hashes with each bit set: rows x 64."""
    rows = len(offsets) - 1
    out = np.zeros((rows, 64), np.int64)
    size = np.diff(offsets)
    full = np.flatnonzero(size > 0)
    if not len(full):
        return out
    # eight counters of eight bits in a word; they hold 255 hashes, so rows are cut there
    parts = -(-size[full] // 255)
    owner = np.repeat(full, parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = offsets[owner] + nth * 255
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, start)
        lanes = sums.view(np.uint8).reshape(-1, 8) if sums.dtype.byteorder in "=<" else sums.byteswap().view(np.uint8).reshape(-1, 8)
        np.add.at(out[:, bit::8], owner, lanes.astype(np.int64))
    return out


def bit_fingerprints(hashes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each run of hashes: a bit is set if it is in over half of them."""
    bits = _bit_counts(hashes, edge) * 2 > np.diff(edge)[:, None]
    return (bits * (np.uint64(1) << np.arange(64, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def fingerprints(texts: list[str | None], shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit SimHash of each text: a bit is set if it is in over half of the shingles' XXH64."""
    offsets, values = [0], []
    for text in texts:
        words = text.encode().lower().split() if text else []
        if words:
            line = b" ".join(words)
            if len(words) <= shingle:
                values.append(xxhash.xxh64_intdigest(line, SEED))
            else:
                size = np.fromiter(map(len, words), np.int64, len(words))
                end = np.cumsum(size + 1) - 1
                begin = end - size
                values += [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(begin[: 1 - shingle].tolist(), end[shingle - 1 :].tolist(), strict=True)]
        offsets.append(len(values))
    return bit_fingerprints(np.array(values, np.uint64), np.array(offsets))


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE_WORDS, marks: bool = False) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; with marks also row1 and row2, the row's hash."""
    names = ["doc_id", "row1", "row2"] if marks else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            fp = fingerprints(part.column("text").to_pylist(), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(fp)], names=[*names, "fp"])

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", *([row_marks(docs).alias("m")] if marks else []))
    source = source.select("doc_id", "text", "m.*") if marks else source
    return source.mapInArrow(run, ", ".join(f"{n} long" for n in (*names, "fp")))


def split_mask(mask: int, parts: int) -> list[int]:
    """Disjoint masks that share out the set bits of mask evenly, high bits first."""
    bits = [b for b in range(63, -1, -1) if mask >> b & 1]
    edges = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(edges[:-1], edges[1:], strict=True)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each number in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Groups of Gray-ordered fingerprints with the bits that their members share."""

    def __init__(self, fp: np.ndarray, node: np.ndarray):
        """fp: fingerprints sorted by node and Gray rank; no group crosses a node."""
        self.fp = fp
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        low = high = fp
        owner, fan = node, LEAF
        while True:
            new = np.r_[True, owner[1:] != owner[:-1]]
            first = np.flatnonzero(new)
            at = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
            start = np.flatnonzero(at % fan == 0)
            end = np.r_[start[1:], len(owner)]
            low, high = np.bitwise_and.reduceat(low, start), np.bitwise_or.reduceat(high, start)
            self.levels.append((start, end, ~(low ^ high), low))
            owner = owner[start]
            if len(np.unique(owner)) == len(owner):
                self.roots = owner
                return
            fan = FAN

    def links(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows a < b of the same node that differ in at most `distance` bits."""
        top = self.levels[-1]
        # every member meets the root of its node
        span = top[1] - top[0]
        node = np.repeat(np.arange(len(span)), span)
        for level in self.levels[-2::-1]:
            node = np.repeat(node, level[1] - level[0])
        query, group = np.arange(len(self.fp)), node
        seen = np.zeros(len(query), np.int64)
        above = np.zeros(len(query), np.uint64)
        for start, end, mask, value in self.levels[::-1]:
            seen = seen + np.bitwise_count((self.fp[query] ^ value[group]) & mask[group] & ~above)
            keep = seen <= distance
            query, group, seen = query[keep], group[keep], seen[keep]
            above = mask[group]
            size = end[group] - start[group]
            child = np.repeat(start[group], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            query, seen, above, group = np.repeat(query, size), np.repeat(seen, size), np.repeat(above, size), child
        keep = group > query
        query, group, seen, above = query[keep], group[keep], seen[keep], above[keep]
        near = seen + np.bitwise_count((self.fp[query] ^ self.fp[group]) & ~above) <= distance
        return query[near], group[near]


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least connected row of each row."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
        live = label[a] != label[b]
        a, b = a[live], b[live]
    return label


def _leaf_links(distance: int):
    """For a stream of (taken, pattern, fp) sorted by node: a star for each connected part."""

    def links(node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((gray_rank(fp), node))
        fp, node = fp[order], node[order]
        label = stars(len(fp), *GrayIndex(fp, node).links(distance))
        move = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[label[move]].view(np.int64)), pa.array(fp[move].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = np.stack([*columns[:3]])
            held.append(rows)
            all_rows = np.concatenate(held, axis=1)
            new = np.flatnonzero((np.diff(all_rows[0]) != 0) | (np.diff(all_rows[1]) != 0)) + 1
            if len(new):
                done, held = all_rows[:, : new[-1]], [all_rows[:, new[-1] :]]
                edge = np.r_[0, np.cumsum((np.diff(done[0]) != 0) | (np.diff(done[1]) != 0))]
                yield links(edge, np.ascontiguousarray(done[2]).view(np.uint64))
        if held:
            done = np.concatenate(held, axis=1)
            yield links(np.zeros(done.shape[1], np.int64), np.ascontiguousarray(done[2]).view(np.uint64))

    return run


def fingerprint_links(distinct: DataFrame, distance: int, scratch: Scratch, members: int = NODE_MEMBERS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints `fp` within the distance.

    Not every pair: in each index node a star for each connected part.
    """
    full = (1 << 64) - 1

    def nodes(df: DataFrame, masks: list[int]) -> DataFrame:
        """Deal fingerprints to the parts of the bits that their node leaves open."""
        rows = [(_signed(taken), _signed(taken | own)) for taken in masks for own in split_mask(full & ~taken, distance + 1)]
        plan = F.array(*(F.struct(F.lit(t).cast("long").alias("t"), F.lit(m).cast("long").alias("mask")) for t, m in rows))
        new = df.withColumn("p", F.explode(F.filter(plan, lambda x: x["t"] == F.col("taken"))))
        return new.select("fp", F.col("p.mask").alias("taken"), F.col("fp").bitwiseAND(F.col("p.mask")).alias("pattern"))

    level, masks, found = 0, [0], []
    rest = distinct.select("fp", F.lit(0).cast("long").alias("taken"))
    while True:
        dealt = scratch.save(nodes(rest, masks), f"nodes-{level}")
        masks = [t | own for t in masks for own in split_mask(full & ~t, distance + 1)]
        sizes = dealt.groupBy("taken", "pattern").agg(F.count("*").alias("n")).filter("n > 1")
        sizes = scratch.save(sizes, f"sizes-{level}")
        last = min(bin(full & ~t).count("1") for t in masks) <= members.bit_length() - 1
        small = sizes if last else sizes.filter(F.col("n") <= members)
        leaf = dealt.join(small.select("taken", "pattern"), ["taken", "pattern"], "left_semi")
        leaf = leaf.repartition("taken", "pattern").sortWithinPartitions("taken", "pattern").select("taken", "pattern", "fp")
        found.append(scratch.save(leaf.mapInArrow(_leaf_links(distance), "a long, b long"), f"links-{level}"))
        large = sizes.filter(F.col("n") > members)
        if last or not large.head(1):
            break
        rest = dealt.join(large.select("taken", "pattern"), ["taken", "pattern"], "left_semi").select("fp", "taken")
        level += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _components(marked: DataFrame, distance: int, scratch: Scratch) -> DataFrame:
    """(fp, label, component_id) of every distinct fingerprint of marked: doc_id, fp."""
    classes = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links = fingerprint_links(classes.select("fp"), distance, scratch)
    labels = connected_components(links, scratch).select(F.col("node").alias("fp"), "label")
    linked = classes.join(labels, "fp")
    least = linked.groupBy("label").agg(F.min("least").alias("component"))
    linked = linked.select("fp", "label").join(least, "label").select("fp", "label", "component")
    found = classes.join(linked, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), F.coalesce("component", "least").alias("component_id"))
    return scratch.save(found, "components")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint and component_id of every document.

    Texts are lower-cased (A-Z), split into words and hashed as runs of
    `shingle` words, repeats included; fewer words make one shingle, none make
    fingerprint zero, which links like any other.  Fingerprints link at
    `distance` or fewer differing bits; component_id is the smallest doc_id
    of the linked documents.

    A null text has no words.  Equal rows share a component.  A null doc_id
    stays and is no component_id unless its component has no other.  Long
    texts are read whole.  Other columns are ignored.  An empty table gives an
    empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.save(with_fingerprint(docs, shingle), "fingerprints")
    classes = _components(marked, distance, scratch)
    return marked.join(classes, "fp").select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each linked group: that of the smallest doc_id.

    A null doc_id comes last; of rows that share the smallest id, one chosen
    by a hash of the row stays, the same in every run.  Rows of one doc_id
    whose texts do not link are in different groups, and each may stay.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.save(with_fingerprint(docs, shingle, marks=True), "fingerprints")
    return keep_rows(docs, marked.join(_components(marked, distance, scratch), "fp"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
