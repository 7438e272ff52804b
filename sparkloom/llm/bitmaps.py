"""Bounds of set similarity, and parity bitmaps that bound how much two sets differ."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a parity bitmap at least and at most.
LEAST_BITS, MOST_BITS = 64, 1 << 17


class Bounds:
    """Sizes that follow from a similarity num / den, exactly in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, n: np.ndarray) -> np.ndarray:
        """Tokens that a set of n shares at least with any set that links to it."""
        return -(-self.num * n // self.den)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - self.overlap(n) + 1

    def slack(self, n: np.ndarray) -> np.ndarray:
        return 1 + (self.den - self.num) * n // self.den

    def long_prefix(self, n: np.ndarray) -> np.ndarray:
        """A prefix of which a linked set shares `shared(n)` tokens with its partner's, whatever the partner's size."""
        return np.minimum(n, n - self.overlap(n) + self.slack(n))

    def shared(self, n: np.ndarray) -> np.ndarray:
        # the least slack of a partner, which has overlap(n) tokens at least
        return self.slack(self.overlap(n))

    def apart(self, n: np.ndarray, m: np.ndarray, differ: np.ndarray) -> np.ndarray:
        """Whether sets of n and m tokens that differ in so many at least cannot link."""
        return (differ * (self.den + self.num) > (n + m) * (self.den - self.num)) | (np.minimum(n, m) * self.den < self.num * np.maximum(n, m))

    def alike(self, n: Column, m: Column) -> Column:
        return F.least(n, m) * self.den >= F.greatest(n, m) * self.num

    def linked(self, n: Column, m: Column, shared: Column) -> Column:
        return shared * (self.den + self.num) >= (n + m) * self.num


def bit_count_of(n: np.ndarray, each: int = 1) -> np.ndarray:
    """Bits of the parity bitmap of a set of n tokens: a power of two, `each` for a token at least."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1) * each)).astype(np.int64), LEAST_BITS, MOST_BITS)


def parities(grams: np.ndarray, bits: int) -> np.ndarray:
    """A bit for each hash value: whether an odd number of tokens has it.  Two sets differ in as many tokens at least as bits."""
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray) -> np.ndarray:
    """Bitmaps (last axis) of half the bits."""
    half = words.shape[-1] // 2
    return words[..., :half] ^ words[..., half:]


def whole_nodes(batches: Iterator[pa.RecordBatch], names: list[str], rows: int) -> Iterator[list[pa.Table]]:
    """Tables of one node each from rows in the order of the node's columns, about so many rows at a time."""

    def cuts(table: pa.Table) -> np.ndarray:
        return np.flatnonzero(np.any([np.diff(table.column(c).to_numpy()) != 0 for c in names], axis=0)) + 1

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held)
        at = cuts(table)
        if len(at):  # the last node may go on in the next batch
            yield [table.slice(a, b - a) for a, b in zip(np.r_[0, at[:-1]], at, strict=True)]
            held = table.slice(int(at[-1])).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        at = np.r_[0, cuts(table), table.num_rows]
        yield [table.slice(a, b - a) for a, b in zip(at[:-1], at[1:], strict=True)]


def node_pairs(chunk: np.ndarray, n: np.ndarray, label: np.ndarray, before: np.ndarray, bits: list[bytes], bounds: Bounds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i, j of pairs of different labels that may link, and their least difference.

    In a node of two chunks only pairs across them count; a pair that has the
    same key before this one has met there.
    """
    words = np.array([len(b) // 8 for b in bits])
    across, found = len(np.unique(chunk)) > 1, []
    for w in np.unique(words):
        own = np.flatnonzero(words == w)
        maps = np.frombuffer(b"".join(bits[i] for i in own), np.uint64).reshape(len(own), w)
        twice = np.flatnonzero(words == 2 * w)
        if len(twice):  # a partner has up to twice the bits: similar sets have similar sizes
            more = folded(np.frombuffer(b"".join(bits[i] for i in twice), np.uint64).reshape(len(twice), 2 * w))
            others, all_maps = np.r_[own, twice], np.concatenate([maps, more])
        else:
            others, all_maps = own, maps
        for k, i in enumerate(own):
            j = others[k + 1 :]
            may = (label[j] != label[i]) & ((before[j] != before[i]) | (before[i] == 0))
            if across:
                may &= chunk[j] != chunk[i]
            may &= ~bounds.apart(n[i], n[j], np.zeros(len(j), np.int64))
            at = np.flatnonzero(may)
            differ = np.bitwise_count(all_maps[k + 1 :][at] ^ maps[k]).sum(axis=1, dtype=np.int64)
            good = ~bounds.apart(n[i], n[j[at]], differ)
            found.append(np.stack([np.full(int(good.sum()), i), j[at[good]], differ[good]]))
    return tuple(np.concatenate(found, axis=1)) if found else tuple(np.zeros((3, 0), np.int64))
