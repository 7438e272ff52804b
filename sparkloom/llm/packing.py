"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A piece of n tokens costs n + n*n/ATTENTION_SCALE: a linear part and the
quadratic part of attention.  Within a shard of documents, pieces in
descending order go to the sequence of lowest cost that has room for them;
what fits nowhere whole is cut to fill the room there is, so all sequences of
a shard but the last are full.  The last one's tokens are laid out in
sequences of a power of two, which need no padding.

Shards are bounded slices of Spark's input partitions: nothing is shuffled,
and a lost task is done again from its own slice.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, read, split_words

#: Tokens of a full sequence.
LENGTH = 2048

#: Tokens at which the quadratic part of a piece's cost equals the linear part.
ATTENTION_SCALE = 4096

#: The id that ends every document.
END_ID = 1

#: UTF-8 bytes of text in a shard.
SHARD_BYTES = 6 << 20

#: Words whose ids a task keeps at hand.
CACHE_WORDS = 600_000

#: Marks that may close a word: none is part of a contraction or a special token's end.
MARKS = ",.!?%&$#*|;:()"

#: A stem that ends so is cut from the marks after it: ASCII and Latin letters and digits.
STEM_END = "[a-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]$"


def piece_cost(n: int) -> float:
    return n + n * n / ATTENTION_SCALE


def assign(sizes: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, tokens, sequence, offset) for all tokens of all documents.

    Every sequence is full, but for those at the end with a power of two of
    tokens each.
    """
    out: list[tuple[int, int, int, int, int]] = []
    full, rest = np.divmod(sizes, length)
    sequence = 0
    tails = []
    for d in np.argsort(-sizes, kind="stable").tolist():
        for k in range(int(full[d])):
            out.append((d, k * length, length, sequence, 0))
            sequence += 1
        if rest[d]:
            tails.append((int(rest[d]), d, int(full[d]) * length))
    tails.sort(key=lambda x: (-x[0], x[1]))
    whole, left = divmod(sum(t[0] for t in tails), length)
    room = [length] * whole
    for bit in range(length.bit_length() - 1, -1, -1):  # what remains, as powers of two
        if left >> bit & 1:
            room.append(1 << bit)
    cost, size = [0.0] * len(room), list(room)
    # sequences by remaining room: bounded lists, searched from the lowest cost
    heap = [(0.0, b) for b in range(len(room))]
    for n, d, start in tails:
        aside, put = [], None
        while heap:
            c, b = heapq.heappop(heap)
            if c != cost[b] or not room[b]:
                continue
            if room[b] >= n:
                put = b
                break
            aside.append((c, b))
        # cut where no sequence has the room, lowest cost first
        pieces = [(put, n)] if put is not None else []
        need = 0 if pieces else n
        for _, b in aside if need else ():
            take = min(need, room[b])
            pieces.append((b, take))
            need -= take
            if not need:
                break
        for b, take in pieces:
            out.append((d, start, take, sequence + b, size[b] - room[b]))
            start += take
            room[b] -= take
            cost[b] += piece_cost(take)
        touched = {b for b, _ in pieces}
        for c, b in aside:
            if b not in touched:
                heapq.heappush(heap, (c, b))
        for b in touched:
            if room[b]:
                heapq.heappush(heap, (cost[b], b))
    return out


class WordEncoder:
    """Ids of texts, word by word.

    The tokenizer lower-cases, never joins across white space, and always cuts
    between a letter or digit and the marks after it.  So a word's stem and
    its closing marks are looked up apart, and each is encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.stems = pa.array([""], pa.large_string())
        self.stem_at = np.zeros(1, np.int64)
        self.marks = {0: 0}
        self.size, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _add(self, ids: list[list[int]]) -> np.ndarray:
        at = len(self.size) + np.arange(len(ids))
        self.size = np.concatenate([self.size, np.fromiter(map(len, ids), np.int64, len(ids))])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32)])
        return at

    def _encode(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts: pure letters many in a text, the others each for itself."""
        plain = [p for p in parts if p.isalpha() and (p.isascii() or unicodedata.normalize("NFC", p).lower().isalpha())]
        found: dict[str, list[int]] = {}
        lines = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        for line, e in zip(lines, self.tokenizer.encode_batch([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids, cut = e.ids, np.flatnonzero(np.diff(e.word_ids)) + 1
            if len(cut) + 1 == len(line):
                edges = [0, *cut.tolist(), len(ids)]
                found.update((w, ids[a:b]) for w, a, b in zip(line, edges[:-1], edges[1:], strict=True))
        rest = [p for p in parts if p not in found]
        found.update((w, e.ids) for w, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True))
        return [found[p] for p in parts]

    def _stem_places(self, stems: pa.Array) -> np.ndarray:
        at = pc.index_in(stems, value_set=self.stems)
        if at.null_count:
            new = stems.filter(at.is_null()).unique()
            self.stem_at = np.concatenate([self.stem_at, self._add(self._encode(new.to_pylist()))])
            self.stems = pa.concat_arrays([self.stems, new])
            at = pc.index_in(stems, value_set=self.stems)
        return self.stem_at[at.to_numpy(zero_copy_only=False)]

    def _mark_places(self, words: pa.Array, length: np.ndarray) -> np.ndarray:
        """Of the last `length` bytes of each word, eight at most, read as one number."""
        end = np.frombuffer(words.buffers()[1], np.int64)[words.offset + 1 : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)
        key = np.zeros(len(words), np.uint64)
        for j in range(8):
            own = np.flatnonzero(length > j)
            key[own] |= data[end[own] - 1 - j].astype(np.uint64) << np.uint64(8 * j)
        distinct, at = np.unique(key, return_inverse=True)
        new = [k for k in distinct.tolist() if k not in self.marks]
        if new:
            text = [k.to_bytes(8, "big").lstrip(b"\0").decode() for k in new]
            self.marks.update(zip(new, self._add(self._encode(text)).tolist(), strict=True))
        return np.array([self.marks[k] for k in distinct.tolist()], np.int64)[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the texts, each ended by END_ID."""
        offsets, codes, words = split_words(texts, lower=True)
        if len(self.stems) > CACHE_WORDS:
            self._clear()
        stems = pc.utf8_rtrim(words, characters=MARKS)
        length = pc.subtract(pc.binary_length(words), pc.binary_length(stems)).to_numpy(zero_copy_only=False).astype(np.int64)
        apart = pc.match_substring_regex(stems, STEM_END).to_numpy(zero_copy_only=False) & (length <= 8)
        length[~apart] = 0
        part = np.stack([self._stem_places(pc.if_else(pa.array(apart), stems, words)), self._mark_places(words, length)], axis=1)[codes].ravel()
        begin = np.cumsum(self.size) - self.size
        n = self.size[part]
        at = np.cumsum(n) - n
        ids = self.flat[np.repeat(begin[part] - at, n) + np.arange(int(n.sum()))]
        edge = np.concatenate([[0], np.cumsum(n)])[2 * offsets]
        return edge + np.arange(len(edge)), np.insert(ids, edge[1:], END_ID)


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One for each worker process, so that its words last over tasks."""
    return WordEncoder(path)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Pack all documents into sequences of at most `length` tokens.

    tokenizer: path of a tokenizer file that every executor has.  Returns a
    row for each piece: doc_id, start (ids of its document before it), length,
    ids_crc32 (of its ids as little-endian unsigned 32-bit numbers),
    doc_tokens (with the ending id), sequence_id, and offset in the sequence.

    A null or empty text has the ending id alone.  A document longer than a
    sequence is cut.  Equal documents are packed each for itself.  Other
    columns are ignored.  An empty table gives no pieces.  Sequence numbers
    depend on how the input is split into partitions.
    """
    if length & (length - 1):
        raise ValueError("the length of a sequence is a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for part in chunks(batches, most=shard_bytes):
            offsets, ids = [np.zeros(1, np.int64)], []
            for small in chunks([part]):
                o, i = encoder(tokenizer).encode(small.column("text"))
                offsets.append(o[1:] + offsets[-1][-1])
                ids.append(i)
            edge, flat = np.concatenate(offsets), np.concatenate(ids)
            size = np.diff(edge)
            pieces = np.array(assign(size, length), np.int64)
            doc, start, n, sequence, offset = pieces.T
            begin = edge[doc] + start
            crc = np.array([zlib.crc32(flat[a:b]) for a, b in zip(begin.tolist(), (begin + n).tolist(), strict=True)], np.int64)
            ids_of = part.column("doc_id").take(pa.array(doc))
            numbers = [start, n, crc, size[doc], base + sequence, offset]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([ids_of, *(pa.array(x, pa.int64()) for x in numbers)], names=names)
            base += int(sequence.max()) + 1

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
