"""Removal of repeated passages by recompression.

All documents are parsed in the same rounds: runs of two equal words get one
name, then adjacent symbols are paired by a coin that hangs on their names
alone, and a pair's name hangs on its two parts' names.  So names are global
without any exchange: equal passages get equal symbols but for a few at either
end, whose words `parse_loss` bounds.  Two equal windows hence share a symbol
boundary in their first words and all symbols from there on up to their last
words.

1. At each boundary a block sends the sequence of the high-level symbols that
   lie in the words which equal windows must share; sequences found once are
   done with.
2. Around the shared ones the blocks hash every whole window (128 bits), its
   ends included; the windows found twice or more are verified repeats.
3. Each block takes the words of its verified windows out of its documents.

Only packed keys travel; a block sends a key once, so a passage that many
documents share has one entry for each block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_SCHEMA, Scratch, block_count, chunks, hash_chunks, join_hashes, mix, ngram_hashes, places, read, repeated_keys, split_words, unpack, unpack_keys, with_block, word_hashes

#: Words of a window in the registered query.
WINDOW = 35

_RUN = np.uint64(0xD6E8FEB86659FD93)


def parse_loss(rounds: int) -> int:
    """Words at either end of a window in which the parses of equal windows may differ.

    The run round costs two words, a pair round at most one symbol: one word
    in the first, then half of the round's longest new symbol.
    """
    return 2 + sum(2**r // 2 for r in range(1, rounds + 1))


def shared_words(window: int, rounds: int) -> int:
    """Words of equal windows that are parsed alike in any case, from their first shared boundary on."""
    return window - 2 * parse_loss(rounds)


def pair_rounds(window: int) -> int:
    """The most pair rounds after which equal windows still share a whole symbol of the longest kind."""
    rounds = 0
    while shared_words(window, rounds + 1) >= 2 ** (rounds + 1):
        rounds += 1
    return rounds


def recompress(names: np.ndarray, first: np.ndarray, rounds: int) -> np.ndarray:
    """Starts of the highest symbols, as word positions."""
    return parse(names, first, rounds)[0]


def parse(names: np.ndarray, first: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts, as word positions, and names of the highest symbols.

    names: a hash for each word; first: true where a document begins, which
    no symbol crosses.
    """
    start = np.arange(len(names))
    if len(names) < 2:
        return start, names
    same = np.r_[False, (names[1:] == names[:-1]) & ~first[1:]]
    heads = np.flatnonzero(~same)
    run = np.diff(np.r_[heads, len(names)])
    double = heads[run == 2]
    names = names.copy()
    names[double] = mix(names[double] ^ _RUN)
    length = np.ones(len(names), np.int64)
    length[double] = 2
    keep = np.ones(len(names), bool)
    keep[double + 1] = False
    names, length, first, start = names[keep], length[keep], first[keep], start[keep]
    for r in range(1, rounds + 1):
        left = mix(names ^ np.uint64(r)) < np.uint64(1 << 63)
        pair = np.flatnonzero(left[:-1] & ~left[1:] & ~first[1:] & (length[:-1] + length[1:] <= 2**r))
        names[pair] = join_hashes(names[pair], names[pair + 1])
        length[pair] += length[pair + 1]
        keep = np.ones(len(names), bool)
        keep[pair + 1] = False
        names, length, first, start = names[keep], length[keep], first[keep], start[keep]
    return start, names


#: An odd number and its inverse among the 64-bit ones: powers of the two cancel out.
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def chain_hashes(names: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each sequence names[begin:end], whatever its place, and of its length."""
    power = lambda base, n: np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(names * power(_STEP, len(names))[:-1], dtype=np.uint64)])
    return mix((sums[end] - sums[begin]) * power(_BACK, len(names))[begin] ^ (end - begin).astype(np.uint64))


class _Words:
    """A slice of documents as one row of word hashes."""

    def __init__(self, texts: pa.Array):
        self.offsets, self.codes, self.words = split_words(texts)
        self.hashes = word_hashes(self.words)[self.codes] if len(self.codes) else np.zeros(0, np.uint64)
        self.end = np.repeat(self.offsets[1:], np.diff(self.offsets))

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbol boundaries, and the sequences of whole symbols in the words from there that equal windows share."""
        rounds = pair_rounds(window)
        first = np.zeros(len(self.hashes), bool)
        first[self.offsets[:-1][np.diff(self.offsets) > 0]] = True
        start, names = parse(self.hashes, first, rounds)
        if not len(start):
            return start, names
        # places among the starts, the last one closing the last symbol
        edges = np.r_[start, len(self.hashes)]
        stop = np.searchsorted(edges, start + shared_words(window, rounds), side="right") - 1
        at = np.flatnonzero(start + window - parse_loss(rounds) <= self.end[start])
        return start[at], chain_hashes(names, at, stop[at])

    def whole(self, window: int) -> np.ndarray:
        """Where a window of the same document starts."""
        return np.arange(len(self.hashes)) + window <= self.end

    def windows(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        return ngram_hashes(self.hashes, window, 2), ngram_hashes(self.hashes, window, 3)


def _pairs(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    both = np.empty(len(k1), [("a", np.uint64), ("b", np.uint64)])
    both["a"], both["b"] = k1, k2
    return both


def _first_keys(window: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        keys = [_Words(part.column("text")).anchors(window)[1] for part in chunks(table.combine_chunks().to_batches())]
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        return hash_chunks(block, key, count, buckets)

    return run


def _window_keys(window: int, buckets: int):
    reach = parse_loss(pair_rounds(window))

    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        block = docs.column("block")[0].as_py() if docs.num_rows else -1
        known = np.sort(np.concatenate([np.zeros(0, np.uint64), *unpack_keys(hits.column("keys"))]))
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        for part in chunks(docs.combine_chunks().to_batches()) if len(known) else ():
            words = _Words(part.column("text"))
            at, keys = words.anchors(window)
            at = at[places(keys, known) >= 0]
            near = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(near, np.maximum(at - reach, 0), 1)
            np.add.at(near, at + 1, -1)
            start = np.flatnonzero((np.cumsum(near)[:-1] > 0) & words.whole(window))
            k1, k2 = words.windows(window)
            found.append((k1[start], k2[start]))
        both, count = np.unique(_pairs(*(np.concatenate(x) for x in zip(*found, strict=True))), return_counts=True)
        return hash_chunks(block, both["a"], count, buckets, both["b"])

    return run


def _covered(words: _Words, known: np.ndarray, known2: np.ndarray, window: int) -> np.ndarray:
    k1, k2 = words.windows(window)
    start = np.flatnonzero(words.whole(window))
    at = places(k1[start], known)
    start, at = start[at >= 0], at[at >= 0]
    same = known2[at] == k2[start]
    while not same.all():  # several second halves under one first half
        at = np.where(same, at, at + 1)
        live = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == k1[start])
        start, at = start[live], at[live]
        same = known2[at] == k2[start]
    cover = np.zeros(len(words.hashes) + 1, np.int64)
    cover[start] += 1
    np.add.at(cover, start + window, -1)
    return np.cumsum(cover)[:-1] > 0


def _remove(window: int, with_text: bool, extra: bool):
    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        known = np.concatenate([np.zeros(0, np.uint64), *unpack_keys(hits.column("keys"))])
        known2 = np.concatenate([np.zeros(0, np.uint64), *unpack(hits.column("keys2"))])
        order = np.lexsort((known2, known))
        known, known2 = known[order], known2[order]
        ids, total, removed, out, rest = [], [], [], [], []
        for part in chunks(docs.combine_chunks().to_batches()):
            words = _Words(part.column("text"))
            gone = _covered(words, known, known2, window) if len(known) else np.zeros(len(words.hashes), bool)
            text = words.words.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
            texts = part.column("text").to_pylist() if with_text else None
            for i, (a, b) in enumerate(zip(words.offsets[:-1], words.offsets[1:], strict=True)):
                cut = gone[a:b]
                n = int(cut.sum())
                total.append(int(b - a))
                removed.append(n)
                if with_text and not n:
                    out.append(texts[i])
                    continue
                kept = b" ".join(text[words.codes[a:b][~cut] if n else words.codes[a:b]].tolist())
                out.append(kept.decode() if with_text else hashlib.sha256(kept).hexdigest())
            ids.append(part.column("doc_id"))
            if extra:
                rest.append(part.column("extra"))
        columns = [pa.chunked_array(ids, pa.int64()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "text" if with_text else "kept_sha256"]
        if extra:
            columns.append(pa.chunked_array(rest, docs.schema.field("extra").type))
            names.append("extra")
        return pa.table(columns, names=names)

    return run


def repeated_windows(parts: DataFrame, window: int, blocks: int, scratch: Scratch) -> DataFrame:
    """For each block the packed 128-bit hashes of its windows that occur twice or more in all."""
    parts = parts.select("doc_id", "text", "block")
    first = parts.groupBy("block").applyInArrow(_first_keys(window, blocks), CHUNK_SCHEMA)
    shared = scratch.save(repeated_keys(first).select("block", "keys"), "anchors")
    second = parts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_window_keys(window, blocks), CHUNK_SCHEMA)
    return scratch.save(repeated_keys(second), "windows")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """Remove each word that a repeated window covers.

    A window is `window` consecutive words of one document; it is repeated if
    the same words also start anywhere else, the same document included.  All
    windows are judged on the input, so no copy of a passage survives.

    Returns doc_id, n_words, n_removed and text: the kept words joined by one
    space, or the text untouched where nothing goes.  Other columns of docs
    follow, but for those of these names.  With digest: kept_sha256 of the
    joined words in place of text, and no other columns.

    A null text has no words and stays null (digest of the empty string).
    Texts shorter than a window stay.  Repeated rows repeat each other.  A
    null doc_id stays null.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    if not pair_rounds(window):
        raise ValueError(f"a window needs {2 * parse_loss(1) + 2} words at least")
    scratch, blocks = Scratch(spark, "substring_dedup"), block_count(docs)
    taken = ("doc_id", "text", "n_words", "n_removed")
    source = docs.select("doc_id", "text", *(docs[f"`{c}`"] for c in docs.columns if c not in taken))
    parts = with_block(source, blocks, scratch, extra=not digest)
    hits = repeated_windows(parts, window, blocks, scratch)
    kinds = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_words", "n_removed")])
    kinds.add("kept_sha256" if digest else "text", T.StringType())
    extra = "extra" in parts.columns
    if extra:
        kinds.add(parts.schema["extra"])
    out = parts.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(_remove(window, not digest, extra), kinds)
    return out.select("doc_id", "n_words", "n_removed", "text", "extra.*") if extra else out


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"), WINDOW, digest=True)


#: DuckDB: every window as text, counted; then the words that a repeated one covers go.
OP1_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM d WHERE len(w) >= {WINDOW}),
g AS (SELECT r, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS s FROM p),
m AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
h AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS i FROM g SEMI JOIN m USING (s)),
c AS (SELECT r, list(i) AS gone FROM h GROUP BY r),
k AS (SELECT d.doc_id, len(d.w) AS n, coalesce(len(c.gone), 0) AS g, d.w, c.gone FROM d LEFT JOIN c USING (r)),
x AS (SELECT doc_id, n, g, CASE WHEN g = 0 THEN w ELSE
        list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END AS kept FROM k)
SELECT doc_id, n::BIGINT AS n_words, g::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM x
"""
