"""Models and searches against plain versions of themselves."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from sparkloom.llm import ann, common, language_model, substring_dedup, toxicity
from tests.conftest import SF

BIG = "/root/testdata/sf0.01"


def _tokens(text):
    return [*(text or "").encode().lower().split(), 0]


def _model(spark, docs, monkeypatch):
    """Scores of the operator with the weights that it learned."""
    kept = {}
    learn = language_model.learn_weights

    def spy(cells, vocabulary):
        kept["cells"], kept["weights"] = cells, learn(cells, vocabulary)
        return kept["weights"]

    monkeypatch.setattr(language_model, "learn_weights", spy)
    got = language_model.interpolated_scores(docs).toPandas().set_index("doc_id")
    return got, kept


def _bucket(n):
    return min(math.frexp(n)[1], language_model.BUCKETS - 1)


def test_language_model_score(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got, kept = _model(spark, docs, monkeypatch)
    weights, rows = kept["weights"], docs.collect()
    train = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2 for r in rows}
    word, pair, context = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        if train[r["doc_id"]]:
            t = _tokens(r["text"])
            word.update(t)
            pair.update(zip([None, *t[:-1]], t, strict=True))
            context.update([None, *t[:-1]])
    n, v = sum(word.values()), len(word)

    def p(before, w):
        a, b, c = weights[_bucket(context[before])]
        return a * pair[before, w] / max(context[before], 1) + b * word[w] / n + c / (v + 1)

    for r in rows:
        t = _tokens(r["text"])
        assert got.loc[r["doc_id"], "score"] == pytest.approx(sum(math.log10(p(x, y)) for x, y in zip([None, *t[:-1]], t, strict=True)), rel=1e-9)
    assert np.allclose(weights.sum(axis=1), 1) and weights[0][0] == 0
    for before in [None, b"never-seen", *random.Random(3).sample(sorted(w for w in word if w), 12)]:
        assert sum(p(before, w) for w in word) + p(before, "unknown") == pytest.approx(1, abs=1e-9)


def test_weights_equal_those_of_exact_counts(spark, monkeypatch):
    """EM over every token with its block's own counts deleted, without a histogram."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    _, kept = _model(spark, docs, monkeypatch)
    blocks = common.with_block(docs, common.block_count(docs), common.Scratch(spark, "test")).toPandas()
    blocks = blocks[[zlib.crc32(str(d).encode()) % 7 != 2 for d in blocks.doc_id]]
    word, pair, context = collections.Counter(), collections.Counter(), collections.Counter()
    own = collections.defaultdict(lambda: (collections.Counter(), collections.Counter(), collections.Counter()))
    events = []
    for b, text in zip(blocks.block, blocks.text, strict=True):
        t = _tokens(text)
        pairs = list(zip([None, *t[:-1]], t, strict=True))
        for total, mine, items in zip((word, pair, context), own[b], (t, pairs, [x for x, _ in pairs]), strict=True):
            total.update(items)
            mine.update(items)
        events += [(b, x, y) for x, y in pairs]
    n, v = sum(word.values()), len(word)
    size = {b: sum(w.values()) for b, (w, _, _) in own.items()}
    rows = []
    for b, x, y in events:
        w, p, c = own[b]
        left = context[x] - c[x]
        rows.append((_bucket(left), (pair[x, y] - p[x, y]) / max(left, 1), (word[y] - w[y]) / (n - size[b]), 1 / (v + 1)))
    rows = np.array(rows)
    for bucket in (3, 6, 8):
        p = rows[rows[:, 0] == bucket, 1:]
        weight = np.array([0.3, 0.6, 0.1])
        for _ in range(language_model.EM_ROUNDS):
            post = p * weight
            share = (post / post.sum(axis=1, keepdims=True)).sum(axis=0) + [0, 0.5, 0.5]
            weight = share / share.sum()
        assert np.allclose(weight, kept["weights"][bucket], atol=0.01)


def _exact(x, ids, q, k=5):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit[q]
    near[ids == ids[q]] = -2
    return ids[np.lexsort((ids, -near))[:k]], np.sort(near)[::-1][:k]


def test_nearest_on_thousands_of_rows(spark):
    """Random vectors: at least nine of ten nearest found, each with its exact cosine."""
    r = np.random.default_rng(4)
    x = r.standard_normal((3000, 24))
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(v, v.filter("vec_id % 50 = 0")).toPandas()
    assert (got.groupby("query_id")["rank"].apply(list).map(lambda z: sorted(z) == [1, 2, 3, 4, 5])).all() and got.query_id.nunique() == 60
    hits, ids = 0, np.arange(3000)
    for q in range(0, 3000, 50):
        own = got[got.query_id == q].sort_values("rank")
        best, score = _exact(x, ids, q)
        hits += len(set(best.tolist()) & set(own.vec_id))
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        assert np.allclose(own.score, unit[own.vec_id.to_numpy()] @ unit[q], rtol=1e-12) and (np.diff(own.score) <= 0).all()
    assert hits >= 0.9 * 300


def test_nearest_with_extreme_components(spark):
    r = np.random.default_rng(6)
    x = r.standard_normal((300, 8))
    x[7] *= 1e-200
    x[11] *= 1e200
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(v, v.filter("vec_id in (7, 11, 50)"), share=1.0).toPandas()
    scaled = x / np.abs(x).max(axis=1)[:, None]
    for q in (7, 11, 50):
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == _exact(scaled, np.arange(300), q)[0].tolist()


def test_blocks_are_merged(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    r = np.random.default_rng(9)
    x = r.standard_normal((400, 6))
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(v, v.filter("vec_id % 50 = 0"), share=1.0).toPandas()
    for q in range(0, 400, 50):
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == _exact(x, np.arange(400), q)[0].tolist()


def _brute_hits(weights, exceptions, line):
    words = {}
    for entry, weight in weights.items():
        for at in range(len(line)):
            if line.startswith(entry, at):
                words[at] = max(weight, words.get(at, 0.0))
    spared = {at + k for e in exceptions for at in range(len(line)) if line.startswith(e, at) for k in range(len(e) - 1)}
    return {at: weight for at, weight in words.items() if at not in spared}


def test_lexicon_matches_like_a_plain_search():
    r = random.Random(7)
    for _ in range(150):
        word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 5)))  # noqa: E731, B023
        weights = {r.choice([f" {word()} ", f" {word()}"]): r.random() + 0.1 for _ in range(6)}
        exceptions = {f" {word()} {word()} " for _ in range(3)}
        line = f" {' '.join(word() for _ in range(40))} "
        assert toxicity.Lexicon(weights, exceptions, np.zeros(3)).hits(line) == pytest.approx(_brute_hits(weights, exceptions, line))


def test_toxicity_of_held_out_documents(spark):
    """Whatever held-out toxic document has a word of the lexicon is found; no clean one is."""
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id").merge(docs.select("doc_id", "text").toPandas(), on="doc_id")
    held = got[got.held_out]
    lexicon = toxicity.learn_lexicon(docs, labels.filter(~(common.row_crc() % 4 == 2)))
    lines, _ = toxicity.folded_texts(common.pa.array(held.text))
    carries = np.array([bool(lexicon.hits(line)) for line in lines])
    toxic = held.toxic.to_numpy() == 1
    assert held[toxic & carries].predicted.all() and held[toxic].predicted.mean() >= 0.6
    assert held[held.predicted == 1].toxic.mean() > 0.9


def test_equal_windows_share_a_sequence_of_symbols():
    """From a shared boundary in the first words the symbols are the same up to the last ones."""
    rng = np.random.default_rng(12)
    for window in (9, 13, 35, 50):
        rounds = substring_dedup.pair_rounds(window)
        loss = substring_dedup.parse_loss(rounds)
        for _ in range(200):
            shared, keys = rng.integers(0, rng.integers(2, 40), window), []
            for _ in range(2):
                before, after = rng.integers(0, 5, rng.integers(0, 30)), rng.integers(0, 5, rng.integers(0, 30))
                words = " ".join(f"w{x}" for x in np.concatenate([before, shared, after]))
                at, key = substring_dedup._Words(common.pa.array([words])).anchors(window)
                keys.append({k for p, k in zip((at - len(before)).tolist(), key.tolist(), strict=True) if 0 <= p <= loss})
            assert keys[0] & keys[1]
