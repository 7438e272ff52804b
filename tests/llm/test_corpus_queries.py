"""Registered queries against brute force, SQL, exact round trips or held-out accuracy."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import html_text, language_id, mixing, packing, quality, simhash, substring_dedup
from sparkloom.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    order = lambda d: d[sorted(d.columns)].sort_values(sorted(d.columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want))


def brute_windows(texts, window):
    """Words that repeated windows cover, by counting all windows."""
    words = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


@pytest.mark.parametrize("window", [9, 13, 35])
def test_substring_dedup_on_periodic_text(spark, window):
    r = random.Random(window)
    base = [r.choice("ab cd ef gh".split()) for _ in range(400)]
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 90))) for _ in range(60)]
    texts += [" ".join(base[i : i + r.randint(5, 120)]) for i in r.sample(range(300), 30)] + ["la " * 80, "la " * 41, "x " + "la " * 37, "p q r " * 30, "q r p " * 13]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {row["doc_id"]: row for row in substring_dedup.dedup_substrings(d, window).collect()}
    for i, kept in enumerate(brute_windows(texts, window)):
        assert WORD.findall(got[i]["text"]) == kept


def test_parse_is_consistent():
    """Equal windows share a symbol boundary within the first words that the loss allows."""
    rng = np.random.default_rng(3)
    for window in (9, 13, 35, 50):
        rounds = substring_dedup.pair_rounds(window)
        loss = substring_dedup.parse_loss(rounds)
        for _ in range(150):
            shared = rng.integers(0, rng.integers(2, 40), window)
            starts = []
            for _ in range(2):
                before, after = rng.integers(0, 5, rng.integers(0, 30)), rng.integers(0, 5, rng.integers(0, 30))
                names = np.concatenate([before, shared, after]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                first = np.zeros(len(names), bool)
                first[0] = True
                at = substring_dedup.recompress(names, first, rounds) - len(before)
                starts.append(set(at[(at >= 0) & (at <= loss)].tolist()))
            assert starts[0] & starts[1]


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, ids):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    root = [find(i) for i in range(len(prints))]
    least = {}
    for r, d in zip(root, ids, strict=True):
        least[r] = min(d, least.get(r, d))
    return [least[r] for r in root]


def test_simhash(spark, docs):
    got = QUERIES["op3_simhash_near_dedup"](spark, SF).toPandas().set_index("doc_id")
    prints = [brute_fingerprint(t) for t in docs.text]
    for d, p, c in zip(docs.doc_id, prints, brute_components(prints, docs.doc_id.tolist()), strict=True):
        assert got.loc[d, "fingerprint"] == f"{p:016x}" and got.loc[d, "component_id"] == c


def test_simhash_index_with_small_nodes(spark):
    """Small nodes force several levels of division."""
    r = random.Random(5)
    prints = [r.getrandbits(64) for _ in range(2)]
    prints = sorted({p ^ (1 << r.randrange(64)) ^ (r.randrange(2) << r.randrange(64)) for p in prints for _ in range(150)} | set(prints))
    d = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    links = simhash.fingerprint_links(d, 2, simhash.Scratch(spark, "test"), members=64)
    from sparkloom.llm.components import connected_components

    label = {row["node"]: row["label"] for row in connected_components(links, simhash.Scratch(spark, "test")).collect()}
    signed = [simhash._signed(p) for p in prints]
    for p, want in zip(signed, brute_components(prints, signed), strict=True):
        assert label.get(p, p) == want


def test_components_of_a_chain(spark):
    from sparkloom.llm.components import connected_components

    r = random.Random(2)
    names = r.sample(range(10**6), 80)
    pairs = list(zip(names[:49], names[1:50], strict=True)) + list(zip(names[50:79], names[51:80], strict=True))
    got = {row["node"]: row["label"] for row in connected_components(spark.createDataFrame(pairs, "a long, b long"), simhash.Scratch(spark, "test")).collect()}
    assert {got[n] for n in names[:50]} == {min(names[:50])} and {got[n] for n in names[50:]} == {min(names[50:])}


def test_packing(spark, docs):
    got = QUERIES["op4_packing"](spark, SF).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        own = got[got.doc_id == d].sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        for p in own.itertuples():
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    padded = 0
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
        n = int(s.length.sum())
        assert n <= 2048
        padded += 0 if n & (n - 1) == 0 else 2048 - n
    assert padded == 0


def test_word_encoder_equals_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, own = Tokenizer.from_file(path), packing.WordEncoder(path)
    import pyarrow as pa

    r = random.Random(1)
    texts = ["Don't stop!!! it's <|endoftext|> a<|endoftext|>b, x|>. 12ab3%% ¿qué? İstanbul, éa... «ab»,, ''s 's.. ab's% ß! x²,"]
    texts += ["".join(r.choice("aAbB'<|>endoftext.,!%& \n\xa0é́İ1²ßﬁ東") for _ in range(40)) for _ in range(800)]
    edge, ids = own.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[edge[i] : edge[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [1]


def test_language_id(spark, docs):
    got = QUERIES["op5_language_id"](spark, SF).toPandas().merge(docs, on="doc_id")
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "ab", "b", "▁ab", "ba"]
    p = np.random.default_rng(0).dirichlet(np.ones(len(pieces)), 2).T
    model = language_id.Segmenter(pieces, p)

    def total(word, lang):
        if not word:
            return 1.0
        out = language_id.UNKNOWN * total(word[1:], lang)
        for i, piece in enumerate(pieces):
            if word.startswith(piece):
                out += p[i, lang] * total(word[len(piece) :], lang)
        return out

    words = ["▁ab", "▁abab", "▁ba", "▁bbb", "▁xaab"]
    got = model.log_probability(words)
    for i, w in enumerate(words):
        for lang in (0, 1):
            assert got[i, lang] == pytest.approx(math.log(total(w, lang)))


def test_quality(spark, docs):
    got = QUERIES["op6_quality_rules"](spark, SF).toPandas().set_index("doc_id")
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        w = WORD.findall(t)
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        gone = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        row = got.loc[d]
        assert (row.n_words, row.word_chars, row.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (row.n_dup_lines, row.n_repeat_words) == (len(lines) - len(set(lines)), len(gone))
        assert row.base_failed == (len(w) < 20 or 100 * len(gone) > 30 * len(w))
        assert not (row.base_failed and row.kept)


def test_rules_find_a_threshold(spark):
    r = random.Random(4)
    rows = [(f"{' '.join(r.choice(['good', 'text', 'here', 'now']) + str(r.random()) for _ in range(40))}{' ###' * (30 if i % 4 == 0 else 0)}", i) for i in range(240)]
    d = spark.createDataFrame(rows, "text string, doc_id long")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(240)], "doc_id long, quality int")
    out = quality.judge_quality(d, labels).toPandas()
    assert (out.kept == (out.doc_id % 4 != 0)).mean() > 0.97


def test_language_model(spark, docs):
    got = QUERIES["op7_lm_scoring"](spark, SF).toPandas().set_index("doc_id")
    tokens = {d: [*t.encode().lower().split(), 0] for d, t in zip(docs.doc_id, docs.text, strict=True)}
    count = collections.Counter(w for d, t in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in t)
    n, v = sum(count.values()), len(count)
    for d, t in tokens.items():
        row = got.loc[d]
        assert row.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t))
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(t), sum(count[w] > 0 for w in t), n)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_pages():
    model, r, wrong, total = html_text.train(400), random.Random(11), 0, 0
    for _ in range(60):
        source, truth = html_text.training_page(r)
        forest = html_text.Forest()
        forest.read(0, source)
        keep = html_text.decode(forest, model.logits(html_text.node_features(forest)))
        at = [i for i, t in enumerate(forest.text) if t]
        assert len(at) == len(truth)
        wrong += sum(bool(keep[i]) != t for i, t in zip(at, truth, strict=True))
        total += len(truth)
    assert wrong < 0.03 * total


def test_pages_query(spark):
    got = QUERIES["op8_html_extraction"](spark, SF).toPandas()
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas().merge(got, on=["page_id", "url"])
    good = 0
    for row in pages.itertuples():
        body = row.html[row.html.index("<article>") : row.html.index("</article>")]
        blocks = [" ".join(html_text.html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        good += row.text == "\n".join(b for b in blocks if b)
    assert good >= 0.98 * len(pages)


def test_nearest_recall(spark):
    got = QUERIES["op9_nearest_neighbours"](spark, SF).toPandas()
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.array(e.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, hits, total = e.vec_id.to_numpy(), 0, 0
    for i in np.flatnonzero(ids % 50 == 0):
        near = x @ x[i]
        near[i] = -2
        own = got[got.query_id == ids[i]].sort_values("rank")
        assert own.score.tolist() == pytest.approx([near[np.flatnonzero(ids == v)[0]] for v in own.vec_id])
        hits += len(set(own.vec_id) & set(ids[np.lexsort((ids, -near))[:5]].tolist()))
        total += 5
    assert hits >= 0.9 * total


def test_forest_recall():
    """Blocks of thousands, where a prefix narrows the search."""
    from sparkloom.llm.ann import SHARE, PrefixForest

    rng = np.random.default_rng(8)
    x = rng.standard_normal((5000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    forest, hits = PrefixForest(x), 0
    for q, rows in enumerate(forest.candidates(x[:60], int(SHARE * len(x)))):
        assert len(rows) >= SHARE * len(x)
        best = np.argsort(-(x @ x[q]))[1:6]
        hits += len(set(rows.tolist()) & set(best.tolist()))
    assert hits >= 0.9 * 300


def test_toxicity(spark):
    got = QUERIES["op2_toxicity"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(got, on="doc_id")
    assert (labels.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in labels.doc_id]).all()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert (labels.predicted == labels.toxic).mean() > 0.8


def test_folding():
    from sparkloom.llm.toxicity import Lexicon, fold

    assert [fold(w) for w in ("1d10t", "ｉｄｉｏｔ", "i.d.i.o.t!!", "idіоt", "Éa", "123", "???")] == ["idiot"] * 4 + ["ea", "123", ""]
    own = Lexicon({" bad ": 2.0, " ba": 1.0, " bat ": 3.0}, {" not bad "}, np.zeros(3))
    assert own.hits(" bad not bad bat bath ") == {0: 2.0, 12: 3.0, 16: 1.0}


def brute_kept(texts, ids, words=5, similarity=0.8):
    """The smallest id of each group of texts that link by the Jaccard similarity of their shingles."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and len(a & b) >= similarity * len(a | b)):
                label[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return set(least.values())


def test_pipeline(spark):
    """Each stage by its own brute force, on what the one before it wrote."""
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, scratch = docs.toPandas(), corpus_pipeline.Scratch(spark, "test")
        docs = scratch.save(stage(spark, docs, SF), name)
        after = docs.toPandas()
        if name != "packing":
            assert docs.columns == columns
        if name == "language_id":
            letters = before[before.text.map(lambda t: any(c.isalpha() for c in t or ""))]
            assert set(after.doc_id) == set(letters.doc_id)
        elif name == "simhash_near_dedup":
            assert set(after.doc_id) == brute_kept(before.text, before.doc_id) and after.doc_id.is_unique
        elif name == "substring_dedup":
            kept = dict(zip(before.doc_id, brute_windows(before.text, corpus_pipeline.PASSAGE_WORDS), strict=True))
            for row in before.itertuples():
                own = after[after.doc_id == row.doc_id]
                if not kept[row.doc_id] and WORD.findall(row.text):
                    assert not len(own)
                else:
                    assert WORD.findall(own.text.iloc[0]) == kept[row.doc_id]
        elif name == "source_mixing":
            want = mixing.mix_sources(spark.createDataFrame(before)).toPandas().set_index("doc_id")
            taken = after.assign(n=after.text.map(lambda t: len(WORD.findall(t)))).groupby("doc_id").n.sum()
            assert taken.sort_index().equals(want.taken[want.taken > 0].sort_index())
            by = want.join(before.set_index("doc_id").source).groupby("source").agg({"taken": "sum", "target": "first"})
            assert ((by.taken - by.target).abs() <= 2).all()
        else:
            n = before.groupby("doc_id").size()
            sums = after.groupby("doc_id").length.sum()
            tokens = after.groupby(["doc_id", "doc_tokens"]).size().reset_index()
            assert set(sums.index) == set(n.index) and (sums >= tokens.groupby("doc_id").doc_tokens.max()).all()
