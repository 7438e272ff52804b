"""Corpus operators take all of their input and drop nothing that they should keep."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import ann, common, html_text, language_id, language_model, near_dup, quality, simhash, substring_dedup


def _jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_near_duplicate_stage_by_jaccard(spark):
    r = random.Random(3)
    texts = []
    for _ in range(12):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(3, 150))]
        texts.append(" ".join(words))
        for changes in (1, 1, 2, 4):
            words = list(words)
            for _ in range(changes):
                words[r.randrange(len(words))] = f"x{r.randrange(5000)}"
            texts.append(" ".join(words))
    texts += ["a b c", "a b c", "a b d", "", "  "]
    label = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if bool(texts[i].split()) == bool(texts[j].split()) and _jaccard(texts[i], texts[j]) >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(d).collect()} == dict(enumerate(label))
    assert {x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, d, "").collect()} == set(label)


def test_near_duplicates_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text + " x"), (None, "other words that stand alone here"), (4, "a b"), (4, "a b"), (5, None), (None, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_dup.drop_near_duplicates(d).collect()
    assert sorted(x["doc_id"] or 0 for x in kept) == [0, 0, 4, 5] and near_dup.drop_near_duplicates(d.limit(0)).count() == 0


def test_language_model_keeps_pairs_seen_once(spark):
    held = iter([i for i in range(100_000, 101_000) if zlib.crc32(str(i).encode()) % 7 == 2])
    train = iter([i for i in range(1, 5000) if zlib.crc32(str(i).encode()) % 7 != 2])
    rows = [(next(train), f"a{i} b{i}") for i in range(60) for _ in range(3)]
    rows += [(next(train), t) for t in ("x y q", "x q", "z q")]
    near, far = next(held), next(held)
    d = spark.createDataFrame([*rows, (near, "x y"), (far, "x z")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in language_model.interpolated_scores(d).collect()}
    assert score[near] > score[far] + 0.1


def test_nearest_with_repeated_ids(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((1400, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(i, (x[i] + e).tolist()) for i in range(40) for e in r.standard_normal((30, 8)) * 0.01]
    rows += [(0, x[0].tolist())] * 1500
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    y = spark.createDataFrame([(0, x[0].tolist()), (5000, x[1].tolist()), (5001, x[0].tolist())], v.schema)
    got = {}
    for row in ann.nearest(v, y, share=1.0).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"]))
    ids, m = np.array([i for i, _ in rows]), np.array([e for _, e in rows])
    for q, e in ((0, x[0]), (5000, x[1]), (5001, x[0])):
        cos = m @ e / np.linalg.norm(m, axis=1) / np.linalg.norm(e)
        best = sorted((-cos[ids == i].max(), i) for i in set(ids.tolist()) - {q})[:5]
        assert sorted(got[q]) == [(k + 1, i) for k, (_, i) in enumerate(best)]


def _texts(source):
    forest = html_text.Forest()
    forest.read(0, source)
    return [t for t in forest.text if t]


def test_open_head_ends_at_body():
    for start in ("<body><p>", "<p>", "<body>", "<div><p>", "<img src=x>", ""):
        assert _texts(f"<html><head><meta charset=x><title>T</title><script>s</script>{start}Words stay.") == ["Words stay."]
    assert _texts("<html><head><title>T</title> <style>p</style></head><body>a<p>b") == ["a", "b"]
    assert _texts("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</article>") == ["so x=2 holds"]


def test_more_than_six_quality_rules(spark):
    r = random.Random(8)
    names = quality.RATES
    rows = []
    for i in range(900):
        rates, bad = {n: r.random() for n in names}, int(i % 10 < 9 and i % 2)
        if bad:
            rates[names[i // 2 % 9]] = 9 + r.random()
        rows.append((rates, bad, i // 18 % 3))
    schema = f"rates struct<{','.join(f'{n}:double' for n in names)}>, bad int, part int"
    rules = quality.learn_rules(spark.createDataFrame(rows, schema).cache())
    assert len(rules) > 6 and {c[0] for rule in rules for c in rule} == set(names)


def test_long_words_are_summed_whole():
    """The pass in logarithms equals the quick one, and takes words of any length as one."""
    r = np.random.default_rng(2)
    pieces = ["▁", "▁a", "a", "ab", "b", "▁ab", "ba", "abab", "bbbbb"]
    model = language_id.Segmenter(pieces, r.dirichlet(np.ones(len(pieces)), 2).T)
    one = language_id.Segmenter(pieces, model.probability[:, :1])
    words = ["▁" + "".join(r.choice(list("abc"), 30)) for _ in range(20)]
    quick = model.log_probability(words)
    for i, w in enumerate(words):
        assert np.allclose(model.long_forward(w)[0][-1], quick[i])
        assert np.allclose(one.long_expected(w), one.expected([w], np.ones(1)))
    long = "▁" + "ab" * 40 + "c" * 3000
    assert np.allclose(model.log_probability([long])[0], model.long_forward("▁" + "ab" * 40)[0][-1] + 3000 * np.log(language_id.UNKNOWN))
    a = language_id.pa.array(["ab" * 40 + " " + "c" * 5000, None, "12", "ab"])
    total, n = model.text_scores(a)
    assert n.tolist() == [2, 0, 0, 1] and np.isfinite(total).all()


def test_equal_rows_are_dealt_to_several_blocks(spark):
    big = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, big)] * 90 + [(2, "a b c")] * 3 + [(3, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    parts = common.with_block(d, 96, common.Scratch(spark, "test"))
    got = parts.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("block").alias("blocks"))
    by = {x["doc_id"]: (x["n"], x["blocks"]) for x in got.collect()}
    assert by[1][0] == 90 and by[1][1] >= 2 and by[2] == (3, 1) and by[3] == (1, 1)
    out = substring_dedup.dedup_substrings(d, 35).groupBy("doc_id").agg(F.sum("n_removed").alias("r"), F.count("*").alias("n"))
    assert {x["doc_id"]: (x["r"], x["n"]) for x in out.collect()} == {1: (90 * 30_000, 90), 2: (0, 3), 3: (0, 1)}


def test_shared_folder_is_asked_for(spark):
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.Scratch(Session(), "x")


def test_rows_that_share_an_id(spark):
    """Two unrelated texts of one id are two groups; of equal rows one stays, the same in every run."""
    texts = ["one text about rivers and the towns on them in the spring", "another text that tells of bread and of the people who bake it"]
    rows = [(1, texts[0], "a"), (1, texts[1], "b"), (1, texts[1], "b"), (1, texts[1], "c"), (2, texts[0], "z"), (None, texts[1], "y")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for drop in (near_dup.drop_near_duplicates, simhash.drop_near_duplicates):
        kept = [sorted(map(tuple, drop(d.repartition(n)).collect())) for n in (1, 3)]
        assert kept[0] == kept[1] and len(kept[0]) == 2 and {k[1] for k in kept[0]} == set(texts) and {k[0] for k in kept[0]} == {1}


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, held_out string, _rest int, label string, row1 long, block int, taken long"


def test_pipeline_stages_keep_columns(spark):
    """Nulls, empty and repeated rows, columns of any name, empty tables."""
    text = "the river rises every spring and the villages along it have learned to build on stilts"
    rows = [(1, text, "en"), (2, text + " indeed", "en"), (3, None, None), (4, "", "en"), (None, "le chat est sur la table et le chien dort", "fr"), (5, "12 !!", "en"), (6, "der hund schläft unter dem tisch im garten", "de"), (6, "der hund schläft unter dem tisch im garten", "de")]
    rows += [(7, " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(20_000)), "en")]
    d = spark.createDataFrame([(*r, "s" if r[0] else None, 5, 777, 0.123, "h", 8, "l", 9, 10, 11) for r in rows], CLASHING).coalesce(2)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, d, "").cache()
        assert out.schema.simpleString() == d.schema.simpleString(), name
        assert {(r["n_words"], r["score"], r["held_out"], r["_rest"], r["label"], r["row1"], r["block"], r["taken"]) for r in out.collect()} == {(777, 0.123, "h", 8, "l", 9, 10, 11)}, name
        assert stage(spark, d.limit(0), "").count() == 0, name
    assert corpus_pipeline.pack(spark, d, "").count() >= len(rows) and corpus_pipeline.pack(spark, d.limit(0), "").count() == 0
