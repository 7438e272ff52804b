"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import ann, html_text, language_id, language_model, mixing, packing, quality, simhash, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, extra string, score double, fp long, size long, taken string, held_out string, s string, bucket int"
LONG = " ".join(f"w{i % 9000}" for i in range(60_000))
ROWS = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n\r\x0b\x0c ", "de", "a"), (4, "the cat sat on the mat and the dog ran to the house", "en", "b"), (5, "le chat est sur la table et le chien dort", "fr", None),
    (None, "the bird is in the tree and sings to the sky", None, "a"), (6, LONG, "en", "b"), (7, "the cat sat on the mat and the dog ran to the house", "en", "b"), (7, "the cat sat on the mat and the dog ran to the house", "en", "b"),
    (8, "!!! 123 ???", "en", "c"), (9, "Ünïcödé ßtraße \U0001f600 éa ​", "de", "c"), (10, "<|endoftext|> the end", None, None), (None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, 1, "x", 0.5, 3, 4, "t", "h", "s", 2) for r in ROWS], SCHEMA).coalesce(2).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2, None) for i in range(1, 11)] + [(None, 1, 1, None), (4, None, None, "z")], "doc_id long, quality int, toxic int, text string")


def test_substring_dedup(docs, empty):
    out = substring_dedup.dedup_substrings(docs, 9)
    rows = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert len(out.columns) == len(set(out.columns)) and {"block", "extra", "score"} <= set(out.columns)
    assert rows[1, None]["n_words"] == 0 and rows[7, ""]["n_removed"] == 13 and out.count() == len(ROWS)
    long = next(r for k, r in rows.items() if k[0] == 6)
    assert long["n_words"] == 60_000 and long["n_removed"] == 60_000
    digest = substring_dedup.dedup_substrings(docs, 35, digest=True).collect()
    assert len(digest) == len(ROWS)
    assert substring_dedup.dedup_substrings(empty, 35).count() == 0 and substring_dedup.dedup_substrings(empty, 35, digest=True).count() == 0


def test_toxicity(docs, empty, labels):
    out = toxicity.score_toxicity(docs, labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert toxicity.score_toxicity(docs, labels.limit(0)).count() == len(ROWS)


def test_simhash(docs, empty):
    out = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert out[1, "0" * 16] == out[2, "0" * 16] == out[3, "0" * 16] == out[None, "0" * 16] == 1
    assert next(c for (d, _), c in out.items() if d == 7) == 4
    kept = simhash.drop_near_duplicates(docs).select("doc_id").collect()
    assert sorted(r[0] or 0 for r in kept) == [0, 1, 4, 5, 6, 8, 9, 10]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.pack_documents(docs, path).collect()
    assert {r["doc_tokens"] for r in out if r["doc_id"] in (1, 2, 3)} == {1}
    assert sum(r["length"] for r in out if r["doc_id"] == 6) == next(r["doc_tokens"] for r in out if r["doc_id"] == 6) > 60_000
    assert packing.pack_documents(empty, path).count() == 0


def test_language_id(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = language_id.identify(docs, path).collect()
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert len(out) == len(ROWS) and by[1]["lang_pred"] == by[2]["lang_pred"] == by[8]["lang_pred"] == "und" and by[8]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in out)
    assert language_id.identify(empty, path).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")), path).collect()} == {"und"}


def test_quality(docs, empty, labels):
    out = quality.judge_quality(docs, labels).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(ROWS) and by[6]["n_words"] == 60_000 and by[6]["n_repeat_words"] == 60_000 and by[6]["base_failed"] and not by[1]["kept"]
    assert quality.judge_quality(empty, labels).count() == 0 and quality.judge_quality(docs, labels.limit(0)).count() == len(ROWS)


def test_language_model(docs, empty):
    out = language_model.interpolated_scores(docs).collect()
    assert len(out) == len(ROWS) and all(r["score"] < 0 for r in out) and {r["n_tokens"] for r in out if r["doc_id"] in (1, 2, 3)} == {1}
    assert language_model.interpolated_scores(empty).count() == 0


def test_mixing(docs, empty):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(ROWS) and all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.mix_sources(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_nearest(spark):
    rows = [(i, [float((i * 7 + j) % 5 - 2) for j in range(4)], "x", 1) for i in range(200)]
    rows += [(200, None, "x", 1), (250, [0.0] * 4, "x", 1), (300, [float("nan")] * 4, "x", 1), (350, [1.0, None, 0.0, 0.0], "x", 1), (400, [1.0, 2.0], "x", 1), (0, rows[0][1], "x", 1), (None, [1.0] * 4, "x", 1), (450, [], "x", 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, dim int")
    out = ann.nearest(v, v.filter("vec_id % 50 = 0")).collect()
    assert {r["query_id"] for r in out} == {0, 50, 100, 150} and max(r["rank"] for r in out) == 5
    assert all(r["query_id"] != r["vec_id"] for r in out) and ann.nearest(v.limit(0), v.limit(0)).count() == 0
    assert [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == 0] == [5, 10, 15, 20, 25]


def test_pages(spark):
    html = [
        (1, "u", None), (2, None, ""), (None, "u", "<p>unclosed <b>text &amp; more"), (3, "u", "<<<>>> < a"), (4, "u", "<div>" * 3000 + "deep"), (5, "u", "<script>var a = '<p>no</p>'"), (6, "u", "</p></div>x" + "<td>" * 50),
        (7, "u", "<html><body><nav><a href=x>home</a></nav><article><h1>Title here</h1><p>First&nbsp;paragraph of the   text, long enough.</p><p>Second one follows it, also long.</p></article><footer>(c) me</footer></body></html>"),
    ]
    pages = spark.createDataFrame([(*r, 1, "z") for r in html], "page_id long, url string, html string, n_chars int, text string")
    out = {r["page_id"]: r for r in html_text.extract_main_text(pages, training_pages=300).collect()}
    assert len(out) == len(html) and out[1]["text"] == "" and out[2]["n_chars"] == 0
    assert out[7]["text"] == "Title here\nFirst paragraph of the text, long enough.\nSecond one follows it, also long."
    assert html_text.extract_main_text(pages.limit(0), training_pages=50).count() == 0
