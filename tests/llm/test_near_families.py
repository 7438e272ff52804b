"""The pipeline's near-duplicate stage on families around its threshold."""

import itertools
import random

from sparkloom.llm import near_dup


def changed(r, words, n):
    """The words with n of them, far apart, replaced: each takes five of the shingles with it."""
    out = list(words)
    for i in r.sample(range(len(out) // 6), n):
        out[i * 6 + 3] = f"x{r.random()}"
    return " ".join(out)


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_a_family_under_the_threshold_costs_no_pairs(spark, monkeypatch):
    """Pairwise similarities of some 0.72: before, every second pair of such a family was verified."""
    r, seen, verified = random.Random(3), [], near_dup._verified
    monkeypatch.setattr(near_dup, "_verified", lambda pairs, sets, least: seen.append(pairs.count()) or verified(pairs, sets, least))
    base = [f"w{i}" for i in range(600)]
    texts = [changed(r, base, 10) for _ in range(300)]
    sets = [shingles(t) for t in texts]
    same = [(i, j, len(a & b) / len(a | b)) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2)]
    assert 0.7 < sorted(x[2] for x in same)[len(same) // 2] < 0.75
    label = list(range(len(texts)))
    for i, j, _ in (x for x in same if x[2] >= 0.8):
        label = [label[i] if x == label[j] else x for x in label]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(d).collect()}
    assert len(set(got.values())) == len(set(label)) == len(set(zip(got.values(), label, strict=True)))
    assert sum(seen) < 2 * len(texts)


def test_pairs_over_the_threshold_are_found(spark):
    r, rows = random.Random(9), []
    for i in range(600):
        base = [f"b{i}.{k}" for k in range(r.randint(120, 400))]
        a, n = " ".join(base), len(base) // 48
        b = changed(r, base, n)
        if 0.8 <= jaccard(a, b) <= 0.86:
            rows += [(2 * i, a), (2 * i + 1, b)]
    assert len(rows) > 500
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = sum(x["doc_id"] % 2 and x["component_id"] == x["doc_id"] - 1 for x in got)
    assert linked >= 0.999 * len(rows) / 2
