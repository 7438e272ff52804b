"""Filter audit, Jaccard join and ranked search against plain versions, with odd rows, ties and families near the threshold."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bitmaps, filter_audit, jaccard_join, lexical_search

WORD, TERM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(lexical_search.TERM)
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "One TWO"), (None, "one two"), (None, None), (7, "x " * 50_000), (7, "x " * 50_000), (8, "one")]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# ---------------------------------------------------------------- filter audit


def plain_audit(rows, names, lost):
    """rows: (part, failing names, marks): every order by itself."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys(names, 0)
        for order in itertools.permutations(names):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                fails = sum(f in r[1] for r in own)
                alone = sum(r[1] == {f} for r in own)
                out[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), alone, *(sum(r[2][k] for r in gone) for k in range(lost))]
                shapley[f] += len(gone)
        for order in itertools.permutations(names):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


@pytest.mark.parametrize("names", ["P", "PQ", "PQRS"])
def test_audit_against_every_order(spark, names):
    r = random.Random(len(names))
    rows = [(r.choice(["a", "b", None]), *(r.choice([True, False, None]) for _ in names), r.choice([True, None])) for _ in range(200)] + [("c", *([True] * len(names)), True)]
    d = spark.createDataFrame(rows, "source string, " + ", ".join(f"{n} boolean" for n in names) + ", good boolean")
    got = filter_audit.audit_filters(d, {n: F.col(n) for n in names}, F.col("source"), {"good_lost": F.col("good")})
    want = plain_audit([(p or "", {n for n, f in zip(names, fs) if f}, [bool(g)]) for p, *fs, g in rows], list(names), 1)
    assert {(x[0], x[1], x[2]): list(x[3:]) for x in got.collect()} == want
    assert filter_audit.audit_filters(d.limit(0), {n: F.col(n) for n in names}, F.col("source")).count() == 0


def test_audit_states_are_made_once(spark, monkeypatch):
    made, save = [], filter_audit.Scratch.save
    monkeypatch.setattr(filter_audit.Scratch, "save", lambda self, df, name: made.append(name) or save(self, df, name))
    d = spark.range(40).select(F.lit("a").alias("source"), *((F.col("id") % k == 0).alias(f"k{k}") for k in (2, 3, 5)))
    out = filter_audit.audit_filters(d, {"x": F.col("k2"), "y": F.col("k3"), "z": F.col("k5")}, F.col("source")).collect()
    assert len(out) == 18 and sorted(m for m in made if "state" in m) == sorted(f"states/state={s}" for s in range(7))


def test_audit_text_facts_and_copies(spark):
    texts = [*(t for _, t in ODD), "A b A b #", "É A\x0bB\x1fC", "a\x1cb"]
    ids = [*(i for i, _ in ODD), 9, 10, 11]
    d = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("first", F.lit(1)).withColumn("digest", F.lit("x"))
    facts = filter_audit.text_facts(d.withColumnRenamed("first", "f"), "doc_id", "text")
    got = {(x["doc_id"], x["text"]): x for x in filter_audit.with_copies(facts).collect()}
    assert len(got) == len(set(zip(ids, texts, strict=True)))
    for (i, t), x in got.items():
        words = WORD.findall(t or "")
        assert (x["n_words"], x["n_distinct"], x["n_upper"], x["n_points"]) == (len(words), len(set(words)), len(re.findall("[A-Z]", t or "")), len(t or ""))
        assert x["marked"] == bool(re.search("[#$%&*|]", t or ""))
        assert x["copy"] == (i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u in zip(ids, texts, strict=True)))


# ---------------------------------------------------------------- Jaccard join


def plain_components(rows, shingle=3, num=90, den=100):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            least[root(i)] = min((x for x in (least.get(root(i)), d) if x is not None), default=None)
    return sorted(((d, len(s), least[root(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def joined(spark, rows, **more):
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("key", F.lit("x")).withColumn("label", F.lit(0))
    return sorted((tuple(r) for r in jaccard_join.jaccard_components(d, **more).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def edited(r, words, edits):
    out = list(words)
    for i in r.sample(range(len(out)), edits):
        out[i] = f"e{r.random()}"
    return " ".join(out)


@pytest.mark.parametrize("size,edits", [(30, (0, 2)), (200, (0, 6)), (200, (3, 4)), (900, (8, 20))])
def test_join_of_families_around_the_threshold(spark, size, edits):
    """Most pairs of a family have a similarity just over or just under 0.9."""
    r = random.Random(size + edits[1])
    rows = []
    for f in range(3):
        base = [f"w{f}.{r.randrange(400)}" for _ in range(size)]
        rows += [(len(rows) + i * 7, edited(r, base, r.randint(*edits))) for i in range(40)]
    chain = [f"c{i}" for i in range(400)]
    rows += [(5000 - i, " ".join(chain[i * 6 : i * 6 + 200])) for i in range(30)]  # each links to the next only
    assert joined(spark, rows) == plain_components(rows)


def test_join_with_other_bounds_and_odd_rows(spark, monkeypatch):
    r = random.Random(5)
    base = [r.choice("abcdefgh") + str(r.randrange(30)) for _ in range(120)]
    rows = ODD + [(100 + i, edited(r, base, r.randint(0, 14))) for i in range(60)] + [(None, " ".join(base)), (50, " ".join(base).upper())]
    assert joined(spark, rows) == plain_components(rows)
    for module in (jaccard_join,):  # chunks of a key, many packs
        monkeypatch.setattr(module, "NODE_CLASSES", 7)
        monkeypatch.setattr(module, "PACK_TOKENS", 100)
    assert joined(spark, rows, shingle=1, num=70) == plain_components(rows, 1, 70)
    assert joined(spark, rows, shingle=5, num=80) == plain_components(rows, 5, 80)
    assert joined(spark, rows, shingle=2, num=100) == plain_components(rows, 2, 100)
    assert joined(spark, []) == []
    with pytest.raises(ValueError):
        joined(spark, rows, num=50)


def test_prefix_bounds_hold_for_linked_pairs():
    r, bounds = np.random.default_rng(3), bitmaps.Bounds(90, 100)
    for _ in range(300):
        n = int(r.integers(1, 300))
        x = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.r_[x[r.random(len(x)) > 0.04], r.integers(0, 1 << 62, n // 25).astype(np.uint64)])
        shared = len(np.intersect1d(x, y))
        if not len(y) or 100 * shared < 90 * len(np.union1d(x, y)):
            continue
        n, m = np.array([len(x)]), np.array([len(y)])
        assert len(np.intersect1d(x[: bounds.prefix(n)[0]], y[: bounds.prefix(m)[0]]))
        both = np.intersect1d(x[: bounds.long_prefix(n)[0]], y[: bounds.long_prefix(m)[0]])
        assert len(both) >= max(bounds.shared(n)[0], bounds.shared(m)[0])
        bits = int(bitmaps.bit_count_of(np.array(min(len(x), len(y)))))
        differ = np.bitwise_count(bitmaps.parities(x, bits) ^ bitmaps.parities(y, bits)).sum()
        assert differ <= len(x) + len(y) - 2 * shared and not bounds.apart(n, m, differ)[0]
        assert (bitmaps.folded(bitmaps.parities(x, 2 * bits)) == bitmaps.parities(x, bits)).all()


def test_families_under_the_threshold_verify_few_pairs(spark, monkeypatch):
    """Texts of a pairwise similarity of some 0.87 are candidates by their prefixes; bitmaps leave few to verify."""
    r, seen, verified = random.Random(8), [], jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, sets, bounds: seen.append(pairs.count()) or verified(pairs, sets, bounds))
    base = [f"w{i}" for i in range(600)]
    rows = [(i, edited(r, base, 7)) for i in range(300)]
    assert joined(spark, rows) == plain_components(rows)
    assert sum(seen) < 10 * len(rows)


# ---------------------------------------------------------------- ranked search


def plain_search(docs, items, k):
    terms = [TERM.findall(lower(t)) for _, t in docs]
    held = [t for t in terms if t]
    n, total = len(held), sum(map(len, held))
    df = {}
    for t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall(lower(t)))
    out = []
    for i, own in asked.items():
        found = []
        for (d, _), t in zip(docs, terms, strict=True):
            m = 10 + 90 * len(t) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in own if x in t)
            if score:
                found.append((-score, d is None, d or 0, d))
        out += [(i, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,most", [(200, 1 << 18), (1 << 20, 9), (40, 1)])
def test_search_equals_scores_of_all(spark, shard, most):
    r = random.Random(shard)
    words = [f"t{i}" for i in range(60)] + ["É", "x-y", "B2"]
    docs = ODD + [(100 + i, " ".join(r.choice(words) for _ in range(r.randint(0, 25)))) for i in range(120)]
    docs += [(300 + i, "t1 t2 t3") for i in range(15)] + [(300, "t1 t2 t3"), (-5, "t1 t2 t3"), (None, "t1 t2 t3")]
    items = [(1, "T1 t2, t3!"), (2, "one x"), (3, None), (4, "nowhere at all"), (5, "t9 t10"), (5, "t11"), (None, "b2 é"), (6, "--"), (7, " ".join(words))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = lexical_search.search_documents(d, q, 7, most, shard)
    assert sorted((tuple(x) for x in got.collect()), key=str) == plain_search(docs, items, 7)


def test_search_of_empty_tables(spark):
    d, q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search_documents(d, full[1]).count() == lexical_search.search_documents(full[0], q).count() == 0
    nothing = spark.createDataFrame([(1, "--"), (2, None)], "doc_id long, text string")
    assert lexical_search.search_documents(nothing, full[1]).count() == 0


@pytest.mark.parametrize("leaf", [0, 2])
def test_wavelet_tree_keeps_postings_by_impact_in_every_node(monkeypatch, leaf):
    r = np.random.default_rng(1)
    monkeypatch.setattr(lexical_search, "LEAF_BITS", leaf)
    for docs in (1, 2, 5, 64, 77):
        pair = np.unique(r.integers(0, 9 * docs, 6 * docs))
        term, doc, impact = pair // docs, pair % docs, r.integers(1, 9, len(pair))
        tree = lexical_search.WaveletTree(term, doc, impact, docs)
        for t in np.unique(term):
            nodes = [(0, tree.ranges(np.array([t]))[1])]
            for level in range(tree.depth):
                nodes = [(2 * n + side, x) for n, spans in nodes for side, x in enumerate(tree.halves(level, n, spans))]
                for n, x in nodes:
                    inside = (term == t) & (doc >> (tree.depth - level - 1 + leaf) == n)
                    assert sorted(impact[inside], reverse=True) == tree.impacts[level + 1][int(x[0, 0]) : int(x[1, 0])].tolist()
