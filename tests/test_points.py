"""Points on error pixels: draws, ranks and whole masks."""

import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import masks, points


def test_draws_are_sets_of_all_kinds(spark):
    n, k = 5, 3
    d = spark.range(4000).select(points.draw_ranks(F.lit(n).cast("bigint"), k, 7, F.col("id")).alias("r"))
    seen = Counter(tuple(r[0]) for r in d.collect())
    assert set(seen) == set(itertools.combinations(range(n), k))
    assert all(abs(c - 400) < 100 for c in seen.values())  # five standard deviations
    for n in range(4):
        assert spark.range(1).select(points.draw_ranks(F.lit(n).cast("bigint"), k, 7, F.col("id"))).first()[0] == list(range(n))
    assert spark.range(1).select(points.draw_ranks(F.lit(9).cast("bigint"), 0, 7, F.col("id"))).first()[0] == []


def test_every_rank_has_its_pixel(spark):
    runs = [(3, 2), (9, 1), (20, 4)]
    d = spark.createDataFrame([(runs,)], f"runs {masks.RUNS}")
    got = d.select(points.pixels(F.col("runs")), points.pixels_at(F.col("runs"), F.sequence(F.lit(0).cast("bigint"), F.lit(6).cast("bigint")))).first()
    assert got[0] == 7 and got[1] == [3, 4, 9, 20, 21, 22, 23]


def test_points_lie_on_errors(spark):
    """Overlapping, equal, lone and huge masks; the huge ones have 10^8 and more pixels in a few runs."""
    true = {1: [(10, 5), (40, 10)], 2: [(0, 4)], 3: [(7, 2)], 5: [(0, 10**8), (10**9, 10**7)], 6: [(0, 3)]}
    pred = {1: [(12, 30)], 2: [(0, 4)], 4: [(512 * 3 + 8, 1)], 5: [(5, 10**8)], 6: [(1, 1)]}
    table = lambda m: spark.createDataFrame([(k, s, n) for k, runs in m.items() for s, n in runs], "k int, start bigint, length bigint")
    got = {r["k"]: r for r in points.error_points(table(true), table(pred), ["k"], height=512).collect()}
    again = {r["k"]: r for r in points.error_points(table(true).repartition(5), table(pred), ["k"], height=512).collect()}
    assert got == again and set(got) == {1, 2, 3, 4, 5, 6}
    inside = lambda m, p: any(s <= p < s + n for s, n in m)
    for k, r in got.items():
        spots = [x * 512 + y for x, y in r["points"]]
        for label, mine, other, most in ((1, true.get(k, []), pred.get(k, []), 3), (0, pred.get(k, []), true.get(k, []), 2)):
            own = [p for p, on in zip(spots, r["labels"], strict=True) if on == label]
            assert len(own) == len(set(own)) and all(inside(mine, p) and not inside(other, p) for p in own)
            if k != 5:
                errors = sum(inside(mine, p) and not inside(other, p) for p in range(2000))
                assert len(own) == min(most, errors)
    assert got[2]["points"] == [] and got[3]["points"] == [[0, 7], [0, 8]] and got[4]["points"] == [[3, 8]] and got[6]["labels"] == [1, 1]
    assert len(got[5]["points"]) == 5


@pytest.mark.parametrize("seed", [1, 2])
def test_other_seeds_draw_others(spark, seed):
    a = spark.createDataFrame([(1, 0, 10**6)], "k int, start bigint, length bigint")
    draw = lambda s: points.error_points(a, a.limit(0), ["k"], seed=s).first()["points"]
    assert draw(seed) == draw(seed) != draw(seed + 10)
