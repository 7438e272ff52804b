"""Connected parts over runs against dense labels."""

import numpy as np
import pytest

from sparkloom.operators import parts


def dense_parts(volume):
    """Boxes z1, y1, x1, z2, y2, x2 and pixels of the parts of an array (slices, rows, columns), pixel by pixel."""
    todo, out = set(map(tuple, np.argwhere(volume))), []
    for first in map(tuple, np.argwhere(volume)):
        if first not in todo:
            continue
        todo.remove(first)
        own, edge = [], [first]
        while edge:
            p = edge.pop()
            own.append(p)
            for k in range(3):
                for d in (-1, 1):
                    q = tuple(v + d * (i == k) for i, v in enumerate(p))
                    if q in todo:
                        todo.remove(q)
                        edge.append(q)
        own = np.array(own)
        out.append((*own.min(0).tolist(), *own.max(0).tolist(), len(own)))
    return out


def runs_of(volume):
    """(z, x, y, length) of the runs down the columns."""
    out = []
    for z, plane in enumerate(volume):
        for x, column in enumerate(plane.T):
            edge = np.flatnonzero(np.diff(np.r_[0, column.astype(int), 0]))
            out += [(z, x, int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return out


@pytest.mark.parametrize("share", [0.1, 0.35, 0.5, 0.62, 0.9, 1.0])
def test_many_masks_at_once(share):
    r, height = np.random.default_rng(int(share * 100)), 9
    volumes = [r.random((r.integers(1, 5), height, r.integers(1, 8))) < share for _ in range(40)]
    rows = np.array([(m, *run) for m, v in enumerate(volumes) for run in runs_of(v)], np.int64).reshape(-1, 5)
    rows = rows[r.permutation(len(rows))]
    rows = np.concatenate([rows, rows[: len(rows) // 3]])  # runs that repeat
    got = parts.run_parts(*rows.T, height)
    want = [(m, k, *p) for m, v in enumerate(volumes) for k, p in enumerate(dense_parts(v))]
    assert list(zip(*(got[c].tolist() for c in ("mask", "part", "z1", "y1", "x1", "z2", "y2", "x2", "pixels")), strict=True)) == want


def test_long_chains_settle():
    n = 5000
    order = np.random.default_rng(1).permutation(n)
    assert (parts.settled(n, order[:-1], order[1:]) == 0).all()
    assert parts.settled(4, np.array([2]), np.array([3])).tolist() == [0, 1, 2, 2]


def test_a_part_through_all_slices(spark):
    """A snail of single pixels that winds through a whole volume is one part; a mask of 10^8 pixels is a few runs."""
    snail = np.zeros((4, 16, 16), bool)
    for z in range(4):
        snail[z, ::2, :] = True
        for y in range(1, 15, 2):
            snail[z, y, 0 if y % 4 == 1 else 15] = True
    snail[:, 1::2, 7] = False
    rows = [("snail", z, x * 16 + y, n) for z, x, y, n in runs_of(snail)] + [("dots", 0, 0, 1), ("dots", 1, 17, 1), ("dots", 3, 0, 1)]
    d = spark.createDataFrame(rows, "name string, z int, start bigint, length bigint").repartition(3)
    got = {(r["name"], r["part"]): tuple(r)[2:] for r in parts.volume_components(d, ["name"], "z", 16).collect()}
    assert got["snail", 0] == (0, 0, 15, 14, 0, 3, int(snail.sum())) and len(got) == 4
    assert [got["dots", k][4] for k in range(3)] == [0, 1, 3]
    large = spark.createDataFrame([(1, x * 10_000, 10_000) for x in range(10_000)], "k int, start bigint, length bigint")
    assert [tuple(r) for r in parts.component_boxes(large, ["k"], 10_000).collect()] == [(1, 0, 0, 0, 9999, 9999)]
    assert parts.component_boxes(large.limit(0), ["k"]).count() == 0
