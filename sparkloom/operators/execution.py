"""The fold of recorded tool calls, for all records of an Arrow batch at once.

A record's calls hang on each other, those of different records do not: the
first calls of all records are executed together, then the second ones, and so
on.  State is a row of each record: the slice in view and, by ordinal, the
overlay, what the last look showed, the box, the refined Dice, and whether the
slice was seen and annotated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import strips

KINDS = {name: i for i, name in enumerate(("get_slice", "scroll", "add_bbox", "add_point", "run_medsam2", "finish"))} | {"finish_3d_segmentation": 5}
OVERLAYS = pa.array(["raw", "bbox", "mask", "refined_mask"])
#: Calls times slices that are held at once.
STEP_CELLS = 4_000_000


def stretches(counts: np.ndarray, sampled: pa.Array) -> list[tuple[int, int]]:
    """Stretches of records that are folded together."""
    width = int(np.diff(sampled.offsets.to_numpy()).max(initial=1))
    return strips.chunks(counts, max(1, STEP_CELLS // width))


def _numbers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values with 0 for nulls, and which are known."""
    return a.fill_null(0).to_numpy(zero_copy_only=False), a.is_valid().to_numpy(zero_copy_only=False)


def _grid(column: pa.Array, width: int) -> tuple[pa.Array, np.ndarray]:
    """Values of a list column, and the place among them of each record's entry by ordinal, -1 where there is none."""
    values, counts = strips.lists(column)
    row, ordinal = np.repeat(np.arange(len(counts)), counts), strips.within(counts)
    at = np.flatnonzero((ordinal < width) & values.is_valid().to_numpy(zero_copy_only=False))
    grid = np.full((len(counts), width), -1)
    grid[row[at], ordinal[at]] = at
    return values, grid


def _taken(values: pa.Array, at: np.ndarray) -> pa.Array:
    """The values at these places, null at -1."""
    return values.take(pa.array(np.maximum(at, 0), mask=at < 0))


def _place(ordinal: np.ndarray) -> pa.Array:
    return pa.array(ordinal.astype(np.int32), mask=ordinal < 0)


def fold(calls: pa.Array, counts: np.ndarray, sampled: pa.Array, tight: pa.Array, rounds: pa.Array, clip: float, met: bool) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The record of each step up to its finish, and the steps' columns; met: with the state that a look shows.

    calls: structs of all records in order, of which each has as many as counts says.
    """
    name, (z, z_known), (delta, _), (fix, fixed) = calls.field("name"), *(_numbers(calls.field(k)) for k in ("z", "delta", "refined"))
    new_fix, new_known = _numbers(calls.field("rounded"))
    box, boxed = calls.field("box"), calls.field("box").is_valid().to_numpy(zero_copy_only=False)
    code = name.dictionary_encode()
    kinds = np.array([KINDS.get(k, -1) for k in code.dictionary.to_pylist()] + [-1])
    kind = kinds[code.indices.fill_null(len(kinds) - 1).to_numpy(zero_copy_only=False)]

    size = np.diff(sampled.offsets.to_numpy())
    rows, width = len(counts), max(1, int(size.max(initial=0)))
    slices, place = _grid(sampled, width)
    number = np.r_[_numbers(slices)[0], 0][place].astype(np.int64)
    true_boxes, truth = _grid(tight, width)
    spread_dice, spread_at = _grid(rounds, width)
    dice = np.r_[_numbers(spread_dice)[0], 0.0][spread_at]
    of = np.repeat(np.arange(rows), counts)
    same = (number[of] == z[:, None]) & (place[of] >= 0) & z_known[:, None]
    found = np.where(same.any(axis=1), same.argmax(axis=1), -1)

    view, spread = np.full(rows, -1), np.zeros(rows, bool)
    overlay, read, boxes = np.zeros((rows, width), np.int8), np.full((rows, width), -1, np.int8), np.full((rows, width), -1)
    refined, corrected_known, seen, drawn_on = np.zeros((rows, width)), *(np.zeros((rows, width), bool) for _ in range(3))

    n = len(kind)
    prev, ptr, shown_box, true_at = (np.full(n, -1) for _ in range(4))
    ran, ok, clamped, decision, changed, again, look, shows_dice, shows_refined = (np.zeros(n, bool) for _ in range(9))
    gain, shown_dice, shown_refined, shown = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, np.int8)
    annotated = np.zeros((n if met else 0, width), bool)
    first, live = np.cumsum(counts) - counts, np.arange(rows)
    for k in range(int(counts.max(initial=0))):
        live = live[counts[live] > k]
        if not len(live):
            break
        c = first[live] + k
        what, old, to = kind[c], view[live], found[c]
        jump, scroll, draw, point, run = (what == i for i in range(5))
        on = old >= 0
        here = on & (place[live, old] >= 0) & z_known[c] & (number[live, old] == z[c])
        target = old + delta[c]
        moved = np.maximum(np.minimum(target, size[live] - 1), 0)
        leap, slid, drawn, corrected = jump & (to >= 0), scroll & on & (delta[c] != 0), draw & here, point & here
        looks = leap | slid
        now = np.where(leap, to, np.where(slid, moved, old))
        # a scroll by 0 is refused, yet it is a move that was decided on
        moves = looks | (scroll & on)
        state = overlay[live, now]
        ran[c], prev[c], ptr[c], ok[c], clamped[c] = True, old, now, looks | drawn | corrected | run | (what == 5), slid & (moved != target)
        decision[c], changed[c], again[c], look[c] = moves, moves & (read[live, now] != state), moves & seen[live, now], looks
        true_at[c] = np.where(drawn, truth[live, old], -1)
        has = corrected_known[live, to] & (to >= 0)
        before = np.where(has, refined[live, to], np.where(spread[live] & (spread_at[live, to] >= 0), dice[live, to], 0.0))
        before = np.where((to >= 0) & (truth[live, to] >= 0), before, 0.0)
        after = np.where(corrected, np.where(fixed[c], fix[c], 0.0), np.where(has, refined[live, to], before))
        gain[c] = np.fmin(np.maximum(after - before, 0.0), clip)
        if met:
            shown[c], shown_box[c], annotated[c] = state, boxes[live, now], drawn_on[live]
            shows_dice[c], shown_dice[c] = spread[live] & (spread_at[live, now] >= 0), dice[live, now]
            shows_refined[c], shown_refined[c] = corrected_known[live, now], refined[live, now]

        view[live] = now
        seen[live[looks], now[looks]] = True
        # a look that fails still shows the slice in view
        w = (jump | scroll) & (now >= 0)
        read[live[w], now[w]] = state[w]
        r, i = live[drawn], old[drawn]
        overlay[r, i], drawn_on[r, i], boxes[r, i] = 1, True, np.where(boxed[c[drawn]], c[drawn], -1)
        r, i = live[corrected], old[corrected]
        overlay[r, i], refined[r, i], corrected_known[r, i] = 3, new_fix[c[corrected]], new_known[c[corrected]]
        r = live[run]
        overlay[r] = np.where(spread_at[r] >= 0, 2, overlay[r])
        spread[r] = True
        live = live[what != 5]

    steps = np.flatnonzero(ran)
    own = {k: calls.field(k).take(pa.array(steps)) for k in ("pos", "name", "z", "delta")}
    own |= {"prev": _place(prev[steps]), "ptr": _place(ptr[steps])} | {k: pa.array(v[steps]) for k, v in (("ok", ok), ("clamped", clamped), ("decision", decision), ("changed", changed), ("again", again))}
    drew = (kind == 2) & ok
    own |= {"gain": pa.array(gain[steps], mask=kind[steps] != 3), "called": _taken(box, np.where(drew, np.arange(n), -1)[steps]), "truth": _taken(true_boxes, true_at[steps])}
    if met:
        s = look[steps]
        own |= {"fix": calls.field("refined").take(pa.array(steps)), "shown": OVERLAYS.take(pa.array(shown[steps].astype(np.int64), mask=~s)), "shown_box": _taken(box, np.where(s, shown_box[steps], -1))}
        own |= {k: pa.array(v[steps], mask=~(s & h[steps])) for k, v, h in (("shown_dice", shown_dice, shows_dice), ("shown_refined", shown_refined, shows_refined))}
        own |= {"visited": _so_far(of[steps], s, ptr[steps]), "annotated": _marked(annotated[steps], s)}
    return of[steps], own


def _lists(values: np.ndarray, counts: np.ndarray, known: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values.astype(np.int32)), mask=pa.array(~known))


def _so_far(record: np.ndarray, look: np.ndarray, ptr: np.ndarray) -> pa.Array:
    """The slices that a record has looked at up to each of its looks."""
    at = np.flatnonzero(look)
    begin = np.searchsorted(record[at], record[at])
    n = np.zeros(len(look), np.int64)
    n[at] = np.arange(len(at)) - begin + 1
    return _lists(ptr[at][np.repeat(begin, n[at]) + strips.within(n[at])], n, look)


def _marked(annotated: np.ndarray, look: np.ndarray) -> pa.Array:
    """Ordinals of the slices annotated before each look."""
    on = annotated & look[:, None]
    return _lists(np.nonzero(on)[1], on.sum(axis=1), look)
