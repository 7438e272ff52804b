"""The rules of whole records for all records of an Arrow batch at once; see `records.validate_entries`.

Each distinct call of a batch is read once.  A text that is an object of the
usual types, or no JSON at all, is judged here.  What Spark's readers might
take otherwise (repeated keys, numbers as texts, text after the object, nulls
in a list) leaves the record without a verdict.
"""

from __future__ import annotations

import json
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import strips

#: Tools of each form, the one that finishes a record last.
NAMES = {
    "boxes": ("add_bbox", "finish_bbox_annotation"), "masks": ("add_bbox", "run_medsam2", "add_point", "finish_3d_segmentation"),
    "navigation": ("get_slice", "scroll", "add_bbox", "run_medsam2", "add_point", "finish_3d_segmentation"),
}
PLAIN, BROKEN, ODD = 0, 1, 2
#: Longer texts, and whole numbers out of this range, are odd.
LONG, MOST_WHOLE = 100_000, 1 << 53


class Call(NamedTuple):
    state: int
    name: int = -1
    box: bool = False
    points: bool = False
    still: bool = False
    z: int | None = None


class _Odd(Exception):
    pass


def _object(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise _Odd
    return out


def _constant(_: str) -> None:
    raise _Odd


_READER = json.JSONDecoder(object_pairs_hook=_object, parse_constant=_constant)


def _ask(ok: bool) -> None:
    if not ok:
        raise _Odd


def _whole(x: object) -> int | None:
    _ask(x is None or type(x) is int and -(1 << 31) <= x < 1 << 31)
    return x


def _numbers(x: object) -> list | None:
    _ask(x is None or type(x) is list and all(type(v) is float and abs(v) < 1e300 or type(v) is int and abs(v) < MOST_WHOLE for v in x))
    return x


@lru_cache(1 << 15)
def read(text: str, names: tuple[str, ...]) -> Call:
    """A call as the rules see it; name: its place in names, -1 for another or none."""
    try:
        _ask(len(text) < LONG and "\\ud" not in text.lower())
        try:
            call = _READER.decode(text)
        except ValueError:
            try:
                _READER.raw_decode(text.lstrip(" \t\r\n"))
            except ValueError:
                return Call(BROKEN)
            raise _Odd from None
        _ask(type(call) is dict)
        name, a = call.get("name"), call.get("arguments")
        _ask((name is None or type(name) is str) and (a is None or type(a) is dict))
        a = a or {}
        z, delta, _ = _whole(a.get("z_index")), _whole(a.get("delta")), _whole(a.get("key_z"))
        box, points, labels = _numbers(a.get("bbox")), a.get("points"), a.get("labels")
        _ask((points is None or type(points) is list) and (labels is None or type(labels) is list))
        for x in points or ():
            _ask(x is not None)
            _numbers(x)
        for x in labels or ():
            _ask(x is not None)
            _whole(x)
    except (_Odd, RecursionError):
        return Call(ODD)
    good = box is not None and len(box) == 4 and box[0] < box[2] and box[1] < box[3]
    paired = bool(points) and labels is not None and len(points) == len(labels)
    return Call(PLAIN, names.index(name) if name in names else -1, good, paired, delta == 0 and delta is not None, z)


def _flags(a: pa.Array) -> np.ndarray:
    return a.fill_null(False).to_numpy(zero_copy_only=False)


def reasons(messages: pa.Array, images: pa.Array, form: str) -> pa.Array:
    """The first rule that each record breaks, ok if none, null where it is not decided here."""
    n, names = len(messages), NAMES[form]
    values, counts = strips.lists(messages)
    row = np.repeat(np.arange(n), counts)
    role, content = (values.flatten()[values.type.get_field_index(k)] for k in ("role", "content"))
    odd = _flags(messages.is_null()) | _flags(images.is_null())
    odd[row[_flags(pc.or_(role.is_null(), content.is_null()))]] = True
    call = np.flatnonzero(_flags(pc.equal(role, "tool_call")))
    answers = np.bincount(row[_flags(pc.equal(role, "tool_response"))], minlength=n)
    marks = np.bincount(row, pc.count_substring_regex(content, "<image>").fill_null(0).to_numpy(), n)
    pictures = pc.list_value_length(images).fill_null(0).to_numpy(zero_copy_only=False)

    texts = content.take(pa.array(call)).dictionary_encode()
    read_texts = [Call(ODD) if t is None else read(t, names) for t in texts.dictionary.to_pylist()] or [Call(ODD)]
    state, name, box, points, still, z = zip(*read_texts, strict=True)
    at = texts.indices.fill_null(0).to_numpy(zero_copy_only=False)
    of = row[call]
    state, name, box, points, still = (np.array(v)[at] for v in (state, name, box, points, still))
    known = np.array([v is not None for v in z])[at]
    z = np.array([v or 0 for v in z], np.int64)[at]
    odd[of[state == ODD]] = True

    def some(which: np.ndarray) -> np.ndarray:
        return number(which) > 0

    def number(which: np.ndarray) -> np.ndarray:
        return np.bincount(of[which], minlength=n)

    def is_(*which: str) -> np.ndarray:
        return np.isin(name, [names.index(k) for k in which if k in names])

    calls, finish = np.bincount(of, minlength=n), is_(names[-1])
    end = np.cumsum(calls)
    last = np.zeros(n, bool)
    last[calls > 0] = finish[end[calls > 0] - 1]
    rules = [(marks != pictures, "image count"), (some(state == BROKEN), "tool call is not JSON"), (some(name < 0), "unknown tool"), (calls == 0, "no tool calls")]
    not_last = (~last, "finish is not last")
    if form == "navigation":
        rules += [not_last, (number(is_("run_medsam2")) != 1, "not one run_medsam2"), (some(is_("scroll") & still), "scroll by 0")]
    rules += [(some(is_("add_bbox") & ~box), "box corners"), (some(is_("add_point") & ~points), "points and labels")]
    if form == "navigation":
        moves = np.flatnonzero(is_("get_slice", "scroll"))
        opening = moves[np.r_[True, of[moves][1:] != of[moves][:-1]]] if len(moves) else moves
        rules += [(some(opening[is_("scroll")[opening]]), "first navigation is not get_slice")]
        # the slice in view is that of the last get_slice, unless a scroll or a propagation came after it
        turns = is_("get_slice", "scroll", "run_medsam2")
        since = np.maximum.accumulate(np.where(turns, np.arange(len(of)), -1)) if len(of) else of
        seen = (since >= 0) & (of[np.maximum(since, 0)] == of)
        seen &= is_("get_slice")[np.maximum(since, 0)] & known[np.maximum(since, 0)]
        rules += [(some(is_("add_bbox", "add_point") & seen & known & (z != z[np.maximum(since, 0)])), "annotation of a slice not viewed")]
    else:
        rules += [not_last]
    rules += [(number(~finish) != answers, "responses missing")]
    out = np.select([broken for broken, _ in rules], np.arange(len(rules)), len(rules))
    return pa.array([reason for _, reason in rules] + ["ok"]).take(pa.array(out, mask=odd))
