"""The templates and JSON of `wording` over Arrow arrays, for the texts of all records of a batch at once.

Arguments are arrays of equal length, or single texts.  Nulls count as in the
expressions: `fill` gives null where a part is null, `fields` leaves a null
value out, `joined` too, and `listed` writes null.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Words = pa.Array | pa.Scalar | str


def by_value(values: pa.Array, say: Callable) -> pa.Array:
    """say of each value as text, asked once for each distinct one; a null stays null."""
    d = values.dictionary_encode()
    return pa.array([say(v) for v in d.dictionary.to_pylist()], pa.string()).take(d.indices)


def number(value: float) -> str:
    """A double as Spark casts it."""
    if math.isnan(value) or math.isinf(value):
        return "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    if value == 0 or 1e-3 <= abs(value) < 1e7:
        return repr(value)
    sign, digits, power = Decimal(repr(value)).normalize().as_tuple()
    head, *rest = map(str, digits)
    return f"{'-' if sign else ''}{head}.{''.join(rest) or '0'}E{power + len(rest)}"


def hundredths(value: float) -> str:
    """The same as format_string's %.2f."""
    if math.isnan(value) or math.isinf(value):
        return number(value)
    return f"{Decimal(repr(value)).quantize(Decimal('0.01'), ROUND_HALF_UP):f}" if abs(value) < 1e15 else f"{value:.2f}"


def _thousandths(value: float) -> float:
    """Rounded half to even, as `wording.score` does."""
    if not abs(value) < 1e15:
        return value
    return float(Decimal(repr(value)).quantize(Decimal("0.001"), ROUND_HALF_EVEN)) + 0.0


def score(values: pa.Array) -> pa.Array:
    d = values.cast(pa.float64()).dictionary_encode()
    return pa.array([_thousandths(v) for v in d.dictionary.to_pylist()], pa.float64()).take(d.indices)


def text(value: Words) -> Words:
    if isinstance(value, str) or pa.types.is_string(value.type):
        return value
    return by_value(value, number) if pa.types.is_floating(value.type) else value.cast(pa.string())


def glued(*parts: Words) -> Words:
    """One text of all parts; texts next to each other are put together first."""
    out: list[Words] = []
    for part in parts:
        if isinstance(part, str) and out and isinstance(out[-1], str):
            out[-1] += part
        else:
            out.append(text(part))
    return pa.scalar(out[0]) if len(out) == 1 and isinstance(out[0], str) else pc.binary_join_element_wise(*out, "")


def fill(template: str, **values: Words) -> Words:
    """The template with its names in braces replaced."""
    parts = re.split(r"\{(\w+)\}", template)
    return glued(*(p if i % 2 == 0 else values[p] for i, p in enumerate(parts) if p))


def fields(**values: Words) -> Words:
    """A JSON object of values that are JSON already."""
    if any(isinstance(v, pa.Array) and v.null_count for v in values.values()):
        pairs = [glued(f'"{name}": ', value) for name, value in values.items()]
        return glued("{", pc.binary_join_element_wise(*pairs, ", ", null_handling="skip"), "}")
    pairs = ((f'{", " if i else ""}"{name}": ', value) for i, (name, value) in enumerate(values.items()))
    return glued("{", *(part for pair in pairs for part in pair), "}")


def tool_call(name: str, arguments: Words = "{}") -> Words:
    return fields(name=f'"{name}"', arguments=arguments)


def lists(words: pa.Array, rows: np.ndarray, n: int) -> pa.ListArray:
    """Entries, which follow each other by row, as a list for each of n rows."""
    edge = np.r_[0, np.cumsum(np.bincount(rows, minlength=n))]
    return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), words)


def joined(words: pa.Array, rows: np.ndarray, n: int, between: str) -> pa.Array:
    known = words.is_valid().to_numpy(zero_copy_only=False)
    return pc.binary_join(lists(words.drop_null(), rows[known], n), between)


def gathered(values: pa.Array, rows: np.ndarray, n: int) -> pa.Array:
    """[1, 2, 3] from the entries of each of n rows."""
    return glued("[", pc.binary_join(lists(text(values).fill_null("null"), rows, n), ", "), "]")


def listed(column: pa.ListArray, say: Callable[[pa.Array], pa.Array] = text) -> pa.Array:
    """[1, 2, 3] for each list; a null list is null."""
    edge = column.offsets.to_numpy()
    words = say(column.values.slice(edge[0], edge[-1] - edge[0])).fill_null("null")
    own = pa.ListArray.from_arrays(pa.array(edge - edge[0]), words)
    return pc.if_else(column.is_valid(), glued("[", pc.binary_join(own, ", "), "]"), pa.scalar(None, pa.string()))


def spread(points: pa.ListArray) -> pa.Array:
    """[[1, 2], [3, 4]]."""
    return listed(points, listed)
