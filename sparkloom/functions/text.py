"""Extraction of structure from model and prompt text."""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The forms that boxes and calls take in a text.
DECIMAL, SIGNED = r"(\d+(?:\.\d+)?)", r"([-+]?\d*\.?\d+)"
UNSIGNED_BOX = rf"\[\s*{DECIMAL}\s*,\s*{DECIMAL}\s*,\s*{DECIMAL}\s*,\s*{DECIMAL}\s*\]"
PLAIN_BOX = rf"\[\s*{SIGNED}\s*,\s*{SIGNED}\s*,\s*{SIGNED}\s*,\s*{SIGNED}\s*\]"
MARKED_BOX = rf"<\|box_start\|>\s*\({SIGNED}\s*,\s*{SIGNED}\)\s*,\s*\({SIGNED}\s*,\s*{SIGNED}\)\s*<\|box_end\|>"
NAMED_BOX = r'"bbox_2d"\s*:\s*' + PLAIN_BOX
TOOL_CALL = r"(?s)<tool_call>(.*?)</tool_call>"

# Caption keywords, in order of priority.
KEYWORDS = {
    "lesion": (
        "tumor", "tumour", "cancer", "mass", "abnormal", "malignant", "carcinoma", "lesion", "metastasis", "cluster of cells",
        "uncontrolled cell", "arising from", "tissue formed",
    ),
    "cyst": ("cyst", "fluid", "pouch", "cystic", "encapsulated", "non-malignant"),
    "organ": ("organ", "kidney", "liver", "spleen", "filtering", "responsible", "pair of", "essential for", "producing urine", "eliminating waste"),
}



def boxes_of(text: Column, pattern: str) -> Column:
    """All boxes that a pattern of four numbers finds, in order."""
    parts = [F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(i)), lambda x: x.cast("double")) for i in (1, 2, 3, 4)]
    at = lambda i: F.struct(*(F.get(p, i).alias(n) for p, n in zip(parts, ("x1", "y1", "x2", "y2"), strict=True)))
    return F.transform(parts[0], lambda _, i: at(i))


def plain_boxes(text: Column) -> Column:
    """Every [n, n, n, n] of non-negative decimals; none in a null text."""
    return F.coalesce(boxes_of(text, UNSIGNED_BOX), boxes_of(F.lit(""), UNSIGNED_BOX))


def referred_boxes(text: Column) -> Column:
    """(name, box) of each marked object that its marked box follows."""
    pattern = rf"<\|object_ref_start\|>(.*?)<\|object_ref_end\|>\s*{MARKED_BOX}"
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    parts = [F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(i)), lambda x: x.cast("double")) for i in (2, 3, 4, 5)]
    box = lambda i: F.struct(*(F.get(p, i).alias(n) for p, n in zip(parts, ("x1", "y1", "x2", "y2"), strict=True)))
    return F.transform(names, lambda name, i: F.struct(F.trim(name).alias("name"), box(i).alias("box")))


def slice_of(text: Column) -> Column:
    """(slice, slices) of a grounding prompt's "slice n out of m"; nulls where it has none."""
    part = lambda i: F.regexp_extract(text, r"slice (\d+) out of (\d+)", i).try_cast("int")
    return F.struct(part(1).alias("slice"), part(2).alias("slices"))


def color_places(names: Column, colors: int = 8) -> Column:
    """A color's number for each name: names in the order of their first appearance, around again after the last."""
    first = F.array_distinct(names)
    return F.transform(names, lambda n: ((F.array_position(first, n) - 1) % colors).cast("int"))


@F.pandas_udf(T.StringType())
def wrapped(texts: pd.Series) -> pd.Series:
    """Texts broken into lines of 60 characters at most, between words where there are any."""
    return texts.map(lambda t: "\n".join(textwrap.wrap(t, 60)), na_action="ignore")


def label_caption(label: Column, names: Column, terms: Column, place: Column) -> Column:
    """A label's description: one of its term's, by place; else a sentence with its name; null for the background.

    names: a map from labels to names; terms: a map to arrays of descriptions,
    asked for the name, the name in lower case, the label and that in lower case.
    """
    key = F.trim(F.coalesce(F.try_element_at(names, label), label))
    found = F.coalesce(*(F.when(F.size(F.try_element_at(terms, k)) > 0, F.try_element_at(terms, k)) for k in (key, F.lower(key), label, F.lower(label))))
    some = F.get(found, F.pmod(place, F.size(found)).cast("int"))
    plain = F.concat(F.lit("The "), F.when(key != "", key).otherwise(label), F.lit(" in the MRI scan."))
    return F.when((F.coalesce(label, F.lit("")) == "") | (F.lower(label) == "background"), F.lit(None)).otherwise(F.coalesce(some, plain))


def json_boxes(text: Column) -> Column:
    """Boxes of the JSON list between the first [ and the last ]; null unless all items are boxes.

    An item is a list of four numbers or an object with one under bbox_2d,
    bbox or box; a list may have both kinds.
    """
    body = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    items = F.from_json(F.regexp_replace(body, "'", '"'), "array<string>")
    named = lambda x: F.from_json(x, "bbox_2d array<double>, bbox array<double>, box array<double>")
    numbers = lambda x: F.when(x.startswith("["), F.from_json(x, "array<double>")).otherwise(F.coalesce(named(x)["bbox_2d"], named(x)["bbox"], named(x)["box"]))
    lists = F.transform(items, numbers)
    whole = lambda x: F.coalesce(F.size(x) == 4, F.lit(False)) & F.forall(x, lambda v: v.isNotNull())
    four = lambda a: F.struct(*(F.get(a, i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))
    return F.when((F.size(lists) > 0) & F.forall(lists, lambda x: F.coalesce(whole(x), F.lit(False))), F.transform(lists, four))


def cascade_boxes(text: Column) -> Column:
    """Boxes by the first form that finds any: JSON, marked, named, or a bare list that is the whole text."""
    some = lambda a: F.when(F.size(a) > 0, a)
    trimmed = F.trim(text)
    whole = trimmed.startswith("[") & trimmed.endswith("]")
    empty = boxes_of(F.lit(""), PLAIN_BOX)
    return F.coalesce(json_boxes(text), some(boxes_of(text, MARKED_BOX)), some(boxes_of(text, NAMED_BOX)), F.when(whole, some(boxes_of(text, PLAIN_BOX))), empty)


def parse_error(text: Column, boxes: Column) -> Column:
    """no_bbox_parsed if there are no boxes and the text does not say so itself."""
    says = F.lower(text).contains("no match") | F.lower(text).contains("none") | text.contains("[]")
    return F.when((F.size(boxes) == 0) & ~F.coalesce(says, F.lit(False)), F.lit("no_bbox_parsed"))


def tool_calls(text: Column) -> Column:
    """Bodies of the tool calls that are valid JSON."""
    bodies = F.transform(F.regexp_extract_all(text, F.lit(TOOL_CALL), F.lit(1)), lambda x: F.trim(x))
    return F.filter(bodies, lambda x: F.try_parse_json(x).isNotNull())


def reasoning(text: Column) -> Column:
    """What stands before the first tool call."""
    return F.trim(F.substring_index(text, "<tool_call>", 1))


def sampled_slices(text: Column) -> Column:
    """The whole numbers of "Sampled Z list ...: [..]"; null if there is no list.  What is no number is left out."""
    body = F.regexp_extract(text, r"Sampled Z list[^:]*:\s*\[([^\]]*)\]", 1)
    return F.when(F.trim(body) != "", F.filter(F.transform(F.split(body, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull()))


def marked_slices(text: Column) -> Column:
    """All Z=n of a text, in order; those beyond the range of an int are left out."""
    return _numbers(text, r"Z=(\d+)")


def listed_slices(text: Column) -> Column:
    """All Z=n that a colon follows: the slices of a prompt, not those of its analysis."""
    return _numbers(text, r"Z=(\d+):")


def _numbers(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def caption_of(text: Column) -> Column:
    """The target structure that a prompt names; null if it names none."""
    found = F.regexp_extract(text, r'target structure is:\s*"([^"]+)"', 1)
    return F.when(found != "", found)


def first_volume(paths: Column) -> Column:
    """Volume name of the first path that is a rendered slice; null if none is."""
    return F.get(F.filter(F.transform(paths, volume_of_render), lambda v: v != ""), F.lit(0))


def volume_of_render(path: Column) -> Column:
    """Volume name in the path of a rendered slice; empty if it is none."""
    return F.regexp_extract(path, r"/([^/]+?)_z\d+_(raw|bbox|mask|refined)\.png$", 1)


def parent_folder(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.try_element_at(parts, F.lit(-2))


def volume_id(path: Column, number: Column) -> Column:
    """A path as one name of word characters and dashes; vol_<number> if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(path, "/", "_"), r"\.npy$", "")
    name = F.regexp_replace(F.regexp_replace(name, r"[^\w-]", "_"), r"^_+|_+$", "")
    return F.when(name != "", name).otherwise(F.concat(F.lit("vol_"), number.cast("string")))


def slug(text: Column, most: int = 40) -> Column:
    """Lower-case letters and digits with single dashes between, x if nothing is left."""
    out = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)
    return F.when(out != "", out).otherwise(F.lit("x"))


def classify_caption(text: Column) -> Column:
    """lesion, cyst, organ or other by the first keyword list with a match."""
    out, low = F.lit("other"), F.lower(text)
    for name, words in reversed(KEYWORDS.items()):
        out = F.when(low.rlike("|".join(words)), F.lit(name)).otherwise(out)
    return out


def count_of(text: Column, mark: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("long")


def four_coordinates(text: Column) -> Column:
    """First four whole numbers up to 1000; null if there are fewer."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\d{1,4}"), F.lit(0)), lambda x: x.cast("int")), lambda x: x <= 1000)
    return F.when(F.size(found) >= 4, F.slice(found, 1, 4))


def prompt(template: str, *columns: Column) -> Column:
    return F.format_string(template, *columns)


def to_double(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def wrap_placeholders(text: Column, mark: str, values: Column) -> Column:
    """The text with its marks replaced in turn by the values; further marks stay."""
    parts = F.split(text, mark, -1)
    tail = F.transform(F.slice(parts, 2, F.size(parts)), lambda p, i: F.concat(F.coalesce(F.get(values, i), F.lit(mark)), p))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(tail, ""))
