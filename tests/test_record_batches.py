"""Records are built and judged for all cases of a batch at once, with the texts that the expressions give."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import phrases, wording
from sparkloom.operators import builders, records, verdicts
from sparkloom.plans import trajectories
from tests.conftest import SF
from tests.test_trajectories import SCHEMA, call, case

FORMS = {"boxes": builders.box_records, "masks": builders.mask_records, "navigation": builders.navigation_records}


@pytest.fixture(scope="module")
def odd_cases(spark):
    """Cases with slices sampled twice, fewer or more of them, and nulls in most places."""
    base = case()[-1]
    short = [(40 + i // 2, *r[1:]) for i, r in enumerate(base)]
    bare = [(r[0], None, None if i == 2 else r[2], r[3], r[4], None if i == 4 else r[5], r[6], r[7], None, r[9], None) for i, r in enumerate(base)]
    rows = [case(), case(2, o=short), case(3, o=bare, caption=None), case(4, o=base[:4]), case(5, o=base + base[1:3], category="cyst"), case(6, n_slices=2), case(7, n_slices=None), case(8, o=None), case(9, vid=None, category=None), case(10, o=[])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("query", [trajectories.box_trajectories, trajectories.mask_trajectories, trajectories.navigation_trajectories])
def test_records_are_built_and_judged_in_one_step(spark, capsys, query):
    """records were array functions, which are interpreted entry by entry."""
    query(spark, SF).explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_broken_entries_are_judged_in_batches(spark, capsys):
    """each call was parsed twice in an array function."""
    trajectories.broken_entries(spark, SF).explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 1 and plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("form", FORMS)
def test_cases_of_a_batch_do_not_touch_each_other(odd_cases, form):
    together = sorted(FORMS[form](odd_cases).collect())
    assert [r["rec"] for r in together] == [1, 2, 3, 4, 5, 9]
    for r in together:
        assert FORMS[form](odd_cases.filter(F.col("rec") == r["rec"])).collect() == [r]


def test_speech_is_that_of_the_expressions(odd_cases):
    o = F.array_sort(F.filter("o", lambda x: x["box"].isNotNull()), lambda x, y: x["z"] - y["z"])
    said = {"boxes": (1, 2), "masks": (1, 2)}
    for form in said:
        want = odd_cases.filter("rec in (1, 3, 4, 9)").select(
            "rec", records.spatial_text(F.col("caption"), F.transform("o", lambda x: x["z"]), F.transform("o", lambda x: x["area"]), form).alias("spatial"), records.review_text(o, form).alias("review")
        )
        got = {r["rec"]: [m["content"] for m in r["messages"] if m["role"] == "assistant"] for r in FORMS[form](odd_cases).collect()}
        for r in want.collect():
            assert got[r["rec"]][0] == r["spatial"] and got[r["rec"]][1].startswith(r["review"])


def test_numbers_are_written_as_spark_does(spark):
    values = [0.0, 1.0, 0.5, 0.0625, 0.5625, 0.0005, 0.00051, 0.125, 0.875, 2.675, 0.1 + 0.2, 1 / 3, -0.0004, 9999999.0, 12345678.5, 1e-5, -3.25e9, float("nan"), float("inf")]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    want = d.select(F.col("v").cast("string").alias("a"), wording.score(F.col("v")).cast("string").alias("b"), F.format_string("%.2f", "v").alias("c")).collect()
    v = pa.array(values)
    got = zip(phrases.text(v).to_pylist(), phrases.text(phrases.score(v)).to_pylist(), phrases.by_value(v, phrases.hundredths).to_pylist(), strict=True)
    assert list(got) == [tuple(r) for r in want]


def test_verdicts_are_those_of_the_expressions(spark, odd_cases):
    """Whatever calls hold; a text that is read in more than one way has no verdict in the batch."""
    calls = [
        "null", "{}", "[1]", "", " {", "{'name': 1}", '{"name": "scroll", "arguments": {"delta": "0"}}', '{"name": "scroll", "arguments": {"delta": 0}} x', '{"name": "scroll", "arguments": {"delta": 0}}', '{"name": 5, "arguments": {}}',
        '{"name": "add_bbox", "arguments": {"z_index": 1.0, "bbox": [1, 2, 3, 4]}}', '{"name": "add_bbox", "arguments": {"z_index": 40, "bbox": [1, 2, 3]}}', '{"name": "add_bbox", "arguments": {"z_index": 40, "bbox": [1, 2, 3, null]}}',
        '{"name": "add_bbox", "arguments": {"bbox": [1, 2, 1e999, 4]}}', '{"name": "add_bbox", "name": "add_bbox", "arguments": {}}', '{"name": "add_point", "arguments": {"points": [], "labels": []}}', '{"name": "add_point", "arguments": {"points": [[1, 2]], "labels": [1, 0]}}',
        '{"name": "add_point", "arguments": {"points": [[1, 2]], "labels": ["1"]}}', '{"name": "run_medsam2", "arguments": 3}', '{"name": "finish_3d_segmentation"}', '{"name": NaN}', call("get_slice", z_index=99999999999), call("zoom"),
    ]
    for form, build in FORMS.items():
        d = build(odd_cases.filter("rec in (1, 4)")).crossJoin(spark.createDataFrame([(c,) for c in [*calls, None]], "text string")).crossJoin(spark.range(3).withColumnRenamed("id", "place"))
        more = F.array(F.struct(F.lit("tool_call").alias("role"), F.col("text").alias("content")), F.struct(F.lit("tool_response").alias("role"), F.lit("{}").alias("content")))
        m = F.col("messages")
        d = d.withColumn("messages", F.when(F.col("place") == 0, F.concat(more, m)).when(F.col("place") == 1, F.concat(F.slice(m, 1, 9), more, F.slice(m, 10, 500))).otherwise(F.concat(m, more)))
        d = d.unionByName(d.filter("place = 0 AND text = ''").withColumn("messages", F.lit(None))).unionByName(d.filter("place = 0 AND text = ''").withColumn("images", F.lit(None)))
        got = records.validate_entries(d, form).withColumn("want", records._reason(verdicts.NAMES[form], form)).select("rec", "place", "text", "reason", "want").collect()
        assert len(got) == 2 * 3 * 24 + 4 and [r for r in got if r["reason"] != r["want"]] == [] and len({r["reason"] for r in got}) >= 5
    odd = verdicts.reasons(pa.array([[{"role": "tool_call", "content": t}] for t in (calls[6], calls[4])]), pa.array([[], []], pa.list_(pa.string())), "navigation").to_pylist()
    assert odd == [None, "tool call is not JSON"]
