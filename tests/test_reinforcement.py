"""Prompts for reinforcement learning: look-up, partition and reasons."""

from sparkloom.operators import reinforcement as rl

ENTRIES = "rec int, messages array<struct<role:string,content:string>>, images array<string>"


def entry(rec, caption, zs, image):
    text = (f'The target structure is: "{caption}".' if caption else "") + (f" Sampled Z list ({len(zs)}): {zs}" if zs is not None else "")
    return (rec, [("user", text), ("assistant", "ok")], ["/x/other.jpg", image] if image else None)


def test_records_and_reasons(spark):
    a = "/r/v1_z003_raw.png"
    rows = [entry(1, "cyst", [0, 2, 4, 9, 2], a), entry(2, "none", [1], a), entry(3, None, [1], a), entry(4, "cyst", None, a), entry(5, "cyst", [], a), entry(6, "cyst", [1], "/r/raw.png"), entry(7, "cyst", [1], None)]
    rows += [(8, None, [a]), entry(9, "flat", [3, 1], a)]
    annos = [("v1", "cyst", 7, [9, 9, 9, 9]), ("v1", "cyst", 8, [0, 5, 6, None, 6]), ("v2", "none", 9, [1]), ("v1", "flat", 1, [0, 0])]
    d = rl.rl_records(spark.createDataFrame(rows, ENTRIES), spark.createDataFrame(annos, "vid string, caption string, anno_id int, areas array<bigint>"), "/data")
    got = {r["rec"]: r for r in d.collect()}
    one = got[1]
    assert len(got) == 9 and (one["anno_id"], one["vid"], one["data_root"], one["images"], len(one["messages"])) == (8, "v1", "/data", [], 1)
    assert (one["lesion_ordinals"], one["non_lesion_ordinals"], one["oracle_key_z"]) == ([1, 2, 4], [0, 3], 2)  # the first of equal areas
    assert (got[9]["lesion_ordinals"], got[9]["oracle_key_z"], got[9]["reason"]) == ([], None, None)
    assert {k for k, r in got.items() if r["reason"] == rl.UNKNOWN} == {2} and {k for k, r in got.items() if r["reason"] == rl.UNREADABLE} == {3, 4, 5, 6, 7, 8}
