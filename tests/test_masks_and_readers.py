"""Masks, readers and quantiles against plain versions."""

import io
import json
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.operators import annotations, masks, metrics
from sparkloom.sources import readers, volumes, writers

PIXELS = st.lists(st.tuples(st.integers(0, 7), st.integers(0, 10)), max_size=40)


def mask_of(points, height=8, width=11):
    m = np.zeros((height, width), bool)
    for y, x in points:
        m[y, x] = True
    return m


def table(spark, pairs):
    """Runs of many masks, keyed by number."""
    rows = [(k, int(s), int(n)) for k, m in enumerate(pairs) for s, n in zip(*masks.runs_of(m), strict=True)]
    return spark.createDataFrame(rows, "k long, start long, length long")


@pytest.mark.parametrize("height", [500, 420, 1024])
def test_scores_at_any_height(spark, height):
    boxes = lambda *b: spark.createDataFrame([(1, *b)], "k int, x1 int, y1 int, x2 int, y2 int")
    a, b = (masks.box_runs(boxes(*x), ["k"], height) for x in ((10, 20, 29, 49), (20, 30, 39, 59)))
    row = masks.mask_scores(a, b, ["k"]).first()
    assert (row["gt_area"], row["pred_area"], row["shared"]) == (600, 600, 200) and row["dice"] == pytest.approx(400 / 1200)


def test_algebra_of_random_masks(spark):
    r = np.random.default_rng(1)
    a, b = ([r.random((8, 11)) < p for p in (0.2, 0.5, 0.9, 0.5, 0.0)] for _ in range(2))
    x, y = table(spark, a), table(spark, b)
    for how, plain in (("and", np.logical_and), ("or", np.logical_or), ("xor", np.logical_xor), ("minus", lambda p, q: p & ~q)):
        got = masks.combine(x, y, ["k"], how).toPandas()
        for k, (p, q) in enumerate(zip(a, b, strict=True)):
            own = got[got.k == k]
            assert (masks.dense(own.start.to_numpy(), own.length.to_numpy(), 11, 8) == plain(p, q)).all()
    shared = {r["k"]: r["shared"] for r in masks.shared_areas(x, y, ["k"]).collect()}
    assert shared == {k: int((p & q).sum()) for k, (p, q) in enumerate(zip(a, b, strict=True)) if (p & q).any()}


@settings(max_examples=80, deadline=None)
@given(PIXELS)
def test_distances(points):
    m = mask_of(points)
    d = masks.squared_distances(m)
    at = np.argwhere(m)
    for y, x in np.ndindex(m.shape):
        assert d[y, x] == (((at - (y, x)) ** 2).sum(axis=1).min() if len(at) else np.inf)


def _hd95(a, b):
    p, q = (np.argwhere(masks.surface(m)).astype(float) for m in (a, b))
    d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2))
    return np.percentile(np.r_[d.min(axis=1), d.min(axis=0)], 95)


def test_distance_of_volumes(spark):
    """Slices 2, 5 and 9 are stacked as neighbours; others do not count."""
    r = np.random.default_rng(5)
    rows = {0: [], 1: []}
    volumes = {}
    for rec in range(4):
        stacks = np.zeros((2, 3, 8, 11), bool)
        for depth, z in enumerate((2, 5, 9)):
            for side in (0, 1):
                m = r.random((8, 11)) < (0.5 if side == 0 or rec != 3 else 0)
                stacks[side, depth] = m
                rows[side] += [(rec, z, int(s), int(n)) for s, n in zip(*masks.runs_of(m), strict=True)]
        rows[1].append((rec, 7, 0, 8))
        volumes[rec] = stacks
    truth, pred = (spark.createDataFrame(rows[k], "rec long, z long, start long, length long") for k in (0, 1))
    annotated = spark.createDataFrame([(rec, z) for rec in range(4) for z in (2, 5, 9)], "rec long, z long")
    slices, cases = masks.case_scores(truth, pred, annotated, ["rec"], "z", 8)
    got = {x["rec"]: x for x in cases.collect()}
    for rec, (a, b) in volumes.items():
        assert got[rec]["n_slices"] == 3 and got[rec]["dice"] == pytest.approx(2 * (a & b).sum() / (a.sum() + b.sum()))
        if b.any():
            assert got[rec]["hd95"] == pytest.approx(_hd95(a, b))
        else:
            assert got[rec]["hd95"] is None and got[rec]["recall"] == 0
    assert slices.count() == 12


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 300_000), max_size=30))
def test_compressed_lengths(counts):
    assert masks.from_compressed(masks.to_compressed(counts)) == counts


def test_distances_by_pairs_and_by_transform(monkeypatch):
    r = np.random.default_rng(8)
    for shape in ((9, 12), (4, 9, 12)):
        a, b = (r.random(shape) < 0.4 for _ in range(2))
        pairs = masks.hausdorff_95(a, b)
        monkeypatch.setattr(masks, "PAIRS", 0)
        assert masks.hausdorff_95(a, b) == pytest.approx(pairs) == pytest.approx(_hd95(a, b))
        monkeypatch.undo()
    flat = r.random((8, 11)) < 0.6
    start, length = masks.runs_of(flat)
    got = masks.surface_points(np.stack([np.zeros_like(start), start // 8, start % 8, length]), True)
    assert {(y, x) for _, x, y in got.tolist()} == {tuple(p) for p in np.argwhere(masks.surface(flat)).tolist()}


def test_compressed_lengths_of_known_texts():
    """Texts as the usual tools write them."""
    assert masks.to_compressed([6, 1, 40, 4, 5, 4, 5, 4, 21]) == "61X13mN000`0"
    assert masks.from_compressed("61X13mN000`0") == [6, 1, 40, 4, 5, 4, 5, 4, 21]


def test_morphology(spark):
    m = mask_of([(4, 5)])
    runs = table(spark, [m])
    assert masks.mask_areas(masks.morph(runs, ["k"], 2, True, 11, 8), ["k"]).first()["area"] == 13
    assert masks.morph(runs, ["k"], 1, False, 11, 8).count() == 0
    grown = masks.dilate(m, 3)
    areas = {int(masks.dilate(grown, n).sum()) for n in (1, 2, 3)} | {int(masks.erode(grown, n).sum()) for n in (1, 2)}
    many = table(spark, [grown] * 40)
    got = [r["area"] for r in masks.mask_areas(masks.simulated(many, ["k"], 11, 8), ["k"]).collect()]
    assert len(got) == 40 and set(got) <= areas and len(set(got)) > 2
    assert set(got) == {r["area"] for r in masks.mask_areas(masks.simulated(many.repartition(5), ["k"], 11, 8), ["k"]).collect()}


def png(image, kind=0, filters=(0, 1, 2, 3, 4)):
    h, w = image.shape
    out, flat = b"", np.zeros((h + 1, w + 1), int)
    flat[1:, 1:] = image
    for y in range(1, h + 1):
        how = filters[(y - 1) % len(filters)]
        line = []
        for x in range(1, w + 1):
            a, b, c = flat[y, x - 1], flat[y - 1, x], flat[y - 1, x - 1]
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, min((a, b, c), key=lambda v: abs(p - v))][how]
            line.append((flat[y, x] - guess) % 256)
        out += bytes([how, *line])
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    palette = chunk(b"PLTE", bytes(range(256)) * 3) if kind == 3 else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + palette + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_label_images(spark, tmp_path):
    r = np.random.default_rng(2)
    images = {z: r.integers(0, 4, (9, 7)) for z in (3, 12)}
    (tmp_path / "case1").mkdir()
    for (z, image), kind in zip(images.items(), (0, 3), strict=True):
        (tmp_path / "case1" / f"{z:05d}.png").write_bytes(png(image, kind))
    got = readers.read_label_images(spark, str(tmp_path)).toPandas()
    assert set(got.folder) == {"case1"}
    for z, image in images.items():
        for label in (1, 2, 3):
            own = got[(got.z == z) & (got.label == label)]
            assert (masks.dense(own.start.to_numpy(), own.length.to_numpy(), 7, 9) == (image == label)).all()
    with pytest.raises(ValueError, match="PNG"):
        readers.label_image(b"\x89PNG\r\n\x1a\n")


@pytest.mark.parametrize("kind", ["csr", "csc", "coo"])
def test_sparse_masks(spark, tmp_path, kind):
    r = np.random.default_rng(3)
    full = (r.random((2, 6, 5, 4)) < 0.3).astype(np.uint8)
    flat = full.reshape(2, -1)
    row, col = np.nonzero(flat)
    if kind == "coo":
        parts = {"row": row, "col": col}
    else:
        major, minor, n = (row, col, 2) if kind == "csr" else (col, row, flat.shape[1])
        order = np.lexsort((minor, major))
        parts = {"indices": minor[order], "indptr": np.r_[0, np.cumsum(np.bincount(major, minlength=n))]}
    buffer = io.BytesIO()
    np.savez_compressed(buffer, format=kind.encode(), shape=flat.shape, data=np.ones(len(row), np.uint8), **parts)
    (tmp_path / "mask_(2, 6, 5, 4).npz").write_bytes(buffer.getvalue())
    (tmp_path / "mask_z_(2, 6, 5, 4).npz").write_bytes(buffer.getvalue())
    got = readers.read_sparse_masks(spark, str(tmp_path), "mask_(*.npz").toPandas()
    for mask in range(2):
        for z in range(4):
            own = got[(got["mask"] == mask) & (got.z == z)]
            assert (masks.dense(own.start.to_numpy(), own.length.to_numpy(), 5, 6) == full[mask, :, :, z].astype(bool)).all()
    assert readers.first_files(spark, str(tmp_path)).first()["file"].endswith("mask_(2,%206,%205,%204).npz") or readers.first_files(spark, str(tmp_path)).count() == 1


def test_volumes_by_axis(spark, tmp_path):
    volume = np.arange(2 * 3 * 4.0).reshape(2, 3, 4)
    np.save(tmp_path / "v.npy", volume[None])
    for axis, stack in (("axial", volume.transpose(2, 0, 1)), ("coronal", volume), ("sagittal", volume.transpose(1, 0, 2))):
        got = volumes.read_volumes(spark, str(tmp_path), axis=axis).orderBy("place").collect()
        assert [r["pixels"] for r in got] == [s.ravel().tolist() for s in stack]
    assert [r["z"] for r in volumes.read_volumes(spark, str(tmp_path), n=10).orderBy("place").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 0, 1]
    assert [r["z"] for r in volumes.read_volumes(spark, str(tmp_path), n=2, first=1).orderBy("place").collect()] == [1, 3]
    drawn = readers.slice_places(50, 7, sampling="random", seed=1)
    assert drawn == sorted(set(drawn)) and len(drawn) == 7 and readers.slice_places(50, 5, 10, 20) == [10, 12, 14, 16, 19]
    assert readers.windowed(np.array([-2000.0, -600.0, 5000.0]), -600, 1600).tolist() == [0, 127, 255]


def test_lines_of_split_files(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 90) for i in range(4000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("one\n\nthree\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        d = readers.read_lines(spark, str(tmp_path))
        assert d.rdd.getNumPartitions() >= 1 and d.select("file").distinct().count() == 2
        got = {(r["file"].rsplit("/", 1)[1], r["line"]): r["value"] for r in d.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {k[1]: v for k, v in got.items() if k[0] == "a.txt"} == dict(enumerate(lines)) and got["b.txt", 2] == "three"


def test_records_by_place(spark, tmp_path):
    rows = [{"objects": {"ref": [], "bbox": [[1, 2, 3, 4]] if i % 2 else []}} for i in range(20)]
    (tmp_path / "g.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    d = readers.read_records(spark, str(tmp_path / "g.jsonl"), readers.GROUNDING, numbered=True)
    assert readers.pick_records(d, line=4).count() == 1 and readers.pick_records(d).count() == 10 and readers.pick_records(d, n=3).count() == 3
    assert readers.pick_records(d, n=12, negatives=True).count() == 12


def test_catalogs_and_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "0006.json").write_text(json.dumps({"labels": {"0": "liver", "1": "cyst"}, "train": [{"image": "a/x.npy"}, {"image": "a/gone.npy"}], "test": [{"image": "a/y.npy"}]}))
    (tmp_path / "c" / "0007.json").write_text(json.dumps({"labels": {}, "train": [{"image": "a/z.npy"}], "test": []}))
    (tmp_path / "d" / "a").mkdir(parents=True)
    for name in ("x", "y"):
        (tmp_path / "d" / "a" / f"{name}.npy").write_bytes(b"0")
    items = readers.read_catalog(spark, str(tmp_path / "c"))
    assert items.count() == 3
    have, missing = readers.present_files(spark, items, str(tmp_path / "d"))
    assert {r["image"] for r in have.collect()} == {"a/x.npy", "a/y.npy"} and [r["image"] for r in missing.collect()] == ["a/gone.npy"]
    labels = readers.read_labels(spark, str(tmp_path / "c"))
    assert {(r["code"], r["mask"], r["label"]) for r in labels.collect()} == {("0006", 0, "liver"), ("0006", 1, "cyst")}
    kept = annotations.labelled(labels.withColumn("label", F.when(F.col("mask") == 0, "Background").otherwise(F.col("label"))), "label", "mask", 5)
    assert [r["label"] for r in kept.collect()] == ["cyst"] and annotations.labelled(labels, "label", "mask", 1).count() == 1


def test_gray_images(spark, tmp_path):
    image = np.arange(12).reshape(3, 4) * 20
    (tmp_path / "v1").mkdir()
    for z in (0, 1):
        (tmp_path / "v1" / f"{z:05d}.png").write_bytes(png(image + z))
    d = readers.read_images(spark, str(tmp_path / "v1"))
    got = readers.gray_stack(d).orderBy("z").collect()
    assert [(r["folder"], r["z"], r["height"], r["width"]) for r in got] == [("v1", 0, 3, 4), ("v1", 1, 3, 4)] and got[0]["gray"] == bytes(image.ravel().tolist())
    sized = readers.with_image_size(spark.createDataFrame([("v1",), ("v2",)], "vid string"), d, "vid").orderBy("vid").collect()
    assert [(r["img_w"], r["img_h"]) for r in sized] == [(4, 3), (None, None)]


def test_written_counts(spark, tmp_path):
    rows = [(1, None), (2, None), (3, "no slices"), (4, "no slices"), (5, "no caption"), (6, "else")]
    d = spark.createDataFrame(rows, "rec int, reason string")
    counts = writers.write_sifted(d, str(tmp_path / "out"), ("no slices", "no caption", "never"))
    assert counts == {"read": 6, "written": 2, "no slices": 2, "no caption": 1, "never": 0, "other": 1}
    assert sorted(r["rec"] for r in spark.read.json(str(tmp_path / "out")).collect()) == [1, 2]
    bad = d.withColumn("rec", F.when(F.col("rec") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("rec")))
    with pytest.raises(Exception, match="lost"):
        writers.write_sifted(bad, str(tmp_path / "none"), ())
    assert not list((tmp_path / "none").glob("*.json")) if (tmp_path / "none").exists() else True
    assert writers.write_sifted(d.limit(0), str(tmp_path / "empty"), ())["read"] == 0


def test_split_records_and_metric_files(spark, tmp_path):
    d = spark.createDataFrame([("train", 1, "é"), ("val", 2, None), ("train", 3, "x")], "split string, rec int, text string")
    writers.write_split_records(d, str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").glob("split=*")) == ["split=train", "split=val"]
    assert sorted(tuple(r) for r in spark.read.schema("rec int, text string").json(str(tmp_path / "s" / "split=train")).collect()) == [(1, "é"), (3, "x")]
    writers.write_metrics(spark.createDataFrame([("a", 0.12345, float("inf")), ("b", None, 2.0)], "k string, x double, y double").coalesce(1), str(tmp_path / "m"))
    lines = [x for p in (tmp_path / "m").glob("*.csv") for x in p.read_text().splitlines()]
    assert lines == ["k,x,y", "a,0.1235,", "b,,2.0000"]


@pytest.mark.parametrize("n", [1, 2, 9, 30_000])
def test_quantiles(spark, n):
    r = np.random.default_rng(n)
    rows = [("a", float(x)) for x in np.round(r.standard_normal(n), 2)] + [("b", float(x)) for x in r.exponential(size=max(1, n // 3))] + [(None, 1.0), ("c", None)]
    d = spark.createDataFrame(rows, "g string, x double")
    got = {row["g"]: row for row in metrics.quantiles(d, "x", ["g"], {"half": 0.5, "most": 0.95, "least": 0.0}).collect()}
    for g in ("a", "b", None):
        x = [v for k, v in rows if k == g and v is not None]
        assert [got[g]["half"], got[g]["most"], got[g]["least"]] == pytest.approx(np.percentile(x, [50, 95, 0]).tolist())
    whole = metrics.quantiles(d, "x", [], {"half": 0.5}).first()
    assert whole["half"] == pytest.approx(np.median([v for _, v in rows if v is not None]))


@pytest.mark.parametrize(("u", "t"), [(0, 5), (1, 1), (3, 0), (7, 1000), (123_456, 654_321), (1, 100_000)])
def test_harmonic_sums(spark, u, t):
    got = spark.range(1).select(metrics.harmonic_gap(F.lit(u), F.lit(t)).alias("x")).first()["x"]
    assert got == pytest.approx(sum(1 / (u + i) for i in range(1, t + 1)), rel=1e-12, abs=1e-13)


def test_numbers_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(annotations, "CUT_KEYS", 1)
    monkeypatch.setattr(annotations.range_cuts, "__defaults__", (7,))
    names = sorted({f"v{(i * 7919) % 100_003}" for i in range(3000)})
    d = spark.createDataFrame([(v, i % 5 + 1) for i, v in enumerate(names)], "vid string, n int").repartition(5)
    assert len(annotations.range_cuts(d.select("vid"), "vid")) >= 3
    before, total = {}, 0
    for i, v in enumerate(names):
        before[v], total = total, total + i % 5 + 1
    assert {r["vid"]: r["before"] for r in annotations.running_totals(d, "vid", "n").collect()} == before


def test_exact_split(spark):
    for n in (1, 2, 10, 777):
        d = spark.range(n).select(F.col("id").cast("string").alias("k"))
        sides = [{r["k"]: r["split"] for r in annotations.exact_split(d.repartition(p), ["k"], 0.9, 3, cells=16).collect()} for p in (1, 4)]
        assert sides[0] == sides[1] and sum(s == "train" for s in sides[0].values()) == max(1, int(n * 0.9))
