"""The volume source: layouts, axes, ranges, filters and files over what a task could hold."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.sources import volumes


class Counted(io.BytesIO):
    """A file that counts what is read."""

    total = 0

    def read(self, n=-1):
        data = super().read(n)
        self.total += len(data)
        return data


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("kind", ["<i2", ">f4", "|u1", "<f8"])
@pytest.mark.parametrize("lead", [False, True])
def test_slices_of_every_layout(order, kind, lead, monkeypatch):
    monkeypatch.setattr(volumes, "BLOCK_BYTES", 100)
    v = np.random.default_rng(2).integers(0, 99, (5, 4, 7)).astype(kind)
    raw = io.BytesIO()
    np.save(raw, np.asarray(v[None] if lead else v, order=order))
    for axis in range(3):
        file = Counted(raw.getvalue())
        layout = volumes.read_layout(file, "v")
        assert layout.count(axis) == v.shape[axis]
        wanted = [2, 0, 2, v.shape[axis] - 1]
        header, got = file.total, list(volumes.read_slices(file, layout, axis, wanted))
        for z, s in zip(wanted, got, strict=True):
            assert (s == np.moveaxis(v, axis, 0)[z]).all()
        read = file.total - header
        if layout.axis(axis) < 2:  # the slices' own bytes and no more
            assert read == len(wanted) * layout.slice_bytes(axis)
        else:
            assert read == v.nbytes


def test_broken_files():
    for array in (np.zeros((2, 3)), np.zeros((2, 2, 2, 2)), np.array([[[{}]]], dtype=object)):
        raw = io.BytesIO()
        np.save(raw, array, allow_pickle=True)
        with pytest.raises(ValueError):
            volumes.read_layout(io.BytesIO(raw.getvalue()), "v")
    raw = io.BytesIO()
    np.save(raw, np.zeros((3, 3, 3)))
    file = io.BytesIO(raw.getvalue()[:-8])
    with pytest.raises(ValueError, match="ends before"):
        list(volumes.read_slices(file, volumes.read_layout(file, "v"), 0, [2]))


@pytest.mark.parametrize("push", ["true", "false"])
def test_filters_choose_what_is_read(spark, tmp_path, monkeypatch, push):
    (tmp_path / "deep").mkdir()
    stacks = {}
    for name, depth in (("a.npy", 9), ("deep/b.npy", 3), ("c.txt", 2)):
        stacks[name] = np.random.default_rng(depth).integers(-500, 500, (depth, 4, 6)).astype("<i2")
        with open(tmp_path / name, "wb") as f:
            np.save(f, stacks[name])
    before = spark.conf.get(volumes.PUSHDOWN, None)
    spark.conf.set(volumes.PUSHDOWN, push)
    try:
        d = volumes.read_volumes(spark, str(tmp_path), axis="coronal", values="smallint")
        assert dict(d.dtypes)["pixels"] == "array<smallint>" and d.count() == 12
        some = d.filter((F.col("z") >= 1) & (F.col("z") < 6) & F.col("place").isin(1, 2, 5, 7) & (F.col("height") == 4))
        got = {(r["file"].split("/")[-1], r["z"]): np.array(r["pixels"]).reshape(r["height"], r["width"]) for r in some.collect()}
        assert set(got) == {("a.npy", 1), ("a.npy", 2), ("a.npy", 5), ("b.npy", 1), ("b.npy", 2)}
        assert all((p == stacks["a.npy" if f == "a.npy" else "deep/b.npy"][z]).all() for (f, z), p in got.items())
        if push == "true":
            plan = some._jdf.queryExecution().executedPlan().toString()
            assert "(z#" in plan.replace("isnotnull", "") and ">= 1" not in plan and " IN " not in plan
    finally:
        spark.conf.unset(volumes.PUSHDOWN) if before is None else spark.conf.set(volumes.PUSHDOWN, before)
    with pytest.raises(ValueError):
        volumes.read_volumes(spark, str(tmp_path), values="string")


def test_a_volume_of_three_gigabytes(spark, tmp_path):
    """No row, task or buffer could hold the file; one slice of it is read in a moment."""
    shape, path = (1500, 1000, 1000), tmp_path / "large.npy"
    with open(path, "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<i2", "fortran_order": False, "shape": shape})
        begin = f.tell()
        f.truncate(begin + 2 * 1500 * 1000 * 1000)  # sparse: no disk is used
        f.seek(begin + 2 * (1234 * 10**6 + 5 * 1000 + 7))
        f.write(np.array([321], "<i2").tobytes())
    reader = volumes.VolumeReader({"path": str(path), "axis": "coronal", "values": "smallint"})
    parts = reader.partitions()
    assert len(parts) == -(-1500 // (volumes.PART_BYTES // (2 * 10**6))) and max(len(p.places) for p in parts) * 2 * 10**6 <= volumes.PART_BYTES
    d = volumes.read_volumes(spark, str(path), axis="coronal", values="smallint", first=1234, last=1235)
    row = d.select("z", F.size("pixels").alias("n"), F.array_position("pixels", F.lit(321).cast("smallint")).alias("at")).first()
    assert tuple(row) == (1234, 10**6, 5008)


def test_written_volumes_read_back(spark, tmp_path):
    v = {"a": np.arange(60).reshape(3, 4, 5), "b": np.arange(60).reshape(5, 4, 3) - 9}
    rows = [(k, z, *x.shape, x[z].ravel().astype(float).tolist()) for k, x in v.items() for z in range(len(x))]
    d = spark.createDataFrame(rows[::-1], "file string, z int, depth int, height int, width int, pixels array<double>").repartition(3)
    assert sorted(tuple(r) for r in volumes.write_volumes(d, f"file://{tmp_path}/v", "int").collect()) == [("a", 3), ("b", 5)]
    assert all((np.load(tmp_path / "v" / f"{k}.npy") == x).all() for k, x in v.items())
    with pytest.raises(Exception, match="slice"):
        volumes.write_volumes(d.filter("z <> 1"), f"file://{tmp_path}/w", "int")
    assert not list((tmp_path / "w").glob("*.npy"))
