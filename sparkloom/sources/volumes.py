"""Volumes in .npy files as a Python data source that reads no more than the slices asked for.

Partitions are planned from the files' headers: each is some slices of one
file, bounded by their bytes.  A task seeks to its slices; of a file of any
size it holds its own slices alone.  Conditions on z, place and file reach
the source where the session allows it (spark.sql.python.filterPushdown.enabled).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .readers import AXES, slice_places, windowed

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

#: Bytes of slices in one partition, and of a file that is read at once where slices do not lie together.
PART_BYTES, BLOCK_BYTES = 64 << 20, 8 << 20

#: Element types of pixels by Spark's names.
VALUES = {"double": np.float64, "float": np.float32, "bigint": np.int64, "int": np.int32, "smallint": np.int16, "tinyint": np.int8}


@dataclass(frozen=True)
class Layout:
    """Where a file's array lies, as three C-ordered axes of the disk; a Fortran array's axes stand in reverse."""

    offset: int
    shape: tuple[int, int, int]
    kind: str
    reverse: bool

    def axis(self, axis: int) -> int:
        return 2 - axis if self.reverse else axis

    def count(self, axis: int) -> int:
        return self.shape[self.axis(axis)]

    def slice_bytes(self, axis: int) -> int:
        return int(np.prod(self.shape, dtype=np.int64)) // max(self.count(axis), 1) * np.dtype(self.kind).itemsize


def read_layout(file: BinaryIO, name: str) -> Layout:
    """The layout from a file's header."""
    version = np.lib.format.read_magic(file)
    header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = header(file)
    if kind.hasobject:
        raise ValueError(f"{name} holds objects")
    if len(shape) == 4 and shape[0] == 1:
        shape = shape[1:]
    if len(shape) != 3:
        raise ValueError(f"{name} has {len(shape)} dimensions")
    return Layout(file.tell(), tuple(shape[::-1] if fortran else shape), kind.str, fortran)


def read_slices(file: BinaryIO, layout: Layout, axis: int, places: list[int]) -> Iterator[np.ndarray]:
    """Slices along an axis of the array.

    Slices of the outermost axis of the disk are one stretch of bytes each,
    those of the middle one a stretch for each outer place.  Slices of the
    innermost axis lie strewn over the whole file, which is then passed
    through once in blocks for all of them.
    """
    (a, b, c), kind, k = layout.shape, np.dtype(layout.kind), layout.axis(axis)

    def part(first: int, n: int) -> np.ndarray:
        file.seek(layout.offset + first * kind.itemsize)
        data = file.read(n * kind.itemsize)
        if len(data) != n * kind.itemsize:
            raise ValueError("the file ends before its array")
        return np.frombuffer(data, kind)

    turn = (lambda x: x.T) if layout.reverse else (lambda x: x)
    if k == 0:
        for z in places:
            yield turn(part(z * b * c, b * c).reshape(b, c))
    elif k == 1:
        for z in places:
            yield turn(np.stack([part((i * b + z) * c, c) for i in range(a)]) if a else np.zeros((0, c), kind))
    else:
        wanted, back = np.unique(places, return_inverse=True)
        out = np.empty((len(wanted), a, b), kind)
        step = max(1, BLOCK_BYTES // max(b * c * kind.itemsize, 1))
        for i in range(0, a, step):
            rows = min(step, a - i)
            out[:, i : i + rows] = np.moveaxis(part(i * b * c, rows * b * c).reshape(rows, b, c)[:, :, wanted], 2, 0)
        for i in back:
            yield turn(out[i])


@dataclass
class SlicePart(InputPartition):
    file: str
    layout: Layout
    places: list[tuple[int, int]]  # number among the slices read, number in the volume


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(path: str, pattern: str) -> list[str]:
    """Files under a path, or the path itself, by name."""
    files, place = _open(path)
    if files.get_file_info(place).type == fs.FileType.File:
        return [path]
    found = [x.path for x in files.get_file_info(fs.FileSelector(place, recursive=True)) if x.type == fs.FileType.File and fnmatchcase(x.base_name, pattern)]
    return sorted(path.rstrip("/") + x[len(place.rstrip("/")) :] for x in found)


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        o = {k.lower(): v for k, v in options.items()}
        number = lambda k, kind=int: kind(o[k]) if o.get(k) not in (None, "") else None
        self.path, self.pattern, self.axis = o["path"], o.get("pattern", "*.npy"), AXES[o.get("axis", "axial")]
        self.level, self.width = number("level", float), number("width", float)
        self.sampling = (number("n"), number("first") or 0, number("last"), o.get("sampling", "uniform"), number("seed") or 0)
        self.normalize, self.values = o.get("normalize", "true").lower() == "true", o.get("values", "double")
        self.tests: list[Filter] = []

    def _wanted(self, file: str, place: int, z: int) -> bool:
        """Whether the filters that were pushed down let a slice through."""
        own = {"file": file, "place": place, "z": z}
        tests = {EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v}
        return all(tests[type(t)](own[t.attribute[0]], t.value) for t in self.tests)

    def partitions(self) -> list[SlicePart]:
        parts = []
        for path in _listed(self.path, self.pattern):
            files, place = _open(path)
            with files.open_input_file(place) as file:
                layout = read_layout(file, path)
            slices = [(i, z) for i, z in enumerate(slice_places(layout.count(self.axis), *self.sampling)) if self._wanted(path, i, z)]
            each = max(1, PART_BYTES // max(layout.slice_bytes(self.axis), 1))
            parts += [SlicePart(path, layout, slices[i : i + each]) for i in range(0, len(slices), each)]
        return parts

    def read(self, part: SlicePart) -> Iterator[pa.RecordBatch]:
        files, place = _open(part.file)
        with files.open_input_file(place) as file:
            stack = read_slices(file, part.layout, self.axis, [z for _, z in part.places])
            for (i, z), s in zip(part.places, stack, strict=True):
                if self.level is not None and self.width is not None:
                    s = windowed(s, self.level, self.width, self.normalize)
                flat = pa.array(np.ascontiguousarray(s).ravel().astype(VALUES[self.values]))
                pixels = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
                columns = [pa.array([part.file]), *(pa.array([x], pa.int32()) for x in (i, z, *s.shape)), pixels]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "place", "z", "height", "width", "pixels"])


class FilteredVolumeReader(VolumeReader):
    """The same, taking over conditions on slices."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In) and f.attribute in (("z",), ("place",), ("file",)):
                self.tests.append(f)
            else:
                yield f


class VolumeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_volumes"

    def schema(self) -> str:
        return f"file string, place int, z int, height int, width int, pixels array<{self.options.get('values', 'double')}>"

    def reader(self, schema) -> VolumeReader:
        return (FilteredVolumeReader if self.options.get("pushdown") == "true" else VolumeReader)(dict(self.options))


def read_volumes(
    spark: SparkSession, path: str, level: float | None = None, width: float | None = None, axis: str = "axial", n: int | None = None, first: int = 0, last: int | None = None,
    sampling: str = "uniform", normalize: bool = True, seed: int = 42, values: str = "double", pattern: str = "*.npy",
) -> DataFrame:
    """(file, place, z, height, width, pixels): slices of .npy volumes along an axis.

    place counts the slices that are read, z is a slice's number in the
    volume.  Volumes are three-dimensional, or have a leading dimension of 1,
    and may be of any size; a task reads some slices of one file.  With level
    and width the values are cut to the window and scaled to 0..255.  values
    is the pixels' type.  Filters on z, place and file choose what is read
    where `PUSHDOWN` is on in the session.
    """
    if width is not None and width <= 0:
        raise ValueError("the window's width is over 0")
    if values not in VALUES:
        raise ValueError(f"values is one of {', '.join(VALUES)}")
    spark.dataSource.register(VolumeSource)
    options = {"level": level, "width": width, "axis": axis, "n": n, "first": first, "last": last, "sampling": sampling, "normalize": str(normalize).lower(), "seed": seed, "values": values, "pattern": pattern}
    options["pushdown"] = spark.conf.get(PUSHDOWN, "false")
    return spark.read.format("npy_volumes").options(**{k: str(v) for k, v in options.items() if v is not None}).load(path)


def write_volumes(slices: DataFrame, path: str, values: str = "double") -> DataFrame:
    """Volumes as .npy files, one for each file of slices (file, z, depth, height, width, pixels); returns (file, slices).

    Slices lie along the first axis, z counts from 0 to depth - 1.  A file's
    slices are sorted and written one after the other, so a task holds a few
    of them.  A file that lacks a slice or has one twice is an error.
    """
    kind = np.dtype(VALUES[values]).str
    schema = "file string, slices bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(path.rstrip("/"))
        files.create_dir(root)
        name, out, at, shape = None, None, 0, None

        def closed() -> pa.RecordBatch:
            out.close()
            if at != shape[0]:
                raise ValueError(f"{name} has {at} of {shape[0]} slices")
            files.move(f"{root}/.{name}", f"{root}/{name}.npy")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64())], names=["file", "slices"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("file", "z", "depth", "height", "width")), batch.column("pixels"), strict=True):
                file, z, *size, pixels = row
                if file != name:
                    if name is not None:
                        yield closed()
                    name, at, shape = file, 0, tuple(size)
                    out = files.open_output_stream(f"{root}/.{name}")
                    np.lib.format.write_array_header_1_0(out, {"descr": kind, "fortran_order": False, "shape": shape})
                if z != at or tuple(size) != shape:
                    raise ValueError(f"{name}: slice {z} stands where {at} should")
                out.write(np.asarray(pixels.values.to_numpy(zero_copy_only=False), kind).tobytes())
                at += 1
        if name is not None:
            yield closed()

    d = slices.select("file", "z", "depth", "height", "width", "pixels").repartition("file").sortWithinPartitions("file", "z").mapInArrow(run, schema)
    return slices.sparkSession.createDataFrame(d.collect(), schema)  # a row for each file
