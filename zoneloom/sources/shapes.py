"""Polygon layers from shapefiles, read in ranges of records by way of their index."""

from __future__ import annotations

import fnmatch
import os
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format: bytes of the file header and of an index entry, types that hold polygons.
HEADER, ENTRY = 100, 8
POLYGON_TYPES = (5, 15, 25)

#: Bytes of geometry per task and per Arrow batch; one record is never divided.
TASK_BYTES, BATCH_BYTES = 32 << 20, 4 << 20

_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_POLYGONS = pa.list_(pa.list_(pa.list_(_POINT)))


class Records(InputPartition):
    """Records ``start`` to ``end`` (exclusive) of one file."""

    def __init__(self, path: str, layer: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.layer, self.start, self.end = path, layer, start, end


def layer_name(path: str) -> str:
    """The folder ``layer=...`` if there is one, else the file name without its ending."""
    named = [part.removeprefix("layer=") for part in path.split("/") if part.startswith("layer=")]
    return named[-1] if named else os.path.basename(path)[:-4]


def area(ring: np.ndarray) -> float:
    """Signed area, negative for clockwise rings; taken from the first point on, so that far-off rings keep digits."""
    x, y = (ring - ring[0]).T
    return float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1])) / 2


def inside(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Whether each point lies in the ring, by crossings of a ray."""
    (x0, y0), (x1, y1) = ring[:-1].T, ring[1:].T
    found = np.zeros(len(points), bool)
    for i, (x, y) in enumerate(points):
        over = (y0 > y) != (y1 > y)
        found[i] = np.count_nonzero(x < x0[over] + (y - y0[over]) * (x1[over] - x0[over]) / (y1[over] - y0[over])) % 2
    return found


def nested(rings: Sequence[np.ndarray]) -> list[list[np.ndarray]]:
    """Polygons of a record: a clockwise ring opens one, any other ring is a hole of the smallest that holds most of it.

    A hole that no ring holds is a polygon of its own.
    """
    areas = [area(ring) for ring in rings]
    outer = [i for i, a in enumerate(areas) if a < 0]
    polygons = {i: [rings[i]] for i in outer}
    boxes = {i: (rings[i].min(0), rings[i].max(0)) for i in outer}
    outer.sort(key=lambda i: -areas[i])
    for i, ring in enumerate(rings):
        if i in boxes:
            continue
        low, high = ring.min(0), ring.max(0)
        around = [o for o in outer if (boxes[o][0] <= low).all() and (boxes[o][1] >= high).all()]
        if len(outer) > 1:
            around = [o for o in around if 2 * inside(ring[:-1], rings[o]).sum() > len(ring) - 1][:1]
        if around:
            polygons[around[0]].append(ring)
        else:
            polygons[i] = [ring]
    return [polygons[i] for i in sorted(polygons)]


def rings_of(content: bytes) -> list[np.ndarray] | None:
    """Rings of a polygon record, heights and measures left out; None for other types."""
    if len(content) < 4 or struct.unpack_from("<i", content)[0] not in POLYGON_TYPES:
        return None
    n_rings, n_points = struct.unpack_from("<2i", content, 36)
    starts = np.frombuffer(content, "<i4", n_rings, 44)
    points = np.frombuffer(content, "<f8", 2 * n_points, 44 + 4 * n_rings).reshape(-1, 2)
    return [ring for ring in np.split(points, starts[1:]) if len(ring)]


def lists(sizes: Sequence[int], values: pa.Array, null: Sequence[bool] | None = None) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=None if null is None else pa.array(null, pa.bool_()))


def polygon_array(records: Sequence[bytes]) -> pa.Array:
    """Records as an Arrow array of polygons, rings and points."""
    rows = [rings_of(content) for content in records]
    polygons = [nested(rings) if rings else [] for rings in rows]
    rings = [ring for row in polygons for polygon in row for ring in polygon]
    points = np.concatenate([np.empty((0, 2)), *rings])
    flat = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], fields=list(_POINT))
    by_ring = lists([len(ring) for ring in rings], flat)
    by_polygon = lists([len(polygon) for row in polygons for polygon in row], by_ring)
    return lists([len(row) for row in polygons], by_polygon, [rings is None for rings in rows]).cast(_POLYGONS)


class Attributes:
    """The attribute file beside a shapefile: fixed-width text, so any range of rows is one read."""

    def __init__(self, files: fs.FileSystem, stem: str, wanted: Sequence[str], encoding: str | None):
        self.file = files.open_input_file(stem + ".dbf")
        self.rows, self.head, self.width = struct.unpack("<IHH", self.file.read_at(12, 0)[4:])
        fields, at = {}, 1  # the first byte of a row marks it deleted
        head = self.file.read_at(self.head - 32, 32)
        for i in range(0, len(head) - 31, 32):
            if head[i] == 0x0D:
                break
            size = head[i + 16]
            fields[head[i:i + 11].split(b"\0")[0].decode("latin-1").strip().lower()] = (at, at + size)
            at += size
        missing = [name for name in wanted if name.lower() not in fields]
        if missing:
            raise ValueError(f"no attribute {', '.join(missing)} in {stem}.dbf")
        self.spans = [fields[name.lower()] for name in wanted]
        self.encoding = encoding or self._declared(files, stem)

    @staticmethod
    def _declared(files: fs.FileSystem, stem: str) -> str:
        """The encoding that a ``.cpg`` file names, Latin-1 without one."""
        if files.get_file_info(stem + ".cpg").type != fs.FileType.File:
            return "latin-1"
        with files.open_input_file(stem + ".cpg") as file:
            name = file.read().decode("ascii", "ignore").strip()
        return {"ANSI 1252": "cp1252"}.get(name, f"cp{name}" if name.isdigit() and len(name) < 5 else name) or "latin-1"

    def read(self, start: int, end: int) -> tuple[np.ndarray, list[list[str]]]:
        """Which of the rows are kept, and each wanted column as text."""
        raw = self.file.read_at((end - start) * self.width, self.head + start * self.width)
        rows = [raw[i:i + self.width] for i in range(0, len(raw), self.width)]
        return np.array([row[:1] != b"*" for row in rows], bool), [
            [row[a:b].decode(self.encoding).strip(" \0") for row in rows] for a, b in self.spans
        ]


class ShapeReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.wanted = [f.name for f in schema.fields[1:-1]]
        self.path, self.pattern = options["path"], options.get("pattern", "*.shp")
        self.encoding, self.task_bytes = options.get("encoding"), int(options.get("taskbytes", TASK_BYTES))

    def partitions(self) -> Sequence[Records]:
        """Ranges of about equally many records; the driver reads file sizes only."""
        files, root = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        inner = [found] if found.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
        parts = []
        for info in sorted((i for i in inner if i.is_file and fnmatch.fnmatch(i.base_name, self.pattern)), key=lambda i: i.path):
            index = files.get_file_info(info.path[:-4] + ".shx")
            if not index.is_file:
                raise FileNotFoundError(f"{info.path} has no index (.shx)")
            rows = (index.size - HEADER) // ENTRY
            step = max(1, rows * self.task_bytes // max(info.size, 1))
            parts += [Records(info.path, layer_name(info.path), i, min(i + step, rows)) for i in range(0, rows, step)]
        return parts or [Records("", "", 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.end:
            return
        files, _ = fs.FileSystem.from_uri(self.path)
        stem = partition.path[:-4]
        attributes = Attributes(files, stem, self.wanted, self.encoding)
        with files.open_input_file(stem + ".shx") as file:
            if attributes.rows != (file.size() - HEADER) // ENTRY:
                raise ValueError(f"{stem}: the index and the attributes count different rows")
            raw = file.read_at((partition.end - partition.start) * ENTRY, HEADER + partition.start * ENTRY)
        offsets, sizes = 2 * np.frombuffer(raw, ">i4").astype(np.int64).reshape(-1, 2).T  # counted in 16-bit words
        batch = np.cumsum(sizes) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(batch)) + 1), len(sizes)]
        with files.open_input_file(partition.path) as file:
            for a, b in zip(cuts[:-1], cuts[1:]):
                keep, texts = attributes.read(partition.start + int(a), partition.start + int(b))
                polygons = polygon_array(self.contents(file, offsets[a:b] + 8, sizes[a:b]))
                columns = [pa.array([partition.layer] * len(keep), pa.string()), *[pa.array(t, pa.string()) for t in texts], polygons]
                yield pa.RecordBatch.from_arrays(columns, ["layer", *self.wanted, "polygons"]).filter(pa.array(keep))

    @staticmethod
    def contents(file: pa.NativeFile, offsets: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Records in one read if they lie together, else one by one."""
        low, high = int(offsets.min()), int((offsets + sizes).max())
        if high - low > 2 * (int(sizes.sum()) + ENTRY * len(sizes)):
            return [file.read_at(int(n), int(o)) for o, n in zip(offsets, sizes)]
        raw = file.read_at(high - low, low)
        return [raw[o - low:o - low + n] for o, n in zip(offsets.tolist(), sizes.tolist())]


class ShapeSource(DataSource):
    """``spark.read.format("zoneloom_shapes")``: layer, attributes as text, polygons."""

    @classmethod
    def name(cls) -> str:
        return "zoneloom_shapes"

    def reader(self, schema: T.StructType) -> ShapeReader:
        return ShapeReader(schema, dict(self.options))


def scan_shapes(
    spark: SparkSession, path: str, properties: str, pattern: str = "*.shp", encoding: str | None = None, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """All shapefiles below a folder, as ``scan_layers`` gives them: ``(layer, properties..., polygons)``.

    ``properties`` declares the attributes to read, e.g. ``"grade string"``; every file must have them. Large files are
    read by several tasks, each its range of records (``.shx``), geometry (``.shp``) and attributes (``.dbf``). Blank
    values and numbers that did not fit their column (``***``) are null, rows marked deleted are left out, and records
    without a polygon have null polygons. A value that its declared type cannot hold is an error.
    """
    declared = T.StructType.fromDDL(properties)
    clash = {f.name.lower() for f in declared} & {"layer", "polygons"}
    if clash:
        raise ValueError(f"attributes named {', '.join(sorted(clash))} clash with the layer's own columns")
    spark.dataSource.register(ShapeSource)
    point = "struct<x: double, y: double>"
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in declared])
    schema = T.StructType([T.StructField("layer", T.StringType()), *texts, *T.StructType.fromDDL(f"polygons array<array<array<{point}>>>")])
    source = spark.read.format("zoneloom_shapes").schema(schema).option("pattern", pattern).option("taskbytes", str(task_bytes))
    raw = (source.option("encoding", encoding) if encoding else source).load(path)

    def typed(field: T.StructField):
        text = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            return F.nullif(text, F.lit("")).alias(field.name)
        value = F.when(~text.rlike(r"^(\**|\?|0{8})$") if isinstance(field.dataType, T.DateType) else ~text.rlike(r"^(\**|\?)$"), text)
        return (F.to_date(value, "yyyyMMdd") if isinstance(field.dataType, T.DateType) else value.cast(field.dataType)).alias(field.name)

    return raw.select("layer", *[typed(f) for f in declared], "polygons")
