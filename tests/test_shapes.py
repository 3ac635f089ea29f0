"""Shapefiles written byte by byte, read in ranges, held against the same layers as GeoJSON."""

from __future__ import annotations

import datetime
import json
import struct

import pytest
from pyspark.sql import functions as F

from zoneloom.operators.edges import polygon_edges
from zoneloom.sources.layers import scan_layers
from zoneloom.sources.shapes import scan_shapes

SQUARE = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)]  # clockwise
HOLE = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
FAR = [(10, 10), (10, 20), (20, 20), (20, 10), (10, 10)]
FAR_HOLE = [(10, 10), (15, 12), (12, 15), (10, 10)]  # touches its ring in a corner
FIELDS = [("GRADE", "C", 6), ("SIZE", "N", 8), ("DAY", "D", 8)]


def record(rings, kind=5):
    if rings is None:
        return struct.pack("<i", 0)
    points = [p for ring in rings for p in ring]
    xs, ys = zip(*points)
    starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
    body = struct.pack("<i4d2i", kind, min(xs), min(ys), max(xs), max(ys), len(rings), len(points))
    body += struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
    return body + (struct.pack(f"<{2 + len(points)}d", *[0] * (2 + len(points))) if kind == 15 else b"")


def write(stem, rows, deleted=(), kind=5, encoding="latin-1"):
    """Rows are ``(texts, rings)``."""
    shp, shx = b"", b""
    for i, (_, rings) in enumerate(rows):
        body = record(rings, kind)
        shx += struct.pack(">2i", (100 + len(shp)) // 2, len(body) // 2)
        shp += struct.pack(">2i", i + 1, len(body) // 2) + body
    for ending, content in [(".shp", shp), (".shx", shx)]:
        head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(content)) // 2) + struct.pack("<2i8d", 1000, kind, *[0] * 8)
        stem.with_suffix(ending).write_bytes(head + content)
    width = 1 + sum(n for *_, n in FIELDS)
    head = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + 32 * len(FIELDS), width)
    head += b"".join(struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), size, 0) for name, kind, size in FIELDS) + b"\r"
    lines = b"".join(
        (b"*" if i in deleted else b" ") + b"".join(t.encode(encoding).ljust(n) for t, (*_, n) in zip(texts, FIELDS))
        for i, (texts, _) in enumerate(rows)
    )
    stem.with_suffix(".dbf").write_bytes(head + lines)


def test_shapes_equal_the_same_layers_as_geojson(spark, tmp_path):
    rows = [((f"G{i}", str(i), "20240102"), [[(x + 7 * i, y) for x, y in ring] for ring in (SQUARE, HOLE)]) for i in range(40)]
    (tmp_path / "a").mkdir()
    write(tmp_path / "a" / "north.shp", rows)
    write(tmp_path / "a" / "south.shp", rows[:3], kind=15)
    (tmp_path / "b").mkdir()
    for name, part in (("north", rows), ("south", rows[:3])):
        (tmp_path / "b" / f"{name}.geojson").write_text("\n".join(json.dumps({
            "type": "Feature", "properties": {"grade": texts[0]}, "geometry": {"type": "Polygon", "coordinates": rings},
        }) for texts, rings in part))
    shapes = scan_shapes(spark, str(tmp_path / "a"), "grade string", task_bytes=1500)
    assert shapes.select(F.spark_partition_id()).distinct().count() > 4
    want = scan_layers(spark, str(tmp_path / "b"), "grade string")
    assert sorted(map(tuple, polygon_edges(shapes, ["layer", "grade"], "polygons").collect())) == sorted(
        map(tuple, polygon_edges(want, ["layer", "grade"], "polygons").collect())
    )


def test_holes_go_to_the_ring_around_them(spark, tmp_path):
    inner = [(0.5, 0.5), (0.5, 0.7), (0.7, 0.7), (0.5, 0.5)]
    write(tmp_path / "l.shp", [(("A", "1", ""), [HOLE, FAR_HOLE, SQUARE, FAR]), (("B", "1", ""), [inner[::-1]])])
    found = [[[[tuple(p) for p in ring] for ring in polygon] for polygon in r.polygons] for r in
             scan_shapes(spark, str(tmp_path), "grade string").orderBy("grade").collect()]
    assert found[0] == [[SQUARE, HOLE], [FAR, FAR_HOLE]]
    assert found[1] == [[inner[::-1]]]  # no ring around it: a polygon of its own


def test_values_of_attributes(spark, tmp_path):
    rows = [(("é", "12", "20240102"), [SQUARE]), (("", "", ""), None), (("gone", "1", ""), [SQUARE]), (("B", "****", "00000000"), [SQUARE])]
    write(tmp_path / "l.shp", rows, deleted=[2])
    got = scan_shapes(spark, str(tmp_path), "Size bigint, grade string, day date").collect()
    assert [(r.layer, r.Size, r.grade, r.day, r.polygons is None) for r in got] == [
        ("l", 12, "é", datetime.date(2024, 1, 2), False), ("l", None, None, None, True), ("l", None, "B", None, False),
    ]
    write(tmp_path / "l.shp", rows[:1], encoding="utf-8")
    (tmp_path / "l.cpg").write_text("UTF-8")
    assert scan_shapes(spark, str(tmp_path / "l.shp"), "grade string").first().grade == "é"


def test_wrong_layers_are_errors_and_empty_ones_are_empty(spark, tmp_path):
    assert scan_shapes(spark, str(tmp_path), "grade string").count() == 0
    write(tmp_path / "l.shp", [])
    assert scan_shapes(spark, str(tmp_path), "grade string").count() == 0
    write(tmp_path / "l.shp", [(("A", "x", ""), [SQUARE])])
    with pytest.raises(Exception, match="no attribute other"):
        scan_shapes(spark, str(tmp_path), "other string").collect()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        scan_shapes(spark, str(tmp_path), "size bigint").collect()
    with pytest.raises(ValueError, match="clash"):
        scan_shapes(spark, str(tmp_path), "Layer string")
    (tmp_path / "l.shx").write_bytes((tmp_path / "l.shx").read_bytes() + bytes(8))
    with pytest.raises(Exception, match="different rows"):
        scan_shapes(spark, str(tmp_path), "grade string").collect()
