"""Boundaries of shared, united and repaired polygons against areas, point tests and closed forms."""

import math
import random

import shapes
from pyspark.sql import functions as F

from zoneloom.functions import projection
from zoneloom.operators import boundary, edges as E
from zoneloom.operators.boundary import dissolve_edges, fragment_edges, repair_edges
from zoneloom.operators.locate import points_in_polygons
from zoneloom.operators.overlay import overlay_area
from zoneloom.operators.shape import nest_counted


def star(rng, size, radius, n):
    cx, cy = rng.random() * size, rng.random() * size
    turns = sorted(rng.random() * 2 * math.pi for _ in range(n))
    return [(cx + radius * (0.4 + 0.6 * rng.random()) * math.cos(t), cy + radius * (0.4 + 0.6 * rng.random()) * math.sin(t)) for t in turns]


def odd(edges, x, y):
    return sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for a, b, c, d in edges) % 2 == 1


def by_key(table, key):
    found = {}
    for r in table.collect():
        found.setdefault(r[key], []).append((r.x1, r.y1, r.x2, r.y2))
    return found


def closes(table, keys):
    """Every edge ends where the next of its ring starts, and numbers run from 1."""
    rings = {}
    for r in table.collect():
        rings.setdefault((*[r[k] for k in keys], r.ring_no), []).append((r.edge_no, r.x1, r.y1, r.x2, r.y2))
    for ring in map(sorted, rings.values()):
        assert [e[0] for e in ring] == list(range(1, len(ring) + 1))
        assert all(a[3:] == b[1:3] for a, b in zip(ring, ring[1:] + ring[:1]))
    return rings


def test_shared_outlines_have_the_shared_area(spark):
    rng = random.Random(5)
    zones = shapes.edges(spark, [("c", i, [[star(rng, 10, 3, 9)]]) for i in range(6)] + [("c", 50, [[shapes.box(0, 0, 4, 4), shapes.box(1, 1, 2, 2)]]), ("d", 1, [[shapes.box(0, 0, 1, 1)]])], "zone")
    areas = shapes.edges(spark, [("c", i, [[star(rng, 10, 2, 7)]]) for i in range(8)] + [
        ("c", 60, [[shapes.box(0, 0, 3, 3)]]), ("c", 61, [[shapes.box(1.2, 1.2, 1.8, 1.8)]]), ("c", 62, [[shapes.box(3, 0, 5, 3)]]),
        ("c", 63, [[shapes.box(0.5, 0.5, 2.5, 2.5)]]), ("d", 1, [[shapes.box(1, 0, 2, 1)]])], "plot")
    found = fragment_edges(zones, areas, ["city"], "zone", "plot").cache()
    keys = ["city", "zone", "plot"]
    got = {(r.zone, r.plot): r.area for r in E.polygon_area(found, keys).collect()}
    want = {(r.zone, r.plot): r.area for r in overlay_area(zones, areas, ["city"], "zone", "plot").collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    closes(found, keys)
    # Boxes around the zone's hole keep it; the box inside the hole and the neighbour that only touches share nothing.
    assert {(r.zone, r.plot) for r in found.filter("hole").collect()} == {(50, 60), (50, 63)} and (50, 61) not in got
    assert found.filter("zone = 50 and plot = 62").count() == 4 and found.filter("city = 'd'").count() == 0


def test_union_holds_what_its_polygons_hold(spark):
    rng = random.Random(6)
    rows = [("c", i, [[star(rng, 8, 2, 7)]]) for i in range(9)] + [("c", 60, [[shapes.box(0, 0, 3, 3)]]), ("c", 62, [[shapes.box(3, 0, 5, 3)]]), ("c", 63, [[shapes.box(0, 0, 3, 3)]])]
    # A ring of four boxes around a gap, some of whose sides are shared in part only.
    rows += [("ring", i, [[b]]) for i, b in enumerate([shapes.box(0, 0, 3, 1), shapes.box(0, 1, 1, 3), shapes.box(1, 2, 3, 3), shapes.box(2, 1, 3, 2)])]
    parts = shapes.edges(spark, rows, "plot")
    found = dissolve_edges(parts, ["city"], "plot").cache()
    closes(found, ["city"])
    outline, polygons = by_key(found.filter("city = 'c'"), "city")["c"], by_key(parts.filter("city = 'c'"), "plot")
    for _ in range(1500):
        x, y = rng.random() * 12 - 2, rng.random() * 12 - 2
        assert odd(outline, x, y) == any(odd(p, x, y) for p in polygons.values())
    ring = found.filter("city = 'ring'")
    assert E.polygon_area(ring, ["city"]).first().area == 8 and E.polygon_area(ring.filter("hole"), ["city"]).first().area == -1


def test_repaired_rings_hold_what_an_odd_number_of_rings_holds(spark):
    rng = random.Random(7)
    rows = [("c", i, [[[(rng.random() * 10, rng.random() * 10) for _ in range(8)]]]) for i in range(5)]
    rows += [("c", 100, [[[(0, 0), (2, 2), (2, 0), (0, 2)]]]), ("c", 101, [[shapes.box(0, 0, 4, 4)], [shapes.box(1, 1, 2, 2)]]), ("c", 102, [[shapes.box(0, 0, 1, 1)], [shapes.box(0, 0, 1, 1)]])]
    raw = E.polygon_edges(shapes.features(spark, rows), ["city", "id"], "polygons")
    found = repair_edges(raw, ["city", "id"]).cache()
    closes(found, ["city", "id"])
    before, after = by_key(raw, "id"), by_key(found, "id")
    for _ in range(800):
        x, y = rng.random() * 10, rng.random() * 10
        assert all(odd(before[k], x, y) == odd(after.get(k, []), x, y) for k in before)
    area = {r.id: r.area for r in E.polygon_area(found, ["city", "id"]).collect()}
    assert area[100] == 2 and area[101] == 15 and 102 not in area and all(a > 0 for a in area.values())


def test_small_groups_are_read_once(spark, monkeypatch):
    """Edges meet in one join, parts are not listed again to count what is distinct, and rings take no rounds of rewriting."""
    written, cut = [], boundary.cut_lineage
    monkeypatch.setattr(boundary, "cut_lineage", lambda df: written.append(df) or cut(df))
    rows = [("c", 4 * g + i, [[shapes.box(3 * g + i, 0, 3 * g + i + 1, 1)]]) for g in range(20) for i in range(2)]
    parts = shapes.edges(spark, rows, "plot").withColumn("g", F.expr("plot div 4"))
    found = dissolve_edges(parts, ["city", "g"], "plot")
    assert found.count() == 20 * 6
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in written]
    cutting = [plan for plan in plans if "lead(" in plan]
    assert [plan.count("Join Inner") for plan in cutting] == [1] and "Expand" not in cutting[0]
    assert sum(df.count() for df in written) <= 3 * 20 * 8


def test_small_and_large_groups_alike(spark, monkeypatch):
    """Groups linked within a row and groups linked by joins give the same rings, also together."""
    rng = random.Random(11)
    rows = [(c, i, [[star(rng, 6, 2, 5 + 4 * (c == "d"))]]) for c in "cd" for i in range(7)]
    rows += [("d", 60, [[shapes.box(0, 0, 3, 3), shapes.box(1, 1, 2, 2)]]), ("d", 61, [[shapes.box(3, 0, 5, 3)]]), ("c", 62, [[shapes.box(0, 0, 1, 1)]]), ("c", 63, [[shapes.box(1, 1, 2, 2)]])]
    polygons = shapes.edges(spark, rows, "plot")
    zones = polygons.filter("plot % 2 = 0").withColumnRenamed("plot", "zone")

    def outlines():
        found = (dissolve_edges(polygons, ["city"], "plot"), repair_edges(polygons, ["city"]), fragment_edges(zones, polygons, ["city"], "zone", "plot"))
        return [sorted(map(tuple, table.drop("ring_no").collect())) for table in found]

    want = outlines()
    assert all(want)
    monkeypatch.setattr(boundary, "SMALL", 12)
    assert outlines() == want


def test_no_polygons(spark):
    none = shapes.edges(spark, [("c", 1, [[shapes.box(0, 0, 1, 1)]])], "zone").filter("false")
    other = none.withColumnRenamed("zone", "plot")
    assert fragment_edges(none, other, ["city"], "zone", "plot").count() == dissolve_edges(none, ["city"], "zone").count() == repair_edges(none, ["city", "zone"]).count() == 0


def test_albers_and_back(spark):
    rng = random.Random(8)
    points = spark.createDataFrame([(rng.uniform(-125, -66), rng.uniform(24, 50)) for _ in range(500)], "lon double, lat double")
    there = projection.project_points(points, projection.albers)
    lon, lat = projection.albers_inverse(F.col("x"), F.col("y"))
    worst = there.select(F.max(F.abs(lon - F.col("lon"))).alias("a"), F.max(F.abs(lat - F.col("lat"))).alias("b")).first()
    assert worst.a < 1e-9 and worst.b < 1e-9


def test_points_on_projected_slanted_edges(spark):
    """A point in the middle of a slanted edge is held, whatever rounding does to its projected coordinates."""
    rng = random.Random(9)
    rows, points = [], []
    for i in range(200):
        x, y = rng.uniform(-1e6, 1e6), rng.uniform(-1e6, 1e6)
        a, b, c = ((x + rng.uniform(-900, 900), y + rng.uniform(-900, 900)) for _ in range(3))
        t = rng.random()
        rows.append(("c", i, [[[a, b, c]]]))
        points.append(("c", i, a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
    held = points_in_polygons(spark.createDataFrame(points, "city string, p bigint, x double, y double"), shapes.edges(spark, rows), ["city"], "p", "id")
    assert held.filter("p = id").count() == 200


def test_nested_by_rank(spark):
    rows = [("a", None, i) for i in range(500)] + [("a", f"t{i % 7}", i) for i in range(200)] + [(None, "x", 1)]
    nested = nest_counted(spark.createDataFrame(rows, "k string, id string, v int").repartition(3), ["k"], "id", "members", block=64).collect()
    assert max(len(r.members) for r in nested) == 64 and len(nested) == 12
    flat = [(r.k, m.id, m.v) for r in sorted(nested, key=lambda r: (r.k is not None, r.block)) for m in r.members]
    assert sorted(flat, key=str) == sorted(rows, key=str)
    ids = [m for k, m, _ in flat if k == "a"]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or ""))
