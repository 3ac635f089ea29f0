import math
import random

import pytest
from pyspark.sql import functions as F

from tests.shapes import box, clip_area, edges, features, holds, ring_area
from zoneloom.operators.edges import layer_bbox, nonempty_features, normalize_rings, polygon_area, polygon_edges
from zoneloom.operators.grid import candidate_pairs, outlines
from zoneloom.operators.locate import points_in_fragments, points_in_polygons
from zoneloom.operators.overlay import overlay_area

ON = ["city"]


def overlap(left, right, **kwargs):
    rows = overlay_area(left, right, ON, "z", "a", **kwargs).collect()
    found = {(r.city, r.z, r.a): r.area for r in rows}
    assert len(found) == len(rows)
    return found


L_SHAPE = [(0, 0), (0, 4), (2, 4), (2, 2), (4, 2), (4, 0)]
FRAME = [box(0, 0, 4, 4), box(1, 1, 3, 3)]


def test_overlay_by_hand(spark):
    zones = edges(spark, [
        ("x", 1, [[L_SHAPE]]), ("x", 2, [FRAME]), ("x", 3, [[box(0, 0, 1, 1)], [box(5, 5, 7, 7)]]),
        ("y", 1, [[box(0, 0, 10, 10)]]),
    ], "z")
    areas = edges(spark, [
        ("x", 1, [[box(1, 1, 3, 3)]]), ("x", 2, [[[(0, 0), (4, 4), (4, 0)]]]), ("x", 3, [[box(4, 0, 6, 6)]]),
        ("y", 1, [[box(9, 9, 12, 12)]]), ("w", 9, [[box(0, 0, 1, 1)]]),
    ], "a")
    got = overlap(zones, areas)
    want = {
        ("x", 1, 1): 3.0, ("x", 1, 2): 6.0, ("x", 2, 2): 6.0, ("x", 3, 2): 0.5, ("x", 3, 3): 1.0, ("y", 1, 1): 1.0,
    }
    assert got.keys() == want.keys()
    for key, area in want.items():
        assert got[key] == pytest.approx(area, abs=1e-9)


def test_touching_polygons_share_nothing(spark):
    zones = edges(spark, [("x", 1, [[box(0, 0, 1, 1)]])], "z")
    areas = edges(spark, [("x", 1, [[box(1, 0, 2, 1)]]), ("x", 2, [[box(1, 1, 2, 2)]]), ("x", 3, [[box(0, -1, 1, 0)]])], "a")
    assert overlap(zones, areas) == {}


def convex(rng):
    n, r = rng.randint(3, 9), 10 ** rng.uniform(-1, 1.5)
    cx, cy = rng.uniform(0, 20), rng.uniform(0, 20)
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + r * math.cos(t), cy + r * math.sin(t)) for t in turns]


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_overlay_of_random_polygons(spark, offset):
    rng = random.Random(5)
    left, right = [convex(rng) for _ in range(40)], [convex(rng) for _ in range(40)]

    def moved(polygons, name):
        return edges(spark, [("x", i, [[[(x + offset, y + offset) for x, y in p]]]) for i, p in enumerate(polygons)], name)

    zones, areas = moved(left, "z"), moved(right, "a")
    got, back = overlap(zones, areas), overlay_area(areas, zones, ON, "a", "z")
    want = {("x", i, j): clip_area(p, q) for i, p in enumerate(left) for j, q in enumerate(right)}
    for key, area in want.items():
        assert got.get(key, 0.0) == pytest.approx(area, abs=1e-5)
    for r in back.collect():
        assert got[("x", r.z, r.a)] == pytest.approx(r.area, abs=1e-6)


def star(rng, points, radius):
    """Concave star-shaped ring with many short edges."""
    turns = [2 * math.pi * i / points for i in range(points)]
    return [(radius * f * math.cos(t), radius * f * math.sin(t)) for t in turns for f in [rng.uniform(0.5, 1)]]


def test_overlay_of_fine_and_coarse_edges(spark):
    rng = random.Random(8)
    fine = star(rng, 600, 50.0)
    tiles = [("x", i * 10 + j, [[box(-50 + 10 * i, -50 + 10 * j, -40 + 10 * i, -40 + 10 * j)]]) for i in range(10) for j in range(10)]
    zones, areas = edges(spark, [("x", 1, [[fine]])], "z"), edges(spark, tiles, "a")
    got = overlap(zones, areas)
    for _, tile, [[ring]] in tiles:
        assert got.get(("x", 1, tile), 0.0) == pytest.approx(clip_area(fine, ring[::-1]), abs=1e-6)
    assert sum(got.values()) == pytest.approx(abs(ring_area(fine)), rel=1e-9)
    itself = overlay_area(zones, zones.withColumnRenamed("z", "a"), ON, "z", "a").first()
    assert itself.area == pytest.approx(abs(ring_area(fine)), rel=1e-9)


def test_points_by_brute_force(spark):
    rng = random.Random(3)
    shapes = {1: FRAME, 2: [L_SHAPE], 3: [star(rng, 60, 4.0)], 4: [box(-20, -20, 20, 20)], 5: [box(2, 2, 2.5, 2.5)]}
    points = [(i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(300)]
    points += [(300 + i, x, y) for i, (x, y) in enumerate((a, b) for a in (0.0, 1.0, 2.0, 4.0) for b in (0.0, 1.0, 2.0, 4.0))]
    frame = spark.createDataFrame([("x", *p) for p in points] + [("x", 998, None, 1.0), ("other", 999, 1.0, 1.0)], "city string, p long, x double, y double")
    got = {(r.p, r.z) for r in points_in_polygons(frame, edges(spark, [("x", k, [v]) for k, v in shapes.items()], "z"), ON, "p", "z").collect()}
    assert got == {(p, k) for p, x, y in points for k, rings in shapes.items() if holds(rings, x, y)}


def test_points_in_fragments_need_both_layers(spark):
    frame = spark.createDataFrame([("x", 1, 0.5, 0.5), ("x", 2, 1.5, 0.5), ("x", 3, 1.0, 0.5)], "city string, p long, x double, y double")
    zones = edges(spark, [("x", 1, [[box(0, 0, 2, 1)]]), ("x", 2, [[box(0, 0, 2, 2)]])], "z")
    areas = edges(spark, [("x", 7, [[box(0, 0, 1, 1)]]), ("x", 8, [[box(1, 0, 1.2, 1)]])], "a")
    got = points_in_fragments(points_in_polygons(frame, zones, ON, "p", "z"), points_in_polygons(frame, areas, ON, "p", "a"), ON, "p")
    assert sorted((r.p, r.z, r.a) for r in got.collect()) == [(1, 1, 7), (1, 2, 7), (3, 1, 7), (3, 1, 8), (3, 2, 7), (3, 2, 8)]


def test_candidates_stay_few_when_sizes_differ(spark):
    """A huge polygon on each side must not make the small ones meet each other in its cells."""
    small = [("x", i, [[box(i, 0, i + 0.9, 0.9)]]) for i in range(200)]
    huge = ("x", 1000, [[box(0, 0, 1000, 1000)]])
    left, right = (edges(spark, [*small, huge], name) for name in ("z", "a"))
    pairs = candidate_pairs(outlines(left, ON, "z"), outlines(right, ON, "a"), ON, "z", "a")
    found = sorted((r.l_z, r.r_a) for r in pairs.collect())
    want = {(i, i) for i in range(200)} | {(i, 1000) for i in range(200)} | {(1000, i) for i in range(200)} | {(1000, 1000)}
    assert found == sorted(want)


def test_rings_are_normalised(spark):
    table = features(spark, [
        ("x", 1, [[box(0, 0, 4, 4)[::-1], box(1, 1, 2, 2)]]),
        ("x", 2, [[[(0, 0), (0, 1), (0, 1), (1, 1), (1, 0), (0, 0)]]]),
        ("x", 3, [[[(0, 0), (1, 1)]]]), ("x", 4, []), ("x", 5, None),
    ])
    raw = polygon_edges(table, ["city", "id"], "polygons")
    clean = normalize_rings(raw, ["city", "id"])
    assert {r.id: r.area for r in polygon_area(clean, ["city", "id"]).collect()} == {1: 15.0, 2: 1.0}
    assert clean.filter("id = 2").count() == 4
    ring = clean.filter("id = 1 and not hole").orderBy("edge_no").collect()
    assert all((a.x2, a.y2) == (b.x1, b.y1) for a, b in zip(ring, ring[1:] + ring[:1]))
    assert sorted(r.id for r in nonempty_features(table, clean, ["city", "id"]).collect()) == [1, 2]
    extent = layer_bbox(clean, ["city"]).first()
    assert (extent.xmin, extent.ymin, extent.xmax, extent.ymax) == (0, 0, 4, 4)


@pytest.fixture
def small_skew_limits(spark):
    """Make adaptive execution treat test-sized partitions as it treats large ones."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1000",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_third_of_the_points_in_one_cell_is_split(spark, small_skew_limits):
    rng = random.Random(1)
    tiles = [(i, j) for i in range(12) for j in range(12)]
    zones = edges(spark, [("x", i * 12 + j, [[box(i, j, i + 1, j + 1)]]) for i, j in tiles], "z")
    n = 30_000
    points = spark.createDataFrame(
        [("x", i, *(rng.uniform(3.1, 3.9) if i % 3 == 0 else rng.uniform(0, 12) for _ in range(2))) for i in range(n)],
        "city string, p long, x double, y double",
    ).repartition(8)
    located = points_in_polygons(points, zones, ON, "p", "z")
    assert located.select("p").distinct().count() == n
    counts = {r.z: r["count"] for r in located.groupBy("z").count().collect()}
    assert sum(counts.values()) == n and counts[3 * 12 + 3] >= n // 3
    plan = located._jdf.queryExecution()
    plan.executedPlan().executeCollect()
    assert "skew=true" in plan.executedPlan().toString()


def test_spatial_plans_have_no_cross_join_and_no_python(spark):
    zones = edges(spark, [("x", 1, [[box(0, 0, 1, 1)]])], "z")
    areas = edges(spark, [("x", 1, [[box(0, 0, 1, 1)]])], "a")
    points = spark.createDataFrame([("x", 1, 0.5, 0.5)], "city string, p long, x double, y double")
    for df in (overlay_area(zones, areas, ON, "z", "a"), points_in_polygons(points, zones, ON, "p", "z")):
        text = df._jdf.queryExecution().executedPlan().toString()
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
            assert bad not in text


def test_same_zone_id_in_two_cities(spark):
    zones = edges(spark, [("x", 1, [[box(0, 0, 2, 2)]]), ("y", 1, [[box(0, 0, 3, 3)]])], "z")
    areas = edges(spark, [("x", 1, [[box(0, 0, 9, 9)]]), ("y", 1, [[box(0, 0, 9, 9)]])], "a")
    assert overlap(zones, areas) == {("x", 1, 1): 4.0, ("y", 1, 1): 9.0}


def test_area_tolerance_is_a_parameter(spark):
    zones = edges(spark, [("x", 1, [[box(0, 0, 1, 1)]])], "z")
    areas = edges(spark, [("x", 1, [[box(0.9, 0, 2, 1)]])], "a")
    assert list(overlap(zones, areas).values()) == [pytest.approx(0.1)]
    assert overlap(zones, areas, min_area=0.2) == {}
