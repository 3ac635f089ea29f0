"""Cases outside unit boxes with unique ids: other units, repeated ids, file layouts, id notations, unscaled predictors."""

import math
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.shapes import box, edges, features
from zoneloom.functions.scalars import to_id
from zoneloom.operators.compare import rank_by_mean
from zoneloom.operators.edges import normalize_rings, polygon_area, polygon_edges
from zoneloom.operators.locate import points_in_polygons
from zoneloom.operators.ordinal import fit_ordinal
from zoneloom.operators.overlay import overlay_area
from zoneloom.sources.layers import scan_layers

ON = ["city"]


def circle(x, y, r, n=200):
    return [(x + r * math.cos(-2 * math.pi * i / n), y + r * math.sin(-2 * math.pi * i / n)) for i in range(n)]


def test_disjoint_outlines_in_metres_share_nothing(spark):
    random.seed(3)
    zones, areas = [], []
    for i in range(300):
        # Discs side by side along a slanted line: their boxes overlap, they do not.
        x, y, r, gap = random.uniform(1e6, 2e6), random.uniform(1e6, 2e6), random.uniform(50, 30000), 1.001
        zones.append((str(i), i, [[circle(x, y, r)]]))
        areas.append((str(i), i, [[circle(x + r * gap * math.sqrt(2), y + r * gap * math.sqrt(2), r)]]))
    assert overlay_area(edges(spark, zones, "z"), edges(spark, areas, "a"), ON, "z", "a").count() == 0


def test_small_overlaps_in_degrees_are_kept(spark):
    side = math.sqrt(9.5e-7)
    zones = edges(spark, [("x", 1, [[box(-87.6, 41.8, -87.5, 41.9)]]), ("x", 2, [[box(-87.4, 41.8, -87.3, 41.9)]])], "z")
    areas = edges(spark, [
        ("x", 1, [[box(-87.5 - side, 41.9 - side, -87.45, 41.95)]]), ("x", 2, [[box(-87.3 - side, 41.9 - side, -87.2, 41.95)]]),
    ], "a")
    found = {(r.z, r.a): r.area for r in overlay_area(zones, areas, ON, "z", "a").collect()}
    assert found == {(1, 1): pytest.approx(9.5e-7, rel=1e-6), (2, 2): pytest.approx(9.5e-7, rel=1e-6)}
    assert overlay_area(zones, areas, ON, "z", "a", min_area=1e-6).count() == 0


def test_rows_of_one_id_add_up_and_hold_points_singly(spark):
    turned = box(0, 0, 2, 1)[::-1]
    rows = [("x", 1, [[box(0, 0, 1, 1)]]), ("x", 1, [[turned]]), ("x", 2, [[box(5, 0, 6, 1)]])]
    zones = normalize_rings(polygon_edges(features(spark, rows).withColumnRenamed("id", "z"), ["city", "z"], "polygons"), ["city", "z"])
    assert {r.z: r.area for r in polygon_area(zones, ["city", "z"]).collect()} == {1: 3.0, 2: 1.0}
    areas = edges(spark, [("x", 9, [[box(0, 0, 10, 10)]])], "a")
    assert {r.z: r.area for r in overlay_area(zones, areas, ON, "z", "a").collect()} == {1: pytest.approx(3.0), 2: pytest.approx(1.0)}
    points = spark.createDataFrame([("x", "both", 0.5, 0.5), ("x", "one", 1.5, 0.5), ("x", "none", 3.0, 0.5)], "city string, p string, x double, y double")
    assert {(r.p, r.z) for r in points_in_polygons(points, zones, ON, "p", "z").collect()} == {("both", 1), ("one", 1)}


FEATURE = '{{"type":"Feature","properties":{{"grade":"{0}"}},"geometry":{{"type":"Polygon","coordinates":[[[0,0],[0,{1}],[1,1],[0,0]]]}}}}'


def test_layouts_of_a_layer_give_the_same_rows(spark, tmp_path):
    made = [FEATURE.format(g, i + 1) for i, g in enumerate("ABC")]
    layouts = {
        "one": '{"type":"FeatureCollection","features":[' + ",".join(made) + "]}",
        "lines": '{"type":"FeatureCollection","features":[\n' + ",\n".join(made) + "\n]}",
        "bare": "\n".join(made),
    }
    for name, text in layouts.items():
        folder = tmp_path / name
        folder.mkdir()
        (folder / "layer.geojson").write_text(text)
        rows = scan_layers(spark, str(folder), "grade string").collect()
        assert sorted((r.grade, r.polygons[0][0][1].y) for r in rows) == [("A", 1.0), ("B", 2.0), ("C", 3.0)], name


@pytest.mark.parametrize("text", [
    '{\n"type": "FeatureCollection",\n"features": [\n{\n"type": "Feature",\n"properties": {}\n}\n]\n}',
    FEATURE.format("A", 1).replace("[[[0,0]", '[[["?",0]'),
])
def test_layers_that_do_not_parse_are_errors(spark, tmp_path, text):
    (tmp_path / "layer.geojson").write_text(text)
    with pytest.raises((PySparkException, Py4JJavaError)):
        scan_layers(spark, str(tmp_path), "grade string").collect()


def test_ids_in_number_notation(spark):
    texts = ["1.70993E+11", "170993000942.0", "0042", "42.5", "†", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "id string").select(to_id("id").alias("n")).collect()
    assert [r.n for r in rows] == [170993000000, 170993000942, 42, None, None, None, None]


def test_unscaled_predictor_is_no_separation(spark):
    random.seed(5)
    rows = []
    for _ in range(4000):
        x = random.uniform(200, 300)
        v = 0.2 * x + math.log(1 / random.uniform(1e-9, 1) - 1)
        rows.append(("A" if v < 46 else "B" if v < 52 else "C", x))
    fit = fit_ordinal(spark.createDataFrame(rows, "outcome string, x double"), "outcome", ["x"], ["A", "B", "C"])
    assert fit.beta[0] == pytest.approx(0.2, abs=0.02)
    assert fit.cuts == pytest.approx((46, 52), abs=5)
    assert math.sqrt(fit.covariance[0, 0]) == pytest.approx(0.004, abs=0.002)


def test_small_means_are_ranked(spark):
    rows = spark.createDataFrame([("x", c, v) for c, v in (("a", 3e-10), ("b", 1e-10), ("c", 2e-10), ("d", 0.0))], "g string, c string, v double")
    assert {r.c: r["rank"] for r in rank_by_mean(rows, ["g"], "c", "v").select("c", F.col("rank")).collect()} == {"d": 1, "b": 2, "c": 3, "a": 4}
