import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zoneloom.functions import projection, scalars
from zoneloom.operators import compare, shape
from zoneloom.operators.edges import polygon_area, polygon_edges
from zoneloom.operators.quantiles import exact_quantiles
from zoneloom.plans import inputs
from zoneloom.plans.study import ZoneStudy
from zoneloom.session import cut_lineage, scratch_path, shared_dir
from zoneloom.sources.layers import scan_layers
from zoneloom.sources.publish import publish, read_published
from zoneloom.sources.tables import read_csv, read_text_table, register_tables


def test_header_cleaning(spark):
    df = spark.createDataFrame([(1, 2)], ["White Students [Public School] 2019-20", "State Name [Public School] Latest available year"])
    assert shape.clean_headers(df, inputs.HEADER_NOISE).columns == ["WhiteStudents", "StateName"]
    with pytest.raises(ValueError, match="repeated"):
        shape.clean_headers(spark.createDataFrame([(1, 2)], ["a1", "a2"]), "[0-9]")


def test_scalar_functions(spark):
    df = spark.createDataFrame([("5", "10"), ("†", "10"), ("5", "0"), ("5", None), ("10", "10")], "a string, t string")
    assert [r[0] for r in df.select(scalars.percent_of("a", "t")).collect()] == [50.0, None, None, None, 100.0]
    flags = df.select(scalars.flag_over(scalars.percent_of("a", "t"), 50)).collect()
    assert [r[0] for r in flags] == [0, None, None, None, 1]
    names = spark.createDataFrame([("B",), ("Z",), (None,)], "g string")
    assert [r[0] for r in names.select(scalars.ordinal("g", ["A", "B"])).collect()] == [2, None, None]
    assert [r[0] for r in names.select(scalars.relabel("g", {"B": "Bee"})).collect()] == ["Bee", "Z", None]
    text = spark.createDataFrame([("abc",)], "g string")
    assert text.select(scalars.replace_patterns("g", {"a": "b", "b+": "x"})).first()[0] == "xc"
    assert spark.createDataFrame([(1234567.6,)], "v double").select(scalars.thousands("v")).first()[0] == "1,234,568"


def test_reshaping(spark):
    df = spark.createDataFrame([("x", i, i * 2) for i in range(2500)], "k string, id long, v long")
    nested = shape.nest(df, ["k"], "id", "members")
    assert sorted(len(r.members) for r in nested.collect()) == [500, 1000, 1000]
    assert nested.select("k", F.inline("members")).exceptAll(df).count() == 0
    tagged = shape.union_tagged({"p": df.limit(2), "q": df.select("v", "id", "k").limit(1)}, "tag")
    assert sorted(r.tag for r in tagged.collect()) == ["p", "p", "q"]
    assert shape.column_range(df, "id", "v") == ["id", "v"]
    summary = spark.createDataFrame([("x", "A", "b", 1.0), ("x", "A", "a", 5.0), ("x", "D", "b", 3.0), ("x", "D", "a", 7.0)], "city string, g string, c string, v double")
    assert {(r.g, r.c): r.paired for r in compare.pair_index(summary, ["city", "g"], "c").collect()} == {("A", "a"): 1, ("A", "b"): 2, ("D", "a"): 1, ("D", "b"): 2}
    assert {r.c: (r.v, r["rank"]) for r in compare.rank_by_mean(summary, ["city"], "c", "v").collect()} == {"b": (2.0, 1), "a": (6.0, 2)}
    assert [r.c for r in compare.in_order(summary, "c", ["b", "a"], "g").collect()] == ["b", "b", "a", "a"]


def test_exact_quantiles(spark):
    rng = random.Random(4)
    groups = {
        "tail": [math.exp(rng.gauss(0, 4)) for _ in range(999)], "hot": [7.0] * 700 + [rng.uniform(-5, 20) for _ in range(300)],
        "one": [3.5], "signed": [rng.gauss(0, 1000) for _ in range(500)], "same": [2.0] * 50,
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("tail", None)], "g string, v double")
    probs = [0.0, 0.025, 0.3, 0.5, 0.975, 1.0]
    for buckets in (16, 65_536):
        got = {(r.g, r.prob): r.quantile for r in exact_quantiles(df, ["g"], "v", probs, buckets).collect()}
        assert got.keys() == {(g, p) for g in groups for p in probs}
        for (g, p), value in got.items():
            assert value == pytest.approx(np.quantile(groups[g], p), rel=1e-9, abs=1e-9)


def test_quantiles_of_close_values_beside_an_outlier(spark):
    """No bucket over the bound is ever numbered, however close its values are; null groups and infinities count."""
    rng = np.random.default_rng(9)
    close = 1e6 + rng.random(20_000) / 5
    huge = np.concatenate([rng.normal(0, 1e307, 300), [-1.7e308, 1.7e308]])
    groups = {
        "close": np.concatenate([close, [-1e15]]), "tiny": np.arange(1, 500) * 5e-324, None: huge,
        "ends": np.array([-np.inf, -np.inf, 0.0, 3.0, np.inf, np.inf]), "equal": np.concatenate([np.full(5000, 0.1), [0.1 + 2**-56]]),
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("close", float("nan"))], "g string, v double")
    probs = [0.0, 0.025, 0.31, 0.5, 0.975, 1.0]
    for buckets, bound in ((65_536, 64), (64, 10), (16, 10**9)):
        got = {(r.g, r.prob): r.quantile for r in exact_quantiles(df, ["g"], "v", probs, buckets, bound).collect()}
        assert got.keys() == {(g, p) for g in groups for p in probs}
        for (g, p), found in got.items():
            if g == "ends":
                assert p not in (0.0, 0.025, 0.975, 1.0) or found == (-np.inf if p < 0.5 else np.inf)
            else:
                assert found == pytest.approx(np.quantile(groups[g], p), rel=1e-9, abs=0)


def test_projections_keep_area(spark):
    """A densified one-degree cell projects to its area on the ellipsoid, respectively the sphere."""
    n, lon, lat = 400, -90.0, 40.0
    side = [i / n for i in range(n)]
    ring = [(lon, lat + t) for t in side] + [(lon + t, lat + 1) for t in side] + [(lon + 1, lat + 1 - t) for t in side] + [(lon + 1 - t, lat) for t in side]
    table = spark.createDataFrame([(1, [[[(float(x), float(y)) for x, y in ring]]])], "id long, polygons array<array<array<struct<x: double, y: double>>>>")
    edges = polygon_edges(table, ["id"], "polygons")
    f = 1 / 298.257222101
    e2 = f * (2 - f)
    e = math.sqrt(e2)

    def band(d):
        s = math.sin(math.radians(d))
        return (1 - e2) * (s / (1 - e2 * s * s) + math.atanh(e * s) / e) / 2

    ellipsoid = 6378137.0**2 * math.radians(1) * (band(lat + 1) - band(lat))
    sphere = 6370997.0**2 * math.radians(1) * (math.sin(math.radians(lat + 1)) - math.sin(math.radians(lat)))
    for method, want in ((projection.albers, ellipsoid), (projection.azimuthal, sphere)):
        projected = projection.project_edges(edges, method)
        assert polygon_area(projected, ["id"]).first().area == pytest.approx(want, rel=1e-7)
        assert {"lon1", "lat1", "lon2", "lat2"} <= set(projected.columns)


def test_text_and_csv_sources(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([("007", "1,5", 'a "quoted" line\nbreak')], "id string, n string, note string").coalesce(1).write.csv(path, header=True, escape='"')
    row = read_csv(spark, path, "id string, n string, note string", long_text=True).first()
    assert tuple(row) == ("007", "1,5", 'a "quoted" line\nbreak')
    plain = scratch_path(spark, "plain") + ".csv"
    spark.createDataFrame([("01", "2")], "id string, n string").write.csv(plain, header=True)
    for columns in (None, ["id", "n"]):
        table = read_text_table(spark, plain, columns)
        assert dict(table.dtypes) == {"id": "string", "n": "string"} and tuple(table.first()) == ("01", "2")
    stored = scratch_path(spark, "stored") + ".parquet"
    spark.createDataFrame([(1, 2.5)], "id long, n double").write.parquet(stored)
    assert tuple(read_text_table(spark, stored).first()) == ("1", "2.5")


def test_layers_from_geojson(spark, tmp_path):
    square = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
    hole = [[0.25, 0.25], [0.75, 0.25], [0.75, 0.75], [0.25, 0.75], [0.25, 0.25]]
    found = [
        {"type": "Feature", "properties": {"grade": "A", "other": 1}, "geometry": {"type": "Polygon", "coordinates": [square, hole]}},
        {"type": "Feature", "properties": {"grade": None}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}},
        {"type": "Feature", "properties": {"grade": "C"}, "geometry": None},
    ]
    document = {"type": "FeatureCollection", "features": found}
    (tmp_path / "north.geojson").write_text(json.dumps(document, indent=1))
    (tmp_path / "notes.txt").write_text("not a layer")
    lines = tmp_path / "lines"
    lines.mkdir()
    body = ",\n".join(json.dumps(f) for f in found)
    (lines / "north.geojson").write_text('{"type": "FeatureCollection", "features": [\n' + body + "\n]}")
    (lines / "south.geojson").write_text(json.dumps(found[0]) + "\n")
    whole = scan_layers(spark, str(tmp_path / "*.geojson"), "grade string", documents=True)
    split = scan_layers(spark, str(lines), "grade string")
    for table in (whole, split.filter("layer = 'north'")):
        rows = {r.grade: r for r in table.collect()}
        assert [r.layer for r in rows.values()] == ["north"] * 3
        assert len(rows["A"].polygons[0]) == 2 and len(rows[None].polygons) == 2 and rows["C"].polygons is None
        assert rows["A"].polygons[0][1][1].x == 0.75
    assert split.filter("layer = 'south'").count() == 1
    (lines / "south.geojson").write_text(json.dumps(found[0])[:-40] + "\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        scan_layers(spark, str(lines), "grade string").collect()


def test_publish_and_register(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "city string, v long")
    path = scratch_path(spark, "published")
    publish(df, path, "city")
    assert sorted(tuple(r) for r in read_published(spark, path, "city").select("city", "v").collect()) == [("x", 1), ("x", 2), ("y", 3)]
    one = read_published(spark, path, "city", "y")
    assert one.count() == 1 and "PartitionFilters: [isnotnull(city" in one._jdf.queryExecution().executedPlan().toString()
    register_tables({"first_view": df, "second_view": df.limit(1)})
    assert spark.table("first_view").count() == 3 and spark.table("second_view").count() == 1
    written = cut_lineage(df)
    assert written.count() == 3 and all(shared_dir(spark) in f for f in written.inputFiles())


def test_raw_inputs_to_comparison(spark):
    """From raw-looking tables of three cities to the rate comparison."""
    names = ["State Name [Public School] Latest available year", "State Abbr [Public School]", "School Level (SY 2017-18 onward) [Public School]",
             "School ID (NCES Assigned) [Public School]", "Latitude", "Longitude", "Free and Reduced Lunch Students [Public School]",
             "Total Students All Grades (Excludes AE) [Public School]", *inputs.DROPPED_COLUMNS]
    unused = ["-"] * len(inputs.DROPPED_COLUMNS)
    rows = [
        ("Illinois", "IL", "Elementary", "0101", "0.5", "0.5", "40", "80", *unused), ("Illinois", "IL", "High", "0102", "0.5", "0.5", "1", "80", *unused),
        ("New York", "NY", "Elementary", "0201", "0.5", "0.5", "10", "40", *unused), ("Texas", "TX", "Elementary", "0301", "0.5", "0.5", "1", "2", *unused),
        ("Illinois", "IL", "Elementary", "0103", "0.6", "0.5", "†", "80", *unused),
    ]
    entities = inputs.prepare_entities(spark.createDataFrame(rows, names))
    assert "AgencyName" not in entities.columns and entities.filter("StateName = 'illinois'").count() == 2
    polygons = "array<array<array<struct<x: double, y: double>>>>"

    def layer(rows, name, kind):
        return spark.createDataFrame(
            [(key, [[[(float(x), float(y)) for x, y in ring]]]) for key, ring in rows], f"{name} {kind}, polygons {polygons}"
        )

    def square(x0, x1):
        return [(x0, 0), (x0, 1), (x1, 1), (x1, 0)]

    zones = inputs.prepare_zones(
        {"Chicago": layer([("1", square(0, 2))], "unit_id", "string"), "New York": layer([(1, square(0, 2))], "esid_no", "long")},
        {"Chicago": "unit_id", "New York": "esid_no"},
    )
    areas, area_edges = inputs.prepare_areas({
        "Chicago": [layer([("A", square(0, 1.2)), (None, square(1.2, 2))], "holc_grade", "string")],
        "New York": [layer([("D", square(0, 0.8))], "holc_grade", "string"), layer([("E", square(0.8, 2))], "holc_grade", "string")],
    })
    assert sorted((r.city, r.grade or "") for r in areas.collect()) == [("Chicago", ""), ("Chicago", "A"), ("New York", "D")]
    spent = inputs.prepare_spending(spark.createDataFrame([("101", 10.0, "IL"), ("201", 20.0, "NY"), ("9", 1.0, "TX")], "ncesid string, pp_total_raw double, state string"))
    study = ZoneStudy(zones, area_edges, areas, entities, spent)
    shares = {(r.city, r.grade): round(r.area_perc, 9) for r in study.classified.collect()}
    assert shares == {("Chicago", "A"): 0.6, ("Chicago", None): 0.4, ("New York", "D"): 1.0}
    assert {(r.city, r.grade_group): r.rate for r in study.compare_rate(comparison="A vs D").collect()} == {("Chicago", "A"): 50.0, ("New York", "D"): 25.0}
    assert {(r.city, r.grade_group): r.pp_total for r in study.compare_spending(comparison="A vs D").collect()} == {("Chicago", "A"): 10.0, ("New York", "D"): 20.0}


def test_term_search_treats_plain_and_regex_terms_alike(spark):
    texts = ["low-cost", "a licence", "license", "LOW", "x.y", "xzy", "", "line\nlow\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    got = [r[0] for r in df.select(scalars.matches_any("d", ["low", "licen[cs]e", "x\\.y"])).collect()]
    assert got == [True, True, True, False, True, False, False, True, None]
    assert [r[0] for r in df.select(scalars.matches_any("d", ["low"])).collect()][:2] == [True, False]
