"""Registered queries over the test tables: ``(spark, sf_dir) -> DataFrame`` by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import views
from zoneloom.functions import projection, scalars
from zoneloom.operators import boundary, compare, edges as E, ordinal, overlay, shape
from zoneloom.operators.classify import category_share, category_weight
from zoneloom.operators.locate import points_in_polygons
from zoneloom.operators.quantiles import exact_quantiles
from zoneloom.plans.inputs import GRADES, prepare_study
from zoneloom.plans.report import ordinal_report, publish_results, published_drill_down
from zoneloom.plans.study import ZoneStudy, sample_description, search_descriptions
from zoneloom.session import cut_lineage, scratch_path
from zoneloom.sources.layers import scan_layers
from zoneloom.sources.publish import publish, read_published
from zoneloom.sources.tables import read_csv, read_text_table, register_tables

ZONE_KEY, AREA_KEY, GROUP = ["city", "zone_id"], ["city", "area_id"], ["city", "zone_id", "grade"]
COUNTS = views.COUNT_COLUMNS
LABELS = {
    "n_urgent": "Urgent", "n_high": "High", "n_medium": "Medium", "n_unspecified": "Not specified", "n_low": "Low",
}
TERMS = ["licen[cs]e", "copyright", "the best", "low"]
FLAGS = ["hi_value", "is_final", "is_building"]
# Parameters of the fixed-parameter counterfactual, and the city and zone of the drill-down.
FIXED_BETA, FIXED_CUT = [0.4, -0.3, 0.2], 1.4
DRILL_CITY, DRILL_ZONE = "ASIA", 7
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _zone_edges(spark, sf_dir):
    return E.box_edges(views.zones(spark, sf_dir), ZONE_KEY)


def _area_edges(spark, sf_dir):
    return E.box_edges(views.areas(spark, sf_dir), AREA_KEY)


def _study(spark: SparkSession, sf_dir: str, entities: bool = False) -> ZoneStudy:
    """Inputs that take joins to derive are written once, as stored inputs would be."""
    areas = views.areas(spark, sf_dir)
    return ZoneStudy(
        zone_edges=E.box_edges(cut_lineage(views.zones(spark, sf_dir)), ZONE_KEY),
        area_edges=E.box_edges(areas, AREA_KEY), areas=areas,
        entities=cut_lineage(views.entities(spark, sf_dir)) if entities else None,
        spending=views.spending(spark, sf_dir).withColumnRenamed("state", "city"),
        categories=COUNTS, category_total="n_total", labels=LABELS, rate_part="n_subsidised", rate_total="n_total",
    )


# Sources and sinks


@query
def scan_entities(spark, sf_dir):
    path = scratch_path(spark, "entities") + ".csv"
    table = views.entities(spark, sf_dir)
    table.write.csv(path, header=True)
    text = read_text_table(spark, path, table.columns).withColumn("level", F.lower("level"))
    return shape.coerce_numeric(text, ["x", "y"])


@query
def scan_spending(spark, sf_dir):
    path = scratch_path(spark, "spending")
    views.spending(spark, sf_dir).withColumn("note", F.lit("kept out")).write.csv(path, header=True)
    table = read_csv(spark, path, "state string, id string, pp_total double, note string")
    return _rounded(table.select("state", F.col("id").cast("bigint").alias("id"), "pp_total"), pp_total=6)


@query
def scan_layers_geojson(spark, sf_dir):
    """Areas written as GeoJSON lines, one folder per city, scanned as layers; edges of what was read."""
    path = scratch_path(spark, "layers")
    corners = "array(array(x0, y0), array(x0, y1), array(x1, y1), array(x1, y0), array(x0, y0))"
    views.areas(spark, sf_dir).selectExpr(
        "city as layer",
        "to_json(named_struct('type', 'Feature', 'properties', named_struct('area_id', area_id, 'grade', grade),"
        f" 'geometry', named_struct('type', 'Polygon', 'coordinates', array({corners})))) as value",
    ).write.partitionBy("layer").text(path)
    layers = scan_layers(spark, path, "area_id bigint, grade string", pattern="*.txt").withColumnRenamed("layer", "city")
    return E.layer_bbox(E.polygon_edges(layers, [*AREA_KEY, "grade"], "polygons"), [*AREA_KEY, "grade"])


QUERIES["scan_layers"] = QUERIES.pop("scan_layers_geojson")


@query
def polygon_edges(spark, sf_dir):
    boxes = views.zones(spark, sf_dir)
    ring = "array(array(named_struct('x', x0, 'y', y0), named_struct('x', x0, 'y', y1), named_struct('x', x1, 'y', y1), named_struct('x', x1, 'y', y0)))"
    table = E.polygon_edges(boxes.withColumn("polygons", F.expr(f"array({ring})")), ZONE_KEY, "polygons")
    return table.select(*ZONE_KEY, "ring_no", "edge_no", "x1", "y1", "x2", "y2")


@query
def publish_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "published")
    publish(views.areas(spark, sf_dir), path, "city")
    return read_published(spark, path, "city").select("city", "area_id", "grade", "x0", "y0")


# Projection and schema


@query
def clean_headers(spark, sf_dir):
    table = views.entities(spark, sf_dir).select(
        F.col("entity_id").alias("Entity ID [Public School] Latest available year"),
        F.col("n_high").alias("n_high [Public School] 2019-20"), F.col("n_low").alias("n_low (all grades)"),
    )
    return shape.clean_headers(table, "[^A-Za-z]|Latest available year|Public School")


@query
def drop_columns(spark, sf_dir):
    return views.entities(spark, sf_dir).drop("x", "y", "n_unspecified")


@query
def column_range(spark, sf_dir):
    table = views.entities(spark, sf_dir)
    return table.select("entity_id", *shape.column_range(table, "n_urgent", "n_total"))


@query
def rename_cols(spark, sf_dir):
    renamed = views.areas(spark, sf_dir).withColumnsRenamed({"grade": "Majority Grade", "area_id": "unit_id"})
    return renamed.select("city", "unit_id", "Majority Grade")


@query
def tag_union(spark, sf_dir):
    """Per-city tables without their city, stacked with city and state tags again."""
    table = views.areas(spark, sf_dir)
    parts = {c: table.filter(F.col("city") == c).drop("city") for c in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")}
    tagged = shape.union_tagged(parts, "city").withColumn("source", F.lit("areas"))
    return tagged.select("city", "source", "area_id", "grade")


@query
def coerce_numeric(spark, sf_dir):
    return shape.coerce_numeric(views.entities(spark, sf_dir).select("entity_id", *COUNTS), COUNTS)


@query
def row_percent(spark, sf_dir):
    table = views.entities(spark, sf_dir)
    return table.select("entity_id", *[F.round(scalars.percent_of(c, "n_total"), 6).alias(c) for c in [*COUNTS, "n_subsidised"]])


@query
def ordinal_levels(spark, sf_dir):
    return views.areas(spark, sf_dir).select("city", "area_id", scalars.ordinal("grade", ["A", "B", "C"]).alias("grade_level"))


@query
def relabel(spark, sf_dir):
    long = views.entities(spark, sf_dir).unpivot(["entity_id"], COUNTS, "category", "value")
    return long.select(
        "entity_id", scalars.relabel("category", LABELS).alias("label"),
        scalars.replace_patterns("category", {"^n_": "", "un": "not "}).alias("rewritten"), "value",
    )


@query
def format_amount(spark, sf_dir):
    return views.spending(spark, sf_dir).select("id", scalars.thousands("pp_total").alias("amount"))


# Filters


@query
def filter_isin(spark, sf_dir):
    return views.entities(spark, sf_dir).filter(
        F.col("city").isin("AMERICA", "ASIA", "EUROPE") & (F.col("level") == "building")
    ).select("city", "entity_id", "level")


@query
def dropna_subset(spark, sf_dir):
    return views.areas(spark, sf_dir).dropna(subset=["grade"]).select("city", "area_id", "grade")


@query
def dropna_any(spark, sf_dir):
    numbers = shape.coerce_numeric(views.entities(spark, sf_dir), COUNTS)
    joined = numbers.withColumn("id", F.expr("try_cast(entity_id as bigint)")).join(
        views.spending(spark, sf_dir).select("id", "pp_total"), "id", "left"
    )
    return _rounded(joined.dropna("any").select("entity_id", *COUNTS, "pp_total"), pp_total=6)


@query
def nonempty_features(spark, sf_dir):
    """Areas without a grade have no shape here."""
    areas = views.areas(spark, sf_dir)
    with_shape = E.box_edges(areas.filter("grade is not null"), AREA_KEY)
    return E.nonempty_features(areas.select("city", "area_id", "grade"), with_shape, AREA_KEY)


@query
def text_terms(spark, sf_dir):
    found = search_descriptions(views.texts(spark, sf_dir), "data", TERMS)
    return found.select("doc_id", "lang", F.md5("data").alias("text_md5"))


@query
def sample_text(spark, sf_dir):
    return sample_description(views.texts(spark, sf_dir), "doc_id", "data", TERMS, seed=42)


# Spatial


def _split_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each zone box as two rows of one id that overlap in their middle, the second one's ring turned round."""
    boxes = views.zones(spark, sf_dir).selectExpr("*", "(x0 + x1) / 2 as xm")
    ring = "array(array(named_struct('x', {0}, 'y', y0), named_struct('x', {0}, 'y', y1), named_struct('x', {1}, 'y', y1), named_struct('x', {1}, 'y', y0)))".format
    first = boxes.selectExpr(*ZONE_KEY, f"array({ring('x0', 'xm + 0.25')}) as polygons")
    second = boxes.selectExpr(*ZONE_KEY, f"array({ring('x1', 'xm - 0.25')}) as polygons")
    return E.normalize_rings(E.polygon_edges(first.unionByName(second), ZONE_KEY, "polygons"), ZONE_KEY)


@query
def multipart_zones(spark, sf_dir):
    """Zones of two overlapping rows: own area, area shared with graded areas, and entities held."""
    edges, areas = cut_lineage(_split_zones(spark, sf_dir)), views.areas(spark, sf_dir)
    own = E.polygon_area(edges, ZONE_KEY)
    shared = overlay.overlay_area(edges, E.box_edges(areas, AREA_KEY), ["city"], "zone_id", "area_id")
    held = points_in_polygons(views.entities(spark, sf_dir), edges, ["city"], "entity_id", "zone_id")
    shared = shared.groupBy(*ZONE_KEY).agg(F.sum("area").alias("shared"), F.count(F.lit(1)).alias("n_areas"))
    held = held.groupBy(*ZONE_KEY).agg(F.count(F.lit(1)).alias("n_entities"))
    return _rounded(own.join(shared, ZONE_KEY, "left").join(held, ZONE_KEY, "left"), area=6, shared=6)


def _slanted_zones(spark, sf_dir) -> DataFrame:
    ring = "array(array(named_struct('x', x0, 'y', y0), named_struct('x', x1, 'y', y1), named_struct('x', x1, 'y', y0)))"
    table = views.zones(spark, sf_dir).withColumn("polygons", F.expr(f"array({ring})"))
    return E.normalize_rings(E.polygon_edges(table, ZONE_KEY, "polygons"), ZONE_KEY)


@query
def overlay_polygons(spark, sf_dir):
    """Slanted zones (lower right triangles of their boxes) over the graded boxes."""
    found = overlay.overlay_area(_slanted_zones(spark, sf_dir), _area_edges(spark, sf_dir), ["city"], "zone_id", "area_id")
    return _rounded(found, area=6)


@query
def project_edges(spark, sf_dir):
    """Both ends of the edges of small boxes around points, projected; source coordinates kept."""
    boxes = views.geo_points(spark, sf_dir).selectExpr("id", "lon as x0", "lat as y0", "lon + 0.5 as x1", "lat + 0.25 as y1")
    return _rounded(projection.project_edges(E.box_edges(boxes, ["id"]), projection.albers).select(
        "id", "edge_no", "lon1", "lat1", "lon2", "lat2", "x1", "y1", "x2", "y2"), x1=3, y1=3, x2=3, y2=3)


@query
def make_points(spark, sf_dir):
    """Text coordinates; where a count carries the bad marker, so does the longitude."""
    table = views.entities(spark, sf_dir).selectExpr(
        "city", "entity_id", "if(n_urgent = '†', n_urgent, cast(x as string)) as Longitude", "cast(y as string) as Latitude"
    )
    return shape.coerce_numeric(table, ["Longitude", "Latitude"]).withColumnsRenamed(
        {"Longitude": "x", "Latitude": "y"}
    ).dropna(subset=["x", "y"])


@query
def project_albers(spark, sf_dir):
    points = projection.project_points(views.geo_points(spark, sf_dir), projection.albers)
    return _rounded(points, x=3, y=3)


@query
def project_laea(spark, sf_dir):
    points = projection.project_points(views.geo_points(spark, sf_dir), projection.azimuthal)
    return _rounded(points, x=3, y=3)


@query
def polygon_area(spark, sf_dir):
    return _rounded(E.polygon_area(_zone_edges(spark, sf_dir), ZONE_KEY), area=6)


@query
def normalize_rings(spark, sf_dir):
    """Zone rings, those of odd ids reversed beforehand, with a doubled corner in each."""
    table = _zone_edges(spark, sf_dir)
    turned = table.selectExpr(
        *ZONE_KEY, "ring_no", "hole", "if(zone_id % 2 = 1, 5 - edge_no, edge_no) as edge_no",
        *[f"if(zone_id % 2 = 1, {b}, {a}) as {a}" for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))],
    )
    corner = turned.filter("edge_no = 4").selectExpr(*ZONE_KEY, "ring_no", "hole", "5 as edge_no", "x2 as x1", "y2 as y1", "x2", "y2")
    return E.normalize_rings(turned.unionByName(corner), ZONE_KEY).select(*ZONE_KEY, "x1", "y1", "x2", "y2")


@query
def layer_bbox(spark, sf_dir):
    return E.layer_bbox(_area_edges(spark, sf_dir), ["city"])


@query
def overlay_area(spark, sf_dir):
    return _rounded(_study(spark, sf_dir).fragments, area=6)


@query
def points_in_zones(spark, sf_dir):
    study = _study(spark, sf_dir)
    return points_in_polygons(
        views.entities(spark, sf_dir), study.zone_edges, ["city"], "entity_id", "zone_id", polygon_outlines=study.zone_outlines
    )


@query
def points_in_fragments(spark, sf_dir):
    return _study(spark, sf_dir, entities=True).located


# Boundaries


@query
def fragment_edges(spark, sf_dir):
    """Outline of what each zone and area share."""
    table = _study(spark, sf_dir).fragment_edges
    return table.select(*ZONE_KEY, "area_id", "hole", "edge_no", *boundary.XY)


@query
def fragment_polygons(spark, sf_dir):
    """Outlines of what slanted zones share with areas, as area and box of each."""
    found = boundary.fragment_edges(_slanted_zones(spark, sf_dir), _area_edges(spark, sf_dir), ["city"], "zone_id", "area_id")
    keys = [*ZONE_KEY, "area_id"]
    return _rounded(E.polygon_area(found, keys).join(E.layer_bbox(found, keys), keys), area=6, xmin=6, ymin=6, xmax=6, ymax=6)


@query
def dissolved_edges(spark, sf_dir):
    """Outline of all parts of one grade in a zone."""
    return _study(spark, sf_dir).grade_edges.select(*GROUP, *boundary.XY)


@query
def repair_rings(spark, sf_dir):
    """Zones given as bow-ties, split where they cross themselves and turned."""
    ring = "array(array(named_struct('x', x0, 'y', y0), named_struct('x', x1, 'y', y1), named_struct('x', x1, 'y', y0), named_struct('x', x0, 'y', y1)))"
    ties = E.polygon_edges(views.zones(spark, sf_dir).withColumn("polygons", F.expr(f"array({ring})")), ZONE_KEY, "polygons")
    return boundary.repair_edges(ties, ZONE_KEY).select(*ZONE_KEY, "hole", "edge_no", *boundary.XY)


@query
def unproject_albers(spark, sf_dir):
    """Points projected and taken back."""
    there = projection.project_points(views.geo_points(spark, sf_dir), projection.albers)
    lon, lat = projection.albers_inverse(F.col("x"), F.col("y"))
    return there.select("id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query
def projected_study(spark, sf_dir):
    """The raw path: zones, areas and entities in degrees, projected alike, compared in square metres."""
    degrees = "{0} * 0.01 - 100".format, "{0} * 0.01 + 38".format
    scaled = {f"{a}{n}": F.expr(degrees[a == "y"](f"{a}{n}")) for a in "xy" for n in (0, 1)}
    zones, areas = (f(spark, sf_dir).withColumns(scaled) for f in (views.zones, views.areas))
    # Entities stand beside the outlines: a parallel is a curve in the plane, an edge along it a chord.
    entities = views.entities(spark, sf_dir).select("city", "entity_id", F.expr(degrees[0]("(x + 0.0617)")).alias("x"), F.expr(degrees[1]("(y + 0.0617)")).alias("y"))
    zone_edges, area_edges, placed = prepare_study(E.box_edges(zones, ZONE_KEY), E.box_edges(areas, AREA_KEY), entities)
    own = E.polygon_area(zone_edges, ZONE_KEY).withColumnRenamed("area", "own_area")
    held_by = points_in_polygons(placed, zone_edges, ["city"], "entity_id", "zone_id")
    graded = points_in_polygons(placed, area_edges, ["city"], "entity_id", "area_id").join(views.areas(spark, sf_dir).select(*AREA_KEY, "grade"), AREA_KEY)
    counts = held_by.join(graded, ["city", "entity_id"]).groupBy(*ZONE_KEY).agg(F.count(F.lit(1)).alias("n_entities"), F.count_if(F.col("grade") == "A").alias("n_in_a"))
    return own.join(counts, ZONE_KEY, "left").select(*ZONE_KEY, F.round("own_area", 1).alias("own_area"), "n_entities", "n_in_a")


# Classification


@query
def zone_grade_area(spark, sf_dir):
    fragments = _study(spark, sf_dir).graded_fragments
    return _rounded(category_weight(fragments, ZONE_KEY, "grade", "area"), area=6)


@query
def zone_grade_share(spark, sf_dir):
    weights = category_weight(_study(spark, sf_dir).graded_fragments, ZONE_KEY, "grade", "area")
    return _rounded(category_share(weights, ZONE_KEY, "area", "area_perc"), area=6, area_perc=6)


@query
def majority_grade(spark, sf_dir):
    return _rounded(_study(spark, sf_dir).classified, area=6, area_perc=6)


@query
def grouped_members(spark, sf_dir):
    """Member areas per zone and grade, nested by blocks of ids and flattened to text."""
    fragments = _study(spark, sf_dir).graded_fragments
    nested = shape.nest(fragments, GROUP, "area_id", "members")
    return nested.select(
        *GROUP, "block", F.expr("array_join(transform(members, m -> cast(m.area_id as string)), ',') as area_ids"),
        F.expr("round(aggregate(members, double(0), (total, m) -> total + m.area), 6) as area"),
    )


# Composite tables


@query
def zone_summary(spark, sf_dir):
    return _rounded(_study(spark, sf_dir).zone_summary(), area=6, area_perc=6)


@query
def zone_drilldown(spark, sf_dir):
    return _rounded(_study(spark, sf_dir, entities=True).drill_down(DRILL_CITY, DRILL_ZONE), area=6)


@query
def zone_drilldown_published(spark, sf_dir):
    """The same drill-down from published tables: one city's folder of each is read."""
    root = scratch_path(spark, "published")
    publish_results(_study(spark, sf_dir, entities=True), root)
    return _rounded(published_drill_down(spark, root, DRILL_CITY, DRILL_ZONE), area=6)


@query
def map_layer(spark, sf_dir):
    table = _study(spark, sf_dir).map_layer()
    return _rounded(table.select(*GROUP, "area_perc", "majority_grade", "majority_level"), area_perc=6)


@query
def published_results(spark, sf_dir):
    """Rows per city of every published table, one city published a second time."""
    root = scratch_path(spark, "published")
    study = _study(spark, sf_dir, entities=True)
    names = publish_results(study, root)
    publish_results(study.of_city(DRILL_CITY), root)
    return reduce(DataFrame.unionByName, [
        read_published(spark, f"{root}/{n}", "city").groupBy("city").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "city", "n")
        for n in names if n in ("zone_summary", "map_layer", "entities_in_zones", "grade_share", "fragments", "located")
    ])


@query
def area_layer(spark, sf_dir):
    return _study(spark, sf_dir).area_layer("EUROPE").select("city", "area_id", "grade", "edge_no", "x1", "y1", "x2", "y2")


@query
def combined(spark, sf_dir):
    rows = _study(spark, sf_dir, entities=True).combined("level", "n_total")
    return _rounded(rows, area=6, area_perc=6)


@query
def located_in_classified(spark, sf_dir):
    return _study(spark, sf_dir, entities=True).located_in_classified()


@query
def grade_share(spark, sf_dir):
    return _rounded(_study(spark, sf_dir, entities=True).grade_share(), percent=6)


@query
def group_membership(spark, sf_dir):
    rows = _study(spark, sf_dir, entities=True).combined().select("city", "zone_id", "grade", "entity_id")
    return compare.group_membership(rows, "grade")


@query
def spend_join(spark, sf_dir):
    rows = _study(spark, sf_dir, entities=True).spend_join()
    return _rounded(rows.select("city", "zone_id", "grade", "area_id", "entity_id", "pp_total"), pp_total=6)


@query
def compare_composition(spark, sf_dir):
    return _rounded(_study(spark, sf_dir, entities=True).compare_composition(), value=6)


@query
def compare_composition_majority(spark, sf_dir):
    """The same comparison with whole zones grouped by their majority."""
    study = _study(spark, sf_dir, entities=True)
    study.grade_col = "majority_grade"
    return _rounded(study.compare_composition(), value=6)


@query
def compare_rate(spark, sf_dir):
    return _rounded(_study(spark, sf_dir, entities=True).compare_rate(), rate=6)


@query
def compare_spending(spark, sf_dir):
    return _rounded(_study(spark, sf_dir, entities=True).compare_spending(), pp_total=6)


@query
def spend_by_group(spark, sf_dir):
    """Spending per city and grade group, labelled by key."""
    result = _study(spark, sf_dir, entities=True).compare_spending()
    codes = {"AFRICA": "AF", "AMERICA": "AM", "ASIA": "AS", "EUROPE": "EU", "MIDDLE EAST": "ME"}
    named = result.withColumn("code", scalars.relabel("city", codes))
    return _rounded(named.select("city", "code", "grade_group", "pp_total"), pp_total=6)


def _composition_by_grade(spark, sf_dir) -> DataFrame:
    """Mean percentage per city, grade and category over the combined rows."""
    study = _study(spark, sf_dir, entities=True)
    rows = study.combined(*COUNTS, "n_total")
    shares = rows.select("city", "grade", *[scalars.percent_of(c, "n_total").alias(c) for c in COUNTS])
    wide = shape.mean_all_columns(shares, ["city", "grade"])
    return compare.unpivot_measures(wide, ["city", "grade"], COUNTS, "category")


@query
def composition_mean(spark, sf_dir):
    return _rounded(_composition_by_grade(spark, sf_dir), value=6).orderBy("city", "grade", "category")


@query
def pair_index(spark, sf_dir):
    table = compare.pair_index(_composition_by_grade(spark, sf_dir), ["city", "grade"], "category")
    return table.select("city", "grade", "category", "paired")


@query
def rank_by_mean(spark, sf_dir):
    return _rounded(compare.rank_by_mean(_composition_by_grade(spark, sf_dir), ["city"], "category", "value"), value=6)


@query
def fixed_order(spark, sf_dir):
    domain = ["n_low", "n_urgent", "n_high", "n_medium", "n_unspecified"]
    table = compare.in_order(_composition_by_grade(spark, sf_dir), "category", domain, "city", "grade")
    return _rounded(table, value=6).withColumn("position", F.array_position(F.array(*map(F.lit, domain)), F.col("category")))


# Reshaping and plain aggregates


@query
def unpivot_counts(spark, sf_dir):
    return views.entities(spark, sf_dir).unpivot(["entity_id", "n_total"], COUNTS, "category", "value")


@query
def nest_by_key(spark, sf_dir):
    table = views.entities(spark, sf_dir).select("city", F.expr("try_cast(entity_id as bigint)").alias("id"), "level")
    nested = shape.nest(table, ["city"], "id", "members")
    return nested.select(
        "city", "block", F.expr("array_join(transform(members, m -> concat(m.id, ':', m.level)), ',') as members"),
        F.size("members").alias("n_members"),
    )


@query
def union_layers(spark, sf_dir):
    table = views.areas(spark, sf_dir)
    parts = [table.filter(F.col("city") == c) for c in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")]
    parts[1] = parts[1].select(*reversed(table.columns))
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.filter(F.col("grade").isin(*GRADES))


@query
def mean_all_columns(spark, sf_dir):
    numbers = shape.coerce_numeric(views.entities(spark, sf_dir).select(*COUNTS, "n_total", "n_subsidised"), [*COUNTS, "n_total", "n_subsidised"])
    means = shape.mean_all_columns(numbers)
    return _rounded(means, **{c: 6 for c in means.columns})


@query
def distinct_keys(spark, sf_dir):
    return views.entities(spark, sf_dir).agg(
        F.count_distinct("city").alias("cities"), F.count_distinct("level").alias("levels"),
        F.count_distinct("entity_id").alias("entities"),
    )


@query
def register_views(spark, sf_dir):
    register_tables({"graded_areas": views.areas(spark, sf_dir)})
    return spark.sql("select city, grade, count(*) as n from graded_areas group by city, grade")


@query
def interval_quantiles(spark, sf_dir):
    table = exact_quantiles(views.spending(spark, sf_dir), ["state"], "pp_total", [0.025, 0.975])
    return _rounded(table, quantile=3)


# Model


@query
def nest_any_id(spark, sf_dir):
    """Texts as ids, a third of them missing, nested by rank."""
    table = views.entities(spark, sf_dir).select("city", F.expr("if(cast(entity_id as bigint) % 3 = 0, null, entity_id)").alias("id"), F.lit(1).alias("one"))
    nested = shape.nest_counted(table, ["city"], "id", "members", block=50)
    return nested.select("city", "block", F.expr("array_join(transform(members, m -> coalesce(m.id, '-')), ',') as members"))


@query
def majority_flags(spark, sf_dir):
    table = views.entities(spark, sf_dir)
    return table.select("entity_id", *[
        scalars.flag_over(scalars.percent_of(c, "n_total"), 50).alias(f"{c}_maj") for c in ("n_urgent", "n_low", "n_subsidised")
    ])


@query
def counterfactual_mean(spark, sf_dir):
    table = ordinal.counterfactual_mean(views.model_rows(spark, sf_dir), FLAGS, FIXED_BETA, FIXED_CUT, "hi_value", [0, 1])
    return _rounded(table, mean_prob=6, difference=6)


@query
def fit_ordinal_null(spark, sf_dir):
    fit = ordinal.fit_ordinal(views.model_rows(spark, sf_dir), "outcome", [], views.PRIORITIES)
    return _rounded(ordinal.coefficient_table(spark, fit).select("term", "estimate"), estimate=6)


@query
def fit_ordinal(spark, sf_dir):
    fit = ordinal.fit_ordinal(views.model_rows(spark, sf_dir), "outcome", FLAGS, views.PRIORITIES)
    table = ordinal.coefficient_table(spark, fit)
    return _rounded(table, estimate=6, std_error=6, t_value=4, p_value=6)


@query
def fit_ordinal_estimates(spark, sf_dir):
    """The fit's estimates alone, which SQL can find as well."""
    fit = ordinal.fit_ordinal(views.model_rows(spark, sf_dir), "outcome", FLAGS, views.PRIORITIES)
    return _rounded(ordinal.coefficient_table(spark, fit).select("term", "estimate"), estimate=5)


@query
def simulate_interval(spark, sf_dir):
    rows = cut_lineage(views.model_rows(spark, sf_dir))
    fit = ordinal.fit_ordinal(rows, "outcome", FLAGS, views.PRIORITIES)
    return ordinal.interval_table(ordinal.simulate_draws(rows, fit, "hi_value", [0, 1], seed=11))


@query
def model_report(spark, sf_dir):
    """Coefficients, counterfactual means and simulated intervals of one report, stacked."""
    report = ordinal_report(views.model_rows(spark, sf_dir), FLAGS, "hi_value", "outcome", views.PRIORITIES, seed=11)
    effect, none = "effect_value", F.lit(None).cast("double")
    return reduce(DataFrame.unionByName, [
        report["coefficients"].select(F.lit("coefficients").alias("section"), F.col("term").alias("item"), none.alias(effect), *_named("estimate", "std_error", "p_value", digits=6)),
        report["counterfactual"].select(F.lit("counterfactual").alias("section"), F.lit("top").alias("item"), effect, *_named("mean_prob", "difference", digits=5), none.alias("c")),
        report["intervals"].select(F.lit("intervals").alias("section"), F.col("outcome").alias("item"), effect, *_named("lower", "mean", "upper", digits=3)),
    ])


def _named(*columns: str, digits: int) -> list:
    return [F.round(c, digits).alias(n) for c, n in zip(columns, "abc")]


@query
def study_model(spark, sf_dir):
    """The study's own model: majority level of the zones by majority flags of the entities in them."""
    rows = _study(spark, sf_dir, entities=True).model_frame({"urgent_maj": "n_urgent", "low_maj": "n_low", "subsidised_maj": "n_subsidised"})
    return rows
