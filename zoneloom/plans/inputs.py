"""From the raw entity, spending, zone and area tables to the ones the study reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneloom.functions.projection import albers, project_edges, project_points
from zoneloom.functions.scalars import to_id, to_number
from zoneloom.operators.edges import normalize_rings, polygon_edges
from zoneloom.operators.shape import clean_headers, union_tagged
from zoneloom.session import cut_lineage

# Header noise, kept level, dropped columns, cities by state, grades, category labels, search terms.
HEADER_NOISE = "[^A-Za-z]|Latest available year|Public School"
ENTITY_LEVEL = "Elementary"
DROPPED_COLUMNS = [
    "AgencyName", "SchoolType", "CharterSchool", "MagnetSchool", "SharedTimeSchool", "UrbancentricLocale",
    "FullTimeEquivalentFTETeachers", "FreeLunchEligible", "ReducedpriceLunchEligibleStudents",
]
CITY_BY_STATE = {"IL": "Chicago", "CA": "Los Angeles", "NY": "New York"}
GRADES = ["A", "B", "C", "D"]
CATEGORY_LABELS = {
    "AmericanIndianAlaskaNativeStudents": "American Indian/Alaska Native",
    "AsianorAsianPacificIslanderStudents": "Asian/Asian Pacific Islander",
    "HispanicStudents": "Hispanic",
    "BlackorAfricanAmericanStudents": "Black/African American",
    "WhiteStudents": "White",
    "NatHawaiianorOtherPacificIslStudents": "Native Hawaiian/Pacific Islander",
    "TwoorMoreRacesStudents": "Two or more Races",
}
DESCRIPTION_TERMS = [
    "infiltration", "encroachment", "colored", "low grade", "low class", "subversive", "undesirable", "negro",
    "inharmonious", "lower grade",
]


def prepare_entities(raw: DataFrame, city_by_state: Mapping[str, str] = CITY_BY_STATE, level: str = ENTITY_LEVEL) -> DataFrame:
    """Clean headers, keep the wanted states and level, drop unused columns, add ``city``, ``entity_id``, ``x``, ``y``.

    Counts stay text; the id keeps its text form. ``x``/``y`` are longitude and latitude.
    """
    table = clean_headers(raw, HEADER_NOISE).filter(
        F.col("StateAbbr").isin(*city_by_state) & (F.col("SchoolLevelSYonward") == level)
    )
    cities = F.create_map(*[F.lit(v) for item in city_by_state.items() for v in item])
    return table.drop(*DROPPED_COLUMNS).withColumns({
        "StateName": F.lower("StateName"), "city": cities[F.col("StateAbbr")],
        "entity_id": F.col("SchoolIDNCESAssigned"), "x": to_number("Longitude"), "y": to_number("Latitude"),
    })


def prepare_spending(raw: DataFrame, city_by_state: Mapping[str, str] = CITY_BY_STATE) -> DataFrame:
    """``(city, id, pp_total)`` from the spending table; ids as numbers."""
    cities = F.create_map(*[F.lit(v) for item in city_by_state.items() for v in item])
    return raw.filter(F.col("state").isin(*city_by_state)).select(
        cities[F.col("state")].alias("city"), to_id("ncesid").alias("id"),
        F.col("pp_total_raw").alias("pp_total"),
    )


def prepare_zones(layers: Mapping[str, DataFrame], id_columns: Mapping[str, str]) -> DataFrame:
    """Zone edges ``(city, zone_id, ...)`` from one polygon layer per city, whose id columns differ."""
    named = {
        city: df.select(to_id(id_columns[city]).alias("zone_id"), "polygons")
        for city, df in layers.items()
    }
    edges = polygon_edges(union_tagged(named, "city"), ["city", "zone_id"], "polygons")
    return normalize_rings(edges, ["city", "zone_id"])


def prepare_areas(
    layers: Mapping[str, Sequence[DataFrame]], graded_only: Sequence[str] = ("New York",), grades: Sequence[str] = GRADES
) -> tuple[DataFrame, DataFrame]:
    """Attributes ``(city, area_id, grade)`` and normalised edges of the area layers, several per city.

    In the cities of ``graded_only`` areas without a grade are left out; elsewhere they stay and count as area.
    Areas have no id of their own: they are numbered once and written, so attributes and edges agree.
    """
    parts = {
        city: reduce(DataFrame.unionByName, [t.select(F.col("holc_grade").alias("grade"), "polygons") for t in tables])
        for city, tables in layers.items()
    }
    areas = union_tagged(parts, "city").filter(~F.col("city").isin(*graded_only) | F.col("grade").isin(*grades))
    areas = cut_lineage(areas.withColumn("area_id", F.monotonically_increasing_id()))
    edges = polygon_edges(areas, ["city", "area_id"], "polygons")
    return areas.select("city", "area_id", "grade"), normalize_rings(edges, ["city", "area_id"])


def prepare_study(
    zone_edges: DataFrame, area_edges: DataFrame, entities: DataFrame, projection=albers
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges and entities in degrees, projected alike so that areas are square metres and points meet their polygons.

    Source coordinates stay: ``lon1, lat1, lon2, lat2`` of the edges, ``lon, lat`` of the entities.
    """
    placed = entities.withColumnsRenamed({"x": "lon", "y": "lat"})
    return project_edges(zone_edges, projection), project_edges(area_edges, projection), project_points(placed, projection)
