"""Polygon layers from GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINT = "named_struct('x', p[0], 'y', p[1])"
_POLYGONS = "array<array<array<array<double>>>>"
_POLYGON = "array<array<array<double>>>"
_FEATURE_LINE = r'"type"\s*:\s*"Feature"'


def _parsed(kind: str) -> str:
    """SQL for a geometry's coordinates; what does not parse is an error, not a missing polygon."""
    parsed = f"from_json(feature.geometry.coordinates, '{kind}', map('mode', 'FAILFAST'))"
    return f"coalesce({parsed}, raise_error(concat('no coordinates in a feature of layer ', layer)))"


def _feature_type(properties: str) -> str:
    return f"struct<type: string, properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>"


def _line_type(properties: str) -> str:
    feature = _feature_type(properties)
    return feature.removesuffix(">") + f", features: array<{feature}>>"


def _flatten(features: DataFrame) -> DataFrame:
    """``(layer, properties..., polygons)`` from parsed features; other geometry types get no polygons."""
    parsed = features.select(
        "layer", "feature.properties.*",
        F.expr(
            f"case feature.geometry.type when 'MultiPolygon' then {_parsed(_POLYGONS)} when 'Polygon' then array({_parsed(_POLYGON)}) end"
        ).alias("nested"),
    )
    points = f"transform(nested, rings -> transform(rings, ring -> transform(ring, p -> {_POINT})))"
    return parsed.withColumn("polygons", F.expr(points)).drop("nested")


def scan_layers(spark: SparkSession, path: str, properties: str, pattern: str = "*.geojson", documents: bool = False) -> DataFrame:
    """All layers below a folder: ``(layer, properties..., polygons)``.

    ``properties`` declares the attributes, e.g. ``"grade string"``. One feature per line is expected, bare or
    inside a collection, so large files are split; a whole collection may also stand on one line. A line with a feature
    that is neither is an error. ``documents=True`` reads collections laid out in any other way, each file in one task. The layer is the partition folder ``layer=...`` if there is one, else the file name.
    """
    source = spark.read.option("pathGlobFilter", pattern)
    if documents:
        raw = source.schema(f"features array<{_feature_type(properties)}>").option("multiLine", True).json(path)
        rows = raw.select("*", F.col("_metadata.file_name").alias("_file"), F.explode("features").alias("feature"))
    else:
        raw = source.text(path)
        line = F.regexp_replace(F.trim("value"), r",$", "")
        rows = raw.filter(F.col("value").rlike(_FEATURE_LINE)).select(
            "*", F.col("_metadata.file_name").alias("_file"),
            F.from_json(line, _line_type(properties), {"mode": "FAILFAST"}).alias("parsed"),
        ).withColumn("feature", F.explode(F.expr(
            "case parsed.type when 'Feature' then array(struct(parsed.type, parsed.properties, parsed.geometry))"
            " when 'FeatureCollection' then parsed.features else raise_error(concat('neither feature nor collection: ', _file)) end"
        )))
    layer = F.col("layer") if "layer" in raw.columns else F.regexp_replace("_file", r"\.[^.]*$", "")
    return _flatten(rows.select(layer.alias("layer"), "feature"))
