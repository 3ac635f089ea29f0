"""Edge tables: one row per polygon edge, the form every spatial operator reads.

Columns: the partition keys (``on``), the feature id, ``ring_no``, ``hole``, ``edge_no``, ``x1, y1, x2, y2``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ring numbers of a feature's second row, third row, ... start at multiples of this.
ROW_STEP = 1 << 50

EDGE_COLUMNS = ("ring_no", "hole", "edge_no", "x1", "y1", "x2", "y2")


def box_edges(boxes: DataFrame, ids: Sequence[str], x0="x0", y0="y0", x1="x1", y1="y1") -> DataFrame:
    """Edges of axis-aligned boxes, clockwise from the lower left corner."""
    corners = f"1, {x0}, {y0}, {x0}, {y1}, 2, {x0}, {y1}, {x1}, {y1}, 3, {x1}, {y1}, {x1}, {y0}, 4, {x1}, {y0}, {x0}, {y0}"
    return boxes.select(
        *ids, F.lit(0).alias("ring_no"), F.lit(False).alias("hole"),
        F.expr(f"stack(4, {corners}) as (edge_no, x1, y1, x2, y2)"),
    )


def polygon_edges(features: DataFrame, ids: Sequence[str], polygons: str) -> DataFrame:
    """Edges of ``polygons``: array of polygons, each an array of rings, each an array of ``<x, y>`` points.

    The first ring of a polygon is its outline, the rest are holes. An open ring gets its closing edge. Ids may repeat:
    the rings of a further row with the same ids get numbers of their own.
    """
    rows = Window.partitionBy(*ids).orderBy(F.xxhash64(polygons))
    rings = (
        features.select(*ids, polygons, ((F.row_number().over(rows) - 1) * F.lit(ROW_STEP)).alias("row_base"))
        .select(*ids, "row_base", F.posexplode(polygons).alias("part_no", "rings"))
        .select(*ids, "row_base", "part_no", F.posexplode("rings").alias("ring_pos", "points"))
        .filter(F.size("points") > 0)
        .select(
            *ids, (F.col("row_base") + F.col("part_no") * F.lit(1 << 32) + F.col("ring_pos")).alias("ring_no"),
            (F.col("ring_pos") > 0).alias("hole"), "points",
        )
    )
    following = F.concat(F.slice("points", 2, F.size("points")), F.slice("points", 1, 1))
    pairs = rings.select(
        *ids, "ring_no", "hole",
        F.posexplode(F.arrays_zip(F.col("points").alias("a"), following.alias("b"))).alias("pos", "edge"),
    )
    return pairs.select(
        *ids, "ring_no", "hole", (F.col("pos") + 1).alias("edge_no"),
        F.col("edge.a.x").alias("x1"), F.col("edge.a.y").alias("y1"),
        F.col("edge.b.x").alias("x2"), F.col("edge.b.y").alias("y2"),
    ).filter(~((F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2"))))


def _under_edge() -> Column:
    """Signed area between an edge and the x axis: positive when the ring runs clockwise."""
    return (F.col("x2") - F.col("x1")) * (F.col("y1") + F.col("y2")) / F.lit(2.0)


def normalize_rings(edges: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Drop zero-length edges and rings under three edges; outlines run clockwise, holes the other way."""
    ring = [*ids, "ring_no"]
    real = edges.filter(~((F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2"))))
    sizes = real.groupBy(*ring).agg(
        F.count(F.lit(1)).alias("ring_edges"), F.max("edge_no").alias("last_no"), F.sum(_under_edge()).alias("ring_area")
    )
    kept = sizes.filter((F.col("ring_edges") >= 3) & (F.col("ring_area") != 0)).select(
        *ring, (F.col("ring_area") > 0).alias("clockwise"), "last_no"
    )
    turn = F.col("clockwise") == F.col("hole")
    return real.join(kept, ring).select(
        *ids, "ring_no", "hole",
        F.when(turn, F.col("last_no") + 1 - F.col("edge_no")).otherwise(F.col("edge_no")).alias("edge_no"),
        F.when(turn, F.col("x2")).otherwise(F.col("x1")).alias("x1"),
        F.when(turn, F.col("y2")).otherwise(F.col("y1")).alias("y1"),
        F.when(turn, F.col("x1")).otherwise(F.col("x2")).alias("x2"),
        F.when(turn, F.col("y1")).otherwise(F.col("y2")).alias("y2"),
    )


def polygon_area(edges: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Area per feature of normalised edges: holes count negative by their direction."""
    return edges.groupBy(*ids).agg(F.sum(_under_edge()).alias("area"))


def layer_bbox(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bounding box per layer, or of any grouping of the edges."""
    return edges.groupBy(*by).agg(
        F.min(F.least("x1", "x2")).alias("xmin"), F.min(F.least("y1", "y2")).alias("ymin"),
        F.max(F.greatest("x1", "x2")).alias("xmax"), F.max(F.greatest("y1", "y2")).alias("ymax"),
    )


def nonempty_features(features: DataFrame, edges: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Features that have at least one edge."""
    return features.join(edges.select(*ids).distinct(), list(ids), "left_semi")
