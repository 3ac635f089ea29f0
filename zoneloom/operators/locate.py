"""Which polygons hold which points: an equi-join on y slabs, then a grouped crossing count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneloom.operators.edges import ROW_STEP
from zoneloom.operators.grid import ROUNDING, candidate_points, cell_of, cells_between, outlines


def y_slabs(edges: DataFrame, headers: DataFrame, on: Sequence[str], polygon: str) -> DataFrame:
    """Edges listed in the y slabs of their polygon that they cross, at most three per edge on average."""
    rows = edges.join(headers.select(*on, polygon, "y_level"), [*on, polygon])
    return rows.selectExpr(
        *on, polygon, f"{cells_between('least(y1, y2)', 'greatest(y1, y2)', 'y_level')} as slab",
        f"floor(ring_no / {ROW_STEP}) as row_no", "x1", "y1", "x2", "y2",
    )


def points_in_polygons(
    points: DataFrame, edges: DataFrame, on: Sequence[str], point: str, polygon: str, x: str = "x", y: str = "y",
    polygon_outlines: DataFrame | None = None,
) -> DataFrame:
    """``(on, point, polygon)`` for every point inside a polygon or on its boundary; holes do not count as inside.

    A feature of several rows holds what one of its rows holds, overlapping or not. Points must be unique by ``on`` and ``point``. Points without coordinates match nothing.
    """
    headers = outlines(edges, on, polygon) if polygon_outlines is None else polygon_outlines
    placed = points.selectExpr(*on, point, f"{x} as px", f"{y} as py").filter("px is not null and py is not null")
    near = candidate_points(placed, headers, on, polygon, "px", "py").selectExpr(
        "*", f"{cell_of('py', 'y_level')} as slab"
    )
    crosses = "(y1 > py) <> (y2 > py) and px < (x2 - x1) * (py - y1) / nullif(y2 - y1, 0) + x1"
    # On the line within what rounding of the coordinates can move it: a projected vertex is on its projected edge.
    wide = f"{ROUNDING!r} * greatest(abs(px), abs(py), abs(x1), abs(y1), abs(x2), abs(y2))"
    on_edge = (
        f"abs((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) <= {wide} * (abs(x2 - x1) + abs(y2 - y1))"
        f" and px between least(x1, x2) - {wide} and greatest(x1, x2) + {wide} and py between least(y1, y2) - {wide} and greatest(y1, y2) + {wide}"
    )
    return (
        near.join(y_slabs(edges, headers, on, polygon), [*on, polygon, "slab"])
        .groupBy(*on, point, polygon, "row_no")
        .agg(F.expr(f"count_if({crosses}) % 2 = 1 or bool_or({on_edge}) as held"))
        .filter("held")
        .select(*on, point, polygon)
        .distinct()
    )


def points_in_fragments(points_in_zones: DataFrame, points_in_areas: DataFrame, on: Sequence[str], point: str) -> DataFrame:
    """One row per point and (zone, area) pair that both hold it."""
    return points_in_zones.join(points_in_areas, [*on, point])
