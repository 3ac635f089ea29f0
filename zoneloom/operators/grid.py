"""Candidate search on a grid whose cell side follows the size of each polygon.

A polygon's level is the smallest power of two not under its longer box side, so it covers at most four cells of
that level however large it is. Two polygons meet on the coarser of their two levels: the coarser one is listed
in its own cells, the finer one in the cells of that level. Small polygons therefore never meet in a large cell
just because both lie in it, and one huge polygon does not flood the grid with cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Times the coordinates: what rounding may move them by, a few units in the last place.
ROUNDING = 8 * 2.0**-52
# Levels are kept within what doubles separate at map coordinates; zero-sized boxes get the lowest one.
MIN_LEVEL, MAX_LEVEL = -20, 60


def size_level(side: str) -> str:
    """SQL for the smallest ``k`` with ``2**k >= side``."""
    level = f"cast(ceil(log2(nullif({side}, 0))) as int)"
    return f"least(greatest(coalesce({level}, {MIN_LEVEL}), {MIN_LEVEL}), {MAX_LEVEL})"


def cell_of(coordinate: str, level: str) -> str:
    """SQL for the number of the cell of side ``2**level`` that holds the coordinate."""
    return f"floor(({coordinate}) / pow(2, {level}))"


def cells_between(first: str, last: str, level: str) -> str:
    """SQL listing the cells from one coordinate to another."""
    return f"explode(sequence({cell_of(first, level)}, {cell_of(last, level)}))"


def outlines(edges: DataFrame, on: Sequence[str], feature: str) -> DataFrame:
    """One row per polygon: box, grid level, and the levels of its typical edge along x and along y."""
    boxes = edges.groupBy(*on, feature).agg(
        F.expr("min(least(x1, x2)) as xmin"), F.expr("min(least(y1, y2)) as ymin"),
        F.expr("max(greatest(x1, x2)) as xmax"), F.expr("max(greatest(y1, y2)) as ymax"),
        F.expr("avg(nullif(abs(x2 - x1), 0)) as mean_dx"), F.expr("avg(nullif(abs(y2 - y1), 0)) as mean_dy"),
    )
    return boxes.selectExpr(
        *on, feature, "xmin", "ymin", "xmax", "ymax",
        f"{size_level('greatest(xmax - xmin, ymax - ymin)')} as level",
        f"{size_level('mean_dx')} as x_level", f"{size_level('mean_dy')} as y_level",
    )


def levels_in_use(boxes: DataFrame) -> Column:
    """The levels that occur in a layer, as a scalar subquery: at most ``MAX_LEVEL - MIN_LEVEL + 1`` numbers."""
    return boxes.agg(F.expr("array_sort(collect_set(level))")).scalar()


def _listed(boxes: DataFrame, other: DataFrame, on: Sequence[str], columns: Sequence[str], prefix: str, entries: str) -> DataFrame:
    """Boxes as one row per (role, level, cell); ``entries`` is SQL for an array of <role, cell_level>."""
    by_level = boxes.select("*", levels_in_use(other).alias("other_levels")).selectExpr(*boxes.columns, f"inline({entries})")
    by_column = by_level.selectExpr("*", f"{cells_between('xmin', 'xmax', 'cell_level')} as cx")
    return by_column.selectExpr(
        *on, "role", "cell_level", "cx", f"{cells_between('ymin', 'ymax', 'cell_level')} as cy",
        *[f"{c} as {prefix}{c}" for c in columns],
    )


def candidate_pairs(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_id: str, right_id: str, carried: Sequence[str] = ("x_level",)
) -> DataFrame:
    """Pairs of polygons whose boxes overlap, each once; ids, boxes and ``carried`` columns of both sides as ``l_*`` and ``r_*``.

    Role 0 joins pairs whose left polygon is at least as coarse, role 1 those whose right polygon is coarser.
    A pair is kept only in the cell holding the lower left corner of the common box, so no distinct is needed.
    """
    columns = ["xmin", "ymin", "xmax", "ymax", *carried]

    def entries(own_role: int, other_role: int, wanted: str) -> str:
        # The own level only where the other layer has boxes that come there.
        own = f"filter(array(named_struct('role', {own_role}, 'cell_level', level)), o -> exists(other_levels, v -> not v {wanted} level))"
        coarser = f"filter(other_levels, v -> v {wanted} level)"
        return f"concat({own}, transform({coarser}, v -> named_struct('role', {other_role}, 'cell_level', v)))"

    l_rows = _listed(left, right, on, [left_id, *columns], "l_", entries(0, 1, ">"))
    r_rows = _listed(right, left, on, [right_id, *columns], "r_", entries(1, 0, ">="))
    matches = " and ".join(
        f"l_{a}min < r_{a}max and r_{a}min < l_{a}max and "
        f"{cell_of(f'greatest(l_{a}min, r_{a}min)', 'cell_level')} = c{a}"
        for a in ("x", "y")
    )
    return l_rows.join(r_rows, [*on, "role", "cell_level", "cx", "cy"]).filter(matches)


def candidate_points(points: DataFrame, boxes: DataFrame, on: Sequence[str], polygon: str, x: str, y: str) -> DataFrame:
    """Points joined to the polygons whose box, edges included, holds them."""
    listed = points.select("*", F.explode(levels_in_use(boxes)).alias("cell_level")).selectExpr(
        "*", f"{cell_of(x, 'cell_level')} as cx", f"{cell_of(y, 'cell_level')} as cy"
    )
    cells = boxes.selectExpr("*", f"{cells_between('xmin', 'xmax', 'level')} as cx").selectExpr(
        *on, polygon, "level as cell_level", "cx", f"{cells_between('ymin', 'ymax', 'level')} as cy",
        "xmin", "ymin", "xmax", "ymax", "y_level",
    )
    return (
        listed.join(cells, [*on, "cell_level", "cx", "cy"])
        .filter(f"{x} between xmin and xmax and {y} between ymin and ymax")
        .select(*points.columns, polygon, "y_level")
    )
