"""Area that two polygon layers share, as joins and one grouped sum.

With outlines clockwise and holes counter-clockwise, a polygon is the sum over its edges of the strip below the
edge, signed by the edge's direction along x. The shared area of two polygons is then the signed sum, over pairs
of edges with a common x range, of the area below the lower of the two edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneloom.operators.grid import ROUNDING, candidate_pairs, cell_of, cells_between, outlines


def _x_slabs(edges: DataFrame, headers: DataFrame, on: Sequence[str], feature: str, side: str) -> DataFrame:
    """Edges listed in the x slabs they cross, columns prefixed with the side.

    A polygon's slab width is not under its mean edge width, so its edges fill at most three times as many slabs
    as there are edges.
    """
    rows = edges.filter("x1 <> x2").join(headers.select(*on, feature, "x_level"), [*on, feature])
    return rows.selectExpr(
        *on, f"{feature} as {side}_{feature}",
        f"{cells_between('least(x1, x2)', 'greatest(x1, x2)', 'x_level')} as {side}_slab",
        f"least(x1, x2) as {side}_lo", f"greatest(x1, x2) as {side}_hi",
        f"if(x1 < x2, y1, y2) as {side}_y_lo", f"if(x1 < x2, y2, y1) as {side}_y_hi",
        f"signum(x2 - x1) as {side}_w",
    )


def _height(side: str, x: str) -> str:
    """SQL for the height of an edge at ``x`` above the base, exact at both ends."""
    lo, hi, y_lo, y_hi = (f"{side}_{c}" for c in ("lo", "hi", "y_lo", "y_hi"))
    inner = f"{y_lo} + ({y_hi} - {y_lo}) * (({x} - {lo}) / ({hi} - {lo}))"
    return f"case when {x} = {lo} then {y_lo} when {x} = {hi} then {y_hi} else {inner} end - base"


def overlay_area(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_id: str, right_id: str, min_area: float = 0.0,
    left_outlines: DataFrame | None = None, right_outlines: DataFrame | None = None,
) -> DataFrame:
    """``(on, left_id, right_id, area)`` for every pair of polygons that share more than ``min_area``.

    Inputs are normalised edge tables in one planar system of any unit. A pair's area also has to be over what rounding
    can add up to in its own sum, which follows its coordinates and widths; polygons that only touch are left out. A
    feature of several rows counts with the sum of its rows. Pass ``outlines`` tables that are already written to spare a scan of the edges.
    """
    l_head = outlines(left, on, left_id) if left_outlines is None else left_outlines
    r_head = outlines(right, on, right_id) if right_outlines is None else right_outlines
    l_key, r_key = f"l_{left_id}", f"r_{right_id}"
    x_lo, x_hi = "greatest(l_xmin, r_xmin)", "least(l_xmax, r_xmax)"
    pairs = candidate_pairs(l_head, r_head, on, left_id, right_id).selectExpr(
        *on, l_key, r_key, f"{x_lo} as xlo", f"{x_hi} as xhi", "least(l_ymin, r_ymin) as base",
        "greatest(abs(l_xmin), abs(l_xmax), abs(r_xmin), abs(r_xmax)) as x_size",
        "greatest(abs(l_ymin), abs(l_ymax), abs(r_ymin), abs(r_ymax)) as y_size",
        "l_x_level", "r_x_level", f"{cells_between(x_lo, x_hi, 'l_x_level')} as l_slab",
    )
    # Each left edge is kept in the one slab where its part of the common x range begins, then spread over the
    # slabs of the right polygon below that part; the same rule keeps each pair of edges once.
    with_left = (
        pairs.join(_x_slabs(left, l_head, on, left_id, "l"), [*on, l_key, "l_slab"])
        .filter(f"l_lo < xhi and l_hi > xlo and {cell_of('greatest(l_lo, xlo)', 'l_x_level')} = l_slab")
        .selectExpr("*", f"{cells_between('greatest(l_lo, xlo)', 'least(l_hi, xhi)', 'r_x_level')} as r_slab")
    )
    edge_pairs = (
        with_left.join(_x_slabs(right, r_head, on, right_id, "r"), [*on, r_key, "r_slab"])
        .filter(f"l_lo < r_hi and r_lo < l_hi and {cell_of('greatest(l_lo, r_lo)', 'r_x_level')} = r_slab")
        .selectExpr("*", "greatest(l_lo, r_lo) as lo", "least(l_hi, r_hi) as hi")
        .selectExpr(
            *on, f"{l_key} as {left_id}", f"{r_key} as {right_id}", "l_w * r_w as w", "hi - lo as width", "x_size", "y_size",
            f"{_height('l', 'lo')} as a0", f"{_height('l', 'hi')} as a1",
            f"{_height('r', 'lo')} as b0", f"{_height('r', 'hi')} as b1",
        )
    )
    # The lower of two lines over a range: one trapezium, or two where the lines cross at part t with height m.
    strips = edge_pairs.selectExpr("*", "a0 - b0 as d0", "a1 - b1 as d1").selectExpr(
        "*", "if(d0 * d1 < 0, d0 / (d0 - d1), 1) as t"
    ).selectExpr("*", "if(t < 1, a0 + t * (a1 - a0), least(a1, b1)) as m")
    return (
        strips.selectExpr(
            *on, left_id, right_id,
            "w * width * (t * (least(a0, b0) + m) + (1 - t) * (m + least(a1, b1))) / 2 as part",
            "width * y_size + greatest(abs(a0), abs(a1), abs(b0), abs(b1)) * x_size as doubt",
        )
        .groupBy(*on, left_id, right_id)
        .agg(F.sum("part").alias("area"), F.sum("doubt").alias("doubt"))
        .filter(f"area > {min_area!r} and area > doubt * {ROUNDING!r}")
        .drop("doubt")
    )
