"""Boundaries of shared, united and repaired polygons.

Edges are split wherever they meet, the parts that bound the result are kept, and rings are linked anew: every part finds
the one that follows it by the common vertex, and pointer jumping finds its ring and its place in it in as many
rounds as the longest ring has binary digits. Small groups take these steps within a row, larger ones by joins. Edges have
the polygon's inside on their right, as normalised rings do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zoneloom.operators.grid import ROUNDING, candidate_pairs, candidate_points, cell_of, cells_between, outlines, size_level
from zoneloom.operators.locate import y_slabs
from zoneloom.session import cut_lineage

XY = ["x1", "y1", "x2", "y2"]
FORWARD = "x1 < x2 or x1 = x2 and y1 < y2"
SMALL = 128  # edges of a group that are compared with each other and linked within a row; larger groups use grid and joins
MAX_ROUNDS = 64  # of pointer jumping: a ring would need more than 2**64 edges to take as many


def _large_groups(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys with more than ``SMALL`` rows."""
    return cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(f"n > {SMALL}").select(*keys))


def _box(ends: str) -> list[str]:
    """SQL for the size and the box of an edge, wider by what rounding may move it; ``ends`` formats a column's name."""
    x1, y1, x2, y2 = map(ends.format, XY)
    size = f"greatest(abs({x1}), abs({y1}), abs({x2}), abs({y2}))"
    corners = (("xmin", "least", x1, x2, "-"), ("ymin", "least", y1, y2, "-"), ("xmax", "greatest", x1, x2, "+"), ("ymax", "greatest", y1, y2, "+"))
    named = [(size, "size"), *((f"{f}({a}, {b}) {sign} {size} * {ROUNDING!r}", name) for name, f, a, b, sign in corners)]
    return [f"{value} as {ends.format(name)}" for value, name in named]


def _met_pairs(left: DataFrame, right: DataFrame, edges: DataFrame, keys: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Pairs of edges of a group whose boxes overlap; both sides as ``l_*`` and ``r_*``.

    In groups of at most ``SMALL`` edges all edges meet by their group alone, which lists every edge once. Larger groups are
    searched on the grid.
    """
    large = _large_groups(edges, keys)
    columns = ["e", *carried, *XY]
    sides = [
        side.join(large, keys, "left_anti").select(*keys, *[F.col(c).alias(f"{a}_{c}") for c in columns]) for a, side in (("l", left), ("r", right))
    ]
    overlap = " and ".join(f"l_{a}min < r_{a}max and r_{a}min < l_{a}max" for a in "xy")
    pairs = sides[0].join(sides[1], list(keys)).selectExpr("*", *_box("l_{0}"), *_box("r_{0}")).filter(overlap)
    if large.isEmpty():
        return pairs
    l_boxes, r_boxes = (
        side.join(large, keys, "left_semi").selectExpr("*", *_box("{0}")).selectExpr("*", f"{size_level('greatest(xmax - xmin, ymax - ymin)')} as level")
        for side in (left, right)
    )
    searched = candidate_pairs(l_boxes, r_boxes, keys, "e", "e", [*carried, "size", *XY])
    return pairs.unionByName(searched.select(*pairs.columns))


def _turned(edge: str, point: tuple[str, int]) -> str:
    """SQL for -1, 0 or 1: the side of an edge on which an end of the other one lies, 0 within rounding of its line."""
    a, (p, n) = edge, point
    dx, dy = f"({a}_x2 - {a}_x1)", f"({a}_y2 - {a}_y1)"
    value = f"{dx} * ({p}_y{n} - {a}_y1) - {dy} * ({p}_x{n} - {a}_x1)"
    return f"if(abs({value}) <= {ROUNDING!r} * greatest(l_size, r_size) * (abs({dx}) + abs({dy})), 0, signum({value}))"


def _meeting_points(pairs: DataFrame, keys: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """``(keys, e, carried, x1 .. y2, px, py)``: where the edges of each pair meet, for both edges.

    An end on the other edge is that end itself; a crossing is computed from the two edges in an order and direction that
    do not depend on how they were given, so whoever meets there gets the same point.
    """
    near = pairs.selectExpr("*", *[f"{_turned(a, (b, n))} as {b}{n}" for a, b in (("l", "r"), ("r", "l")) for n in (1, 2)])
    end = "named_struct('x', {0}_x{1}, 'y', {0}_y{1})".format
    both = "named_struct('p', least({0}, {1}), 'q', greatest({0}, {1}))".format
    sorted_ends = near.selectExpr("*", *[f"{both(end(a, 1), end(a, 2))} as {a}_ends" for a in "lr"])
    placed = sorted_ends.selectExpr("*", "least(l_ends, r_ends) as u", "greatest(l_ends, r_ends) as v").selectExpr(
        "*", "(u.q.x - u.p.x) * (v.q.y - v.p.y) - (u.q.y - u.p.y) * (v.q.x - v.p.x) as det",
        "(v.p.x - u.p.x) * (v.q.y - v.p.y) - (v.p.y - u.p.y) * (v.q.x - v.p.x) as num",
    )
    crossing = "l1 * l2 < 0 and r1 * r2 < 0"
    at = "named_struct('x', u.p.x + num / det * (u.q.x - u.p.x), 'y', u.p.y + num / det * (u.q.y - u.p.y))"
    sides = []
    for a, b in (("l", "r"), ("r", "l")):
        own = [f"if({crossing}, {at}, null)"]
        for n in (1, 2):
            x, y = f"{b}_x{n}", f"{b}_y{n}"
            inside = f"{x} between {a}_xmin and {a}_xmax and {y} between {a}_ymin and {a}_ymax"
            own.append(f"if({b}{n} = 0 and {inside}, named_struct('x', {x}, 'y', {y}), null)")
        edge = ", ".join(f"'{c}', {a}_{c}" for c in ("e", *carried, *XY))
        sides.append(f"transform(filter(array({', '.join(own)}), p -> p is not null), p -> named_struct({edge}, 'px', p.x, 'py', p.y))")
    # One pass for both edges: as a union the search would run twice.
    return placed.selectExpr(*keys, f"inline(concat({', '.join(sides)}))")


def _parts(edges: DataFrame, points: DataFrame, keys: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Edges cut at their points: ``(keys, carried, x1 .. y2)`` of each part, in the edge's direction.

    A part starts at the edge's start or at a point; the last one ends where the edge does. Points that come twice make
    parts without length, which go.
    """
    columns = [*keys, "e", *carried, *XY]
    inner = points.selectExpr(*columns, "px", "py", "(px - x1) * (x2 - x1) + (py - y1) * (y2 - y1) as t").filter(
        "t > 0 and t < (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)"
    )
    starts = edges.selectExpr(*columns, "x1 as px", "y1 as py", "double(0) as t").filter("x1 + y1 + x2 + y2 is not null")
    along = Window.partitionBy(*keys, "e").orderBy("t", "px", "py")
    cut = inner.unionByName(starts).select(
        *keys, *carried, F.col("px").alias("x1"), F.col("py").alias("y1"),
        F.coalesce(F.lead("px").over(along), "x2").alias("x2"), F.coalesce(F.lead("py").over(along), "y2").alias("y2"),
    )
    return cut.filter("x1 <> x2 or y1 <> y2")


def _together(parts: DataFrame, keys: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """``(keys, x1 .. y2, one_way, <least and greatest of carried>)``: equal parts as one, forward if one of them is.

    Least and greatest tell whether all are alike, in one grouping; counts of distinct values would list every part again.
    """
    ends = ["xa", "ya", "xb", "yb"]
    grouped = parts.selectExpr(
        *keys, *carried, f"{FORWARD} as forward", "least(x1, x2) as xa", f"if({FORWARD}, y1, y2) as ya", "greatest(x1, x2) as xb", f"if({FORWARD}, y2, y1) as yb",
    ).groupBy(*keys, *ends).agg(
        F.min("forward").alias("all_forward"), F.max("forward").alias("forward"), *[F.expr(f"{f}({c}) as {f}_{c}") for c in carried for f in ("min", "max")],
    )
    turned = [f"if(forward, {a}, {b}) as {c}" for a, b, c in zip(ends, ["xb", "yb", "xa", "ya"], XY)]
    return grouped.selectExpr(*keys, *turned, "all_forward = forward as one_way", *[f"{f}_{c}" for c in carried for f in ("min", "max")])


def _middles(parts: DataFrame) -> DataFrame:
    return parts.selectExpr("*", "(x1 + x2) / 2 as mx", "(y1 + y2) / 2 as my")


def _strictly_inside(near: DataFrame, edges: DataFrame, headers: DataFrame, on: Sequence[str], polygon: str, columns: Sequence[str]) -> DataFrame:
    """Distinct ``columns`` of the rows whose middle lies inside ``polygon`` and not on its boundary.

    ``near`` has ``mx, my`` and ``y_level``; each middle meets the edges of the polygon's slab at its height."""
    slabs = y_slabs(edges, headers, on, polygon).withColumnsRenamed({c: f"p_{c}" for c in XY})
    dx, dy = "(p_x2 - p_x1)", "(p_y2 - p_y1)"
    crosses = f"(p_y1 > my) <> (p_y2 > my) and mx < {dx} * (my - p_y1) / nullif({dy}, 0) + p_x1"
    wide = f"{ROUNDING!r} * greatest(abs(mx), abs(my), abs(p_x1), abs(p_x2), abs(p_y1), abs(p_y2))"
    on_edge = (
        f"abs({dx} * (my - p_y1) - {dy} * (mx - p_x1)) <= {wide} * (abs({dx}) + abs({dy}))"
        f" and mx between least(p_x1, p_x2) - {wide} and greatest(p_x1, p_x2) + {wide}"
        f" and my between least(p_y1, p_y2) - {wide} and greatest(p_y1, p_y2) + {wide}"
    )
    group = list(dict.fromkeys([*columns, *on, polygon, "row_no"]))
    return (
        near.withColumn("slab", F.expr(cell_of("my", "y_level"))).join(slabs, [*on, polygon, "slab"])
        .groupBy(*group).agg(F.expr(f"count_if({crosses}) % 2 = 1 and not bool_or({on_edge}) as held"))
        .filter("held").select(*columns).distinct()
    )


def link_rings(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, ring_no, hole, edge_no, x1 .. y2)``: directed parts that close up, linked to rings.

    Where several parts leave a vertex the one furthest to the right follows, so rings touch but do not cross. A ring
    starts at its least vertex; rings that run counter-clockwise are holes. Groups of at most ``SMALL`` parts are linked
    in one row each, larger ones by joins.
    """
    rows = cut_lineage(parts.select(*keys, *XY).dropna(subset=list(keys)))
    large = _large_groups(rows, keys)
    linked = _link_small(rows.join(large, keys, "left_anti"), keys)
    return linked if large.isEmpty() else linked.unionByName(_link_large(rows.join(large, keys, "left_semi"), keys))


def _link_small(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``link_rings`` within rows that hold a group's parts; the same steps as for large groups, on places in an array."""
    ix, iy = "(p.x2 - p.x1)", "(p.y2 - p.y1)"
    ox, oy = "(q.x2 - q.x1)", "(q.y2 - q.y1)"
    turn = f"atan2({ix} * {oy} - {iy} * {ox}, {ix} * {ox} + {iy} * {oy})"
    leaving = "filter(transform(parts, (q, j) -> named_struct('x1', q.x1, 'y1', q.y1, 'x2', q.x2, 'y2', q.y2, 'j', j)), q -> q.x1 = p.x2 and q.y1 = p.y2)"
    following = f"array_min(transform({leaving}, q -> named_struct('turn', if({turn} <= -pi(), pi(), {turn}), 'ptr', q.j))).ptr"
    # m: place of the least start within the next 2**k parts, as parts are in the order of their starts; off: parts from here to it.
    first = f"transform(parts, (p, i) -> named_struct('ptr', {following}, 'm', i, 'off', bigint(0)))"
    ahead = "get(st, s.ptr)"
    step = (
        f"transform(st, s -> if({ahead}.m < s.m, named_struct('ptr', {ahead}.ptr, 'm', {ahead}.m, 'off', shiftleft(bigint(1), k) + {ahead}.off),"
        f" named_struct('ptr', {ahead}.ptr, 'm', s.m, 'off', s.off)))"
    )
    state = f"aggregate(sequence(0, cast(ceil(log2(size(parts))) as int)), first, (st, k) -> {step})"
    placed = (
        parts.groupBy(*keys).agg(F.expr(f"array_sort(collect_list(struct({', '.join(XY)}))) as parts"))
        .selectExpr("*", f"{first} as first").selectExpr(*keys, "parts", f"{state} as state")
        .selectExpr(*keys, "filter(transform(parts, (p, i) -> named_struct('p', p, 'ptr', state[i].ptr, 'm', state[i].m, 'off', state[i].off)), r -> r.ptr is not null) as state")
    )
    size = "size(filter(state, t -> t.m = s.m))"
    under = "aggregate(filter(state, t -> t.m = s.m), double(0), (a, t) -> a + (t.p.x2 - t.p.x1) * (t.p.y1 + t.p.y2) / 2)"
    ring = f"named_struct('ring_no', bigint(s.m), 'hole', {under} < 0, 'edge_no', ({size} - s.off) % {size} + 1, {', '.join(f"'{c}', s.p.{c}" for c in XY)})"
    return placed.selectExpr(*keys, f"inline(transform(state, s -> {ring}))")


def _link_large(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``link_rings`` by a join on vertices and pointer jumping; no group is gathered."""
    rows = cut_lineage(parts.withColumn("e", F.monotonically_increasing_id()))
    leaving = rows.select(*keys, F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.expr("x2 - x1 as ox"), F.expr("y2 - y1 as oy"), F.col("e").alias("ptr"))
    ix, iy = "(x2 - x1)", "(y2 - y1)"
    turn = f"atan2({ix} * oy - {iy} * ox, {ix} * ox + {iy} * oy)"
    following = rows.join(leaving, [*keys, "x2", "y2"]).withColumn("turn", F.expr(turn)).withColumn(
        "turn", F.expr("if(turn <= -pi(), pi(), turn)")  # back the way it came is the last choice
    ).groupBy("e").agg(F.min(F.struct("turn", "ptr")).alias("best"))
    first = F.struct("x1", "y1", "e").alias("m")
    state = cut_lineage(rows.join(following, "e").select("e", F.col("best.ptr").alias("ptr"), first, F.lit(0).cast("bigint").alias("off")))
    span = 1
    for _ in range(MAX_ROUNDS):
        # m: least start within the next ``span`` parts; off: parts from here to it.
        ahead = state.select(F.col("e").alias("ptr"), F.col("ptr").alias("far"), F.col("m").alias("m2"), F.col("off").alias("off2"))
        moved = F.col("m2") < F.col("m")
        state = cut_lineage(state.join(ahead, "ptr").select(
            "e", F.col("far").alias("ptr"), F.least("m", "m2").alias("m"),
            F.when(moved, F.lit(span) + F.col("off2")).otherwise(F.col("off")).alias("off"), moved.alias("moved"),
        ))
        span *= 2
        if state.filter("moved").isEmpty():
            break
        state = state.drop("moved")
    under = F.expr("(x2 - x1) * (y1 + y2) / 2")
    placed = rows.join(state.select("e", F.col("m.e").alias("ring_no"), "off"), "e")
    rings = placed.groupBy("ring_no").agg(F.count(F.lit(1)).alias("size"), (F.sum(under) < 0).alias("hole"))
    return placed.join(rings, "ring_no").select(
        *keys, "ring_no", "hole", ((F.col("size") - F.col("off")) % F.col("size") + 1).alias("edge_no"), *XY
    )


def _of_pairs(pairs: DataFrame, edges: DataFrame, on: Sequence[str], feature: str, key: str, level: str, side: int) -> DataFrame:
    """The edges of one side of each pair that reach into the common box, found by the slabs of its polygon."""
    listed = pairs.selectExpr("*", f"{cells_between('xlo', 'xhi', level)} as slab")
    slabbed = edges.selectExpr(*on, f"{feature} as {key}", *XY).join(pairs.select(*on, key, level).distinct(), [*on, key]).selectExpr(
        *on, key, *XY, f"{cells_between('least(x1, x2)', 'greatest(x1, x2)', level)} as slab"
    )
    return listed.join(slabbed, [*on, key, "slab"]).filter(
        "least(x1, x2) <= xhi and greatest(x1, x2) >= xlo and least(y1, y2) <= yhi and greatest(y1, y2) >= ylo"
        f" and {cell_of('greatest(least(x1, x2), xlo)', level)} = slab"
    ).selectExpr(*on, "l_key", "r_key", f"{side} as side", *XY)


def fragment_edges(left: DataFrame, right: DataFrame, on: Sequence[str], left_id: str, right_id: str) -> DataFrame:
    """Edge table of the polygons that each left and right polygon share, keyed by ``on, left_id, right_id``.

    Inputs are normalised edge tables of polygons that do not cross themselves. Polygons that only touch share nothing.
    A part of an edge bounds the shared polygon if it runs inside the other polygon, or along its boundary with both
    insides on the same hand.
    """
    l_head, r_head = cut_lineage(outlines(left, on, left_id)), cut_lineage(outlines(right, on, right_id))
    pairs = cut_lineage(candidate_pairs(l_head, r_head, on, left_id, right_id).selectExpr(
        *on, f"l_{left_id} as l_key", f"r_{right_id} as r_key", "l_x_level", "r_x_level",
        "greatest(l_xmin, r_xmin) as xlo", "least(l_xmax, r_xmax) as xhi", "greatest(l_ymin, r_ymin) as ylo", "least(l_ymax, r_ymax) as yhi",
    ))
    keys = [*on, "l_key", "r_key"]
    edges = cut_lineage(
        _of_pairs(pairs, left, on, left_id, "l_key", "l_x_level", 0)
        .unionByName(_of_pairs(pairs, right, on, right_id, "r_key", "r_x_level", 1)).withColumn("e", F.monotonically_increasing_id())
    )
    met = _met_pairs(edges.filter("side = 0"), edges.filter("side = 1"), edges, keys, ["side"])
    together = cut_lineage(_together(_parts(edges, _meeting_points(met, keys, ["side"]), keys, ["side"]), keys, ["side"]))
    shared = together.filter("min_side <> max_side and one_way").select(*keys, *XY)
    alone = _middles(together.filter("min_side = max_side").select(*keys, F.col("min_side").alias("side"), *XY))
    columns = [*keys, *XY]
    inside = shared
    for side, edge_table, head, feature, key in ((0, right, r_head, right_id, "r_key"), (1, left, l_head, left_id, "l_key")):
        renamed = edge_table.withColumnRenamed(feature, key)
        heads = head.withColumnRenamed(feature, key)
        near = alone.filter(F.col("side") == side).join(heads.select(*on, key, "y_level"), [*on, key])
        inside = inside.unionByName(_strictly_inside(near, renamed, heads, on, key, columns))
    return link_rings(inside, keys).withColumnsRenamed({"l_key": left_id, "r_key": right_id})


def dissolve_edges(edges: DataFrame, group: Sequence[str], feature: str) -> DataFrame:
    """Edge table of the union of each group's polygons, keyed by ``group``.

    Edges along which two polygons lie on either side cancel; parts inside another polygon of the group go; of equal
    parts one stays. ``feature`` tells the polygons of a group apart. Inputs are normalised edge tables.
    """
    keys = list(group)
    rows = cut_lineage(edges.select(*keys, F.col(feature).alias("f"), *XY).withColumn("e", F.monotonically_increasing_id()))
    met = _met_pairs(rows, rows, rows, keys, ["f"]).filter("l_f < r_f")
    together = _together(_parts(rows, _meeting_points(met, keys, ["f"]), keys, ["f"]), keys, [])
    outer = _middles(cut_lineage(together.filter("one_way").select(*keys, *XY)))
    columns = [*keys, *XY]
    polygons = edges.withColumnRenamed(feature, "f")
    heads = cut_lineage(outlines(polygons, keys, "f"))
    near = candidate_points(outer, heads, keys, "f", "mx", "my")
    covered = _strictly_inside(near, polygons, heads, keys, "f", columns)
    return link_rings(outer.select(*columns).join(covered, columns, "left_anti"), keys)


def repair_edges(edges: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Edge table of valid polygons from rings that may cross or touch themselves and each other, keyed by ``ids``.

    What lies within an odd number of rings is inside. Edges are split where they meet, parts that repeat an even number
    of times go, and every other part is turned so that the inside is on its right.
    """
    keys = list(ids)
    rows = cut_lineage(edges.select(*keys, *XY).filter("x1 <> x2 or y1 <> y2").withColumn("e", F.monotonically_increasing_id()))
    met = _met_pairs(rows, rows, rows, keys, []).filter("l_e < r_e")
    parts = cut_lineage(
        _parts(rows, _meeting_points(met, keys, []), keys, [])
        .selectExpr(*keys, "least(x1, x2) as x1", f"if({FORWARD}, y1, y2) as y1", "greatest(x1, x2) as x2", f"if({FORWARD}, y2, y1) as y2")
        .groupBy(*keys, *XY).agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").drop("n")
    )
    # The side of larger x (of larger y, for level parts) is inside if an odd number of parts lies beyond it.
    upright = _odd_beyond(parts, keys, "y1 <> y2").selectExpr(*keys, *XY, "odd = (y2 > y1) as kept")
    swapped = parts.selectExpr(*keys, "y1 as x1", "x1 as y1", "y2 as x2", "x2 as y2")
    level = _odd_beyond(swapped, keys, "y1 <> y2 and x1 = x2").selectExpr(*keys, "y1 as x1", "x1 as y1", "y2 as x2", "x2 as y2", "not odd as kept")
    turned = upright.unionByName(level).selectExpr(*keys, "if(kept, x1, x2) as x1", "if(kept, y1, y2) as y1", "if(kept, x2, x1) as x2", "if(kept, y2, y1) as y2")
    return link_rings(turned, keys)


def _odd_beyond(parts: DataFrame, keys: Sequence[str], which: str) -> DataFrame:
    """``(keys, x1 .. y2, odd)`` of the chosen parts: whether an odd number of others crosses its middle's height at larger x."""
    columns = [*keys, *XY]
    numbered = parts.withColumn("f", F.lit(0)).withColumn("ring_no", F.lit(0))
    heads = outlines(numbered, keys, "f")
    slabs = y_slabs(numbered, heads, keys, "f").withColumnsRenamed({c: f"p_{c}" for c in XY}).drop("f")
    chosen = _middles(parts.filter(which)).join(heads.select(*keys, "y_level"), keys).withColumn("slab", F.expr(cell_of("my", "y_level")))
    itself = " and ".join(f"{c} = p_{c}" for c in XY)
    beyond = f"(p_y1 > my) <> (p_y2 > my) and mx < (p_x2 - p_x1) * (my - p_y1) / nullif(p_y2 - p_y1, 0) + p_x1 and not ({itself})"
    return chosen.join(slabs, [*keys, "slab"]).groupBy(*columns).agg(F.expr(f"count_if({beyond}) % 2 = 1 as odd"))

