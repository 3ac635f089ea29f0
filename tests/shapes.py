"""Small polygons for tests, and slow independent geometry to check against."""

POLYGONS = "array<array<array<struct<x: double, y: double>>>>"


def features(spark, rows):
    """``rows``: (city, id, [polygon, ...]); a polygon is a list of rings, a ring a list of (x, y)."""
    def floats(rings):
        return [[(float(x), float(y)) for x, y in ring] for ring in rings]

    rows = [(city, i, None if parts is None else [floats(rings) for rings in parts]) for city, i, parts in rows]
    return spark.createDataFrame(rows, f"city string, id bigint, polygons {POLYGONS}")


def edges(spark, rows, name="id"):
    from zoneloom.operators.edges import normalize_rings, polygon_edges

    table = features(spark, rows).withColumnRenamed("id", name)
    return normalize_rings(polygon_edges(table, ["city", name], "polygons"), ["city", name])


def box(x0, y0, x1, y1):
    return [(x0, y0), (x0, y1), (x1, y1), (x1, y0)]


def ring_area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def clip_area(subject, convex):
    """Area of a polygon within a convex counter-clockwise one, by cutting off half planes."""
    for (ax, ay), (bx, by) in zip(convex, convex[1:] + convex[:1]):
        kept = []
        for p, q in zip(subject, subject[1:] + subject[:1]):
            side_p, side_q = ((bx - ax) * (r[1] - ay) - (by - ay) * (r[0] - ax) for r in (p, q))
            if side_p >= 0:
                kept.append(p)
            if side_p * side_q < 0:
                t = side_p / (side_p - side_q)
                kept.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        subject = kept
        if not subject:
            return 0.0
    return abs(ring_area(subject))


def holds(rings, x, y):
    """Even-odd test over all rings, boundary included."""
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return True
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd
