"""Two equal-area projections from longitude/latitude degrees, one with its inverse, as native column expressions.

The formulas are the standard closed forms (Snyder, Map Projections - A Working Manual). Source coordinates stay beside the
projected ones; the inverse is for vertices that only arise in the plane, such as those of shared polygons.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Conterminous US Albers on GRS80, and the spherical US national atlas azimuthal projection.
GRS80_AXIS, GRS80_FLATTENING = 6378137.0, 1 / 298.257222101
ALBERS_PARALLELS, ALBERS_ORIGIN = (29.5, 45.5), (-96.0, 23.0)
ATLAS_RADIUS, ATLAS_ORIGIN = 6370997.0, (-100.0, 45.0)


def _q(sin_lat: float, e: float) -> float:
    return (1 - e * e) * (sin_lat / (1 - (e * sin_lat) ** 2) + math.atanh(e * sin_lat) / e)


def _albers_cone() -> tuple[float, float, float, float, float]:
    """Eccentricity squared and plain, the cone's constants and the radius of the origin's parallel."""
    e2 = GRS80_FLATTENING * (2 - GRS80_FLATTENING)
    e = math.sqrt(e2)
    sin1, sin2, sin0 = (math.sin(math.radians(d)) for d in (*ALBERS_PARALLELS, ALBERS_ORIGIN[1]))
    m1_squared, m2_squared = ((1 - s * s) / (1 - e2 * s * s) for s in (sin1, sin2))
    n = (m1_squared - m2_squared) / (_q(sin2, e) - _q(sin1, e))
    c = m1_squared + n * _q(sin1, e)
    rho0 = GRS80_AXIS * math.sqrt(c - n * _q(sin0, e)) / n
    return e2, e, n, c, rho0


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Ellipsoidal Albers conic (EPSG:5070) in metres."""
    e2, e, n, c, rho0 = _albers_cone()
    s = F.sin(F.radians(lat))
    atanh = F.log((1 + e * s) / (1 - e * s)) / (2 * e)
    q = (1 - e2) * (s / (1 - e2 * s * s) + atanh)
    rho = GRS80_AXIS * F.sqrt(c - n * q) / n
    theta = n * F.radians(lon - ALBERS_ORIGIN[0])
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def albers_inverse(x: Column, y: Column, rounds: int = 6) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a point that ``albers`` gave.

    The latitude starts from the series of the authalic one and is corrected ``rounds`` times, each time by the error of
    its equal-area function over its slope; away from the poles the error is squared each time.
    """
    e2, e, n, c, rho0 = _albers_cone()
    up = F.lit(rho0) - y
    rho = F.sqrt(x * x + up * up)
    theta = F.atan2(x, up)
    q = (F.lit(c) - (rho * n / GRS80_AXIS) ** 2) / n
    beta = F.asin(q / _q(1.0, e))
    lat = (
        beta + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(2 * beta)
        + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(4 * beta) + (761 * e2**3 / 45360) * F.sin(6 * beta)
    )

    def corrected(found: Column, target: Column) -> Column:
        s = F.sin(found)
        inner = 1 - e2 * s * s
        error = target / (1 - e2) - s / inner - F.log((1 + e * s) / (1 - e * s)) / (2 * e)
        return found + inner * inner / (2 * F.cos(found)) * error

    better = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), lat, lambda found, _: corrected(found, q))
    return F.degrees(theta / n) + ALBERS_ORIGIN[0], F.degrees(better)


def azimuthal(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical Lambert azimuthal equal-area (EPSG:2163) in metres."""
    lon0, lat0 = ATLAS_ORIGIN
    sin0, cos0 = math.sin(math.radians(lat0)), math.cos(math.radians(lat0))
    turn, up = F.radians(lon - lon0), F.radians(lat)
    k = F.sqrt(2 / (1 + sin0 * F.sin(up) + cos0 * F.cos(up) * F.cos(turn)))
    x = ATLAS_RADIUS * k * F.cos(up) * F.sin(turn)
    y = ATLAS_RADIUS * k * (cos0 * F.sin(up) - sin0 * F.cos(up) * F.cos(turn))
    return x, y


def project_points(points: DataFrame, projection, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    px, py = projection(F.col(lon), F.col(lat))
    return points.withColumns({x: px, y: py})


def project_edges(edges: DataFrame, projection) -> DataFrame:
    """Project both ends of every edge; the source coordinates are kept as ``lon1, lat1, lon2, lat2``."""
    kept = edges.withColumnsRenamed({"x1": "lon1", "y1": "lat1", "x2": "lon2", "y2": "lat2"})
    first, second = (projection(F.col(f"lon{i}"), F.col(f"lat{i}")) for i in (1, 2))
    return kept.withColumns({"x1": first[0], "y1": first[1], "x2": second[0], "y2": second[1]})
