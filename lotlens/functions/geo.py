"""Geometry column expressions (native Spark higher-order functions).

A geometry is a MultiPolygon stored as
``array<array<array<struct<x:double,y:double>>>>`` (parts -> rings -> points);
ring 0 of a part is its exterior, the others are holes; rings are closed.
All functions here stay inside Catalyst (no Python), so they run in
whole-stage code generation on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotlens.params import (GRS80_INV_F, LAMBERT93_C, LAMBERT93_LON0_DEG, LAMBERT93_N, LAMBERT93_X0,
                            LAMBERT93_YS)

POINT_TYPE = "struct<x:double,y:double>"
RING_TYPE = f"array<{POINT_TYPE}>"
GEOM_TYPE = f"array<array<{RING_TYPE}>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def map_points(geom: Column, fn) -> Column:
    """Apply ``fn(point) -> point`` to every vertex of a MultiPolygon."""
    return F.transform(geom, lambda part: F.transform(part, lambda ring: F.transform(ring, fn)))


def round_coordinates(geom: Column, precision: int = 5) -> Column:
    """Half-even rounding of every coordinate (any nesting of the MultiPolygon)."""
    return map_points(geom, lambda p: point(F.bround(p["x"], precision), F.bround(p["y"], precision)))


def ring_area2(ring: Column) -> Column:
    """Twice the signed shoelace area of a closed ring (CCW > 0)."""
    n = F.size(ring)
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        F.lit(0.0),
        lambda acc, i: acc + F.when(
            i < n,
            F.element_at(ring, i)["x"] * F.element_at(ring, i + 1)["y"]
            - F.element_at(ring, i + 1)["x"] * F.element_at(ring, i)["y"]).otherwise(F.lit(0.0)))


def orient(geom: Column) -> Column:
    """Exterior rings counter-clockwise, holes clockwise."""
    def fix_part(part):
        return F.transform(part, lambda ring, i: F.when(
            ((i == 0) & (ring_area2(ring) < 0)) | ((i > 0) & (ring_area2(ring) > 0)),
            F.reverse(ring)).otherwise(ring))
    return F.transform(geom, fix_part)


def all_points(geom: Column) -> Column:
    """Flat array of every vertex."""
    return F.flatten(F.flatten(geom))


def bbox(geom: Column) -> Column:
    """struct(minx, miny, maxx, maxy) of a geometry (NULL for NULL/empty)."""
    pts = all_points(geom)
    xs = F.transform(pts, lambda p: p["x"])
    ys = F.transform(pts, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
                    F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


# --- Lambert-93 (EPSG:2154) <-> WGS84 lon/lat, closed form on GRS80 ----------

_F = 1.0 / GRS80_INV_F
_E = math.sqrt(2 * _F - _F * _F)
_LON0 = math.radians(LAMBERT93_LON0_DEG)


def _lat_from_t(t: Column) -> Column:
    """Latitude from the isometric quantity t, 5 fixed-point iterations."""
    phi0 = F.lit(math.pi / 2) - 2 * F.atan(t)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(5)), phi0,
        lambda phi, _i: F.lit(math.pi / 2) - 2 * F.atan(
            t * F.pow((1 - F.lit(_E) * F.sin(phi)) / (1 + F.lit(_E) * F.sin(phi)), F.lit(_E / 2))))


def lambert93_to_lonlat(x: Column, y: Column) -> Column:
    """Inverse Lambert conformal conic: metres -> struct(x=lon°, y=lat°). Always lon first."""
    dx = x - F.lit(LAMBERT93_X0)
    dy = F.lit(LAMBERT93_YS) - y
    r = F.sqrt(dx * dx + dy * dy)
    gamma = F.atan2(dx, dy)
    lon = F.lit(_LON0) + gamma / F.lit(LAMBERT93_N)
    t = F.pow(r / F.lit(LAMBERT93_C), F.lit(1.0 / LAMBERT93_N))
    return point(F.degrees(lon), F.degrees(_lat_from_t(t)))


def lonlat_to_lambert93(lon_deg: Column, lat_deg: Column) -> Column:
    """Forward projection (for round-trip checks): degrees -> struct(x, y) metres."""
    lat = F.radians(lat_deg)
    es = F.lit(_E) * F.sin(lat)
    t = F.tan(F.lit(math.pi / 4) - lat / 2) / F.pow((1 - es) / (1 + es), F.lit(_E / 2))
    r = F.lit(LAMBERT93_C) * F.pow(t, F.lit(LAMBERT93_N))
    theta = F.lit(LAMBERT93_N) * (F.radians(lon_deg) - F.lit(_LON0))
    return point(F.lit(LAMBERT93_X0) + r * F.sin(theta), F.lit(LAMBERT93_YS) - r * F.cos(theta))


def to_wgs84(geom: Column) -> Column:
    return map_points(geom, lambda p: lambert93_to_lonlat(p["x"], p["y"]))


# --- slippy-map tiles --------------------------------------------------------

def tile_x(lon: Column, z: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    return F.least(F.floor((lon + 180.0) / 360.0 * n), n - 1).cast("int")


def tile_y(lat: Column, z: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    lat_r = F.radians(lat)
    y = (1.0 - F.ln(F.tan(lat_r) + 1.0 / F.cos(lat_r)) / F.lit(math.pi)) / 2.0 * n
    return F.least(F.greatest(F.floor(y), F.lit(0.0)), n - 1).cast("int")
