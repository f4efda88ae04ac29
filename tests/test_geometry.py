"""Geometry operators: dissolve, stitching, simplification, projection, bbox."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from lotlens.functions import geo
from lotlens.operators import geometry, layers

GEOM = "array<array<array<struct<x:double,y:double>>>>"


def sq(x0, y0, s=1.0):
    return [[{"x": x0, "y": y0}, {"x": x0 + s, "y": y0}, {"x": x0 + s, "y": y0 + s},
             {"x": x0, "y": y0 + s}, {"x": x0, "y": y0}]]


def frame(spark, rows):
    return spark.createDataFrame([(g, [poly]) for g, poly in rows], f"g string, geometry {GEOM}")


def rings_of(df):
    return {r.g: r.geometry for r in df.collect()}


def area(geom):
    total = 0.0
    for part in geom:
        for ring in part:
            pts = [(p.x, p.y) for p in ring]
            total += sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(pts[:-1], pts[1:])) / 2
    return total


def test_grid_edge_counts(spark):
    cells = layers.commune_cells(spark, "/root/testdata/sf0.1")
    e = geometry.edges(cells, ["insee"])
    assert e.count() == 4000
    assert geometry.undirected(e).select("ux1", "uy1", "ux2", "uy2").distinct().count() == 2090
    everything = geometry.boundary_edges(cells.withColumn("g", F.lit(1)), ["g"])
    assert everything.count() == 180
    depts = geometry.boundary_edges(cells.select("dept", "geometry"), ["dept"])
    assert depts.count() == 900


def test_dissolve_two_squares_and_hole(spark):
    # 3x3 block minus the centre -> one polygon with one hole
    ring = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    df = frame(spark, [("a", sq(float(x), float(y))) for x, y in ring])
    g = rings_of(geometry.dissolve(df, ["g"]))["a"]
    assert len(g) == 1 and len(g[0]) == 2
    assert area(g) == pytest.approx(8.0)


def test_dissolve_touching_at_a_vertex(spark):
    df = frame(spark, [("a", sq(0.0, 0.0)), ("a", sq(1.0, 1.0))])
    g = rings_of(geometry.dissolve(df, ["g"]))["a"]
    assert len(g) == 2 and all(len(p) == 1 for p in g)
    assert area(g) == pytest.approx(2.0)


def test_dissolve_keeps_clockwise_input_right(spark):
    cw = [list(reversed(sq(0.0, 0.0)[0]))]
    df = frame(spark, [("a", cw), ("a", sq(1.0, 0.0))])
    g = rings_of(geometry.dissolve(df, ["g"]))["a"]
    assert len(g) == 1 and area(g) == pytest.approx(2.0)


def test_simplify_square_with_midpoints_and_collapse(spark):
    cells = layers.commune_cells(spark, SF01).limit(3)
    out = geometry.simplify(cells, 30.0).select(F.size(F.col("geometry")[0][0]).alias("n")).collect()
    assert {r.n for r in out} == {5}
    # a ring far smaller than the tolerance never collapses below 4 points
    tiny = [[{"x": 0.0, "y": 0.0}, {"x": 0.1, "y": 0.0}, {"x": 0.2, "y": 0.05}, {"x": 0.1, "y": 0.1},
             {"x": 0.0, "y": 0.1}, {"x": 0.0, "y": 0.0}]]
    df = frame(spark, [("t", tiny)])
    g = geometry.simplify(df, 1500.0).first().geometry[0][0]
    assert len(g) == 4 and (g[0].x, g[0].y) == (g[-1].x, g[-1].y)


def test_simplify_null_and_empty_geometries(spark):
    df = spark.createDataFrame([("n", None), ("e", [])], f"g string, geometry {GEOM}")
    out = {r.g: r.geometry for r in geometry.simplify(df, 10.0).collect()}
    assert out == {"n": None, "e": []}


def test_dp_keeps_points_beyond_tolerance():
    xs = np.array([0.0, 1.0, 2.0, 3.0, 4.0, 0.0])
    ys = np.array([0.0, 0.1, -0.1, 5.0, 0.0, 0.0])
    keep = geometry._dp_keep(xs, ys, 0.5)
    assert keep[0] and keep[-1] and keep[3] and not keep[1]


def test_projection_check_points(spark):
    r = spark.range(1).select(
        geo.lambert93_to_lonlat(F.lit(700000.0), F.lit(6600000.0)).alias("a"),
        geo.lambert93_to_lonlat(F.lit(652301.5648), F.lit(6861302.7259)).alias("b"),
        geo.lonlat_to_lambert93(F.lit(2.35), F.lit(48.85)).alias("c")).first()
    assert r.a.x == pytest.approx(3.0, abs=1e-9) and r.a.y == pytest.approx(46.5, abs=1e-9)
    assert r.b.x == pytest.approx(2.35, abs=1e-8) and r.b.y == pytest.approx(48.85, abs=1e-8)
    assert r.c.x == pytest.approx(652301.5648, abs=1e-3) and r.c.y == pytest.approx(6861302.7259, abs=1e-3)


def test_round_trip_projection(spark):
    df = spark.range(50).select((F.lit(-4.0) + F.col("id") * 0.2).alias("lon"), (F.lit(42.0) + F.col("id") * 0.15).alias("lat"))
    p = df.select("lon", "lat", geo.lonlat_to_lambert93(F.col("lon"), F.col("lat")).alias("m"))
    back = p.select("lon", "lat", geo.lambert93_to_lonlat(F.col("m.x"), F.col("m.y")).alias("b"))
    for r in back.collect():
        assert abs(r.b.x - r.lon) < 1e-9 and abs(r.b.y - r.lat) < 1e-9


def test_round_coordinates_half_even(spark):
    df = frame(spark, [("a", [[{"x": 1.234565, "y": 2.0}]])])
    r = df.select(geo.round_coordinates(F.col("geometry"), 5).alias("g")).first().g
    assert r[0][0][0].y == 2.0


def test_department_bbox_is_40_by_50_km(spark):
    cells = layers.commune_cells(spark, "/root/testdata/sf0.1")
    d = layers.department_layer(cells).select(geo.bbox(F.col("geometry")).alias("b")).collect()
    assert {(r.b.maxx - r.b.minx, r.b.maxy - r.b.miny) for r in d} == {(40000.0, 50000.0)}


def test_single_pass_layers_equal_stepwise(spark):
    from lotlens.functions.geo import ring_area2

    def summary(df):
        rings = df.select("level", "code", "name", F.explode(F.flatten("geometry")).alias("r"))
        return sorted(map(tuple, rings.groupBy("level", "code", "name")
                          .agg(F.sum(ring_area2(F.col("r"))).alias("a"), F.sum(F.size("r")).alias("n")).collect()))
    assert summary(layers.all_layers(spark, SF01).where("level <> 'postcode'")) == summary(layers.all_layers_stepwise(spark, SF01))


def test_shared_border_simplified_once(spark):
    # two polygons sharing a wiggly border, listed from different start points
    border = [(10.0, float(y), ) for y in range(0, 11)]
    wig = [(10.0 + (0.4 if y % 2 else -0.4), float(y)) for y in range(0, 11)]
    wig[0], wig[-1] = (10.0, 0.0), (10.0, 10.0)
    left = [(0.0, 0.0)] + wig + [(0.0, 10.0), (0.0, 0.0)]
    right = [(20.0, 5.0), (20.0, 10.0)] + wig[::-1] + [(20.0, 0.0), (20.0, 5.0)]

    def poly(pts):
        return [[{"x": x, "y": y} for x, y in pts]]
    df = spark.createDataFrame([("L", [poly(left)]), ("R", [poly(right)])],
                               f"code string, geometry {GEOM}").withColumn("level", F.lit("x"))
    out = {r.code: r.geometry for r in geometry.simplify_shared(df, 0.5, ["level"]).collect()}

    def edge_set(g):
        pts = [(p.x, p.y) for p in g[0][0]]
        return {tuple(sorted((a, b))) for a, b in zip(pts[:-1], pts[1:])}
    shared = edge_set(out["L"]) & edge_set(out["R"])
    # the simplified border is identical on both sides: one straight edge
    assert shared == {((10.0, 0.0), (10.0, 10.0))}
    for g in out.values():
        ring = g[0][0]
        assert (ring[0].x, ring[0].y) == (ring[-1].x, ring[-1].y) and len(ring) >= 4


def test_shared_simplify_keeps_grid_cells(spark):
    cells = layers.commune_cells(spark, SF01).select(F.lit("commune").alias("level"),
                                                      F.col("insee").alias("code"), "geometry")
    a = {r.code: r.geometry for r in geometry.simplify(cells, 30.0).collect()}
    b = {r.code: r.geometry for r in geometry.simplify_shared(cells, 30.0, ["level"]).collect()}
    assert a == b


def test_published_departments_still_share_borders(spark):
    lay = layers.all_layers(spark, "/root/testdata/sf0.1").where(F.col("level") == "departement")
    simp = geometry.simplify_shared(lay, geometry.tolerance_for(F.col("level")), ["level"])
    e = geometry.undirected(geometry.edges(simp, ["code"]))
    counts = e.groupBy("ux1", "uy1", "ux2", "uy2").count()
    lonely = counts.where(F.col("count") == 1).collect()
    outer = lambda r: (r.ux1 == r.ux2 and r.ux1 in (600000.0, 800000.0)) or \
        (r.uy1 == r.uy2 and r.uy1 in (6500000.0, 6750000.0))
    assert lonely and all(outer(r) for r in lonely)


def test_simplify_deals_a_single_split_to_all_workers(spark):
    wiggle = [(0.0, 0.0), (50.0, -0.2), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0), (0.0, 0.0)]
    rows = [("commune", str(i), [[[(x + 200.0 * i, y) for x, y in wiggle]]]) for i in range(40)]
    schema = "level string, code string, geometry array<array<array<struct<x:double,y:double>>>>"
    df = spark.createDataFrame(rows, schema).coalesce(1)
    for got in (geometry.simplify(df, 0.5), geometry.simplify_shared(df, 0.5, ["level"])):
        assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert [len(r.geometry[0][0]) for r in got.collect()] == [5] * 40


def test_many_lines_at_once_are_split_like_each_alone():
    rng = np.random.default_rng(5)
    sizes = np.array([6, 40, 5, 300, 9, 2000])
    xs, ys = rng.integers(0, 30, sizes.sum()).astype(float), rng.normal(0, 3, sizes.sum())
    s = np.cumsum(sizes) - sizes
    keep = np.zeros(len(xs), dtype=bool)
    geometry._split_keep_all(xs, ys, s, s + sizes - 1, np.full(len(s), 2.0), keep)
    alone = [geometry._split_keep(xs[a:a + n], ys[a:a + n], 2.0) for a, n in zip(s, sizes)]
    assert (keep == np.concatenate(alone)).all() and 0 < keep.sum() < len(keep)
