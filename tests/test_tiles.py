"""Thinning of dense features: against brute force, budget and monotony."""
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from lotlens.operators import tiles


def tile(lon, lat, z):
    n = 2 ** z
    r = math.radians(lat)
    return int((lon + 180) / 360 * n), int((1 - math.log(math.tan(r) + 1 / math.cos(r)) / math.pi) / 2 * n)


def curve(x, y):
    return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(20))


def test_first_zooms_equal_brute_force_and_what_is_shown_stays(spark):
    rng = random.Random(4)
    rows = []
    for k in range(400):  # a city, its surroundings, and equal places
        s = rng.choice([0.002, 0.05, 1.0])
        lon, lat = (2.35, 48.85) if k % 40 == 0 else (2.35 + rng.gauss(0, s), 48.85 + rng.gauss(0, s))
        rows.append(("a" if k % 4 else "b", f"c{k}", lon, lat))
    df = spark.createDataFrame(rows, "layer string, code string, lon double, lat double").repartition(6)
    point = F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))
    df = df.select("layer", "code", F.array(F.array(F.array(point, point, point, point))).alias("geometry"))
    df = df.unionByName(df.limit(1).select(F.lit("a").alias("layer"), F.lit("null").alias("code"),
                                           F.lit(None).cast(df.schema["geometry"].dataType).alias("geometry")))
    low, high, budget = 6, 14, 5
    got = {(r.layer, r.code): r.first_zoom for r in tiles.first_zooms(df, F.lit(low), F.lit(high), budget).collect()}

    want, gap = {}, {}
    for layer in "ab":
        placed = sorted((curve(*tile(lon, lat, 20)), code, lon, lat) for la, code, lon, lat in rows if la == layer)
        for i, (c, code, *_) in enumerate(placed):
            gap[layer, code] = math.inf if i == 0 else c - placed[i - 1][0]
        for z in range(high, low - 1, -1):
            for _, code, lon, lat in placed:
                own = sorted((-gap[layer, o], o) for _, o, x, y in placed if tile(x, y, z) == tile(lon, lat, z))
                if z == high or own.index((-gap[layer, code], code)) < budget:
                    want[layer, code] = z
    assert got == want and len(set(want.values())) > 5
    for z in range(low, high):
        shown = Counter((la, tile(lon, lat, z)) for la, code, lon, lat in rows if got[la, code] <= z)
        assert max(shown.values()) <= budget
    assert max(got.values()) == high


def test_no_features_and_one_zoom(spark):
    none = spark.createDataFrame([], "layer string, code string, geometry array<array<array<struct<x:double,y:double>>>>")
    assert tiles.first_zooms(none, F.lit(3), F.lit(9), 2).collect() == []
    one = spark.createDataFrame([("a", "x", [[[(2.0, 48.0)] * 4]])], none.schema)
    assert [tuple(r) for r in tiles.first_zooms(one, F.lit(9), F.lit(9), 2).collect()] == [("a", "x", 9)]
