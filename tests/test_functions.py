"""Scalar functions (colour, tiles, department prefix) and the bucketed range join."""

import math
import random

from pyspark.sql import functions as F

from lotlens.functions import geo
from lotlens.functions.expressions import dept_of_commune, price_color
from lotlens.operators import tiles, viewport


def test_price_color_stops_clamp_and_missing(spark):
    df = spark.createDataFrame([(500.0,), (1000.0,), (4000.0,), (12000.0,), (99999.0,), (None,)], "p double")
    got = [r.c for r in df.select(price_color(F.col("p")).alias("c")).collect()]
    assert got == ["#27ae60", "#27ae60", "#f1c40f", "#ff0000", "#ff0000", "#aebd2a"]


def test_slippy_tiles_match_the_formula(spark):
    pts = [(2.35, 48.85, 12), (-4.5, 43.2, 7), (0.0, 0.0, 0), (7.7, 51.0, 15)]
    df = spark.createDataFrame(pts, "lon double, lat double, z int")
    got = df.select(geo.tile_x(F.col("lon"), F.col("z")).alias("x"), geo.tile_y(F.col("lat"), F.col("z")).alias("y")).collect()
    for (lon, lat, z), r in zip(pts, got):
        n = 2 ** z
        x = int((lon + 180) / 360 * n)
        y = int((1 - math.log(math.tan(math.radians(lat)) + 1 / math.cos(math.radians(lat))) / math.pi) / 2 * n)
        assert (r.x, r.y) == (min(x, n - 1), min(y, n - 1))


def test_layer_for_zoom_ranges(spark):
    df = spark.range(0, 18).select(F.col("id").cast("int").alias("z"))
    got = {r.z: r.l for r in df.select("z", tiles.layer_for_zoom(F.col("z")).alias("l")).collect()}
    assert got[0] == "country" and got[4] == "country" and got[5] == "regions" and got[8] == "departements"
    assert got[10] == "cantons" and got[11] == "communes" and got[16] == "communes" and got[17] is None


def test_dept_prefix(spark):
    df = spark.createDataFrame([("75101",), ("971101",), ("98735",), ("2A004",)], "c string")
    assert [r[0] for r in df.select(dept_of_commune(F.col("c"))).collect()] == ["75", "971", "987", "2A"]


def test_overlap_join_equals_brute_force(spark):
    rnd = random.Random(11)

    def rects(n, size):
        out = []
        for i in range(n):
            x, y = rnd.uniform(0, 200), rnd.uniform(0, 200)
            out.append((i, x, y, x + rnd.uniform(0, size), y + rnd.uniform(0, size)))
        return out
    a, b = rects(200, 30), rects(120, 60)
    # exact touches (closed overlap) must count
    a.append((999, 0.0, 0.0, 10.0, 10.0))
    b.append((999, 10.0, 10.0, 20.0, 20.0))
    left = spark.createDataFrame(a, "lid int, w double, s double, e double, n double")
    right = spark.createDataFrame(b, "rid int, minx double, miny double, maxx double, maxy double")
    got = {(r.lid, r.rid) for r in viewport.overlap_join(left, right, ("w", "s", "e", "n"),
                                                         ("minx", "miny", "maxx", "maxy"), 25.0)
           .select("lid", "rid").collect()}
    want = {(la[0], rb[0]) for la in a for rb in b
            if rb[3] >= la[1] and rb[1] <= la[3] and rb[4] >= la[2] and rb[2] <= la[4]}
    assert got == want and (999, 999) in got


def test_overlap_join_mixed_sizes_bounded_replication(spark):
    rnd = random.Random(5)
    a = []
    for i in range(150):
        x, y = rnd.uniform(0, 1000), rnd.uniform(0, 1000)
        w = rnd.choice([5.0, 40.0, 300.0, 900.0])  # zoomed-in to zoomed-out viewports
        a.append((i, x, y, x + w, y + w))
    b = [(j, x, y, x + 20.0, y + 25.0) for j, (x, y) in enumerate((rnd.uniform(0, 1000), rnd.uniform(0, 1000))
                                                                for _ in range(80))]
    left = spark.createDataFrame(a, "lid int, w double, s double, e double, n double")
    right = spark.createDataFrame(b, "rid int, minx double, miny double, maxx double, maxy double")
    got = {(r.lid, r.rid) for r in viewport.overlap_join(left, right, ("w", "s", "e", "n"),
                                                         ("minx", "miny", "maxx", "maxy"), 25.0, levels=7)
           .select("lid", "rid").collect()}
    want = {(la[0], rb[0]) for la in a for rb in b
            if rb[3] >= la[1] and rb[1] <= la[3] and rb[4] >= la[2] and rb[2] <= la[4]}
    assert got == want
    # every left rectangle is bucketed into at most 2 x 2 cells
    lv = viewport._own_level("w", "s", "e", "n", 25.0, 7)
    cells = viewport._cells(left.withColumn("_lv", lv), "w", "s", "e", "n",
                            F.lit(25.0) * F.pow(F.lit(2.0), F.col("_lv")))
    assert cells.groupBy("lid").count().agg(F.max("count")).first()[0] <= 4


def test_salted_cap_equals_plain_window(spark):
    from pyspark.sql import Window
    from lotlens.operators.parcels import cap_per_group
    # one department holds most rows (skew); ids are unique per row
    df = spark.range(20000).select(
        F.when(F.col("id") % 10 < 7, F.lit("75")).otherwise((F.col("id") % 5).cast("string")).alias("dept"),
        F.format_string("%08d", (F.col("id") * 7919) % 1000003).alias("id"),
        F.lit("n").alias("name"))
    got = {tuple(r) for r in cap_per_group(df, "dept", ["id", "name"], 37, salt_buckets=16).collect()}
    w = Window.partitionBy("dept").orderBy("id", "name")
    want = {tuple(r) for r in df.withColumn("_rn", F.row_number().over(w)).where("_rn <= 37").drop("_rn").collect()}
    assert got == want and len(got) == 37 * 4


def test_fixed_values_stated_once_more(spark):
    """Literals that the SQL side shares with the code, checked here on their own."""
    from lotlens import params
    from lotlens.functions.expressions import price_color
    from lotlens.functions.geo import lambert93_to_lonlat
    # the projection's origin, by its public definition, and the Pantheon in Paris to a metre or so
    pts = spark.createDataFrame([(700000.0, 6600000.0), (652391.0, 6861029.0)], "x double, y double")
    ll = [r.p for r in pts.select(lambert93_to_lonlat(F.col("x"), F.col("y")).alias("p")).collect()]
    assert abs(ll[0].x - 3.0) < 1e-9 and abs(ll[0].y - 46.5) < 1e-6
    assert abs(ll[1].x - 2.351) < 0.02 and abs(ll[1].y - 48.847) < 0.02
    assert len(params.DEPT_TO_REGION) == 101 and "20" not in params.DEPT_TO_REGION
    assert [params.DEPT_TO_REGION[d] for d in ("75", "2A", "13", "69", "974")] == ["11", "94", "93", "84", "04"]
    assert params.SIMPLIFY_TOLERANCE == {"country": 1500.0, "region": 300.0, "departement": 150.0, "canton": 100.0,
                                         "commune": 30.0, "arrondissement": 30.0}
    assert params.PARCEL_SIMPLIFY_TOLERANCE == 0.5 and params.COORD_PRECISION == 5
    colors = spark.createDataFrame([(1000.0,), (4000.0,), (12000.0,), (2500.0,)], "p double")
    got = [r.c for r in colors.select(price_color(F.col("p")).alias("c")).collect()]
    assert got[:3] == ["#27ae60", "#f1c40f", "#ff0000"] and got[3] == "#8cb938"
    d = params.DEFAULT
    assert (d.min_price_m2, d.max_price_m2, d.min_sales, d.sale_nature) == (100.0, 50000.0, 5, "Vente")
