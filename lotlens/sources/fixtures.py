"""Adapter that gives the TPC-H-shaped test tables the shape of sale data.

One lot per ``lineitem`` row; an order is a sale whose total price repeats on
each of its lots (the multi-lot problem of the real files).  Every derived
table (lots, the commune->canton map, the commune grid, parcels, viewports)
is computed by Spark from the given tables, so its size follows theirs.
The DuckDB oracle in ``lotlens.plans.oracle`` uses the same expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.params import PLM


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dept_from_nation(nationkey: Column) -> Column:
    """c_nationkey 22 -> '69', 23 -> '75', 24 -> '971', else lpad(key+1, 2)."""
    return (F.when(nationkey == 22, F.lit("69"))
            .when(nationkey == 23, F.lit("75"))
            .when(nationkey == 24, F.lit("971"))
            .otherwise(F.lpad((nationkey + 1).cast("string"), 2, "0")))


def commune_from_customer(custkey: Column, nationkey: Column) -> Column:
    """custkey % 20 + 1, shifted into the arrondissement ranges for PLM."""
    base = (custkey % 20 + 1).cast("int")
    return (F.when(nationkey == 12, base + 200)
            .when(nationkey == 22, base + 380)
            .when(nationkey.isin(23, 24), base + 100)
            .otherwise(base))


def customer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: department, commune number, postcode, commune name."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    dept = dept_from_nation(F.col("c_nationkey"))
    commune = commune_from_customer(F.col("c_custkey"), F.col("c_nationkey"))
    return c.select(
        "c_custkey",
        "c_nationkey",
        dept.alias("code_departement"),
        commune.alias("code_commune"),
        F.concat(dept, F.lpad(((F.col("c_custkey") % 5) * 10).cast("string"), 3, "0")).alias("code_postal"),
        F.concat(F.lit("COMMUNE "), dept, F.lit("-"), commune.cast("string")).alias("commune"),
    )


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lot table L (one row per lineitem), canonical snake_case names."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                             "o_totalprice", "o_orderdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    places = customer_places(spark, sf_dir)

    sale = o.join(places, o.o_custkey == places.c_custkey)
    joined = li.join(p, li.l_partkey == p.p_partkey).join(sale, li.l_orderkey == sale.o_orderkey)
    type_local = (F.when(F.col("l_linenumber") == 7, F.lit("Dependance"))
                  .when(F.col("p_type") == "PROMO", F.lit("Local industriel"))
                  .when(F.col("p_type").isin("LARGE", "MEDIUM"), F.lit("Maison"))
                  .otherwise(F.lit("Appartement")))
    return joined.select(
        F.col("o_orderdate").cast("date").alias("date_mutation"),
        (F.col("o_orderkey") % 3 + 1).cast("int").alias("no_disposition"),
        F.when(F.col("o_orderstatus") == "P", F.lit("Adjudication")).otherwise(F.lit("Vente")).alias("nature_mutation"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("valeur_fonciere"),
        "code_departement",
        "code_commune",
        "code_postal",
        "commune",
        type_local.alias("type_local"),
        F.when(F.col("l_linenumber") == 7, F.lit(None))
         .otherwise(F.col("l_quantity")).cast("decimal(18,2)").alias("surface_reelle_bati"),
    )


def insee_of(dept: Column, commune_no: Column) -> Column:
    return F.concat(dept, F.lpad(commune_no.cast("string"), 3, "0"))


def commune_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct communes present in the data, with their grid indices.

    di = c_nationkey (department index 0..24), k = (c_custkey % 20)
    (commune index 0..19).  Output: di, k, dept, insee.
    """
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    cells = c.select(F.col("c_nationkey").alias("di"), (F.col("c_custkey") % 20).cast("int").alias("k")).distinct()
    dept = dept_from_nation(F.col("di"))
    commune = commune_from_customer(F.col("k"), F.col("di"))
    return cells.select("di", "k", dept.alias("dept"), insee_of(dept, commune).alias("insee"))


def commune_to_canton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commune -> canton map (insee, canton_code) of the communes in the data.

    PLM departments (di 12, 22, 23) carry no canton; k = 19 has a NULL canton
    (dropped, as rows with a missing canton are); the three PLM parents map to
    their pseudo-cantons.
    """
    cells = commune_cells(spark, sf_dir)
    regular = (cells.where(~F.col("di").isin(12, 22, 23) & (F.col("k") != 19))
               .select("insee",
                       F.concat(F.col("dept"), F.lit("_"),
                                F.lpad(((F.col("k") % 4) + 1).cast("string"), 2, "0")).alias("canton_code")))
    plm = spark.createDataFrame([(p[0], p[1]) for p in PLM], "insee string, canton_code string")
    # Upsert: the PLM rows replace any regular row of the same commune.
    return regular.join(plm, "insee", "left_anti").unionByName(plm)


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cadastre-shaped parcels, one per customer (so they grow with the data).

    id = insee || lpad(custkey, 9); type_objet 'batiment' when custkey % 3 = 2,
    else 'parcelle'; geometry NULL for commune index k = 7, else a 50 m square
    inside its commune cell (EPSG:2154 metres).
    """
    from lotlens.operators.geometry import square

    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    di, key = F.col("c_nationkey"), F.col("c_custkey")
    k = (key % 20).cast("int")
    j = F.floor(key / 20)
    dept = dept_from_nation(di)
    insee = insee_of(dept, commune_from_customer(key, di))
    x0 = F.lit(600000.0) + (di % 5) * 40000 + (k % 4) * 10000 + 100 + (j % 90) * 100
    y0 = F.lit(6500000.0) + F.floor(di / 5) * 50000 + F.floor(k / 4) * 10000 + 100 + (F.floor(j / 90) % 90) * 100
    return c.select(
        F.concat(insee, F.lpad(key.cast("string"), 9, "0")).alias("id"),
        insee.alias("commune"),
        dept.alias("departement"),
        F.when(key % 3 == 2, F.lit("batiment")).otherwise(F.lit("parcelle")).alias("type_objet"),
        F.when(k == 7, F.lit(None)).otherwise(square(x0, y0, 50.0, midpoints=False)).alias("geometry"))


def viewports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One map viewport per event (EPSG:2154 metres) with its zoom."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    west = F.lit(600000.0) + (F.col("event_id") * 7919) % 200000
    south = F.lit(6500000.0) + (F.col("event_id") * 104729) % 250000
    return e.select("event_id", "user_id", "ts",
                    west.alias("west"), south.alias("south"),
                    (west + 30000).alias("east"), (south + 30000).alias("north"),
                    (F.lit(4) + F.col("event_id") % 14).cast("int").alias("zoom"))


def crowded_viewports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One map viewport per event: nine in ten show 1.5 km of one city, far smaller
    than a 50 km cell, the others 30 km anywhere."""
    key = F.col("event_id")
    far, side = key % 10 == 0, F.when(key % 10 == 0, 30000.0).otherwise(1500.0)
    west = 600000.0 + F.when(far, key * 7919 % 200000).otherwise(key * 7919 % 8000)
    south = 6500000.0 + F.when(far, key * 104729 % 250000).otherwise(key * 104729 % 1500)
    return table(spark, sf_dir, "events").select("event_id", west.alias("west"), south.alias("south"),
                                                 (west + side).alias("east"), (south + side).alias("north"))


#: The published simplification tolerances in metres, stated here
#: once more so that a wrong one in ``params`` shows.
WIGGLE_LEVELS = (("country", 1500.0), ("region", 300.0), ("departement", 150.0), ("canton", 100.0), ("commune", 30.0),
                 ("arrondissement", 30.0), ("parcel", 0.5))
#: A side's middle vertex stands this many tolerances outside the square.
WIGGLE_FACTORS = (0.0, 0.5, 0.95, 1.05, 2.0)


def wiggly_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One square per customer (level, code, geometry), each side with a middle
    vertex a little below or above the level's tolerance: what simplification
    keeps depends on the tolerance, and the table grows with the customers."""
    from lotlens.functions.geo import point
    key = F.col("c_custkey")
    level = F.element_at(F.array(*(F.lit(a) for a, _ in WIGGLE_LEVELS)), (key % len(WIGGLE_LEVELS)).cast("int") + 1)
    tol = F.element_at(F.array(*(F.lit(t) for _, t in WIGGLE_LEVELS)), (key % len(WIGGLE_LEVELS)).cast("int") + 1)
    factors = F.array(*map(F.lit, WIGGLE_FACTORS))
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", level.alias("level"), (100 * tol).alias("s"), (key * 400000.0).alias("x"),
        *((tol * F.element_at(factors, ((F.floor(key / 5 ** i) + key) % 5).cast("int") + 1)).alias(f"d{i}") for i in range(4)))
    x, s = F.col("x"), F.col("s")
    zero = F.lit(0.0)
    ring = F.array(point(x, zero), point(x + s / 2, -F.col("d0")), point(x + s, zero), point(x + s + F.col("d1"), s / 2),
                   point(x + s, s), point(x + s / 2, s + F.col("d2")), point(x, s), point(x - F.col("d3"), s / 2), point(x, zero))
    return c.select("level", key.cast("string").alias("code"), F.array(F.array(ring)).alias("geometry"))


def dipped_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communes (level, code, geometry), one or two per customer, whose squares' south
    side dips by 27 m (under the 30 m tolerance). By ``c_custkey % 4``: an outward
    dip; one with a hole inside it; an inward dip into which a neighbour's corner
    reaches; an inward dip."""
    from lotlens.functions.geo import point
    key = F.col("c_custkey")
    kind, x = key % 4, key * 2000.0
    dip = F.when(kind < 2, -27.0).otherwise(27.0)

    def ring(*points):
        return F.array(*(point(x + a, F.lit(b) if not isinstance(b, Column) else b) for a, b in points))
    shell = ring((0.0, 0.0), (500.0, dip), (1000.0, 0.0), (1000.0, 1000.0), (0.0, 1000.0), (0.0, 0.0))
    hole = ring((490.0, -16.0), (490.0, -8.0), (510.0, -8.0), (510.0, -16.0), (490.0, -16.0))
    corner = ring((400.0, -500.0), (600.0, -500.0), (500.0, 5.0), (400.0, -500.0))
    code = key.cast("string")
    square = F.when(kind == 1, F.array(F.array(shell, hole))).otherwise(F.array(F.array(shell)))
    both = F.array(F.struct(code.alias("code"), square.alias("geometry")),
                   F.struct(F.concat(code, F.lit("s")).alias("code"), F.array(F.array(corner)).alias("geometry")))
    c = table(spark, sf_dir, "customer").select(kind.alias("kind"), both.alias("both"))
    return (c.select(F.explode(F.when(F.col("kind") == 2, F.col("both")).otherwise(F.slice("both", 1, 1))).alias("f"))
            .select(F.lit("commune").alias("level"), "f.code", "f.geometry"))


def boundary_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GeoJSON features (dept, feature), one per customer, with names that hold braces,
    quotes and backslashes. By ``c_custkey % 5``: a polygon, one with a hole, two
    parts, no geometry, coordinates that cannot be decoded."""
    from lotlens.operators.publish import geometry_json
    from lotlens.functions.geo import point
    key = F.col("c_custkey")
    kind, x = key % 5, key * 100.0

    def ring(*points):
        return F.array(*(point(x + a, F.lit(b)) for a, b in points))
    shell = ring((0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0), (0.0, 0.0))
    hole = ring((10.0, 10.0), (10.0, 20.0), (20.0, 20.0), (10.0, 10.0))
    other = ring((60.0, 0.0), (70.0, 0.0), (60.0, 10.0), (60.0, 0.0))
    geometry = (F.when(kind == 0, F.array(F.array(shell))).when(kind == 1, F.array(F.array(shell, hole)))
                .when(kind == 2, F.array(F.array(shell), F.array(other))))
    text = (F.when(kind == 4, F.lit('{"type":"Polygon","coordinates":["none"]}'))
            .otherwise(F.coalesce(geometry_json(geometry), F.lit("null"))))
    props = F.to_json(F.struct(key.cast("string").alias("INSEE"), F.concat(F.lit('a}{"\\'), key).alias("NOM"),
                               F.array(F.struct(F.lit("}").alias("k"))).alias("other")))
    return table(spark, sf_dir, "customer").select(
        dept_from_nation(F.col("c_nationkey")).alias("dept"),
        F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), text, F.lit("}")).alias("feature"))
