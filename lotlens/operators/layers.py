"""Boundary layers: country, region, department, canton, commune, postcode.

Source polygons are the commune cells of the data (a 10 km square per
commune present in the sales, EPSG:2154 metres).  Every coarser layer is
the dissolve of finer polygons, so borders are shared exactly.

Layer frame: (level, code, name, geometry); ``level`` drives the
simplification tolerance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.operators import dims
from lotlens.operators.crossings import simplify_layer
from lotlens.operators.geometry import dissolve, square, tolerance_for
from lotlens.functions.geo import round_coordinates, to_wgs84
from lotlens.params import COORD_PRECISION, METRO_REGIONS
from lotlens.sources import fixtures

LAYER_COLUMNS = ("level", "code", "name", "geometry")
CELL_SIZE = 10000.0


def commune_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(insee, name, dept, di, k, canton, postcode, geometry) — one square per commune."""
    cells = fixtures.commune_cells(spark, sf_dir)
    di, k = F.col("di"), F.col("k")
    x0 = F.lit(600000.0) + (di % 5) * 40000 + (k % 4) * 10000
    y0 = F.lit(6500000.0) + F.floor(di / 5) * 50000 + F.floor(k / 4) * 10000
    commune_no = fixtures.commune_from_customer(k, di)
    canton = F.when(~di.isin(12, 22, 23) & (k != 19), F.lpad(((k % 4) + 1).cast("string"), 2, "0"))
    return cells.select(
        "insee",
        F.concat(F.lit("COMMUNE "), F.col("dept"), F.lit("-"), commune_no.cast("string")).alias("name"),
        "dept", "di", "k",
        canton.alias("canton"),
        F.concat(F.col("dept"), F.lpad(((k % 5) * 10).cast("string"), 3, "0")).alias("postcode"),
        square(x0, y0, CELL_SIZE).alias("geometry"))


def arrondissement_source(cells: DataFrame) -> DataFrame:
    """Arrondissement polygons: cells whose code is in the arrondissement map."""
    arr = dims.arrondissement_parent(cells.sparkSession)
    return (cells.join(arr, cells.insee == arr.arr_code, "inner")
            .select(F.col("insee").alias("code"), "name", "parent_code", "geometry"))


def commune_source(cells: DataFrame) -> DataFrame:
    """Commune polygons as a commune boundary file holds them.

    Regular communes carry (dept, canton); each Paris/Lyon/Marseille parent is
    one polygon, the dissolve of its arrondissements, without a canton.
    """
    spark = cells.sparkSession
    arr = dims.arrondissement_parent(spark)
    regular = (cells.join(arr, cells.insee == arr.arr_code, "left_anti")
               .select(F.col("insee").alias("code"), "name", "dept", "canton", "geometry"))
    arr_cells = arrondissement_source(cells)
    parents = dissolve(arr_cells.select("parent_code", "geometry"), ["parent_code"])
    names = dims.plm_parents(spark)
    plm = (parents.join(names, "parent_code")
           .select(F.col("parent_code").alias("code"), "name",
                   F.substring("parent_code", 1, 2).alias("dept"),
                   F.lit(None).cast("string").alias("canton"), "geometry"))
    return regular.unionByName(plm)


def department_layer(cells: DataFrame) -> DataFrame:
    d = dissolve(cells.select(F.col("dept").alias("code"), "geometry"), ["code"])
    return d.select(F.lit("departement").alias("level"), "code",
                    F.concat(F.lit("Departement "), F.col("code")).alias("name"), "geometry")


def region_layer(departments: DataFrame) -> DataFrame:
    spark = departments.sparkSession
    with_region = departments.join(dims.dept_region(spark), departments.code == F.col("dept_code"))
    r = dissolve(with_region.select(F.col("region_code").alias("code"), "geometry"), ["code"])
    return r.select(F.lit("region").alias("level"), "code",
                    F.concat(F.lit("Region "), F.col("code")).alias("name"), "geometry")


def country_layer(regions: DataFrame) -> DataFrame:
    """Metropolitan regions dissolved into one outline (code FR)."""
    spark = regions.sparkSession
    metro = regions.join(dims.metro_regions(spark), regions.code == F.col("region_code"), "left_semi")
    c = dissolve(metro.select(F.lit("FR").alias("code"), "geometry"), ["code"])
    return c.select(F.lit("country").alias("level"), "code", F.lit("France").alias("name"), "geometry")


def commune_canton_map(communes: DataFrame) -> DataFrame:
    """(insee, canton_code) from the commune source; PLM parents -> pseudo-cantons."""
    spark = communes.sparkSession
    regular = (communes.where(F.col("canton").isNotNull())
               .select(F.col("code").alias("insee"),
                       F.concat_ws("_", F.col("dept"), F.col("canton")).alias("canton_code")))
    plm = dims.plm_parents(spark).select(F.col("parent_code").alias("insee"),
                                         F.col("pseudo_canton").alias("canton_code"))
    return regular.join(plm, "insee", "left_anti").unionByName(plm)


def canton_layer(communes: DataFrame) -> DataFrame:
    """Cantons (dissolve of their communes) plus the three PLM pseudo-cantons."""
    spark = communes.sparkSession
    grouped = (communes.where(F.col("canton").isNotNull())
               .select(F.concat_ws("_", F.col("dept"), F.col("canton")).alias("code"),
                       F.col("canton"), "geometry"))
    cantons = dissolve(grouped.select("code", "geometry"), ["code"])
    cantons = cantons.select(F.lit("canton").alias("level"), "code",
                             F.concat(F.lit("Canton "), F.substring_index("code", "_", -1)).alias("name"),
                             "geometry")
    plm = dims.plm_parents(spark)
    pseudo = (communes.join(plm, communes.code == plm.parent_code)
              .select(F.lit("canton").alias("level"), F.col("pseudo_canton").alias("code"),
                      plm["name"].alias("name"), "geometry"))
    return cantons.unionByName(pseudo)


def commune_layer(communes: DataFrame, arrondissements: DataFrame) -> DataFrame:
    """(communes minus PLM parents) union arrondissements."""
    spark = communes.sparkSession
    plm = dims.plm_parents(spark)
    kept = communes.join(plm, communes.code == plm.parent_code, "left_anti")
    return (kept.select(F.lit("commune").alias("level"), "code", "name", "geometry")
            .unionByName(arrondissements.select(F.lit("commune").alias("level"), "code", "name", "geometry")))


def postcode_features(cells: DataFrame) -> DataFrame:
    """Postcode polygons: the cells sharing a postcode, dissolved (may be multi-part).

    The postcode sits under one of three property names, as in files from
    different producers: code_postal, postal_code or code.
    """
    d = dissolve(cells.select(F.col("postcode").alias("pc"), "geometry"), ["pc"])
    r = F.substring("pc", -2, 1).cast("int") % 3
    return d.select(F.when(r == 0, F.col("pc")).alias("code_postal"),
                    F.when(r == 1, F.col("pc")).alias("postal_code"),
                    F.when(r == 2, F.col("pc")).alias("code"),
                    "geometry")


def layer_members(cells: DataFrame) -> DataFrame:
    """(level, code, name, geometry): every commune cell once per coarser
    feature it belongs to — country (metropolitan regions), region,
    department, canton, the PLM pseudo-cantons (arrondissements), and postcode
    where the cells have one."""
    spark = cells.sparkSession
    regions = dims.dept_region(spark)
    with_region = cells.join(regions, cells.dept == regions.dept_code, "left")
    metro = F.col("region_code").isin(*METRO_REGIONS)
    arr = dims.arrondissement_parent(spark)
    plm = dims.plm_parents(spark)
    # pseudo-canton of a cell: its PLM parent when it is an arrondissement, or
    # itself when the frame holds the parent commune polygon
    pseudo = (with_region.join(arr, with_region.insee == arr.arr_code, "left")
              .withColumn("parent_code", F.coalesce(F.col("parent_code"), F.col("insee")))
              .join(plm, "parent_code", "left"))
    postcode = F.col("postcode") if "postcode" in cells.columns else F.lit(None).cast("string")
    m = F.array(
        F.when(postcode.isNotNull(),
               F.struct(F.lit("postcode").alias("level"), postcode.alias("code"),
                        F.concat(F.lit("Postcode "), postcode).alias("name"))),
        F.when(metro, F.struct(F.lit("country").alias("level"), F.lit("FR").alias("code"),
                               F.lit("France").alias("name"))),
        F.when(F.col("region_code").isNotNull(),
               F.struct(F.lit("region").alias("level"), F.col("region_code").alias("code"),
                        F.concat(F.lit("Region "), F.col("region_code")).alias("name"))),
        F.struct(F.lit("departement").alias("level"), F.col("dept").alias("code"),
                 F.concat(F.lit("Departement "), F.col("dept")).alias("name")),
        F.when(F.col("canton").isNotNull(),
               F.struct(F.lit("canton").alias("level"), F.concat_ws("_", F.col("dept"), F.col("canton")).alias("code"),
                        F.concat(F.lit("Canton "), F.col("canton")).alias("name"))),
        F.when(F.col("pseudo_canton").isNotNull(),
               F.struct(F.lit("canton").alias("level"), F.col("pseudo_canton").alias("code"),
                        plm["name"].alias("name"))))
    return (pseudo.select(F.explode(F.filter(m, lambda x: x.isNotNull())).alias("m"), cells["geometry"])
            .select("m.level", "m.code", "m.name", "geometry"))


def all_layers(spark: SparkSession, sf_dir: str, cells: DataFrame | None = None,
               arrondissements: DataFrame | None = None) -> DataFrame:
    """Every published layer in one frame (level, code, name, geometry), metres.

    ``cells`` (insee, name, dept, canton, geometry) must be a coverage (no
    overlaps): the test grid's cells, or a commune boundary file whose PLM
    parents are whole polygons.  All coarser layers are dissolved in ONE pass
    over its edges (grouped by level and code), which gives the same polygons
    as dissolving level by level.  The commune layer is the cells; where
    ``arrondissements`` (code, name, geometry) are given they replace the PLM
    parents that they make up, other parents stay whole.
    """
    cells = commune_cells(spark, sf_dir) if cells is None else cells
    dissolved = dissolve(layer_members(cells), ["level", "code", "name"])
    communes = cells.select(F.lit("commune").alias("level"), F.col("insee").alias("code"), "name", "geometry")
    if arrondissements is not None:
        # at most three parents, from the fixed table of 45 arrondissements
        replaced = (dims.arrondissement_parent(spark).join(arrondissements.select(F.col("code").alias("arr_code")), "arr_code")
                    .select(F.col("parent_code").alias("code")).distinct())
        communes = communes.join(F.broadcast(replaced), "code", "left_anti").select("level", "code", "name", "geometry")
        communes = communes.unionByName(
            arrondissements.select(F.lit("commune").alias("level"), "code", "name", "geometry"))
    return dissolved.unionByName(communes)


def all_layers_stepwise(spark: SparkSession, sf_dir: str, cells: DataFrame | None = None) -> DataFrame:
    """Same layers built level by level (department -> region -> country)."""
    cells = commune_cells(spark, sf_dir) if cells is None else cells
    communes = commune_source(cells)
    arrs = arrondissement_source(cells)
    depts = department_layer(cells)
    regions = region_layer(depts)
    country = country_layer(regions)
    return (country.unionByName(regions).unionByName(depts)
            .unionByName(canton_layer(communes)).unionByName(commune_layer(communes, arrs)))


def publishable(layers: DataFrame, precision: int = COORD_PRECISION) -> DataFrame:
    """Simplify per level (metres, shared arcs once, no crossings) -> WGS84 lon/lat -> round
    coordinates."""
    # borders shared inside a layer are simplified once, so neighbours still meet
    s = simplify_layer(layers, tolerance_for(F.col("level")), ["level"])
    return s.withColumn("geometry", round_coordinates(to_wgs84(F.col("geometry")), precision))
