"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the whole test tables through the lot adapter (or tables
Spark derives from them); none runs on fixed input alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.functions.expressions import dept_of_commune, price_color
from lotlens.functions.geo import ring_area2
from lotlens.operators import (clean, crossings, dims, geometry, incremental, layers, loadtree, parcels, publish, reports, stats, tiles,
                               viewport)
from lotlens.params import DEFAULT, METRO_REGIONS, PARCEL_SIMPLIFY_TOLERANCE
from lotlens.sources import csv_lots, fixtures, geojson
from lotlens.sources.tables import CODE_VERSION, key_for, materialize
from lotlens.session import table_path

Query = Callable[[SparkSession, str], DataFrame]


def _lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lot table L, written once per input folder (the ingest step)."""
    return materialize(lambda: fixtures.lots(spark, sf_dir), spark, "lots", sf_dir)


def _t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction table T, written once from L (the clean step)."""
    return materialize(lambda: clean.clean_transactions(_lots(spark, sf_dir)), spark, "clean", sf_dir)


def _communes_wp(spark, sf_dir):
    return stats.commune_stats_with_parents(_t(spark, sf_dir))


def _all_levels(spark, sf_dir):
    return stats.all_level_stats(_t(spark, sf_dir), fixtures.commune_to_canton(spark, sf_dir))


APPROX = replace(DEFAULT, quantile_mode="approx")
SKETCH = replace(DEFAULT, quantile_mode="sketch")


def _cells(spark, sf_dir):
    return layers.commune_cells(spark, sf_dir)


def _layers(spark, sf_dir):
    """All boundary layers in metres (dissolves run once per input folder)."""
    return materialize(lambda: layers.all_layers(spark, sf_dir), spark, "layers", sf_dir)


def _published(spark, sf_dir):
    """Simplified, lon/lat, rounded layers."""
    return materialize(lambda: layers.publishable(_layers(spark, sf_dir)), spark, "published", sf_dir)


def _commune_features(spark, sf_dir):
    return _published(spark, sf_dir).where(F.col("level") == "commune")


def dissolve_boundary_edges(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    dept = geometry.boundary_edges(cells.select(F.col("dept").alias("code"), "geometry"), ["code"])
    metro = (cells.join(dims.dept_region(spark), cells.dept == F.col("dept_code"))
             .where(F.col("region_code").isin(*METRO_REGIONS))
             .select(F.lit("FR").alias("code"), "geometry"))
    country = geometry.boundary_edges(metro, ["code"])
    return (dept.select(F.lit("departement").alias("level"), "*")
            .unionByName(country.select(F.lit("country").alias("level"), "*")))


def dissolved_layers(spark, sf_dir):
    """Per feature: area (holes subtract) and number of distinct boundary vertices."""
    lay = _layers(spark, sf_dir)
    rings = lay.select("level", "code", "name", F.explode(F.flatten("geometry")).alias("ring"))
    return (rings.groupBy("level", "code", "name")
            .agg((F.sum(ring_area2(F.col("ring"))) / 2).alias("area_m2"),
                 F.sum(F.size("ring") - 1).alias("vertices")))


def dissolved_outline(spark, sf_dir):
    """The country outline (metropolitan regions dissolved): area and vertices."""
    return dissolved_layers(spark, sf_dir).where(F.col("level") == "country").drop("level")


def _vertices(features, code="code"):
    """(code, part, ring, idx, p): every point of every ring of every part."""
    parts = features.select(F.col(code).alias("code"), F.posexplode("geometry").alias("part", "rings"))
    rings = parts.select("code", "part", F.posexplode("rings").alias("ring", "points"))
    return rings.select("code", "part", "ring", F.posexplode("points").alias("idx", "p"))


def lambert93_to_wgs84(spark, sf_dir):
    """Every vertex of the commune cells, EPSG:2154 -> lon/lat (7 decimals)."""
    from lotlens.functions.geo import lambert93_to_lonlat
    pts = _vertices(_cells(spark, sf_dir), "insee")
    ll = lambert93_to_lonlat(F.col("p.x"), F.col("p.y"))
    return pts.select("code", "part", "ring", "idx", F.col("p.x").alias("x"), F.col("p.y").alias("y"),
                      F.bround(ll["x"], 7).alias("lon"), F.bround(ll["y"], 7).alias("lat"))


def simplified_area(spark, sf_dir):
    """Area of every feature after the shared-arc simplification (metres):
    on the grid only collinear vertices may go, so areas must not change."""
    simp = geometry.simplify_shared(_layers(spark, sf_dir), geometry.tolerance_for(F.col("level")), ["level"])
    rings = simp.select("level", "code", "name", F.explode(F.flatten("geometry")).alias("ring"))
    return rings.groupBy("level", "code", "name").agg((F.sum(ring_area2(F.col("ring"))) / 2).alias("area_m2"))


def simplified_vertices(spark, sf_dir):
    """Vertices kept per published feature (ring closing points not counted)."""
    rings = _published(spark, sf_dir).select("level", "code", "name", F.explode(F.flatten("geometry")).alias("ring"))
    return rings.groupBy("level", "code", "name").agg(F.sum(F.size("ring") - 1).alias("vertices"))


def simplified_layers(spark, sf_dir):
    return _published(spark, sf_dir).select("level", "code", "name",
                                            F.size(F.flatten(F.flatten("geometry"))).alias("points"),
                                            "geometry")


def _all_stats_table(spark, sf_dir):
    """S written once per input folder, partitioned by level (level filters prune)."""
    return materialize(lambda: _all_levels(spark, sf_dir), spark, "all_stats", sf_dir, partition_by="level")


def _stats_level(spark, sf_dir, level):
    return _all_stats_table(spark, sf_dir).where(F.col("level") == level)


def enriched_features(spark, sf_dir):
    e = publish.enrich(_layers(spark, sf_dir).drop("geometry"), _all_stats_table(spark, sf_dir))
    return e.select("level", "code", "name", "price_m2", "n_sales", "q25", "q75")


def geojson_features(spark, sf_dir):
    communes = _commune_features(spark, sf_dir)
    s = _all_stats_table(spark, sf_dir).where(F.col("level") == "commune")
    e = publish.enrich(communes, s)
    lines = publish.geojson_lines(e, ["code", "name", "price_m2", "n_sales", "q25", "q75"])
    return lines.select("code", publish.dept_of_commune(F.col("code")).alias("dept"), "feature")


def geojson_parsed(spark, sf_dir):
    """The published commune features parsed back from their GeoJSON text, all parts and rings."""
    doc = F.from_json("feature", "struct<type:string, properties:struct<code:string, price_m2:double, "
                                 "n_sales:bigint, q25:double, q75:double>, "
                                 "geometry:struct<type:string, coordinates:string>>")
    f = geojson_features(spark, sf_dir).select(doc.alias("f"))
    shape = geojson.geometry_from_json(F.col("f.geometry.type"), F.col("f.geometry.coordinates"))
    return f.select(F.col("f.properties.code").alias("code"), F.col("f.geometry.type").alias("geom_type"),
                    F.size(shape).alias("parts"), F.size(F.flatten(shape)).alias("rings"),
                    F.size(F.flatten(F.flatten(shape))).alias("ring_points"),
                    F.col("f.properties.price_m2").alias("price_m2"), F.col("f.properties.n_sales").alias("n_sales"),
                    F.col("f.properties.q25").alias("q25"), F.col("f.properties.q75").alias("q75"))


def rounded_coordinates(spark, sf_dir):
    pts = _vertices(_commune_features(spark, sf_dir))
    return pts.select("code", "part", "ring", "idx", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))


def feature_bbox(spark, sf_dir):
    d = _layers(spark, sf_dir).where(F.col("level") == "departement")
    b = viewport.feature_bounds(d)
    return b.select(F.col("code").alias("dept"), "minx", "miny", "maxx", "maxy",
                    (F.col("maxx") - F.col("minx")).alias("width"), (F.col("maxy") - F.col("miny")).alias("height"))


def _dept_bounds(spark, sf_dir):
    return viewport.feature_bounds(_layers(spark, sf_dir).where(F.col("level") == "departement"))


def _visible(spark, sf_dir):
    return viewport.visible_departments(fixtures.viewports(spark, sf_dir), _dept_bounds(spark, sf_dir))


def viewport_to_load(spark, sf_dir):
    return viewport.departments_to_load(_visible(spark, sf_dir))


def viewport_communes(spark, sf_dir):
    communes = _layers(spark, sf_dir).where(F.col("level") == "commune").select(
        "code", dept_of_commune(F.col("code")).alias("dept"))
    return viewport.communes_to_load(viewport_to_load(spark, sf_dir), communes)


def crowded_viewports(spark, sf_dir):
    """Parcels that each viewport shows, most viewports being in one city."""
    # the customers are few bytes, and one input split, for so many parcels
    workers = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = fixtures.parcels(spark, sf_dir).withColumnRenamed("id", "code").repartition(workers)
    bounds = viewport.feature_bounds(seen).withColumn("key", F.substring("code", -9, 9).cast("long"))
    found = loadtree.tree_join(fixtures.crowded_viewports(spark, sf_dir), bounds, ("west", "south", "east", "north"),
                               ("minx", "miny", "maxx", "maxy"), totals=("event_id", "key"))
    return found.select("event_id", F.col("count").alias("parcels"), F.col("min").alias("first"), F.col("max").alias("last"))


def commune_dept_index(spark, sf_dir):
    c = publish.commune_dept(_layers(spark, sf_dir).where(F.col("level") == "commune").select("code"))
    return c.groupBy("dept").agg(F.count(F.lit(1)).alias("n"))


def enrichment_coverage(spark, sf_dir):
    c = _layers(spark, sf_dir).where(F.col("level") == "commune").drop("geometry")
    e = publish.enrich(c, _all_stats_table(spark, sf_dir))
    return e.agg(F.count(F.lit(1)).alias("features"), F.count("price_m2").alias("enriched"))


def enriched_postcodes(spark, sf_dir):
    pcs = layers.postcode_features(_cells(spark, sf_dir))
    s = _all_stats_table(spark, sf_dir).where(F.col("level") == "postcode")
    e = publish.enrich_postcodes(pcs, s)
    return e.select(F.col("pc").alias("code"), "price_m2", "n_sales", "q25", "q75")


def layer_codes(level):
    def q(spark, sf_dir):
        return _layers(spark, sf_dir).where(F.col("level") == level).select("code", "name")
    return q


def parcel_prices(cap):
    def q(spark, sf_dir):
        return parcels.sold_parcels(fixtures.parcels(spark, sf_dir), _t(spark, sf_dir), cap).drop("geometry")
    return q


def parcel_layer(spark, sf_dir):
    p = parcels.parcel_layer(fixtures.parcels(spark, sf_dir), _t(spark, sf_dir))
    return p.select("parcel_id", "dept_code", "price_m2", "n_sales", "commune_name",
                    F.size(F.flatten(F.flatten("geometry"))).alias("points"))


def tile_assignment(spark, sf_dir):
    return tiles.assign_tiles(_commune_features(spark, sf_dir), "communes")


def parcel_tiles(spark, sf_dir):
    p = parcels.parcel_layer(fixtures.parcels(spark, sf_dir), _t(spark, sf_dir))
    return tiles.assign_parcel_tiles(p)


def parcel_first_zooms(spark, sf_dir):
    """The zoom from which each sold parcel is shown, 8 to a tile below the top zoom."""
    p = parcels.parcel_layer(fixtures.parcels(spark, sf_dir), _t(spark, sf_dir))
    f = p.select(F.lit("parcels").alias("layer"), F.col("parcel_id").alias("code"), "geometry")
    return tiles.first_zooms(f, F.lit(7), F.lit(18), 8)


def layer_tiles(spark, sf_dir):
    return tiles.assign_all_layers(_published(spark, sf_dir))


def tile_top_features(spark, sf_dir):
    weights = _all_stats_table(spark, sf_dir).where(F.col("level") == "commune").select(
        F.lit("communes").alias("layer"), "code", "n_sales")
    return tiles.rank_in_tile(tile_assignment(spark, sf_dir), weights)


def price_colors(spark, sf_dir):
    c = _layers(spark, sf_dir).where(F.col("level") == "commune").drop("geometry")
    e = publish.enrich(c, _all_stats_table(spark, sf_dir))
    return e.select("code", "price_m2", price_color(F.col("price_m2")).alias("color"))


def zoom_levels(spark, sf_dir):
    v = fixtures.viewports(spark, sf_dir).select("event_id", "zoom")
    return (v.select("event_id", "zoom", tiles.layer_for_zoom(F.col("zoom")).alias("layer"))
            .where(F.col("layer").isNotNull()))


def refreshed_department_stats(spark, sf_dir):
    """The department report after a second part of the lots has arrived and only that
    part was scanned: exact volumes, and whether the median is within 3 % of rank 1/2."""
    base = table_path(spark, key_for("refreshed", CODE_VERSION, sf_dir, uuid.uuid4().hex))
    lots, first = _lots(spark, sf_dir), F.coalesce(F.col("no_disposition") == 1, F.lit(True))
    for part in (first, ~first):
        lots.where(part).write.mode("append").parquet(base + "/lots")
        incremental.refresh(spark, base + "/lots", base + "/state")
    report = incremental.department_report(spark, base + "/lots", base + "/state")
    report = report.select(F.col("dept").alias("_dept"), F.col("price_m2").alias("median"), F.col("volume").alias("_volume"))
    prices = reports.residential_lot_prices(lots).select(F.col("code_departement").alias("dept"), "price_m2")
    j = prices.join(report, F.col("dept") == F.col("_dept"))
    below = F.avg((F.col("price_m2") < F.col("median") - 0.005).cast("double"))
    upto = F.avg((F.col("price_m2") <= F.col("median") + 0.005).cast("double"))
    return j.groupBy("dept", F.col("_volume").alias("volume")).agg(((below <= 0.53) & (upto >= 0.47)).alias("within"))


def csv_lots_query(spark, sf_dir):
    """Lots written in the published text format, read back through S1-S5."""
    src = table_path(spark, key_for("csv_source", CODE_VERSION, sf_dir))

    def build():
        csv_lots.write_french_csv(_lots(spark, sf_dir), src)
        valid, _ = csv_lots.ingest(spark, src + "/*.csv", src + "-parsed")
        return valid.drop("file_path")
    return materialize(build, spark, "csv_lots", sf_dir)


def published_vertices(spark, sf_dir):
    """Every vertex of the published features, with how often it is visited
    (ring closing points not counted)."""
    rings = _published(spark, sf_dir).select("level", "code", F.explode(F.flatten("geometry")).alias("ring"))
    pts = rings.select("level", "code", F.explode(F.slice("ring", F.lit(1), F.size("ring") - 1)).alias("p"))
    return (pts.groupBy("level", "code", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))
            .agg(F.count(F.lit(1)).alias("visits")))


def sketch_rank_error(spark, sf_dir):
    """Whether the sketched median of each area is within 3 % of rank 1/2 in
    its exact prices (the published median is rounded to a whole number)."""
    t = _t(spark, sf_dir)
    sk = stats.sketch_level_stats(t, SKETCH).select(
        F.col("level").alias("_level"), F.col("code").alias("_code"), "median_price_m2", "n_sales")
    m = stats.level_members(t).where(F.col("price_m2").isNotNull())
    j = m.join(sk, (m["level"] == sk["_level"]) & (m["code"] == sk["_code"]))
    below = F.avg((F.col("price_m2") < F.col("median_price_m2") - 0.5).cast("double"))
    upto = F.avg((F.col("price_m2") <= F.col("median_price_m2") + 0.5).cast("double"))
    return j.groupBy("level", "code", "n_sales").agg(((below <= 0.53) & (upto >= 0.47)).alias("within"))


def tile_zoom_layers(spark, sf_dir):
    """Tile layers that hold each viewport's zoom (two at the shared borders)."""
    v = fixtures.viewports(spark, sf_dir).select("event_id", "zoom")
    return v.select("event_id", "zoom", F.explode(tiles.tile_layers_at(F.col("zoom"))).alias("layer"))


def _kept(features):
    """Vertices of all rings, closing points not counted."""
    rings = F.flatten("geometry")
    return features.select("level", "code", (F.size(F.flatten(rings)) - F.size(rings)).cast("long").alias("vertices"))


def simplified_squares(spark, sf_dir):
    """Vertices that simplification keeps of squares that grow with the customers
    and whose wiggles lie on both sides of the tolerance (parcels at 0.5 m)."""
    tol = F.when(F.col("level") == "parcel", PARCEL_SIMPLIFY_TOLERANCE).otherwise(geometry.tolerance_for(F.col("level")))
    return _kept(geometry.simplify(fixtures.wiggly_squares(spark, sf_dir), tol))


def simplified_squares_shared(spark, sf_dir):
    """The same through the shared-border simplifier, which starts a ring at its
    smallest vertex and so keeps that one."""
    tol = F.when(F.col("level") == "parcel", PARCEL_SIMPLIFY_TOLERANCE).otherwise(geometry.tolerance_for(F.col("level")))
    return _kept(geometry.simplify_shared(fixtures.wiggly_squares(spark, sf_dir), tol, ["level"]))


def simplified_crossings(spark, sf_dir):
    """Vertices kept of squares whose simplified sides would cross a neighbour or leave
    a hole outside, the crossings that are left, and the holes outside their shell."""
    squares = fixtures.dipped_squares(spark, sf_dir)
    simple = crossings.simplify_layer(squares, geometry.tolerance_for(F.col("level")), ["level"])
    rings = F.flatten("geometry")
    shell, holes = F.element_at(rings, 1), F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    stray = F.filter(holes, lambda h: ~crossings.inside(h[0]["x"], h[0]["y"], shell))
    kept = simple.select("level", "code", (F.size(F.flatten(rings)) - F.size(rings)).cast("long").alias("vertices"),
                         F.size(stray).cast("long").alias("stray_holes"))
    return kept.join(crossings.crossings(simple, ["level"]), ["level", "code"])


def csv_mixed_headers(spark, sf_dir):
    """Files with two column orders in one folder, each read by its own header."""
    src = table_path(spark, key_for("csv_mixed", CODE_VERSION, sf_dir))

    def build():
        lots, even = _lots(spark, sf_dir), F.coalesce(F.col("no_disposition") % 2 == 0, F.lit(True))
        csv_lots.write_french_csv(lots.where(even), src + "/straight")
        csv_lots.write_french_csv(lots.where(~even), src + "/backwards", backwards=True)
        valid, _ = csv_lots.ingest(spark, src + "/*/*.csv", src + "-parsed")
        return valid.drop("file_path")
    return materialize(build, spark, "csv_mixed_headers", sf_dir)


def csv_lot_files(spark, sf_dir):
    """Lots per department and the folder that each lot's file path names."""
    src = table_path(spark, key_for("csv_lot_files_source", CODE_VERSION, sf_dir))

    def build():
        lots, even = _lots(spark, sf_dir), F.coalesce(F.col("no_disposition") % 2 == 0, F.lit(True))
        csv_lots.write_french_csv(lots.where(even), src + "/even")
        csv_lots.write_french_csv(lots.where(~even), src + "/odd")
        valid, _ = csv_lots.ingest(spark, src + "/*/*.csv", src + "-parsed")
        folder = F.regexp_extract("file_path", "/([^/]+)/[^/]+$", 1)
        return valid.groupBy("code_departement", folder.alias("folder")).agg(F.count(F.lit(1)).alias("lots"))
    return materialize(build, spark, "csv_lot_files", sf_dir)


def _files_read_back(spark, lines, key, path):
    """Feature lines written into a folder per ``key`` and parsed from the files of all folders."""
    from lotlens.plans.pipeline import feature_folder
    publish.write_features(lines.select(key, "feature"), path, partition_by=key)
    doc = F.from_json("value", "struct<properties:struct<code:string, name:string, price_m2:double, n_sales:bigint, "
                               "q25:double, q75:double>, geometry:struct<type:string, coordinates:string>>")
    f = spark.read.schema(feature_folder(key)).text(path).select(key, doc.alias("f"))
    shape = geojson.geometry_from_json(F.col("f.geometry.type"), F.col("f.geometry.coordinates"))
    return f.select(key, "f.properties.*", F.size(F.flatten(F.flatten(shape))).alias("points"))


def department_files(spark, sf_dir):
    """The commune features of each department's files."""
    path = table_path(spark, key_for("department_files_source", CODE_VERSION, sf_dir))

    def build():
        return _files_read_back(spark, geojson_features(spark, sf_dir), "dept", path).drop("name")
    return materialize(build, spark, "department_files", sf_dir)


def loaded_features(spark, sf_dir):
    """The commune features that each viewport loads, read from the departments' files
    after the statistics of every second department came late and their folders alone
    were written again."""
    from lotlens.plans.pipeline import features_to_load
    path = table_path(spark, key_for("loaded_features", CODE_VERSION, sf_dir, uuid.uuid4().hex))
    communes, s = _commune_features(spark, sf_dir), _all_stats_table(spark, sf_dir).where(F.col("level") == "commune")
    early = F.pmod(F.hash(dept_of_commune(F.col("code"))), F.lit(2)) == 0
    for known in (s.where(early), s):
        lines = publish.geojson_lines(publish.commune_dept(publish.enrich(communes, known)),
                                      ["code", "name", "price_m2", "n_sales", "q25", "q75"])
        publish.update_features(lines, path, "dept")
    doc = F.from_json("feature", "struct<properties:struct<code:string, price_m2:double, n_sales:bigint>>")
    loads = features_to_load(spark, path, viewport_to_load(spark, sf_dir))
    return loads.select("user_id", "event_id", "dept", doc["properties"].alias("p")).select("user_id", "event_id", "dept", "p.*")


def parcel_files(spark, sf_dir):
    """The parcel features of each department's files."""
    path = table_path(spark, key_for("parcel_files_source", CODE_VERSION, sf_dir))

    def build():
        p = parcels.parcel_layer(fixtures.parcels(spark, sf_dir), _t(spark, sf_dir))
        lines = publish.geojson_lines(p.withColumnRenamed("commune_name", "name"), ["price_m2", "n_sales", "name"])
        return _files_read_back(spark, lines, "dept_code", path).drop("code", "q25", "q75")
    return materialize(build, spark, "parcel_files", sf_dir)


def csv_rejects(spark, sf_dir):
    """Valid and malformed rows per department: all lots are written, with the dates
    of some damaged, and read again."""
    src = table_path(spark, key_for("csv_rejects_files", CODE_VERSION, sf_dir))

    def build():
        damaged = F.coalesce(F.round("surface_reelle_bati").cast("long") % 7 == 3, F.lit(False))
        csv_lots.write_french_csv(_lots(spark, sf_dir), src, damaged=damaged)
        valid, rejects = csv_lots.ingest(spark, src + "/*.csv", src + "-parsed")
        both = (valid.select("code_departement", F.lit(1).alias("v"), F.lit(0).alias("r"))
                .unionByName(rejects.select("code_departement", F.lit(0).alias("v"), F.lit(1).alias("r"))))
        return both.groupBy("code_departement").agg(F.sum("v").alias("valid"), F.sum("r").alias("rejected"))
    return materialize(build, spark, "csv_rejects", sf_dir)


def boundary_documents(spark, sf_dir):
    """Features written as a document per department, and read back from all documents."""
    path = table_path(spark, key_for("boundary_documents", CODE_VERSION, sf_dir))
    publish.write_collections(fixtures.boundary_features(spark, sf_dir), path, "dept")
    layer = geojson.load_layer(spark, path, "INSEE", "NOM", "commune")
    rings = F.flatten("geometry")
    points = F.flatten(rings)
    total = [F.aggregate(points.getField(c), F.lit(0.0), lambda a, v: a + v).alias(f"sum_{c}") for c in "xy"]
    return layer.select("level", "code", "name", *(F.size(a).alias(n) for a, n in (
        (F.col("geometry"), "parts"), (rings, "rings"), (points, "points"))), *total)


def stats_cache_roundtrip(spark, sf_dir):
    """The stats cache written as JSON lines and read back."""
    path = table_path(spark, key_for("stats_cache", CODE_VERSION, sf_dir))
    publish.stats_lines(_all_stats_table(spark, sf_dir)).write.mode("overwrite").text(path)
    return geojson.stats_from_lines(spark.read.text(path), "value")


def tables() -> dict[str, Query]:
    """The written tables that queries read, in the order they are built in."""
    return {"table_lots": _lots, "table_transactions": _t, "table_layers": _layers, "table_published": _published,
            "table_stats": _all_stats_table}


def build() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q["clean_transactions"] = _t
    q["dept_stats"] = lambda s, d: stats.dept_stats(_t(s, d))
    q["dept_stats_approx"] = lambda s, d: stats.dept_stats(_t(s, d), APPROX)
    q["region_stats"] = lambda s, d: stats.region_stats(_t(s, d))
    q["country_stats"] = lambda s, d: stats.country_stats(_t(s, d))
    q["commune_stats"] = lambda s, d: stats.commune_stats(_t(s, d))
    q["postcode_stats"] = lambda s, d: stats.postcode_stats(_t(s, d))
    q["plm_rollup"] = lambda s, d: stats.plm_rollup(stats.commune_stats(_t(s, d)))
    q["commune_stats_with_parents"] = _communes_wp
    q["canton_rollup"] = lambda s, d: stats.canton_rollup(_communes_wp(s, d), fixtures.commune_to_canton(s, d))
    q["commune_canton_map"] = lambda s, d: fixtures.commune_to_canton(s, d)
    q["all_level_stats"] = _all_levels
    # consumers of the published statistics read the written S table (no rescan of T)
    q["areas_per_level"] = lambda s, d: reports.areas_per_level(_all_stats_table(s, d))
    q["plm_canton_lookup"] = lambda s, d: reports.point_lookup(
        _all_stats_table(s, d), "canton", ["75_PARIS", "69_LYON", "13_MARSEILLE"])
    q["stats_grouping_sets"] = lambda s, d: stats.stats_grouping_sets(_t(s, d))
    q["top_expensive_communes"] = lambda s, d: stats.top_expensive_communes(_stats_level(s, d, "commune"), 100, 10)
    q["top_expensive_communes_min20"] = lambda s, d: stats.top_expensive_communes(
        _stats_level(s, d, "commune"), 20, 10)
    q["unmapped_departments"] = lambda s, d: stats.unmapped_departments(_t(s, d))
    q["dataset_summary"] = lambda s, d: reports.dataset_summary(_t(s, d))
    q["price_distribution"] = lambda s, d: reports.price_distribution(_t(s, d))
    q["top_departments"] = lambda s, d: reports.top_departments(_t(s, d))
    q["top_communes"] = lambda s, d: reports.top_communes(_t(s, d))
    q["top_communes_min10"] = lambda s, d: reports.top_communes(_t(s, d), min_n=10)
    q["raw_lot_department_stats"] = lambda s, d: reports.raw_lot_department_stats(_lots(s, d))
    q["raw_lot_department_stats_approx"] = lambda s, d: reports.raw_lot_department_stats(_lots(s, d), params=APPROX)
    q["refreshed_department_stats"] = refreshed_department_stats
    q["raw_lot_city_report"] = lambda s, d: reports.raw_lot_city_report(_lots(s, d))
    q["city_report_by_insee"] = lambda s, d: reports.city_report_by_insee(_lots(s, d))
    q["bulk_sale_inflation"] = lambda s, d: reports.bulk_sale_inflation(_lots(s, d), _t(s, d))
    q["all_level_stats_sketch"] = lambda s, d: stats.all_level_stats(_t(s, d), fixtures.commune_to_canton(s, d), SKETCH)
    q["dissolve_boundary_edges"] = dissolve_boundary_edges
    q["dissolved_layers"] = dissolved_layers
    q["dissolved_outline"] = dissolved_outline
    q["lambert93_to_wgs84"] = lambert93_to_wgs84
    q["simplified_area"] = simplified_area
    q["simplified_vertices"] = simplified_vertices
    q["simplified_layers"] = simplified_layers
    q["enriched_features"] = enriched_features
    q["geojson_features"] = geojson_features
    q["geojson_parsed"] = geojson_parsed
    q["department_files"] = department_files
    q["parcel_files"] = parcel_files
    q["csv_lot_files"] = csv_lot_files
    q["rounded_coordinates"] = rounded_coordinates
    q["feature_bbox"] = feature_bbox
    q["viewport_departments"] = lambda s, d: _visible(s, d).select("event_id", "dept")
    q["viewport_to_load"] = viewport_to_load
    q["viewport_communes"] = viewport_communes
    q["crowded_viewports"] = crowded_viewports
    q["loaded_features"] = loaded_features
    q["commune_dept_index"] = commune_dept_index
    q["enrichment_coverage"] = enrichment_coverage
    q["enriched_postcodes"] = enriched_postcodes
    q["commune_layer"] = layer_codes("commune")
    q["canton_layer"] = layer_codes("canton")
    q["parcel_prices"] = parcel_prices(None)
    q["parcel_prices_cap10"] = parcel_prices(10)
    q["parcel_layer"] = parcel_layer
    q["csv_mixed_headers"] = csv_mixed_headers
    q["published_vertices"] = published_vertices
    q["simplified_squares"] = simplified_squares
    q["simplified_squares_shared"] = simplified_squares_shared
    q["simplified_crossings"] = simplified_crossings
    q["sketch_rank_error"] = sketch_rank_error
    q["tile_zoom_layers"] = tile_zoom_layers
    # a caller's own predicate, and one department's communes
    q["dept_stats_large_homes"] = lambda s, d: stats.area_stats(
        _t(s, d), F.col("dept_code"), where=F.col("total_surface") >= 100)
    q["commune_stats_one_dept"] = lambda s, d: stats.commune_stats(_t(s, d).where(F.col("dept_code") == "75"))
    q["csv_rejects"] = csv_rejects
    q["boundary_documents"] = boundary_documents
    q["tile_assignment"] = tile_assignment
    q["tile_top_features"] = tile_top_features
    q["parcel_tiles"] = parcel_tiles
    q["layer_tiles"] = layer_tiles
    q["parcel_first_zooms"] = parcel_first_zooms
    q["price_color"] = price_colors
    q["zoom_levels"] = zoom_levels
    q["csv_lots"] = csv_lots_query
    q["stats_cache_roundtrip"] = stats_cache_roundtrip
    return q
