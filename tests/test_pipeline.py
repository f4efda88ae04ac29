"""End to end: CSV -> lots -> transactions -> layers/stats -> split -> parcels."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from lotlens.operators import layers
from lotlens.plans import pipeline
from lotlens.sources import csv_lots, fixtures, geojson


def part_files(path):
    return {(os.path.basename(d), f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def test_pipeline_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="lotlens-pipe-")
    src = os.path.join(d, "raw")
    csv_lots.write_french_csv(fixtures.lots(spark, SF001), src)
    out = os.path.join(d, "out")
    r = pipeline.run_etl(spark, src + "/*.csv", out)
    assert r["lots"] == 6000 and r["rejected"] == 0 and r["transactions"] == 485
    assert pipeline.run_etl(spark, src + "/*.csv", out) == {}  # idempotent: skipped
    cells = layers.commune_cells(spark, SF001)
    rp = pipeline.run_precompute(spark, out, cells, fixtures.commune_to_canton(spark, SF001))
    assert rp["stats"] > 0 and rp["layers"] > 0
    top = json.loads(spark.read.text(os.path.join(out, "top_expensive")).first()[0])
    assert "data" in top
    cache = [json.loads(r[0]) for r in spark.read.text(os.path.join(out, "stats_cache")).collect()]
    assert {x["level"] for x in cache} >= {"country", "departement", "commune"}
    assert [x["n_sales"] for x in cache if (x["level"], x["code"]) == ("country", "FR")] == [476]
    rs = pipeline.run_split(spark, out)
    idx = json.loads(spark.read.text(os.path.join(out, "communes_index")).first()[0])
    assert sum(idx["counts"].values()) == rs["communes"]
    assert idx["departments"] == sorted(idx["departments"])
    one = idx["departments"][0]
    feats = spark.read.text(os.path.join(out, "communes", f"dept={one}"))
    assert feats.count() == idx["counts"][one]
    # a department's statistics change: its folder alone is written again
    folder = os.path.join(out, "communes")
    before = part_files(folder)
    assert pipeline.refresh_split(spark, out) == []
    changed = spark.read.parquet(os.path.join(out, "stats"))
    late = F.when((F.col("level") == "commune") & F.col("code").startswith(one), F.col("n_sales") + 1).otherwise(F.col("n_sales"))
    changed.withColumn("n_sales", late).write.partitionBy("level").parquet(os.path.join(out, "stats_late"))
    os.rename(os.path.join(out, "stats"), os.path.join(out, "stats_early"))
    os.rename(os.path.join(out, "stats_late"), os.path.join(out, "stats"))
    assert pipeline.refresh_split(spark, out) == [one]
    after = part_files(folder)
    assert {d for d, _ in before - after} == {d for d, _ in after - before} == {f"dept={one}"}
    assert json.loads(spark.read.text(os.path.join(out, "communes_index")).first()[0]) == idx
    rparc = pipeline.run_parcels(spark, out, fixtures.parcels(spark, SF001), cap=5)
    assert 0 < rparc["parcels"] <= 5 * rparc["departments"]
    tiles = pipeline.run_tiles(spark, out)
    assert tiles.select("layer").distinct().count() >= 4
    info = pipeline.describe(spark, out)
    assert info["transactions"]["bytes"] > 0 and "price_m2" in info["transactions"]["schema"]
    c1 = pipeline.cached_department_stats(spark, out)
    t1 = c1.agg(F.max("computed_at")).first()[0]
    c2 = pipeline.cached_department_stats(spark, out)
    assert c2.agg(F.max("computed_at")).first()[0] == t1
    c3 = pipeline.cached_department_stats(spark, out, refresh=True)
    assert c3.agg(F.max("computed_at")).first()[0] >= t1


def test_load_layer_from_feature_collection(spark):
    d = tempfile.mkdtemp(prefix="lotlens-layer-")
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"INSEE_DEP": "75", "NOM": "Paris", "X": 1},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
        {"type": "Feature", "properties": {"INSEE_DEP": "92", "NOM": "Hauts"},
         "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]],
                                                              [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}]}
    p = os.path.join(d, "dep.geojson")
    with open(p, "w") as f:
        json.dump(doc, f)
    lay = {r.code: r for r in geojson.load_layer(spark, p, "INSEE_DEP", "NOM", "departement").collect()}
    assert lay["75"].name == "Paris" and len(lay["75"].geometry) == 1
    assert len(lay["92"].geometry) == 2 and lay["92"].level == "departement"


def test_partition_pruned_reads(spark):
    from lotlens.operators import publish, viewport
    d = tempfile.mkdtemp(prefix="lotlens-prune-")
    cad = os.path.join(d, "cadastre")
    pipeline.write_cadastre(fixtures.parcels(spark, SF001), cad)
    one = pipeline.read_cadastre(spark, cad, ["75"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(departement" in plan and "75" in plan
    assert one.select("departement").distinct().collect()[0][0] == "75"
    # department-split features, loaded through a join on the partition column
    lay = layers.commune_cells(spark, SF001).select(F.lit("commune").alias("level"), F.col("insee").alias("code"),
                                                   "name", "geometry")
    lines = publish.geojson_lines(publish.commune_dept(lay), ["code", "name"])
    out = os.path.join(d, "communes")
    publish.write_features(lines, out, partition_by="dept")
    to_load = spark.createDataFrame([(1, 10, "75"), (2, 11, "01")], "user_id long, event_id long, dept string")
    got = pipeline.features_to_load(spark, out, to_load)
    assert got.count() == lines.where(F.col("dept").isin("75", "01")).count()


def test_cli_from_commune_boundary_file(spark):
    """Commune boundary file with PLM parents as whole polygons, via the CLI steps."""
    from lotlens.operators import geometry
    d = tempfile.mkdtemp(prefix="lotlens-cli-")
    cells = layers.commune_cells(spark, SF001)
    arr = layers.arrondissement_source(cells)
    parents = geometry.dissolve(arr.select("parent_code", "geometry"), ["parent_code"])
    regular = cells.join(arr.select(F.col("code").alias("insee")), "insee", "left_anti")
    feats = (regular.select("insee", "name", "dept", "canton", "geometry")
             .unionByName(parents.select(F.col("parent_code").alias("insee"), F.lit("PLM").alias("name"),
                                         F.substring("parent_code", 1, 2).alias("dept"),
                                         F.lit(None).cast("string").alias("canton"), "geometry")))
    coords = F.transform("geometry", lambda part: F.transform(part, lambda ring: F.transform(
        ring, lambda p: F.array(p["x"], p["y"]))))
    doc = feats.select(F.struct(F.lit("Feature").alias("type"),
                                F.struct(F.col("insee").alias("INSEE_COM"), F.col("name").alias("NOM"),
                                         F.col("dept").alias("INSEE_DEP"), F.col("canton").alias("INSEE_CAN")
                                         ).alias("properties"),
                                F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates"))
                                .alias("geometry")).alias("f"))
    fc = doc.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"),
                                    F.collect_list("f").alias("features"))).alias("j")).first().j
    path = os.path.join(d, "communes.geojson")
    with open(path, "w") as fh:
        fh.write(fc)
    src = os.path.join(d, "raw")
    csv_lots.write_french_csv(fixtures.lots(spark, SF001), src)
    out = os.path.join(d, "out")
    pipeline.main(["--step", "all", "--lots", src + "/*.csv", "--communes", path, "--out", out])
    lay = spark.read.parquet(os.path.join(out, "layers"))
    grid = {(r.level, r.code) for r in layers.all_layers(spark, SF001).select("level", "code").collect()}
    got = {(r.level, r.code) for r in lay.select("level", "code").collect()}
    # same coarse layers; without an arrondissement file the PLM parents stay whole
    coarse = ("commune", "postcode")  # a boundary file has no postcodes
    assert {x for x in grid if x[0] not in coarse} == {x for x in got if x[0] not in coarse}
    arr_codes = {("commune", r.code) for r in arr.select("code").collect()}
    parent_codes = {("commune", r.parent_code) for r in parents.select("parent_code").collect()}
    assert len(parent_codes) == 3 and len(arr_codes) > 3
    assert {x for x in got if x[0] == "commune"} == {x for x in grid if x[0] == "commune"} - arr_codes | parent_codes
    # with the file its arrondissements replace exactly their parents
    arr_doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"INSEE_ARM": r.code, "NOM": r.name},
         "geometry": {"type": "MultiPolygon", "coordinates": [[[[p.x, p.y] for p in ring] for ring in part] for part in r.geometry]}}
        for r in arr.select("code", "name", "geometry").collect() if not r.code.startswith("13")]}
    arr_path = os.path.join(d, "arr.geojson")
    with open(arr_path, "w") as fh:
        json.dump(arr_doc, fh)
    again = layers.all_layers(spark, "", pipeline.communes_from_file(spark, path), pipeline.arrondissements_from_file(spark, arr_path))
    communes = {("commune", r.code) for r in again.where("level = 'commune'").collect()}
    want = {x for x in grid if x[0] == "commune"} - {x for x in arr_codes if x[1].startswith("13")} | {("commune", "13055")}
    assert communes == want
    stats = spark.read.parquet(os.path.join(out, "stats"))
    assert stats.where("level = 'canton' AND code = '75_PARIS'").count() == 1
