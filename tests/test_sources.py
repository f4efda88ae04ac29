"""CSV lot source with malformed rows; stats JSON round trip; GeoJSON output."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from lotlens.operators import publish
from lotlens.sources import csv_lots, fixtures, geojson


def test_csv_rejects_and_keeps(spark):
    d = tempfile.mkdtemp(prefix="lotlens-csv-")
    src = os.path.join(d, "src")
    lots = fixtures.lots(spark, SF001).orderBy("date_mutation", "code_commune", "valeur_fonciere").limit(5)
    csv_lots.write_french_csv(lots, src)
    header = "Date mutation|No disposition|Nature mutation|Valeur fonciere|Code postal|Commune|Code departement|Code commune|Type local|Surface reelle bati"
    bad = [
        "31/02/2024x|1|Vente|100000,00|01000|C|01|1|Maison|50,00",      # bad date
        "02/01/2024|1|Vente|100000,00|01000|C|01|1|Maison|abc",         # non-numeric surface
        "02/01/2024|2|Vente||01000|C|01|1|Maison|50,00",                # empty price -> NULL, kept
        "02/01/2024|3|Vente|100000,00|01000|C|01|1|Maison|50,00|extra",  # one field too many
    ]
    with open(os.path.join(src, "bad.csv"), "w") as f:
        f.write(header + "\n" + "\n".join(bad) + "\n")
    valid, rejects = csv_lots.ingest(spark, src + "/*.csv", os.path.join(d, "parsed"))
    assert rejects.count() == 3
    assert valid.count() == 6
    kept = valid.where(F.col("valeur_fonciere").isNull()).first()
    assert kept.no_disposition == 2 and kept.file_path.endswith("bad.csv")
    back = valid.where(F.col("valeur_fonciere").isNotNull()).select(*lots.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, lots.collect()))


def test_all_lots_are_written_and_counted(spark):
    from lotlens.plans import registry
    got = registry.build()["csv_rejects"](spark, SF001).select(F.sum("valid"), F.sum("rejected")).first()
    lots = fixtures.lots(spark, SF001)
    damaged = F.coalesce(F.round("surface_reelle_bati").cast("long") % 7 == 3, F.lit(False))
    assert got[1] == lots.where(damaged).count() > 0
    assert got[0] + got[1] == lots.count() > lots.where(F.col("surface_reelle_bati").isNotNull()).count()


def test_stats_json_round_trip(spark):
    s = spark.createDataFrame([("commune", "75101", None, 12770.0, 10509.0, 15440.0, 1622),
                               ("country", "FR", None, 3000.0, None, 4000.0, 10)],
                              "level string, code string, name string, median_price_m2 double, q25 double, "
                              "q75 double, n_sales long")
    lines = publish.stats_lines(s)
    parsed = {(x["level"], x["code"]): x for x in (json.loads(r.json) for r in lines.collect())}
    assert parsed["commune", "75101"]["n_sales"] == 1622
    back = geojson.stats_from_lines(lines).orderBy("code").collect()
    assert [(r.code, r.q25) for r in back] == [("75101", 10509.0), ("FR", None)]


def test_geojson_feature_and_reader(spark):
    g = [[[{"x": 2.0, "y": 48.0}, {"x": 2.1, "y": 48.0}, {"x": 2.1, "y": 48.1}, {"x": 2.0, "y": 48.0}]]]
    df = spark.createDataFrame([("75101", "PARIS 01", 12770.0, None, g), ("x", "empty", None, None, [])],
                               "code string, name string, price_m2 double, q25 double, "
                               "geometry array<array<array<struct<x:double,y:double>>>>")
    lines = publish.geojson_lines(df, ["code", "name", "price_m2", "q25"]).collect()
    assert len(lines) == 1
    feat = json.loads(lines[0].feature)
    assert feat["geometry"]["type"] == "Polygon" and "q25" not in feat["properties"]
    d = tempfile.mkdtemp(prefix="lotlens-gj-")
    publish.write_features(publish.geojson_lines(df, ["code", "name"]).withColumn("dept", F.lit("75")),
                           d, partition_by="dept")
    props = "code string, name string"
    from pyspark.sql import types as T
    rd = geojson.read_feature_lines(spark, d, T._parse_datatype_string(f"struct<{props.replace(' string', ':string')}>"))
    row = rd.select("properties.code", geojson.geometry_from_json(F.col("geometry.type"), F.col("geometry.coordinates")).alias("g")).first()
    assert row.code == "75101" and len(row.g[0][0]) == 4


def test_csv_header_driven_schema_with_extra_columns(spark):
    d = tempfile.mkdtemp(prefix="lotlens-csvh-")
    header = ("Identifiant de document|No disposition|Date mutation|Nature mutation|Valeur fonciere|No voie|"
              "Code postal|Commune|Code departement|Code commune|Section|Type local|Surface reelle bati|Nombre pieces")
    rows = ["|1|02/01/2024|Vente|250000,50|12|01000|C|01|1|AB|Maison|100,25|4",
            "|2|03/01/2024|Vente|99000,00|3|2A004|AJACCIO|2A|4|ZZ|Appartement||2"]
    with open(os.path.join(d, "a.txt"), "w") as f:
        f.write(header + "\n" + "\n".join(rows) + "\n")
    valid, rejects = csv_lots.ingest(spark, os.path.join(d, "*.txt"), os.path.join(d, "p"))
    assert rejects.count() == 0
    got = {r.no_disposition: r for r in valid.collect()}
    assert str(got[1].valeur_fonciere) == "250000.50" and str(got[1].surface_reelle_bati) == "100.25"
    assert got[2].code_postal == "2A004" and got[2].code_departement == "2A" and got[2].surface_reelle_bati is None
    assert str(got[1].date_mutation) == "2024-01-02"


def test_each_file_is_read_by_its_own_header(spark):
    d = tempfile.mkdtemp(prefix="lotlens-csvm-")
    names = [h for h, _, _ in csv_lots.HEADER]
    row = dict(zip(names, ["02/01/2024", "1", "Vente", "250000,50", "69001", "LYON", "69", "1", "Maison", "100,25"]))
    orders = {"a": names, "b": names[:4] + [names[5], names[4]] + names[6:], "c": ["Section", *reversed(names)]}
    for f, order in orders.items():
        with open(os.path.join(d, f + ".txt"), "w") as fh:
            fh.write("|".join(order) + "\n" + "|".join(row.get(n, "AB") for n in order) + "\n")
    with open(os.path.join(d, "d.txt"), "w") as fh:
        fh.write("no header here\n" + "|".join(row.values()) + "\n")
    valid, rejects = csv_lots.ingest(spark, os.path.join(d, "*.txt"), os.path.join(d, "p"))
    got = valid.collect()
    assert len(got) == 3 and {(r.code_postal, r.commune, str(r.valeur_fonciere)) for r in got} == {("69001", "LYON", "250000.50")}
    assert {os.path.basename(r.file_path) for r in got} == {"a.txt", "b.txt", "c.txt"}
    assert {(os.path.basename(r.file_path), r[csv_lots.CORRUPT]) for r in rejects.collect()} == {
        ("d.txt", "no header here"), ("d.txt", "|".join(row.values()))}


def test_a_header_is_the_first_line_that_is_not_blank(spark):
    d = tempfile.mkdtemp(prefix="lotlens-csvf-")
    names = "|".join(h for h, _, _ in csv_lots.HEADER)
    long = "|".join(["02/01/2024", "1", "Vente", "250000,50", "69001", "LYON", "69", "1", "Maison", "100,25"]) + "\n"
    with open(os.path.join(d, "blank.txt"), "w") as fh:
        fh.write("\n \n" + names + "\n" + long)
    with open(os.path.join(d, "late.txt"), "w") as fh:
        fh.write("title\n" + names + "\n" + long)
    open(os.path.join(d, "empty.txt"), "w").close()
    for i in range(3):
        with open(os.path.join(d, f"large {i}.txt"), "w") as fh:
            fh.write(names + "\n" + long * 200_000)
    got = {h: sorted(os.path.basename(f) for f in fs) for h, fs in csv_lots.file_headers(spark, d + "/*.txt").items()}
    assert got == {
        names: ["blank.txt", "large 0.txt", "large 1.txt", "large 2.txt"], None: ["late.txt"]}
    valid, rejects = csv_lots.ingest(spark, d + "/large*.txt", d + "/parsed")
    assert valid.count() == 600_000 and rejects.count() == 0


def test_table_key_follows_the_input_and_unmarked_targets_are_replaced(spark):
    from lotlens.sources import tables
    d = tempfile.mkdtemp(prefix="lotlens-tab-")
    src = os.path.join(d, "in")

    def build():
        return spark.read.parquet(src)
    spark.range(3).write.parquet(src)
    assert tables.materialize(build, spark, "t", src).count() == 3
    spark.range(5).write.mode("overwrite").parquet(src)
    assert tables.materialize(build, spark, "t", src).count() == 5
    # a target without its marker (a failed writer's) is replaced, a finished one stays
    staging, target = os.path.join(d, "staging"), os.path.join(d, "target")
    os.makedirs(target)
    spark.range(7).write.parquet(staging)
    tables.publish(spark, staging, target)
    assert spark.read.parquet(target).count() == 7 and not os.path.exists(staging)
    spark.range(9).write.parquet(staging)
    tables.publish(spark, staging, target)
    assert spark.read.parquet(target).count() == 7


def test_session_defaults_and_shared_folder():
    import pytest
    from pyspark import SparkConf
    from lotlens import session
    conf = SparkConf(loadDefaults=False).set("spark.sql.adaptive.enabled", "false")
    assert session.unset_only({"spark.sql.adaptive.enabled": "true", "x": "1"}, conf) == {"x": "1"}
    assert session.unset_only({"x": "1"}, None) == {"x": "1"}
    for master in ("local", "local[4]", "local[*]"):
        session.require_local(master)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.require_local(master)


def test_zooms_weights_and_empty_statistics(spark):
    from lotlens.operators import stats, tiles
    z = {r.z: r.l for r in spark.range(22).select(F.col("id").cast("int").alias("z")).select("z", tiles.tile_layers_at(F.col("z")).alias("l")).collect()}
    assert z[5] == ["country", "regions"] and z[7] == ["regions", "departments"] and z[15] == ["communes"] and z[16] == []
    assert z[10] == ["departments", "postcodes"] and z[12] == ["postcodes", "communes"]
    # a region and a department share a code: each gets its own weight, no row is doubled
    t = spark.createDataFrame([("regions", 5, 1, 1, "75"), ("departments", 7, 1, 1, "75"), ("departments", 7, 1, 1, "92")],
                              "layer string, z int, x int, y int, code string")
    w = spark.createDataFrame([("regions", "75", 9), ("departments", "75", 1), ("departments", "92", 2)],
                              "layer string, code string, n_sales long")
    got = {(r.layer, r.code): r["rank"] for r in tiles.rank_in_tile(t, w).collect()}
    assert got == {("regions", "75"): 1, ("departments", "92"): 1, ("departments", "75"): 2}
    empty = spark.createDataFrame([], "nature string, price_m2 double, dept_code string, commune_code int, commune_name string, postal_code string")
    canton = spark.createDataFrame([], "insee string, canton_code string")
    assert [tuple(r) for r in stats.all_level_stats(empty, canton).collect()] == [("country", "FR", None, None, None, None, 0)]
