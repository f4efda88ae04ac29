"""End-to-end jobs: etl -> precompute -> split (and the deferred parcel step).

Each step reads and writes tables under an output folder; a step whose
outputs exist is skipped (idempotent re-runs).  Usage::

    spark-submit -m lotlens.plans.pipeline --step all --lots 'in/*.txt' --out /shared/out
"""

from __future__ import annotations

import argparse
from dataclasses import replace
import datetime as dt
import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotlens.operators import clean, layers, parcels, publish, stats, tiles
from lotlens.operators.publish import feature_folder
from lotlens.params import DEFAULT, MIN_SALES_TOP_EXPENSIVE, TOP_EXPENSIVE_LIMIT, StatsParams
from lotlens.sources import csv_lots
from lotlens.sources.tables import exists
from lotlens.session import get_spark, ship_package


def _p(out: str, name: str) -> str:
    return os.path.join(out, name)


def write_observed(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None,
                   sort_within: str | None = None) -> int:
    """Write ``df`` and return its row count, counted during the write (no second pass)."""
    obs = Observation(f"rows_{abs(hash(path))}")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    if sort_within:
        observed = observed.sortWithinPartitions(sort_within)
    w = observed.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    getattr(w, fmt)(path)
    return int(obs.get["rows"])


def run_etl(spark: SparkSession, lots_glob: str, out: str, params: StatsParams = DEFAULT) -> dict:
    """Ingest the sale files (L) and collapse them into transactions (T)."""
    report = {}
    if not exists(spark, _p(out, "lots")):
        valid, rejects = csv_lots.ingest(spark, lots_glob, _p(out, "lots"))
        report |= {"lots": valid.count(), "rejected": rejects.count()}  # from the files' row counts
    if not exists(spark, _p(out, "transactions")):
        report["transactions"] = write_observed(clean.clean_transactions(read_lots(spark, out), params),
                                                _p(out, "transactions"), sort_within="dept_code")
    return report


def read_lots(spark: SparkSession, out: str) -> DataFrame:
    """The valid lots (L)."""
    return csv_lots.stored(spark, _p(out, "lots"), True).drop(csv_lots.CORRUPT)


def run_precompute(spark: SparkSession, out: str, cells: DataFrame, commune_canton: DataFrame,
                   params: StatsParams = DEFAULT, arrondissements: DataFrame | None = None) -> dict:
    """Layers, statistics of every level, stats cache, top-10 report."""
    report = {}
    t = spark.read.parquet(_p(out, "transactions"))
    if not exists(spark, _p(out, "layers")):
        report["layers"] = write_observed(layers.publishable(layers.all_layers(spark, "", cells, arrondissements)),
                                          _p(out, "layers"), partition_by="level")
    if not exists(spark, _p(out, "stats")):
        s = stats.all_level_stats(t, commune_canton, params)
        report["stats"] = write_observed(s, _p(out, "stats"), partition_by="level")
    s = spark.read.parquet(_p(out, "stats"))
    if not exists(spark, _p(out, "stats_cache")):
        publish.stats_lines(s).write.mode("overwrite").text(_p(out, "stats_cache"))
    if not exists(spark, _p(out, "top_expensive")):
        communes = s.where(F.col("level") == "commune")
        top = stats.top_expensive_communes(communes, MIN_SALES_TOP_EXPENSIVE, TOP_EXPENSIVE_LIMIT)
        doc = top.agg(F.to_json(F.struct(F.collect_list(F.struct("city", "code", "median_price_m2", "volume"))
                                         .alias("data"))).alias("json"))
        doc.coalesce(1).write.mode("overwrite").text(_p(out, "top_expensive"))
    return report


def run_split(spark: SparkSession, out: str) -> dict:
    """Commune features + stats, one folder per department, and the index."""
    report = {}
    if not exists(spark, _p(out, "communes")):
        report["communes"] = write_counted(commune_lines(spark, out), _p(out, "communes"), "dept")
        write_index(spark, out)
    return report


def refresh_split(spark: SparkSession, out: str) -> list[str]:
    """Writes again the folders of the departments whose features differ from the layers
    and statistics of now, and the index; the departments written or gone."""
    changed = publish.update_features(commune_lines(spark, out), _p(out, "communes"), "dept")
    write_index(spark, out)
    return sorted(r["dept"] for r in changed.collect())


def commune_lines(spark: SparkSession, out: str) -> DataFrame:
    """Commune features with their statistics as GeoJSON text, and their department."""
    lay = spark.read.parquet(_p(out, "layers")).where(F.col("level") == "commune")
    s = spark.read.parquet(_p(out, "stats")).where(F.col("level") == "commune")
    e = publish.commune_dept(publish.enrich(lay, s))
    return publish.geojson_lines(e, ["code", "name", "price_m2", "n_sales", "q25", "q75"])


def write_index(spark: SparkSession, out: str) -> None:
    """The department index: counts of the features that were written."""
    written = spark.read.schema(feature_folder("dept")).text(_p(out, "communes"))
    publish.dept_index(written.select("dept")).select(F.to_json(F.struct("departments", "counts")).alias("json")) \
        .coalesce(1).write.mode("overwrite").text(_p(out, "communes_index"))


def write_counted(lines: DataFrame, path: str, key: str) -> int:
    """Writes feature lines into one folder per key; the rows written, counted on the way."""
    obs = Observation(f"features_{abs(hash(path))}")
    publish.write_features(lines.observe(obs, F.count(F.lit(1)).alias("rows")).select(key, "feature"), path, partition_by=key)
    return int(obs.get["rows"])


def run_parcels(spark: SparkSession, out: str, cadastre: DataFrame, cap: int | None = None) -> dict:
    """Deferred step: sold parcels with their commune median, per department."""
    t = spark.read.parquet(_p(out, "transactions"))
    layer = parcels.parcel_layer(cadastre, t, cap)
    lines = publish.geojson_lines(layer.withColumnRenamed("commune_name", "name"), ["price_m2", "n_sales", "name"])
    n = write_counted(lines, _p(out, "parcels"), "dept_code")
    written = spark.read.schema(feature_folder("dept_code")).text(_p(out, "parcels"))
    return {"parcels": n, "departments": written.select("dept_code").distinct().count()}


def run_tiles(spark: SparkSession, out: str) -> DataFrame:
    """Tile assignment of every published layer (the container encoding is not built)."""
    lay = spark.read.parquet(_p(out, "layers"))
    return tiles.assign_all_layers(lay)


def describe(spark: SparkSession, out: str) -> dict:
    """Catalogue view of the outputs: name -> schema string and file sizes."""
    info = {}
    for name in ("lots", "transactions", "stats", "layers"):
        path = _p(out, name)
        if exists(spark, path):
            sizes = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                     .option("pathGlobFilter", "*.parquet").load(path).agg(F.sum("length")).first()[0])
            info[name] = {"schema": spark.read.parquet(path).schema.simpleString(), "bytes": sizes}
    return info


def cached_department_stats(spark: SparkSession, out: str, ttl_seconds: int = 3600,
                            refresh: bool = False) -> DataFrame:
    """Materialised raw-lot department report with a TTL and forced refresh.

    The table carries ``computed_at``; it is rebuilt when older than the TTL
    or when ``refresh`` is set (overwrite), else read back as is.
    """
    from lotlens.operators.reports import raw_lot_department_stats

    path = _p(out, "department_stats_cache")
    if exists(spark, path) and not refresh:
        cached = spark.read.parquet(path)
        at = cached.agg(F.max("computed_at")).first()[0]
        if at is not None and (dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) - at).total_seconds() < ttl_seconds:
            return cached
    lots = read_lots(spark, out)
    fresh = raw_lot_department_stats(lots).withColumn(
        "computed_at", F.lit(dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz"))
    fresh.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def refreshed_department_stats(spark: SparkSession, out: str) -> DataFrame:
    """The department report brought up to date by scanning only the lot files that are
    new since the last call (sketched medians, exact volumes)."""
    from lotlens.operators import incremental
    incremental.refresh(spark, _p(out, "lots"), _p(out, "department_state"))
    return incremental.department_report(spark, _p(out, "lots"), _p(out, "department_state"))


def communes_from_file(spark: SparkSession, path: str) -> DataFrame:
    """Commune boundary file (GeoJSON FeatureCollection with INSEE_COM, NOM,
    INSEE_DEP, INSEE_CAN) -> the commune frame the layer builder takes:
    (insee, name, dept, canton, geometry) in metres."""
    from pyspark.sql import types as _T
    from lotlens.sources.geojson import geometry_from_json, read_feature_collection
    props = _T.StructType([_T.StructField(f, _T.StringType())
                           for f in ("INSEE_COM", "NOM", "INSEE_DEP", "INSEE_CAN")])
    f = read_feature_collection(spark, path, props)
    return f.select(F.col("properties.INSEE_COM").alias("insee"), F.col("properties.NOM").alias("name"),
                    F.col("properties.INSEE_DEP").alias("dept"), F.col("properties.INSEE_CAN").alias("canton"),
                    geometry_from_json(F.col("geometry.type"), F.col("geometry.coordinates")).alias("geometry"))


def arrondissements_from_file(spark: SparkSession, path: str) -> DataFrame:
    """Arrondissement boundary file (INSEE_ARM, NOM) -> (code, name, geometry)."""
    from lotlens.sources.geojson import load_layer
    return load_layer(spark, path, "INSEE_ARM", "NOM", "commune").drop("level")


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description="property-sale price pipeline")
    ap.add_argument("--step", choices=["all", "etl", "precompute", "split"], default="all")
    ap.add_argument("--lots", help="glob of the pipe-delimited sale files")
    ap.add_argument("--communes", help="commune boundary GeoJSON (EPSG:2154) for precompute")
    ap.add_argument("--arrondissements", help="arrondissement boundary GeoJSON (EPSG:2154): they replace Paris, Lyon and "
                                              "Marseille in the commune layer; without it the three communes stay whole")
    ap.add_argument("--out", required=True, help="shared output folder")
    ap.add_argument("--quantiles", choices=["exact", "approx", "sketch"], default="exact",
                    help="quantile mode of the statistics")
    args = ap.parse_args(argv)
    params = replace(DEFAULT, quantile_mode=args.quantiles)
    spark = get_spark()
    ship_package(spark)
    if args.step in ("all", "etl"):
        print(run_etl(spark, args.lots, args.out, params))
    if args.step in ("all", "precompute"):
        communes = communes_from_file(spark, args.communes)
        print(run_precompute(spark, args.out, communes, layers.commune_canton_map(
            communes.select(F.col("insee").alias("code"), "dept", "canton")), params,
            arrondissements_from_file(spark, args.arrondissements) if args.arrondissements else None))
    if args.step in ("all", "split"):
        print(run_split(spark, args.out))


def write_cadastre(parcels_df: DataFrame, path: str) -> None:
    """Cadastre stored one folder per department, so department filters prune files."""
    parcels_df.write.mode("overwrite").partitionBy("departement").parquet(path)


def read_cadastre(spark: SparkSession, path: str, departments: list[str] | None = None) -> DataFrame:
    """Parcels of some departments (partition pruning), parcel objects with a geometry."""
    # department codes are text ('01', '2A', '971'): no partition type inference
    inferred = spark.read.parquet(path).schema
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "departement" else f.dataType, True)
                           for f in inferred])
    c = spark.read.schema(schema).parquet(path)
    if departments:
        c = c.where(F.col("departement").isin(*departments))
    return c.where((F.col("type_objet") == "parcelle") & F.col("geometry").isNotNull())


def features_to_load(spark: SparkSession, communes_path: str, to_load: DataFrame) -> DataFrame:
    """Commune features of the departments each viewport must load.

    ``communes_path`` is the department-partitioned feature folder; joining on
    the partition column lets Spark prune the folders (dynamic partition
    pruning) instead of reading every department. Spark prunes by a broadcast
    side only: here the departments themselves (a folder each, fixed by the
    geography), whatever the number of viewports.
    """
    feats = spark.read.schema(feature_folder("dept")).text(communes_path).withColumnRenamed("value", "feature")
    # pruning wants a comparison on the broadcast side; this one drops nulls, which match nothing
    wanted = to_load.select("dept").where(F.col("dept") >= "").distinct()
    feats = feats.join(F.broadcast(wanted), "dept", "left_semi")
    return to_load.join(feats, "dept").select("user_id", "event_id", "dept", "feature")


if __name__ == "__main__":
    main()
