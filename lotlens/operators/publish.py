"""Join statistics onto features and write GeoJSON / JSON outputs.

Features are written as newline-delimited GeoJSON (one Feature per line),
partitioned by department where the consumer loads by department, so each
task writes its own files and no department is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotlens.functions.expressions import dept_of_commune
from lotlens.operators.stats import STAT_COLUMNS
from lotlens.session import checkpoint_dir
from lotlens.sources.tables import exists, remove_partition

STATS_PROPS = ("price_m2", "n_sales", "q25", "q75")


def enrich(features: DataFrame, stats: DataFrame, on_level: bool = True) -> DataFrame:
    """features LEFT JOIN stats on (level, code) -> price_m2, n_sales, q25, q75."""
    s = stats.select(*(["level"] if on_level else []), "code",
                     F.col("median_price_m2").alias("price_m2"), "n_sales", "q25", "q75")
    keys = ["level", "code"] if on_level else ["code"]
    return features.join(s, keys, "left")


def postcode_code(features: DataFrame) -> Column:
    """First usable postcode among the three property names."""
    return F.coalesce(F.nullif(F.col("code_postal"), F.lit("")),
                      F.nullif(F.col("postal_code"), F.lit("")),
                      F.col("code"))


def enrich_postcodes(postcodes: DataFrame, postcode_stats: DataFrame) -> DataFrame:
    f = postcodes.withColumn("pc", postcode_code(postcodes))
    s = postcode_stats.select(F.col("code").alias("pc"), F.col("median_price_m2").alias("price_m2"),
                              "n_sales", "q25", "q75")
    return f.join(s, "pc", "left")


def geometry_json(geom: Column) -> Column:
    """GeoJSON geometry text: Polygon for one part, MultiPolygon otherwise."""
    coords = F.transform(geom, lambda part: F.transform(
        part, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    poly = F.to_json(F.struct(F.lit("Polygon").alias("type"), coords[0].alias("coordinates")))
    multi = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates")))
    return F.when(F.size(geom) == 1, poly).otherwise(multi)


def feature_json(props: list[str], geom: str = "geometry") -> Column:
    """Compact Feature text; NULL properties are omitted."""
    return F.concat(F.lit('{"type":"Feature","properties":'),
                    F.to_json(F.struct(*[F.col(p) for p in props])),
                    F.lit(',"geometry":'), geometry_json(F.col(geom)), F.lit("}"))


def drop_empty(features: DataFrame, geom: str = "geometry") -> DataFrame:
    """Null / empty geometries are not published."""
    g = F.col(geom)
    return features.where(g.isNotNull() & (F.size(g) > 0)
                          & (F.size(F.flatten(F.flatten(g))) > 0))


def geojson_lines(features: DataFrame, props: list[str]) -> DataFrame:
    return drop_empty(features).select(*[c for c in features.columns if c != "geometry"],
                                       feature_json(props).alias("feature"))


def write_features(features: DataFrame, path: str, partition_by: str | None = None, dynamic: bool = False) -> None:
    """Newline-delimited GeoJSON text files (optionally one folder per key). ``dynamic``
    replaces the folders of the keys in ``features`` and leaves the others.

    Rows are brought together by the key first, so that a key's folder holds few
    files; the rebalance splits a key that is too large for one task.
    """
    cols = ([partition_by] if partition_by else []) + ["feature"]
    features = features.select(*cols)
    if partition_by:
        features = features.hint("rebalance", F.col(partition_by))
    w = features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if dynamic else "static")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.text(path)


def feature_folder(key: str) -> T.StructType:
    """Schema of a folder of feature lines with one sub-folder per ``key`` (text)."""
    return T.StructType([T.StructField("value", T.StringType()), T.StructField(key, T.StringType())])


def changed_keys(features: DataFrame, path: str, key: str) -> DataFrame:
    """Keys whose lines are not those of their folder, and whether they are ``gone``
    from ``features``: both sides are counted and hashed by key where they are read,
    so a row per key is shuffled and no line is."""
    written = features.sparkSession.read.schema(feature_folder(key)).text(path).withColumnRenamed("value", "feature")

    def digest(df, side):
        hashes = F.struct(F.xxhash64("feature"), F.hash("feature"))
        return df.groupBy(key).agg(F.struct(
            F.count(F.lit(1)), F.sum(hashes["col1"].cast("decimal(38,0)")), F.sum(hashes["col2"].cast("long"))).alias(side))
    new, old = digest(features, "_new"), digest(written, "_old").withColumnRenamed(key, "_key")
    both = new.join(old, F.col(key).eqNullSafe(F.col("_key")), "full_outer").where(~F.col("_new").eqNullSafe(F.col("_old")))
    gone = F.col("_new").isNull()
    return both.select(F.when(gone, F.col("_key")).otherwise(F.col(key)).alias(key), gone.alias("gone"))


def update_features(features: DataFrame, path: str, key: str) -> DataFrame:
    """Brings the folders below ``path`` up to date with ``features`` (key, feature),
    writing only those whose lines changed; the first call writes all. Returns the keys
    written or gone. The folders of keys that are gone are removed one by one, for which
    their names come to the driver: use it for keys of a bounded number (departments)."""
    spark = features.sparkSession
    features = features.select(key, "feature")
    if not exists(spark, path):
        write_features(features, path, key)
        return features.select(key, F.lit(False).alias("gone")).distinct()
    checkpoint_dir(spark)
    # kept apart from the folder, which is about to change
    changed = changed_keys(features, path, key).checkpoint()
    keep = changed.where(~F.col("gone")).select(F.col(key).alias("_key"))
    write_features(features.join(keep, F.col(key).eqNullSafe(F.col("_key")), "left_semi"), path, key, dynamic=True)
    for row in changed.where("gone").collect():
        remove_partition(spark, path, key, row[key])
    return changed


def write_collections(features: DataFrame, path: str, partition_by: str) -> None:
    """One FeatureCollection document per key, as a reader of whole files expects; its
    features stand in the order of their text. A key's document is one row: use
    ``write_features`` where keys are large."""
    body = F.array_join(F.array_sort(F.collect_list("feature")), ",")
    docs = features.groupBy(partition_by).agg(
        F.concat(F.lit('{"type":"FeatureCollection","name":"layer {\\"","features":['), body, F.lit("]}")).alias("value"))
    docs.write.mode("overwrite").partitionBy(partition_by).text(path)


def commune_dept(features: DataFrame) -> DataFrame:
    return features.withColumn("dept", dept_of_commune(F.col("code")))


def dept_index(features_with_dept: DataFrame) -> DataFrame:
    """Per department feature count + one-row index {departments, counts}."""
    counts = features_with_dept.groupBy("dept").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sort_array(F.collect_list("dept")).alias("departments"),
                      F.map_from_entries(F.collect_list(F.struct("dept", "n"))).alias("counts"))


def stats_lines(all_stats: DataFrame) -> DataFrame:
    """Stats cache: one JSON object {level, code, ..stats..} per area and line."""
    return all_stats.select(F.to_json(F.struct("level", "code", *STAT_COLUMNS)).alias("json"))
