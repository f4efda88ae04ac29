"""GeoJSON and stats-cache JSON readers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotlens.session import checkpoint_dir

STATS_LINE = T.StructType([
    T.StructField("level", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("median_price_m2", T.DoubleType()),
    T.StructField("q25", T.DoubleType()),
    T.StructField("q75", T.DoubleType()),
    T.StructField("n_sales", T.LongType()),
])


def feature_schema(properties: T.StructType) -> T.StructType:
    """Feature with MultiPolygon-depth coordinates kept as JSON text."""
    return T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("properties", properties),
        T.StructField("geometry", T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("coordinates", T.StringType()),
        ])),
    ])


def read_feature_lines(spark: SparkSession, path: str, properties: T.StructType) -> DataFrame:
    """Newline-delimited features (one per line), explicit schema."""
    return spark.read.schema(feature_schema(properties)).json(path)


#: JSON strings outside and inside: whole ones, and what is left of one.
_STRING = r'"(?:[^"\\]++|\\.)*+(?:"|$)'
_REST_OF_STRING = r'^(?:[^"\\]++|\\.)*+(?:"|$)'
_NOT_OPEN = r'(?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+'


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _before(pieces: DataFrame, value: str) -> Column:
    """What the pieces of the same byte range before this one add up to."""
    return F.coalesce(F.sum(value).over(Window.partitionBy("path", "block").orderBy("nth")
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _running(pieces: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all pieces of the file before this one: per byte
    range, then over the ranges of a file, of which there are few."""
    ranges = pieces.groupBy(F.col("path").alias("_path"), F.col("block").alias("_block")).agg(F.sum(value).alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy("_path").orderBy("_block")) - F.col("_sum")
    ranges = ranges.select("_path", "_block", earlier.alias("_earlier"))
    joined = pieces.join(ranges, (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block")))
    return joined.withColumn(name, F.col("_earlier") + _before(pieces, value)).drop("_path", "_block", "_earlier")


def feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """The members of the ``features`` of GeoJSON documents as text: path, feature.

    A document may hold line breaks anywhere or none at all: files are read in byte
    ranges, cut at closing braces, and whether a piece begins inside a string and how
    deep it lies is carried from range to range. Members cut off by the end of a
    file are left out; so is everything that is not a feature.
    """
    cut = (spark.read.option("lineSep", "}").text(path)
           .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("nth"), F.col("value").alias("piece")))
    quotes = _count(F.regexp_replace("piece", r"\\.", ""), '"')
    table = os.path.join(checkpoint_dir(spark), "boundaries", uuid.uuid4().hex)
    plain = F.regexp_replace("piece", _STRING, "")  # without strings, if the piece begins outside of one
    inner = F.regexp_replace(F.regexp_replace("piece", _REST_OF_STRING, ""), _STRING, "")
    cut.select("*", quotes.alias("quotes"), _count(plain, "{").alias("opened"), _count(inner, "{").alias("opened_inside")
               ).write.parquet(table)
    texts = spark.read.parquet(table)
    small = _running(texts.drop("piece"), "quotes", "quotes_before")
    inside = F.col("quotes_before") % 2 == 1
    ends_inside = (F.col("quotes_before") + F.col("quotes")) % 2 == 1
    small = (small.withColumn("opened", F.when(inside, F.col("opened_inside")).otherwise(F.col("opened")))
             .withColumn("step", F.col("opened") - F.when(ends_inside, 0).otherwise(1)))
    small = _running(small.select("path", "block", "nth", "opened", "step"), "step", "depth")
    closes = (F.col("depth") + F.col("step") == 1) & (F.col("depth") + F.col("opened") == 2)
    small = _running(small.withColumn("closes", closes.cast("long")), "closes", "number")
    pieces = (small.select(*(F.col(c).alias(f"_{c}") for c in ("path", "block", "nth")), "depth", "number", "closes")
              .join(texts, (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block")) & (F.col("nth") == F.col("_nth"))))
    # what stands between two features, or before the first
    body = (F.when(F.col("depth") == 0, F.regexp_replace("piece", r"^[^{]*\{" + _NOT_OPEN, ""))
            .when(F.col("depth") == 1, F.regexp_replace("piece", "^" + _NOT_OPEN, "")).otherwise(F.col("piece")))
    whole = pieces.withColumn("body", F.concat(body, F.lit("}"))).groupBy("path", "number").agg(
        F.max("closes").alias("closed"), F.array_sort(F.collect_list(F.struct("block", "nth", "body"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["body"]), "")
    return whole.where("closed = 1").select("path", text.alias("feature"))


def read_feature_collection(spark: SparkSession, path: str, properties: T.StructType) -> DataFrame:
    """FeatureCollection documents -> one row per feature, read in byte ranges."""
    f = feature_texts(spark, path).select(F.from_json("feature", feature_schema(properties)).alias("f"))
    return f.select("f.*").where(F.col("type") == "Feature")


def geometry_from_json(geom_type: Column, coordinates: Column) -> Column:
    """GeoJSON Polygon / MultiPolygon coordinates text -> MultiPolygon column.

    Undecodable text gives NULL (dropped later, like an unreadable geometry).
    """
    poly_t = "array<array<array<double>>>"
    multi_t = "array<array<array<array<double>>>>"

    def to_points(rings):
        return F.transform(rings, lambda ring: F.transform(
            ring, lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))))
    def whole(rings):  # every ring has points, and every point two numbers
        return F.forall(rings, lambda ring: ring.isNotNull() & F.forall(
            ring, lambda c: F.coalesce(F.get(c, F.lit(0)).isNotNull() & F.get(c, F.lit(1)).isNotNull(), F.lit(False))))
    poly = F.from_json(coordinates, poly_t)
    multi = F.from_json(coordinates, multi_t)
    return (F.when((geom_type == "Polygon") & whole(poly), F.array(to_points(poly)))
            .when((geom_type == "MultiPolygon") & F.forall(multi, lambda p: p.isNotNull() & whole(p)),
                  F.transform(multi, to_points)))


def stats_from_lines(lines: DataFrame, json_col: str = "json") -> DataFrame:
    """Lines of {level, code, ..stats..} -> long S(level, code, stats...)."""
    return lines.select(F.from_json(F.col(json_col), STATS_LINE).alias("s")).select("s.*")


def load_layer(spark: SparkSession, path: str, code_field: str, name_field: str, level: str,
               multi_line: bool = True) -> DataFrame:
    """Boundary file (GeoJSON) -> standard (level, code, name, geometry).

    Only the two attribute fields are parsed (column pruning at the reader);
    features whose geometry cannot be decoded get a NULL geometry.
    """
    props = T.StructType([T.StructField(code_field, T.StringType()), T.StructField(name_field, T.StringType())])
    feats = (read_feature_collection(spark, path, props) if multi_line
             else read_feature_lines(spark, path, props))
    return feats.select(F.lit(level).alias("level"),
                        F.col("properties")[code_field].alias("code"),
                        F.col("properties")[name_field].alias("name"),
                        geometry_from_json(F.col("geometry.type"), F.col("geometry.coordinates")).alias("geometry"))
