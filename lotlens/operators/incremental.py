"""The department report kept up to date file by file.

For each input file the state holds one cell per department: how many residential lots
it has, and a mergeable quantile sketch of their prices. A refresh lists the input,
scans only files that the state doesn't know by name, size and time, appends their
cells, and merges the cells of the files that are there now; cells of files that were
replaced or removed match no file and take no part. Counts are exact, medians
within the sketch's error; the work of a refresh follows the new files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotlens.operators.reports import residential_lot_prices
from lotlens.params import DEFAULT, StatsParams
from lotlens.sources.tables import exists

FILE = ["file", "bytes", "modified"]
CELL = "file string, bytes long, modified timestamp, dept string, volume long, sketch binary"


def _name(path: Column) -> Column:
    """One spelling for paths that are given with one or three slashes."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def input_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, modified, path) of the parquet files below ``path``; no file is read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
             .option("recursiveFileLookup", True).load(path))
    return files.select(_name(F.col("path")).alias("file"), F.col("length").alias("bytes"),
                        F.col("modificationTime").alias("modified"), "path")


def cells(lots: DataFrame, params: StatsParams = DEFAULT) -> DataFrame:
    """The cells of the files that ``lots`` is read from. A file without a residential
    lot has one cell without a department."""
    meta = F.col("_metadata")
    named = lots.select("*", _name(meta["file_path"]).alias("file"), meta["file_size"].alias("bytes"),
                        meta["file_modification_time"].alias("modified"))
    prices = residential_lot_prices(named, params).where(F.col("price_m2").isNotNull())
    own = prices.groupBy(*FILE, F.col("code_departement").alias("dept")).agg(
        F.count("*").alias("volume"), F.kll_sketch_agg_double(F.col("price_m2").cast("double")).alias("sketch"))
    none = named.select(*FILE).distinct().select(*FILE, *(F.lit(None).cast(t).alias(c) for c, t in (
        ("dept", "string"), ("volume", "long"), ("sketch", "binary"))))
    return own.unionByName(none)


def _state(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], T._parse_datatype_string(CELL))
    # cells that two refreshes appended at a time are equal
    return spark.read.schema(CELL).parquet(path).dropDuplicates([*FILE, "dept"])


def refresh(spark: SparkSession, lots_path: str, state_path: str, params: StatsParams = DEFAULT) -> int:
    """Appends the cells of new files to the state; how many files were scanned. Files
    that hold no rows are listed again each time and add nothing."""
    known = _state(spark, state_path).select(*FILE).distinct()
    new = [r.path for r in input_files(spark, lots_path).join(known, FILE, "left_anti").select("path").collect()]
    if new:  # the names of new files; Spark's own file listing holds all names as well
        cells(spark.read.parquet(*new), params).write.mode("append").parquet(state_path)
    return len(new)


def department_report(spark: SparkSession, lots_path: str, state_path: str, min_n: int = 10) -> DataFrame:
    """(dept, price_m2, volume) of the files that are there now, from the state alone."""
    now = input_files(spark, lots_path).drop("path")
    merged = (_state(spark, state_path).join(now, FILE, "left_semi").where("sketch IS NOT NULL").groupBy("dept")
              .agg(F.sum("volume").alias("volume"), F.kll_merge_agg_double("sketch").alias("sketch")))
    median = F.kll_sketch_get_quantile_double("sketch", F.lit(0.5))
    return (merged.where((F.col("volume") >= min_n) & F.col("dept").isNotNull() & (F.col("dept") != ""))
            .select("dept", F.bround(F.nullif(median, F.lit(0.0)), 2).alias("price_m2"), "volume")
            .orderBy(F.desc("price_m2"), F.asc("dept")))
