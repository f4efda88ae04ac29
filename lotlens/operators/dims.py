"""Small fixed dimension tables.

Their sizes are bounded by the fixed values in ``lotlens.params`` (101, 45 and
3 rows), never by the data, so broadcasting them is always safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.params import DEPT_TO_REGION, METRO_REGIONS, PLM


def dept_region(spark: SparkSession) -> DataFrame:
    rows = sorted(DEPT_TO_REGION.items())
    return F.broadcast(spark.createDataFrame(rows, "dept_code string, region_code string"))


def arrondissement_parent(spark: SparkSession) -> DataFrame:
    """(arr_code, parent_code) generated from the three arrondissement ranges."""
    ranges = spark.createDataFrame([(p[0], p[3], p[4]) for p in PLM],
                                   "parent_code string, first int, last int")
    return F.broadcast(ranges.select(F.explode(F.sequence("first", "last")).alias("_arr"), "parent_code")
                       .select(F.col("_arr").cast("string").alias("arr_code"), "parent_code"))


def plm_parents(spark: SparkSession) -> DataFrame:
    """(parent_code, pseudo_canton, name) of Paris, Lyon, Marseille."""
    return F.broadcast(spark.createDataFrame([(p[0], p[1], p[2]) for p in PLM],
                                             "parent_code string, pseudo_canton string, name string"))


def metro_regions(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(r,) for r in METRO_REGIONS], "region_code string"))
