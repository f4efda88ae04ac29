"""The department report refreshed file by file."""
import os

from pyspark.sql import functions as F

from conftest import SF001
from lotlens.operators import incremental
from lotlens.operators.reports import residential_lot_prices
from lotlens.sources import fixtures


def report(spark, path, state):
    return {r.dept: r.volume for r in incremental.department_report(spark, path, state).collect()}


def volumes(lots):
    prices = residential_lot_prices(lots).where(F.col("price_m2").isNotNull()).groupBy("code_departement").count()
    return {r.code_departement: r["count"] for r in prices.where("count >= 10").collect() if r.code_departement}


def test_only_new_files_are_scanned(spark, tmp_path):
    path, state = str(tmp_path / "lots"), str(tmp_path / "state")
    lots = fixtures.lots(spark, SF001).checkpoint()
    for n in (1, 2):
        lots.where(F.col("no_disposition") == n).repartition(2).write.mode("append").parquet(path)
        assert incremental.refresh(spark, path, state) == 2
        assert report(spark, path, state) == volumes(lots.where(F.col("no_disposition") <= n))
    before = sorted(os.listdir(state))
    assert incremental.refresh(spark, path, state) == 0 and sorted(os.listdir(state)) == before
    exact = {r.dept: r.p for r in residential_lot_prices(spark.read.parquet(path)).groupBy(F.col("code_departement").alias("dept"))
             .agg(F.percentile("price_m2", F.array(F.lit(0.47), F.lit(0.53))).alias("p")).collect()}
    for r in incremental.department_report(spark, path, state).collect():
        assert exact[r.dept][0] - 0.01 <= r.price_m2 <= exact[r.dept][1] + 0.01


def test_replaced_and_removed_files_leave_the_report(spark, tmp_path):
    path, state = str(tmp_path / "lots"), str(tmp_path / "state")
    lots = fixtures.lots(spark, SF001).checkpoint()
    lots.coalesce(1).write.parquet(path)
    incremental.refresh(spark, path, state)
    third = lots.where(F.col("no_disposition") == 3)
    third.coalesce(1).write.mode("overwrite").parquet(path)
    assert report(spark, path, state) == {}  # not scanned yet
    assert incremental.refresh(spark, path, state) == 1
    assert report(spark, path, state) == volumes(third)
    # files without residential lots, and none at all
    lots.where("false").coalesce(1).write.mode("overwrite").parquet(path)
    incremental.refresh(spark, path, state)
    assert report(spark, path, state) == {}
    # cells appended twice count once
    third.coalesce(1).write.mode("overwrite").parquet(path)
    incremental.refresh(spark, path, state)
    incremental.cells(spark.read.parquet(path)).write.mode("append").parquet(state)
    assert report(spark, path, state) == volumes(third)
