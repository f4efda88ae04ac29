"""Exact interpolating quantiles that never gather a group into one task.

The built-in ``percentile`` keeps, per group, a map of every distinct value
and merges the maps of a group in one task: a group holding a third of the
data would land in one task.  Here every group, of whatever size, is ranked
across tasks:

1. every value falls into a bucket by a fixed monotone function (a bucket is
   1/1024 of a unit of log(1 + |value|)); counts per (group, bucket) come straight
   from the scan, by partial aggregation, and give each bucket its first rank;
2. the target ranks floor/ceil((n-1)q) name the few buckets that hold them; these
   are written, so that their size is known where the next step is planned;
3. a second scan keeps the values of those buckets only (by a broadcast join where
   the written buckets are small enough, by a shuffled one otherwise), merges
   repeats and ranks them one by one;
4. the quantile is interpolated as ``(ceil - pos) * lo + (pos - floor) * hi``
   (the same arithmetic as the built-in ``percentile``).

Of the values only those in target buckets are shuffled.  Group keys are matched
null-safely, and a group without any value keeps its row (no quantiles, count 0).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlens.session import checkpoint_dir

#: Buckets per unit of log(1 + |value|).
BUCKETS_PER_UNIT = 1024


def _bucket(v: Column) -> Column:
    """Monotone in the value; NaN, which sorts last, has a bucket of its own."""
    b = F.floor(F.signum(v) * F.log1p(F.abs(v)) * BUCKETS_PER_UNIT).cast("long")
    return F.when(F.isnan(v), F.lit((1 << 63) - 1)).otherwise(b)


def _same_keys(a: DataFrame, b: DataFrame, keys: list[str], *more: Column) -> list[Column]:
    return [a[k].eqNullSafe(b[f"_r_{k}"]) for k in keys] + list(more)


def _marked(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys renamed, for the right side of a null-safe join."""
    return df.withColumnsRenamed({k: f"_r_{k}" for k in keys})


def _written(df: DataFrame) -> DataFrame:
    """``df`` in the shared folder: a few rows per group, with a size that the planner knows."""
    path = os.path.join(checkpoint_dir(df.sparkSession), "quantiles", uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """keys + ``_q`` (array of quantiles, order of ``qs``) + ``_n`` (number of
    values); groups without a value have no row."""
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    values = values.withColumn("_b", _bucket(F.col("_v")))

    # first rank of every bucket, and the group size
    by_key = Window.partitionBy(*keys)
    sums = values.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_bc"))
    sums = sums.select(*keys, "_b", "_bc",
                       (F.sum("_bc").over(by_key.orderBy("_b")) - F.col("_bc")).alias("_off"),
                       F.sum("_bc").over(by_key).alias("_n"))

    # the buckets that hold a target rank
    targets = []
    for i, q in enumerate(qs):
        pos = (F.col("_n") - 1) * F.lit(float(q))
        targets.append(F.struct(F.lit(i).alias("i"), F.lit(0).alias("side"), F.floor(pos).alias("r")))
        targets.append(F.struct(F.lit(i).alias("i"), F.lit(1).alias("side"), F.ceil(pos).alias("r")))
    inside = F.filter(F.array(*targets),
                      lambda t: (t["r"] >= F.col("_off")) & (t["r"] < F.col("_off") + F.col("_bc")))
    wanted = _written(_marked(sums.select(*keys, "_b", "_off", "_n", inside.alias("_t")).where(F.size("_t") > 0), keys + ["_b"]))

    # ranks of the values in those buckets
    rows = (values.join(wanted, _same_keys(values, wanted, keys + ["_b"]))
            .groupBy(*keys, "_b", "_off", "_n", "_t", "_v").agg(F.count(F.lit(1)).alias("_c")))
    upto = F.col("_off") + F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_v"))
    hits = (rows.select(*keys, "_n", "_v", "_c", "_t", upto.alias("_upto"))
            .select(*keys, "_n", "_v", F.explode(F.filter("_t", lambda t: (t["r"] < F.col("_upto"))
                                                          & (t["r"] >= F.col("_upto") - F.col("_c")))).alias("_h")))
    quantiles = []
    found = []
    for i, q in enumerate(qs):
        for side in (0, 1):
            found.append(F.max(F.when((F.col("_h.i") == i) & (F.col("_h.side") == side), F.col("_v"))).alias(f"_{i}_{side}"))
        pos = (F.col("_n") - 1) * F.lit(float(q))
        lower, upper = F.floor(pos), F.ceil(pos)
        lo, hi = F.col(f"_{i}_0"), F.col(f"_{i}_1")
        quantiles.append(F.when(lower == upper, lo).otherwise((upper - pos) * lo + (pos - lower) * hi))
    return hits.groupBy(*keys, "_n").agg(*found).select(*keys, F.array(*quantiles).alias("_q"), "_n")


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], mode: str = "exact",
                      accuracy: int = 10000, extra_aggs: list[Column] | None = None) -> DataFrame:
    """keys + ``_q`` (quantiles in the order of ``qs``) + ``_n`` + extra aggregates.

    approx: ``percentile_approx`` — bounded sketch per group, partial/final.
    exact:  the ranking above, for groups of every size.  Groups whose values
            are all null have a null ``_q`` and ``_n`` = 0; without keys there
            is always one row.
    """
    extra_aggs = extra_aggs or []
    if mode == "approx":
        return df.groupBy(*keys).agg(F.percentile_approx(value, [float(q) for q in qs], accuracy).alias("_q"),
                                     F.count(value).alias("_n"), *extra_aggs)
    by = keys or ["_g"]
    src = df if keys else df.withColumn("_g", F.lit(0))
    # an aggregate without keys has one row even on empty input
    groups = df.groupBy(*keys).agg(F.count(value).alias("_n"), *extra_aggs)
    groups = groups if keys else groups.withColumn("_g", F.lit(0))
    q = _marked(exact_quantiles(src, by, value, qs).drop("_n"), by)
    extra = [c for c in groups.columns if c not in (*by, "_n")]
    return groups.join(q, _same_keys(groups, q, by), "left").select(*keys, "_q", "_n", *extra)
