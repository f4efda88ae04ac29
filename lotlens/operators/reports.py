"""Ranked reports, raw-lot reports and dataset summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.functions.expressions import insee_code, ratio
from lotlens.operators.clean import valid_sale_lots
from lotlens.operators.quantiles import grouped_quantiles
from lotlens.operators.stats import STAT_COLUMNS
from lotlens.params import DEFAULT, StatsParams


def _exact(df: DataFrame, keys: list[str], qs: list[float], params: StatsParams, extra_aggs=None) -> DataFrame:
    """keys + _q + _n: quantiles of price_m2 in the mode of ``params`` (exact by
    default, big groups ranked across tasks; or the approximate sketch)."""
    return grouped_quantiles(df, keys, "price_m2", qs, params.quantile_mode, params.approx_accuracy,
                             extra_aggs)


def price_band(params: StatsParams = DEFAULT):
    return F.col("price_m2").between(params.min_price_m2, params.max_price_m2)


def dataset_summary(t: DataFrame) -> DataFrame:
    """Transactions, distinct departments, first/last date, mean price_m2."""
    return t.agg(F.count(F.lit(1)).alias("total_transactions"),
                 F.countDistinct("dept_code").alias("departments"),
                 F.min("mutation_date").alias("earliest_date"),
                 F.max("mutation_date").alias("latest_date"),
                 # float sums depend on order: round for a stable value
                 F.bround(F.avg("price_m2"), 4).alias("avg_price_m2"))


def price_distribution(t: DataFrame, params: StatsParams = DEFAULT) -> DataFrame:
    """p10/p25/p50/p75/p90 and mean of price_m2 inside the price band."""
    qs = [0.10, 0.25, 0.50, 0.75, 0.90]
    agg = _exact(t.where(price_band(params)).select("price_m2"), [], qs, params,
                 [F.avg("price_m2").alias("_mean")])
    names = ["p10", "p25", "median", "p75", "p90"]
    return agg.select(*[F.bround(F.col("_q")[i], 4).alias(n) for i, n in enumerate(names)],
                      F.bround("_mean", 4).alias("mean"))


def _quantiles_report(df: DataFrame, keys: list, min_n: int, order: list, limit: int | None,
                      params: StatsParams = DEFAULT) -> DataFrame:
    agg = (_exact(df, keys, [0.5, 0.25, 0.75], params)
           .withColumnRenamed("_n", "n_sales")
           .where(F.col("n_sales") >= min_n))
    out = agg.select(*keys, "n_sales",
                     F.bround(F.col("_q")[0], 2).alias("median_price_m2"),
                     F.bround(F.col("_q")[1], 2).alias("q25"),
                     F.bround(F.col("_q")[2], 2).alias("q75"))
    out = out.orderBy(*order)
    return out.limit(limit) if limit else out


def top_departments(t: DataFrame, min_n: int = 10, limit: int = 15,
                    params: StatsParams = DEFAULT) -> DataFrame:
    """Departments by median price_m2 (desc), n >= min_n, top ``limit``."""
    return _quantiles_report(t.where(price_band(params)).select("dept_code", "price_m2"), ["dept_code"], min_n,
                             [F.desc("median_price_m2"), F.asc("dept_code")], limit, params)


def top_communes(t: DataFrame, min_n: int = 50, limit: int = 20,
                 params: StatsParams = DEFAULT) -> DataFrame:
    """Communes by median price_m2 (desc), grouped by (dept, commune, name)."""
    df = t.where(price_band(params)).select(
        insee_code(F.col("dept_code"), F.col("commune_code")).alias("insee_code"),
        "dept_code", "commune_code", "commune_name", "price_m2")
    out = _quantiles_report(df, ["dept_code", "commune_code", "commune_name", "insee_code"], min_n,
                            [F.desc("median_price_m2"), F.asc("insee_code"), F.asc("commune_name")], limit, params)
    return out.select("insee_code", "commune_name", "median_price_m2", "n_sales")


def residential_lot_prices(lots: DataFrame, params: StatsParams = DEFAULT) -> DataFrame:
    """Raw lots (no transaction collapse): valid residential lots with a row-level price_m2."""
    return (valid_sale_lots(lots, params)
            .where(F.col("type_local").isin(*params.residential_types))
            .withColumn("price_m2", ratio(F.col("valeur_fonciere"), F.col("surface_reelle_bati"))))


def raw_lot_department_stats(lots: DataFrame, min_n: int = 10, params: StatsParams = DEFAULT) -> DataFrame:
    """Median of lot-level price/surface per department, n >= min_n, desc.

    Bulk sales repeat their full price on every lot, so this overstates
    prices; it is kept as published and contrasted in ``bulk_sale_inflation``.
    """
    prices = residential_lot_prices(lots, params).select(F.col("code_departement").alias("dept"), "price_m2")
    agg = (_exact(prices, ["dept"], [0.5], params)
           .select("dept", F.col("_q")[0].alias("_m"), F.col("_n").alias("volume"))
           .where((F.col("volume") >= min_n) & F.col("dept").isNotNull() & (F.col("dept") != "")))
    return (agg.select("dept", F.bround(F.nullif("_m", F.lit(0.0)), 2).alias("price_m2"), "volume")
            .orderBy(F.desc("price_m2"), F.asc("dept")))


def raw_lot_city_report(lots: DataFrame, min_n: int = 50, limit: int = 20,
                        params: StatsParams = DEFAULT) -> DataFrame:
    """City x property type: exact median, n >= min_n, top ``limit`` by volume.

    Grouped by commune name + commune number (no department), as published.
    """
    prices = residential_lot_prices(lots, params).select(
        F.col("commune").alias("city"), F.col("code_commune").alias("code"),
        F.col("type_local").alias("property_type"), "price_m2")
    keys = ["city", "code", "property_type"]
    agg = (_exact(prices, keys, [0.5], params)
           .select(*keys, F.col("_q")[0].alias("_m"), F.col("_n").alias("volume"))
           .where(F.col("volume") >= min_n))
    return (agg.select("city", "code", "property_type",
                       F.bround(F.nullif("_m", F.lit(0.0)), 2).alias("median_price_m2"), "volume")
            .orderBy(F.desc("volume"), F.asc("city"), F.asc("code"), F.asc("property_type"))
            .limit(limit))


def city_report_by_insee(lots: DataFrame, min_n: int = 50, limit: int = 20,
                         params: StatsParams = DEFAULT) -> DataFrame:
    """Department-safe variant of the city report, keyed by INSEE code."""
    prices = residential_lot_prices(lots, params).select(
        insee_code(F.col("code_departement"), F.col("code_commune")).alias("insee"),
        F.col("type_local").alias("property_type"), "commune", "price_m2")
    agg = (_exact(prices, ["insee", "property_type"], [0.5], params, [F.min("commune").alias("city")])
           .select("insee", "property_type", "city", F.col("_q")[0].alias("_m"), F.col("_n").alias("volume"))
           .where(F.col("volume") >= min_n))
    return (agg.select("insee", "city", "property_type",
                       F.bround(F.nullif("_m", F.lit(0.0)), 2).alias("median_price_m2"), "volume")
            .orderBy(F.desc("volume"), F.asc("insee"), F.asc("property_type"))
            .limit(limit))


def bulk_sale_inflation(lots: DataFrame, t: DataFrame, min_n: int = 10,
                        params: StatsParams = DEFAULT) -> DataFrame:
    """Per department: lot-level median vs transaction-level median."""
    raw_prices = residential_lot_prices(lots, params).select(F.col("code_departement").alias("dept_code"), "price_m2")
    raw = _exact(raw_prices, ["dept_code"], [0.5], params).select(
        "dept_code", F.col("_q")[0].alias("_raw"), F.col("_n").alias("raw_n"))
    clean = _exact(t.select("dept_code", "price_m2"), ["dept_code"], [0.5], params).select(
        "dept_code", F.col("_q")[0].alias("_clean"), F.col("_n").alias("clean_n"))
    both = raw.join(clean, "dept_code").where((F.col("raw_n") >= min_n) & (F.col("clean_n") >= min_n))
    return both.select("dept_code",
                       F.bround("_raw", 2).alias("raw_median_price_m2"),
                       F.bround("_clean", 2).alias("clean_median_price_m2"),
                       "raw_n", "clean_n",
                       F.bround(F.col("_raw") / F.col("_clean"), 4).alias("inflation"))


def areas_per_level(all_stats: DataFrame) -> DataFrame:
    return all_stats.groupBy("level").agg(F.count(F.lit(1)).alias("areas"))


def point_lookup(all_stats: DataFrame, level: str, codes: list[str]) -> DataFrame:
    """Rows of S for one level and a list of codes (prunes on ``level``)."""
    return all_stats.where((F.col("level") == level) & F.col("code").isin(*codes)) \
                    .select("level", "code", *STAT_COLUMNS)
