"""Per-area price statistics and volume-weighted roll-ups.

``area_stats`` is the one template behind every directly computed level
(country, region, department, commune, postcode): filter -> group ->
quantiles + count -> minimum sample -> half-even rounding -> drop falsy.
Roll-ups (Paris/Lyon/Marseille parents, cantons) combine already-published
child statistics: median weighted by sales, quartiles averaged unweighted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.functions.expressions import insee_code
from lotlens.operators import dims
from lotlens.operators.quantiles import grouped_quantiles
from lotlens.session import checkpoint_dir
from lotlens.params import DEFAULT, StatsParams

STAT_COLUMNS = ("median_price_m2", "q25", "q75", "n_sales")
QUANTILES = (0.25, 0.5, 0.75)


def base_filter(params: StatsParams = DEFAULT) -> Column:
    """Inclusive price band on sale transactions."""
    return (F.col("price_m2").between(params.min_price_m2, params.max_price_m2)
            & (F.col("nature") == params.sale_nature))


def _quantiles(df: DataFrame, keys: list[str], params: StatsParams, extra_aggs=None) -> DataFrame:
    """keys + _q (q25, q50, q75) + _n, skew-safe in exact mode."""
    return grouped_quantiles(df, keys, "price_m2", list(QUANTILES), params.quantile_mode,
                             params.approx_accuracy, extra_aggs)


def _finish(agg: DataFrame, key_name: str, extra: list[str]) -> DataFrame:
    """Round half-even, turn falsy quartiles into NULL, drop falsy code/median."""
    median = F.bround(F.col("_q")[1], 0)
    q25 = F.bround(F.nullif(F.col("_q")[0], F.lit(0.0)), 0)
    q75 = F.bround(F.nullif(F.col("_q")[2], F.lit(0.0)), 0)
    out = agg.select(F.col(key_name), *extra,
                     median.alias("median_price_m2"), q25.alias("q25"), q75.alias("q75"),
                     F.col("_n").alias("n_sales"))
    return out.where(F.col(key_name).isNotNull() & (F.col(key_name) != "")
                     & F.col("median_price_m2").isNotNull() & (F.col("median_price_m2") != 0))


def area_stats(t: DataFrame, key: Column, key_name: str = "code", where: Column | None = None,
               params: StatsParams = DEFAULT, name_col: str | None = None,
               min_sales: int | None = None) -> DataFrame:
    """Quantiles of price_m2 per ``key`` over filtered transactions.

    Columns: key_name, [name], median_price_m2, q25, q75, n_sales.
    ``name`` is the smallest non-null name of the group (deterministic).
    """
    base = t.where(base_filter(params))
    if where is not None:
        base = base.where(where)
    base = base.select(key.alias(key_name), "price_m2", *([name_col] if name_col else []))
    extra_aggs, extra = [], []
    if name_col:
        extra_aggs, extra = [F.min(name_col).alias("name")], ["name"]
    threshold = params.min_sales if min_sales is None else min_sales
    agg = _quantiles(base, [key_name], params, extra_aggs).where(F.col("_n") >= threshold)
    return _finish(agg, key_name, extra)


def country_stats(t: DataFrame, params: StatsParams = DEFAULT) -> DataFrame:
    """Global aggregate: always one row (code 'FR'), no minimum sample."""
    agg = _quantiles(t.where(base_filter(params)).select("price_m2"), [], params)
    return agg.select(
        F.lit("FR").alias("code"),
        F.bround(F.nullif(F.col("_q")[1], F.lit(0.0)), 0).alias("median_price_m2"),
        F.bround(F.nullif(F.col("_q")[0], F.lit(0.0)), 0).alias("q25"),
        F.bround(F.nullif(F.col("_q")[2], F.lit(0.0)), 0).alias("q75"),
        F.col("_n").alias("n_sales"))


def dept_stats(t: DataFrame, params: StatsParams = DEFAULT) -> DataFrame:
    return area_stats(t, F.col("dept_code"), "code", params=params)


def region_stats(t: DataFrame, params: StatsParams = DEFAULT) -> DataFrame:
    """Transactions joined (broadcast, 101 rows) to their region; unmapped dropped."""
    spark = t.sparkSession
    with_region = t.join(dims.dept_region(spark), "dept_code", "inner")
    return area_stats(with_region, F.col("region_code"), "code", params=params)


def commune_stats(t: DataFrame, params: StatsParams = DEFAULT) -> DataFrame:
    """Per INSEE commune code (arrondissements included), with the commune name.

    One distributed group-by over all departments (no per-department loop).
    """
    return area_stats(t, insee_code(F.col("dept_code"), F.col("commune_code")), "code",
                      params=params, name_col="commune_name")


def postcode_stats(t: DataFrame, params: StatsParams = DEFAULT) -> DataFrame:
    return area_stats(t, F.col("postal_code"), "code", params=params)


def weighted_rollup(child_stats: DataFrame, mapping: DataFrame, child_key: str, parent_key: str,
                    params: StatsParams = DEFAULT) -> DataFrame:
    """Combine child statistics into parents.

    median = sum(median * n) / sum(n) over the already-rounded child medians;
    q25 / q75 = unweighted mean of the non-null child quartiles;
    n = sum(n); parents with sum(n) < min_sales are dropped.
    ``mapping`` has columns (child_key, parent_key); one row per child.
    """
    joined = child_stats.join(mapping, child_stats["code"] == mapping[child_key], "inner")
    agg = (joined.groupBy(F.col(parent_key).alias("code"))
           .agg((F.sum(F.col("median_price_m2") * F.col("n_sales")) / F.sum("n_sales")).alias("_w"),
                F.avg("q25").alias("_q25"),
                F.avg("q75").alias("_q75"),
                F.sum("n_sales").alias("n_sales"))
           .where(F.col("n_sales") >= params.min_sales))
    return agg.select(
        "code",
        F.bround("_w", 0).alias("median_price_m2"),
        F.bround(F.nullif(F.col("_q25"), F.lit(0.0)), 0).alias("q25"),
        F.bround(F.nullif(F.col("_q75"), F.lit(0.0)), 0).alias("q75"),
        "n_sales")


def plm_rollup(communes: DataFrame, params: StatsParams = DEFAULT) -> DataFrame:
    """Paris / Lyon / Marseille parents from their arrondissements (+ names)."""
    spark = communes.sparkSession
    parents = weighted_rollup(communes.select("code", *STAT_COLUMNS), dims.arrondissement_parent(spark),
                              "arr_code", "parent_code", params)
    names = dims.plm_parents(spark).select(F.col("parent_code").alias("code"), "name")
    return parents.join(names, "code", "left").select("code", "name", *STAT_COLUMNS)


def upsert(base: DataFrame, new: DataFrame, key: str = "code", new_is_bounded: bool = False) -> DataFrame:
    """Rows of ``new`` replace rows of ``base`` with the same key.

    ``new_is_bounded``: the caller proves ``new`` has a fixed small size (the
    three PLM parents), so its keys are broadcast instead of shuffling ``base``.
    """
    keys = new.select(key)
    return base.join(F.broadcast(keys) if new_is_bounded else keys, key, "left_anti").unionByName(new)


def commune_stats_with_parents(t: DataFrame, params: StatsParams = DEFAULT,
                               communes: DataFrame | None = None) -> DataFrame:
    communes = commune_stats(t, params) if communes is None else communes
    return upsert(communes, plm_rollup(communes, params), new_is_bounded=True)


def canton_rollup(communes_with_parents: DataFrame, commune_canton: DataFrame,
                  params: StatsParams = DEFAULT) -> DataFrame:
    """Cantons from commune statistics (PLM parents map to pseudo-cantons)."""
    return weighted_rollup(communes_with_parents.select("code", *STAT_COLUMNS), commune_canton,
                           "insee", "canton_code", params)


def all_level_stats(t: DataFrame, commune_canton: DataFrame, params: StatsParams = DEFAULT) -> DataFrame:
    """Long table S(level, code, name, median_price_m2, q25, q75, n_sales).

    Direct levels come from one pass over T; PLM parents and cantons are
    roll-ups of the (small) commune rows.
    """
    # one row per area: small; written once so the roll-ups below do not
    # recompute the quantile pass for each branch of the union
    checkpoint_dir(t.sparkSession)
    direct = (sketch_level_stats(t, params) if params.quantile_mode == "sketch"
              else direct_level_stats(t, params)).checkpoint(eager=True)
    communes = direct.where(F.col("level") == "commune").select("code", "name", *STAT_COLUMNS)
    with_parents = upsert(communes, plm_rollup(communes, params), new_is_bounded=True)

    def lvl(df: DataFrame, level: str) -> DataFrame:
        name = F.col("name") if "name" in df.columns else F.lit(None).cast("string")
        return df.select(F.lit(level).alias("level"), "code", name.alias("name"), *STAT_COLUMNS)

    others = direct.where(F.col("level") != "commune").select(
        "level", "code", F.lit(None).cast("string").alias("name"), *STAT_COLUMNS)
    return (others
            .unionByName(lvl(canton_rollup(with_parents, commune_canton, params), "canton"))
            .unionByName(lvl(with_parents, "commune")))


def unmapped_departments(t: DataFrame) -> DataFrame:
    """Departments present in the data with no region mapping (left anti)."""
    spark = t.sparkSession
    return (t.where(F.col("dept_code").isNotNull()).select("dept_code").distinct()
            .join(dims.dept_region(spark), "dept_code", "left_anti"))


def top_expensive_communes(communes_with_parents: DataFrame, min_sales: int, limit: int) -> DataFrame:
    """Most expensive communes with at least ``min_sales`` sales.

    Ties on the median are broken by code so the result is deterministic.
    """
    return (communes_with_parents.where(F.col("n_sales") >= min_sales)
            .select(F.coalesce(F.col("name"), F.col("code")).alias("city"), "code",
                    "median_price_m2", F.col("n_sales").alias("volume"))
            .orderBy(F.desc("median_price_m2"), F.asc("code"))
            .limit(limit))


def level_members(t: DataFrame, params: StatsParams = DEFAULT) -> DataFrame:
    """Each in-band transaction once per level it belongs to: (level, code, name, price_m2).

    The single-scan equivalent of GROUPING SETS ((), (region), (dept),
    (commune), (postcode)); the region comes from a broadcast join of the
    101-row dimension.
    """
    spark = t.sparkSession
    base = (t.where(base_filter(params))
            .join(dims.dept_region(spark), "dept_code", "left"))
    no_name = F.lit(None).cast("string")
    members = F.array(
        F.struct(F.lit("country").alias("level"), F.lit("FR").alias("code"), no_name.alias("name")),
        F.struct(F.lit("region").alias("level"), F.col("region_code").alias("code"), no_name.alias("name")),
        F.struct(F.lit("departement").alias("level"), F.col("dept_code").alias("code"), no_name.alias("name")),
        F.struct(F.lit("commune").alias("level"), insee_code(F.col("dept_code"), F.col("commune_code")).alias("code"),
                 F.col("commune_name").alias("name")),
        F.struct(F.lit("postcode").alias("level"), F.col("postal_code").alias("code"), no_name.alias("name")))
    each = base.select(F.explode(members).alias("m"), "price_m2").select("m.level", "m.code", "m.name", "price_m2")
    # a member without a price keeps the country's row where there are no sales
    country = spark.range(1).select(F.lit("country").alias("level"), F.lit("FR").alias("code"), no_name.alias("name"),
                                    F.lit(None).cast("double").alias("price_m2"))
    return each.unionByName(country)


def direct_level_stats(t: DataFrame, params: StatsParams = DEFAULT) -> DataFrame:
    """Country, region, department, commune and postcode statistics in ONE pass.

    (level, code, name, median_price_m2, q25, q75, n_sales); the country row
    has no minimum sample, every other level needs ``min_sales``.
    """
    m = level_members(t, params)
    agg = _quantiles(m, ["level", "code"], params, [F.min("name").alias("name")])
    agg = agg.where((F.col("level") == "country")
                    | ((F.col("_n") >= params.min_sales) & F.col("code").isNotNull() & (F.col("code") != "")))
    return agg.select(
        "level", "code", "name",
        F.bround(F.nullif(F.col("_q")[1], F.lit(0.0)), 0).alias("median_price_m2"),
        F.bround(F.nullif(F.col("_q")[0], F.lit(0.0)), 0).alias("q25"),
        F.bround(F.nullif(F.col("_q")[2], F.lit(0.0)), 0).alias("q75"),
        F.col("_n").alias("n_sales")).where(
        (F.col("level") == "country") | (F.col("median_price_m2").isNotNull() & (F.col("median_price_m2") != 0)))


def sketch_level_stats(t: DataFrame, params: StatsParams = DEFAULT, k: int | None = None) -> DataFrame:
    """Approximate statistics of every direct level from ONE scan of T.

    T is reduced to one mergeable KLL sketch per (region, department, commune,
    postcode) cell; every level then merges the sketches of its cells, so no
    level rescans the transactions and no group is ever held whole (a sketch
    has bounded size whatever the group size).  Same columns as
    ``direct_level_stats``; counts are exact, quantiles approximate.
    """
    spark = t.sparkSession
    sketch = (lambda c: F.kll_sketch_agg_double(c, k)) if k else F.kll_sketch_agg_double
    base = t.where(base_filter(params)).join(dims.dept_region(spark), "dept_code", "left")
    cells = (base.groupBy("region_code", "dept_code",
                          insee_code(F.col("dept_code"), F.col("commune_code")).alias("insee"), "postal_code")
             .agg(sketch(F.col("price_m2")).alias("sk"), F.min("commune_name").alias("name")))
    checkpoint_dir(spark)
    cells = cells.checkpoint(eager=True)  # small; read by the five merges below
    qs = F.array(*[F.lit(q) for q in QUANTILES])

    def level(name: str, key: Column | None, with_name: bool = False) -> DataFrame:
        src = cells if key is None else cells.where(key.isNotNull())
        aggs = [F.kll_merge_agg_double("sk").alias("sk")]
        if with_name:
            aggs.append(F.min("name").alias("name"))
        g = src.agg(*aggs) if key is None else src.groupBy(key.alias("code")).agg(*aggs)
        code = F.lit("FR") if key is None else F.col("code")
        return g.select(F.lit(name).alias("level"), code.alias("code"),
                        (F.col("name") if with_name else F.lit(None).cast("string")).alias("name"),
                        F.kll_sketch_get_quantile_double("sk", qs).alias("_q"),
                        F.kll_sketch_get_n_double("sk").alias("_n"))

    merged = (level("country", None)
              .unionByName(level("region", F.col("region_code")))
              .unionByName(level("departement", F.col("dept_code")))
              .unionByName(level("commune", F.col("insee"), with_name=True))
              .unionByName(level("postcode", F.col("postal_code"))))
    merged = merged.where((F.col("level") == "country")
                          | ((F.col("_n") >= params.min_sales) & (F.col("code") != "")))
    return merged.select(
        "level", "code", "name",
        F.bround(F.nullif(F.col("_q")[1], F.lit(0.0)), 0).alias("median_price_m2"),
        F.bround(F.nullif(F.col("_q")[0], F.lit(0.0)), 0).alias("q25"),
        F.bround(F.nullif(F.col("_q")[2], F.lit(0.0)), 0).alias("q75"),
        F.col("_n").alias("n_sales"))


def stats_grouping_sets(t: DataFrame, params: StatsParams = DEFAULT) -> DataFrame:
    """Country, region, department and commune statistics from one scan."""
    d = direct_level_stats(t, params)
    return d.where(F.col("level") != "postcode").select("level", "code", *STAT_COLUMNS)
