"""Parcel price layer: every sold-commune parcel with its commune's median.

One job for all departments: commune sales are aggregated before the join
(one row per commune and name), parcels are filtered and projected at the
scan.  Every sold parcel is kept; a top-k per department, where one is asked
for, is a two-phase salted ``row_number`` so a hot department never sorts in
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotlens.functions.expressions import insee_code
from lotlens.functions.geo import to_wgs84
from lotlens.operators.geometry import simplify
from lotlens.operators.quantiles import grouped_quantiles
from lotlens.params import DEFAULT, PARCEL_SIMPLIFY_TOLERANCE, StatsParams


def cap_per_group(df: DataFrame, group: str, order: list[str], cap: int, salt_buckets: int = 64) -> DataFrame:
    """First ``cap`` rows of each group in ``order`` — exact, and skew-safe.

    Phase 1 ranks inside (group, salt) sub-groups (salt = hash of the order
    key), so a department holding a third of all parcels is split into
    ``salt_buckets`` tasks; every global top-``cap`` row is in the top ``cap``
    of its sub-group.  Phase 2 ranks the at most ``salt_buckets * cap``
    survivors per group.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(salt_buckets))
    w1 = Window.partitionBy(group, "_salt").orderBy(*order)
    pre = (df.withColumn("_salt", salt)
           .withColumn("_rn1", F.row_number().over(w1))
           .where(F.col("_rn1") <= cap).drop("_rn1", "_salt"))
    w2 = Window.partitionBy(group).orderBy(*order)
    return pre.withColumn("_rn", F.row_number().over(w2)).where(F.col("_rn") <= cap).drop("_rn")


def commune_sales(t: DataFrame, params: StatsParams = DEFAULT) -> DataFrame:
    """Median and count per (dept, commune, name); exclusive price band, no minimum."""
    band = (F.col("price_m2") > params.min_price_m2) & (F.col("price_m2") < params.max_price_m2)
    keys = ["dept_code", "commune_code", "commune_name"]
    q = grouped_quantiles(t.where(band).select(*keys, "price_m2"), keys, "price_m2", [0.5], "exact",
                          params.approx_accuracy)
    return q.select(insee_code(F.col("dept_code"), F.col("commune_code")).alias("insee_com"),
                    "commune_name", F.col("_n").alias("n_sales"), F.col("_q")[0].alias("median_price_m2"))


def sold_parcels(parcels: DataFrame, t: DataFrame, cap: int | None = None,
                 params: StatsParams = DEFAULT) -> DataFrame:
    """All parcels of communes with sales; with ``cap`` the first ones of each
    department by parcel id (a top-k report)."""
    p = (parcels.where((F.col("type_objet") == "parcelle") & F.col("geometry").isNotNull())
         .select("id", "commune", "departement", "geometry"))
    sales = commune_sales(t, params)
    joined = p.join(sales, p.commune == sales.insee_com, "inner")
    if cap is not None:
        joined = cap_per_group(joined, "departement", ["id", "commune_name"], cap)
    return joined.select(
        F.col("id").alias("parcel_id"),
        F.col("departement").alias("dept_code"),
        F.bround(F.nullif(F.col("median_price_m2"), F.lit(0.0)), 0).alias("price_m2"),
        "n_sales", "commune_name", "geometry")


def parcel_layer(parcels: DataFrame, t: DataFrame, cap: int | None = None,
                 params: StatsParams = DEFAULT) -> DataFrame:
    """Sold parcels, simplified at 0.5 m in metres, then lon/lat."""
    s = simplify(sold_parcels(parcels, t, cap, params), PARCEL_SIMPLIFY_TOLERANCE)
    return s.withColumn("geometry", to_wgs84(F.col("geometry")))
