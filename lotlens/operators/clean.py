"""Lot -> transaction collapse (the cleaned transaction table T)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.functions.expressions import ratio
from lotlens.params import DEFAULT, StatsParams

# Group key of a transaction: property type is deliberately NOT part of it
# (one sale can mix an apartment with its parking space).
TRANSACTION_KEY = ("date_mutation", "code_departement", "code_commune", "no_disposition",
                   "valeur_fonciere", "code_postal", "commune", "nature_mutation")


def valid_sale_lots(lots: DataFrame, params: StatsParams = DEFAULT) -> DataFrame:
    """Sale lots with a positive price and a positive built surface.

    Lots with a NULL / zero surface (outbuildings, parking) vanish here, before
    the residential check of the transaction.
    """
    return lots.where((F.col("nature_mutation") == params.sale_nature)
                      & (F.col("valeur_fonciere") > 0)
                      & (F.col("surface_reelle_bati") > 0))


def clean_transactions(lots: DataFrame, params: StatsParams = DEFAULT) -> DataFrame:
    """One row per transaction whose surviving lots are all residential.

    Partial (map-side) + final hash aggregate on the 8-column key; price stays
    a key, surfaces are summed, lots counted.  A lot with a NULL type counts as
    non-residential, so the whole transaction is rejected.
    """
    residential = F.coalesce(F.col("type_local").isin(*params.residential_types), F.lit(False))
    grouped = (valid_sale_lots(lots, params)
               .groupBy(*TRANSACTION_KEY)
               .agg(F.sum("surface_reelle_bati").alias("_surface"),
                    F.count(F.lit(1)).alias("n_lots"),
                    F.bool_and(residential).alias("_all_residential"))
               .where(F.col("_all_residential")))
    mutation_id = F.concat(
        F.col("date_mutation").cast("string"), F.lit("|"),
        F.col("code_departement"), F.lit("|"),
        F.lpad(F.col("code_commune").cast("string"), 3, "0"), F.lit("|"),
        F.col("no_disposition").cast("string"), F.lit("|"),
        # decimal -> text keeps "123.45" (a double would print as 1.2345E2)
        F.col("valeur_fonciere").cast("decimal(18,2)").cast("string"))
    total_surface = F.col("_surface").cast("double")
    return grouped.select(
        mutation_id.alias("mutation_id"),
        F.col("date_mutation").alias("mutation_date"),
        F.col("nature_mutation").alias("nature"),
        F.col("code_departement").alias("dept_code"),
        F.col("code_commune").alias("commune_code"),
        F.col("code_postal").alias("postal_code"),
        F.col("commune").alias("commune_name"),
        F.col("valeur_fonciere").cast("double").alias("price"),
        total_surface.alias("total_surface"),
        F.col("n_lots"),
        ratio(F.col("valeur_fonciere"), total_surface).alias("price_m2"),
    )
