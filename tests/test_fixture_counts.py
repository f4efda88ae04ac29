"""Expected counts of the lot adapter and the statistics at sf0.01."""

from pyspark.sql import functions as F

from conftest import SF01
from lotlens.operators import clean, stats
from lotlens.params import DEFAULT
from lotlens.sources import fixtures


def test_lot_adapter_counts(spark):
    lots = fixtures.lots(spark, SF01)
    r = lots.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.when(F.col("nature_mutation") == "Vente", 1).otherwise(0)).alias("vente"),
                 F.sum(F.when(F.col("surface_reelle_bati").isNull(), 1).otherwise(0)).alias("nulls")).first()
    assert (r.n, r.vente, r.nulls) == (60000, 39512, 8598)


def test_clean_and_stats_counts(spark):
    t = clean.clean_transactions(fixtures.lots(spark, SF01)).cache()
    assert t.count() == 5256
    assert t.agg(F.sum("n_lots")).first()[0] == 15825
    band = t.where(stats.base_filter(DEFAULT))
    n, med = band.agg(F.count(F.lit(1)), F.percentile("price_m2", F.lit(0.5))).first()
    assert n == 5096 and abs(med - 3400.3006) < 1e-4
    assert stats.dept_stats(t).count() == 25
    communes = stats.commune_stats(t)
    assert communes.count() == 400
    assert communes.where("n_sales >= 20").count() == 51
    assert stats.postcode_stats(t).count() == 125
    parents = {r.code: (r.median_price_m2, r.q25, r.q75, r.n_sales)
               for r in stats.plm_rollup(communes).collect()}
    assert parents["13055"] == (4245, 2346, 6975, 145)
    assert parents["69123"] == (3681, 1577, 6567, 98)
    assert parents["75056"] == (3193, 1544, 6371, 231)
    wp = stats.commune_stats_with_parents(t, communes=communes)
    cantons = stats.canton_rollup(wp, fixtures.commune_to_canton(spark, SF01))
    assert cantons.count() == 91
    top = stats.top_expensive_communes(wp, 20, 10).first()
    assert (top.code, top.median_price_m2, top.volume) == ("19002", 4956, 23)
    assert [r[0] for r in stats.unmapped_departments(t).collect()] == ["20"]
    t.unpersist()
