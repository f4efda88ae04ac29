"""Skew-safe exact quantiles equal the built-in in-task percentile."""

from dataclasses import replace

from pyspark.sql import functions as F

from conftest import SF01
from lotlens.operators import clean, stats
from lotlens.operators.quantiles import exact_quantiles, grouped_quantiles
from lotlens.params import DEFAULT
from lotlens.sources import fixtures

QS = [0.25, 0.5, 0.75]


def builtin(df, keys, value):
    return {tuple(r[k] for k in keys): list(r.p) for r in
            df.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(q) for q in QS])).alias("p")).collect()}


def test_hot_key_ranked_across_tasks(spark):
    # one key holds 90% of the rows, with repeated values
    df = spark.range(200000).select(
        F.when(F.col("id") % 10 < 9, F.lit(0)).otherwise(F.col("id") % 97).alias("k"),
        F.floor(F.rand(3) * 5000).cast("double").alias("v"))
    got = {(r.k,): list(r._q) for r in exact_quantiles(df, ["k"], "v", QS).collect()}
    assert got == builtin(df, ["k"], "v")


def test_extra_aggregates_and_the_global_group(spark):
    df = spark.range(50000).select((F.col("id") % 7 == 0).cast("int").alias("k"), F.rand(5).alias("v"))
    out = grouped_quantiles(df, ["k"], "v", QS, extra_aggs=[F.max("v").alias("mx")])
    got = {(r.k,): list(r._q) for r in out.collect()}
    assert got == builtin(df, ["k"], "v")
    assert {r.k: r.mx for r in out.collect()} == {r.k: r.mx for r in df.groupBy("k").agg(F.max("v").alias("mx")).collect()}
    glob = grouped_quantiles(df, [], "v", QS).first()
    assert list(glob._q) == list(df.agg(F.percentile("v", F.array(*[F.lit(q) for q in QS]))).first()[0])


def test_null_keys_null_groups_and_empty_input_keep_their_rows(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", 2.0), ("a", None), ("b", None), ("b", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    out = grouped_quantiles(df, ["k"], "v", [0.5], extra_aggs=[F.count(F.lit(1)).alias("rows")])
    got = {r.k: (r._q and list(r._q), r._n, r.rows) for r in out.collect()}
    assert got == {None: ([2.0], 2, 2), "a": ([2.0], 1, 2), "b": (None, 0, 2)}
    empty = df.where("false")
    assert grouped_quantiles(empty, ["k"], "v", [0.5]).collect() == []
    one = grouped_quantiles(empty, [], "v", [0.5], extra_aggs=[F.max("v").alias("mx")]).collect()
    assert [tuple(r) for r in one] == [(None, 0, None)]


def test_negative_huge_and_special_values(spark):
    vals = [-1e300, -5.5, -0.0, 0.0, 1e-9, 2e-9, 7.25, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in vals * 3], "v double")
    qs = [0.0, 0.1, 0.5, 0.8]
    want = df.agg(F.percentile("v", F.array(*[F.lit(q) for q in qs]))).first()[0]
    assert list(grouped_quantiles(df, [], "v", qs).first()._q) == list(want)


def test_levels_and_reports_equal_the_builtin_percentile(spark, monkeypatch):
    from lotlens.operators import parcels, quantiles, reports
    lots = fixtures.lots(spark, SF01).cache()
    t = clean.clean_transactions(lots).cache()
    cc = fixtures.commune_to_canton(spark, SF01)

    def run():
        frames = [stats.all_level_stats(t, cc), reports.price_distribution(t), reports.raw_lot_department_stats(lots),
                  reports.bulk_sale_inflation(lots, t), reports.top_departments(t), parcels.commune_sales(t)]
        return [sorted(map(tuple, f.collect()), key=repr) for f in frames]

    def in_one_task(df, keys, value, qs, mode="exact", accuracy=10000, extra_aggs=None):
        q = F.percentile(value, F.array(*[F.lit(float(x)) for x in qs])).alias("_q")
        return df.groupBy(*keys).agg(q, F.count(value).alias("_n"), *(extra_aggs or []))
    got = run()
    for module in (stats, reports, parcels):
        monkeypatch.setattr(module, "grouped_quantiles", in_one_task)
    assert quantiles.grouped_quantiles is not in_one_task and got == run()
    t.unpersist()
    lots.unpersist()


def test_sketch_levels_one_scan(spark):
    from bisect import bisect_right
    t = clean.clean_transactions(fixtures.lots(spark, SF01)).cache()
    cc = fixtures.commune_to_canton(spark, SF01)
    exact = {(r.level, r.code): r for r in stats.all_level_stats(t, cc).collect()}
    sk = {(r.level, r.code): r for r in stats.all_level_stats(t, cc, replace(DEFAULT, quantile_mode="sketch")).collect()}
    direct = [k for k in exact if k[0] in ("country", "region", "departement", "commune", "postcode")]
    assert {k for k in sk if k[0] in ("country", "region", "departement", "commune", "postcode")} == set(direct)
    assert all(sk[k].n_sales == exact[k].n_sales for k in direct)
    prices = sorted(r[0] for r in t.where(stats.base_filter(DEFAULT)).select("price_m2").collect())
    rank = bisect_right(prices, sk[("country", "FR")].median_price_m2) / len(prices)
    assert abs(rank - 0.5) < 0.03
    t.unpersist()


def test_null_key_group_in_distributed_path(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("k"),
                                   F.rand(9).alias("v"))
    got = {r.k: list(r._q) for r in grouped_quantiles(df, ["k"], "v", QS).collect()}
    want = {k[0]: v for k, v in builtin(df, ["k"], "v").items()}
    assert got == want and None in got


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 20)), min_size=1, max_size=300),
       st.integers(1, 7))
def test_exact_quantiles_random(spark, rows, parts):
    df = spark.createDataFrame([(k, float(v)) for k, v in rows], "k string, v double").repartition(parts)
    got = {(r.k,): list(r._q) for r in exact_quantiles(df, ["k"], "v", QS).collect()}
    assert got == builtin(df, ["k"], "v")
