"""Hand-made cases for the semantic traps of the transaction collapse and roll-ups."""

import datetime as dt
from decimal import Decimal

from lotlens.operators import clean, stats
from lotlens.sources.csv_lots import LOT_COLUMNS

SCHEMA = ("date_mutation date, no_disposition int, nature_mutation string, valeur_fonciere decimal(18,2), "
          "code_postal string, commune string, code_departement string, code_commune int, type_local string, "
          "surface_reelle_bati decimal(18,2)")


def lot(price, type_local, surface, disposition=1, commune=1, nature="Vente"):
    return (dt.date(2024, 1, 2), disposition, nature, Decimal(price), "01000", "C", "01", commune,
            type_local, None if surface is None else Decimal(surface))


def test_mutation_id_uses_decimal_text_and_padding(spark):
    df = spark.createDataFrame([lot("12345678.50", "Maison", "100")], SCHEMA)
    row = clean.clean_transactions(df).first()
    assert row.mutation_id == "2024-01-02|01|001|1|12345678.50"


def test_parking_passes_shop_fails_null_type_fails(spark):
    rows = [
        # apartment + parking (no surface): parking vanishes before the check
        lot("200000.00", "Appartement", "50", disposition=1), lot("200000.00", "Dependance", None, disposition=1),
        # apartment + shop with surface: rejected
        lot("300000.00", "Appartement", "60", disposition=2), lot("300000.00", "Local industriel", "40", disposition=2),
        # NULL type with a surface: rejected
        lot("150000.00", "Maison", "70", disposition=3), lot("150000.00", None, "10", disposition=3),
    ]
    out = clean.clean_transactions(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 1
    assert out[0].n_lots == 1 and out[0].price_m2 == 4000.0


def test_bulk_sale_sums_surfaces(spark):
    rows = [lot("1000000.00", "Appartement", "50", disposition=1) for _ in range(4)]
    out = clean.clean_transactions(spark.createDataFrame(rows, SCHEMA)).first()
    assert (out.n_lots, out.total_surface, out.price_m2) == (4, 200.0, 5000.0)


def test_inclusive_band_and_half_even(spark):
    rows = [lot("100.00", "Maison", "1", disposition=d, commune=1) for d in range(1, 6)]
    t = clean.clean_transactions(spark.createDataFrame(rows, SCHEMA))
    s = stats.commune_stats(t).first()
    assert s.median_price_m2 == 100 and s.n_sales == 5


def test_bround_is_half_even(spark):
    from pyspark.sql import functions as F
    r = spark.range(1).select(F.bround(F.lit(2.5), 0), F.bround(F.lit(3.5), 0)).first()
    assert (r[0], r[1]) == (2.0, 4.0)


# Golden: the 20 Paris arrondissement statistics published by the original
# pipeline (fixed values) and the Paris parent it derives from them.
PARIS = [
    ("75101", 12770.0, 10509.0, 15440.0, 1622), ("75102", 11694.0, 9814.0, 13412.0, 2280),
    ("75103", 12256.0, 10485.0, 14164.0, 3439), ("75104", 12999.0, 10994.0, 15238.0, 2681),
    ("75105", 12269.0, 10430.0, 14083.0, 4401), ("75106", 14810.0, 12329.0, 17708.0, 4066),
    ("75107", 14515.0, 12119.0, 17671.0, 4742), ("75108", 12627.0, 10670.0, 14974.0, 3387),
    ("75109", 11324.0, 9611.0, 12903.0, 5995), ("75110", 10069.0, 8531.0, 11467.0, 8138),
    ("75111", 10511.0, 9103.0, 11753.0, 12463), ("75112", 9704.0, 8415.0, 10870.0, 8298),
    ("75113", 9264.0, 7890.0, 10586.0, 7388), ("75114", 10089.0, 8681.0, 11493.0, 7894),
    ("75115", 10173.0, 8807.0, 11474.0, 15702), ("75116", 11419.0, 9709.0, 13357.0, 12875),
    ("75117", 10841.0, 9169.0, 12321.0, 13244), ("75118", 9536.0, 7888.0, 11203.0, 15742),
    ("75119", 8753.0, 7340.0, 10024.0, 8214), ("75120", 8978.0, 7762.0, 10164.0, 9937),
]


def test_golden_paris_rollup(spark):
    communes = spark.createDataFrame(
        [(c, f"PARIS {c[-2:]}", m, q25, q75, n) for c, m, q25, q75, n in PARIS],
        "code string, name string, median_price_m2 double, q25 double, q75 double, n_sales long")
    p = stats.plm_rollup(communes).first()
    assert (p.code, p.name, p.median_price_m2, p.q25, p.q75, p.n_sales) == ("75056", "Paris", 10630, 9513, 13015, 152508)
    top = stats.top_expensive_communes(stats.upsert(communes, stats.plm_rollup(communes)), 100, 10).collect()
    assert [r.code for r in top[:2]] == ["75106", "75107"]
    assert top[-1].median_price_m2 == 11324.0 and len(top) == 10


def test_lot_columns_cover_schema():
    assert LOT_COLUMNS == [c.split()[0] for c in SCHEMA.split(", ")]


def test_raw_lot_report_overstates_bulk_sales(spark):
    from lotlens.operators import reports
    # one building sold as 4 apartments of 50 m2 for 1,000,000: 5,000/m2 per
    # transaction, but 20,000/m2 for every lot
    rows = [lot("1000000.00", "Appartement", "50", disposition=d) for d in (1, 2, 3) for _ in range(4)]
    rows += [lot("300000.00", "Maison", "100", disposition=d) for d in (4, 5, 6)]
    lots = spark.createDataFrame(rows, SCHEMA)
    t = clean.clean_transactions(lots)
    r = reports.bulk_sale_inflation(lots, t, min_n=5).first()
    assert (r.raw_n, r.clean_n) == (15, 6)
    assert (r.raw_median_price_m2, r.clean_median_price_m2, r.inflation) == (20000.0, 4000.0, 5.0)


def test_two_spellings_fan_out_parcels(spark):
    from lotlens.operators import parcels
    rows = [lot("200000.00", "Maison", "100", disposition=d) for d in range(1, 4)]
    rows += [(dt.date(2024, 1, 3), 9, "Vente", Decimal("300000.00"), "01000", "C-bis", "01", 1, "Maison",
              Decimal("100"))]
    t = clean.clean_transactions(spark.createDataFrame(rows, SCHEMA))
    cad = spark.createDataFrame(
        [("01001000000001", "01001", "01", "parcelle", [[[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0},
                                                          {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]]])],
        "id string, commune string, departement string, type_objet string, "
        "geometry array<array<array<struct<x:double,y:double>>>>")
    out = parcels.sold_parcels(cad, t).collect()
    assert sorted(r.commune_name for r in out) == ["C", "C-bis"]


def test_city_report_merges_same_name_and_number_across_departments(spark):
    from lotlens.operators import reports
    rows = []
    for dept in ("01", "02"):
        for d in range(30):
            rows.append((dt.date(2024, 1, 2), d, "Vente", Decimal("100000.00"), dept + "000", "SAINT-X", dept, 5,
                         "Maison", Decimal("50")))
    lots = spark.createDataFrame(rows, SCHEMA)
    merged = reports.raw_lot_city_report(lots, min_n=50).collect()
    assert len(merged) == 1 and merged[0].volume == 60
    safe = reports.city_report_by_insee(lots, min_n=50).collect()
    assert safe == []


def test_country_row_on_empty_input(spark):
    empty = clean.clean_transactions(spark.createDataFrame([], SCHEMA))
    r = stats.country_stats(empty).collect()
    assert len(r) == 1 and r[0].code == "FR" and r[0].n_sales == 0 and r[0].median_price_m2 is None


def test_country_stats_include_overseas(spark):
    rows = [(dt.date(2024, 1, 2), d, "Vente", Decimal("100000.00"), "97100", "C", "971", 101, "Maison",
             Decimal("50")) for d in range(1, 6)]
    t = clean.clean_transactions(spark.createDataFrame(rows, SCHEMA))
    assert stats.country_stats(t).first().n_sales == 5
    assert stats.region_stats(t).first().code == "01"
