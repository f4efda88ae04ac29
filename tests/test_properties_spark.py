"""Randomised checks of the transaction collapse and the roll-up against
plain-Python implementations of the published rules (small fixtures)."""

import datetime as dt
from collections import defaultdict
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lotlens.operators import clean, stats

SCHEMA = ("date_mutation date, no_disposition int, nature_mutation string, valeur_fonciere decimal(18,2), "
          "code_postal string, commune string, code_departement string, code_commune int, type_local string, "
          "surface_reelle_bati decimal(18,2)")

lot_st = st.tuples(
    st.integers(0, 2),                                   # day offset
    st.integers(1, 2),                                   # disposition
    st.sampled_from(["Vente", "Vente", "Echange"]),      # nature
    st.sampled_from(["0", "100000", "250000.5"]),        # price
    st.sampled_from(["01", "2A"]),                       # department
    st.integers(1, 2),                                   # commune number
    st.sampled_from(["Maison", "Appartement", "Dependance", None]),
    st.sampled_from([None, "0", "20", "55.5"]),          # surface
)


def brute(lots):
    groups = defaultdict(list)
    for d, disp, nat, price, dept, com, typ, surf in lots:
        if nat == "Vente" and Decimal(price) > 0 and surf is not None and Decimal(surf) > 0:
            key = (d, dept, com, disp, Decimal(price).quantize(Decimal("0.01")), dept + "000", "C", nat)
            groups[key].append((typ, Decimal(surf)))
    out = {}
    for key, rows in groups.items():
        if sum(1 for t, _ in rows if t in ("Maison", "Appartement")) == len(rows):
            total = float(sum(s for _, s in rows))
            out[key] = (len(rows), total, float(key[4]) / total)
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(lot_st, min_size=0, max_size=25))
def test_collapse_matches_rules(spark, lots):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=d), disp, nat, Decimal(price), dept + "000", "C", dept, com,
             typ, None if surf is None else Decimal(surf)) for d, disp, nat, price, dept, com, typ, surf in lots]
    t = clean.clean_transactions(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {(r.mutation_date, r.dept_code, r.commune_code, int(r.mutation_id.split("|")[3]), Decimal(str(r.price)).quantize(Decimal("0.01")),
            r.postal_code, r.commune_name, r.nature): (r.n_lots, r.total_surface, r.price_m2) for r in t}
    want = {(dt.date(2024, 1, 1) + dt.timedelta(days=k[0]),) + k[1:]: v for k, v in brute(lots).items()}
    assert got == want


child_st = st.lists(st.tuples(st.integers(0, 5), st.integers(100, 20000), st.one_of(st.none(), st.integers(50, 20000)),
                              st.integers(1, 40)), min_size=1, max_size=12, unique_by=lambda c: c[0])


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(child_st)
def test_rollup_matches_rules(spark, children):
    df = spark.createDataFrame([(f"c{i}", float(m), None if q is None else float(q), None if q is None else float(q) + 1,
                                 n) for i, m, q, n in children],
                               "code string, median_price_m2 double, q25 double, q75 double, n_sales long")
    mapping = spark.createDataFrame([(f"c{i}", "P") for i, *_ in children], "child string, parent string")
    got = stats.weighted_rollup(df, mapping, "child", "parent").collect()
    total = sum(n for *_, n in children)
    if total < 5:
        assert got == []
        return
    w = sum(m * n for _, m, _, n in children) / total
    q = [c[2] for c in children if c[2] is not None]
    r = got[0]
    assert r.n_sales == total and r.median_price_m2 == round(w)
    assert r.q25 == (round(sum(q) / len(q)) if q else None)
