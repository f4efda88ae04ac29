"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The SQL runs against the raw test tables (views ``lineitem orders customer
part events``) and rebuilds the lot adapter, the transaction collapse and the
statistics independently of the Spark code: SUM/COUNT residential check
instead of ``bool_and``, ``quantile_cont`` instead of ``percentile``,
``round_even`` for half-even rounding.
"""

from __future__ import annotations

from lotlens.params import DEPT_TO_REGION, METRO_REGIONS, PLM

BAND = "price_m2 BETWEEN 100 AND 50000"

_DEPT = ("CASE WHEN {n} = 22 THEN '69' WHEN {n} = 23 THEN '75' WHEN {n} = 24 THEN '971' "
         "ELSE lpad(CAST({n} + 1 AS VARCHAR), 2, '0') END")
_COMMUNE = ("CAST(CASE WHEN {n} = 12 THEN {k} + 201 WHEN {n} = 22 THEN {k} + 381 "
            "WHEN {n} IN (23, 24) THEN {k} + 101 ELSE {k} + 1 END AS INTEGER)")


def dept_sql(n: str) -> str:
    return _DEPT.format(n=n)


def commune_sql(k: str, n: str) -> str:
    return _COMMUNE.format(k=k, n=n)


PLACES = f"""places AS (
  SELECT c_custkey,
         {dept_sql('c_nationkey')} AS code_departement,
         {commune_sql('(c_custkey % 20)', 'c_nationkey')} AS code_commune,
         {dept_sql('c_nationkey')} || lpad(CAST((c_custkey % 5) * 10 AS VARCHAR), 3, '0') AS code_postal,
         'COMMUNE ' || {dept_sql('c_nationkey')} || '-' || CAST({commune_sql('(c_custkey % 20)', 'c_nationkey')} AS VARCHAR) AS commune
  FROM customer)"""

LOTS = """lots AS (
  SELECT CAST(o.o_orderdate AS DATE) AS date_mutation,
         CAST(o.o_orderkey % 3 + 1 AS INTEGER) AS no_disposition,
         CASE WHEN o.o_orderstatus = 'P' THEN 'Adjudication' ELSE 'Vente' END AS nature_mutation,
         CAST(o.o_totalprice AS DECIMAL(18,2)) AS valeur_fonciere,
         pl.code_departement, pl.code_commune, pl.code_postal, pl.commune,
         CASE WHEN l.l_linenumber = 7 THEN 'Dependance'
              WHEN p.p_type = 'PROMO' THEN 'Local industriel'
              WHEN p.p_type IN ('LARGE', 'MEDIUM') THEN 'Maison'
              ELSE 'Appartement' END AS type_local,
         CASE WHEN l.l_linenumber = 7 THEN NULL ELSE CAST(l.l_quantity AS DECIMAL(18,2)) END AS surface_reelle_bati
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN places pl ON o.o_custkey = pl.c_custkey)"""

CLEAN = """clean AS (
  SELECT CAST(date_mutation AS VARCHAR) || '|' || code_departement || '|'
           || lpad(CAST(code_commune AS VARCHAR), 3, '0') || '|' || CAST(no_disposition AS VARCHAR)
           || '|' || CAST(valeur_fonciere AS VARCHAR) AS mutation_id,
         date_mutation AS mutation_date,
         nature_mutation AS nature,
         code_departement AS dept_code,
         code_commune AS commune_code,
         code_postal AS postal_code,
         commune AS commune_name,
         CAST(valeur_fonciere AS DOUBLE) AS price,
         CAST(SUM(surface_reelle_bati) AS DOUBLE) AS total_surface,
         COUNT(*) AS n_lots,
         CAST(valeur_fonciere AS DOUBLE) / NULLIF(CAST(SUM(surface_reelle_bati) AS DOUBLE), 0) AS price_m2
  FROM lots
  WHERE nature_mutation = 'Vente' AND valeur_fonciere > 0 AND surface_reelle_bati > 0
  GROUP BY date_mutation, code_departement, code_commune, no_disposition, valeur_fonciere,
           code_postal, commune, nature_mutation
  HAVING SUM(CASE WHEN type_local IN ('Maison', 'Appartement') THEN 1 ELSE 0 END) = COUNT(*))"""

DEPT_REGION = "dept_region AS (SELECT * FROM (VALUES {}) v(dept_code, region_code))".format(
    ", ".join(f"('{d}', '{r}')" for d, r in sorted(DEPT_TO_REGION.items())))

ARR = """arr AS (
  SELECT CAST(unnest(generate_series(a, b)) AS VARCHAR) AS arr_code, parent_code
  FROM (VALUES {}) r(parent_code, a, b))""".format(", ".join(f"('{p[0]}', {p[3]}, {p[4]})" for p in PLM))

PLM_NAMES = "plm_names AS (SELECT * FROM (VALUES {}) v(code, pseudo_canton, name))".format(
    ", ".join(f"('{p[0]}', '{p[1]}', '{p[2]}')" for p in PLM))

CELLS = f"""cells AS (
  SELECT di, k, {dept_sql('di')} AS dept,
         {dept_sql('di')} || lpad(CAST({commune_sql('k', 'di')} AS VARCHAR), 3, '0') AS insee
  FROM (SELECT DISTINCT c_nationkey AS di, CAST(c_custkey % 20 AS INTEGER) AS k FROM customer))"""

COMMUNE_CANTON = """commune_canton AS (
  SELECT insee, dept || '_' || lpad(CAST(k % 4 + 1 AS VARCHAR), 2, '0') AS canton_code
  FROM cells WHERE di NOT IN (12, 22, 23) AND k <> 19 AND insee NOT IN ({parents})
  UNION ALL
  SELECT code AS insee, pseudo_canton AS canton_code FROM plm_names)""".format(
    parents=", ".join(f"'{p[0]}'" for p in PLM))

INSEE = "dept_code || lpad(CAST(commune_code AS VARCHAR), 3, '0')"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = (PLACES, LOTS, CLEAN)


def stats_select(key: str, source: str = "clean", where: str = "TRUE", name: bool = False,
                 quant: str = "cont", min_n: int = 5) -> str:
    """Statistics template: quantiles, count, HAVING, half-even rounding, falsy drop."""
    fn = "quantile_cont" if quant == "cont" else "quantile_disc"
    name_col = ", MIN(commune_name) AS name" if name else ""
    name_out = "name, " if name else ""
    return f"""SELECT code, {name_out}median_price_m2, q25, q75, n_sales FROM (
  SELECT {key} AS code{name_col},
         round_even({fn}(price_m2, 0.5), 0) AS median_price_m2,
         round_even(NULLIF({fn}(price_m2, 0.25), 0), 0) AS q25,
         round_even(NULLIF({fn}(price_m2, 0.75), 0), 0) AS q75,
         COUNT(*) AS n_sales
  FROM {source}
  WHERE {BAND} AND nature = 'Vente' AND {where}
  GROUP BY 1
  HAVING COUNT(*) >= {min_n}) s
WHERE code IS NOT NULL AND code <> '' AND median_price_m2 IS NOT NULL AND median_price_m2 <> 0"""


def rollup_select(child: str, mapping: str, child_key: str, parent_key: str, min_n: int = 5) -> str:
    return f"""SELECT code, round_even(w, 0) AS median_price_m2,
       round_even(NULLIF(q25a, 0), 0) AS q25, round_even(NULLIF(q75a, 0), 0) AS q75, n_sales FROM (
  SELECT m.{parent_key} AS code,
         SUM(c.median_price_m2 * c.n_sales) / SUM(c.n_sales) AS w,
         AVG(c.q25) AS q25a, AVG(c.q75) AS q75a, CAST(SUM(c.n_sales) AS BIGINT) AS n_sales
  FROM {child} c JOIN {mapping} m ON c.code = m.{child_key}
  GROUP BY 1
  HAVING SUM(c.n_sales) >= {min_n}) r"""


COUNTRY = f"""SELECT 'FR' AS code,
       round_even(NULLIF(quantile_cont(price_m2, 0.5), 0), 0) AS median_price_m2,
       round_even(NULLIF(quantile_cont(price_m2, 0.25), 0), 0) AS q25,
       round_even(NULLIF(quantile_cont(price_m2, 0.75), 0), 0) AS q75,
       COUNT(*) AS n_sales
FROM clean WHERE {BAND} AND nature = 'Vente'"""

REGION_SOURCE = "(SELECT c.*, d.region_code FROM clean c JOIN dept_region d ON c.dept_code = d.dept_code)"

COMMUNES_CTE = f"communes AS ({stats_select(INSEE, name=True)})"
PARENTS_CTE = f"""parents AS (
  SELECT r.code, pn.name, r.median_price_m2, r.q25, r.q75, r.n_sales
  FROM ({rollup_select('communes', 'arr', 'arr_code', 'parent_code')}) r
  LEFT JOIN plm_names pn ON r.code = pn.code)"""
COMMUNES_WP_CTE = """communes_wp AS (
  SELECT * FROM communes WHERE code NOT IN (SELECT code FROM parents)
  UNION ALL SELECT * FROM parents)"""
CANTONS_CTE = f"cantons AS ({rollup_select('communes_wp', 'commune_canton', 'insee', 'canton_code')})"

ROLLUP_BASE = BASE + (ARR, PLM_NAMES, COMMUNES_CTE, PARENTS_CTE, COMMUNES_WP_CTE)
ALL_LEVELS_BASE = BASE + (DEPT_REGION, ARR, PLM_NAMES, CELLS, COMMUNE_CANTON, COMMUNES_CTE,
                          PARENTS_CTE, COMMUNES_WP_CTE, CANTONS_CTE)

ALL_LEVELS_CTE = f"""all_stats AS (
  SELECT 'country' AS level, code, CAST(NULL AS VARCHAR) AS name, median_price_m2, q25, q75, n_sales FROM ({COUNTRY}) a
  UNION ALL SELECT 'region', code, NULL, median_price_m2, q25, q75, n_sales FROM ({stats_select('region_code', REGION_SOURCE)}) b
  UNION ALL SELECT 'departement', code, NULL, median_price_m2, q25, q75, n_sales FROM ({stats_select('dept_code')}) c
  UNION ALL SELECT 'canton', code, NULL, median_price_m2, q25, q75, n_sales FROM cantons
  UNION ALL SELECT 'commune', code, name, median_price_m2, q25, q75, n_sales FROM communes_wp
  UNION ALL SELECT 'postcode', code, NULL, median_price_m2, q25, q75, n_sales FROM ({stats_select('postal_code')}) d)"""


def raw_lot_prices_cte() -> str:
    return """raw AS (
  SELECT *, CAST(valeur_fonciere AS DOUBLE) / NULLIF(CAST(surface_reelle_bati AS DOUBLE), 0) AS price_m2
  FROM lots
  WHERE nature_mutation = 'Vente' AND valeur_fonciere > 0 AND surface_reelle_bati > 0
    AND type_local IN ('Maison', 'Appartement'))"""


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["clean_transactions"] = with_(*BASE) + "SELECT * FROM clean"
    q["dept_stats"] = with_(*BASE) + stats_select("dept_code")
    q["dept_stats_approx"] = with_(*BASE) + stats_select("dept_code", quant="disc")
    q["dept_stats_large_homes"] = with_(*BASE) + stats_select("dept_code", where="total_surface >= 100")
    q["commune_stats_one_dept"] = with_(*BASE) + stats_select(INSEE, name=True, where="dept_code = '75'")
    q["region_stats"] = with_(*BASE, DEPT_REGION) + stats_select("region_code", REGION_SOURCE)
    q["country_stats"] = with_(*BASE) + COUNTRY
    q["commune_stats"] = with_(*BASE) + stats_select(INSEE, name=True)
    q["postcode_stats"] = with_(*BASE) + stats_select("postal_code")
    q["plm_rollup"] = with_(*ROLLUP_BASE) + "SELECT * FROM parents"
    q["commune_stats_with_parents"] = with_(*ROLLUP_BASE) + "SELECT * FROM communes_wp"
    q["canton_rollup"] = with_(*ALL_LEVELS_BASE) + "SELECT * FROM cantons"
    q["commune_canton_map"] = with_(PLACES, PLM_NAMES, CELLS, COMMUNE_CANTON) + "SELECT * FROM commune_canton"
    q["all_level_stats"] = with_(*ALL_LEVELS_BASE, ALL_LEVELS_CTE) + "SELECT * FROM all_stats"
    q["areas_per_level"] = (with_(*ALL_LEVELS_BASE, ALL_LEVELS_CTE)
                            + "SELECT level, COUNT(*) AS areas FROM all_stats GROUP BY level")
    q["plm_canton_lookup"] = (with_(*ALL_LEVELS_BASE, ALL_LEVELS_CTE)
                              + "SELECT level, code, median_price_m2, q25, q75, n_sales FROM all_stats "
                                "WHERE level = 'canton' AND code IN ('75_PARIS', '69_LYON', '13_MARSEILLE')")
    q["stats_grouping_sets"] = with_(*BASE, DEPT_REGION) + f"""
SELECT level, code, median_price_m2, q25, q75, n_sales FROM (
  SELECT 'country' AS level, code, median_price_m2, q25, q75, n_sales FROM ({COUNTRY}) a
  UNION ALL SELECT 'region', * FROM ({stats_select('region_code', REGION_SOURCE)}) b
  UNION ALL SELECT 'departement', * FROM ({stats_select('dept_code')}) c
  UNION ALL SELECT 'commune', code, median_price_m2, q25, q75, n_sales FROM ({stats_select(INSEE, name=True)}) d) x"""
    top = """SELECT COALESCE(name, code) AS city, code, median_price_m2, n_sales AS volume
FROM communes_wp WHERE n_sales >= {n} ORDER BY median_price_m2 DESC, code ASC LIMIT 10"""
    q["top_expensive_communes"] = with_(*ROLLUP_BASE) + top.format(n=100)
    q["top_expensive_communes_min20"] = with_(*ROLLUP_BASE) + top.format(n=20)
    q["unmapped_departments"] = with_(*BASE, DEPT_REGION) + """
SELECT DISTINCT c.dept_code FROM clean c
WHERE c.dept_code IS NOT NULL AND c.dept_code NOT IN (SELECT dept_code FROM dept_region)"""
    q["dataset_summary"] = with_(*BASE) + """
SELECT COUNT(*) AS total_transactions, COUNT(DISTINCT dept_code) AS departments,
       MIN(mutation_date) AS earliest_date, MAX(mutation_date) AS latest_date,
       round_even(AVG(price_m2), 4) AS avg_price_m2
FROM clean"""
    q["price_distribution"] = with_(*BASE) + f"""
SELECT round_even(quantile_cont(price_m2, 0.10), 4) AS p10, round_even(quantile_cont(price_m2, 0.25), 4) AS p25,
       round_even(quantile_cont(price_m2, 0.50), 4) AS median, round_even(quantile_cont(price_m2, 0.75), 4) AS p75,
       round_even(quantile_cont(price_m2, 0.90), 4) AS p90, round_even(AVG(price_m2), 4) AS mean
FROM clean WHERE {BAND}"""
    rep = """SELECT {keys}, round_even(quantile_cont(price_m2, 0.5), 2) AS median_price_m2,
       round_even(quantile_cont(price_m2, 0.25), 2) AS q25, round_even(quantile_cont(price_m2, 0.75), 2) AS q75,
       COUNT(*) AS n_sales
FROM clean WHERE {band} GROUP BY {keys} HAVING COUNT(*) >= {n}"""
    q["top_departments"] = with_(*BASE) + rep.format(keys="dept_code", band=BAND, n=10) + \
        " ORDER BY median_price_m2 DESC, dept_code ASC LIMIT 15"
    q["top_communes"] = with_(*BASE) + f"""
SELECT insee_code, commune_name, median_price_m2, n_sales FROM (
  SELECT {INSEE} AS insee_code, commune_name,
         round_even(quantile_cont(price_m2, 0.5), 2) AS median_price_m2, COUNT(*) AS n_sales
  FROM clean WHERE {BAND}
  GROUP BY dept_code, commune_code, commune_name
  HAVING COUNT(*) >= 50) t
ORDER BY median_price_m2 DESC, insee_code ASC, commune_name ASC LIMIT 20"""
    q["top_communes_min10"] = q["top_communes"].replace("HAVING COUNT(*) >= 50", "HAVING COUNT(*) >= 10")
    q["raw_lot_department_stats"] = with_(PLACES, LOTS, raw_lot_prices_cte()) + """
SELECT code_departement AS dept, round_even(NULLIF(quantile_cont(price_m2, 0.5), 0), 2) AS price_m2,
       COUNT(*) AS volume
FROM raw GROUP BY code_departement
HAVING COUNT(*) >= 10 AND code_departement IS NOT NULL AND code_departement <> ''"""
    q["raw_lot_department_stats_approx"] = with_(PLACES, LOTS, raw_lot_prices_cte()) + """
SELECT code_departement AS dept, round_even(NULLIF(quantile_disc(price_m2, 0.5), 0), 2) AS price_m2,
       COUNT(*) AS volume
FROM raw GROUP BY code_departement
HAVING COUNT(*) >= 10 AND code_departement IS NOT NULL AND code_departement <> ''"""
    q["refreshed_department_stats"] = with_(PLACES, LOTS, raw_lot_prices_cte()) + """
SELECT code_departement AS dept, COUNT(*) AS volume, true AS within
FROM raw GROUP BY code_departement
HAVING COUNT(*) >= 10 AND code_departement IS NOT NULL AND code_departement <> ''"""
    q["raw_lot_city_report"] = with_(PLACES, LOTS, raw_lot_prices_cte()) + """
SELECT commune AS city, code_commune AS code, type_local AS property_type,
       round_even(NULLIF(quantile_cont(price_m2, 0.5), 0), 2) AS median_price_m2, COUNT(*) AS volume
FROM raw GROUP BY commune, code_commune, type_local HAVING COUNT(*) >= 50
ORDER BY volume DESC, city ASC, code ASC, property_type ASC LIMIT 20"""
    q["city_report_by_insee"] = with_(PLACES, LOTS, raw_lot_prices_cte()) + """
SELECT code_departement || lpad(CAST(code_commune AS VARCHAR), 3, '0') AS insee, MIN(commune) AS city,
       type_local AS property_type,
       round_even(NULLIF(quantile_cont(price_m2, 0.5), 0), 2) AS median_price_m2, COUNT(*) AS volume
FROM raw GROUP BY 1, type_local HAVING COUNT(*) >= 50
ORDER BY volume DESC, insee ASC, property_type ASC LIMIT 20"""
    q["bulk_sale_inflation"] = with_(*BASE, raw_lot_prices_cte()) + """
SELECT r.dept_code, round_even(r.m, 2) AS raw_median_price_m2, round_even(c.m, 2) AS clean_median_price_m2,
       r.n AS raw_n, c.n AS clean_n, round_even(r.m / c.m, 4) AS inflation
FROM (SELECT code_departement AS dept_code, quantile_cont(price_m2, 0.5) AS m, COUNT(*) AS n FROM raw GROUP BY 1) r
JOIN (SELECT dept_code, quantile_cont(price_m2, 0.5) AS m, COUNT(*) AS n FROM clean GROUP BY 1) c
  ON r.dept_code = c.dept_code
WHERE r.n >= 10 AND c.n >= 10"""
    return q


# --- geometry, publishing, parcels, viewports, tiles -------------------------

def _lit(v: float) -> str:
    return repr(float(v))


def _geo_consts():
    import math as _m
    from lotlens.params import (GRS80_INV_F, LAMBERT93_C, LAMBERT93_LON0_DEG, LAMBERT93_N,
                                LAMBERT93_X0, LAMBERT93_YS)
    f = 1.0 / GRS80_INV_F
    e = _m.sqrt(2 * f - f * f)
    return dict(e=e, lon0=_m.radians(LAMBERT93_LON0_DEG), n=LAMBERT93_N, c=LAMBERT93_C,
                x0=LAMBERT93_X0, ys=LAMBERT93_YS, inv_n=1.0 / LAMBERT93_N, half_pi=_m.pi / 2, half_e=e / 2)


def lonlat_sql(x: str, y: str, alias_lon: str = "lon", alias_lat: str = "lat", src: str = "src") -> str:
    """SELECT *, lon, lat FROM src — inverse Lambert-93, 5 latitude iterations."""
    k = _geo_consts()
    phi = f"({_lit(k['half_pi'])} - 2 * atan(t))"
    for _ in range(5):
        phi = (f"({_lit(k['half_pi'])} - 2 * atan(t * pow((1 - {_lit(k['e'])} * sin({phi})) / "
               f"(1 + {_lit(k['e'])} * sin({phi})), {_lit(k['half_e'])})))")
    return f"""SELECT *, degrees({_lit(k['lon0'])} + atan2(dx, dy) / {_lit(k['n'])}) AS {alias_lon},
       degrees({phi}) AS {alias_lat}
FROM (SELECT *, pow(sqrt(dx * dx + dy * dy) / {_lit(k['c'])}, {_lit(k['inv_n'])}) AS t
      FROM (SELECT *, {x} - {_lit(k['x0'])} AS dx, {_lit(k['ys'])} - {y} AS dy FROM {src}) a) b"""


CELLGEO = f"""cellgeo AS (
  SELECT di, k, dept, insee,
         'COMMUNE ' || dept || '-' || CAST({commune_sql('k', 'di')} AS VARCHAR) AS name,
         CASE WHEN di NOT IN (12, 22, 23) AND k <> 19 THEN lpad(CAST(k % 4 + 1 AS VARCHAR), 2, '0') END AS canton,
         CAST(600000.0 + (di % 5) * 40000 + (k % 4) * 10000 AS DOUBLE) AS x0,
         CAST(6500000.0 + floor(di / 5) * 50000 + floor(k / 4) * 10000 AS DOUBLE) AS y0
  FROM cells)"""

_OFFS = [(0, 0, .5, 0), (.5, 0, 1, 0), (1, 0, 1, .5), (1, .5, 1, 1), (1, 1, .5, 1), (.5, 1, 0, 1),
         (0, 1, 0, .5), (0, .5, 0, 0)]
CELL_EDGES = """cell_edges AS (
  SELECT insee, x0 + o.fa * 10000 AS ax, y0 + o.ga * 10000 AS ay, x0 + o.fb * 10000 AS bx, y0 + o.gb * 10000 AS "by"
  FROM (SELECT c.*, unnest([{}]) AS o FROM cellgeo c) s)""".format(
    ", ".join(f"{{'fa': {a}, 'ga': {b}, 'fb': {c}, 'gb': {d}}}" for a, b, c, d in _OFFS))

METRO = ", ".join(f"'{r}'" for r in METRO_REGIONS)

MEMBERS = f"""members AS (
  SELECT 'country' AS level, 'FR' AS code, 'France' AS name, c.insee
    FROM cellgeo c JOIN dept_region d ON c.dept = d.dept_code WHERE d.region_code IN ({METRO})
  UNION ALL SELECT 'region', d.region_code, 'Region ' || d.region_code, c.insee
    FROM cellgeo c JOIN dept_region d ON c.dept = d.dept_code
  UNION ALL SELECT 'departement', dept, 'Departement ' || dept, insee FROM cellgeo
  UNION ALL SELECT 'canton', dept || '_' || canton, 'Canton ' || canton, insee FROM cellgeo WHERE canton IS NOT NULL
  UNION ALL SELECT 'canton', pn.pseudo_canton, pn.name, c.insee
    FROM cellgeo c JOIN arr a ON c.insee = a.arr_code JOIN plm_names pn ON a.parent_code = pn.code
  UNION ALL SELECT 'postcode', dept || lpad(CAST((k % 5) * 10 AS VARCHAR), 3, '0'),
                   'Postcode ' || dept || lpad(CAST((k % 5) * 10 AS VARCHAR), 3, '0'), insee FROM cellgeo
  UNION ALL SELECT 'commune', insee, name, insee FROM cellgeo)"""


def boundary_sql(src: str, keys: str) -> str:
    """Edges of src (keys..., ax, ay, bx, "by") whose undirected copy occurs once per group."""
    a_first = '(ax < bx OR (ax = bx AND ay <= "by"))'
    return f"""SELECT {keys}, min(ax) AS ax, min(ay) AS ay, min(bx) AS bx, min("by") AS "by"
FROM (SELECT *, CASE WHEN {a_first} THEN ax ELSE bx END AS ux1, CASE WHEN {a_first} THEN ay ELSE "by" END AS uy1,
             CASE WHEN {a_first} THEN bx ELSE ax END AS ux2, CASE WHEN {a_first} THEN "by" ELSE ay END AS uy2
      FROM {src}) u
GROUP BY {keys}, ux1, uy1, ux2, uy2 HAVING COUNT(*) = 1"""


GEO_BASE = (PLACES, DEPT_REGION, ARR, PLM_NAMES, CELLS, CELLGEO)

P7 = "CASE WHEN {c} LIKE '97%' OR {c} LIKE '98%' THEN substr({c}, 1, 3) ELSE substr({c}, 1, 2) END"

CORNERS = """corners AS (
  SELECT insee AS code, o.idx AS idx, x0 + o.fx * 10000 AS px, y0 + o.fy * 10000 AS py
  FROM (SELECT c.*, unnest([{'idx': 0, 'fx': 0.0, 'fy': 0.0}, {'idx': 1, 'fx': 1.0, 'fy': 0.0},
                            {'idx': 2, 'fx': 1.0, 'fy': 1.0}, {'idx': 3, 'fx': 0.0, 'fy': 1.0},
                            {'idx': 4, 'fx': 0.0, 'fy': 0.0}]) AS o FROM cellgeo c) s)"""

PROJECTED = f"""projected AS (
  SELECT code, idx, round_even(lon, 5) AS lon, round_even(lat, 5) AS lat
  FROM ({lonlat_sql('px', 'py', src='corners')}) p)"""

PARCELS = """parcels AS (
  SELECT code_departement || lpad(CAST(code_commune AS VARCHAR), 3, '0') || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id,
         code_departement || lpad(CAST(code_commune AS VARCHAR), 3, '0') AS commune,
         code_departement AS departement,
         CASE WHEN c_custkey % 3 = 2 THEN 'batiment' ELSE 'parcelle' END AS type_objet,
         (c_custkey % 20) = 7 AS geom_null
  FROM places)"""

VIEWPORTS = """viewports AS (
  SELECT event_id, user_id, ts, west, south, west + 30000 AS east, south + 30000 AS north,
         CAST(4 + event_id % 14 AS INTEGER) AS zoom
  FROM (SELECT event_id, user_id, ts, 600000.0 + (event_id * 7919) % 200000 AS west,
               6500000.0 + (event_id * 104729) % 250000 AS south FROM events) e)"""

DEPT_BBOX = """dept_bbox AS (
  SELECT dept, min(x0) AS minx, min(y0) AS miny, max(x0) + 10000 AS maxx, max(y0) + 10000 AS maxy
  FROM cellgeo GROUP BY dept)"""

VISIBLE = """visible AS (
  SELECT v.event_id, v.user_id, v.ts, v.zoom, b.dept
  FROM viewports v JOIN dept_bbox b
    ON b.maxx >= v.west AND b.minx <= v.east AND b.maxy >= v.south AND b.miny <= v.north)"""

TO_LOAD = """to_load AS (
  SELECT user_id, dept, event_id, ts FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, dept ORDER BY ts, event_id) AS rn
    FROM visible WHERE zoom >= 10) x WHERE rn = 1)"""


def _tile_x(lon: str, z: str) -> str:
    return f"CAST(least(floor(({lon} + 180.0) / 360.0 * pow(2.0, {z})), pow(2.0, {z}) - 1) AS INTEGER)"


def _tile_y(lat: str, z: str) -> str:
    y = f"(1.0 - ln(tan(radians({lat})) + 1.0 / cos(radians({lat}))) / pi()) / 2.0 * pow(2.0, {z})"
    return f"CAST(least(greatest(floor({y}), 0.0), pow(2.0, {z}) - 1) AS INTEGER)"


TILES = f"""tiles AS (
  SELECT 'communes' AS layer, CAST(z AS INTEGER) AS z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, code FROM (
    SELECT code, z, unnest(generate_series({_tile_x('minlon', 'z')}, {_tile_x('maxlon', 'z')})) AS x,
           ymin, ymax
    FROM (SELECT code, minlon, maxlon, z, {_tile_y('maxlat', 'z')} AS ymin, {_tile_y('minlat', 'z')} AS ymax
          FROM (SELECT code, min(lon) AS minlon, max(lon) AS maxlon, min(lat) AS minlat, max(lat) AS maxlat,
                       unnest(generate_series(12, 15)) AS z
                FROM projected GROUP BY code) b) c) d,
  LATERAL (SELECT unnest(generate_series(ymin, ymax)) AS y) e)"""


def _color_sql(price: str) -> str:
    from lotlens.params import PRICE_COLOR_MISSING, PRICE_COLOR_STOPS
    p = f"least(greatest(coalesce(CAST({price} AS DOUBLE), {_lit(PRICE_COLOR_MISSING)}), " \
        f"{_lit(PRICE_COLOR_STOPS[0][0])}), {_lit(PRICE_COLOR_STOPS[-1][0])})"

    def rgb(h):
        h = h.lstrip("#")
        return int(h[0:2], 16), int(h[2:4], 16), int(h[4:6], 16)
    parts = []
    for ch in range(3):
        arms = []
        for (x0, c0), (x1, c1) in zip(PRICE_COLOR_STOPS[:-1], PRICE_COLOR_STOPS[1:]):
            v0, v1 = rgb(c0)[ch], rgb(c1)[ch]
            arms.append(f"WHEN {p} <= {_lit(x1)} THEN {_lit(v0)} + ({p} - {_lit(x0)}) * {_lit((v1 - v0) / (x1 - x0))}")
        last = rgb(PRICE_COLOR_STOPS[-1][1])[ch]
        parts.append(f"printf('%02x', CAST(round_even(CASE {' '.join(arms)} ELSE {_lit(last)} END, 0) AS INTEGER))")
    return "'#' || " + " || ".join(parts)


def build_geo(q: dict[str, str]) -> None:
    base = GEO_BASE
    q["dissolve_boundary_edges"] = with_(*base, CELL_EDGES) + "SELECT * FROM (" + boundary_sql(f"""(
  SELECT 'departement' AS level, c.dept AS code, e.ax, e.ay, e.bx, e."by" FROM cell_edges e JOIN cellgeo c ON e.insee = c.insee
  UNION ALL
  SELECT 'country', 'FR', e.ax, e.ay, e.bx, e."by" FROM cell_edges e JOIN cellgeo c ON e.insee = c.insee
    JOIN dept_region d ON c.dept = d.dept_code WHERE d.region_code IN ({METRO}))""", "level, code") + ") z"
    q["dissolved_layers"] = with_(*base, CELL_EDGES, MEMBERS) + f"""
SELECT a.level, a.code, a.name, a.area_m2, b.vertices FROM
  (SELECT level, code, name, CAST(COUNT(*) AS DOUBLE) * 100000000.0 AS area_m2 FROM members GROUP BY level, code, name) a
JOIN
  (SELECT level, code, name, COUNT(*) AS vertices FROM ({boundary_sql(
      '(SELECT m.level, m.code, m.name, e.ax, e.ay, e.bx, e."by" FROM members m JOIN cell_edges e ON m.insee = e.insee)',
      'level, code, name')}) bb GROUP BY level, code, name) b
ON a.level = b.level AND a.code = b.code AND a.name = b.name"""
    all_stats = ALL_LEVELS_BASE + (ALL_LEVELS_CTE,)
    geo_stats = tuple(dict.fromkeys(all_stats + (CELLGEO,)))
    q["enriched_features"] = with_(*geo_stats, MEMBERS) + """
SELECT f.level, f.code, f.name, s.median_price_m2 AS price_m2, s.n_sales, s.q25, s.q75
FROM (SELECT DISTINCT level, code, name FROM members) f
LEFT JOIN all_stats s ON f.level = s.level AND f.code = s.code"""
    # Douglas-Peucker on the rectilinear grid shapes keeps exactly the junction
    # vertices (degree != 2 in the level's edge graph) and the corners; a vertex
    # where a feature touches itself is visited twice (degree 4 in the feature)
    bedges = "bedges AS (" + boundary_sql(
        '(SELECT m.level, m.code, m.name, e.ax, e.ay, e.bx, e."by" FROM members m JOIN cell_edges e ON m.insee = e.insee)',
        "level, code, name") + ")"
    kept_ctes = """
, lvl_edges AS (
  SELECT DISTINCT level, least(ax, bx) AS x1, CASE WHEN ax < bx OR (ax = bx AND ay <= "by") THEN ay ELSE "by" END AS y1,
         greatest(ax, bx) AS x2, CASE WHEN ax < bx OR (ax = bx AND ay <= "by") THEN "by" ELSE ay END AS y2
  FROM bedges)
, lvl_deg AS (
  SELECT level, x, y, COUNT(*) AS deg
  FROM (SELECT level, x1 AS x, y1 AS y FROM lvl_edges UNION ALL SELECT level, x2, y2 FROM lvl_edges) v
  GROUP BY level, x, y)
, fv AS (
  SELECT level, code, name, x, y, COUNT(*) AS degf, bool_or(h) AS has_h, bool_or(NOT h) AS has_v
  FROM (SELECT level, code, name, ax AS x, ay AS y, ay = "by" AS h FROM bedges
        UNION ALL SELECT level, code, name, bx, "by", ay = "by" FROM bedges) w
  GROUP BY level, code, name, x, y)
, kept AS (
  SELECT f.level, f.code, f.name, f.x, f.y, f.degf
  FROM fv f JOIN lvl_deg d ON f.level = d.level AND f.x = d.x AND f.y = d.y
  WHERE d.deg <> 2 OR (f.has_h AND f.has_v))
"""
    q["simplified_vertices"] = with_(*base, CELL_EDGES, MEMBERS, bedges) + kept_ctes + """
SELECT level, code, name, CAST(SUM(degf // 2) AS BIGINT) AS vertices FROM kept GROUP BY level, code, name"""
    from lotlens.params import TILE_ZOOM_LAYERS
    from lotlens.operators.tiles import LEVEL_TO_TILE_LAYER
    layer_zoom = ", ".join(f"('{lvl}', '{lay}', {lo}, {hi})" for lvl, lay in LEVEL_TO_TILE_LAYER.items()
                           for name, lo, hi in TILE_ZOOM_LAYERS if name == lay)
    q["layer_tiles"] = with_(*base, CELL_EDGES, MEMBERS, bedges) + kept_ctes + f"""
, proj AS (SELECT level, code, round_even(lon, 5) AS lon, round_even(lat, 5) AS lat
           FROM ({lonlat_sql('x', 'y', src='kept')}) p)
, bb AS (SELECT level, code, min(lon) AS minlon, max(lon) AS maxlon, min(lat) AS minlat, max(lat) AS maxlat
         FROM proj GROUP BY level, code)
SELECT layer, CAST(z AS INTEGER) AS z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, code FROM (
  SELECT layer, code, z, unnest(generate_series({_tile_x('minlon', 'z')}, {_tile_x('maxlon', 'z')})) AS x, ymin, ymax
  FROM (SELECT layer, code, minlon, maxlon, z, {_tile_y('maxlat', 'z')} AS ymin, {_tile_y('minlat', 'z')} AS ymax
        FROM (SELECT lz.layer, b.code, b.minlon, b.maxlon, b.minlat, b.maxlat, unnest(generate_series(lz.lo, lz.hi)) AS z
              FROM bb b JOIN (VALUES {layer_zoom}) lz(level, layer, lo, hi) ON b.level = lz.level) t1) t2) t3,
LATERAL (SELECT unnest(generate_series(ymin, ymax)) AS y) t4"""
    q["published_vertices"] = with_(*base, CELL_EDGES, MEMBERS, bedges) + kept_ctes + f"""
SELECT level, code, round_even(lon, 5) AS lon, round_even(lat, 5) AS lat, CAST(SUM(degf // 2) AS BIGINT) AS visits
FROM ({lonlat_sql('x', 'y', src='kept')}) p GROUP BY 1, 2, 3, 4"""
    q["geojson_features"] = with_(*geo_stats, CORNERS, PROJECTED) + f"""
SELECT c.insee AS code, {P7.format(c='c.insee')} AS dept,
       '{{"type":"Feature","properties":{{"code":"' || c.insee || '","name":"' || c.name || '"'
       || coalesce(',"price_m2":' || s.median_price_m2, '') || coalesce(',"n_sales":' || s.n_sales, '')
       || coalesce(',"q25":' || s.q25, '') || coalesce(',"q75":' || s.q75, '')
       || '}},"geometry":{{"type":"Polygon","coordinates":[[' || g.ring || ']]}}}}' AS feature
FROM cellgeo c
JOIN (SELECT code, string_agg('[' || lon || ',' || lat || ']', ',' ORDER BY idx) AS ring FROM projected GROUP BY code) g
  ON g.code = c.insee
LEFT JOIN (SELECT * FROM all_stats WHERE level = 'commune') s ON c.insee = s.code"""
    q["sketch_rank_error"] = with_(*all_stats) + """
SELECT level, code, n_sales, TRUE AS "within" FROM all_stats
WHERE level <> 'canton' AND NOT (level = 'commune' AND code IN (SELECT code FROM plm_names))"""
    q["simplified_area"] = with_(*base, MEMBERS) + """
SELECT level, code, name, CAST(COUNT(*) AS DOUBLE) * 100000000.0 AS area_m2 FROM members GROUP BY level, code, name"""
    q["dissolved_outline"] = "SELECT code, name, area_m2, vertices FROM (" + q["dissolved_layers"] + \
        ") d WHERE level = 'country'"
    nine = ", ".join(f"{{'idx': {i}, 'fx': {a}, 'fy': {b}}}" for i, (a, b) in enumerate(
        [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0), (1.0, 0.5), (1.0, 1.0), (0.5, 1.0), (0.0, 1.0), (0.0, 0.5), (0.0, 0.0)]))
    cell_pts = f"""cell_pts AS (
  SELECT insee AS code, o.idx AS idx, x0 + o.fx * 10000 AS px, y0 + o.fy * 10000 AS py
  FROM (SELECT c.*, unnest([{nine}]) AS o FROM cellgeo c) s)"""
    q["lambert93_to_wgs84"] = with_(*base, cell_pts) + f"""
SELECT code, CAST(0 AS INTEGER) AS part, CAST(0 AS INTEGER) AS ring, CAST(idx AS INTEGER) AS idx, px AS x, py AS y, round_even(lon, 7) AS lon, round_even(lat, 7) AS lat
FROM ({lonlat_sql('px', 'py', src='cell_pts')}) p"""
    q["rounded_coordinates"] = with_(*base, CORNERS, PROJECTED) + \
        "SELECT code, CAST(0 AS INTEGER) AS part, CAST(0 AS INTEGER) AS ring, CAST(idx AS INTEGER) AS idx, lon, lat FROM projected"
    q["feature_bbox"] = with_(*base, DEPT_BBOX) + """
SELECT dept, minx, miny, maxx, maxy, maxx - minx AS width, maxy - miny AS height FROM dept_bbox"""
    vbase = base + (DEPT_BBOX, "events_placeholder")
    vb = tuple(x for x in vbase if x != "events_placeholder") + (VIEWPORTS, VISIBLE)
    q["viewport_departments"] = with_(*vb) + "SELECT event_id, dept FROM visible"
    q["viewport_to_load"] = with_(*vb, TO_LOAD) + "SELECT * FROM to_load"
    q["viewport_communes"] = with_(*vb, TO_LOAD) + f"""
SELECT t.user_id, t.event_id, t.dept, c.insee AS code FROM to_load t JOIN cellgeo c ON {P7.format(c='c.insee')} = t.dept"""
    q["crowded_viewports"] = """
SELECT v.event_id, count(*) AS parcels, min(p.c_custkey) AS first, max(p.c_custkey) AS last
FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 30000.0 ELSE 1500.0 END AS side,
             600000.0 + CASE WHEN event_id % 10 = 0 THEN event_id * 7919 % 200000 ELSE event_id * 7919 % 8000 END AS west,
             6500000.0 + CASE WHEN event_id % 10 = 0 THEN event_id * 104729 % 250000 ELSE event_id * 104729 % 1500 END AS south
      FROM events) v
JOIN (SELECT c_custkey,
             600000.0 + (c_nationkey % 5) * 40000 + (c_custkey % 4) * 10000 + 100 + (c_custkey // 20 % 90) * 100 AS x,
             6500000.0 + (c_nationkey // 5) * 50000 + (c_custkey % 20 // 4) * 10000 + 100 + (c_custkey // 1800 % 90) * 100 AS y
      FROM customer WHERE c_custkey % 20 <> 7) p
  ON p.x + 50 >= v.west AND p.x <= v.west + v.side AND p.y + 50 >= v.south AND p.y <= v.south + v.side
GROUP BY v.event_id"""
    q["loaded_features"] = with_(*tuple(dict.fromkeys(geo_stats + vb)), TO_LOAD) + f"""
SELECT t.user_id, t.event_id, t.dept, c.insee AS code, s.median_price_m2 AS price_m2, s.n_sales
FROM to_load t JOIN cellgeo c ON {P7.format(c='c.insee')} = t.dept
LEFT JOIN (SELECT * FROM all_stats WHERE level = 'commune') s ON c.insee = s.code"""
    q["commune_dept_index"] = with_(*base) + f"SELECT {P7.format(c='insee')} AS dept, COUNT(*) AS n FROM cellgeo GROUP BY 1"
    q["enrichment_coverage"] = with_(*geo_stats) + """
SELECT COUNT(*) AS features, COUNT(s.code) AS enriched FROM cellgeo c
LEFT JOIN (SELECT code FROM all_stats WHERE level = 'commune') s ON c.insee = s.code"""
    q["enriched_postcodes"] = with_(*tuple(dict.fromkeys(BASE + base))) + f"""
SELECT p.code, s.median_price_m2 AS price_m2, s.n_sales, s.q25, s.q75
FROM (SELECT DISTINCT dept || lpad(CAST((k % 5) * 10 AS VARCHAR), 3, '0') AS code FROM cellgeo) p
LEFT JOIN ({stats_select('postal_code')}) s ON p.code = s.code"""
    q["commune_layer"] = with_(*base) + "SELECT insee AS code, name FROM cellgeo"
    q["canton_layer"] = with_(*base, MEMBERS) + "SELECT DISTINCT code, name FROM members WHERE level = 'canton'"
    parcel_q = f"""
SELECT parcel_id, dept_code, price_m2, n_sales, commune_name FROM (
  SELECT p.id AS parcel_id, p.departement AS dept_code, round_even(NULLIF(s.m, 0), 0) AS price_m2, s.n_sales,
         s.commune_name, row_number() OVER (PARTITION BY p.departement ORDER BY p.id, s.commune_name) AS rn
  FROM parcels p JOIN (
    SELECT {INSEE} AS insee_com, commune_name, COUNT(*) AS n_sales, quantile_cont(price_m2, 0.5) AS m
    FROM clean WHERE price_m2 > 100 AND price_m2 < 50000
    GROUP BY dept_code, commune_code, commune_name) s ON p.commune = s.insee_com
  WHERE p.type_objet = 'parcelle' AND NOT p.geom_null) x
{{top}}"""
    q["parcel_prices"] = with_(*BASE, PARCELS) + parcel_q.format(top="")
    q["parcel_prices_cap10"] = with_(*BASE, PARCELS) + parcel_q.format(top="WHERE rn <= 10")
    # a 50 m parcel square keeps its 4 corners (+ closing point) at 0.5 m tolerance
    q["parcel_layer"] = with_(*BASE, PARCELS) + "SELECT *, CAST(5 AS INTEGER) AS points FROM (" + \
        parcel_q.format(top="") + ") p"
    q["parcel_files"] = with_(*BASE, PARCELS) + "SELECT dept_code, price_m2, n_sales, commune_name AS name, " \
        "CAST(5 AS INTEGER) AS points FROM (" + parcel_q.format(top="") + ") p"
    q["tile_assignment"] = with_(*base, CORNERS, PROJECTED, TILES) + "SELECT * FROM tiles"
    q["tile_top_features"] = with_(*tuple(dict.fromkeys(ROLLUP_BASE + base)), CORNERS, PROJECTED, TILES) + """
SELECT layer, z, x, y, code, rank FROM (
  SELECT t.*, CAST(row_number() OVER (PARTITION BY layer, z, x, y ORDER BY s.n_sales DESC NULLS LAST, t.code ASC) AS INTEGER) AS rank
  FROM tiles t LEFT JOIN communes_wp s ON t.code = s.code) r
"""
    parcel_corners = f"""pcorners AS (
  SELECT id AS code, x0 + o.fx * 50 AS px, y0 + o.fy * 50 AS py FROM (
    SELECT {dept_sql('c_nationkey')} || lpad(CAST({commune_sql('(c_custkey % 20)', 'c_nationkey')} AS VARCHAR), 3, '0')
             || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id,
           600000.0 + (c_nationkey % 5) * 40000 + ((c_custkey % 20) % 4) * 10000 + 100 + (floor(c_custkey / 20) % 90) * 100 AS x0,
           6500000.0 + floor(c_nationkey / 5) * 50000 + floor((c_custkey % 20) / 4) * 10000 + 100
             + (floor(floor(c_custkey / 20) / 90) % 90) * 100 AS y0,
           unnest([{{'fx': 0.0, 'fy': 0.0}}, {{'fx': 1.0, 'fy': 0.0}}, {{'fx': 1.0, 'fy': 1.0}}, {{'fx': 0.0, 'fy': 1.0}}]) AS o
    FROM customer) c
  WHERE id IN (SELECT parcel_id FROM ({parcel_q.format(top="")}) kept))"""
    q["parcel_tiles"] = with_(*BASE, PARCELS, parcel_corners) + f"""
SELECT 'parcels' AS layer, CAST(z AS INTEGER) AS z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, code FROM (
  SELECT code, z, unnest(generate_series({_tile_x('minlon', 'z')}, {_tile_x('maxlon', 'z')})) AS x, ymin, ymax
  FROM (SELECT code, minlon, maxlon, z, {_tile_y('maxlat', 'z')} AS ymin, {_tile_y('minlat', 'z')} AS ymax
        FROM (SELECT code, min(lon) AS minlon, max(lon) AS maxlon, min(lat) AS minlat, max(lat) AS maxlat,
                     unnest(generate_series(16, 20)) AS z
              FROM ({lonlat_sql('px', 'py', src='pcorners')}) pr GROUP BY code) b) c) d,
LATERAL (SELECT unnest(generate_series(ymin, ymax)) AS y) e"""
    # bit by bit: bit i of a tile's x is bit 2 i of its place on the curve, bit i of y bit 2 i + 1
    curve = " + ".join(f"((x >> {i}) & 1) * {1 << 2 * i} + ((y >> {i}) & 1) * {2 << 2 * i}" for i in range(20))
    q["parcel_first_zooms"] = with_(*BASE, PARCELS, parcel_corners) + f"""
, centres AS (
  SELECT code, {_tile_x('lon', 20)}::BIGINT AS x, {_tile_y('lat', 20)}::BIGINT AS y
  FROM (SELECT code, (min(lon) + max(lon)) / 2 AS lon, (min(lat) + max(lat)) / 2 AS lat
        FROM ({lonlat_sql('px', 'py', src='pcorners')}) pr GROUP BY code) b),
gaps AS (
  SELECT code, x, y, curve - lag(curve) OVER (ORDER BY curve, code) AS gap FROM (SELECT *, {curve} AS curve FROM centres) c),
ranked AS (
  SELECT code, z, row_number() OVER (PARTITION BY z, x >> (20 - z), y >> (20 - z) ORDER BY gap DESC NULLS FIRST, code) AS rank
  FROM (SELECT *, unnest(generate_series(7, 17)) AS z FROM gaps) g)
SELECT 'parcels' AS layer, code, CAST(coalesce(min(z) FILTER (WHERE rank <= 8), 18) AS INTEGER) AS first_zoom
FROM ranked GROUP BY code"""
    q["geojson_parsed"] = with_(*geo_stats) + """
SELECT c.insee AS code, 'Polygon' AS geom_type, CAST(1 AS INTEGER) AS parts, CAST(1 AS INTEGER) AS rings,
       CAST(5 AS INTEGER) AS ring_points,
       s.median_price_m2 AS price_m2, s.n_sales, s.q25, s.q75
FROM cellgeo c LEFT JOIN (SELECT * FROM all_stats WHERE level = 'commune') s ON c.insee = s.code"""
    q["department_files"] = with_(*geo_stats) + f"""
SELECT {P7.format(c='c.insee')} AS dept, c.insee AS code, s.median_price_m2 AS price_m2, s.n_sales, s.q25, s.q75,
       CAST(5 AS INTEGER) AS points
FROM cellgeo c LEFT JOIN (SELECT * FROM all_stats WHERE level = 'commune') s ON c.insee = s.code"""
    q["price_color"] = with_(*geo_stats) + f"""
SELECT c.insee AS code, s.median_price_m2 AS price_m2, {_color_sql('s.median_price_m2')} AS color
FROM cellgeo c LEFT JOIN (SELECT * FROM all_stats WHERE level = 'commune') s ON c.insee = s.code"""
    from lotlens.params import APP_ZOOM_LAYERS
    zooms = ", ".join(f"('{a}', {b}, {c})" for a, b, c in APP_ZOOM_LAYERS)
    q["zoom_levels"] = with_(VIEWPORTS) + f"""
SELECT v.event_id, v.zoom, z.layer FROM viewports v
JOIN (VALUES {zooms}) z(layer, minzoom, maxzoom) ON v.zoom >= z.minzoom AND v.zoom < z.maxzoom"""
    from lotlens.params import TILE_ZOOM_LAYERS
    closed = ", ".join(f"('{a}', {b}, {c})" for a, b, c in TILE_ZOOM_LAYERS)
    q["tile_zoom_layers"] = with_(VIEWPORTS) + f"""
SELECT v.event_id, v.zoom, z.layer FROM viewports v
JOIN (VALUES {closed}) z(layer, minzoom, maxzoom) ON v.zoom BETWEEN z.minzoom AND z.maxzoom"""
    q["csv_lots"] = with_(PLACES, LOTS) + "SELECT * FROM lots"
    q["csv_mixed_headers"] = q["csv_lots"]
    # four corners, and the middle vertices that stand more than one tolerance out
    squares = """
SELECT ['country', 'region', 'departement', 'canton', 'commune', 'arrondissement', 'parcel'][c_custkey % 7 + 1] AS level,
       CAST(c_custkey AS VARCHAR) AS code,
       4 + CAST(len(list_filter([{sides}], lambda i: [0, 0.5, 0.95, 1.05, 2][(c_custkey // i + c_custkey) % 5 + 1] > 1)) AS BIGINT)
       {more} AS vertices
FROM customer"""
    q["simplified_squares"] = squares.format(sides="1, 5, 25, 125", more="")
    q["simplified_squares_shared"] = squares.format(
        sides="1, 5, 25", more="+ CASE WHEN (c_custkey // 125 + c_custkey) % 5 > 0 THEN 1 ELSE 0 END")
    q["simplified_crossings"] = """
SELECT 'commune' AS level, u.code, u.vertices, 0::BIGINT AS stray_holes, 0::BIGINT AS crossings
FROM (SELECT unnest(CASE c_custkey % 4 WHEN 1 THEN [{'code': c_custkey::VARCHAR, 'vertices': 8::BIGINT}]
                    WHEN 2 THEN [{'code': c_custkey::VARCHAR, 'vertices': 5::BIGINT},
                                 {'code': c_custkey || 's', 'vertices': 3::BIGINT}]
                    ELSE [{'code': c_custkey::VARCHAR, 'vertices': 4::BIGINT}] END) AS u FROM customer)"""
    q["boundary_documents"] = r"""
SELECT 'commune' AS level, c_custkey::VARCHAR AS code, 'a}{"\' || c_custkey AS name,
       CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS parts, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 END AS rings,
       CASE k WHEN 0 THEN 5 WHEN 1 THEN 9 WHEN 2 THEN 9 END AS points,
       CASE k WHEN 0 THEN 5 * x + 100 WHEN 1 THEN 9 * x + 150 WHEN 2 THEN 9 * x + 350 END AS sum_x,
       CASE k WHEN 0 THEN 100.0 WHEN 1 THEN 160.0 WHEN 2 THEN 110.0 END::DOUBLE AS sum_y
FROM (SELECT *, c_custkey % 5 AS k, c_custkey * 100.0::DOUBLE AS x FROM customer)"""
    q["csv_lot_files"] = with_(PLACES, LOTS) + """
SELECT code_departement, CASE WHEN coalesce(no_disposition % 2 = 0, true) THEN 'even' ELSE 'odd' END AS folder, count(*) AS lots
FROM lots GROUP BY ALL"""
    q["csv_rejects"] = with_(PLACES, LOTS) + """
SELECT code_departement, count(*) FILTER (WHERE NOT bad) AS valid, count(*) FILTER (WHERE bad) AS rejected
FROM (SELECT code_departement, coalesce(CAST(round(surface_reelle_bati) AS BIGINT) % 7 = 3, false) AS bad
      FROM lots) GROUP BY ALL"""
    q["stats_cache_roundtrip"] = with_(*all_stats) + \
        "SELECT level, code, median_price_m2, q25, q75, n_sales FROM all_stats"


_build_core = build


def build() -> dict[str, str]:  # noqa: F811
    q = _build_core()
    build_geo(q)
    return q
