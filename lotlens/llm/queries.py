"""Registered queries of this subpackage: op<N>_<name> and the pipeline.

Each applies its operator, with production parameters, to the whole table named
in its contract and returns the contract's columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from lotlens.llm.common import UPPER, table
from lotlens.llm.decontaminate import contamination, is_contaminated
from lotlens.llm.exact_dedup import exact_dedup
from lotlens.llm.hard_negatives import hard_negatives
from lotlens.llm.language_id import language_id
from lotlens.llm.line_dedup import line_dedup
from lotlens.llm.merkle import document_leaves, merkle_manifest
from lotlens.llm.mixing import mix
from lotlens.llm.pii import KINDS, count_of, find_pii, span_text
from lotlens.llm.simhash import simhash_dedup
from lotlens.llm.substring_dedup import repeated_spans
from lotlens.llm.token_count import token_counts
from lotlens.llm.url_filter import rules_frame, url_filter
from lotlens.llm.warc import warc_roundtrip

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents")).drop("component_fp")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), rules_frame(spark))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        is_contaminated().alias("contaminated"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")).drop("text")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.withColumn("dropped", F.concat_ws(",", F.col("dropped").cast("array<string>")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_roundtrip(table(spark, sf_dir, "pages")).drop("error")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the digest are of the base spans; ``spans`` has all."""
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
                        span_text(F.concat("base", "added")).alias("spans"),
                        F.size("added").cast("long").alias("n_added"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = merkle_manifest(document_leaves(table(spark, sf_dir, "documents"), tampered))
    return found.drop("tree", "witness").withColumnRenamed("id", "doc_id")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # stands beside the package and imports this subpackage
    return corpus_pipeline.run(spark, sf_dir)


def build() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_simhash, op2_token_counts, op3_url_filter, op4_decontaminate, op5_exact_dedup, op6_mix_sources,
                                   op7_language_id, op8_line_dedup, op9_warc, op10_pii, op11_substring_dedup,
                                   op12_merkle_manifest, op13_hard_negatives, pipeline)}


OP3_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

# Water-filling level by level, then whole epochs and a prefix in seeded order.
MIX_SQL = """
WITH d AS (
  SELECT *, coalesce(lang, '') AS l, coalesce(source, '') AS s,
         'd' || translate(substr(md5(coalesce(source, '')), 1, 1), '0123456789abcdef', '0123012301230123') AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM {docs}),
leaf AS (SELECT domain, l, s, sum(n_tokens)::HUGEINT AS tokens FROM d GROUP BY ALL),
n1 AS (SELECT domain, sum(tokens * 4)::HUGEINT AS cap, (SELECT sum(tokens)::HUGEINT // 2 FROM leaf) AS given,
              CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS w FROM leaf GROUP BY domain),
f1 AS (SELECT *, cap * sum(w) OVER (ORDER BY cap::DOUBLE / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
              <= w * (given - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, domain
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS sat FROM n1),
b1 AS (SELECT domain, CASE WHEN sat THEN cap ELSE (w * (given - coalesce(sum(cap) FILTER (WHERE sat) OVER (), 0)))::HUGEINT
              // (sum(w) FILTER (WHERE NOT sat) OVER ())::HUGEINT END AS given FROM f1),
n2 AS (SELECT domain, l, sum(tokens * 4)::HUGEINT AS cap,
              CASE l WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS w
       FROM leaf GROUP BY domain, l),
f2 AS (SELECT *, cap * sum(w) OVER (PARTITION BY domain ORDER BY cap::DOUBLE / w, l
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
              <= w * (given - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap::DOUBLE / w, l
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS sat FROM n2 JOIN b1 USING (domain)),
b2 AS (SELECT domain, l, CASE WHEN sat THEN cap
              ELSE (w * (given - coalesce(sum(cap) FILTER (WHERE sat) OVER (PARTITION BY domain), 0)))::HUGEINT
              // (sum(w) FILTER (WHERE NOT sat) OVER (PARTITION BY domain))::HUGEINT END AS given FROM f2),
f3 AS (SELECT domain, l, s, tokens, tokens * 4 AS cap, 1 AS w, given,
              tokens * 4 * count(*) OVER (PARTITION BY domain, l ORDER BY (tokens * 4)::DOUBLE, s
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
              <= given - coalesce(sum(tokens * 4) OVER (PARTITION BY domain, l ORDER BY (tokens * 4)::DOUBLE, s
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sat FROM leaf JOIN b2 USING (domain, l)),
b3 AS (SELECT domain, l, s, tokens, (CASE WHEN sat THEN cap
              ELSE (given - coalesce(sum(cap) FILTER (WHERE sat) OVER (PARTITION BY domain, l), 0))::HUGEINT
              // (sum(w) FILTER (WHERE NOT sat) OVER (PARTITION BY domain, l))::HUGEINT END)::HUGEINT AS budget FROM f3),
plan AS (SELECT *, CASE WHEN tokens > 0 THEN (budget // tokens)::BIGINT ELSE 0 END AS whole FROM b3),
placed AS (SELECT d.*, whole, (budget - whole * tokens)::BIGINT AS rest,
                  md5('17:' || (whole + 1) || ':' || coalesce(doc_id::VARCHAR, '')) AS place
           FROM d JOIN plan USING (domain, l, s)),
took AS (SELECT *, whole + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, l, s ORDER BY place
                 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest THEN 1 ELSE 0 END AS n FROM placed)
SELECT {cols}, domain, n_tokens, unnest(range(1, n + 1)) AS epoch FROM took WHERE n > 0
"""
OP6_SQL = MIX_SQL.format(docs="documents", cols="doc_id, lang, source")

OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha256(body) AS digest,
             min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END
         AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d
"""

WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), "
         r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {WORDS} AS w FROM benchmark),
b_at AS (SELECT item, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, array_to_string(list_slice(w, s + 1, s + 13), ' ') AS win,
               least(len(w), 13) AS n FROM b_at),
d_at AS (SELECT rid, w, n, unnest(range(0, len(w) - n + 1)) AS s
         FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
occ AS (SELECT rid, s, d_at.n, item
        FROM d_at JOIN win ON array_to_string(list_slice(w, s + 1, s + d_at.n), ' ') = win.win AND win.n = d_at.n),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM occ) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
        FROM occ GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""

OP5_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same
         AND row_number() OVER (PARTITION BY coalesce(text, ''), doc_id) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
starts AS (SELECT rid, doc_id, w, unnest(range(0, len(w) - 19)) AS s FROM d WHERE len(w) >= 20),
wins AS (
  SELECT rid, s, row(doc_id IS NULL, coalesce(doc_id, 0), s) AS place, array_to_string(w[s + 1:s + 20], ' ') AS win
  FROM starts),
later AS (SELECT rid, s FROM wins QUALIFY place > min(place) OVER (PARTITION BY win)),
gone AS (SELECT DISTINCT rid, unnest(range(s, s + 20)) AS p FROM later),
words AS (SELECT rid, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
kept AS (
  SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""


def _crc32_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def _tree_sql(name: str, leaves: str, levels: int) -> str:
    """CTEs of a tree: n<k> its nodes, r<k> their runs, up to ``levels`` levels; a
    level of one node repeats."""
    out = [f"{name}_n0 AS ({leaves})"]
    for k in range(levels):
        out.append(f"""{name}_r{k} AS (
  SELECT tree, nth // 16 AS run, list(h ORDER BY nth) AS hs, any_value(n) AS n
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}_n{k}) GROUP BY tree, nth // 16),
{name}_n{k + 1} AS (
  SELECT tree, run AS nth, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}_r{k})""")
    return ",\n".join(out)


def _climb_sql(name: str, start: str, tree: str, levels: int) -> str:
    """CTEs that carry each leaf's siblings, folded value and place up the tree."""
    out, last = [], start
    for k in range(levels):
        out.append(f"""{name}_c{k} AS (
  SELECT c.* EXCLUDE (nth, siblings, folded), nth // 16 AS nth,
         siblings || CASE WHEN n > 1 THEN array_to_string(list_filter(hs, lambda x, j: j <> nth % 16 + 1), '') ELSE '' END
           AS siblings,
         CASE WHEN n > 1 THEN sha256(array_to_string(list_transform(hs, lambda x, j:
           CASE WHEN j = nth % 16 + 1 THEN folded ELSE x END), '')) ELSE folded END AS folded
  FROM {last} c JOIN {name}_r{k} r ON c.{tree} IS NOT DISTINCT FROM r.tree AND c.nth // 16 = r.run)""")
        last = f"{name}_c{k}"
    return ",\n".join(out)


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars")]
    return f"sha256({' || '.join(parts)} || coalesce(strlen({text}) || ':' || {text}, '-'))"


#: Six levels hold 16 million documents of a source, and as many sources.
OP12_SQL = f"""
WITH crc AS (SELECT {_crc32_table()}::BIGINT[] AS t),
d AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
         CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
                lambda ch: ascii(ch)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 5 = 0
              THEN {_leaf_sql(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} END AS changed
  FROM documents, crc),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth FROM d),
{_tree_sql("s", "SELECT source AS tree, nth, leaf AS h FROM placed", 6)},
{_tree_sql("t", "SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS nth, h FROM s_n6", 6)},
start AS (SELECT doc_id, source, leaf, nth, '' AS siblings, coalesce(changed, leaf) AS folded FROM placed),
{_climb_sql("s", "start", "source", 6)},
top AS (
  SELECT c.* EXCLUDE (nth), h AS subroot, 0 AS zero, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS nth
  FROM s_c5 c JOIN s_n6 n ON c.source IS NOT DISTINCT FROM n.tree),
{_climb_sql("t", "top", "zero", 6)}
SELECT doc_id, leaf, subroot, h AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = h AS verified
FROM t_c5, t_n6
"""

OP13_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.rid AS a_rid, a.vec_id AS anchor_id, e.rid, e.vec_id, e.label = a.label AS same,
         list_dot_product(a.v, e.v)::BIGINT AS score
  FROM e a JOIN e ON a.vec_id % 100 = 0 AND e.rid <> a.rid AND len(a.v) = len(e.v)),
positive AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY a_rid ORDER BY score DESC, vec_id NULLS LAST, rid) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.a_rid, p.rid ORDER BY n.score DESC, n.vec_id NULLS LAST)::INT AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON n.a_rid = p.a_rid AND NOT n.same
 AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""


def oracle() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL, "op9_warc": OP9_SQL, "op4_decontaminate": OP4_SQL, "op5_exact_dedup": OP5_SQL,
            "op6_mix_sources": OP6_SQL, "op11_substring_dedup": OP11_SQL, "op12_merkle_manifest": OP12_SQL,
            "op13_hard_negatives": OP13_SQL}
