"""Registered queries against SQL, and the pipeline stage by stage."""
import hashlib
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline as cp  # noqa: E402
from lotlens.llm import queries  # noqa: E402

SF001 = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "embeddings")


def test_one_query_for_each_operator():
    names = queries.build()
    assert [n.split("_")[0] for n in names if n != "pipeline"] == [f"op{i}" for i in range(1, 14)]
    assert set(names) <= set(entry.queries()) and set(queries.oracle()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    want = con.execute(queries.oracle()[name])
    cols = [c[0] for c in want.description]
    got = entry.queries()[name](spark, SF001)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_line_query_against_brute_force(spark):
    from tests.llm.test_dedup import short_want
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").orderBy("doc_id").collect()]
    got = entry.queries()["op8_line_dedup"](spark, SF001).collect()
    n_lines = {i: 0 if t is None else t.count("\n") + 1 for i, t in rows}
    assert {(r.doc_id, r.n_lines, r.n_links, r.dropped) for r in got} == \
        {(i, n_lines[i], n, ",".join(map(str, d))) for i, n, d in short_want(rows)}


COPY = "some words of a longer text that is not short at all and goes on"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_language_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    odd = frame(spark, [(9001, None), (9002, ""), (9003, "12 34 !"), (None, "Das ist der Text und die Sprache")])
    out = cp.identify_language(spark, docs.unionByName(odd), SF001)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert not kept & {9001, 9002, 9003} and None in kept
    clean = {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert clean <= kept


def test_exact_stage(spark):
    docs = frame(spark, [(1, COPY), (3, COPY), (2, COPY), (3, COPY), (None, COPY), (None, "other"), (None, "other"), (4, None),
                         (5, "")])
    out = cp.drop_copies(spark, docs, SF001)
    assert out.columns == docs.columns
    assert rows_of(out.select("doc_id", "text")) == sorted([(3, COPY), (None, "other"), (5, "")], key=str)


def test_near_stage(spark):
    long = " ".join(f"word{i}" for i in range(3000))
    docs = frame(spark, [(7, long), (3, long + " x"), (9, long.upper()), (4, "a b c d e"), (None, "x y z"), (None, "x y Z"),
                         (None, "q r s t")])
    out = rows_of(cp.drop_near_copies(spark, docs, SF001).select("doc_id", "text"))
    from tests.llm.test_dedup import naive_fingerprint
    assert (naive_fingerprint(long) ^ naive_fingerprint(long + " x")).bit_count() <= 2
    first = min("x y z", "x y Z", key=lambda t: hashlib.sha256(t.encode()).digest())  # without ids the text's hash decides
    assert out == sorted([(3, long + " x"), (4, "a b c d e"), (None, "q r s t"), (None, first)], key=str)


def test_contamination_stage(spark):
    bench = [r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    docs = frame(spark, [(1, "clean words only"), (2, "before " + bench[0]), (2, "before " + bench[0]), (None, bench[1]),
                         (None, None), (3, bench[2][:20]), (4, bench[3] + " filler" * 20_000), (1, "clean words only")])
    out = rows_of(cp.drop_contaminated(spark, docs, SF001).select("doc_id", "text"))
    want = [(1, "clean words only")] * 2 + [(None, None), (3, bench[2][:20]), (4, bench[3] + " filler" * 20_000)]
    assert out == sorted(want, key=str)


CLASHING = ["n_tokens", "epoch", "_n", "_epoch", "_whole", "_cutoff", "_text_key", "_key", "_text", "_wid", "_wkey", "_language", "language", "_bad",
            "_bad_key", "_row", "_id", "_leaf_lang", "_at_lang", "fp", "whole", "cutoff", "tokens", "a.b", "c`d"]


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stages_take_extra_columns_of_any_name(spark, name, stage):
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet").first().text
    docs = frame(spark, [(i, f"{COPY} {'and more ' * (i % 5)} number {i // 4}", ) for i in range(40)]
                 + [(50, bench), (None, COPY), (None, COPY), (51, None), (52, "")])
    extra = docs.select("*", *(F.concat_ws(":", F.lit(c), "doc_id").alias(c) for c in CLASHING))
    want, got = stage(spark, docs, SF001), stage(spark, extra, SF001)
    passed = [c for c in CLASHING if name != "mix" or c not in ("n_tokens", "epoch")]
    assert want.count() and sorted(got.columns) == sorted([*want.columns, *passed])
    rows = got.collect()
    assert sorted((tuple(r[c] for c in want.columns) for r in rows), key=str) == rows_of(want)
    assert all(r[c] == (c if r.doc_id is None else f"{c}:{r.doc_id}") for r in rows for c in passed)


def test_every_stage_takes_an_empty_table(spark):
    for _, stage in cp.STAGES:
        out = stage(spark, frame(spark, []), SF001)
        assert out.collect() == []


def test_run_applies_the_stages_in_order(spark):
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "simhash", "decontaminate", "mix"]
    got = rows_of(cp.run(spark, SF001).select("doc_id", "epoch"))
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    from tests.llm.test_dedup import naive_fingerprint, union_find
    from tests.llm.test_models_and_mixing import mix_want
    from tests.llm.test_text_filters import contaminated
    from lotlens.llm import language_id, mixing
    model = language_id.learn(docs)
    rows = [r for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)]
    rows = [r for r in rows if language_id.predict(model, r.text)[1] >= cp.least_score(model)]
    last = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        last[r.text] = r
    rows = sorted(last.values(), key=lambda r: r.doc_id)
    fps = [naive_fingerprint(r.text) for r in rows]
    p, find = union_find(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                p[max(a, b)] = min(a, b)
    rows = [r for i, r in enumerate(rows) if find(i) == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    bad = {i for i, n, hit, _ in contaminated([(r.doc_id, r.text) for r in rows], items) if hit and 20 * hit >= n}
    rows = [r for r in rows if r.doc_id not in bad]

    def domain(s):
        return f"d{int(hashlib.md5((s or '').encode()).hexdigest()[0], 16) % 4}"
    want = mix_want([(r.doc_id, r.text, domain(r.source), r.lang, r.source) for r in rows], mixing.WEIGHTS, (1, 2), 4, 17)
    assert got == sorted([(w[0], w[-1]) for w in want], key=str)
