"""Boundary documents read in byte ranges."""
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotlens.sources import geojson

PROPS = T.StructType([T.StructField("code", T.StringType()), T.StructField("name", T.StringType())])
TRICKY = ['}', '{', '"', '\\', '\\"', '}{"}', 'é}', ',"features":[{', '\n}', ' \\\\ }', ']}']


def documents(seed, n):
    rng = random.Random(seed)
    features = []
    for i in range(n):
        ring = [[rng.random() for _ in range(2)] for _ in range(rng.randint(4, 9))]
        geometry = rng.choice([None, {"type": "Polygon", "coordinates": [ring]},
                               {"type": "MultiPolygon", "coordinates": [[ring, ring], [ring]]}])
        features.append({"type": "Feature", "properties": {"code": str(i), "name": "".join(rng.choices(TRICKY, k=rng.randint(0, 4))),
                                                           "more": [{"deep": {"}": "{"}}]}, "geometry": geometry})
    return {"type": "FeatureCollection", "name": rng.choice(TRICKY), "crs": {"type": "name", "properties": {"name": "x}"}},
            "features": features, "bbox": [1, 2], "tail": {"type": "other", "deep": {}}}


@pytest.mark.parametrize("split, indent", [(1 << 20, 2), (90, None)])
def test_documents_in_byte_ranges(spark, tmp_path, split, indent):
    want = []
    for k in range(3):
        doc = documents(k, 8)
        text = json.dumps(doc, indent=indent, ensure_ascii=k == 0, separators=(",", ":") if indent is None else None)
        (tmp_path / f"{k}.geojson").write_text(text + "\n" * k, encoding="utf-8")
        want += [json.dumps(f, sort_keys=True) for f in doc["features"]]
    (tmp_path / "none.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    (tmp_path / "empty.geojson").write_text("")
    (tmp_path / "cut.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"code":"cut"},"geom')
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        texts = [json.loads(r.feature) for r in geojson.feature_texts(spark, str(tmp_path)).collect()]
        rows = geojson.read_feature_collection(spark, str(tmp_path), PROPS).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(json.dumps(f, sort_keys=True) for f in texts if f["type"] == "Feature") == sorted(want)
    assert sorted((r.properties.code, r.properties.name) for r in rows) == \
        sorted((f["properties"]["code"], f["properties"]["name"]) for f in map(json.loads, want))


def test_undecodable_geometries_are_null(spark):
    rows = [("Polygon", "[[[1,2],[3,4],[5,6],[1,2]]]", True), ("Polygon", '["none"]', False), ("Polygon", "[[[1,2],[3]]]", False),
            ("Polygon", "oops", False), ("Polygon", None, False), ("MultiPolygon", "[[[[1,2],[3,4],[1,2]]]]", True),
            ("MultiPolygon", '[["none"]]', False), ("Point", "[1,2]", False), (None, "[[[1,2]]]", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, c string, ok boolean")
    got = df.select("i", (geojson.geometry_from_json(F.col("t"), F.col("c")).isNotNull() == F.col("ok")).alias("as_said")).collect()
    assert all(r.as_said for r in got), got


def test_vertices_come_from_all_parts_and_rings(spark):
    from lotlens.plans.registry import _kept, _vertices
    shell, hole, other = ([(float(a + i), float(b)) for i, (a, b) in enumerate([(0, 0), (9, 0), (0, 9)])] for a, b in ((0, 0), (1, 1), (50, 0)))
    rows = [("hole", [[shell, hole]]), ("parts", [[shell], [other, hole]]), ("empty", []), ("null", None)]
    df = spark.createDataFrame(rows, "code string, geometry array<array<array<struct<x:double,y:double>>>>")
    got = sorted((r.code, r.part, r.ring, r.idx, tuple(r.p)) for r in _vertices(df).collect())
    assert got == sorted((c, i, j, k, p) for c, g in rows for i, part in enumerate(g or []) for j, ring in enumerate(part)
                         for k, p in enumerate(ring))
    kept = {r.code: r.vertices for r in _kept(df.selectExpr("'x' AS level", "*")).collect()}
    assert kept["hole"] == 4 and kept["parts"] == 6 and kept["empty"] == 0
