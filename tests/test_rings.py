"""Boundary edges linked into rings and polygons by joins, against the plain walk."""
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lotlens.operators import rings
from lotlens.operators.geometry import stitch_rings

EDGES = "level string, code string, ax double, ay double, bx double, by double"


def cell_boundary(cells):
    """Directed boundary edges of the union of unit cells, counter-clockwise outside."""
    edges = {}
    for x, y in cells:
        c = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
        for a, b in zip(c, c[1:] + c[:1]):
            if (b, a) in edges:
                del edges[b, a]
            else:
                edges[a, b] = True
    return list(edges)


def want(edges):
    cols = np.array([(*a, *b) for a, b in edges], float).reshape(-1, 4).T
    return [[[tuple(p) for p in ring] for ring in part] for part in stitch_rings(*cols)]


def got(spark, features):
    rows = [("l" if code != "none" else None, code, *map(float, (*a, *b))) for code, edges in features.items() for a, b in edges]
    out = rings.stitched(spark.createDataFrame(rows, EDGES).repartition(5), ["level", "code"])
    assert out.columns == ["level", "code", "geometry"]
    return {r.code: [[[(p.x, p.y) for p in ring] for ring in part] for part in r.geometry] for r in out.collect()}


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_rings_and_holes_equal_the_plain_walk(spark, monkeypatch, block):
    monkeypatch.setattr(rings, "BLOCK", block)
    rng = random.Random(block)
    nested = {(x, y) for x in range(9) for y in range(9)} - {(x, y) for x in range(1, 8) for y in range(1, 8)} \
        | {(x, y) for x in range(2, 7) for y in range(2, 7)} - {(3, 3), (5, 5), (4, 4)}
    shapes = {"nested": nested, "touching": {(0, 0), (1, 1), (2, 0), (1, -1)}, "one": {(5, 5)}, "none": {(3, 3), (3, 4)},
              "apart": {(0, 0), (10, 10), (20, 20), (20, 21)}}
    for k in range(6):
        shapes[f"r{k}"] = {(x, y) for x in range(14) for y in range(14) if rng.random() < 0.6}
    features = {code: cell_boundary(cells) for code, cells in shapes.items()}
    assert got(spark, features) == {code: want(edges) for code, edges in features.items()}


def test_lines_that_do_not_close_are_left_out(spark):
    square = cell_boundary({(0, 0)})
    assert got(spark, {"a": square + [((5, 5), (6, 6)), ((6, 6), (7, 5))], "b": [((0, 0), (1, 1))]}) == {"a": want(square)}
    assert got(spark, {}) == {}


def test_a_ring_of_a_million_edges(spark):
    n = 500_000  # a band: out below, back above
    low, high = (F.col("id") % 2) * 0.25, 1 + (F.col("id") % 3) * 0.25
    x = F.col("id").cast("double")
    out = spark.range(n - 1).select(x.alias("ax"), low.alias("ay"), (x + 1).alias("bx"), (((F.col("id") + 1) % 2) * 0.25).alias("by"))
    back = spark.range(n - 1).select((x + 1).alias("ax"), (1 + ((F.col("id") + 1) % 3) * 0.25).alias("ay"), x.alias("bx"), high.alias("by"))
    last = spark.createDataFrame([(float(n - 1), (n - 1) % 2 * 0.25, float(n - 1), 1 + (n - 1) % 3 * 0.25), (0.0, 1.0, 0.0, 0.0)],
                                 "ax double, ay double, bx double, by double")
    edges = out.unionByName(back).unionByName(last).withColumn("code", F.lit("band"))
    r = rings.stitched(edges, ["code"]).select(F.size("geometry").alias("parts"), F.size(F.col("geometry")[0]).alias("rings"),
                                               F.size(F.col("geometry")[0][0]).alias("points"),
                                               F.col("geometry")[0][0][1]["x"].alias("x1"), F.col("geometry")[0][0][n]["x"].alias("xn")).collect()
    assert [tuple(v) for v in r] == [("band",)[1:] + (1, 1, 2 * n + 1, 1.0, float(n - 1))]


@given(st.permutations(range(40)), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_chains_of_a_block(order, size):
    ids = np.array(order[:size], np.int64)
    follows = (ids + 1) % 40
    places, chains = rings._follow(ids, follows)
    assert sorted(p[0] for p in places) == sorted(ids)
    chain = {c[0]: c for c in chains}
    for i, head, step in places:
        assert i == (head + step) % 40
    for head, nxt, length, least, off in chains:
        own = [(head + k) % 40 for k in range(length)]
        assert least == min(own) and own[off] == least
        assert nxt == head if size == 40 else nxt == (own[-1] + 1) % 40 and nxt not in own
    assert len(chain) == len(chains)
