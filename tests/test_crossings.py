"""Simplified layers without crossings: against brute force, and each kind of fault."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotlens.operators import crossings as cr
from lotlens.operators.geometry import simplify, simplify_shared

GEOMETRY = "level string, code string, geometry array<array<array<struct<x:double,y:double>>>>"


def layer(spark, features):
    return spark.createDataFrame([("commune", code, None if g is None else
                                   [[[(float(x), float(y)) for x, y in ring] for ring in part] for part in g])
                                  for code, g in features], GEOMETRY)


def kept_of(df):
    return {r.code: None if r.geometry is None else [[[(p.x, p.y) for p in ring] for ring in part] for part in r.geometry]
            for r in df.collect()}


def side(p, q, r):
    return np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))


def cross(a, b, c, d):
    if {a, b} & {c, d} or max(a[0], b[0]) < min(c[0], d[0]) or max(c[0], d[0]) < min(a[0], b[0]) \
            or max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1]):
        return False
    return side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0


def within(pt, line):
    odd = False
    for (x1, y1), (x2, y2) in zip(line, line[1:] + line[:1]):
        if (y1 > pt[1]) != (y2 > pt[1]) and pt[0] < x1 + (pt[1] - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return odd


def all_lines(original, kept):
    out = set()
    for code, geometry in original.items():
        for i, part in enumerate(geometry):
            for j, ring in enumerate(part):
                on = set(kept[code][i][j])
                at = [k for k in range(len(ring) - 1) if ring[k] in on]
                for a, b in zip(at, at[1:] + [at[0] + len(ring) - 1]):
                    line = [ring[k % (len(ring) - 1)] for k in range(a, b + 1)]
                    out.add(tuple(min(line, line[::-1])))
    return out


def brute(original, kept):
    """Every line against every other and every vertex, round by round."""
    kept = {c: [[list(r) for r in p] for p in g] for c, g in kept.items()}
    while True:
        lines, back = all_lines(original, kept), set()
        vertices = {p for line in lines for p in (line[0], line[-1])}
        for line in lines:
            bad = any(other != line and ((other[0], other[-1]) == (line[0], line[-1])
                                         or cross(line[0], line[-1], other[0], other[-1])) for other in lines)
            if len(line) > 2 and (bad or any(v not in line and within(v, list(line)) for v in vertices)):
                back.add(cr.farthest(np.array(line)))
        if not back:
            return kept
        for code, geometry in original.items():
            for i, part in enumerate(geometry):
                for j, ring in enumerate(part):
                    kept[code][i][j] += [p for p in ring if p in back]


def wiggly_grid(seed, n=3, size=10.0):
    """A coverage whose borders wiggle by less than the tolerance, with small
    features close to the borders."""
    rng = random.Random(seed)
    lines = {}

    def border(a, b):
        if (b, a) in lines:
            return lines[b, a][::-1]
        if (a, b) not in lines:
            out = [a]
            for k in range(1, 6):
                t, off = k / 6, rng.uniform(-0.9, 0.9)
                across = (off, 0) if a[0] == b[0] else (0, off)
                out.append((round(a[0] + (b[0] - a[0]) * t + across[0], 3), round(a[1] + (b[1] - a[1]) * t + across[1], 3)))
            lines[a, b] = [*out, b]
        return lines[a, b]

    features = []
    for i in range(n):
        for j in range(n):
            c = [(i * size, j * size), ((i + 1) * size, j * size), ((i + 1) * size, (j + 1) * size), (i * size, (j + 1) * size)]
            ring = [p for a, b in zip(c, c[1:] + c[:1]) for p in border(a, b)[:-1]]
            features.append((f"s{i}{j}", [[ring + ring[:1]]]))
    paths = [np.array(line) for line in lines.values()]
    for k in range(25):  # close to a border's middle, not across it
        line = rng.choice(paths)
        x, y = line[rng.randrange(1, 5)] + rng.choice([-0.3, 0.3])
        tri = [(round(x + dx, 3), round(y + dy, 3)) for dx, dy in ((0, 0), (0.7, 0), (0, 0.7), (0, 0))]
        if not any(cross(tuple(p), tuple(q), tri[m], tri[m + 1]) for li in paths for p, q in zip(li, li[1:]) for m in range(3)):
            features.append((f"t{k}", [[tri]]))
    return features


@pytest.mark.parametrize("seed", [1])
def test_put_back_equals_brute_force(spark, seed):
    features = wiggly_grid(seed)
    original = {c: [[[(float(x), float(y)) for x, y in r] for r in p] for p in g] for c, g in features}
    df = layer(spark, features)
    plain = simplify_shared(df, 1.0, ["level"]).checkpoint()
    got_df = cr.simplify_layer(df, 1.0, ["level"])
    got, want = kept_of(got_df), brute(original, kept_of(plain))
    assert {c: [[set(r) for r in p] for p in g] for c, g in got.items()} == \
        {c: [[set(r) for r in p] for p in g] for c, g in want.items()}
    assert cr.crossings(got_df, ["level"]).agg(F.sum("crossings")).first()[0] == 0
    before = kept_of(plain)
    assert cr.crossings(plain, ["level"]).agg(F.sum("crossings")).first()[0] > 0
    assert sum(len(r) for g in got.values() for p in g for r in p) > sum(len(r) for g in before.values() for p in g for r in p)
    assert sum(len(r) for g in got.values() for p in g for r in p) < sum(len(r) for g in original.values() for p in g for r in p)
    for code, geometry in got.items():  # a subsequence of the ring, closed, from its smallest vertex
        for was, now in zip(original[code][0], geometry[0]):
            assert now[0] == now[-1] == min(now)
            at = [was.index(p) for p in now[:-1]]
            assert sum(b < a for a, b in zip(at, at[1:] + at[:1])) == 1


SQUARE = [(0, 0), (50, -9), (100, 0), (100, 100), (0, 100), (0, 0)]
HOLE = [(45, -5), (45, -3), (55, -3), (55, -5), (45, -5)]


def test_a_hole_in_a_dip_stays_inside_its_shell(spark):
    df = layer(spark, [("a", [[SQUARE, HOLE]])])
    assert (50.0, -9.0) not in kept_of(simplify_shared(df, 10.0, ["level"]))["a"][0][0]
    assert (50.0, -9.0) in kept_of(cr.simplify_layer(df, 10.0, ["level"]))["a"][0][0]
    assert (50.0, -9.0) not in kept_of(cr.simplify_layer(layer(spark, [("a", [[SQUARE]])]), 10.0, ["level"]))["a"][0][0]


def test_a_sliver_does_not_shrink_to_a_line(spark):
    lens = [(0, 0), (50, -3), (100, 0), (50, 3), (0, 0)]
    around = [[(0, 0), (50, -3), (100, 0), (100, -80), (0, -80), (0, 0)], [(0, 0), (0, 80), (100, 80), (100, 0), (50, 3), (0, 0)]]
    df = layer(spark, [("lens", [[lens]]), ("s", [[around[0]]]), ("n", [[around[1]]]), ("none", None)])
    got = kept_of(cr.simplify_layer(df, 10.0, ["level"]))
    assert set(got["lens"][0][0]) >= {(0.0, 0.0), (100.0, 0.0)} and len(set(got["lens"][0][0])) >= 3
    assert {p for p in got["lens"][0][0] if p[1] < 0} == {p for p in got["s"][0][0] if -80 < p[1] < 0}
    assert got["none"] is None


def test_empty_layer(spark):
    df = layer(spark, [])
    assert cr.simplify_layer(df, 10.0, ["level"]).collect() == [] and cr.crossings(df, ["level"]).collect() == []


def test_a_single_split_is_dealt_to_all_workers(spark, monkeypatch):
    square = [[[[(2000.0 * i + x, float(y)) for x, y in SQUARE]], [[(2000.0 * i + x, float(y)) for x, y in HOLE]]] for i in range(20)]
    df = layer(spark, [(str(i), [[part[0] for part in parts]]) for i, parts in enumerate(square)]).coalesce(1)
    got = cr.simplify_layer(df, 10.0, ["level"])
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all((2000.0 * int(c) + 50.0, -9.0) in g[0][0] for c, g in kept_of(got).items())


def test_chords_of_a_ring_start_at_their_smaller_end():
    ring = [(0.0, 0.0), (2.0, -1.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    assert cr.ring_chords(ring, [True, False, True, False, True]) == [ring[:3], [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0)]]
    assert cr.ring_chords(ring, [False, False, True, False, False]) == [
        min(line, line[::-1]) for line in [[ring[2], ring[3], ring[0], ring[1], ring[2]]]]
    assert cr.ring_chords(ring, [False] * 5) == []


def test_chords_are_made_once_a_round(spark, monkeypatch):
    ring = [(0, 0), (500, -27), (1000, 0), (1000, 1000), (0, 1000), (0, 0)]
    hole = [(490, -16), (490, -8), (510, -8), (510, -16), (490, -16)]
    plans, faults = [], cr.faults

    def watched(lines, keys):
        plans.append(lines._jdf.queryExecution().executedPlan().toString())
        return faults(lines, keys)
    monkeypatch.setattr(cr, "faults", watched)
    kept = kept_of(cr.simplify_layer(layer(spark, [("a", [[ring, hole]])]), 30.0, ["level"]))
    assert (500.0, -27.0) in kept["a"][0][0]
    assert len(plans) == 2 and not any("MapInArrow" in p for p in plans)


def test_few_features_do_not_get_a_task_per_shuffle_partition(spark):
    features = [(str(i), [[[(i, 0), (i + 1, 0), (i + 1, 1), (i, 1), (i, 0)]]]) for i in range(0, 20, 2)]
    most = max(64, 4 * spark.sparkContext.defaultParallelism)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for workers, tasks in ((600, most), (3, 3)):
            spark.conf.set("spark.sql.shuffle.partitions", str(workers))
            for f in (lambda df: simplify(df, 0.1), lambda df: simplify_shared(df, 0.1, ["level"])):
                df = f(layer(spark, features))
                assert df.rdd.getNumPartitions() == tasks
                assert sorted(kept_of(df)) == sorted(code for code, _ in features)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
