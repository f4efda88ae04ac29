"""Property tests for the dissolve ring walk and Douglas-Peucker (pure functions)."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lotlens.operators import geometry
from lotlens.operators.geometry import _dp_keep, stitch_rings


def cell_edges(cells):
    """Directed CCW edges of unit squares, with shared edges cancelled."""
    count = {}
    directed = []
    for x, y in cells:
        pts = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]
        for a, b in zip(pts[:-1], pts[1:]):
            directed.append((a, b))
            key = (min(a, b), max(a, b))
            count[key] = count.get(key, 0) + 1
    keep = [(a, b) for a, b in directed if count[(min(a, b), max(a, b))] == 1]
    return [np.array(v, dtype=float) for v in zip(*[(a[0], a[1], b[0], b[1]) for a, b in keep])] if keep else None


def area(ring):
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:])) / 2


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=36))
def test_dissolve_preserves_area_and_closes_rings(cells):
    edges = cell_edges(cells)
    polys = stitch_rings(*edges)
    total = sum(area(r) for p in polys for r in p)
    assert math.isclose(total, len(cells))
    n_vertices = sum(len(r) - 1 for p in polys for r in p)
    assert n_vertices == len(edges[0])
    for p in polys:
        assert area(p[0]) > 0
        for r in p:
            assert r[0] == r[-1] and len(r) >= 4
        for h in p[1:]:
            assert area(h) < 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.floats(0.5, 10.0), min_size=5, max_size=60), st.floats(0.01, 3.0))
def test_dp_closed_subset_within_tolerance(radii, tol):
    n = len(radii)
    ang = np.linspace(0, 2 * math.pi, n, endpoint=False)
    xs = np.append(np.array(radii) * np.cos(ang), radii[0])
    ys = np.append(np.array(radii) * np.sin(ang), 0.0)
    keep = _dp_keep(xs, ys, tol)
    assert keep[0] and keep[-1] and keep.sum() >= 4
    kept = np.flatnonzero(keep)
    if keep.sum() > 4 or len(xs) <= 4:
        # every dropped vertex lies within tol of the segment that replaced it
        for s, e in zip(kept[:-1], kept[1:]):
            for i in range(s + 1, e):
                dx, dy = xs[e] - xs[s], ys[e] - ys[s]
                seg2 = dx * dx + dy * dy
                t = 0.0 if seg2 == 0 else max(0.0, min(1.0, ((xs[i] - xs[s]) * dx + (ys[i] - ys[s]) * dy) / seg2))
                d = math.hypot(xs[i] - (xs[s] + t * dx), ys[i] - (ys[s] + t * dy))
                assert d <= tol + 1e-9


# ---- simplification keeps rings free of crossings

def _ring(points):
    return [[{"x": float(x), "y": float(y)} for x, y in points]]


def _crosses(rings):
    import numpy as np
    segs = [(*p, *q) for ring in rings for p, q in zip(ring[:-1], ring[1:])]
    return bool(geometry._crossing(*(np.array(c, float) for c in zip(*segs))).any())


INLET = [(0, 0), (50, -8), (100, 0), (100, 100), (52, 100), (50, -4), (48, 100), (0, 100), (0, 0)]


def test_a_chord_never_cuts_an_inlet(spark):
    df = spark.createDataFrame([("a", [_ring(INLET)])], "code string, geometry array<array<array<struct<x:double,y:double>>>>")
    for out in (geometry.simplify(df, 10.0), geometry.simplify_shared(df.selectExpr("'l' AS level", "*"), 10.0, ["level"])):
        ring = [(p.x, p.y) for p in out.first().geometry[0][0]]
        assert not _crosses([ring]) and (50.0, -8.0) in ring


def _star(rng, n, cx, cy, low, high, turn=1):
    import math
    pts = []
    for i in range(n):
        a, r = turn * 2 * math.pi * i / n, rng.uniform(low, high)
        pts.append((cx + r * math.cos(a), cy + r * math.sin(a)))
    return pts + pts[:1]


def test_simplified_rings_with_inlets_and_holes_do_not_cross(spark):
    import random
    rng = random.Random(11)
    rows = []
    for i in range(60):
        shell = _star(rng, rng.randint(12, 60), 0, 0, 40, 100)
        hole = _star(rng, rng.randint(8, 30), 0, 0, 20, 39, -1)  # close to the shell's deepest inlets
        assert not _crosses([shell, hole])
        rows.append((str(i), float(rng.choice([2, 10, 30])), [_ring(shell) + _ring(hole)]))
    df = spark.createDataFrame(rows, "code string, tol double, geometry array<array<array<struct<x:double,y:double>>>>")
    out = geometry.simplify(df, F.col("tol")).collect()
    before = {r[0]: sum(map(len, r[2][0])) for r in rows}
    assert all(not _crosses([[(p.x, p.y) for p in ring] for ring in r.geometry[0]]) for r in out)
    assert sum(sum(len(ring) for ring in r.geometry[0]) < before[r.code] for r in out) > 40
    shared = geometry.simplify_shared(df.selectExpr("code AS level", "*"), F.col("tol"), ["level"]).collect()
    assert all(not _crosses([[(p.x, p.y) for p in ring]]) for r in shared for ring in r.geometry[0])


def test_squares_see_a_wrong_tolerance(spark):
    """Twice or half the tolerance keeps other vertices: the registered rows would differ."""
    from conftest import SF001
    from lotlens.sources import fixtures
    sq = fixtures.wiggly_squares(spark, SF001)
    tols = dict(fixtures.WIGGLE_LEVELS)

    def kept(factor):
        tol = F.create_map(*[x for k, v in tols.items() for x in (F.lit(k), F.lit(v * factor))])[F.col("level")]
        out = geometry.simplify(sq, tol).select("level", "code", F.size(F.col("geometry")[0][0]).alias("n")).collect()
        return {lvl: sum(r.n for r in out if r.level == lvl) for lvl in tols}
    right, double, half = kept(1.0), kept(1.95), kept(0.52)
    assert all(double[k] < right[k] < half[k] for k in tols)
