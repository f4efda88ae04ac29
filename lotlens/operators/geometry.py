"""Polygon operators: edge table, dissolve, Douglas-Peucker simplification.

Dissolve of a polygon coverage is an edge-count aggregate: every ring edge
is exploded, undirected copies are counted per group, and edges seen once
form the boundary of the union (a distributed shuffle aggregate whose size is
linear in the number of vertices).  Boundary edges are linked into rings by joins
(``rings.stitched``), so a feature's boundary is never walked in one task;
``stitch_rings`` is the same on a list, to test against.

Simplification works on whole Arrow batches (``mapInArrow``): coordinates of
all rings of the batch are flat numpy arrays; only the Douglas-Peucker split
loop runs per ring.  Vertices go back where a chord would cross another kept
segment: of the same feature in ``simplify``, of the same arc in
``simplify_shared`` (where both sides of a border must decide alike).
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.functions.geo import orient, point
from lotlens.operators import rings
from lotlens.params import SIMPLIFY_TOLERANCE, SIMPLIFY_TOLERANCE_DEFAULT

EDGE_COLUMNS = ("ax", "ay", "bx", "by")


def square(x0: Column, y0: Column, size: float, midpoints: bool = True) -> Column:
    """Counter-clockwise closed square ring as a one-part MultiPolygon."""
    if midpoints:
        fx = [0, 0.5, 1, 1, 1, 0.5, 0, 0, 0]
        fy = [0, 0, 0, 0.5, 1, 1, 1, 0.5, 0]
    else:
        fx = [0, 1, 1, 0, 0]
        fy = [0, 0, 1, 1, 0]
    ring = F.array(*[point(x0 + F.lit(a * size), y0 + F.lit(b * size)) for a, b in zip(fx, fy)])
    return F.array(F.array(ring))


def edges(df: DataFrame, keys: list[str], geom: str = "geometry") -> DataFrame:
    """Directed edge table: keys, part_idx, ring_idx, ax, ay, bx, by."""
    parts = df.select(*keys, F.posexplode(orient(F.col(geom))).alias("part_idx", "_part"))
    rings = parts.select(*keys, "part_idx", F.posexplode("_part").alias("ring_idx", "_ring"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_ring") - 1, F.lit(1))),
                        lambda i: F.struct(F.element_at("_ring", i).alias("a"),
                                           F.element_at("_ring", i + 1).alias("b")))
    e = (rings.where(F.size("_ring") >= 2)
         .select(*keys, "part_idx", "ring_idx", F.explode(pairs).alias("_e")))
    return e.select(*keys, "part_idx", "ring_idx",
                    F.col("_e.a.x").alias("ax"), F.col("_e.a.y").alias("ay"),
                    F.col("_e.b.x").alias("bx"), F.col("_e.b.y").alias("by"))


def undirected(e: DataFrame) -> DataFrame:
    """Adds (ux1, uy1, ux2, uy2): the edge with its smaller endpoint first."""
    a_first = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") <= F.col("by")))
    return e.select("*",
                    F.when(a_first, F.col("ax")).otherwise(F.col("bx")).alias("ux1"),
                    F.when(a_first, F.col("ay")).otherwise(F.col("by")).alias("uy1"),
                    F.when(a_first, F.col("bx")).otherwise(F.col("ax")).alias("ux2"),
                    F.when(a_first, F.col("by")).otherwise(F.col("ay")).alias("uy2"))


def boundary_edges(df: DataFrame, group_keys: list[str], geom: str = "geometry") -> DataFrame:
    """Edges of the union of each group's polygons: undirected count == 1.

    Zero-length edges are ignored.  The surviving edge keeps its direction,
    so exteriors stay counter-clockwise and holes clockwise.
    """
    e = edges(df, group_keys, geom).where((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by")))
    counted = (undirected(e)
               .groupBy(*group_keys, "ux1", "uy1", "ux2", "uy2")
               # per-column min is the edge itself when it occurs once (the only
               # rows kept), and keeps the aggregate a fixed-width hash aggregate
               .agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in EDGE_COLUMNS]))
    return counted.where(F.col("_n") == 1).select(*group_keys, *EDGE_COLUMNS)


# --- ring stitching ------------------------------------------------------------

def _signed_area2(ring: list[tuple[float, float]]) -> float:
    s = 0.0
    for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:]):
        s += x1 * y2 - x2 * y1
    return s


def _inside(pt: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    x, y = pt
    inside = False
    for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:]):
        if (y1 > y) != (y2 > y):
            xc = x1 + (y - y1) * (x2 - x1) / (y2 - y1)
            if xc > x:
                inside = not inside
    return inside


def stitch_rings(ax, ay, bx, by) -> list[list[list[tuple[float, float]]]]:
    """Link directed boundary edges into closed rings, then into polygons (all in one
    list: the plain form of ``rings.stitched``).

    At a vertex with several outgoing edges (polygons touching at a point)
    the successor is the first outgoing edge clockwise from the reversed
    incoming edge (the sharpest left turn), which keeps each polygon's
    interior on the left and gives every edge exactly one successor.
    Counter-clockwise rings are exteriors, clockwise rings holes; each hole
    goes to the smallest exterior containing it.
    """
    n = len(ax)
    by_start: dict[tuple[float, float], list[int]] = defaultdict(list)
    for i in range(n):
        by_start[(ax[i], ay[i])].append(i)
    succ = np.full(n, -1, dtype=np.int64)
    for i in range(n):
        cands = by_start.get((bx[i], by[i]), [])
        if len(cands) == 1:
            succ[i] = cands[0]
        elif cands:
            back = math.atan2(ay[i] - by[i], ax[i] - bx[i])
            best, best_cw = -1, 10.0
            for j in cands:
                ang = math.atan2(by[j] - ay[j], bx[j] - ax[j])
                cw = (back - ang) % (2 * math.pi)
                if cw == 0.0:
                    cw = 2 * math.pi
                if cw < best_cw:
                    best, best_cw = j, cw
            succ[i] = best
    seen = np.zeros(n, dtype=bool)
    rings = []
    for i in range(n):
        if seen[i]:
            continue
        ring, e = [], i
        while e != -1 and not seen[e]:
            seen[e] = True
            ring.append((float(ax[e]), float(ay[e])))
            e = int(succ[e])
        # canonical start: the smallest (x, y) vertex, always a true corner,
        # so the simplified result does not depend on edge order
        m = min(range(len(ring)), key=lambda q: ring[q])
        ring = ring[m:] + ring[:m]
        ring.append(ring[0])
        if len(ring) >= 4:
            rings.append(ring)
    shells, holes = [], []
    for r in rings:
        a = _signed_area2(r)
        if a > 0:
            shells.append((a, r))
        elif a < 0:
            holes.append(r)
    shells.sort(key=lambda t: (-t[0], t[1][0]))
    holes.sort(key=lambda r: r[0])  # deterministic output whatever the row order of the group
    polys = [[r] for _, r in shells]
    for h in holes:
        probe = ((h[0][0] + h[1][0]) / 2.0, (h[0][1] + h[1][1]) / 2.0)
        owner = None
        for k in range(len(shells) - 1, -1, -1):  # smallest containing shell
            if _inside(probe, shells[k][1]):
                owner = k
                break
        if owner is not None:
            polys[owner].append(h)
    return polys


def stitch(boundary: DataFrame, group_keys: list[str]) -> DataFrame:
    """(group_keys, ax, ay, bx, by) -> (group_keys, geometry); see ``rings``."""
    return rings.stitched(boundary, group_keys)


def dissolve(df: DataFrame, group_keys: list[str], geom: str = "geometry") -> DataFrame:
    """Union of each group's polygons (polygons must form a coverage)."""
    return stitch(boundary_edges(df, group_keys, geom), group_keys)


# --- Douglas-Peucker on Arrow batches ----------------------------------------

def _split_keep(xs: np.ndarray, ys: np.ndarray, tol: float) -> np.ndarray:
    """Douglas-Peucker of an open line with fixed ends: the vertices to keep."""
    n = len(xs)
    keep = np.zeros(n, dtype=bool)
    keep[0] = keep[-1] = True
    stack = [(0, n - 1)]
    while stack:
        s, e = stack.pop()
        if e <= s + 1:
            continue
        i, d = _farthest(xs, ys, s, e)
        if d > tol:
            keep[i] = True
            stack.append((s, i))
            stack.append((i, e))
    return keep


def _farthest(xs: np.ndarray, ys: np.ndarray, s: int, e: int) -> tuple[int, float]:
    """(vertex between s and e that is farthest from their chord, its distance)."""
    px, py = xs[s + 1:e], ys[s + 1:e]
    dx, dy = xs[e] - xs[s], ys[e] - ys[s]
    seg2 = dx * dx + dy * dy
    if seg2 == 0.0:
        d = np.hypot(px - xs[s], py - ys[s])
    else:
        t = np.clip(((px - xs[s]) * dx + (py - ys[s]) * dy) / seg2, 0.0, 1.0)
        d = np.hypot(px - (xs[s] + t * dx), py - (ys[s] + t * dy))
    i = int(np.argmax(d))
    return s + 1 + i, float(d[i])


def _split_keep_all(xs: np.ndarray, ys: np.ndarray, s: np.ndarray, e: np.ndarray, tol: np.ndarray, keep: np.ndarray) -> None:
    """``_split_keep`` of many lines (first and last vertices s, e) at once, marked in ``keep``."""
    keep[s] = keep[e] = True
    while len(s):
        inner = e > s + 1
        s, e, tol = s[inner], e[inner], tol[inner]
        if not len(s):
            return
        i, d = _farthest_all(xs, ys, s, e)
        far = d > tol
        s, e, tol, i = s[far], e[far], tol[far], i[far]
        keep[i] = True
        s, e, tol = np.concatenate([s, i]), np.concatenate([i, e]), np.concatenate([tol, tol])


def _farthest_all(xs: np.ndarray, ys: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_farthest`` of many chords, each with a vertex between its ends."""
    counts = e - s - 1
    first = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(s)), counts)
    at = np.arange(len(of)) - first[of] + s[of] + 1
    dx, dy = xs[e] - xs[s], ys[e] - ys[s]
    seg2 = dx * dx + dy * dy
    point, ox, oy = seg2 == 0.0, xs[s][of], ys[s][of]
    t = np.clip(((xs[at] - ox) * dx[of] + (ys[at] - oy) * dy[of]) / np.where(point, 1.0, seg2)[of], 0.0, 1.0)
    t[point[of]] = 0.0
    d = np.hypot(xs[at] - (ox + t * dx[of]), ys[at] - (oy + t * dy[of]))
    most = np.maximum.reduceat(d, first)
    # the first of equals, or the first that is not a number, as argmax takes it
    i, equal = s + 1, np.flatnonzero((d == most[of]) | np.isnan(d))[::-1]
    i[of[equal]] = at[equal]
    return i, most


def _crossing(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Which segments cross or touch another one (of their group) with which they share no end.

    Segments are compared along x only while their x ranges overlap.
    """
    group = np.zeros(len(ax), dtype=np.int64) if group is None else group
    order = np.lexsort((np.minimum(ax, bx), group))
    ax, ay, bx, by, group = ax[order], ay[order], bx[order], by[order], group[order]
    low, high = np.minimum(ax, bx), np.maximum(ax, bx)
    hit = np.zeros(len(ax), dtype=bool)
    i, step = np.arange(len(ax)), 0
    while len(i):
        step += 1
        i = i[i + step < len(ax)]
        i = i[(group[i + step] == group[i]) & (low[i + step] <= high[i])]
        j = i + step

        def side(p, q, rx, ry):
            return np.sign((bx[p] - ax[p]) * (ry[q] - ay[p]) - (by[p] - ay[p]) * (rx[q] - ax[p]))
        apart = (np.maximum(ay[i], by[i]) < np.minimum(ay[j], by[j])) | (np.maximum(ay[j], by[j]) < np.minimum(ay[i], by[i]))
        joined = ((ax[i] == ax[j]) & (ay[i] == ay[j])) | ((ax[i] == bx[j]) & (ay[i] == by[j])) \
            | ((bx[i] == ax[j]) & (by[i] == ay[j])) | ((bx[i] == bx[j]) & (by[i] == by[j]))
        cut = (side(i, j, ax, ay) * side(i, j, bx, by) <= 0) & (side(j, i, ax, ay) * side(j, i, bx, by) <= 0)
        bad = cut & ~apart & ~joined
        hit[i[bad]] = hit[j[bad]] = True
    out = np.zeros(len(ax), dtype=bool)
    out[order] = hit
    return out


def _uncross_all(xs: np.ndarray, ys: np.ndarray, line: np.ndarray, group: np.ndarray, keep: np.ndarray) -> None:
    """Puts vertices back until no segment of the kept lines crosses another of its group:
    of each crossing chord the vertex that is farthest from it. ``line`` and ``group``
    number each vertex's line and group, and ascend; ``keep`` is changed. Lines that
    did not cross before do not cross afterwards."""
    open_ = np.ones(len(xs), dtype=bool)
    while True:
        at = np.flatnonzero(keep & open_)
        a, b = at[:-1], at[1:]
        same = line[a] == line[b]
        a, b = a[same], b[same]
        bad = _crossing(xs[a], ys[a], xs[b], ys[b], group[a]) & (b > a + 1)
        if not bad.any():
            return
        a, b = a[bad], b[bad]
        keep[_farthest_all(xs, ys, a, b)[0]] = True
        open_ = np.isin(group, group[a])  # the others crossed nowhere, and did not change


def _uncross(lines: list[tuple[np.ndarray, np.ndarray]], keeps: list[np.ndarray]) -> None:
    """``_uncross_all`` of lines that may not cross one another; ``keeps`` is changed."""
    sizes = [len(k) for k in keeps]
    xs, ys = (np.concatenate([c[axis] for c in lines]) for axis in (0, 1))
    keep, line = np.concatenate(keeps), np.repeat(np.arange(len(lines)), sizes)
    _uncross_all(xs, ys, line, np.zeros(len(xs), dtype=np.int64), keep)
    for k, new in zip(keeps, np.split(keep, np.cumsum(sizes)[:-1])):
        k[:] = new


def _dp_keep_all(xs: np.ndarray, ys: np.ndarray, starts: np.ndarray, counts: np.ndarray, tol: np.ndarray) -> np.ndarray:
    """Douglas-Peucker of rings that lie one after the other; none collapses."""
    keep = np.ones(len(xs), dtype=bool)
    cut = np.flatnonzero((counts > 4) & (tol > 0))
    s, e = starts[cut], starts[cut] + counts[cut] - 1
    keep[np.repeat(np.isin(np.arange(len(counts)), cut), counts)] = False
    _split_keep_all(xs, ys, s, e, tol[cut], keep)
    held = np.append(0, np.cumsum(keep))
    small = held[e + 1] - held[s] < 4
    for a, b in zip(s[small], e[small] + 1):
        keep[a:b] = _triangle(xs[a:b], ys[a:b])
    return keep


def _dp_keep(xs: np.ndarray, ys: np.ndarray, tol: float) -> np.ndarray:
    return _dp_keep_all(xs, ys, np.array([0]), np.array([len(xs)]), np.array([tol]))


def _triangle(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """The vertices that a ring which would collapse keeps: start, the farthest vertex from
    it, and the vertex farthest from that chord (a closed triangle)."""
    keep = np.zeros(len(xs), dtype=bool)
    far = int(np.argmax(np.hypot(xs - xs[0], ys - ys[0])))
    dx, dy = xs[far] - xs[0], ys[far] - ys[0]
    dist = np.abs(dx * (ys - ys[0]) - dy * (xs - xs[0]))
    dist[[0, far, len(xs) - 1]] = -1
    keep[[0, far, int(np.argmax(dist)), len(xs) - 1]] = True
    return keep


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), type=pa.int32())


def simplify_array(geom: pa.Array, tol: np.ndarray) -> pa.Array:
    """Douglas-Peucker every ring of a MultiPolygon Arrow column (row tolerance)."""
    if isinstance(geom, pa.ChunkedArray):
        geom = geom.combine_chunks()
    valid = geom.is_valid().to_numpy(zero_copy_only=False)
    part_counts = geom.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    parts = geom.flatten()
    ring_counts = parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rings = parts.flatten()
    pt_counts = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    pts = rings.flatten()
    xs = pts.field("x").to_numpy(zero_copy_only=False)
    ys = pts.field("y").to_numpy(zero_copy_only=False)
    row_of_part = np.repeat(np.arange(len(geom)), part_counts)
    row_of_ring = row_of_part[np.repeat(np.arange(len(parts)), ring_counts)]
    starts = np.concatenate([[0], np.cumsum(pt_counts)[:-1]]) if len(pt_counts) else np.array([], int)
    keep = _dp_keep_all(xs, ys, starts, pt_counts, tol[row_of_ring])
    # the rings of a feature may not cross one another, nor may its parts
    row, ring = np.repeat(row_of_ring, pt_counts), np.repeat(np.arange(len(pt_counts)), pt_counts)
    cut = np.flatnonzero(np.isin(row, row[~keep]))
    held = keep[cut]
    _uncross_all(xs[cut], ys[cut], ring[cut], row[cut], held)
    keep[cut] = held
    new_counts = np.bincount(ring[keep], minlength=len(pt_counts)).astype(np.int64)
    point_type = geom.type.value_type.value_type.value_type
    new_pts = pa.StructArray.from_arrays([pa.array(xs[keep], pa.float64()), pa.array(ys[keep], pa.float64())],
                                         fields=list(point_type))
    ring_arr = pa.ListArray.from_arrays(_offsets(new_counts), new_pts, type=geom.type.value_type.value_type)
    part_arr = pa.ListArray.from_arrays(_offsets(ring_counts), ring_arr, type=geom.type.value_type)
    return pa.ListArray.from_arrays(_offsets(part_counts), part_arr, type=geom.type,
                                    mask=pa.array(~valid))


def tolerance_for(level: Column) -> Column:
    """Per-level tolerance in metres; unknown level -> the fixed default."""
    m = F.create_map(*[x for k, v in SIMPLIFY_TOLERANCE.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[level], F.lit(SIMPLIFY_TOLERANCE_DEFAULT))


def dealt_out(df: DataFrame) -> DataFrame:
    """Rows dealt out to all workers, for work that the few tasks of a small file's scan, or of
    a join of few bytes, would do alone. A task starts Python whatever it holds, so there
    are no more than keep the cores busy: the shuffle partitions grow with the
    lots, which a layer's features do not."""
    spark = df.sparkSession
    workers = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(workers, max(64, 4 * spark.sparkContext.defaultParallelism)))


def simplify(df: DataFrame, tolerance: Column | float, geom: str = "geometry") -> DataFrame:
    """Douglas-Peucker simplification of ``geom`` (metres), rings never collapse."""
    tol_col = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    with_tol = dealt_out(df.withColumn("_tol", tol_col.cast("double")))
    schema = with_tol.schema

    def fn(batches):
        for rb in batches:
            gi = rb.schema.get_field_index(geom)
            tol = rb.column(rb.schema.get_field_index("_tol")).to_numpy(zero_copy_only=False)
            cols = list(rb.columns)
            cols[gi] = simplify_array(rb.column(gi), tol)
            yield pa.RecordBatch.from_arrays(cols, schema=rb.schema)

    return with_tol.mapInArrow(fn, schema).drop("_tol")


# --- shared-border (topology-consistent) simplification -----------------------

def junction_nodes(df: DataFrame, layer_keys: list[str], geom: str = "geometry") -> DataFrame:
    """Vertices whose degree in the layer's undirected edge graph is not 2.

    Where three features meet, or a border ends, the degree differs from 2;
    such vertices cut rings into arcs that are shared whole by neighbours.
    """
    e = undirected(edges(df, layer_keys + ["code"], geom))
    distinct_edges = e.select(*layer_keys, "ux1", "uy1", "ux2", "uy2").distinct()
    ends = distinct_edges.select(*layer_keys, F.explode(F.array(
        F.struct(F.col("ux1").alias("x"), F.col("uy1").alias("y")),
        F.struct(F.col("ux2").alias("x"), F.col("uy2").alias("y")))).alias("v")).select(*layer_keys, "v.x", "v.y")
    return ends.groupBy(*layer_keys, "x", "y").count().where(F.col("count") != 2).drop("count")


def _canonical(seg_x: np.ndarray, seg_y: np.ndarray) -> bool:
    """True when the polyline must be reversed to its canonical direction."""
    a, b = (seg_x[0], seg_y[0]), (seg_x[-1], seg_y[-1])
    if a != b:
        return a > b
    if len(seg_x) > 2:
        return (seg_x[1], seg_y[1]) > (seg_x[-2], seg_y[-2])
    return False


def _arc_keep(xs: np.ndarray, ys: np.ndarray, tol: float) -> np.ndarray:
    """Douglas-Peucker of an open arc (endpoints fixed) in canonical direction."""
    n = len(xs)
    if n <= 2 or not tol > 0:
        return np.ones(n, dtype=bool)
    rev = _canonical(xs, ys)
    cx, cy = (xs[::-1], ys[::-1]) if rev else (xs, ys)
    keep = _split_keep(cx, cy, tol)
    if keep.sum() == 2 and n > 2 and (cx[0], cy[0]) == (cx[-1], cy[-1]):
        # a closed arc keeps its farthest vertex so the ring never collapses
        d = np.hypot(cx - cx[0], cy - cy[0]) + np.hypot(cx - cx[-1], cy - cy[-1])
        d[[0, n - 1]] = -1
        keep[int(np.argmax(d))] = True
    if not keep.all():
        # within the arc, so that both features that share it decide alike
        _uncross([(cx, cy)], [keep])
    return keep[::-1] if rev else keep


def _ring_keep_shared(xs: np.ndarray, ys: np.ndarray, is_node: np.ndarray, tol: float) -> tuple[np.ndarray, int]:
    """Keep-mask of a closed ring simplified arc by arc; also the canonical start."""
    m = len(xs) - 1  # distinct vertices (last repeats the first)
    if m < 3 or not tol > 0:
        return np.ones(len(xs), dtype=bool), 0
    nodes = np.flatnonzero(is_node[:m])
    if len(nodes) == 0:
        nodes = np.array([min(range(m), key=lambda q: (xs[q], ys[q]))])
    keep = np.zeros(m, dtype=bool)
    for a, b in zip(nodes, np.append(nodes[1:], nodes[0] + m)):
        idx = np.arange(a, b + 1) % m
        k = _arc_keep(xs[idx], ys[idx], tol)
        keep[idx[k]] = True
    if keep.sum() < 3:
        # degenerate ring (all arcs straight): keep the vertex farthest from the kept ones
        k = np.flatnonzero(keep)
        d = np.min(np.hypot(xs[:m, None] - xs[k][None, :], ys[:m, None] - ys[k][None, :]), axis=1)
        keep[int(np.argmax(d))] = True
    kept = np.flatnonzero(keep)
    start = min(kept, key=lambda q: (xs[q], ys[q]))
    full = np.append(keep, True)
    return full, int(start)


def simplify_shared(df: DataFrame, tolerance: Column | float, layer_keys: list[str],
                    geom: str = "geometry") -> DataFrame:
    """Douglas-Peucker per shared arc: a border two features share is simplified
    once (same vertices on both sides), so neighbours still meet exactly.

    Junction vertices come from a distributed degree count; each feature's
    node positions are gathered by one group-by on its own vertices and the
    arcs are simplified in an Arrow batch function.  ``df`` needs a ``code``.
    """
    tol_col = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    nodes = junction_nodes(df, layer_keys, geom).withColumn("_node", F.lit(True))
    parts = df.select(*layer_keys, "code", F.posexplode(geom).alias("_pi", "_part"))
    rings = parts.select(*layer_keys, "code", "_pi", F.posexplode("_part").alias("_ri", "_ring"))
    verts = rings.select(*layer_keys, "code", "_pi", "_ri", F.posexplode("_ring").alias("_vi", "_p")) \
                 .select(*layer_keys, "code", "_pi", "_ri", "_vi", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
    flagged = verts.join(nodes, layer_keys + ["x", "y"], "inner")
    node_pos = flagged.groupBy(*layer_keys, "code").agg(
        F.collect_list(F.struct("_pi", "_ri", "_vi")).alias("_nodes"))
    with_nodes = dealt_out(df.join(node_pos, layer_keys + ["code"], "left").withColumn("_tol", tol_col.cast("double")))
    schema = with_nodes.schema

    def fn(batches):
        for rb in batches:
            gi = rb.schema.get_field_index(geom)
            tol = rb.column(rb.schema.get_field_index("_tol")).to_numpy(zero_copy_only=False)
            node_lists = rb.column(rb.schema.get_field_index("_nodes")).to_pylist()
            cols = list(rb.columns)
            cols[gi] = _simplify_shared_array(rb.column(gi), tol, node_lists)
            yield pa.RecordBatch.from_arrays(cols, schema=rb.schema)

    return with_nodes.mapInArrow(fn, schema).drop("_tol", "_nodes")


def _simplify_shared_array(geom: pa.Array, tol: np.ndarray, node_lists: list) -> pa.Array:
    """Arc-wise simplification of every ring of a MultiPolygon Arrow column.

    Coordinates stay flat numpy arrays; Python loops run per ring and per
    junction node, never per vertex.
    """
    if isinstance(geom, pa.ChunkedArray):
        geom = geom.combine_chunks()
    valid = geom.is_valid().to_numpy(zero_copy_only=False)
    part_counts = geom.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    parts = geom.flatten()
    ring_counts = parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rings = parts.flatten()
    pt_counts = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    pts = rings.flatten()
    xs = pts.field("x").to_numpy(zero_copy_only=False)
    ys = pts.field("y").to_numpy(zero_copy_only=False)
    part_start = np.concatenate([[0], np.cumsum(part_counts)])
    ring_start = np.concatenate([[0], np.cumsum(ring_counts)])
    pt_start = np.concatenate([[0], np.cumsum(pt_counts)])
    row_of_ring = np.repeat(np.arange(len(geom)), part_counts)[np.repeat(np.arange(len(parts)), ring_counts)]
    node_mask = np.zeros(len(xs), dtype=bool)
    for r, nodes in enumerate(node_lists):
        for d in nodes or []:
            ring_id = ring_start[part_start[r] + d["_pi"]] + d["_ri"]
            node_mask[pt_start[ring_id] + d["_vi"]] = True
    out_x, out_y, new_counts = [], [], np.zeros(len(pt_counts), dtype=np.int64)
    for q in range(len(pt_counts)):
        a, n = int(pt_start[q]), int(pt_counts[q])
        rx, ry = xs[a:a + n], ys[a:a + n]
        if n < 4:
            out_x.append(rx)
            out_y.append(ry)
            new_counts[q] = n
            continue
        keep, first = _ring_keep_shared(rx, ry, node_mask[a:a + n], float(tol[row_of_ring[q]]))
        kept = np.flatnonzero(keep[:-1])
        k0 = int(np.searchsorted(kept, first))
        order = np.concatenate([kept[k0:], kept[:k0], kept[k0:k0 + 1]])
        out_x.append(rx[order])
        out_y.append(ry[order])
        new_counts[q] = len(order)
    nx = np.concatenate(out_x) if out_x else np.array([], dtype=float)
    ny = np.concatenate(out_y) if out_y else np.array([], dtype=float)
    point_type = geom.type.value_type.value_type.value_type
    new_pts = pa.StructArray.from_arrays([pa.array(nx, pa.float64()), pa.array(ny, pa.float64())],
                                         fields=list(point_type))
    ring_arr = pa.ListArray.from_arrays(_offsets(new_counts), new_pts, type=geom.type.value_type.value_type)
    part_arr = pa.ListArray.from_arrays(_offsets(ring_counts), ring_arr, type=geom.type.value_type)
    return pa.ListArray.from_arrays(_offsets(part_counts), part_arr, type=geom.type, mask=pa.array(~valid))
