"""Simplified layers without crossings: a check and a repair over a whole layer.

A chord stands for the vertices that simplification removed between two kept ones.
Chords of a layer may not cross or touch one another but at shared ends (whichever
arcs, rings or features they belong to), no kept vertex may lie between a chord
and the line that it replaces (a hole or a neighbour would change sides), and no two
lines may shrink to one chord. All pairs come from equi-joins on the cells of a grid
pyramid: a chord is entered at the level whose cells are as large as itself, in at
most four cells, and looks for larger ones at the coarser levels.

Of each chord at fault the removed vertex farthest from it is put back, by its
coordinates, on every feature that has it, so that shared borders stay shared. Rounds
follow until none is at fault; each is checkpointed. A layer without crossings
before simplification has none afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lotlens.operators.geometry import dealt_out, simplify_shared
from lotlens.session import checkpoint_dir

_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_CHORD = [T.StructField(c, T.DoubleType()) for c in ("ax", "ay", "bx", "by")]


def _rings(geometry: list) -> list[list[tuple[float, float]]]:
    return [[(p["x"], p["y"]) for p in ring] for part in geometry or () for ring in part or ()]


def ring_chords(original: list[tuple[float, float]], kept: list[bool]) -> list[list[tuple[float, float]]]:
    """The lines between successive kept vertices of a closed ring, each from its
    smaller end."""
    marks, n = [i for i, k in enumerate(kept[:-1]) if k], len(original) - 1
    twice = original[:-1] * 2
    lines = (twice[a:b + 1] for a, b in zip(marks, marks[1:] + [m + n for m in marks[:1]]))
    return [min(line, line[::-1]) for line in lines]


def farthest(line: np.ndarray) -> tuple[float, float] | None:
    """The inner vertex farthest from the chord; of equals the smallest."""
    if len(line) < 3:
        return None
    a, d = line[0], line[-1] - line[0]
    inner = line[1:-1]
    size = float(d @ d)
    t = np.clip(((inner - a) @ d) / size, 0.0, 1.0) if size else np.zeros(len(inner))
    gap = np.hypot(*(inner - (a + t[:, None] * d)).T)
    x, y = min(map(tuple, inner[gap == gap.max()]))
    return float(x), float(y)


def chords(features: DataFrame, keys: list[str], original: str = "_original", geom: str = "geometry") -> DataFrame:
    """One row per chord of a layer: keys, ends, line (with both ends), the farthest
    removed vertex (px, py), and whether another line of the layer has the same ends.

    A chord that two features share is one row."""
    own = [features.schema[k] for k in keys]
    schema = T.StructType([*own, *_CHORD, T.StructField("line", T.ArrayType(_POINT)),
                           *(T.StructField(c, T.DoubleType()) for c in ("px", "py"))])
    arrow = to_arrow_schema(schema)

    def fn(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = []
                for row in batch.slice(start, 256).to_pylist():
                    named = [row[k] for k in keys]
                    for was, now in zip(_rings(row[original]), _rings(row[geom])):
                        if len(was) < 4 or len(now) < 4:
                            continue
                        points = set(now)
                        for line in ring_chords(was, [p in points for p in was]):
                            far = farthest(np.array(line)) if len(line) > 2 else None
                            out.append((*named, *line[0], *line[-1], [{"x": x, "y": y} for x, y in line], *(far or (None, None))))
                cols = zip(*out) if out else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    rows = features.select(*keys, original, geom).mapInArrow(fn, schema)
    lines = rows.groupBy(*keys, "ax", "ay", "bx", "by").agg(
        F.collect_set(F.struct("line", "px", "py")).alias("lines"))
    return lines.select(*keys, "ax", "ay", "bx", "by", (F.size("lines") > 1).alias("collapsed"),
                        F.explode("lines").alias("l")).select(*keys, "ax", "ay", "bx", "by", "collapsed", "l.*")


def _bounds(points: Column) -> list[Column]:
    return [f(points.getField(c)) for c in ("x", "y") for f in (F.array_min, F.array_max)]


def with_level(df: DataFrame, points: Column) -> DataFrame:
    """Adds the bounding box and the level whose cells are as large as it."""
    x0, x1, y0, y1 = _bounds(points)
    df = df.withColumns({"x0": x0, "x1": x1, "y0": y0, "y1": y1})
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-6))
    return df.withColumn("zoom", F.ceil(F.log2(extent)).cast("int"))


def _cells(df: DataFrame, zooms: Column) -> DataFrame:
    """A row for each cell that the bounding box touches at each of ``zooms``."""
    df = df.withColumn("at", F.explode(zooms))
    size = F.pow(F.lit(2.0), F.col("at"))
    for axis in "xy":
        df = df.withColumn(f"c{axis}", F.explode(F.sequence(F.floor(F.col(f"{axis}0") / size), F.floor(F.col(f"{axis}1") / size))))
    return df


def _side(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))


def crossing_pairs(entered: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of chords (columns l_* and r_*) that cross or touch without a shared end.
    ``entered``: chords with their levels."""
    entered = entered.select(*keys, "ax", "ay", "bx", "by", "px", "py", "x0", "x1", "y0", "y1", "zoom")
    top = entered.groupBy(*keys).agg(F.max("zoom").alias("top"))
    small = _cells(entered.join(top, keys), F.sequence("zoom", "top")).drop("top")
    large = _cells(entered, F.array("zoom"))
    names = [c for c in small.columns if c not in (*keys, "at", "cx", "cy")]
    small = small.withColumnsRenamed({c: f"l_{c}" for c in names})
    large = large.withColumnsRenamed({c: f"r_{c}" for c in names})
    c = F.col
    first = F.struct("l_ax", "l_ay", "l_bx", "l_by") < F.struct("r_ax", "r_ay", "r_bx", "r_by")
    apart = F.lit(False)  # the boxes above are those of the lines, these are the chords'
    for axis in "xy":
        (l0, l1), (r0, r1) = ([f(c(f"{s}_a{axis}"), c(f"{s}_b{axis}")) for f in (F.least, F.greatest)] for s in "lr")
        apart = apart | (l1 < r0) | (r1 < l0)
    joined = F.lit(False)
    for u in "ab":
        for v in "ab":
            joined = joined | ((c(f"l_{u}x") == c(f"r_{v}x")) & (c(f"l_{u}y") == c(f"r_{v}y")))

    def across(u: str, v: str) -> Column:
        ends = [c(f"{u}_{k}") for k in ("ax", "ay", "bx", "by")]
        return _side(*ends, c(f"{v}_ax"), c(f"{v}_ay")) * _side(*ends, c(f"{v}_bx"), c(f"{v}_by")) <= 0

    found = small.join(large, [*keys, "at", "cx", "cy"]).where(
        ((c("l_zoom") < c("r_zoom")) | first) & ~apart & ~joined & across("l", "r") & across("r", "l"))
    return found.drop("at", "cx", "cy").distinct()


def inside(x: Column, y: Column, line: Column) -> Column:
    """Whether a point lies inside the polygon of a line and its chord, or of a ring."""
    n = F.size(line)
    return F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(False),
        lambda odd, i: F.when(
            (line[i]["y"] > y) != (line[(i + 1) % n]["y"] > y),
            odd != (x < line[i]["x"] + (y - line[i]["y"]) * (line[(i + 1) % n]["x"] - line[i]["x"])
                    / (line[(i + 1) % n]["y"] - line[i]["y"]))).otherwise(odd))


def swept(entered: DataFrame, keys: list[str]) -> DataFrame:
    """Chords between which and their line a kept vertex of the layer lies."""
    moved = entered.where("px IS NOT NULL")
    zooms = moved.groupBy(*keys).agg(F.min("zoom").alias("low"), F.max("zoom").alias("top"))
    ends = F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")),
                             F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))))
    vertices = entered.select(*keys, ends.alias("v")).select(*keys, "v.x", "v.y").distinct()
    probe = vertices.select(*keys, "x", "y", *(F.col(a).alias(f"{a}{k}") for a in "xy" for k in "01")).join(zooms, keys)
    probe = _cells(probe, F.sequence("low", "top")).select(*keys, "x", "y", "at", "cx", "cy")
    areas = _cells(moved.select(*keys, "line", "px", "py", "x0", "x1", "y0", "y1", "zoom"), F.array("zoom"))
    box = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    own = F.exists("line", lambda p: (p["x"] == F.col("x")) & (p["y"] == F.col("y")))
    return (areas.join(probe, [*keys, "at", "cx", "cy"]).where(box)
            .where(~own & inside(F.col("x"), F.col("y"), F.col("line"))).select(*keys, "px", "py").distinct())


def faults(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Vertices (keys, px, py) to put back on the layer with these chords."""
    entered = with_level(lines, F.col("line"))
    # the crossing test takes the chord's own box, which lies inside its line's
    pairs = crossing_pairs(entered, keys)
    both = pairs.select(*keys, F.explode(F.array(*(F.struct(F.col(f"{s}_px").alias("px"), F.col(f"{s}_py").alias("py"))
                                                   for s in "lr"))).alias("p")).select(*keys, "p.*")
    shrunk = lines.where("collapsed").select(*keys, "px", "py")
    return both.unionByName(shrunk).unionByName(swept(entered, keys)).where("px IS NOT NULL").distinct()


def _put_back(features: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """``features`` with the vertices ``points`` (keys, px, py) kept wherever they occur."""
    vertices = features.select(*keys, "code", F.explode(F.flatten(F.flatten("_original"))).alias("p"))
    # rows that repeat keys and code share their vertices, and get the same ones back
    given = (vertices.select(*keys, "code", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
             .join(points, [*keys, "px", "py"]).groupBy(*keys, "code")
             .agg(F.collect_set(F.struct(F.col("px").alias("x"), F.col("py").alias("y"))).alias("_back")))
    joined = dealt_out(features.join(given, [*keys, "code"], "left").select(*features.columns, "_back"))
    schema = joined.schema

    def fn(batches):
        arrow = to_arrow_schema(schema)
        at = {n: i for i, n in enumerate(schema.names)}
        for batch in batches:
            cols = list(batch.columns)
            geometry = []
            for was, now, back in zip(*(batch.column(at[n]).to_pylist() for n in ("_original", "geometry", "_back"))):
                geometry.append(now if not back else _kept_again(was, now, back))
            cols[at["geometry"]] = pa.array(geometry, arrow.field("geometry").type)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return joined.mapInArrow(fn, schema).drop("_back")


def _kept_again(original: list, geometry: list, back: list) -> list:
    points, out = {(p["x"], p["y"]) for p in back}, []
    for part, simple in zip(original, geometry):
        rings = []
        for was, now in zip(part, simple):
            (line,), (short,) = _rings([[was]]), _rings([[now]])
            if len(line) >= 4 and len(short) >= 4:
                held = points | set(short)
                kept = [p for p in line[:-1] if p in held]
                first = min(range(len(kept)), key=kept.__getitem__)
                now = [{"x": x, "y": y} for x, y in kept[first:] + kept[:first + 1]]
            rings.append(now)
        out.append(rings)
    return out


def simplify_layer(features: DataFrame, tolerance: Column | float, keys: list[str]) -> DataFrame:
    """``simplify_shared``, then as many vertices put back as are needed for layers
    (features of equal ``keys``) without crossings. ``features`` hold a ``code`` and a
    geometry. Null geometries stay null; an empty table gives an empty result."""
    checkpoint_dir(features.sparkSession)
    state = simplify_shared(features.withColumn("_original", F.col("geometry")), tolerance, keys).checkpoint()
    while True:
        # kept: the joins below read the chords many times, each with columns of its own
        back = faults(chords(state, keys).checkpoint(), keys).checkpoint()
        if back.isEmpty():
            return state.drop("_original")
        state = _put_back(state, back, keys).checkpoint()


def crossings(features: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, crossings): how many chords of other lines cross or touch the
    feature's, over all features of its layer; features without any have 0."""
    plain = features.select(*keys, "code", "geometry", F.col("geometry").alias("_original"))
    lines = with_level(chords(plain, keys), F.col("line"))
    pairs = crossing_pairs(lines, keys)
    ends = ("ax", "ay", "bx", "by")
    hit = pairs.select(*keys, F.explode(F.array(*(F.struct(*(F.col(f"{s}_{c}").alias(c) for c in ends)) for s in "lr")))
                       .alias("e")).select(*keys, "e.*").groupBy(*keys, *ends).agg(F.count("*").alias("n"))
    with_code = plain.select(*keys, "code", F.explode(F.flatten("geometry")).alias("r"))
    pairs_of = F.transform(F.sequence(F.lit(1), F.size("r") - 1), lambda i: F.struct(
        F.least(F.element_at("r", i), F.element_at("r", i + 1)).alias("a"),
        F.greatest(F.element_at("r", i), F.element_at("r", i + 1)).alias("b")))
    own = (with_code.where(F.size("r") > 1).select(*keys, "code", F.explode(pairs_of).alias("e"))
           .select(*keys, "code", *(F.col(f"e.{c[0]}.{c[1]}").alias(c) for c in ends)).distinct())
    counts = own.join(hit, [*keys, *ends]).groupBy(*keys, "code").agg(F.sum("n").alias("n"))
    return (features.select(*keys, "code").join(counts, [*keys, "code"], "left")
            .select(*keys, "code", F.coalesce("n", F.lit(0)).cast("long").alias("crossings")))
