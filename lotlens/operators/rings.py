"""Directed boundary edges linked into rings, and rings into polygons, by joins.

Every edge finds its successor at its end vertex. Edges are numbered in the order of
their coordinates and dealt out in blocks of consecutive numbers; a block's task
follows successors as far as they lie in the block and returns chains. Chains
of one ring are linked by pointer doubling: each round joins a chain with the one that
it points to, so a ring of n chains takes log2(n) rounds, and a ring inside one
block takes none. A chain then knows the ring's first edge and how far off it is, which
gives each edge its place. Holes find the smallest shell around them by counting the
shell's edges to the right of a point, met by equal slabs of a pyramid over y.

No task holds more than a block's edges; the output row of a feature is the only place
that holds a feature.
"""

from __future__ import annotations

import math
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.session import checkpoint_dir

BLOCK = 1 << 16


def _written(df: DataFrame) -> DataFrame:
    path = os.path.join(checkpoint_dir(df.sparkSession), "rings", uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(a: DataFrame, b: DataFrame, keys: list[str], prefix: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[prefix + k])
    return on


def numbered(boundary: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with an ``id`` that ascends with keys and coordinates, and their ``block``."""
    order = [*keys, "ax", "ay", "bx", "by"]
    rows = boundary.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("id", F.monotonically_increasing_id())
    return _written(rows.withColumn("block", F.shiftright("id", int(math.log2(BLOCK)))))


def successors(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(id, block, next): of the edges that leave an edge's end the first one clockwise from
    the way back, which keeps the inside on the left. An edge that ends nowhere has none."""
    out = edges.select(*(F.col(k).alias("_" + k) for k in keys), *(F.col(c).alias("_" + c) for c in ("ax", "ay", "bx", "by", "id")))
    meet = _same(edges, out, keys, "_") & (edges["bx"] == out["_ax"]) & (edges["by"] == out["_ay"])
    back = F.atan2(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx"))
    turn = back - F.atan2(F.col("_by") - F.col("_ay"), F.col("_bx") - F.col("_ax"))
    turn = F.when(turn <= 0, turn + 2 * math.pi).otherwise(turn)
    joined = edges.join(out, meet, "left")
    return joined.groupBy("id", "block").agg(F.min(F.when(F.col("_id").isNotNull(), F.struct(turn, "_id")))["_id"].alias("next"))




def _follow(ids: np.ndarray, follows: np.ndarray) -> tuple[list, list]:
    """Of a block: (id, chain, step) of each edge, (chain, next, length, least id, its
    step) of each chain. ``follows`` is -1 where there is no next edge."""
    order = np.argsort(ids)
    ids, follows = ids[order], follows[order]
    at = np.minimum(np.searchsorted(ids, follows), len(ids) - 1)
    inside = ids[at] == follows
    first = np.ones(len(ids), bool)
    first[at[inside]] = False
    step_to, seen = np.where(inside, at, -1).tolist(), [False] * len(ids)
    places, chains = [], []
    # what no edge of the block leads to begins a chain; what is left are whole rings
    for start in (*np.flatnonzero(first).tolist(), *range(len(ids))):
        if seen[start]:
            continue
        walk, i = [], start
        while i >= 0 and not seen[i]:
            seen[i] = True
            walk.append(i)
            i = step_to[i]
        head, least = int(ids[start]), min(walk)
        places += [(int(ids[j]), head, k) for k, j in enumerate(walk)]
        chains.append((head, head if i == start else int(follows[walk[-1]]), len(walk), int(ids[least]), walk.index(least)))
    return places, chains


def _block_rows(batches):
    """Rows sorted by block -> places and chains of each block, in one schema."""
    def rows(found):
        places, chains = found
        cols = [*zip(*(p + (None,) * 5 for p in places))] if places else [[]] * 8
        first = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=_NAMES)
        cols = [*zip(*((None,) * 3 + c for c in chains))] if chains else [[]] * 8
        return first, pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=_NAMES)

    held, at = [], None
    for batch in batches:
        ids, blocks, follows = (c.fill_null(-1).to_numpy() for c in batch.columns)
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(blocks)]):
            if hi > lo:
                if held and blocks[lo] != at:
                    yield from rows(_follow(*(np.concatenate(c) for c in zip(*held))))
                    held = []
                at = blocks[lo]
                held.append((ids[lo:hi], follows[lo:hi]))
    if held:
        yield from rows(_follow(*(np.concatenate(c) for c in zip(*held))))


_NAMES = ["id", "in_chain", "step", "chain", "next", "length", "least", "off"]


def places(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(id, ring, place, size): the ring is named by its first edge in the order of ids;
    places count from there. Edges of lines that don't close are left out."""
    linked = successors(edges, keys).select("id", "block", "next").repartition("block").sortWithinPartitions("block")
    found = _written(linked.mapInArrow(_block_rows, ", ".join(f"{n} long" for n in _NAMES)))
    chains = found.where("chain IS NOT NULL").select("chain", "next", "length", "least", "off")
    whole = chains.where("next = chain").select("chain", "least", "off", "length")
    # of open chains: what lies within the next ``span`` edges from the chain's head
    state = chains.where("next IS NULL OR next <> chain").where("next >= 0").withColumnRenamed("length", "span")
    state = _written(state.select("chain", "next", "span", "least", "off"))
    while not state.isEmpty():
        on = state.select(*(F.col(c).alias("_" + c) for c in state.columns))
        better = F.col("_least") < F.col("least")
        state = _written(state.join(on, F.col("next") == F.col("_chain")).select(
            "chain", F.col("_next").alias("next"), (F.col("span") + F.col("_span")).alias("span"),
            F.least("least", "_least").alias("least"),
            F.when(better, F.col("span") + F.col("_off")).otherwise(F.col("off")).alias("off"), better.alias("changed")))
        changed = not state.where("changed").isEmpty()
        state = state.drop("changed")
        if not changed:
            break
    own = state.join(chains.select("chain", "length"), "chain").select("chain", "least", "off", "length")
    rings = whole.unionByName(own)
    rings = rings.withColumnsRenamed({"chain": "_chain"})
    sizes = rings.groupBy(F.col("least").alias("ring")).agg(F.sum("length").alias("size"))
    edge = found.where("id IS NOT NULL").select("id", "in_chain", "step")
    placed = edge.join(rings, F.col("in_chain") == F.col("_chain")).join(sizes, F.col("least") == F.col("ring"))
    return placed.select("id", "ring", F.pmod(F.col("step") - F.col("off"), F.col("size")).alias("place"), "size")


def _owners(holes: DataFrame, shell_edges: DataFrame) -> DataFrame:
    """(ring, owner): the smallest shell of the hole's feature around the hole's probe.
    ``holes``: feature, ring, px, py; ``shell_edges``: feature, shell, area, edge."""
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    e = shell_edges.where("ay <> by").withColumns({"low": low, "high": high})
    e = e.withColumn("zoom", F.ceil(F.log2(F.col("high") - F.col("low"))).cast("int"))
    cell = F.pow(F.lit(2.0), F.col("zoom"))
    e = e.withColumn("slab", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor(F.col("high") / cell))))
    zooms = e.groupBy(F.col("feature").alias("_feature")).agg(F.collect_set("zoom").alias("zooms"))
    probe = holes.join(zooms, F.col("feature") == F.col("_feature")).withColumn("zoom", F.explode("zooms"))
    probe = probe.select("feature", F.col("ring").alias("hole"), "px", "py", "zoom",
                         F.floor(F.col("py") / F.pow(F.lit(2.0), F.col("zoom"))).alias("slab"))
    met = e.join(probe, ["feature", "zoom", "slab"])
    crosses = (F.col("ay") > F.col("py")) != (F.col("by") > F.col("py"))
    right = F.col("ax") + (F.col("py") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay")) > F.col("px")
    around = (met.where(crosses & right).groupBy("hole", "shell", "area").agg(F.count("*").alias("n")).where("n % 2 = 1"))
    # of equally large shells the one that comes last in the feature
    return around.groupBy("hole").agg(F.min(F.struct("area", (-F.col("shell")).alias("order"))).alias("best")).select(
        F.col("hole").alias("ring"), (-F.col("best.order")).alias("owner"))


def stitched(boundary: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ax, ay, bx, by) -> (keys, geometry): counter-clockwise rings are shells,
    clockwise ones holes of the smallest shell around them (without one they are left
    out). Rings start at their smallest vertex and close; shells come by falling area, then
    by first vertex, holes by first vertex."""
    edges = numbered(boundary, keys)
    place = places(edges, keys)
    rows = _written(edges.join(place.where("size >= 3"), "id").drop("block", "id"))
    start = rows.where("place = 0").select(F.col("ring").alias("_ring"), F.col("ax").alias("sx"), F.col("ay").alias("sy"),
                                           F.col("bx").alias("tx"), F.col("by").alias("ty"))
    cross = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    rings = rows.groupBy(*keys, "ring").agg(F.sum(cross).alias("area"), F.array_sort(F.collect_list(
        F.struct("place", F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")).alias("p")))).alias("points"))
    line = F.transform("points", lambda q: q["p"])
    rings = rings.join(start, F.col("ring") == F.col("_ring")).select(
        *keys, "ring", "area", "sx", "sy", ((F.col("sx") + F.col("tx")) / 2).alias("px"), ((F.col("sy") + F.col("ty")) / 2).alias("py"),
        F.concat(line, F.slice(line, 1, 1)).alias("line"))
    rings = _written(rings.where("area <> 0"))
    shells, holes = rings.where("area > 0"), rings.where("area < 0")
    feature = F.hash(F.lit(0)) if not keys else F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    of_shell = shells.select(F.col("ring").alias("shell"), "area")
    shell_edges = rows.join(of_shell, F.col("ring") == F.col("shell")).select(feature.alias("feature"), "shell", "area", "ax", "ay", "bx", "by")
    owner = _owners(holes.select(feature.alias("feature"), "ring", "px", "py"), shell_edges)
    inner = holes.join(owner, "ring").groupBy(F.col("owner").alias("_owner")).agg(
        F.array_sort(F.collect_list(F.struct("sx", "sy", "line"))).alias("inner"))
    parts = shells.join(inner, F.col("ring") == F.col("_owner"), "left")
    none = F.array().cast(rings.schema["line"].dataType.simpleString().join(("array<", ">")))
    part = F.concat(F.array("line"), F.coalesce(F.transform("inner", lambda h: h["line"]), none))
    return (parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("area")).alias("by_area"), "sx", "sy", part.alias("part"))))
                                     .alias("parts"))
            .select(*keys, F.transform("parts", lambda q: q["part"]).alias("geometry")))
