"""Overlap join over a quadtree split by load: pairs, even tasks, odd input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotlens.operators import loadtree, viewport

LEFT, RIGHT = ("west", "south", "east", "north"), ("minx", "miny", "maxx", "maxy")
LSCHEMA = "event_id long, west double, south double, east double, north double"
RSCHEMA = "code long, minx double, miny double, maxx double, maxy double"


def rect(rng, spread, sides):
    x, y, s = rng.uniform(-spread, spread), rng.uniform(-spread, spread), rng.choice(sides)
    return x, y, x + s * rng.random(), y + s * rng.random()


@pytest.mark.parametrize("max_load,depth", [(1, 12), (7, 5), (50, 3), (10**6, 12)])
def test_pairs_are_those_of_brute_force(spark, max_load, depth):
    rng = random.Random(max_load)
    left = [(i, *rect(rng, 1000.0 if i % 3 else 20.0, [0.0, 1.0, 30.0, 900.0])) for i in range(300)]
    left += [(300, 0.0, 0.0, 64.0, 64.0), (301, 64.0, 64.0, 64.0, 64.0), (301, 64.0, 64.0, 64.0, 64.0)]
    right = [(i, *rect(rng, 1000.0, [0.0, 10.0, 200.0, 2500.0])) for i in range(120)]
    right += [(120, 64.0, 64.0, 128.0, 128.0), (121, -1e4, -1e4, 1e4, 1e4)]
    want = sorted((a[0], b[0]) for a in left for b in right
                  if b[3] >= a[1] and b[1] <= a[3] and b[4] >= a[2] and b[2] <= a[4])
    got = loadtree.tree_join(spark.createDataFrame(left, LSCHEMA), spark.createDataFrame(right, RSCHEMA), LEFT, RIGHT,
                             max_load=max_load, depth=depth)
    assert got.columns == ["event_id", *LEFT, "code", *RIGHT]
    assert sorted((r.event_id, r.code) for r in got.collect()) == want and len(want) > 500


def test_unusable_rectangles_and_empty_tables(spark):
    left = spark.createDataFrame([(0, None, 0.0, 1.0, 1.0), (1, 0.0, 0.0, float("inf"), 1.0), (2, 5.0, 0.0, 1.0, 1.0),
                                  (3, 0.0, 0.0, float("nan"), 1.0), (4, 0.0, 0.0, 0.0, 0.0)], LSCHEMA)
    right = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0), (1, None, 0.0, 1.0, 1.0)], RSCHEMA)
    assert [(r.event_id, r.code) for r in loadtree.tree_join(left, right, LEFT, RIGHT).collect()] == [(4, 0)]
    assert loadtree.tree_join(left.limit(0), right, LEFT, RIGHT).count() == 0
    assert loadtree.tree_join(left, right.limit(0), LEFT, RIGHT).count() == 0
    assert loadtree.tree_join(left.where("event_id = 0"), right, LEFT, RIGHT).count() == 0


def crowd(spark, n, places):
    """Viewports, nine in ten of which are in one 50 km cell, at so many places."""
    i = F.col("id")
    west = F.when(i % 10 == 0, i * 7919 % 500000).otherwise(210000 + F.pmod(F.hash(i), F.lit(places)) * (30000.0 / places))
    south = F.when(i % 10 == 0, i * 104729 % 500000).otherwise(210000 + F.pmod(F.hash(i, F.lit(1)), F.lit(places)) * (30000.0 / places))
    at = spark.range(n).select(i.alias("event_id"), west.cast("double").alias("west"), south.cast("double").alias("south"))
    return at.withColumn("east", F.col("west") + 1500).withColumn("north", F.col("south") + 1500)


@pytest.mark.parametrize("places", [1, 2, 30000])
def test_no_task_has_over_three_times_the_median(spark, places):
    left = crowd(spark, 40000, places)
    tree = loadtree.load_tree(left, LEFT, min_load=100)
    dealt = loadtree.deal_left(left, LEFT, tree)
    assert dealt.count() == 40000
    sizes = sorted(r["count"] for r in dealt.repartition(8, *loadtree.LEAF).groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 3 * sizes[4]
    # the cells of fixed size put nine tenths of the rows into one task
    fixed = viewport._cells(left.withColumn("_lv", F.lit(0)), *LEFT, 50000.0)
    worst = fixed.groupBy("_cx", "_cy").count().agg(F.max("count")).first()[0]
    assert worst >= 36000


def test_the_tree_is_broadcast_only_below_its_bound(spark, monkeypatch):
    left = crowd(spark, 3000, 300)
    right = spark.createDataFrame([(0, 210000.0, 210000.0, 215000.0, 215000.0)], RSCHEMA)
    small = loadtree.tree_join(left, right, LEFT, RIGHT, max_load=10).select("event_id").collect()
    monkeypatch.setattr(loadtree, "MAX_BROADCAST_NODES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = loadtree.tree_join(left, right, LEFT, RIGHT, max_load=10).select("event_id")
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(joined.collect()) == sorted(small) and len(small) > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


VALUED = RSCHEMA + ", v long"


@pytest.mark.parametrize("max_load,right_max,frontier", [(1, 10**6, 1 << 14), (50, 7, 5), (10**6, 40, 300)])
def test_totals_are_those_of_the_pairs(spark, monkeypatch, max_load, right_max, frontier):
    monkeypatch.setattr(loadtree, "MAX_RIGHT", right_max)
    monkeypatch.setattr(loadtree, "FRONTIER", frontier)
    rng = random.Random(max_load)
    left = [(i // 2 if i % 9 else None, *rect(rng, 1000.0 if i % 3 else 20.0, [0.0, 1.0, 30.0, 900.0])) for i in range(200)]
    left += [(900, 64.0, 64.0, 64.0, 64.0), (900, 64.0, 64.0, 64.0, 64.0), (901, 5.0, 0.0, 1.0, 1.0), (902, None, 0.0, 1.0, 1.0)]
    right = [(i, *rect(rng, 1000.0, [0.0, 10.0, 200.0, 2500.0]), None if i % 5 == 0 else rng.choice([-1, 1]) * i) for i in range(120)]
    right += [(120, 64.0, 64.0, 128.0, 128.0, 2**63 - 1)] * 30 + [(121, None, 0.0, 1.0, 1.0, 5)]
    want = {}
    for a in left:
        for b in right:
            if None not in (a[1], b[1]) and a[1] <= a[3] and b[3] >= a[1] and b[1] <= a[3] and b[4] >= a[2] and b[2] <= a[4]:
                want.setdefault(a[0], []).append(b[5])
    want = {k: (len(v), min((x for x in v if x is not None), default=None), max((x for x in v if x is not None), default=None))
            for k, v in want.items()}
    got = loadtree.tree_join(spark.createDataFrame(left, LSCHEMA), spark.createDataFrame(right, VALUED), LEFT, RIGHT,
                             max_load=max_load, totals=("event_id", "v"))
    assert got.columns == ["event_id", "count", "min", "max"]
    assert {r.event_id: tuple(r)[1:] for r in got.collect()} == want and None in want and len(want) > 50
    none = spark.createDataFrame([], VALUED)
    assert loadtree.tree_join(spark.createDataFrame(left, LSCHEMA), none, LEFT, RIGHT, totals=("event_id", "v")).count() == 0


def test_totals_visit_far_fewer_boxes_than_there_are_pairs(monkeypatch):
    x, y = (a.ravel() * 10.0 for a in np.meshgrid(np.arange(200), np.arange(200)))
    levels = loadtree.box_tree(np.column_stack([x, y, x + 5, y + 5]), np.arange(40000), np.ones(40000, dtype=bool))
    visits = []
    bounds = [level[0].view(Counted) for level in levels]
    for b in bounds:
        b.visits = visits
    left = np.array([[500.0, 500.0, 1500.0, 1500.0]] * 20)
    n, low, high = loadtree.box_totals([(b, *level[1:]) for b, level in zip(bounds, levels)], left)
    assert set(n) == {101 * 101} and set(low) == {50 * 200 + 50} and set(high) == {150 * 200 + 150}
    assert sum(visits) < n.sum() / 5


class Counted(np.ndarray):
    def __getitem__(self, key):
        if isinstance(key, np.ndarray):
            self.visits.append(len(key))
        return np.asarray(self)[key]
