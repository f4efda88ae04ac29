"""Feature folders brought up to date by key, and the pruned read of them."""

import os
import tempfile

from pyspark.sql import functions as F

from lotlens.operators import publish
from lotlens.plans import pipeline

SCHEMA = "dept string, feature string"


def files(path):
    return {(os.path.basename(d), f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def test_only_changed_folders_are_written(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="lotlens-upd-"), "communes")
    rows = [("01", "a"), ("01", "a"), ("2A", "b"), ("75", "c"), ("75", "d"), (None, "e"), ("9/7:1", "f"), ("gone", "g")]

    def update(rows):
        changed = publish.update_features(spark.createDataFrame(rows, SCHEMA), path, "dept")
        read = spark.read.schema(publish.feature_folder("dept")).text(path)
        assert sorted(((r.dept, r.value) for r in read.collect()), key=repr) == sorted(rows, key=repr)
        return {(r["dept"], r.gone) for r in changed.collect()}
    assert update(rows) == {(d, False) for d, _ in rows}
    before = files(path)
    assert update(rows) == set() and files(path) == before
    # one copy less, a line changed, a key gone, a key new, a null key's line added
    rows = [("01", "a"), ("2A", "b"), ("75", "c"), ("75", "dd"), (None, "e"), (None, "ee"), ("9/7:1", "f"), ("95", "h")]
    assert update(rows) == {("01", False), ("75", False), (None, False), ("95", False), ("gone", True)}
    assert {x for x in before if x[0] in ("dept=2A", "dept=9%2F7%3A1")} <= files(path)
    assert not any(d == "dept=gone" for d, _ in files(path))
    assert update([r for r in rows if r[0] is not None]) == {(None, True)}


def test_a_load_prunes_the_folders_of_other_departments(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="lotlens-prune-"), "communes")
    lines = spark.range(200).select(F.format_string("%02d", F.col("id") % 40).alias("dept"), F.col("id").cast("string").alias("feature"))
    publish.update_features(lines, path, "dept")
    loads = spark.createDataFrame([(1, 7, "03"), (2, 8, "03"), (2, 9, "39"), (3, 9, "none"), (4, 9, None)],
                                  "user_id long, event_id long, dept string")
    got = pipeline.features_to_load(spark, path, loads)
    assert sorted((r.event_id, r.feature) for r in got.collect()) == sorted(
        (e, str(i)) for e, d in ((7, 3), (8, 3), (9, 39)) for i in range(d, 200, 40))
    assert "dynamicpruningexpression" in got._jdf.queryExecution().executedPlan().toString()
