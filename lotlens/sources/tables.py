"""Materialised tables: create-table-as-select, skip when present.

A table is written once as parquet under the shared folder named by
``spark.checkpoint.dir`` and read back; the write cuts the lineage, so a lost
executor never forces the upstream joins to run again.  The folder name
carries a hash of this package's sources, so a code change never reads a
table written by older code.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from lotlens.session import table_path


def _code_version() -> str:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1()
    for dirpath, _, files in sorted(os.walk(root)):
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(dirpath, f), "rb") as fh:
                    h.update(fh.read())
    return h.hexdigest()[:12]


CODE_VERSION = _code_version()


def _jvm_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """True when a completed write (``_SUCCESS`` marker) is at ``path``."""
    p, fs = _jvm_path(spark, os.path.join(path, "_SUCCESS"))
    return fs.exists(p)


def fingerprint(spark: SparkSession, folder: str) -> str:
    """Digest of the names, sizes and times of the files below an input folder;
    empty for a key that is no folder. A changed input gets a new table."""
    if "/" not in folder:
        return ""
    p, fs = _jvm_path(spark, folder)
    if not fs.exists(p):
        return ""
    h, it = hashlib.sha1(), fs.listFiles(p, True)
    found = []
    while it.hasNext():
        f = it.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    for line in sorted(found):
        h.update(line.encode())
    return h.hexdigest()[:12]


def key_for(*parts: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", "-".join(parts)).strip("_")


def materialize(df_factory, spark: SparkSession, name: str, *key_parts: str,
                sort_within: str | None = None, partition_by: str | None = None) -> DataFrame:
    """Write ``df_factory()`` once under the shared folder; return the table.

    ``sort_within`` orders rows inside each output file so parquet min/max
    statistics prune on that column; no extra shuffle is added.
    """
    path = table_path(spark, key_for(name, CODE_VERSION, *key_parts, *(fingerprint(spark, p) for p in key_parts)))
    if not exists(spark, path):
        df = df_factory()
        if sort_within:
            df = df.sortWithinPartitions(sort_within)
        # write aside, then publish with one rename: a concurrent or failed
        # writer never leaves a half-written table under the final name
        staging = f"{path}.staging-{uuid.uuid4().hex}"
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(partition_by)
        w.parquet(staging)
        publish(spark, staging, path)
    return spark.read.parquet(path)


def publish(spark: SparkSession, staging: str, path: str) -> None:
    """Moves a finished table to its name. A target without its marker is what a
    failed writer left and is replaced; a finished one (of a concurrent writer)
    stays. Raises if afterwards no finished table is there."""
    src, fs = _jvm_path(spark, staging)
    dst, _ = _jvm_path(spark, path)
    if not exists(spark, path):
        if fs.exists(dst):
            fs.delete(dst, True)
        fs.rename(src, dst)
    if not exists(spark, path):
        raise OSError(f"{staging} could not be published as {path}")
    if fs.exists(src):
        fs.delete(src, True)


def remove_partition(spark: SparkSession, path: str, key: str, value: str | None) -> None:
    """Deletes the folder of one partition of a partitioned table (a dynamic overwrite
    replaces the folders that it has rows for and leaves all others)."""
    utils = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    p, fs = _jvm_path(spark, os.path.join(path, utils.getPartitionPathString(key, value)))
    fs.delete(p, True)
