"""SparkSession construction and shared-storage locations."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import zipfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

# Defaults for settings that nobody else has set: what the submitter gave with
# ``spark-submit --conf`` (or the defaults file it read) stays.
_LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "lotlens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = dict(_LOCAL_CONF)
    if master and master.startswith("local"):
        # local mode: the driver JVM is also the executor; 1 GB default is too small
        defaults["spark.driver.memory"] = "8g"
    if shuffle_partitions:
        defaults["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in unset_only(defaults, submitted_conf()).items():
        builder = builder.config(k, v)
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def submitted_conf() -> SparkConf | None:
    """What ``spark-submit`` was given; None in a plain Python process, where no
    JVM runs yet and there is nothing to respect."""
    if "PYSPARK_GATEWAY_PORT" not in os.environ:
        return None
    SparkContext._ensure_initialized()
    return SparkConf()


def unset_only(defaults: dict[str, str], conf: SparkConf | None) -> dict[str, str]:
    """The defaults whose key ``conf`` does not set."""
    return {k: v for k, v in defaults.items() if conf is None or not conf.contains(k)}


_SHIPPED: set[str] = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``lotlens`` importable by the Python workers (like --py-files).

    Pandas/Arrow functions are pickled by reference to their module, so the
    executors need the package; it is zipped once per SparkContext and added
    with ``addPyFile``.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    with _SHIP_LOCK:  # queries may be started from several threads
        if key in _SHIPPED:
            return
        pkg = os.path.dirname(os.path.abspath(__file__))
        out = os.path.join(tempfile.mkdtemp(prefix="lotlens-pyfiles-"), "lotlens.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for dirpath, _, files in os.walk(pkg):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(dirpath, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
        sc.addPyFile(out)
        _SHIPPED.add(key)


_LOCAL_DIRS: dict[str, str] = {}


def require_local(master: str) -> None:
    """Raises unless every task of ``master`` runs in this process."""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir is not set: on {master} it must name a folder that the driver and "
                           "all executors share")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and materialised tables.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names a
    shared folder there).  Only on a local master, where all threads share the
    machine's folders, an unset one is replaced by a scratch folder, once per
    application; on any other master an unset folder is an error.
    """
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    require_local(sc.master)
    app = sc.applicationId
    with _SHIP_LOCK:
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="lotlens-ckpt-")
            sc.setCheckpointDir(_LOCAL_DIRS[app])
    return _LOCAL_DIRS[app]


def table_path(spark: SparkSession, name: str) -> str:
    """Location of a materialised table under the shared checkpoint folder."""
    # an optional namespace isolates runs that must not reuse earlier tables (bench)
    ns = spark.conf.get("spark.lotlens.namespace", "") or ""
    return os.path.join(checkpoint_dir(spark), "tables", ns, name) if ns else \
        os.path.join(checkpoint_dir(spark), "tables", name)
