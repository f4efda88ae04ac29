"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.session import checkpoint_dir

_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared folder that the session names."""
    return os.path.join(checkpoint_dir(spark), "llm", f"{tag}-{uuid.uuid4().hex}")


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs inside drops its shuffle files when it ends, not only when the driver
    happens to collect its garbage. (A no-op where the setting is unknown.)"""
    before = spark.conf.get(_DROP, None)
    spark.conf.set(_DROP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_DROP) if before is None else spark.conf.set(_DROP, before)


def written(df: DataFrame, tag: str, rows: int | None = None, rows_per_file: int = 250_000,
            drop_shuffles: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, so a
    lost executor re-reads files instead of recomputing what led to them.

    Where a bound on its ``rows`` is known and they fit in fewer files than a
    shuffle has partitions, they are dealt out to that many, so that small
    tables don't become hundreds of small files. (``coalesce`` would run the
    sorts and joins below in those few tasks, with all their memory.) With
    ``drop_shuffles`` the shuffle files of this step go when it is written.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    files = None if rows is None else max(1, -(-rows // rows_per_file))
    if files is not None and files < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.repartition(files)
    with _shuffles_dropped(spark) if drop_shuffles else contextlib.nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_step(df: DataFrame, tag: str) -> DataFrame:
    """``written``, with the step's shuffle files dropped."""
    return written(df, tag, drop_shuffles=True)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` also maps letters beyond ASCII)."""
    return F.translate(c, UPPER, UPPER.lower())


def repeat_rows(df: DataFrame, count: str, nth: str, block: int = 1 << 16) -> DataFrame:
    """Each row ``count`` times, numbered from 1 in ``nth``; arrays stay below ``block``."""
    n, start = F.col(count), F.col("_block") * block
    df = df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / block))))
    return df.withColumn(nth, F.explode(F.sequence(start + 1, F.least(start + block, n)))).drop("_block")


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def with_text_key(df: DataFrame, text: str = "text", key: str = "_text_key") -> DataFrame:
    return df.withColumn(key, text_key(F.col(text)))


def packed(columns: Sequence[str]) -> Column:
    """A caller's row in one column, so that no helper column meets a column of its name."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in columns)).alias("_row")


def unpacked(columns: Sequence[str]) -> list[Column]:
    return [F.col("_row").getField(c).alias(c) for c in columns]


def keep_rows(docs: DataFrame, winners: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` named by ``winners`` (id, _text_key); one row per winner.

    Null-safe in the id. Rows repeated with the same id and text stay once
    (the smallest of their other columns, whatever those are named).
    """
    others = [c for c in docs.columns if c not in (id_col, text)]
    w = winners.select(F.col(id_col).alias("_wid"), F.col("_text_key").alias("_wkey"))
    d = docs.select(F.col(id_col).alias("_id"), text_key(F.col(text)).alias("_key"), packed([*others, text, id_col]))
    d = d.join(w, d["_id"].eqNullSafe(w["_wid"]) & (d["_key"] == w["_wkey"]), "left_semi")
    return d.groupBy("_id", "_key").agg(F.min("_row").alias("_row")).select(*unpacked(docs.columns))
