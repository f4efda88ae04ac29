"""Training-corpus pipeline: language ID, exact dedup, SimHash near-dedup,
benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of documents. Stages
write nothing that later ones need but their result, which ``run`` writes to the
shared folder and reads again.

Repeated rows, nulls and empty tables are handled as the operators' docstrings
say: a null or letterless text is rejected by language ID; of equal texts, and
of near copies, one row stays; rows with null ids take part in every stage.
Extra columns of any name pass through, but for n_tokens and epoch, which the
mixture sets anew; an extra column domain is the mixture's first level.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lotlens.llm import decontaminate, exact_dedup, language_id, mixing, simhash  # noqa: E402
from lotlens.llm.common import keep_rows, packed, table, text_key, unpacked, with_text_key, written  # noqa: E402
from lotlens.session import ship_package  # noqa: E402

def least_score(model: language_id.Model | None) -> float:
    """A score that is hardly above an even guess between the labels counts as no
    language. (Short texts of real words, a third of them numbers, still score
    above it; a stricter bound would drop clean documents.)"""
    return 1.05 / len(model.labels) if model is not None and len(model.labels) > 1 else 0.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a likely language."""
    ship_package(spark)
    model = language_id.learn(docs)
    found = docs.select(packed(docs.columns), language_id.predicted(docs, "text", model).alias("language"))
    sure = (F.col("language.lang") != language_id.UNKNOWN) & (F.col("language.score") >= least_score(model))
    return found.where(sure).select(*unpacked(docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    ship_package(spark)
    owners = exact_dedup.owners(docs)
    return keep_rows(docs, owners.select(F.col("keep_id").alias("doc_id"), F.col("text_key").alias("_text_key")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the row with the smallest doc_id stays."""
    ship_package(spark)
    rows = with_text_key(docs.select("doc_id", "text", simhash.fingerprints(F.col("text")).alias("fp")))
    rows = written(rows.drop("text"), "pipeline-fingerprints")
    grouped = simhash.simhash_components(rows, "doc_id")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_text_key")
    first = grouped.groupBy("component_fp").agg(F.min(place).alias("first"))
    return keep_rows(docs, first.select("first.doc_id", "first._text_key"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the contamination rule names."""
    ship_package(spark)
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = (found.where(decontaminate.is_contaminated()).select(F.col("doc_id").alias("_bad"), "_text_key")
           .distinct().withColumnRenamed("_text_key", "_bad_key"))
    keyed = docs.select(packed(docs.columns), F.col("doc_id").alias("_id"), text_key(F.col("text")).alias("_key"))
    same = keyed["_id"].eqNullSafe(bad["_bad"]) & (keyed["_key"] == bad["_bad_key"])
    return keyed.join(bad, same, "left_anti").select(*unpacked(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents with domain, n_tokens and epoch."""
    ship_package(spark)
    return mixing.mix(docs)


STAGES = [("language_id", identify_language), ("exact_dedup", drop_copies), ("simhash", drop_near_copies),
          ("decontaminate", drop_contaminated), ("mix", mix_sources)]

#: SQL has no XXH64 fingerprints, tries or trained classifiers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
