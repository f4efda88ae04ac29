"""Pipe-delimited French sale files (one row per lot) -> lot table L.

* explicit schema by each file's own header line (no inference pass;
  department and postcode stay text),
* ``|`` separator, header, ``dd/MM/yyyy`` dates, decimal commas through the
  ``fr-FR`` locale on decimal fields,
* PERMISSIVE parsing with a corrupt-record column, written once to parquet
  with every column (so the verdict on a row never depends on which columns
  a later query reads), then split into valid rows and rejects,
* the source file of every row from ``_metadata.file_path``.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
HEADER_JOBS = 16

# File header -> canonical column, in file order.
HEADER = (
    ("Date mutation", "date_mutation", T.DateType()),
    ("No disposition", "no_disposition", T.IntegerType()),
    ("Nature mutation", "nature_mutation", T.StringType()),
    ("Valeur fonciere", "valeur_fonciere", T.DecimalType(18, 2)),
    ("Code postal", "code_postal", T.StringType()),
    ("Commune", "commune", T.StringType()),
    ("Code departement", "code_departement", T.StringType()),
    ("Code commune", "code_commune", T.IntegerType()),
    ("Type local", "type_local", T.StringType()),
    ("Surface reelle bati", "surface_reelle_bati", T.DecimalType(18, 2)),
)
LOT_COLUMNS = [c for _, c, _ in HEADER]


def file_schema(with_corrupt: bool = True) -> T.StructType:
    fields = [T.StructField(h, t, True) for h, _, t in HEADER]
    if with_corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType(), True))
    return T.StructType(fields)


def header_schema(header: str, sep: str = "|") -> T.StructType:
    """Schema of the files with this header line: the used columns get their
    types, every other column (the published files carry ~40) is read as text."""
    typed = {h: t for h, _, t in HEADER}
    fields = [T.StructField(n, typed.get(n, T.StringType()), True) for n in header.split(sep)]
    fields.append(T.StructField(CORRUPT, T.StringType(), True))
    return T.StructType(fields)


def first_line(spark: SparkSession, file: str) -> str | None:
    """The file's first line that is not blank: the one task stops reading there, so a
    buffer is read of a file of any length."""
    row = spark.read.text(file).where(F.length(F.trim("value")) > 0).first()
    return row and row["value"]


def file_headers(spark: SparkSession, path: str, sep: str = "|") -> dict[str | None, list[str]]:
    """Header line -> files that have it; None -> files without one.

    A header is a file's first line that is not blank, if it names all used columns,
    in any order; files without any line are left out. Each file's head is a job of
    one task, ``HEADER_JOBS`` at a time (an early end in a Python function does not stop
    Spark from reading the rest, and a limit over all files is none for each).
    """
    files = [unquote(f) for f in spark.read.text(path).inputFiles()]
    with ThreadPoolExecutor(HEADER_JOBS) as pool:
        lines = list(pool.map(lambda f: first_line(spark, f), files))
    out: dict[str | None, list[str]] = {}
    for file, line in zip(files, lines):
        if line is not None:
            named = {h for h, _, _ in HEADER} <= set(line.split(sep))
            out.setdefault(line if named else None, []).append(file)
    return out


def _read_csv(spark: SparkSession, paths: list[str] | str, schema: T.StructType) -> DataFrame:
    raw = (spark.read.schema(schema)
           .option("sep", "|").option("header", True)
           .option("locale", "fr-FR").option("dateFormat", "dd/MM/yyyy")
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
           .csv(paths))
    return raw.select(*[F.col(f"`{h}`").alias(c) for h, c, _ in HEADER], F.col(CORRUPT),
                      F.col("_metadata.file_path").alias("file_path"))


def read_raw(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parse the files (glob allowed) permissively; canonical names + file_path.

    Files are read with the columns of their own header line, whatever its
    order; all lines of a file without a header line are malformed.
    """
    if schema is not None:
        return _read_csv(spark, path, schema)
    out = None
    for header, files in sorted(file_headers(spark, path).items(), key=lambda x: (x[0] is None, x[0] or "")):
        if header is None:
            lines = spark.read.text(files)
            part = lines.select(*[F.lit(None).cast(t).alias(c) for _, c, t in HEADER], F.col("value").alias(CORRUPT),
                                F.col("_metadata.file_path").alias("file_path"))
        else:
            part = _read_csv(spark, files, header_schema(header))
        out = part if out is None else out.unionByName(part)
    if out is None:  # files without any line
        return _read_csv(spark, path, file_schema())
    return out


def ingest(spark: SparkSession, path: str, parquet_path: str,
           schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes every parsed row once, valid and malformed ones in folders of their
    own, and returns (valid lots, rejects)."""
    raw = read_raw(spark, path, schema).withColumn("valid", F.col(CORRUPT).isNull())
    raw.write.mode("overwrite").partitionBy("valid").parquet(parquet_path)
    return stored(spark, parquet_path, True).drop(CORRUPT), stored(spark, parquet_path, False)


def stored(spark: SparkSession, parquet_path: str, valid: bool) -> DataFrame:
    """The valid (malformed) rows of an ingested table; only their folder is read."""
    fields = [T.StructField(c, t) for _, c, t in HEADER] + [T.StructField(CORRUPT, T.StringType()),
                                                            T.StructField("file_path", T.StringType()),
                                                            T.StructField("valid", T.BooleanType())]
    rows = spark.read.schema(T.StructType(fields)).parquet(parquet_path)
    return rows.where(F.col("valid") == valid).drop("valid")


def write_french_csv(lots: DataFrame, path: str, damaged: Column | None = None, backwards: bool = False,
                     mode: str = "overwrite") -> None:
    """Write L in the published text format (used to build fixtures): rows where
    ``damaged`` is true get an unreadable date; ``backwards`` turns the column
    order round and adds a column that is not used."""
    def dec(c: str):
        return F.regexp_replace(F.col(c).cast("string"), r"\.", ",")
    day = F.date_format("date_mutation", "dd/MM/yyyy")
    if damaged is not None:
        day = F.when(damaged, F.concat(day, F.lit("x"))).otherwise(day)
    out = lots.select(
        day.alias("Date mutation"),
        F.col("no_disposition").cast("string").alias("No disposition"),
        F.col("nature_mutation").alias("Nature mutation"),
        dec("valeur_fonciere").alias("Valeur fonciere"),
        F.col("code_postal").alias("Code postal"),
        F.col("commune").alias("Commune"),
        F.col("code_departement").alias("Code departement"),
        F.col("code_commune").cast("string").alias("Code commune"),
        F.col("type_local").alias("Type local"),
        dec("surface_reelle_bati").alias("Surface reelle bati"))
    if backwards:
        out = out.select(F.lit("AB").alias("Section"), *reversed(out.columns))
    out.write.mode(mode).option("sep", "|").option("header", True).csv(path)
