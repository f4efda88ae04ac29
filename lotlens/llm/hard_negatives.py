"""Hard negatives by rotated one-bit codes.

A vector is rotated by a fixed random rotation; its code is the signs of the result,
and next to the code stand the vector's length and its alignment (the cosine
between the rotated vector and its code). A query is rotated too and its components
are rounded to a few bits; the inner product of a code with the rounded query is
read off popcounts of the query's bit planes. The estimate times length and
alignment is the part of the score along the code. What is left of the vector is
orthogonal to the code and of known length, so by Cauchy-Schwarz it adds no more than
its length times that of the query's part across the code: a certain interval
for each score. Only rows whose interval can reach the result are scored, in integers.

Queries (anchors) and rows are packed into blocks of bounded size; every pair of a
query block and a row block is a task's row, and what it returns is a few rows for each
anchor. The best over all blocks are chosen by windows over those.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lotlens.llm.common import scratch_step

SCALE = 256
PLANES = 5
#: Squared lengths up to this keep 100 times a score within 64 bits.
LONGEST = 1 << 56
#: Bounds a block of long vectors to 4 MB.
_MOST_COMPONENTS = 1 << 19


@functools.lru_cache(maxsize=4)
def rotation(dim: int, seed: int = 13) -> np.ndarray:
    """A random rotation, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _bits(on: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(on, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, lengths, alignments) of integer vectors."""
    dim = vectors.shape[1]
    turned = vectors @ rotation(dim)
    length = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    along = np.abs(turned).sum(axis=1) / math.sqrt(dim) if dim else np.zeros(len(vectors))
    return _bits(turned >= 0), length, np.minimum(along / np.where(length > 0, length, 1), 1.0)


def intervals(query: np.ndarray, codes: np.ndarray, length: np.ndarray, alignment: np.ndarray,
              planes: int = PLANES) -> tuple[np.ndarray, np.ndarray]:
    """Bounds that hold every score of ``query`` with the coded vectors."""
    dim = len(query)
    turned = query @ rotation(dim)
    low, high = float(turned.min()), float(turned.max())
    step = (high - low) / ((1 << planes) - 1) or 1.0
    levels = np.rint((turned - low) / step).astype(np.int64)
    rounded = low + step * levels
    lost = math.sqrt(((turned - rounded) ** 2).sum())
    total = np.zeros(len(codes), np.int64)  # of the levels where the code's bit is set
    for j in range(planes):
        plane = _bits((levels >> j & 1).astype(bool)[None, :])
        total += np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) << j
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    # code = (2 bit - 1) / sqrt(dim)
    along = (2 * (step * total + low * ones) - rounded.sum()) / math.sqrt(dim)
    size = math.sqrt(float((query.astype(float) ** 2).sum()))
    least = np.maximum(np.abs(along) - lost, 0)
    across = np.sqrt(np.maximum(size * size - least * least, 0))
    middle = length * alignment * along
    # the last term covers the rounding of these floating-point numbers
    reach = length * (alignment * lost + np.sqrt(np.maximum(1 - alignment ** 2, 0)) * across) \
        + 1e-9 * length * size * (dim + 1) + 1e-6
    return middle - reach, middle + reach


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value, or minus infinity where there are fewer."""
    return -math.inf if len(values) < k else float(np.partition(values, len(values) - k)[len(values) - k])


def _best(scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, unnamed, -scores))[:k]


class Block:
    """A packed row block."""

    def __init__(self, dim: int, ids: bytes, unnamed: bytes, labels: bytes, vectors: bytes, codes: bytes, length: bytes,
                 alignment: bytes, rows: bytes) -> None:
        self.ids, self.labels, self.rows = (np.frombuffer(x, np.int64) for x in (ids, labels, rows))
        self.unnamed = np.frombuffer(unnamed, bool)
        n = len(self.ids)
        self.vectors = np.frombuffer(vectors, np.int64).reshape(n, dim)
        self.codes = np.frombuffer(codes, np.uint64).reshape(n, -1) if dim else np.zeros((n, 0), np.uint64)
        self.length, self.alignment = (np.frombuffer(x, float) for x in (length, alignment))

    def id_of(self, i: int) -> int | None:
        return None if self.unnamed[i] else int(self.ids[i])

    def bounds(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(query):
            return np.zeros(len(self.ids)), np.zeros(len(self.ids))
        return intervals(query, self.codes, self.length, self.alignment)


def nearest(block: Block, query: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(score, id, row) of the block's first k allowed rows."""
    low, high = block.bounds(query)
    at = np.flatnonzero(allowed & (high >= _kth(low[allowed], k)))
    scores = block.vectors[at] @ query
    for i in _best(scores, block.ids[at], block.unnamed[at], k):
        yield int(scores[i]), block.id_of(at[i]), int(block.rows[at[i]])


def in_band(block: Block, query: np.ndarray, allowed: np.ndarray, least: int, most: int, k: int,
            bounds: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int]]:
    """(score, id) of the block's first k allowed rows whose score is in [least, most]."""
    low, high = bounds
    certain = allowed & (low >= least) & (high <= most)
    at = np.flatnonzero(allowed & (high >= max(least, _kth(low[certain], k))) & (low <= most))
    scores = block.vectors[at] @ query
    keep = np.flatnonzero((scores >= least) & (scores <= most))
    for i in keep[_best(scores[keep], block.ids[at[keep]], block.unnamed[at[keep]], k)]:
        yield int(scores[i]), block.id_of(at[i])


_PACKED = ("ids", "unnamed", "labels", "vectors", "codes", "length", "alignment", "rows")


def _pack_rows(schema: pa.Schema, size: int):
    """Rows sorted by (dimension, part) -> blocks of at most ``size`` rows of one of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(held: list[tuple]) -> pa.RecordBatch:
            rows, ids, labels, vectors, _ = zip(*held)
            vectors = np.array(vectors, np.int64).reshape(len(held), -1)
            unnamed = np.array([i is None for i in ids])
            packed = (np.array([i or 0 for i in ids], np.int64), unnamed, np.array(labels, np.int64), vectors,
                      *encode(vectors), np.array(rows, np.int64))
            cols = [[vectors.shape[1]], [held[0][4]], *([x.tobytes()] for x in packed)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        held = []
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                for row in zip(*(c.to_pylist() for c in batch.slice(start, 1024).columns)):
                    full = len(held) == size or len(held) * len(row[3]) >= _MOST_COMPONENTS
                    if held and (full or (len(row[3]), row[4]) != (len(held[0][3]), held[0][4])):
                        yield pack(held)
                        held = []
                    held.append(row)
        if held:
            yield pack(held)
    return run


def _block_of(row: dict, prefix: str) -> Block:
    return Block(row["dim"], *(row[prefix + c] for c in _PACKED))


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _positive_rows(schema: pa.Schema, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                anchors, block, out = _block_of(row, "q_"), _block_of(row, ""), []
                for i, query in enumerate(anchors.vectors):
                    allowed = (block.labels == anchors.labels[i]) & (block.rows != anchors.rows[i])
                    out += [(int(anchors.rows[i]), anchors.id_of(i), *x) for x in nearest(block, query, allowed, k)]
                yield _emit(out, schema)
    return run


def _negative_rows(schema: pa.Schema, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                anchors, block, out = _block_of(row, "q_"), _block_of(row, ""), []
                for i, query in enumerate(anchors.vectors):
                    allowed, bounds = block.labels != anchors.labels[i], block.bounds(query)
                    for p in row["positives"][i]:
                        score = p["score"]
                        for negative, id_ in in_band(block, query, allowed, -(-30 * score // 100), 90 * score // 100, k, bounds):
                            out.append((int(anchors.rows[i]), anchors.id_of(i), p["row"], p["id"], id_, score, negative))
                yield _emit(out, schema)
    return run


def _mapped(df: DataFrame, make, schema: T.StructType, *args) -> DataFrame:
    return df.mapInArrow(make(to_arrow_schema(schema), *args), schema)


def integer_rows(rows: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(row, id, label, vector) of the rows that take part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float(1 << 24), F.lit(False)))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE))
    out = rows.where(F.col(label).isNotNull() & v.isNotNull()).where(finite).select(
        F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("vector"))
    short = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x) < float(LONGEST)
    return out.where(short)


def _grid(queries: DataFrame, query_parts: int, blocks: DataFrame, parts: int) -> DataFrame:
    """Every query block beside every row block of its dimension: a query block is copied to
    the numbers of the row blocks, a row block to those of the query blocks, so that
    pairs meet by an equal key and spread over all tasks."""
    left = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = (blocks.withColumnRenamed("part", "block")
             .withColumn("query", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1)))))
    return left.withColumnRenamed("part", "query").join(right, ["dim", "query", "block"]).drop("query", "block")


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector: str = "embedding",
                   label: str = "label", positives: int = 5, negatives: int = 10, query_block: int = 128,
                   row_block: int = 8192) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null label, a null vector, or a null or non-finite component take no part
    (nor do vectors so long that 100 times a score could pass 64 bits: components of
    2^24 or, in whole numbers, a length of 2^28 and more). Components become floor(256 x), scores are
    integer inner products of rows of equal dimension; higher scores come first, then
    smaller ids. ``is_anchor`` is a condition on ``id``. The positives of an
    anchor row are its first other rows of the same label; for each the first
    rows of another label with 30 p <= 100 n <= 90 p are returned. Rows that repeat
    an id are rows of their own: each is its twin's neighbour, and each is an
    anchor. A negative score of the positive admits nothing. An empty table gives
    an empty result; other columns are not read.
    """
    longs, binary = T.LongType(), T.BinaryType()
    whole = integer_rows(rows, id_col, vector, label).withColumn("row", F.monotonically_increasing_id())
    whole = scratch_step(whole.select("row", "id", "label", "vector"), "negatives-rows")
    anchors = scratch_step(whole.where(is_anchor), "negatives-anchors")
    packed = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("part", T.IntegerType()),
                           *(T.StructField(c, binary) for c in _PACKED)])

    def blocks(df: DataFrame, size: int, tag: str) -> tuple[DataFrame, int]:
        """Rows dealt out by a hash to so many parts that one fills a block, and their number."""
        parts = max(1, -(-df.count() // size))
        dealt = df.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
        dealt = dealt.repartition(F.size("vector"), "part").sortWithinPartitions(F.size("vector"), "part")
        return scratch_step(_mapped(dealt, _pack_rows, packed, size), tag), parts

    blocked, parts = blocks(whole, row_block, "negatives-blocks")
    queries, query_parts = blocks(anchors, query_block, "negatives-queries")
    queries = scratch_step(queries.withColumn("name", F.monotonically_increasing_id()), "negatives-named")
    renamed = queries.select("dim", "part", "name", *(F.col(c).alias("q_" + c) for c in _PACKED))

    found = T.StructType([T.StructField(c, longs) for c in ("a_row", "anchor_id", "score", "id", "row")])
    near = _mapped(_grid(renamed, query_parts, blocked, parts), _positive_rows, found, positives)
    first = Window.partitionBy("a_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    best = scratch_step(near.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= positives), "negatives-positives")

    # each query block with its anchors' positives, in the order of its rows
    given = best.groupBy("a_row").agg(F.collect_list(F.struct("score", "id", "row")).alias("own"))
    places = (_mapped(queries.select("name", "rows"), _place_rows,
                      T.StructType([T.StructField(c, longs) for c in ("name", "at", "a_row")]))
              .join(given, "a_row", "left")
              .groupBy(F.col("name").alias("_name")).agg(F.sort_array(F.collect_list(F.struct(
                  "at", F.coalesce("own", F.array().cast("array<struct<score:bigint,id:bigint,row:bigint>>")).alias("own"))))
                  .alias("places")))
    filled = (renamed.join(places, renamed["name"] == places["_name"])
              .withColumn("positives", F.col("places.own")).drop("places", "_name"))
    kept = T.StructType([T.StructField(c, longs) for c in ("a_row", "anchor_id", "p_row", "positive_id", "negative_id",
                                                           "positive_score", "negative_score")])
    hard = _mapped(_grid(filled, query_parts, blocked, parts), _negative_rows, kept, negatives)
    order = Window.partitionBy("a_row", "p_row").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    return (hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def _place_rows(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, rows in zip(*(c.to_pylist() for c in batch.columns)):
                yield _emit([(name, i, r) for i, r in enumerate(np.frombuffer(rows, np.int64).tolist())], schema)
    return run
