"""Benchmark decontamination: prefix-filtered set join of word windows.

A window of a benchmark item is contained in a document only if all of its
shingles are, so its necessary prefix is one shingle: the one that is rarest in
the documents. Only the documents' shingles that equal such a prefix become
candidates; the shingle's position gives the window's place, which must lie
inside the document (length and positional bounds), and the words there are
compared with the whole window. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.llm.common import lower_ascii, repeat_rows, with_text_key, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words: ASCII digits and letters and all signs beyond ASCII."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _shingle(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *(F.get(words, at + j) for j in range(size)))


def windows(benchmark: DataFrame, id_col: str = "item_id", text: str = "text", size: int = 13) -> DataFrame:
    """Distinct windows (words) with the items that hold them, as strings.

    A window is ``size`` consecutive words; an item with fewer words, but not
    none, is one window. A null id counts as the empty string.
    """
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                             words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    each = items.select("item", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0))))
                        .alias("at"))
    return (each.select("item", F.slice("words", F.col("at") + 1, F.lit(size)).alias("window"))
            .groupBy("window").agg(F.collect_set("item").alias("items")))


def _window_shingles(wins: DataFrame, shingle: int) -> DataFrame:
    """Every shingle of each window: hash, size and offset."""
    n = F.size("window")
    each = wins.select("window", "items", F.least(F.lit(shingle), n).alias("k"),
                       F.explode(F.sequence(F.lit(0), n - F.least(F.lit(shingle), n))).alias("offset"))
    h = F.coalesce(*(F.when(F.col("k") == k, _shingle(F.col("window"), F.col("offset"), k))
                     for k in range(1, shingle + 1)))
    return each.withColumn("h", h)


def _doc_shingles(docs: DataFrame, sizes: list[int], *keep: str, header: bool = False) -> DataFrame:
    """Every shingle of each document: its hash and place ``at``; with
    ``header`` also one row per document with ``at`` = -1 and no hash."""
    at, words, n = F.col("at"), F.col("words"), F.col("n_words")
    first = F.lit(-1 if header else 0)
    # a range that is never empty, so that each document keeps its header
    d = docs.select(*keep, "words", "n_words", F.explode(F.sequence(first, F.greatest(n - 1, first))).alias("at"))
    hashes = [F.when((at >= 0) & (at + k <= n), _shingle(words, at, k)) for k in sizes]
    if len(hashes) == 1:
        return d.withColumn("h", hashes[0])
    return d.withColumn("h", F.explode(F.when(at < 0, F.array(F.lit(None).cast("long"))).otherwise(F.array(*hashes))))


def index(docs: DataFrame, wins: DataFrame, shingle: int, block_windows: int) -> tuple[list[DataFrame], list[int]]:
    """(blocks of the index, shingle sizes in use).

    The index has a row per window that can occur at all: its rarest shingle
    with that shingle's offset. A block holds about ``block_windows`` windows,
    which bounds what a join has to hold; documents are joined with one block
    after the other.
    """
    parts = written(_window_shingles(wins, shingle), "window-shingles")
    sizes = sorted(r["k"] for r in parts.select("k").distinct().collect())  # 1 to ``shingle``
    if not sizes:
        return [], []
    n_blocks = max(1, -(-parts.where("offset = 0").count() // block_windows))
    part = F.pmod(F.xxhash64("window"), F.lit(n_blocks))
    counts = None
    for b in range(n_blocks):
        known = F.broadcast(parts.where(part == b).select(F.col("h").alias("known")).distinct())
        found = _doc_shingles(docs, sizes).select("h").join(known, F.col("h") == F.col("known"))
        found = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        counts = found if counts is None else counts.unionByName(found)
    counts = counts.groupBy(F.col("h").alias("_h")).agg(F.max("n").alias("n"))  # a shingle may be in several blocks
    # a window with a shingle that no document has cannot occur: inner rarest, then its count decides
    ranked = parts.join(counts, F.col("h") == F.col("_h"), "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset", "k", "items")).alias("r"))
    rows = written(ranked.where("r.n > 0").select("window", "r.h", "r.offset", "r.items",
                                                  F.size("window").alias("size")), "window-index")
    return [rows.where(part == b) for b in range(n_blocks)], sizes


def _occurrences(docs: DataFrame, block: DataFrame, sizes: list[int], header: bool) -> DataFrame:
    """(_id, _text_key, n_words, start, end, items) of each window in each
    document; with ``header`` also a row per document without a place."""
    idx = F.broadcast(block.select(F.col("h").alias("_h"), "offset", "window", "items", "size"))
    d = _doc_shingles(docs, sizes, "_id", "_text_key", header=header)
    j = d.join(idx, F.col("h") == F.col("_h"), "left" if header else "inner")
    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    same = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.greatest("size", F.lit(0))) == F.col("window")
    hit = F.col("_h").isNotNull() & inside & same
    head = (F.col("at") == -1) if header else F.lit(False)
    return j.where(head | hit).select("_id", "_text_key", "n_words", head.alias("head"),
                                      F.when(~head, start).alias("start"),
                                      F.when(~head, start + F.col("size")).alias("end"),
                                      F.when(~head, F.col("items")).alias("items"))


def _covered(spans: Column) -> Column:
    """Number of positions that the spans cover together."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("upto"))
    return F.aggregate(F.array_sort(spans), zero, lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["upto"]))).alias("n"),
        F.greatest(x["end"], s["upto"]).alias("upto")))["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
                  item_col: str = "item_id", size: int = 13, shingle: int = 5,
                  block_windows: int = 100_000) -> DataFrame:
    """Per row: id, _text_key, n_words, n_hit, items (sorted strings) in it.

    A word is hit if it lies inside any occurrence of a window. A null text has
    no words. Rows repeated with the same id and text each get the same result;
    null ids are ids like any other. Without documents the result is empty;
    without benchmark items nothing is hit. Other columns are not read.
    """
    d = with_text_key(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "_text")
    d = d.withColumn("words", words_of(F.col("_text"))).drop("_text").withColumn("n_words", F.size("words"))
    wins = windows(benchmark, item_col, text, size)
    blocks, sizes = index(d, wins, shingle, block_windows)
    if blocks:
        occ = _occurrences(d, blocks[0], sizes, header=True)
        for block in blocks[1:]:
            occ = occ.unionByName(_occurrences(d, block, sizes, header=False))
    else:
        occ = d.select("_id", "_text_key", "n_words", F.lit(True).alias("head"), F.lit(None).cast("int").alias("start"),
                       F.lit(None).cast("int").alias("end"), F.lit(None).cast("array<string>").alias("items"))
    span = F.when(~F.col("head"), F.struct("start", "end"))
    per = occ.groupBy("_id", "_text_key").agg(
        F.sum(F.col("head").cast("long")).alias("_rows"), F.max("n_words").cast("long").alias("n_words"),
        F.collect_set(span).alias("_spans"), F.collect_set("items").alias("_items"))
    per = per.select("_id", "_text_key", "_rows", "n_words", _covered(F.col("_spans")).alias("n_hit"),
                     F.array_sort(F.array_distinct(F.flatten("_items"))).alias("items"))
    return repeat_rows(per, "_rows", "_nth").select(F.col("_id").alias(id_col), "_text_key", "n_words", "n_hit", "items")


def is_contaminated(share: int = 20) -> Column:
    """The rule: something is hit, and at least one word in ``share``."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
