"""SimHash near-dedup over pivot distance tables.

Every fingerprint is described by its Hamming distances to 65 reference
fingerprints (pivots): zero, and for each of eight 8-bit blocks the eight Walsh
patterns in that block. Two fingerprints at most ``d`` bits apart differ by at
most ``d`` in every coordinate of this table, and by nothing inside the blocks
where all their bits agree; the distance inside a block follows from three
coordinates. So any linked pair agrees in the inner coordinates of all blocks
but ``d``: rows are dealt out by those coordinates, once for each choice of
``d`` blocks. In such a group pairs are discarded by their maximum coordinate
difference and the rest verified bit by bit. A group holds distinct
fingerprints that differ in 8*d bits at most, so its size has a bound that does
not depend on the data (65,536 for d = 2).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.llm.common import written
from lotlens.llm.components import components

BLOCKS, WIDTH = 8, 8
_SPACE = b" \t\n\x0b\x0c\r"


def _chunks(data: bytes, size: int) -> Iterator[bytes]:
    """``data`` cut at white space into parts of about ``size`` bytes."""
    start = 0
    while start < len(data):
        end = start + size
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        yield data[start:end]
        start = end


def fingerprint(data: bytes, shingle_words: int = 3, seed: int = 42, chunk: int = 1 << 20) -> int:
    """64-bit SimHash of the word shingles of UTF-8 ``data`` (A-Z lower-cased);
    0 without words. A chunk's worth of words is held at a time."""
    votes, total, words, seen = np.zeros(64, np.int64), 0, [], 0
    parts = list(_chunks(data, chunk)) if len(data) > chunk else [data]
    for last, part in ((part is parts[-1], part) for part in parts):
        new = part.lower().split()
        seen += len(new)
        words += new
        k = shingle_words if not last or seen >= shingle_words else seen
        if not words or len(words) < k:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - k + 1)
        for at in range(0, len(hashes), 1 << 15):
            bits = np.unpackbits(hashes[at:at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8),
                                 axis=1, bitorder="little")
            votes += bits.sum(axis=0, dtype=np.int32)
        total += len(hashes)
        words = words[len(words) - k + 1:]
    set_bits = np.flatnonzero(2 * votes > total)
    return sum(1 << int(b) for b in set_bits)


def fingerprints(text: Column, shingle_words: int = 3) -> Column:
    """Fingerprint of a text column as a signed long (null counts as empty)."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = np.empty(len(texts), np.uint64)
            for i, text in enumerate(texts):
                out[i] = fingerprint(text.as_py(), shingle_words)
            yield pa.array(out.view(np.int64))
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "long")(F.coalesce(text, F.lit("")).cast("binary"))


def _walsh() -> list[int]:
    """The eight Walsh patterns of eight bits; the first has all bits set."""
    return [sum((1 - (row & col).bit_count() % 2) << col for col in range(WIDTH)) for row in range(WIDTH)]


def references() -> np.ndarray:
    """The pivots: zero, then block by block the Walsh patterns in that block."""
    return np.array([0] + [q << (WIDTH * b) for b in range(BLOCKS) for q in _walsh()], np.uint64)


def distances(fps: np.ndarray) -> np.ndarray:
    """The pivot table: a row of Hamming distances for each fingerprint."""
    return np.bitwise_count(fps[:, None] ^ references()[None, :]).astype(np.int8)


def inner_coordinates(table: np.ndarray) -> np.ndarray:
    """Distances inside each block to its patterns, from the pivot table alone."""
    whole = table[:, 0].astype(np.int64)[:, None]
    by_block = table[:, 1:].astype(np.int64).reshape(-1, BLOCKS, WIDTH)
    in_block = (whole + WIDTH - by_block[:, :, 0]) // 2  # set bits of the block
    return by_block - (whole - in_block)[:, :, None]


def _deal(max_bits: int):
    """Each fingerprint once for every choice of the blocks that may differ."""
    left_out = list(combinations(range(BLOCKS), max_bits))
    radix = (WIDTH + 1) ** np.arange(WIDTH, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            names = (inner_coordinates(distances(fps)) @ radix).astype(np.uint64)  # one number per block
            keys = np.empty((len(left_out), len(fps)), np.uint64)
            for t, free in enumerate(left_out):
                key = np.full(len(fps), t, np.uint64)
                for b in set(range(BLOCKS)) - set(free):
                    key = (key ^ names[:, b]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                keys[t] = (key << np.uint64(8)) | np.uint64(t)  # equal coordinates, equal key
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(fps, len(left_out)).view(np.int64))],
                names=["key", "fp"])
    return run


def _verified(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs survive the coordinate test and then the comparison of bits."""
    near = np.flatnonzero(np.abs(table[i, 0] - table[j, 0]) <= max_bits)
    near = near[np.abs(table[i[near]] - table[j[near]]).max(axis=1, initial=0) <= max_bits]
    return near[np.bitwise_count(fps[i[near]] ^ fps[j[near]]) <= max_bits]


def _first_table(diff: np.ndarray, max_bits: int) -> np.ndarray:
    """The first choice of blocks that covers all blocks set in ``diff``."""
    out = np.full(len(diff), 255, np.uint8)
    for t, free in reversed(list(enumerate(combinations(range(BLOCKS), max_bits)))):
        mask = np.uint64(sum(0xFF << (WIDTH * b) for b in free))
        out[(diff & ~mask) == 0] = t
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges as stars to the smallest member of each component they form."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    member = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[member], nodes[label[member]]


def _link(max_bits: int, block: int = 1 << 17):
    """Pairs of equal key (rows come sorted by key) within ``max_bits`` bits."""
    def pairs(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows = np.flatnonzero(keys[1:] == keys[:-1])  # groups of one are left out
        rows = np.union1d(rows, rows + 1)
        keys, fps = keys[rows], fps[rows]
        table = distances(fps)
        i, step = np.arange(len(keys)), 0
        while len(i):
            step += 1
            i = i[i + step < len(keys)]
            i = i[keys[i] == keys[i + step]]
            for at in range(0, len(i), block):
                x = i[at:at + block]
                x = x[_verified(fps, table, x, x + step, max_bits)]
                # a pair may meet in several groups; it counts in the first of them
                x = x[_first_table(fps[x] ^ fps[x + step], max_bits) == (keys[x] & 0xFF).astype(np.uint8)]
                if len(x):
                    yield fps[x], fps[x + step]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k = held_f = np.empty(0, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            a, b = _forest(*(np.concatenate(x).view(np.int64) for x in zip(*found)))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

        for batch in batches:
            k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False)])
            cut = int(np.searchsorted(k, k[-1], "left")) if len(k) else 0
            found.extend(pairs(k[:cut], f[:cut].view(np.uint64)))
            held_k, held_f = k[cut:], f[cut:]
            if sum(len(a) for a, _ in found) > 1 << 20:
                yield out()
        found.extend(pairs(held_k, held_f.view(np.uint64)))
        if found:
            yield out()
    return run


def links(fps: DataFrame, fp: str = "fp", max_bits: int = 2) -> DataFrame:
    """Edges (u, v) over the distinct fingerprints that connect exactly those
    with a chain of links of at most ``max_bits`` bits."""
    if not 0 < max_bits < 4:
        raise ValueError("max_bits is 1 to 3")
    distinct = fps.select(F.col(fp).alias("fp")).distinct()
    dealt = distinct.mapInArrow(_deal(max_bits), "key long, fp long")
    return (dealt.repartition("key").sortWithinPartitions("key")
            .mapInArrow(_link(max_bits), "u long, v long"))


def simhash_components(rows: DataFrame, id_col: str, fp: str = "fp", max_bits: int = 2) -> DataFrame:
    """``rows`` (a written table) with component_fp (smallest fingerprint) and component_id
    (smallest non-null id) of each row's component."""
    dealt = rows.count() * math.comb(BLOCKS, max_bits)  # rows that the linking tasks read, at most
    stars = components(written(links(rows, fp, max_bits), "simhash-links", rows=dealt))
    reps = rows.groupBy(F.col(fp).alias("_fp")).agg(F.min(id_col).alias("_low"))
    reps = (reps.join(stars, reps["_fp"] == stars["node"], "left")
            .select("_fp", "_low", F.coalesce("root", "_fp").alias("component_fp")))
    low = reps.groupBy(F.col("component_fp").alias("_root")).agg(F.min("_low").alias("component_id"))
    by_fp = reps.join(low, reps["component_fp"] == low["_root"]).select("_fp", "component_fp", "component_id")
    return rows.join(by_fp, rows[fp] == by_fp["_fp"]).drop("_fp")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle_words: int = 3,
                  max_bits: int = 2) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id, component_fp.

    Fingerprints at most ``max_bits`` apart are linked; component_id is the
    smallest id reachable. Texts without words (null, empty, white space) have
    fingerprint zero and are linked like any other; a text of fewer than
    ``shingle_words`` words is one shingle. Repeated rows stay; null ids are
    not candidates for component_id, which is null where a component has none.
    An empty table gives an empty result; other columns are not read.
    """
    rows = written(docs.select(F.col(id_col).alias("_id"), fingerprints(F.col(text), shingle_words).alias("fp")),
                   "simhash-fingerprints")
    out = simhash_components(rows, "_id", "fp", max_bits)
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      "component_id", F.lower(F.lpad(F.hex("component_fp"), 16, "0")).alias("component_fp"))
