"""Near-duplicate lines by a segment-partition edit join.

A line is split into threshold + 1 segments. A line within the threshold must
hold one of them as a substring, at a place that is bounded by the two lengths
and the segment's number. Segments and the substrings that can equal them are
hashed together with (length, segment number) and meet in one shuffle of short
rows; pairs are verified by a banded bit-parallel edit distance. Linked lines
form classes; of each class the first occurrence stays. Short lines may differ by
fewer edits, in proportion; equal lines are one class at any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.llm.common import written
from lotlens.llm.components import components

_DIGEST = xxhash.xxh64_intdigest
_PROBE = np.uint64(1 << 32)


def segments(n: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of ``parts`` segments of a line of ``n`` signs; the later
    ones are the longer ones."""
    short, longer = divmod(n, parts)
    out, at = [], 0
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((at, size))
        at += size
    return out


def allowed(n: int, threshold: int, min_chars: int) -> int:
    """Edits between a line of ``n`` signs and one as long or longer: ``threshold``
    from ``min_chars`` signs on, the same share of the signs below."""
    return threshold if n >= min_chars else threshold * n // min_chars


def least_chars(threshold: int, min_chars: int) -> int:
    """The fewest signs with which an edit is allowed."""
    return -(-min_chars // threshold) if threshold else min_chars


def probes(n: int, threshold: int, min_chars: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(indexed length, segment number, start, length) of the substrings of a line
    of ``n`` signs that a line of the indexed length (``n`` or shorter) can share
    as its segment. With k edits allowed there are at most i before segment i and
    at most k - i after it (a segment further left would match otherwise)."""
    for longer in range(threshold + 1):
        k = allowed(n - longer, threshold, min_chars)
        if longer > k:
            continue
        for i, (p, size) in enumerate(segments(n - longer, k + 1)):
            low = max(p - i, p + longer - (k - i), 0)
            high = min(p + i, p + longer + (k - i), n - size)
            for start in range(low, high + 1):
                if longer or start != p:  # the line's own segments are indexed anyway
                    yield n - longer, i, start, size


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most ``k``: Wu-Manber states in a band.

    After j signs of ``b`` bit t of ``row[d]`` says that the first j - k + t signs
    of ``a`` are reached with d edits; only 2k + 1 diagonals are kept.
    """
    if abs(len(a) - len(b)) > k:
        return False
    at = {}
    for p, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << p
    band, m = (1 << 2 * k + 1) - 1, len(a)
    row = [(((1 << d + 1) - 1) << k) & band for d in range(k + 1)]  # j = 0: d signs of a deleted
    for j, c in enumerate(b):
        match = at.get(c, 0)
        match = (match >> j - k if j >= k else match << k - j) & band
        low = max(0, k - 1 - j)  # places before the start or past the end of a do not exist
        inside = band >> low << low
        past = m - (j + 1) + k + 1
        if past <= 2 * k:
            inside &= (1 << max(past, 0)) - 1
        new = [row[0] & match & inside]
        for d in range(1, k + 1):
            new.append(((row[d] & match) | row[d - 1] | (row[d - 1] >> 1) | (new[d - 1] << 1)) & inside)
        row = new
        if not row[k]:
            return False
    return bool(row[k] >> (m - len(b) + k) & 1)


def long_lines(text: str | None, min_chars: int) -> list[tuple[int, str]]:
    """(number from 0, trimmed line) of the lines with at least ``min_chars`` signs."""
    return [(i, s) for i, line in enumerate((text or "").split("\n")) if len(s := line.strip()) >= min_chars]


def _sketches(lines: list[str]) -> np.ndarray:
    """Eight counts of signs modulo 16 per line; an edit changes two by one at most."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    x = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    bucket = (x * np.uint32(0x9E3779B1)) >> np.uint32(29)
    of = np.repeat(np.arange(len(lines)), sizes)
    counts = np.bincount(of * 8 + bucket, minlength=8 * len(lines)).reshape(-1, 8) & 15
    return (counts << (4 * np.arange(8))).sum(axis=1).astype(np.uint64)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By how much two sketches differ, modulo 16 in each count."""
    total = np.zeros(len(a), np.int64)
    for i in range(8):
        s = np.uint64(4 * i)
        d = ((a >> s) - (b >> s)) & np.uint64(15)
        total += np.minimum(d, np.uint64(16) - d).astype(np.int64)
    return total


def _line_id(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def _short_id(line_id: bytes) -> int:
    return int.from_bytes(line_id[:8], "little", signed=True)


def _new_lines(batches: Iterator[pa.RecordBatch], min_chars: int, block: int,
               max_seen: int = 400_000) -> Iterator[list[tuple[bytes, str]]]:
    """Blocks of (id, line); lines that the task has just seen are left out, so
    a line that is everywhere leaves a task about once."""
    seen: set[bytes] = set()
    held: list[tuple[bytes, str]] = []
    for batch in batches:
        for text in batch.column(0):
            for _, line in long_lines(text.as_py(), min_chars):
                name = _line_id(line)
                if name not in seen:
                    seen.add(name)
                    held.append((name, line))
            if len(held) >= block:
                yield held
                held = []
            if len(seen) > max_seen:
                seen.clear()
    if held:
        yield held


def _signatures(threshold: int, min_chars: int):
    """(key, id, mark) of each line's segments and of its probing substrings; the
    mark is the line's sketch, with a bit set for probes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[int, list] = {}
        for block in _new_lines(batches, least_chars(threshold, min_chars), 4000):
            keys: list[int] = []
            kinds: list[int] = []
            rows: list[int] = []
            for name, line in block:
                n = len(line)
                if n not in places:
                    own = [(n, i, p, size) for i, (p, size) in enumerate(segments(n, allowed(n, threshold, min_chars) + 1))]
                    all_ = own + list(probes(n, threshold, min_chars))
                    places[n] = [[(p, p + size, l * (threshold + 1) + i) for l, i, p, size in all_],
                                 [0] * len(own) + [1] * (len(all_) - len(own))]
                where, kind = places[n]
                keys += [_DIGEST(line[a:b].encode("utf-8", "surrogatepass"), seed) for a, b, seed in where]
                kinds += kind
                rows.append(len(kind))
            if len(places) > 5000:
                places.clear()
            sketch = np.repeat(_sketches([line for _, line in block]), rows)
            ids = np.repeat(np.array([_short_id(name) for name, _ in block], np.int64), rows)
            marks = sketch | (np.array(kinds, np.uint64) * _PROBE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(ids), pa.array(marks.view(np.int64))],
                names=["key", "id", "mark"])
    return run


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("block", pa.int64()), ("id", pa.int64()),
                   ("mark", pa.int64())])
_PAIR_SQL = "a long, b long, key long, block long, id long, mark long"


def _linked(ids, mark, i, j, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the index pairs (i, j) those of an index row with an index or probe
    row, whose sketches allow a link; as (smaller id, larger id)."""
    ok = ((mark[i] & mark[j] & _PROBE) == 0) & (ids[i] != ids[j])
    i, j = i[ok], j[ok]
    near = _far(mark[i], mark[j]) <= 2 * threshold
    a, b = ids[i[near]], ids[j[near]]
    return np.minimum(a, b), np.maximum(a, b)


def _pair_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none, none, none], schema=_PAIR)


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
    return [*cols[:-1], cols[-1].view(np.uint64)]


def _candidates(threshold: int, block_rows: int, step_rows: int = 1 << 18):
    """Candidate pairs of one key (rows come sorted by it).

    A task holds ``block_rows`` rows of a key at most: of a larger group it
    compares block by block and hands the blocks' rows on, so that ``_crossed``
    can compare each block with every other one in tasks of their own.
    """
    def pairs(key, ids, mark) -> Iterator[pa.RecordBatch]:
        rows = np.flatnonzero(key[1:] == key[:-1])
        rows = np.union1d(rows, rows + 1)
        key, ids, mark = key[rows], ids[rows], mark[rows]
        i, step = np.arange(len(key)), 0
        while len(i):
            step += 1
            i = i[i + step < len(key)]
            i = i[key[i] == key[i + step]]
            for at in range(0, len(i), step_rows):
                a, b = _linked(ids, mark, i[at:at + step_rows], i[at:at + step_rows] + step, threshold)
                if len(a):
                    yield _pair_rows(a, b)

    def block(number: int, key, ids, mark) -> Iterator[pa.RecordBatch]:
        yield from pairs(key, ids, mark)
        none = pa.nulls(len(key), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(key), pa.array(np.full(len(key), number)), pa.array(ids),
                                          pa.array(mark.view(np.int64))], schema=_PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]
        hot, number = None, 0  # key of a group that is handed on, its next block
        for batch in batches:
            rows = [np.concatenate(x) for x in zip(held, _columns(batch))]
            if hot is not None:
                end = int(np.searchsorted(rows[0], hot, "right"))
                held, rows = [x[:end] for x in rows], [x[end:] for x in rows]
                while len(held[0]) >= block_rows or (len(rows[0]) and len(held[0])):
                    yield from block(number, *(x[:block_rows] for x in held))
                    held, number = [x[block_rows:] for x in held], number + 1
                if not len(rows[0]):
                    continue
                hot, number = None, 0
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left")) if len(rows[0]) else 0
            yield from pairs(*(x[:cut] for x in rows))
            held = [x[cut:] for x in rows]
            while len(held[0]) >= block_rows:
                hot = held[0][0]
                yield from block(number, *(x[:block_rows] for x in held))
                held, number = [x[block_rows:] for x in held], number + 1
        if hot is not None:
            if len(held[0]):
                yield from block(number, *held)
        else:
            yield from pairs(*held)
    return run


def _crossed(threshold: int, step_rows: int = 1 << 18):
    """Candidate pairs between two blocks of one key; rows (key, low, high, block,
    id, mark) come sorted, two blocks of bounded size for each (key, low, high)."""
    def cross(block, ids, mark) -> Iterator[pa.RecordBatch]:
        left = int(np.searchsorted(block, block[0], "right"))
        right = np.arange(left, len(block))
        per = max(1, step_rows // max(1, len(right)))
        for at in range(0, left, per):
            some = np.arange(at, min(at + per, left))
            a, b = _linked(ids, mark, np.repeat(some, len(right)), np.tile(right, len(some)), threshold)
            if len(a):
                yield _pair_rows(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = _columns(batch)
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            new = (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]) | (held[2][1:] != held[2][:-1])
            starts = [0, *(np.flatnonzero(new) + 1).tolist()]
            for s, e in zip(starts, starts[1:]):
                yield from cross(*(x[s:e] for x in held[3:]))
            held = [x[starts[-1]:] for x in held]
        if held is not None and len(held[0]):
            yield from cross(*held[3:])
    return run


def _all_candidates(rows: DataFrame, threshold: int, block_rows: int, n_lines: int | None) -> DataFrame:
    """Distinct candidate pairs (a, b) of the signature rows."""
    first = written(rows.repartition("key").sortWithinPartitions("key")
                    .mapInArrow(_candidates(threshold, block_rows), _PAIR_SQL), "line-candidates", rows=n_lines)
    large = first.where("key is not null").select("key", "block", "id", "mark")
    blocks = large.groupBy(F.col("key").alias("_key")).agg((F.max("block") + 1).alias("n")).where("n > 1")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other")
    meet = large.join(blocks, F.col("key") == F.col("_key")).select("key", "block", "id", "mark", other).where("other <> block")
    meet = meet.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "mark")
    second = (meet.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "block")
              .mapInArrow(_crossed(threshold), _PAIR_SQL))
    return first.where("key is null").unionByName(second).select("a", "b").distinct()


def _bitmap(pairs: DataFrame, bits: int) -> np.ndarray:
    """A bit for each residue of the ids in ``pairs``: 2**bits bits, whatever the input."""
    size = 1 << bits
    slots = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(F.pmod("id", F.lit(size)).alias("slot"))
    words = (slots.groupBy((F.col("slot") / 64).cast("long").alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")))
    out = np.zeros(size // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["w"]] = r["bits"]
    return out.view(np.uint64)


def _texts(texts: DataFrame, pairs: DataFrame, min_chars: int, bits: int) -> DataFrame:
    """(short, line_id, line) of the lines in ``pairs``. A bitmap of fixed size
    keeps most other lines out of the shuffle; the join decides."""
    bitmap = texts.sparkSession.sparkContext.broadcast(_bitmap(pairs, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, size = bitmap.value, 1 << bits
        for block in _new_lines(batches, min_chars, 2000):
            slot = np.array([_short_id(name) % size for name, _ in block], np.int64)
            hit = np.flatnonzero(words[slot // 64] >> (slot % 64).astype(np.uint64) & np.uint64(1))
            if len(hit):
                some = [block[i] for i in hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_short_id(name) for name, _ in some], pa.int64()),
                     pa.array([name for name, _ in some], pa.binary()), pa.array([line for _, line in some])],
                    names=["short", "line_id", "line"])
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("short")).distinct()
    found = texts.mapInArrow(run, "short long, line_id binary, line string").join(wanted, "short", "left_semi")
    return found.groupBy("line_id").agg(F.min("short").alias("short"), F.min("line").alias("line"))


def line_links(texts: DataFrame, threshold: int = 2, min_chars: int = 24, bits: int = 23,
               n_lines: int | None = None, block_rows: int = 20_000) -> DataFrame:
    """(u, v) ids of different lines of ``texts`` (one column) with an edit
    distance of at most ``threshold`` signs (of what ``allowed`` says for the
    shorter line); every such pair once. ``n_lines``:
    a bound on their number, if known, to size the tasks that write;
    ``block_rows``: how many rows of one segment a task holds."""
    if min_chars <= threshold:
        raise ValueError("a line must have more signs than the threshold")
    rows = texts.mapInArrow(_signatures(threshold, min_chars), "key long, id long, mark long")
    pairs = written(_all_candidates(rows, threshold, block_rows, n_lines), "line-pairs", rows=n_lines)
    lines = written(_texts(texts, pairs, least_chars(threshold, min_chars), bits), "line-texts", rows=n_lines)
    left = lines.select(F.col("short").alias("a"), F.col("line_id").alias("u"), F.col("line").alias("_x"))
    right = lines.select(F.col("short").alias("b"), F.col("line_id").alias("v"), F.col("line").alias("_y"))

    def check(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for xs, ys in batches:
            both = [(x.as_py(), y.as_py()) for x, y in zip(xs, ys)]
            yield pa.array([within(x, y, allowed(min(len(x), len(y)), threshold, min_chars)) for x, y in both], pa.bool_())
    check.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    both = pairs.join(left, "a").join(right, "b")
    return both.where(F.arrow_udf(check, "boolean")("_x", "_y")).select("u", "v")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: int = 2,
               min_chars: int = 24) -> DataFrame:
    """Per row: id, n_lines, n_links, n_dropped, dropped (line numbers from 0).

    Lines are cut at line feeds and compared without white space at their ends.
    Equal lines of any length, and lines linked by chains of at most
    ``threshold`` edits, are one class; its first line by (id, row, number)
    stays, the others are dropped (in ascending order). Where the shorter of two
    lines has fewer than ``min_chars`` signs, the same share of its signs may
    differ, rounded down (of 24 and 2: one edit from 12 signs on, none below).
    n_links counts, over the row's lines, the different lines each is linked
    with. Lines of white space alone always stay. A null text has no lines, an empty one has one; null ids come last; repeated rows are
    later occurrences. An empty table gives an empty result; other columns are
    not read.
    """
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [long_lines(t.as_py(), 1) for t in texts]
            yield pa.StructArray.from_arrays(
                [pa.array([[i for i, _ in x] for x in found], pa.list_(pa.int32())),
                 pa.array([[_line_id(s) for _, s in x] for x in found], pa.list_(pa.binary()))], names=["number", "line"])
    cut.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    lines_of = F.arrow_udf(cut, "struct<number: array<int>, line: array<binary>>")

    body = docs.select(F.col(text).alias("_text"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(
        F.octet_length("_text") - F.octet_length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1)
    rows = written(rows.select("_id", "_row", n_lines.cast("long").alias("n_lines"), lines_of("_text").alias("l")), "line-rows")
    each = rows.select("_id", "_row", F.explode(F.arrays_zip("l.number", "l.line")).alias("z")).select(
        F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_row").alias("row"),
                 F.col("z.number").alias("number")).alias("place"), F.col("z.line").alias("line"))

    n = rows.agg(F.coalesce(F.sum(F.size("l.line")), F.lit(0))).first()[0]
    links = written(line_links(body, threshold, min_chars, n_lines=n), "line-links", rows=n)
    stars = components(links)
    degrees = links.select(F.explode(F.array("u", "v")).alias("_end")).groupBy("_end").agg(F.count(F.lit(1)).alias("links"))
    member = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    firsts = each.groupBy("line").agg(F.min("place").alias("own"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.join(member, firsts["line"] == member["node"], "left").where("n > 1 or root is not null")
    firsts = firsts.join(degrees, firsts["line"] == degrees["_end"], "left")
    firsts = written(firsts.select("line", "own", "root", F.coalesce("links", F.lit(0)).alias("links")), "line-firsts", rows=n)
    of_class = firsts.where("root is not null").groupBy(F.col("root").alias("_root")).agg(F.min("own").alias("first"))
    firsts = firsts.join(of_class, F.col("root") == F.col("_root"), "left").select(
        F.col("line").alias("_line"), F.coalesce("first", "own").alias("first"), "links")
    seen = each.join(firsts, F.col("line") == F.col("_line"))
    later = F.when(F.col("place") != F.col("first"), F.col("place.number"))  # collect_list leaves nulls out
    seen = seen.groupBy(F.col("place.row").alias("_at")).agg(
        F.array_sort(F.collect_list(later)).alias("dropped"), F.sum("links").alias("links"))
    out = rows.join(seen, F.col("_row") == F.col("_at"), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return out.select(F.col("_id").alias(id_col), "n_lines", F.coalesce("links", F.lit(0)).alias("n_links"),
                      F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"))


def without_lines(text, dropped):
    """Column: ``text`` without the lines of the given numbers."""
    lines = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(dropped, i))
    return F.array_join(lines, "\n")
