"""Repeated passages by a relative Lempel-Ziv parse of every document.

The reference is the corpus itself. Its index holds, for each anchor, the
earliest place in the corpus; an anchor is a short word sequence that its
surroundings select (the minimizer of a window), so equal windows have equal
anchors at equal offsets. The texts around the indexed places are cut into
reference blocks of bounded size. A document is parsed against every block that
holds the earliest place of one of its anchors; against any other block no factor
can be as long as a window. In a block the parse is greedy: the next anchor
outside the last factor is extended left and right as far as the words agree.

A factor of a window or more is a duplicate span. A window that crosses a factor's
boundary may still start earlier elsewhere, and only among other windows that cross
boundaries: those are hashed and meet in one aggregate, in which the
earliest stays. So no window is compared with all its equals, however many there are.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lotlens.llm.common import scratch_step

GRAM = 6
#: Texts are hashed this many bytes at a time.
_BYTES = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = re.compile(rb"[ \t-\r]")


@functools.cache
def _tables() -> tuple[np.ndarray, ...]:
    """Separators, a random number for each byte, the multiplier's powers and their inverses."""
    separator = np.zeros(256, bool)
    separator[[0x20, *range(9, 14)]] = True
    of_byte = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)
    powers, inverses = (np.full(_BYTES + 1, m, np.uint64) for m in (_MULTIPLIER, pow(int(_MULTIPLIER), -1, 1 << 64)))
    powers[0] = inverses[0] = 1
    return separator, of_byte, np.multiply.accumulate(powers), np.multiply.accumulate(inverses)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _hash_piece(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of at most ``_BYTES`` bytes: differences of one
    running sum over all bytes; words of over 64 bytes are hashed one by one."""
    separator, of_byte, powers, inverses = _tables()
    raw = np.frombuffer(body, np.uint8)
    edges = np.flatnonzero(np.diff(~separator[raw], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(of_byte[raw] * powers[:len(raw)], out=total[1:])
    h = _mixed((total[ends] - total[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > 64):
        h[i] = xxhash.xxh3_64_intdigest(body[starts[i]:ends[i]])
    return starts, h


def hash_texts(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, number of words of each text)."""
    joined = b" ".join(bodies)
    begins = np.cumsum([0, *(len(x) + 1 for x in bodies[:-1])])
    starts, hashes, at = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while at < len(joined):
        stop = len(joined)
        if stop - at > _BYTES:  # up to the last separator that fits, or past a word that doesn't
            last = max(joined.rfind(c, at + 1, at + _BYTES) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
            if last < 0:
                found = _SEPARATOR.search(joined, at + 1)
                last = found.start() if found else stop
            stop = last
        if stop - at > _BYTES:  # one word
            word = joined[at:stop].lstrip(b" \t\n\r\v\f")
            place, h = np.array([stop - at - len(word)]), np.array([xxhash.xxh3_64_intdigest(word)], np.uint64)
        else:
            place, h = _hash_piece(joined[at:stop])
        starts.append(place + at)
        hashes.append(h)
        at = stop
    starts = np.concatenate(starts)
    return np.concatenate(hashes), np.diff(np.searchsorted(starts, begins), append=len(starts))


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words."""
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * _MULTIPLIER + h[j:j + n]
    return _mixed(out)


def selected(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``window`` words: the place of its anchor (the first of its
    smallest gram hashes), and that hash. Depends on the window's words only."""
    size = min(GRAM, window)
    width, n = window - size + 1, len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, value = np.empty(n, np.int64), np.empty(n, np.uint64)
    low = np.uint64(0xFFFF)  # of a gram's 64 bits 48 are compared, the rest hold its place
    step = 0x10000 - width
    for start in range(0, n, step):
        stop = min(start + step, n)
        grams = gram_hashes(h[start:stop + window - 1], size)
        least, span = (grams & ~low) | np.arange(len(grams), dtype=np.uint64), 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[:stop - start], least[width - span:][:stop - start])
        place = (least & low).astype(np.int64)
        at[start:stop], value[start:stop] = place + start, grams[place]
    return at, value


def anchors_of(h: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(place, hash, first window, last window) of the anchors of all texts, as places
    in ``h``; no window reaches from one text into the next."""
    at, value = selected(h, window)
    ends = np.repeat(np.cumsum(counts), counts)[:len(at)]
    inside = np.flatnonzero(np.arange(len(at)) + window <= ends)
    at, value = at[inside], value[inside]
    if not len(at):
        return at, value, at, at
    new = np.flatnonzero(np.diff(at, prepend=-1))
    return at[new], value[new], inside[new], inside[np.append(new[1:], len(at)) - 1]


def _runs(bodies: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that are hashed together."""
    start = size = 0
    for i, body in enumerate(bodies):
        if size and size + len(body) >= _BYTES:
            yield start, i
            start, size = i, 0
        size += len(body) + 1
    if bodies:
        yield start, len(bodies)


def _anchor_rows(schema: pa.Schema, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(2).to_pylist()
            for start, stop in _runs(bodies):
                h, counts = hash_texts(bodies[start:stop])
                at, value, _, _ = anchors_of(h, counts, window)
                row = np.repeat(np.arange(stop - start), counts)[at]
                local = at - (np.cumsum(counts) - counts)[row]
                take = pa.array(row + start)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), batch.column(0).take(take),
                                                  batch.column(1).take(take), pa.array(local.astype(np.int32))], schema=schema)
    return run


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _lists(starts: np.ndarray, values: np.ndarray, type_: pa.DataType) -> pa.Array:
    """``values`` cut at ``starts``."""
    return pa.ListArray.from_arrays(np.append(starts, len(values)).astype(np.int32), pa.array(values.astype(np.int32))).cast(type_)


def _structs(parents: np.ndarray, rows: int, columns: list[pa.Array], type_: pa.ListType) -> pa.Array:
    """A list of structs for each of ``rows``; ``parents`` ascend."""
    structs = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, type_.value_type)],
                                         fields=list(type_.value_type))
    return pa.ListArray.from_arrays(np.searchsorted(parents, np.arange(rows + 1)).astype(np.int32), structs).cast(type_)


def _parse_rows(schema: pa.Schema, window: int, block: int):
    """A document and its anchors that others share -> the parts of blocks that it
    offers, and its slices that are parsed elsewhere."""
    ref_type, slice_type = schema.field("refs").type, schema.field("slices").type

    def chunk(batch: pa.RecordBatch, bodies: list[bytes]) -> pa.RecordBatch:
        rows = batch.num_rows
        h, counts = hash_texts(bodies)
        ends = np.cumsum(counts)
        begins = ends - counts
        parent = pc.list_parent_indices(batch.column(3)).to_numpy()
        hit = dict(zip(("pos", "first", "ref_id", "ref_key", "ref_pos"), batch.column(3).flatten().flatten()))
        pos, first, ref_pos = (hit[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "first", "ref_pos"))
        spot = begins[parent] + pos  # rows that repeat id and text bring the same hits more than once
        own = np.flatnonzero(first == 1)
        own = own[np.lexsort((pos[own], parent[own]))]
        own, own_row, chunk_of = pos[own], parent[own], pos[own] // block
        new = np.flatnonzero((np.diff(own_row, prepend=-1) != 0) | (np.diff(chunk_of, prepend=-1) != 0))
        last = np.append(new[1:], len(own))[:len(new)] - 1
        begin, end = np.maximum(own[new] - window, 0), own[last] + window
        own_row = own_row[new]
        refs = [pa.array(chunk_of[new]), pa.array(begin),
                pa.array([h[begins[r] + a:min(begins[r] + b, ends[r])].tobytes() for r, a, b in zip(own_row, begin, end)],
                         pa.binary())]

        other = np.flatnonzero(first == 0)
        other = other[np.unique(spot[other], return_index=True)[1]]
        row, spot, ref_pos = parent[other], spot[other], ref_pos[other]
        places, _, low, high = anchors_of(h, counts, window)
        nth = np.searchsorted(places, spot)
        low, high = low[nth], high[nth]
        key, taken = hit["ref_key"].to_numpy()[other], pa.array(other)
        id_code = hit["ref_id"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)[other]
        new = np.ones(len(other), bool)
        if len(other):
            changed = [x[1:] != x[:-1] for x in (row, key, id_code, ref_pos // block)]
            new[1:] = np.logical_or.reduce([*changed, low[1:] > high[:-1] + window])
        start = np.flatnonzero(new)
        last = np.append(start[1:], len(other))[:len(start)] - 1
        shift = begins[row]
        words = [h[a:b + window].tobytes() for a, b in zip(low[start], high[last])]
        ints = [_lists(start, x, slice_type.value_type.field("low").type) for x in (low - shift, high - shift, spot - shift, ref_pos)]
        first_of = taken.take(pa.array(start))
        slices = [hit["ref_id"].take(first_of), hit["ref_key"].take(first_of), pa.array(ref_pos[start] // block),
                  pa.array((low - shift)[start]), pa.array(words, pa.binary()), *ints]
        return pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1),
            _structs(own_row, rows, refs, ref_type), _structs(row[start], rows, slices, slice_type)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(2).to_pylist()
            for start, stop in _runs(bodies):
                yield chunk(batch.slice(start, stop - start), bodies[start:stop])
    return run


def factors(words: np.ndarray, start: int, ref: np.ndarray, ref_start: int, at: np.ndarray, ref_at: np.ndarray,
            low: np.ndarray, high: np.ndarray, earlier: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """The greedy parse of a slice against a block: (first anchor, end of anchors, begin
    and end in the document) of each factor. A factor holds the anchors that follow it
    with the same offset, and those whose windows ``low`` to ``high`` + a window all lie
    inside, if what it repeats is ``earlier``."""
    shift, i = at - ref_at, 0
    while i < len(at):
        p, q = int(at[i]) - start, int(ref_at[i]) - ref_start
        n = min(len(words) - p, len(ref) - q)
        differ = words[p:p + n] != ref[q:q + n]
        right = int(differ.argmax()) if differ.any() else n
        n = min(p, q)
        differ = words[p - n:p][::-1] != ref[q - n:q][::-1]
        left = int(differ.argmax()) if differ.any() else n
        begin, end = start + p - left, start + p + right
        outside = (shift[i + 1:] != shift[i]) | (at[i + 1:] >= end)
        if earlier[i]:
            outside &= (low[i + 1:] < begin) | (high[i + 1:] > end)
        j = i + 1 + (int(outside.argmax()) if outside.any() else len(outside))
        yield i, j, begin, end
        i = j


def _factor_rows(schema: pa.Schema, window: int):
    def parse(start: int, words: np.ndarray, ref_start: int, ref: np.ndarray, same_doc: bool,
              at: np.ndarray, ref_at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[list, list]:
        spans, checks = [], []
        high = high + window
        earlier = ref_at < at if same_doc else np.ones(len(at), bool)
        for i, j, a, b in factors(words, start, ref, ref_start, at, ref_at, low, high, earlier):
            if b - a >= window and earlier[i]:
                spans.append((a, b))
            crossing = np.flatnonzero((low[i:j] < a) | (high[i:j] > b)) + i
            for k in crossing:  # the anchors' windows that cross the factor's boundary
                for s in range(low[k], high[k] - window + 1):
                    if s < a or s + window > b:
                        digest = xxhash.xxh3_128_digest(words[s - start:s - start + window].tobytes())
                        checks.append((*np.frombuffer(digest, np.int64).tolist(), s))
        return spans, checks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            lists = {n: (col[n].flatten().to_numpy(), np.append(0, np.cumsum(col[n].value_lengths().to_numpy())))
                     for n in ("at", "ref_at", "low", "high")}
            starts, ref_starts, same = (col[n].to_pylist() for n in ("start", "ref_start", "same_doc"))
            found = []
            for r in range(batch.num_rows):
                words, ref = (np.frombuffer(col[n][r].as_buffer(), np.uint64) for n in ("words", "ref_words"))
                found.append(parse(starts[r], words, ref_starts[r], ref, same[r],
                                   *(v[o[r]:o[r + 1]] for v, o in lists.values())))
            out = [col["_id"], col["_key"]]
            for k, width in ((0, 2), (1, 3)):
                rows = [(r, *x) for r, both in enumerate(found) for x in both[k]]
                parents, *values = zip(*rows) if rows else [()] * (width + 1)
                type_ = schema[2 + k].type
                out.append(_structs(np.array(parents, np.int64), batch.num_rows,
                                    [pa.array(v, f.type) for v, f in zip(values, type_.value_type)], type_))
            yield pa.RecordBatch.from_arrays(out, schema=schema)
    return run


def _finish_rows(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                out = {name: [] for name in schema.names}
                for row in batch.slice(start, 64).to_pylist():
                    words, kept, at, spans = row["_body"].split(), [], 0, []
                    for a, b in sorted((s["a"], s["b"]) for s in row["spans"] or ()):
                        if spans and a <= spans[-1]["b"]:
                            spans[-1]["b"] = max(spans[-1]["b"], b)
                        else:
                            spans.append({"a": a, "b": b})
                    for s in spans:
                        kept += words[at:s["a"]]
                        at = s["b"]
                    kept += words[at:]
                    out["_id"].append(row["_id"])
                    out["n_words"].append(len(words))
                    out["n_removed"].append(len(words) - len(kept))
                    out["spans"].append(spans)
                    out["sha"].append(_sha(kept))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
    return run


def _mapped(df: DataFrame, make, schema: T.StructType, *args) -> DataFrame:
    return df.mapInArrow(make(to_arrow_schema(schema), *args), schema)


def _place(id_: str, *rest: str) -> Column:
    """Orders by id, nulls last, then by the rest."""
    return F.struct(F.col(id_).isNull().alias("no"), F.col(id_).alias("id"), *(F.col(c) for c in rest))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 20,
                   block: int = 256) -> DataFrame:
    """One row per document: id, n_words, n_removed, spans (array of word ranges
    [a, b) that repeat an earlier passage), kept_sha256 of the kept words.

    Words are runs of anything but ASCII white space. A word is removed if a
    window of ``window`` words around it also starts at an earlier place: in a row
    of a smaller id, or further up in the same document. Rows of the same id (a null
    id comes last) count as one document for that order, so a row repeated with id and
    text removes nothing from its twin. A null text has no words; texts shorter than
    a window keep all words. An empty table gives an empty result; other columns are
    not read. ``block`` bounds the words of a reference block.

    Grams, words and windows are compared by hashes of 64, 64 and 128 bits.
    """
    id_type = docs.schema[id_col].dataType
    key = T.StructField("_key", T.LongType())
    ident = [T.StructField("_id", id_type), key]
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_key"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_body"))

    hashed = T.StructType([T.StructField("_h", T.LongType()), *ident, T.StructField("_pos", T.IntegerType())])
    if not 2 <= window <= 10_000:
        raise ValueError("window must be 2 to 10,000 words")
    anchors = _mapped(rows, _anchor_rows, hashed, window)
    index = scratch_step(anchors.groupBy("_h").agg(F.min(_place("_id", "_pos", "_key")).alias("ref"), F.count("*").alias("n"))
                    .where("n > 1").select("_h", "ref"), "substring-index")

    first = F.col("_id").eqNullSafe(F.col("ref.id")) & (F.col("_pos") == F.col("ref._pos")) & \
        (F.col("_key") == F.col("ref._key"))
    hits = anchors.join(index, "_h").groupBy("_id", "_key").agg(F.collect_list(F.struct(
        F.col("_pos").alias("pos"), first.alias("first"), F.col("ref.id").alias("ref_id"),
        F.col("ref._key").alias("ref_key"), F.col("ref._pos").alias("ref_pos"))).alias("hits"))
    hits = hits.withColumnsRenamed({"_id": "_hid", "_key": "_hkey"})
    joined = rows.join(hits, rows["_id"].eqNullSafe(hits["_hid"]) & (rows["_key"] == hits["_hkey"]))

    ints, longs = T.ArrayType(T.IntegerType()), T.LongType()
    chunk = [T.StructField("chunk", T.IntegerType()), T.StructField("start", T.IntegerType()),
             T.StructField("words", T.BinaryType())]
    parsed = T.StructType([
        *ident, T.StructField("refs", T.ArrayType(T.StructType(chunk))),
        T.StructField("slices", T.ArrayType(T.StructType([
            T.StructField("ref_id", id_type), T.StructField("ref_key", longs), *chunk,
            *(T.StructField(c, ints) for c in ("low", "high", "at", "ref_at"))])))])
    parsed = scratch_step(_mapped(joined.select("_id", "_key", "_body", "hits"), _parse_rows, parsed, window, block),
                     "substring-slices")

    # rows that repeat id and text offer the same blocks
    refs = (parsed.select(F.col("_id").alias("_rid"), F.col("_key").alias("_rkey"), F.explode("refs").alias("r"))
            .select("_rid", "_rkey", F.col("r.chunk").alias("_chunk"), F.col("r.start").alias("ref_start"),
                    F.col("r.words").alias("ref_words")).dropDuplicates(["_rid", "_rkey", "_chunk"]))
    slices = parsed.select("_id", "_key", F.explode("slices").alias("s")).select("_id", "_key", "s.*")
    pairs = slices.join(refs, slices["ref_id"].eqNullSafe(refs["_rid"]) & (slices["ref_key"] == refs["_rkey"])
                        & (slices["chunk"] == refs["_chunk"]))
    spans = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in "ab"]))
    checks = T.ArrayType(T.StructType([T.StructField("one", longs), T.StructField("two", longs),
                                       T.StructField("at", T.IntegerType())]))
    found = T.StructType([*ident, T.StructField("spans", spans), T.StructField("checks", checks)])
    found = scratch_step(_mapped(pairs.select(
        "_id", "_key", F.col("_id").eqNullSafe(F.col("ref_id")).alias("same_doc"), "start", "words", "low", "high", "at",
        "ref_at", "ref_start", "ref_words"), _factor_rows, found, window), "substring-factors")

    crossing = found.select("_id", "_key", F.explode("checks").alias("c")).select("_id", "_key", "c.*")
    earliest = (crossing.groupBy("one", "two").agg(F.min(_place("_id", "at")).alias("ref"), F.count("*").alias("n"))
                .where("n > 1").select("one", "two", "ref"))
    later = crossing.join(earliest, ["one", "two"]).where(_place("_id", "at") > F.col("ref"))
    all_spans = (found.select("_id", "_key", F.explode("spans").alias("s"))
                 .unionByName(later.select("_id", "_key", F.struct(F.col("at").alias("a"),
                                                                   (F.col("at") + window).alias("b")).alias("s")))
                 .groupBy(F.col("_id").alias("_sid"), F.col("_key").alias("_skey"))
                 .agg(F.collect_set("s").alias("spans")))

    result = T.StructType([T.StructField("_id", id_type), T.StructField("n_words", longs), T.StructField("n_removed", longs),
                           T.StructField("spans", spans), T.StructField("sha", T.StringType())])
    whole = rows.join(all_spans, rows["_id"].eqNullSafe(all_spans["_sid"]) & (rows["_key"] == all_spans["_skey"]), "left")
    return _mapped(whole.select("_id", "_body", "spans"), _finish_rows, result).select(
        F.col("_id").alias(id_col), "n_words", "n_removed", "spans", F.col("sha").alias("kept_sha256"))
