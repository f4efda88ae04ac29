"""Personal data: base patterns and bootstrapped contextual extraction.

Four kinds have fixed base patterns. What they find seeds a graph: the two
words before and the two words after an identifier are lexical patterns, joined
to the identifiers they stand beside. Strings that only look like an identifier
are candidates in the same graph. Spark scores the graph in rounds: a pattern's
confidence is the share of its occurrences in the whole corpus that stand beside
an instance, weighted by the instances' scores; a candidate's score is the
chance that one of its patterns is right. Candidates beside a pattern of high
confidence become spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.llm.common import written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# The base patterns. Possessive runs and the look-behind change no
# match of the plain forms; they keep long runs of digits linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Shapes of candidates: what may be an identifier where its context says so.
_AT = re.compile(r"@|\(at\)|\[at\]")
_NAME = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\(dot\)|\[dot\])[A-Za-z0-9-]+)*")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])")
_COLONS = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:.])")


@dataclass(frozen=True)
class Params:
    rounds: int = 3
    min_support: int = 3  # different instances beside a pattern
    confidence: float = 0.8
    filter_bits: int = 1 << 26  # of the filter of patterns (8 MB), a power of two, at least 64


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _local_start(text: str, at: int, floor: int) -> int:
    while at > floor and text[at - 1] in _LOCAL:
        at -= 1
    return at


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and without overlaps
    within a kind, in order."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = _local_start(text, at, done)
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, EMAIL, domain.end()))
            done = domain.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() < 60 else ""
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), CARD, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), PHONE, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, list[int]]]:
    """(start, end, possible kinds) of other strings with the shape of a kind
    that touch no base span and not one another; ``base`` in order."""
    found = []
    for m in _AT.finditer(text):
        start, name = _local_start(text, m.start(), 0), _NAME.match(text, m.end())
        if start < m.start() and name:
            found.append((start, name.end(), [EMAIL]))
    found += [(m.start(), m.end(), [IP]) for m in _IP.finditer(text)]
    found += [(m.start(), m.end(), [IP]) for m in _COLONS.finditer(text)]
    for m in _NUMBER.finditer(text):
        n = len(_digits(m.group()))
        kinds = [CARD] * (n >= 12) + [PHONE] * (n <= 15)
        if kinds:
            found.append((m.start(), m.end(), kinds))
    out: list[tuple[int, int, list[int]]] = []
    taken: list[list[int]] = []  # the places of base spans, which may overlap one another
    for start, _, end in base:
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    at = 0
    for start, end, kinds in sorted(found):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if (at == len(taken) or end <= taken[at][0]) and (not out or start >= out[-1][1]):
            out.append((start, end, kinds))
    return out


_ODD = re.compile("[\u0130\u03a3\u212a]")


def lower(text: str) -> str:
    """Lower case sign by sign: a slice's is the slice of the whole text's. The dotted I
    (two signs in lower case) and the Kelvin sign (an ASCII letter) stay."""
    if not _ODD.search(text):
        return text.lower()
    return "".join(c if c in "\u0130\u212a" else c.lower() for c in text)


LONG = 64  # signs from which a pattern holds a word's length and hash instead of the word
_PRIME = (1 << 128) - 159  # of the hash: a word as a number of base 2**32, modulo this prime


class Slices:
    """Keys of the slices of a text: the slice, or a longer one's length and hash.

    Slices with one start and ascending ends, or one end and ascending starts,
    take time linear in the text together. (No slice of a word holds a tab.)
    """

    def __init__(self, text: str):
        self.text, self.start, self.at, self.hash = text, 0, 0, 0
        self.word, self.whole = (0, 0), 0

    def _upto(self, start: int, end: int) -> int:
        if start != self.start or end < self.at:
            self.start, self.at, self.hash = start, start, 0
        number = int.from_bytes(self.text[self.at:end].encode("utf-32-be", "surrogatepass"), "big")
        self.hash = (self.hash * pow(2, 32 * (end - self.at), _PRIME) + number) % _PRIME
        self.at = end
        return self.hash

    def head(self, start: int, end: int) -> str:
        """Key of text[start:end]."""
        return self.text[start:end] if end - start <= LONG else f"\t{end - start}:{self._upto(start, end):x}"

    def tail(self, start: int, cut: int, end: int) -> str:
        """Key of text[cut:end], ``start`` being a place at or before the cut that does not change."""
        if end - cut <= LONG:
            return self.text[cut:end]
        if self.word != (start, end):
            self.word, self.whole = (start, end), Slices(self.text)._upto(start, end)
        rest = (self.whole - self._upto(start, cut) * pow(2, 32 * (end - cut), _PRIME)) % _PRIME
        return f"\t{end - cut}:{rest:x}"


_SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text, those of ``str.split``."""
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(signs) + 2, np.bool_)
    inside[1:-1] = ~_SPACE[np.minimum(signs, 0x3001)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def all_contexts(text: str, spans: list[tuple[int, int]]) -> list[list[str]]:
    """The lexical patterns around each span: the two words before and the two words
    after, whole but for the span's edges, in lower case."""
    if not spans:
        return []
    low = lower(text)
    starts, ends = _words(low)
    out: list[list[str]] = [[] for _ in spans]
    near, far = Slices(low), Slices(low)

    def word(w: int) -> str:
        return far.head(int(starts[w]), int(ends[w]))
    order = sorted(range(len(spans)), key=lambda i: spans[i][0])
    for i, j in zip(order, np.searchsorted(starts, [spans[i][0] for i in order], "left").tolist()):
        if j >= 2:
            part = near.head(int(starts[j - 1]), min(int(ends[j - 1]), spans[i][0]))
            out[i].append(f"< {word(j - 2)} {part}")
    order.sort(key=lambda i: spans[i][1])
    near, far = Slices(low), Slices(low)
    for i, k in zip(order, np.searchsorted(ends, [spans[i][1] for i in order], "right").tolist()):
        if k + 1 < len(ends):
            start = int(starts[k])
            out[i].append(f"> {near.tail(start, max(start, spans[i][1]), int(ends[k]))} {word(k + 1)}")
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    return all_contexts(text, [(start, end)])[0]


def _value(kind: int, s: str) -> str:
    return _digits(s) if kind in (CARD, PHONE) else s.lower()


_HINT = re.compile(r"[0-9:@]|[(\[]at[)\]]")  # every span and candidate holds one
_SEEN = ("struct<base: array<struct<start: int, kind: int, end: int>>, "
         "found: array<struct<start: int, end: int, seed: boolean, kinds: array<int>, value: string, near: array<string>>>>")
_SEEN_ARROW = pa.struct([
    ("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))),
    ("found", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()),
                                  ("kinds", pa.list_(pa.int32())), ("value", pa.string()),
                                  ("near", pa.list_(pa.string()))])))])


def look(text: str) -> dict:
    """Base spans of a text, and its seeds and candidates with their contexts."""
    if not _HINT.search(text):
        return {"base": [], "found": []}
    base = base_spans(text)
    found = [(s, e, True, [k]) for s, k, e in base] + [(s, e, False, ks) for s, e, ks in candidates(text, base)]
    near = all_contexts(text, [(s, e) for s, e, _, _ in found])
    return {"base": [{"start": s, "kind": k, "end": e} for s, k, e in base],
            "found": [{"start": s, "end": e, "seed": seed, "kinds": kinds, "value": _value(kinds[0], text[s:e]),
                       "near": n} for (s, e, seed, kinds), n in zip(found, near)]}


def _seen(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([look(t.as_py()) for t in texts], _SEEN_ARROW)


_seen.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


# Where a span can start or end inside a word (in lower case) that a cue is glued to.
_STARTS = re.compile(r"(?<=[^0-9])(?=[0-9])|(?=\+)|(?<=[^0-9a-z])(?=\()|(?<=[^0-9a-z._%+-])(?=[0-9a-z._%+-])|(?<=[^0-9a-z:.])(?=:)")
_ENDS = re.compile(r"(?<=[0-9])(?=[^0-9])|(?<=[0-9a-z-])(?=[^0-9a-z-])")


def _plain(word: str) -> bool:
    return word.isascii() and word.isalpha()


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_BEFORE, _AFTER, _FIRST, _LAST = range(4)  # what the filter holds: pairs by side, words by side
_CACHE = 1 << 19  # hashes and counts kept in a task


class _Codes(dict):
    """64-bit hashes of words' keys, at most ``_CACHE`` of them."""

    def __missing__(self, key: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        code = self[key] = xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"))
        return code


def _probes(role: int, first, second, bits: int) -> np.ndarray:
    """The two bits of the filter for a word or a pair in a role."""
    h = (np.asarray(first, np.uint64) ^ np.uint64(role)) * _MIX[0] + np.asarray(second, np.uint64) * _MIX[1]
    h = (h ^ (h >> np.uint64(29))) * _MIX[2]
    shift = np.uint64(65 - bits.bit_length())
    return np.stack([h >> shift, ((h ^ (h >> np.uint64(32))) * _MIX[3]) >> shift])


def filter_bits(patterns: Iterable[str], bits: int) -> np.ndarray:
    """Bits that ``patterns`` set in the filter."""
    codes, sides = _Codes(), ([], [])
    for p in patterns:
        w, _, x = p[2:].partition(" ")
        sides[p[0] == ">"].append((codes[w], codes[x]))
    out = []
    for pairs, role, edge, column in zip(sides, (_BEFORE, _AFTER), (_FIRST, _LAST), (0, 1)):
        a = np.array(pairs, np.uint64).reshape(-1, 2)
        out += [_probes(role, a[:, 0], a[:, 1], bits), _probes(edge, a[:, column], 0, bits)]
    return np.unique(np.concatenate([o.ravel() for o in out]))


class Known:
    """A filter of patterns: says yes to all of them and to few others."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits, self.codes = words, 64 * len(words), _Codes()

    def _has(self, role: int, first, second=0) -> np.ndarray:
        at = _probes(role, first, second, self.bits)
        found = (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
        return found[0] & found[1] != 0

    def occurrences(self, words: list[str]) -> Iterator[str]:
        """The patterns (and few other pairs) that stand in a text, given as words in lower
        case: a pair as two whole words on either side, the nearer of them also cut where
        a span can start (before) or end (after), as ``contexts`` cuts it."""
        if len(words) < 2:
            return
        keys = [w if len(w) <= LONG else Slices(w).head(0, len(w)) for w in words]
        codes = np.array([self.codes[k] for k in keys], np.uint64)
        for side, role in (("<", _BEFORE), (">", _AFTER)):
            for i in np.flatnonzero(self._has(role, codes[:-1], codes[1:])).tolist():
                yield f"{side} {keys[i]} {keys[i + 1]}"
        heads, tails = [], []
        for i in np.flatnonzero(self._has(_FIRST, codes[:-1])).tolist():
            if not _plain(x := words[i + 1]):
                cut = Slices(x)
                heads += [(keys[i], cut.head(0, m.start())) for m in _STARTS.finditer(x) if m.start()]
        for i in np.flatnonzero(self._has(_LAST, codes[1:])).tolist():
            if not _plain(w := words[i]):
                cut = Slices(w)
                tails += [(cut.tail(0, m.start(), len(w)), keys[i + 1]) for m in _ENDS.finditer(w)]
        for side, role, pairs in zip("<>", (_BEFORE, _AFTER), (heads, tails)):
            if pairs:
                a = np.array([(self.codes[w], self.codes[x]) for w, x in pairs], np.uint64)
                for i in np.flatnonzero(self._has(role, a[:, 0], a[:, 1])).tolist():
                    yield f"{side} {pairs[i][0]} {pairs[i][1]}"


def pattern_filter(patterns: DataFrame, bits: int) -> np.ndarray:
    """The filter's 64-bit words, put together by Spark; only they, ``bits`` / 64 of them at
    most whatever the number of patterns, come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = filter_bits(batch.column(0).to_pylist(), bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> np.uint64(6)).astype(np.int64)),
                 pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bits"])
    words = np.zeros(bits // 64, np.uint64)
    found = patterns.select("pattern").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = found.toArrow()
    words[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return words


def pattern_counts(texts: DataFrame, patterns: DataFrame, bits: int, rows: int) -> DataFrame:
    """(pattern, total): how often each of ``patterns``, of which there are at most ``rows``,
    stands in ``texts``.

    One pass over the texts, however many patterns there are: the pairs that pass
    the filter, of a fixed size, are counted; those that are no patterns
    drop out in a join. A task holds a bounded number of counts.
    """
    patterns = written(patterns.select("pattern").distinct(), "pii-patterns", rows=rows)
    known = texts.sparkSession.sparkContext.broadcast(pattern_filter(patterns, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                              names=["pattern", "total"])
        seen, counts = Known(known.value), {}
        for batch in batches:
            for text in batch.column(0):
                for pattern in seen.occurrences(lower(text.as_py() or "").split()):
                    counts[pattern] = counts.get(pattern, 0) + 1
                    if len(counts) >= _CACHE:
                        yield counted()
                        counts.clear()
        yield counted()
    found = texts.mapInArrow(run, "pattern string, total long").groupBy("pattern").agg(F.sum("total").alias("total"))
    return written(found.join(patterns, "pattern", "left_semi"), "pii-pattern-counts", rows=rows)


def matched_counts(rows: DataFrame) -> DataFrame:
    """(pattern, matched): how often each pattern stands beside a span or candidate,
    once for each place, whatever the number of kinds there."""
    def place(f, near):
        before = F.startswith(near, F.lit("<"))
        return F.struct(near.alias("pattern"), F.when(before, f["start"]).otherwise(f["end"]).alias("at"))
    places = F.flatten(F.transform("found", lambda f: F.transform(f["near"], lambda near: place(f, near))))
    each = rows.select(F.explode(F.array_distinct(places)).alias("place"))
    return each.groupBy(F.col("place.pattern").alias("pattern")).agg(F.count(F.lit(1)).alias("matched"))


def score(edges: DataFrame, totals: DataFrame, matched: DataFrame, p: Params) -> DataFrame:
    """(pattern, kind, confidence) after the rounds.

    ``edges``: pattern, kind, value, seed, n; ``totals``: pattern, total;
    ``matched``: pattern, matched. Seeds of a kind score 1 in it and
    0 in the others; candidates start at 0 and take 1 - prod(1 - confidence) of
    their patterns. A pattern's sums are aggregated before they are joined.
    """
    size = edges.count()
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for at in range(p.rounds):
        sums = scored.groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("hit"))
        conf = (sums.join(matched, "pattern").join(totals, "pattern", "left")  # greatest leaves nulls out
                .select("pattern", "kind", (F.col("hit") / F.greatest("total", "matched")).alias("confidence")))
        conf = written(conf.where("confidence > 0"), "pii-confidence", rows=size)
        if at + 1 < p.rounds:
            miss = F.log1p(-F.least("confidence", F.lit(1 - 1e-9)))
            chance = (edges.where("not seed").join(conf, ["pattern", "kind"]).groupBy("value", "kind")
                      .agg((1 - F.exp(F.sum(miss))).alias("chance")))
            scored = (edges.join(chance, ["value", "kind"], "left")
                      .withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("chance", F.lit(0.0)))))
    return conf


def find_pii(docs: DataFrame, id_col: str = "doc_id", text: str = "text", p: Params = Params()) -> DataFrame:
    """Per row: id, base and added spans: arrays of (start, kind, end) in order;
    places are code points, the end is exclusive, kinds index ``KINDS``.

    A null text counts as empty; null ids and repeated rows each get their own
    result; an empty table gives an empty result; other columns are not read.
    Added spans touch no base span; of several kinds the most confident is
    taken, ties go to the first of ``KINDS``.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    seen = F.arrow_udf(_seen, _SEEN)("_text")
    rows = written(rows.select("_id", "_row", seen.alias("s")).select("_id", "_row", "s.base", "s.found"), "pii-rows")
    each = rows.select("_row", F.explode("found").alias("f")).select("_row", "f.*")
    size = rows.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0] * 4  # edges at most
    near = each.select("value", "seed", F.explode("kinds").alias("kind"), "near").withColumn("pattern", F.explode("near"))
    edges = near.groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"))
    enough = (edges.groupBy("pattern").agg(F.count_distinct("value").alias("support"))
              .where(F.col("support") >= p.min_support).select("pattern"))
    edges = written(edges.join(enough, "pattern", "left_semi"), "pii-edges", rows=size)
    patterns = edges.select("pattern").distinct()
    totals = pattern_counts(docs.select(F.col(text)), patterns, p.filter_bits, size)
    matched = matched_counts(rows).join(patterns, "pattern", "left_semi")
    sure = score(edges, totals, written(matched, "pii-matched", rows=size), p).where(F.col("confidence") >= p.confidence)

    added = (each.where("not seed").select("_row", "start", "end", F.explode("kinds").alias("kind"), "near")
             .withColumn("pattern", F.explode("near")).join(sure, ["pattern", "kind"])
             .groupBy("_row", "start", "end")
             .agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("best")))
    added = added.groupBy(F.col("_row").alias("_at")).agg(F.array_sort(F.collect_list(
        F.struct("start", (-F.col("best.k")).alias("kind"), "end"))).alias("added"))
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    return rows.join(added, F.col("_row") == F.col("_at"), "left").select(
        F.col("_id").alias(id_col), "base", F.coalesce("added", none).alias("added"))


def span_text(spans):
    """kind:start:end of each span, comma-joined, by start and then kind."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
