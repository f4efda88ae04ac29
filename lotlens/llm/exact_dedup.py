"""Exact dedup with Patricia-trie owners.

Every text goes into a compressed radix trie twice: once in the task that read
it (so that a hot group of copies leaves each task as one row), once in the
partition of its length and content hash, where all copies of it meet. A
terminal node keeps the owner's id and the number of rows that ended there.
Equality is decided by the trie alone, on full byte strings; length and hash
only deal the texts out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.llm.common import repeat_rows

PARTIAL = "n_bytes long, content_hash long, body binary, owner long, copies long"
_PARTIAL_ARROW = pa.schema([("n_bytes", pa.int64()), ("content_hash", pa.int64()), ("body", pa.binary()),
                            ("owner", pa.int64()), ("copies", pa.int64())])
GROUPS = "text_key binary, keep_id long, group_size long"
_GROUPS_ARROW = pa.schema([("text_key", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


class _Node:
    __slots__ = ("label", "children", "terminal")

    def __init__(self, label: bytes, children: dict, terminal: list | None):
        self.label, self.children, self.terminal = label, children, terminal


def _shared_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``, by halving."""
    lo, hi = 0, min(len(a), len(b) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[at + lo:at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class RadixTrie:
    """Patricia trie over byte strings; a terminal is [owner, copies, hash].

    ``owner`` is the largest id seen (smallest if ``largest`` is False); a null
    id owns only where no other id ended.
    """

    NODE_BYTES = 400

    def __init__(self, largest: bool = True):
        self.largest = largest
        self.clear()

    def clear(self) -> None:
        self.root = _Node(b"", {}, None)
        self.bytes = 0
        self.weight: dict[int, int] = {}  # bytes held below each child of the root

    def _charge(self, key: bytes, n: int) -> None:
        self.bytes += n
        if key:
            self.weight[key[0]] = self.weight.get(key[0], 0) + n

    def insert(self, key: bytes, owner: int | None, copies: int, content_hash: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = _Node(key[at:], {}, None)
                self._charge(key, len(key) - at + self.NODE_BYTES)
                node, at = child, len(key)
            elif key.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                m = _shared_prefix(child.label, key, at)
                upper = _Node(child.label[:m], {child.label[m]: child}, None)
                child.label = child.label[m:]
                node.children[key[at]] = upper
                self._charge(key, self.NODE_BYTES)
                node, at = upper, at + m
        if node.terminal is None:
            node.terminal = [owner, copies, content_hash]
            return
        held = node.terminal
        held[1] += copies
        if owner is not None and (held[0] is None or (owner > held[0] if self.largest else owner < held[0])):
            held[0] = owner

    @staticmethod
    def _walk(node: _Node, prefix: bytes) -> Iterator[tuple[bytes, list]]:
        todo = [(node, prefix)]
        while todo:
            node, prefix = todo.pop()
            key = prefix + node.label
            if node.terminal is not None:
                yield key, node.terminal
            todo.extend((child, key) for child in node.children.values())

    def items(self) -> Iterator[tuple[bytes, list]]:
        return self._walk(self.root, b"")

    def pop_heaviest(self) -> Iterator[tuple[bytes, list]]:
        """Takes the heaviest subtree below the root out of the trie."""
        first = max(self.weight, key=self.weight.get)
        self.bytes -= self.weight.pop(first)
        return self._walk(self.root.children.pop(first), b"")


def _batches(rows: Iterator[tuple], schema: pa.Schema, size_of, limit: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batch: pa.RecordBatch, step: int = 512) -> Iterator[tuple]:
    """Rows as Python values, a bounded slice at a time."""
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        yield from zip(*(c.to_pylist() for c in part.columns))


def _combine(largest: bool, memory_bytes: int, out_bytes: int):
    """Map side: one trie per task; over its budget it passes on its heaviest
    subtree, whose terminals meet their equals again after the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie(largest)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for content_hash, body, owner in _rows(batch):
                    trie.insert(body, owner, 1, content_hash)
                    while trie.bytes > memory_bytes:
                        for key, (who, n, h) in trie.pop_heaviest():
                            yield len(key), h, key, who, n
            for key, (who, n, h) in trie.items():
                yield len(key), h, key, who, n
        yield from _batches(rows(), _PARTIAL_ARROW, lambda r: r[0] + 64, out_bytes)
    return run


def _own(largest: bool, memory_bytes: int):
    """Reduce side: rows come sorted by (length, hash), so a text is complete
    when that pair changes; a full trie is handed out there and emptied."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie(largest)

        def groups() -> Iterator[tuple]:
            for key, (who, n, _) in trie.items():
                yield hashlib.sha256(key).digest(), who, n

        def rows() -> Iterator[tuple]:
            at = None
            for batch in batches:
                for n_bytes, content_hash, body, owner, copies in _rows(batch):
                    if (n_bytes, content_hash) != at:
                        at = (n_bytes, content_hash)
                        if trie.bytes > memory_bytes:
                            yield from groups()
                            trie.clear()
                    trie.insert(body, owner, copies, content_hash)
            yield from groups()
        yield from _batches(rows(), _GROUPS_ARROW, lambda r: 64, 1 << 20)
    return run


def owners(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "largest",
           memory_bytes: int = 48 << 20) -> DataFrame:
    """One row per distinct text: text_key (SHA-256), keep_id, group_size.

    A null text counts as empty. ``memory_bytes`` bounds the trie of a task:
    beyond it the map side spills its heaviest subtree into the shuffle, and the
    reduce side hands out the finished texts (a single text is always whole).
    """
    largest = {"largest": True, "smallest": False}[keep]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.xxhash64(body).alias("content_hash"), body.cast("binary").alias("body"),
                       F.col(id_col).cast("long").alias("owner"))
    partial = rows.mapInArrow(_combine(largest, memory_bytes, 4 << 20), PARTIAL)
    return (partial.repartition("n_bytes", "content_hash").sortWithinPartitions("n_bytes", "content_hash")
            .mapInArrow(_own(largest, memory_bytes), GROUPS))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "largest",
                memory_bytes: int = 48 << 20) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Exactly one row of each group of equal texts is kept: the one with the
    largest (smallest) id. Rows repeated with the same id and text count each
    and the first of them is kept; a null id is kept only where all ids of the
    group are null (keep_id is then null). A null text equals an empty one.
    An empty table gives an empty result; other columns are not read.
    """
    groups = owners(docs, id_col, text, keep, memory_bytes)
    rows = (docs.select(F.col(id_col).alias("_id"),
                        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("_key"))
            .groupBy("_id", "_key").agg(F.count(F.lit(1)).alias("_rows")))
    # thin rows; a hot text's partition is split by the adaptive skew join
    out = repeat_rows(rows.join(groups, rows["_key"] == groups["text_key"]), "_rows", "_nth")
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size",
                      (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1)).alias("kept"),
                      F.lower(F.hex("text_key")).alias("text_sha256"))
