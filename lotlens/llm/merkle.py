"""Merkle manifest of a table: a root per tree (source), one root over all, and a
witness for each leaf.

Leaves are appended in order, in blocks of ``fanout ** height`` aligned leaves, a
block in one task. An append that completes a run of ``fanout`` nodes makes their
parent, and the run becomes part of the witness of every leaf below it; subtrees
still open hold only the part that they have. What the leaves of a subtree share
is kept once, in the block's row. Block roots are appended in the next round as
leaves are in the first, and each completion there extends the witnesses of whole
blocks; the roots of the trees are appended to the tree over all trees in the same way.
At the end every block gets what later completions added above it.

A witness is packed as segments (own slot, nodes of the run, their digests).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lotlens.llm.common import lower_ascii, scratch_step

FANOUT = 16
HEIGHT = 3
SIZE = 32  # bytes of a digest


def parent(run: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in run).encode()).digest()


class OpenTree:
    """Appends leaves; holds the nodes of each level, of which the last run may be open."""

    def __init__(self, fanout: int = FANOUT, height: int = HEIGHT) -> None:
        self.fanout, self.height = fanout, height
        self.levels: list[list[bytes]] = [[]]

    def append(self, digest: bytes, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        nodes = self.levels[level]
        nodes.append(digest)
        if level < self.height and len(nodes) % self.fanout == 0:
            self.append(parent(nodes[-self.fanout:]), level + 1)

    def finish(self, whole: bool) -> bytes:
        """Completes the open runs: up to one node if this is the ``whole`` tree, to
        the full height if other blocks follow or precede."""
        level = 0
        while len(self.levels[level]) > 1 if whole else level < self.height:
            nodes = self.levels[level]
            if level + 1 == len(self.levels):
                self.levels.append([])
            if len(self.levels[level + 1]) * self.fanout < len(nodes):
                self.append(parent(nodes[len(self.levels[level + 1]) * self.fanout:]), level + 1)
            level += 1
        del self.levels[level + 1:]
        return self.levels[level][0]


def segment(slot: int, run: list[bytes]) -> bytes:
    return bytes((slot, len(run))) + b"".join(run)


def segments(witness: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(witness):
        slot, n = witness[at], witness[at + 1]
        body = witness[at + 2:at + 2 + n * SIZE]
        yield slot, [body[i:i + SIZE] for i in range(0, n * SIZE, SIZE)]
        at += 2 + n * SIZE


def in_block(levels: list[list[bytes]], i: int, fanout: int = FANOUT, start: int = 0) -> bytes:
    """The witness of leaf ``i`` from level ``start`` of its block up to the block's root."""
    out = b""
    for level in range(start, len(levels) - 1):
        at = i // fanout ** level
        first = at - at % fanout
        out += segment(at - first, levels[level][first:first + fanout])
    return out


def fold(digest: bytes, witness: bytes) -> bytes:
    """The root that a leaf's digest and its witness give."""
    for slot, run in segments(witness):
        digest = parent([*run[:slot], digest, *run[slot + 1:]])
    return digest


def siblings(witness: bytes) -> bytes:
    """The siblings of a witness as hex text, level by level, left to right."""
    return "".join(d.hex() for slot, run in segments(witness) for i, d in enumerate(run) if i != slot).encode()


def _unpack(body: bytes) -> list[bytes]:
    return [body[i:i + SIZE] for i in range(0, len(body), SIZE)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _append_rows(schema: pa.Schema, fanout: int, height: int):
    """Nodes sorted by (tree, block, place) -> a row per block."""
    size = fanout ** height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple]:
            at, tree, ids, claims, n = None, None, [], [], 0

            def done() -> tuple:
                root = tree.finish(n <= size)
                return (*at, -(-n // size), root, [b"".join(level) for level in tree.levels], ids, b"".join(claims))

            for batch in batches:
                for start in range(0, batch.num_rows, 1024):
                    for key, block, nodes, digest, claim, id_ in zip(*(c.to_pylist() for c in batch.slice(start, 1024).columns)):
                        if (key, block) != at:
                            if at is not None:
                                yield done()
                            at, tree, ids, claims, n = (key, block), OpenTree(fanout, height), [], [], nodes
                        tree.append(digest)
                        ids.append(id_)
                        claims.append(claim)
            if at is not None:
                yield done()

        held, leaves = [], 0
        for row in blocks():
            held.append(row)
            leaves += len(row[5])
            if leaves >= 1 << 13:
                yield _batch(held, schema)
                held, leaves = [], 0
        if held:
            yield _batch(held, schema)
    return run


def _witness_rows(schema: pa.Schema, fanout: int, height: int):
    """Blocks of upper rounds and what lies above them -> the witness of each node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, block, levels, above in zip(*(c.to_pylist() for c in batch.columns)):
                levels = [_unpack(x) for x in levels]
                rows = [(tree, block * fanout ** height + i, in_block(levels, i, fanout) + above)
                        for i in range(len(levels[0]))]
                yield _batch(rows, schema)
    return run


def _leaf_rows(schema: pa.Schema, fanout: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column(0).slice(r, 1).flatten()
                tree, levels, claims, above, subroot, root = (c[r].as_py() for c in batch.columns[1:])
                levels, claims = [_unpack(x) for x in levels], _unpack(claims)
                out, shared = [], b""
                for i, (leaf, claim) in enumerate(zip(levels[0], claims)):
                    if i % fanout == 0:  # what the leaves of a run share
                        shared = in_block(levels, i, fanout, 1) + above
                        hashed = siblings(shared)
                    first = i - i % fanout
                    own = segment(i - first, levels[0][first:first + fanout]) if len(levels) > 1 else b""
                    proof = hashlib.sha256(siblings(own) + hashed).hexdigest()
                    folded = fold(claim, own + shared).hex()
                    out.append((leaf.hex(), subroot.hex(), root.hex(), own + shared, proof, folded, folded == root.hex()))
                cols = [pa.array(c, f.type) for c, f in zip(zip(*out), list(schema)[2:])]
                yield pa.RecordBatch.from_arrays([ids, pa.array([tree] * len(ids), schema[1].type), *cols], schema=schema)
    return run


def _tree_rows(schema: pa.Schema, fanout: int):
    """Blocks of the tree over all trees -> each tree's root, witness and the root of all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, levels, above in zip(*(c.to_pylist() for c in batch.columns)):
                levels, rows = [_unpack(x) for x in levels], []
                for i, id_ in enumerate(ids):
                    witness = in_block(levels, i, fanout) + above
                    rows.append((id_, levels[0][i], witness, fold(levels[0][i], witness)))
                yield _batch(rows, schema)
    return run


def _mapped(df: DataFrame, make, schema: T.StructType, *args) -> DataFrame:
    return df.mapInArrow(make(to_arrow_schema(schema), *args), schema)


def ranked(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, id, digest, claim) with their place in the tree and its size.

    Ordered by range partitions, so a tree of any size is ranked by many tasks; rows
    equal in tree, id and digest are told apart by where they were read.
    """
    nodes = scratch_step(nodes.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    order = ["tree", "id", "digest", "row"]
    placed = (nodes.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)).drop("row"))
    placed = scratch_step(placed, "merkle-ordered")
    runs = placed.groupBy("tree", "part").agg(F.min("at").alias("from"), F.count("*").alias("rows"))
    runs = runs.selectExpr(
        "tree AS _tree", "part AS _part", "from", "sum(rows) OVER (PARTITION BY tree) AS n",
        "sum(rows) OVER (PARTITION BY tree ORDER BY part) - rows AS before")
    same = placed["tree"].eqNullSafe(runs["_tree"]) & (placed["part"] == runs["_part"])
    return placed.join(runs, same).select("tree", "id", "digest", "claim", "n",
                                          (F.col("at") - F.col("from") + F.col("before")).alias("place"))


def _rounds(nodes: DataFrame, tree_type: T.DataType, id_type: T.DataType, fanout: int, height: int) -> list[DataFrame]:
    """The block rows of each round, until every tree is one block."""
    size, out = fanout ** height, []
    schema = T.StructType([
        T.StructField("tree", tree_type), T.StructField("block", T.LongType()), T.StructField("blocks", T.LongType()),
        T.StructField("root", T.BinaryType()), T.StructField("levels", T.ArrayType(T.BinaryType())),
        T.StructField("ids", T.ArrayType(id_type)), T.StructField("claims", T.BinaryType())])
    while True:
        dealt = (nodes.select("tree", F.floor(F.col("place") / size).alias("block"), "n", "digest", "claim", "id", "place")
                 .repartition("tree", "block").sortWithinPartitions("tree", "block", "place").drop("place"))
        blocks = scratch_step(_mapped(dealt, _append_rows, schema, fanout, height), "merkle-blocks")
        out.append(blocks)
        more = blocks.where("blocks > 1")
        if more.isEmpty():
            return out
        nodes = more.select("tree", F.lit(None).cast(id_type).alias("id"), F.col("root").alias("digest"),
                            F.col("root").alias("claim"), F.col("blocks").alias("n"), F.col("block").alias("place"))


def _roots(rounds: list[DataFrame]) -> DataFrame:
    tops = [b.where("blocks = 1").select("tree", "root") for b in rounds]
    for other in tops[1:]:
        tops[0] = tops[0].unionByName(other)
    return tops[0]


def _above(rounds: list[DataFrame], top: DataFrame, tree_type: T.DataType, fanout: int, height: int) -> DataFrame:
    """(tree, block, above) for the blocks of the first round; ``top`` has what lies
    above each tree's root."""
    top = top.select(F.col("tree").alias("_top"), "above")
    witness = T.StructType([T.StructField("tree", tree_type), T.StructField("block", T.LongType()),
                            T.StructField("above", T.BinaryType())])
    lower = None
    for k in reversed(range(len(rounds))):
        whole = rounds[k].where("blocks = 1").select("tree", "block")
        above = whole.join(top, whole["tree"].eqNullSafe(top["_top"])).select("tree", "block", "above")
        above = above if lower is None else above.unionByName(lower)
        if k == 0:
            return above
        lower = _mapped(with_above(rounds[k], above).select("tree", "block", "levels", "above"), _witness_rows, witness,
                        fanout, height)


def with_above(blocks: DataFrame, above: DataFrame) -> DataFrame:
    above = above.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), "above")
    return blocks.join(above, blocks["tree"].eqNullSafe(above["_tree"]) & (blocks["block"] == above["_block"]))


def merkle_manifest(leaves: DataFrame, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """``leaves`` (tree, id, digest, claim) -> id, tree, leaf, subroot, root, witness
    (packed, see ``fold``), proof_sha256, folded_root, verified; digests as hex text.

    Leaves of a tree ascend by id, trees by their value: nulls come first, and
    equal ids are ordered by digest. ``digest`` and ``claim`` are SHA-256 values; the
    claim is what the witness is tried on (null: the leaf's digest). Every row is a
    leaf, repeated rows too. An empty table gives an empty result.
    """
    tree_type, id_type = leaves.schema["tree"].dataType, leaves.schema["id"].dataType
    claimed = leaves.select("tree", "id", "digest", F.coalesce("claim", "digest").alias("claim"))
    rounds = _rounds(ranked(claimed), tree_type, id_type, fanout, height)
    subroots = _roots(rounds)

    # the tree over the trees: their roots are its leaves, their values its ids
    one = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("id"), F.col("root").alias("digest"),
                          F.col("root").alias("claim"))
    upper = _rounds(ranked(one), T.IntegerType(), tree_type, fanout, height)
    root = _roots(upper)
    above = _above(upper, root.select("tree", F.lit(b"").alias("above")), T.IntegerType(), fanout, height)
    of_tree = T.StructType([T.StructField("tree", tree_type), *(T.StructField(c, T.BinaryType())
                                                                for c in ("subroot", "above", "root"))])
    tops = scratch_step(_mapped(with_above(upper[0], above).select("ids", "levels", "above"), _tree_rows, of_tree, fanout),
                   "merkle-tops")

    above = _above(rounds, tops, tree_type, fanout, height)
    named = tops.select(F.col("tree").alias("_named"), "subroot", F.col("root").alias("top"))
    blocks = with_above(rounds[0], above)
    blocks = blocks.join(named, blocks["tree"].eqNullSafe(named["_named"]))
    string = T.StringType()
    schema = T.StructType([
        T.StructField("id", id_type), T.StructField("tree", tree_type), T.StructField("leaf", string),
        T.StructField("subroot", string), T.StructField("root", string), T.StructField("witness", T.BinaryType()),
        T.StructField("proof_sha256", string), T.StructField("folded_root", string),
        T.StructField("verified", T.BooleanType())])
    return _mapped(blocks.select("ids", "tree", "levels", "claims", "above", "subroot", "top"), _leaf_rows, schema, fanout)


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields, each as its length in UTF-8 bytes, a colon and its text;
    a null field is a hyphen."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """Leaves of documents by source; where ``tampered`` holds, the claim is the digest
    of the row with its text in lower case (A-Z)."""
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    return docs.select(F.col("source").alias("tree"), F.col("doc_id").alias("id"),
                       leaf_digest(*others, F.col("text")).alias("digest"),
                       F.when(tampered, leaf_digest(*others, lower_ascii(F.col("text")))).alias("claim"))
