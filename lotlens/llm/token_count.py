"""Token counts of whole texts with a public tokenizer file.

An Arrow function returns one number per text. Texts are cut into pieces at
places that no token can reach across (before a space that follows a non-space
character), pieces are encoded in batches of a bounded number of bytes, and
only their lengths are kept: a piece seen before is not encoded again.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space other than the space.
_OTHER_SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"
                 + "".join(map(chr, range(0x2000, 0x200B))))
_AFTER_NON_SPACE = re.compile(r"(?<=\S)(?= )")
#: Inside a piece: after a letter where other ASCII signs begin, and between a
#: sign and a line end.
_INNER = re.compile(r"(?<=[A-Za-z])(?=[.,;:!?&*%$#|\n])|(?<=[.,;:!?&*%$#|])(?=\n)")


def safe_pieces(text: str) -> list[str]:
    """``text`` cut before each space that follows a non-space character; all
    pieces but the first are returned without that space."""
    pieces = text.split(" ")
    if "" in pieces or any(part[:1] == " " for c in _OTHER_SPACES if c in text for part in text.split(c)[1:]):
        first, *rest = _AFTER_NON_SPACE.split(text)
        return [first, *(piece[1:] for piece in rest)]
    return pieces


class PieceCounts:
    """Token counts of texts by their pieces; remembers the pieces it has encoded."""

    def __init__(self, encode, pieces, batch_bytes: int, max_entries: int):
        self.encode, self.pieces = encode, pieces
        self.batch_bytes, self.max_entries = batch_bytes, max_entries
        self.spaced: dict[str, int] = {}  # without the space that stands before the piece
        self.bare: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.pieces(text) for text in texts]
        whole = [text for text, p in zip(texts, cut) if p is None]
        lengths = iter(self._lengths(whole))
        self._learn({p[0] for p in cut if p} - self.bare.keys(),
                    set().union(*(p[1:] for p in cut if p)) - self.spaced.keys())
        spaced, bare = self.spaced.__getitem__, self.bare
        out = [next(lengths) if p is None else bare[p[0]] + sum(map(spaced, p[1:])) for p in cut]
        if len(self.spaced) + len(self.bare) > self.max_entries:
            self.spaced.clear()
            self.bare.clear()
        return out

    def _learn(self, bare: set[str], spaced: set[str]) -> None:
        parts = [(piece, self.bare, _INNER.split(piece)) for piece in bare]
        parts += [(piece, self.spaced, _INNER.split(piece)) for piece in spaced]
        after = {x for _, _, p in parts for x in p[1:]}
        after.update(p[0] for _, kind, p in parts if kind is self.bare)
        self._store(self.bare, "", after - self.bare.keys())
        self._store(self.spaced, " ", {p[0] for _, kind, p in parts if kind is self.spaced} - self.spaced.keys())
        for piece, kind, p in parts:
            if len(p) > 1:
                kind[piece] = kind[p[0]] + sum(map(self.bare.__getitem__, p[1:]))

    def _store(self, kind: dict[str, int], before: str, pieces: set[str]) -> None:
        order = list(pieces)
        kind.update(zip(order, self._lengths([before + piece for piece in order])))

    def _lengths(self, texts: list[str]) -> list[int]:
        found, batch, size = [], [], 0
        for text in texts:
            batch.append(text)
            size += len(text) + 16
            if size >= self.batch_bytes:
                found += self.encode(batch)
                batch, size = [], 0
        return found + self.encode(batch) if batch else found


def byte_balanced(texts: pa.Array, limit: int) -> Iterator[list[str]]:
    """Runs of consecutive texts of about ``limit`` bytes (one text at least)."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= limit:
            yield [t or "" for t in texts.slice(start, i + 1 - start).to_pylist()]
            start, size = i + 1, 0
    if start < len(texts):
        yield [t or "" for t in texts.slice(start).to_pylist()]


def _encoder(spec: bytes, kind: str):
    """(a batch of texts -> their token counts, a text -> its pieces or None: whole)."""
    if kind == ".model":
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_proto=spec)
        return (lambda batch: [len(x) for x in model.encode(batch, num_threads=1)]), lambda text: None
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_str(spec.decode())
    tok.no_truncation()
    tok.no_padding()
    pre = json.loads(spec).get("pre_tokenizer") or {}
    cuttable = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                and json.loads(spec).get("normalizer") is None)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]

    def pieces(text: str) -> list[str] | None:
        if not cuttable or any(s in text for s in special):
            return None
        return safe_pieces(text)
    return (lambda batch: [len(e) for e in tok.encode_batch_fast(batch, add_special_tokens=False)]), pieces


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def n_tokens(spark: SparkSession, text: Column, tokenizer: str | None = None, slice_bytes: int = 2 << 20,
             batch_bytes: int = 128 << 10, max_entries: int = 1_000_000) -> Column:
    """Token count of a text column (null counts as empty).

    ``tokenizer``: path of a file of the tokenizers library (.json) or of
    sentencepiece (.model), read once on the driver (a few MB, fixed) and
    broadcast. Only byte-level BPE without a normalizer has cuts that are safe;
    texts for other files, and texts that hold a special token, go in whole. ``slice_bytes``
    of text are cut at a time, ``batch_bytes`` of pieces are encoded at a time;
    a task keeps at most ``max_entries`` piece lengths.
    """
    path = tokenizer or default_tokenizer()
    with open(path, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind = os.path.splitext(path)[1]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = PieceCounts(*_encoder(spec.value, kind), batch_bytes, max_entries)
        gc.disable()  # large dicts of strings without cycles: its passes cost a third of the time
        try:
            for texts in batches:
                out: list[int] = []
                for part in byte_balanced(texts, slice_bytes):
                    out.extend(counts.count(part))
                yield pa.array(out, pa.int64())
        finally:
            gc.enable()
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "long")(F.coalesce(text, F.lit("")))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = 1024,
                 tokenizer: str | None = None) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens); a null id and repeated rows
    pass through; an empty table gives an empty result; other columns, whatever
    their names, are not read.
    """
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    d = d.withColumn("_n", n_tokens(docs.sparkSession, F.col("_text"), tokenizer))
    return d.select(F.col("_id").alias(id_col), F.octet_length("_text").cast("long").alias("n_bytes"),
                    F.col("_n").alias("n_tokens"), (F.col("_n") > limit).alias("over_limit"))
