"""WARC archives in Zstandard frames: writer and reader.

An archive is a leading skippable frame that holds the dictionary, then one
frame per record. Archives are built in tasks of bounded size and written by
Spark's own text writer, one row per file, so that they go through Spark's
commit protocol to any store. The writer's line end is itself an empty
skippable frame, so each file stays a valid Zstandard stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.llm.common import scratch

# Fixed values of the formats.
DICT_MAGIC = 0x184D2A5D  # skippable frame that holds the dictionary
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"  # 0x184D2A50 with no content
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

RECORD = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
          "target_uri string, payload binary, error string")
_RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                           ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()),
                           ("payload", pa.binary()), ("error", pa.string())])


def with_revisits(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html",
                  min_bytes: int = 100) -> DataFrame:
    """Rows (page_id, url, payload, digest, refers_to) as they go into archives.

    Of equal payloads of at least ``min_bytes`` bytes the smallest id is the
    response, the others refer to it. Equal payloads whose ids are all null
    have no response to refer to and are all responses. Rows that repeat the
    response's id are responses too.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    d = d.withColumn("digest", F.sha2("payload", 256))
    first = (pages.select(F.col(id_col).cast("long").alias("_id"), payload.alias("_payload"))
             .where(F.octet_length("_payload") >= min_bytes).select("_id", F.sha2("_payload", 256).alias("_digest"))
             .groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    d = d.join(first, d["digest"] == first["_digest"], "left")
    other = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id"))
    return d.select("page_id", "url", "payload", "digest", F.when(other, F.col("_first")).alias("refers_to"))


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(uri: str) -> int | None:
    name = uri.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit's block has the response head without payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if refers_to is None else head
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _uri(page_id)),
              ("WARC-Date", DATE), ("Content-Type", "application/http;msgtype=response"),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Length", str(len(block)))]
    if url is not None:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    if refers_to is not None:
        fields += [("WARC-Refers-To", _uri(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def build_archive(records: list[bytes], dict_bytes: int, sample_bytes: int, level: int) -> bytes:
    """Dictionary frame and one frame per record. The dictionary is trained on
    the first ``sample_bytes`` of records; too few of them give an empty one."""
    sample, size = [], 0
    for r in records:
        if size >= sample_bytes:
            break
        sample.append(r[:sample_bytes])
        size += len(r)
    try:
        trained = zstandard.train_dictionary(dict_bytes, sample, k=512, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        trained = b""
    known = zstandard.ZstdCompressionDict(trained) if trained else None
    packer = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
    lead = DICT_MAGIC.to_bytes(4, "little") + len(trained).to_bytes(4, "little") + trained
    return lead + b"".join(map(packer.compress, records))


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its block headers."""
    params = zstandard.get_frame_parameters(data[at:at + 18])
    pos = at + zstandard.frame_header_size(data[at:at + 18])
    last = False
    while not last:
        if pos + 3 > len(data):
            raise ValueError("truncated frame")
        head = int.from_bytes(data[pos:pos + 3], "little")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        if kind == 3:
            raise ValueError("reserved block type")
        pos += 3 + (1 if kind == 1 else size)
    pos += 4 * params.has_checksum
    if pos > len(data):
        raise ValueError("truncated frame")
    return pos


def frames(data: bytes) -> Iterator[bytes]:
    """The content of each record frame of an archive."""
    at, known = 0, None
    if data[:4] == DICT_MAGIC.to_bytes(4, "little"):
        size = int.from_bytes(data[4:8], "little")
        raw = data[8:8 + size]
        if len(raw) < size:
            raise ValueError("truncated dictionary frame")
        if raw[:4] == FRAME_MAGIC.to_bytes(4, "little"):  # the dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw)
        known = zstandard.ZstdCompressionDict(raw) if raw else None
        at = 8 + size
    unpack = zstandard.ZstdDecompressor(dict_data=known)
    while at < len(data):
        magic = int.from_bytes(data[at:at + 4], "little")
        if magic in SKIPPABLE:
            if at + 8 > len(data):
                raise ValueError("truncated skippable frame")
            at += 8 + int.from_bytes(data[at + 4:at + 8], "little")
            continue
        if magic != FRAME_MAGIC:
            raise ValueError("not a Zstandard frame")
        end = frame_end(data, at)
        yield unpack.decompressobj().decompress(data[at:end])
        at = end


def parse_record(data: bytes) -> dict:
    """Fields of one record; raises ValueError where headers or lengths are wrong."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not blank or first not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC version line or no end of headers")
    fields = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise ValueError("header line without a colon")
        fields[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError("missing " + ", ".join(sorted(missing)))
    if not fields["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not match the block")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        raise ValueError(f"record type {kind}")
    http, blank, payload = rest[:size].partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n")[1:]
                   if x.lower().startswith(b"content-length:")), None)
    if not blank or length is None:
        raise ValueError("no response head")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload does not match its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields or "warc-profile" not in fields):
        raise ValueError("revisit with a payload or without its response")
    return {"page_id": _page_of(fields["warc-record-id"]), "payload_bytes": length, "payload_digest": digest,
            "record_type": kind, "target_uri": fields.get("warc-target-uri"),
            "refers_to": _page_of(fields["warc-refers-to"]) if kind == "revisit" else None,
            "payload": payload if kind == "response" else None, "error": None}


def write_archives(rows: DataFrame, path: str, archive_bytes: int = 8 << 20, dict_bytes: int = 16 << 10,
                   sample_bytes: int = 512 << 10, level: int = 3) -> None:
    """Archives of about ``archive_bytes`` of records each, one file per archive."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def archive(held: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([build_archive(held, dict_bytes, sample_bytes, level)], pa.binary())], names=["archive"])

        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                one = record(*(c[i].as_py() for c in batch.columns))
                held.append(one)
                size += len(one)
                if size >= archive_bytes:
                    yield archive(held)
                    held, size = [], 0
        if held:
            yield archive(held)

    cols = rows.select("page_id", "url", F.col("payload").cast("binary"), "digest", "refers_to")
    (cols.mapInArrow(pack, "archive binary").select(F.col("archive").cast("string"))
     .write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).option("compression", "none").text(path))


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives below ``path`` (``RECORD``); what fails its
    checks is a row with ``error`` set, and ends its archive if a frame is bad."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records(data: bytes) -> Iterator[dict]:
            blank = dict.fromkeys(_RECORD_ARROW.names)
            try:
                for content in frames(data):
                    try:
                        one = parse_record(content)
                    except ValueError as e:
                        one = blank | {"error": str(e)}
                    yield one if payloads else one | {"payload": None}
            except (ValueError, zstandard.ZstdError) as e:
                yield blank | {"error": str(e)}

        for batch in batches:
            for data in batch.column(0):
                held, size = [], 0
                for one in records(data.as_py()):
                    held.append(one)
                    size += len(one["payload"] or b"") + 256
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, _RECORD_ARROW)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, _RECORD_ARROW)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, "
                                                   "content binary").load(path)
    return files.select("content").mapInArrow(unpack, RECORD)


def warc_roundtrip(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html",
                   min_bytes: int = 100, path: str | None = None) -> DataFrame:
    """Writes a record per row to archives, reads them back: id, payload_bytes,
    payload_digest, record_type, refers_to, error (null for sound records).

    A null html is an empty payload, a null url has no target, a null id is
    kept as null; repeated rows give repeated records; an empty table gives an
    empty result; other columns are not read. The archives go to ``path``, by
    default a new folder in the shared folder.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(with_revisits(pages, id_col, url, html, min_bytes), path)
    return read_archives(spark, path, payloads=False).drop("target_uri", "payload").withColumnRenamed("page_id", id_col)
