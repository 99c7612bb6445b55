"""WARC archives in Zstandard with an embedded dictionary (operator 8).

Writing: each archive is a text file of Spark's own writer whose "lines" are Zstandard frames, so
any file system Spark writes to will do, and a lost task's file is replaced by its retry. The
line separator is an empty skippable frame, which every Zstandard reader passes over. The first
line is a skippable frame (magic 0x184D2A5D) with the dictionary, as in the public WARC-Zstandard
proposal; then one frame holds one record.

Reading: whole files come in through the binary source. The reader loads the dictionary from the
leading skippable frame, decodes one frame per record, and validates version, required headers,
lengths, block ends and payload digests. A file of which a byte is missing or wrong raises.

Payloads of at least ``MIN_REVISIT`` bytes are stored once: the record with the smallest page id is
the response, the others are revisits that refer to it. Archives hold at most about ``ARCHIVE_BYTES``
of payload, so that a file fits a task; the number follows from the total size, not from a key.

Edge cases: a null payload is empty; a null page id sorts last and is written as ``none``; rows
that repeat the smallest page id are responses too; extra columns are ignored; an empty table
writes an archive without records and reads as an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

MIN_REVISIT = 100
ARCHIVE_BYTES = 32 << 20
DICT_MAGIC = 0x184D2A5D
PAD = "P*M\x18\x00\x00\x00\x00"             # an empty skippable frame (magic 0x184D2A50)
SAMPLE_PAGES, SAMPLE_BYTES, DICT_BYTES = 500, 16 << 10, 64 << 10
WHEN = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")     # fixed, so that reruns agree
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_FIELDS = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
           ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]
_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _record_id(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page(record_id: str) -> int | None:
    name = record_id.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def build_record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record: a response with the payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page)}",
            f"WARC-Date: {WHEN}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: {_record_id(refers)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> tuple[str, dict[str, str], int]:
    """First line, headers in lower case, and where the block begins."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("record without end of header")
    first, *lines = data[:end].decode("utf-8").split("\r\n")
    out = {}
    for line in lines:
        name, sep, value = line.partition(":")
        if not sep or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        out[name.lower()] = value.strip()
    return first, out, end + 4


def parse_record(data: bytes) -> tuple:
    """Validated (page id, payload bytes, digest, type, refers to, url) of one record."""
    version, head, at = _headers(data)
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in head:
            raise ValueError(f"record without {name}")
    size = int(head["content-length"])
    if len(data) != at + size + 4 or data[-4:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(data) - at - 4} bytes, header says {size}")
    status, http, body = _headers(data[at:at + size])
    if not status.startswith("HTTP/"):
        raise ValueError("block is no HTTP response")
    payload, kind = data[at + body:at + size], head["warc-type"]
    digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
    length = int(http["content-length"])
    if kind == "response":
        if length != len(payload) or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {head['warc-record-id']} does not fit its length or digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in head:
        raise ValueError(f"bad record of type {kind}")
    refers = _page(head["warc-refers-to"]) if kind == "revisit" else None
    return _page(head["warc-record-id"]), length, digest, kind, refers, head.get("warc-target-uri")


def _frame(tool: zstandard.ZstdDecompressor, data: bytes, at: int, step: int = 1 << 14) -> tuple[bytes, int]:
    """The content of the frame at ``at`` and where the next frame begins."""
    frame, out = tool.decompressobj(), []
    while not frame.eof:
        piece = data[at:at + step]
        if not piece:
            raise ValueError("archive ends inside a record")
        out.append(frame.decompress(piece))
        at += len(piece)
    return b"".join(out), at - len(frame.unused_data)


def read_archive(data: bytes):
    """Records of one archive, each from a frame of its own."""
    at, tool, dictionary = 0, None, None
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("archive ends inside a frame")
        magic, size = struct.unpack_from("<II", data, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if at + 8 + size > len(data):
                raise ValueError("archive ends inside a skippable frame")
            if magic == DICT_MAGIC:
                if at:
                    raise ValueError("dictionary is not the first frame")
                raw = data[8:8 + size]
                if raw[:4] == b"\x28\xb5\x2f\xfd":      # the dictionary may itself be compressed
                    raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 26)
                dictionary = zstandard.ZstdCompressionDict(raw)
            at += 8 + size
            continue
        tool = tool or zstandard.ZstdDecompressor(dict_data=dictionary)
        record, at = _frame(tool, data, at)
        yield parse_record(record)
    if dictionary is None and data:
        raise ValueError("archive without dictionary")


def train_dictionary(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> bytes:
    """Dictionary from the first ``SAMPLE_BYTES`` of at most ``SAMPLE_PAGES`` pages, the first by hash of the id."""
    place = F.xxhash64(id_col).alias("h")
    # ids are ranked alone: a task's leading rows, which go to the driver, hold no text
    lead = pages.select(place).orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h")).first()[0]
    few = pages.where(F.xxhash64(id_col) <= F.lit(lead).cast("long")).select(F.substring(payload_col, 1, SAMPLE_BYTES).alias("p"), id_col, place)
    rows = few.where("p is not null").orderBy("h").limit(SAMPLE_PAGES).collect()
    samples = [build_record(r[1], "", r[0].encode(), "0" * 64, None, False) for r in rows]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):       # too few samples: raw content serves as dictionary
        return b"".join(samples)[:DICT_BYTES] or b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"


def record_plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                min_revisit: int = MIN_REVISIT, files: int | None = None) -> DataFrame:
    """``page, url, payload, digest, first``: first is the smallest id with the same payload of enough bytes, else null.

    With ``files`` the rows come in that many partitions. Payloads are exchanged once, by page and
    digest; what repeats is found on digests alone and meets them there.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    url = F.col(url_col) if url_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), url.cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"))
    names = rows.where(F.octet_length("payload") >= min_revisit).select("page", "digest", F.unhex("digest").alias("_d"))
    first = names.groupBy("_d").agg(F.min("page").alias("first"), F.count("*").alias("_c")).where("_c > 1").drop("_c")
    key = F.concat_ws("/", F.col("page").cast("string"), "digest").alias("_key")
    copies = names.join(first, "_d").groupBy(key).agg(F.first("first").alias("first"))
    rows = rows.select("*", key)
    if files is not None:
        rows, copies = rows.repartition(files, "_key"), copies.repartition(files, "_key")
    return rows.join(copies, "_key", "left").select("page", "url", "payload", "digest", "first")


def write_archives(pages: DataFrame, path: str, dictionary: bytes, total_bytes: int, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of at most about ``archive_bytes`` of payload in the folder ``path``."""
    lead = struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary

    def work(batches):
        tool = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        yield pa.RecordBatch.from_arrays([pa.array([lead], pa.binary())], ["frame"])
        for batch in batches:
            out = []
            for page, url, payload, digest, first in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "payload", "digest", "first"))):
                revisit = first is not None and page != first
                out.append(tool.compress(build_record(page, url, payload, digest, first, revisit)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
    # with fewer files than shuffle partitions, Spark would exchange the payloads again for the join
    files = max(-(-total_bytes // archive_bytes), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    records = record_plan(pages, id_col, url_col, payload_col, files=files)
    frames = records.mapInArrow(work, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", PAD).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url`` of every record in the archives of a folder."""
    def work(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = list(read_archive(data.as_py())) if len(data.as_py()) else []
                cols = list(zip(*rows)) or [()] * len(_FIELDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS)], [n for n, _ in _FIELDS])
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(work, _SCHEMA)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the pages as archives under the shared folder, read them back, and return the contract's columns."""
    spark = pages.sparkSession
    total = pages.agg(F.sum(F.octet_length(payload_col))).first()[0] or 0
    path = Scratch(spark, "warc").path("archives")
    write_archives(pages, path, train_dictionary(pages, id_col, payload_col), total, id_col, url_col, payload_col)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
