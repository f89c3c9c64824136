"""WARC archives in Zstandard: one frame per record, with the dictionary in a skippable frame at the front.

Archives are written and read where Spark's tasks run, in a folder that all of them reach. A task that is run again writes
files of new names; the list of files that Spark committed tells which ones count.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from csvharbor.session import cut

DICTIONARY_MAGIC = 0x184D2A5D  # fixed value of the format
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"  # fixed value of Zstandard
ARCHIVE_BYTES = 16 << 20
SAMPLE_PAGES = 400
SAMPLE_BYTES = 1 << 16
DICTIONARY_BYTES = 1 << 15
READ_BYTES = 1 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


class BrokenArchive(ValueError):
    pass


def digest(payload: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None = None, is_revisit: bool = False) -> bytes:
    """A response record, or a revisit that keeps only the HTTP header, which still tells the payload's length."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not is_revisit:
        block += payload
    fields = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if key is None else key}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if is_revisit:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("WARC-Payload-Digest", "sha1:" + digest(payload)), ("WARC-Block-Digest", "sha1:" + digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def parse(data: bytes) -> dict:
    """Fields of one record; raises ``BrokenArchive`` where version, header, a length or a digest is wrong."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise BrokenArchive("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name.strip():
            raise BrokenArchive(f"header line without a name: {name[:60]}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise BrokenArchive(f"{name} is missing")
    if not fields["content-length"].isdigit() or int(fields["content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise BrokenArchive("Content-Length does not fit the record")
    block = rest[:-4]
    if fields.get("warc-block-digest") not in (None, "sha1:" + digest(block)):
        raise BrokenArchive("block digest does not fit")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if fields["warc-type"] == "response":
        if length and int(length[1]) != len(payload):
            raise BrokenArchive("HTTP Content-Length does not fit the payload")
        if stated not in (None, digest(payload)):
            raise BrokenArchive("payload digest does not fit")
    return {
        "page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
        "refers_to": _page(fields.get("warc-refers-to")), "payload_digest": stated,
        "payload_bytes": len(payload) if fields["warc-type"] == "response" or not length else int(length[1]), "payload": payload,
    }


def dictionary_frame(content: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(content)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def _exactly(source, n: int, front: bytes = b"") -> bytes:
    parts, have = [front], len(front)
    while have < n and (more := source.read(n - have)):
        parts.append(more)
        have += len(more)
    return b"".join(parts)


def frames(source) -> Iterator[bytes]:
    """The content of every frame of an open archive, in order. The dictionary may itself be a Zstandard frame."""
    held = _exactly(source, 8)
    known = None
    if len(held) == 8 and struct.unpack("<I", held[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", held[4:])[0]
        content = _exactly(source, size)
        if len(content) != size:
            raise BrokenArchive("the dictionary is cut off")
        known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(content) if content[:4] == FRAME_MAGIC else content)
        held = b""
    opener = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while True:
        held = held or source.read(READ_BYTES)
        if not held:
            return
        unpacker, parts = opener.decompressobj(), []
        try:
            while True:
                parts.append(unpacker.decompress(held))
                if unpacker.eof:
                    held = unpacker.unused_data
                    break
                held = source.read(READ_BYTES)
                if not held:
                    raise BrokenArchive("the last frame is cut off")
        except zstandard.ZstdError as e:
            raise BrokenArchive(f"not a frame: {e}") from e
        yield b"".join(parts)


def train_dictionary(pages: DataFrame, html: str = "html", pages_at_most: int = SAMPLE_PAGES) -> bytes:
    """A dictionary from at most ``pages_at_most`` pages, of which ``SAMPLE_BYTES`` characters at most count; empty if they are too few.

    It changes the size of the archives only, so any pages will do.
    """
    rows = pages.where(F.length(html) > 0).select(F.substring(html, 1, SAMPLE_BYTES).alias("h")).limit(pages_at_most).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r.h.encode("utf-8") for r in rows]).as_bytes() if len(rows) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _writer(folder: str, dictionary: bytes, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
        name, out, size, count = "", None, 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for key, url, html, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = store.open_output_stream(f"{base}/{name}")
                    if dictionary:
                        out.write(dictionary_frame(dictionary))
                payload = (html or "").encode("utf-8")
                frame = packer.compress(record(key, url, payload, head, head is not None))
                out.write(frame)
                size, count = size + len(frame), count + 1
                if size >= archive_bytes:
                    out.close()
                    out = done.append((f"{folder}/{name}", count))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    return write


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme and host that Spark gives it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", full)


def write_archives(
    pages: DataFrame, folder: str, id_column: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Writes a record per row and gives back ``path, records`` of the archives, which roll over at ``archive_bytes``.

    The payload is the html in UTF-8, null as empty. Among equal payloads of at least ``revisit_from`` bytes the row with the
    smallest id becomes a response and the others revisit it; rows without an id, and rows that repeat that id, are responses
    too. Digests are counted before the pages are joined with them, so that a payload that many rows share is neither
    gathered nor compared in pairs.
    """
    spark = pages.sparkSession
    content = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), F.sha1(content).alias("sum"), F.octet_length(content).alias("bytes"))
    shared = rows.where(F.col("bytes") >= revisit_from).groupBy("sum", "bytes").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = rows.join(shared, ["sum", "bytes"], "left").select("id", "url", "html", F.when(F.col("id") != F.col("head"), F.col("head")).alias("head"))
    folder = qualified(spark, folder)
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    return cut(marked.mapInArrow(_writer(folder, train_dictionary(pages, html), archive_bytes), "path string, records long"))


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload, path, place, error`` per record.

    Files are streamed frame by frame, so an archive of any size needs the memory of one record. A record that fails a check
    is a row with its ``error``; what follows a broken frame cannot be found and the row says so. ``payloads`` false leaves
    the payloads out after they are checked.
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload", "path", "place", "error"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string()]

    def rows(path: str) -> Iterator[dict]:
        store, base = fs.FileSystem.from_uri(path)
        place = -1
        try:
            with store.open_input_stream(base) as source:
                for place, data in enumerate(frames(source)):
                    try:
                        yield parse(data) | {"place": place}
                    except BrokenArchive as e:
                        yield {"place": place, "error": str(e)}
        except BrokenArchive as e:
            yield {"place": place + 1, "error": str(e)}

    def packed(held: list[dict], path: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(held) if n == "path" else [x.get(n) for x in held], k) for n, k in zip(names, kinds, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(path):
                    if not payloads:
                        row["payload"] = None
                    held.append(row)
                    size += len(row.get("payload") or b"")
                    if size > ARCHIVE_BYTES or len(held) >= 5000:
                        yield packed(held, path)
                        held, size = [], 0
                if held:
                    yield packed(held, path)

    kind = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, path string, place long, error string"
    count = archives.count()
    return archives.select("path").repartition(max(1, min(count, 100_000))).mapInArrow(read, kind)


#: What the archives of a whole table hold, in plain SQL.
RECORDS_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages),
h AS (SELECT *, list_transform(range(4), lambda k: ('0x' || substr(sha1(payload), 10 * k + 1, 10))::BIGINT) AS fives FROM p)
SELECT page_id, strlen(payload) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((fives[1 + i // 8] >> (35 - 5 * (i % 8))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > least THEN least END AS refers_to, NULL::VARCHAR AS error
FROM h
"""
