"""WARC archives: a writer and a splittable reader.

Writing: a page becomes one gzip member that holds a WARC/1.1 record.  Pages with
equal payloads (SHA-1) of at least ``min_bytes`` bytes form a group; those with the
largest page id are ``response`` records, the others ``revisit`` records that refer
to that id and carry the payload's digest and length but no payload.  The groups
come from an aggregate over digests that combines on the map side, so a payload
that a third of the pages share costs one row for each task.  Only digests of two
or more pages are joined back, by broadcast after a count or else by a shuffle.

Reading: every archive is cut into byte ranges.  A task scans its range for the
gzip magic, decodes the start of each candidate and accepts it if a WARC header
follows; from there it walks member by member.  It owns the records that start
inside its range and reads beyond the range's end to complete the last.

Defined cases: NULL html is the empty payload; a NULL page id is written
without its field and comes back NULL, and as the smallest id; equal ids with equal
payloads are all responses; a NULL url is written without its field and comes back
NULL; control characters in a url are percent-encoded; an empty table
gives no archives; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batches_of, filesystem, scratch_path, small

MAGIC = b"\x1f\x8b\x08"
ARCHIVE_BYTES = 256 << 20
SPLIT_BYTES = 16 << 20
CHUNK = 1 << 18
#: Fixed value: writing time of the records, so that equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "path string, n_records long, n_bytes long"
RECORD = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
          "payload_digest string, payload binary")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def safe_url(url: str) -> str:
    return "".join(f"%{b:02X}" if (b := ord(c)) < 33 or b == 127 else c for c in url)


def record(page_id, url, payload: bytes, refers_to, is_revisit: bool) -> bytes:
    """One uncompressed WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if is_revisit else http + payload
    name = "none" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}",
            f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {safe_url(url)}")
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse_record(data: bytes) -> tuple:
    """A RECORD row from an uncompressed WARC record."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[:int(fields["Content-Length"])]
    page = fields.get("X-Page-ID")
    revisit = fields["WARC-Type"] == "revisit"
    refers = fields["WARC-Refers-To"][len("<urn:page:"):-1] if revisit else None
    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
    size = int(fields["X-Payload-Length"]) if revisit else len(payload)
    stored = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and digest(payload) != stored:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return (None if page is None else int(page), fields.get("WARC-Target-URI"), fields["WARC-Type"],
            None if refers is None else int(refers), size, stored, payload)


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, level: int = 3,
               archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Writes the archives and returns their folder, whose ``manifest`` (Parquet) names them."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    keyed = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    groups = (keyed.filter(F.length("payload") >= min_bytes).groupBy("sha")
              .agg(F.max("page_id").alias("kept_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    joined = keyed.join(small(groups), "sha", "left").drop("sha")

    def run(batches):
        fs, base = filesystem(folder)
        out, n, size, path = None, 0, 0, ""

        def manifest():
            nonlocal out, n, size, path
            for b in batches:
                for page_id, url, payload, kept in zip(*(b.column(i) for i in range(4))):
                    page_id, kept = page_id.as_py(), kept.as_py()
                    if out is None:
                        fs.create_dir(f"{base}/data", recursive=True)
                        path, n, size = f"data/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(f"{base}/{path}", compression=None)
                    revisit = kept is not None and page_id != kept
                    packed = member(record(page_id, url.as_py(), payload.as_py(), kept, revisit), level)
                    out.write(packed)
                    n, size = n + 1, size + len(packed)
                    if size >= archive_bytes:
                        out.close()
                        out = None
                        yield f"{folder}/{path}", n, size
            if out is not None:
                out.close()
                yield f"{folder}/{path}", n, size

        yield from batches_of(manifest(), arrow_schema(MANIFEST), 1)

    joined.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


class Window:
    """Bytes of a file from a place on, read in chunks as they are needed."""

    def __init__(self, file, start: int, size: int):
        self.file, self.base, self.end, self.held = file, start, size, b""
        file.seek(start)

    def more(self) -> bool:
        data = self.file.read(min(CHUNK, self.end - self.base - len(self.held)))
        self.held += data
        return bool(data)

    def drop(self, to: int) -> None:
        """Forgets the bytes before ``to``."""
        if to > self.base:
            self.held, self.base = self.held[to - self.base:], to


def is_record_start(window: Window, at: int) -> bool:
    """True if a gzip member whose content starts as a WARC record lies at ``at``."""
    unpacker, i, text = zlib.decompressobj(31), at - window.base, b""
    try:
        while len(text) < 16:
            if i >= len(window.held) and not window.more():
                return False
            part = window.held[i:i + 512]
            text, i = text + unpacker.decompress(part), i + len(part)
            if unpacker.eof:
                break
    except zlib.error:
        return False
    return text.startswith(b"WARC/1.") and b"\r\n" in text[:16]


def read_member(window: Window, at: int) -> tuple[bytes, int] | None:
    """(content, place after the member) of the member at ``at``; None at the end of the file."""
    unpacker, i, parts = zlib.decompressobj(31), at - window.base, []
    while not unpacker.eof:
        if i >= len(window.held) and not window.more():
            if not parts and i >= len(window.held):
                return None
            raise ValueError("the archive ends inside a member")
        part = window.held[i:]
        parts.append(unpacker.decompress(part))
        i += len(part)
    return b"".join(parts), window.base + i - len(unpacker.unused_data)


def records_in(file, start: int, end: int, size: int):
    """The contents of the records that start in [start, end)."""
    window, at = Window(file, start, size), start
    while True:  # the first member that starts here
        found = window.held.find(MAGIC, at - window.base)
        if found >= 0:
            at = window.base + found
            if at >= end:
                return
            if is_record_start(window, at):
                break
            at += 1
        else:
            at = max(at, window.base + len(window.held) - len(MAGIC) + 1)
            if at >= end or not window.more():
                return
            window.drop(at)
    while at < end:
        got = read_member(window, at)
        if got is None:
            return
        content, at = got
        window.drop(at)
        yield content


def read_warc(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """A RECORD row for every record of the archives in ``folder``."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    ranges = manifest.select("path", "n_bytes", F.explode(F.sequence(
        F.lit(0), F.col("n_bytes") - 1, F.lit(split_bytes))).alias("start"))
    ddl = RECORD if payloads else RECORD.rpartition(",")[0]
    n = max(1, ranges.count())

    def run(batches):
        def rows():
            for b in batches:
                for path, size, start in zip(*(b.column(i).to_pylist() for i in range(3))):
                    fs, place = filesystem(path)
                    with fs.open_input_file(place) as f:
                        for content in records_in(f, start, min(size, start + split_bytes), size):
                            row = parse_record(content)
                            yield row if payloads else row[:-1]

        yield from batches_of(rows(), arrow_schema(ddl), 200 if payloads else 2000)

    return ranges.repartition(n, "path", "start").mapInArrow(run, ddl)
