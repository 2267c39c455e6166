"""WARC archives: a writer that replaces repeated payloads by revisits, and a salvage reader.

Each record is a gzip member of its own. The reader checks a record's version line, header,
length, end and block digest. After a failed check it searches onward for the next valid
member (compressed files) or version line (plain ones), resumes there, and logs the bytes in
between as a quarantined gap; records after the damage are not lost.

Files are capped (``FILE_BYTES``) and read whole; a task holds one file. Every task attempt
writes files of its own and only counted attempts enter the manifest.

Defined cases: a null or empty payload has zero bytes; a null url is left out; line breaks in
a url are percent-encoded; equal rows are written each for itself (of equal page_ids with an
equal payload, one is the response); null page_ids never become a response that others
revisit; an empty table gives no file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.llm.common import Scratch, shuffle_partitions
from tallow.llm.files import make_folder, open_folder

VERSION = b"WARC/1.1\r\n"
#: Versions that are read; their lines have one length.
VERSIONS = (b"WARC/1.0\r\n", VERSION)
FILE_BYTES = 32 << 20
REVISIT_BYTES = 1000
SALTS = 32
GZIP = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return "urn:tallow:page:" + ("none" if page_id is None else str(page_id))


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """An uncompressed record. A revisit has no block; its payload's size is kept in a header."""
    block = b"" if refers_to is not None else payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{record_id(page_id)}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(refers_to)}>"), ("WARC-Truncated", "length")]
    head.append(("Content-Length", str(len(block))))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


class Damaged(ValueError):
    pass


def header_end(data: memoryview, at: int) -> int:
    """Where the header at ``at`` ends, -1 if it does not; a line that begins another record ends the search."""
    step = 1 << 16
    start = at
    while start < len(data):
        part = bytes(data[start : start + step + 3])
        found = part.find(b"\r\n\r\n")
        other = part.find(b"\nWARC/1.")
        if 0 <= found and (other < 0 or found < other):
            return start + found
        if other >= 0:
            return -1
        start += step - 8  # what is searched for may lie across the cut
    return -1


def parse(data: memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """(header, block, end) of the record at ``at``; ``Damaged`` if a check fails."""
    if data[at : at + len(VERSION)] not in VERSIONS:
        raise Damaged("version line")
    head_end = header_end(data, at) - at
    if head_end < 0:
        raise Damaged("header")
    header = {}
    # WARC/1.0 may fold a value over several lines
    for line in re.sub(rb"\r\n[ \t]+", b" ", bytes(data[at + len(VERSION) : at + head_end])).split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line")
        header[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if not header.get("content-length", "").isdigit():
        raise Damaged("length")
    start = at + head_end + 4
    end = start + int(header["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record end")
    block = bytes(data[start:end])
    digest = header.get("warc-block-digest", "")
    # other writers put digests in base 32
    if digest.startswith("sha1:") and digest[5:].upper() not in ((found := hashlib.sha1(block)).hexdigest().upper(), base64.b32encode(found.digest()).decode()):
        raise Damaged("block digest")
    return header, block, end + 4


def inflate(data: memoryview, at: int) -> tuple[bytes, int]:
    """The member at ``at`` and its end; checks the member's own CRC and length."""
    unpack, out = zlib.decompressobj(31), []
    while not unpack.eof:
        part = data[at : at + (1 << 16)]
        if not part:
            raise Damaged("member ends early")
        try:
            out.append(unpack.decompress(part))
        except zlib.error as e:
            raise Damaged(str(e)) from None
        at += len(part)
    return b"".join(out), at - len(unpack.unused_data)


def salvage(data: bytes) -> Iterator[tuple[str, object]]:
    """('record', (header, block)) of each sound record and ('gap', (start, end, reason)) between.

    Plain and compressed records may follow each other.
    """
    view, at, gap, reason = memoryview(data), 0, -1, ""
    while at < len(data):
        try:
            if data.startswith(GZIP, at):
                body, end = inflate(view, at)
                header, block, used = parse(memoryview(body), 0)
                if used != len(body):
                    raise Damaged("bytes after the record")
            else:
                header, block, end = parse(view, at)
        except Damaged as e:
            if gap < 0:
                gap, reason = at, str(e)
            found = [x for x in (data.find(GZIP, at + 1), data.find(b"WARC/1.", at + 1)) if x >= 0]
            at = min(found, default=len(data))
            continue
        if gap >= 0:
            yield "gap", (gap, at, reason)
            gap = -1
        yield "record", (header, block)
        at = end
    if gap >= 0:
        yield "gap", (gap, len(data), reason)


def with_references(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest and refers_to: the page whose record has the equal payload."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    big = rows.filter(F.octet_length("html") >= least_bytes)
    firsts = big.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1 AND response IS NOT NULL")
    # only repeated payloads are joined back, by a salt: copies without end are dealt over many tasks
    firsts = firsts.select("digest", "response", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = rows.join(firsts, ["digest", "salt"], "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives of ``with_references`` rows when run; file and records of each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        out, name, size, n = None, "", 0, 0

        def listed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns)):
                    if out is None:
                        name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = system.open_output_stream(f"{base}/{name}")
                    data = member(record(page_id, url, html.encode(), digest, refers_to))
                    out.write(data)
                    size, n = size + len(data), n + 1
                    if size >= FILE_BYTES:
                        yield listed()
                        out = None
        if out is not None:
            yield listed()

    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, "file string, records long")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, gap_start long, gap_end long, reason string, file string"


def read_archives(manifest: DataFrame, folder: str, partitions: int) -> DataFrame:
    """A row for each record, and one for each quarantined gap (with gap_start and gap_end)."""

    def page_of(value: str | None) -> int | None:
        found = re.fullmatch(r"<?urn:tallow:page:(-?\d+)>?", value or "")
        return int(found[1]) if found else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in READ.split(", ")]
        system, base = open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{base}/{name}") as f:
                    data = f.read()
                rows = []
                for kind, found in salvage(data):
                    if kind == "gap":
                        rows.append((None,) * 6 + found + (name,))
                        continue
                    header, block = found
                    kind, length = header.get("warc-type"), len(block)
                    digest = hashlib.sha1(block).hexdigest()
                    if kind == "revisit":  # other writers' revisits may not say these
                        digest = header["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in header else None
                        length = int(header["warc-payload-length"]) if header.get("warc-payload-length", "").isdigit() else None
                    rows.append((page_of(header.get("warc-record-id")), header.get("warc-target-uri"), length, digest, kind, page_of(header.get("warc-refers-to")), None, None, None, name))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    return manifest.select("file").repartition(partitions, "file").mapInArrow(read, READ)


def round_trip(spark: SparkSession, pages: DataFrame, quarantine: str | None = None) -> DataFrame:
    """Writes a record for each page and reads the archives back.

    Byte gaps that the reader had to leave out are written to ``quarantine`` (a Parquet folder;
    one beside the archives if none is given); the records that were recovered are returned.
    """
    scratch = Scratch(spark, "warc")
    folder = make_folder(scratch.path("archives"))
    manifest = scratch.table(write_archives(with_references(pages), folder), "manifest")
    back = scratch.table(read_archives(manifest, folder, shuffle_partitions(spark)), "records")
    gaps = back.filter("gap_start IS NOT NULL").select("file", "gap_start", "gap_end", "reason")
    gaps.write.mode("overwrite").parquet(quarantine or scratch.path("quarantine"))
    return back.filter("gap_start IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
