"""WARC archives: a writer with revisit records and a splittable reader.

Writing. Each record is a gzip member of its own. Spark's text sink writes the members: a member's last byte is the top
byte of its length, which is 0 below 16 MB, so the member goes out without it and with NUL as line end; a larger record
is followed by an empty member, which ends in 0 too. So the files are committed by Spark's own protocol to any file
system, and a lost executor leaves no half-written archive. Of records with equal payloads of at least
``least_revisit`` bytes, that with the largest page_id is a response; the others are revisits that refer to it.

Reading. The reader's tasks each get byte ranges of files. A task looks for gzip magic in its range, takes a candidate
for a member only if it inflates to a WARC version line and a full header, and owns the records whose members start
inside its range, also where they end beyond. After a record the next member's start is known; garbage between members
is skipped by searching on. Payload length and digest are computed from the bytes read and, for revisits, taken from
the headers.

Results for odd input: null html is an empty payload; null urls leave out the target header; rows that repeat the
largest page_id of a payload are all responses; null page_ids are written without an id and come back null; very long
pages are written and read whole; an empty table makes an archive without records. Only page_id, url and html are
stored: other columns, whatever their names, are not looked at, and the reader's columns are its own.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leverframe.llm.common import cut, join_grouped, scratch

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def member(data: bytes) -> bytes:
    """``data`` as one gzip member that ends in NUL (see above)."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out.endswith(b"\0") else out + EMPTY_MEMBER


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record, not yet compressed."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}:{digest}')}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, path: str, least_revisit: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes ``pages`` (page_id, url, html) as WARC files in the folder ``path``."""
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html"), F.sha1(body).alias("digest"), F.octet_length(body).alias("size"))
    groups = cut(rows.where(F.col("size") >= least_revisit).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    named = join_grouped(rows, groups, "digest", "n", rows.count())
    refers = F.when((F.col("size") >= least_revisit) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))

    @F.pandas_udf("binary")
    def members(page_id: pd.Series, url: pd.Series, html: pd.Series, digest: pd.Series, refers_to: pd.Series) -> pd.Series:
        return pd.Series([member(record(i, u, h.encode("utf-8", "surrogatepass"), d, r, date))[:-1] for i, u, h, d, r in zip(page_id, url, html, digest, refers_to, strict=True)], dtype=object)

    text = members(F.col("page_id").cast("string"), "url", "html", "digest", refers.cast("string")).cast("string")
    named.select(text.alias("value")).write.option("lineSep", "\x00").option("compression", "none").text(path)


def parse(data: bytes) -> tuple[dict[str, str], int] | None:
    """The headers of a record and where its block begins; None if this is no whole WARC header."""
    if not data.startswith(b"WARC/1."):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return (head, end + 4) if "warc-type" in head and head.get("content-length", "").isdigit() else None


class Source:
    """Bytes of one file from a moving window."""

    def __init__(self, file, size: int, step: int = 1 << 20):
        self.file, self.size, self.step, self.at, self.data = file, size, step, 0, b""

    def get(self, start: int, n: int) -> bytes:
        n = min(n, self.size - start)
        if start < self.at or start + n > self.at + len(self.data):
            self.file.seek(start)
            self.at, self.data = start, self.file.read(max(n, self.step))
        return self.data[start - self.at : start - self.at + n]


def inflate(source: Source, start: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at ``start`` and where it ends; None if no valid WARC member is there."""
    z, out, at, checked = zlib.decompressobj(31), [], start, False
    got = b""
    try:
        while not z.eof:
            chunk = source.get(at, 1 << 16)
            if not chunk:
                return None
            got = z.decompress(chunk)
            out.append(got)
            at += len(chunk)
            if not checked and sum(map(len, out)) >= 7:
                if not b"".join(out).startswith(b"WARC/1."):
                    return None
                checked = True
    except zlib.error:
        return None
    return b"".join(out), at - len(z.unused_data)


def records(source: Source, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of the records whose members start in [start, end)."""
    at = start
    while at < end:
        window = source.get(at, min(1 << 16, end - at) + len(MAGIC) - 1)
        hit = window.find(MAGIC)
        if hit < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += hit
        if at >= end:
            return
        found = inflate(source, at)
        parsed = parse(found[0]) if found else None
        if parsed is None:
            at += 1
            continue
        head, begin = parsed
        yield head, found[0][begin : begin + int(head["content-length"])]
        at = found[1]


def row(head: dict[str, str], block: bytes) -> tuple:
    """A record as the columns of ``RECORD``."""
    kind = head["warc-type"]
    payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
    number = lambda key: int(head[key]) if key in head else None
    if kind == "revisit":
        digest, size, payload = head.get("warc-payload-digest", "").removeprefix("sha1:"), number("x-payload-length"), None
    else:
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    return number("x-page-id"), head.get("warc-target-uri"), kind, digest, size, number("x-refers-to-page"), payload


def read(spark: SparkSession, path: str, split_bytes: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """The records of all WARC files under ``path`` (columns of ``RECORD``), by tasks that share out byte ranges.

    Files are listed by Spark (binaryFile, of which only path and length are read); ranges are opened in the tasks
    through the file system that the path's scheme names.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long")))
    ranges = files.select("path", "length", starts.alias("start"))
    n = max(1, ranges.count())
    ranges = ranges.repartition(min(n, 20_000), "path", "start")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, length, start in zip(frame["path"], frame["length"], frame["start"], strict=True):
                system, inner = fs.FileSystem.from_uri(name)
                with system.open_input_file(inner) as file:
                    rows, held = [], 0
                    for head, block in records(Source(file, length), start, min(length, start + split_bytes)):
                        rows.append(row(head, block) if with_payload else (*row(head, block)[:-1], None))
                        held += len(block)
                        if held > 4 << 20 or len(rows) >= 2000:
                            yield frame_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield frame_of(rows)

    return ranges.mapInPandas(run, RECORD)


def frame_of(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"])
    return out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame, least_revisit: int = 1000) -> DataFrame:
    """Writes ``pages`` to a new archive in the shared folder and reads it back."""
    path = scratch(pages.sparkSession, "warc")
    write(pages, path, least_revisit)
    return read(pages.sparkSession, path, with_payload=False)
