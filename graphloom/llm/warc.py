"""WARC archives: a writer that revisits equal payloads, and a salvage reader.

The writer makes one gzip member per record and lets Spark's text sink put them behind each other, so that any store
and Spark's commit protocol serve. The reader checks every member and record; where a check fails it searches for the
next member or version line from which a whole record can be read, goes on there, and reports the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import warnings
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import fresh_path, written

MAGIC, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r\n")
#: An empty gzip member but for its last byte.
_EMPTY = bytes.fromhex("1f8b08000000000000ff0300") + bytes(7)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed when it holds so many bytes. A task reads one whole, and Spark's reader takes 2 GB at most.
ARCHIVE_BYTES = 64 << 20


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header value without line breaks."""
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(page_id, uri: str | None, payload: bytes, first, revisit: bool, date: str) -> bytes:
    """One WARC record. A revisit has the HTTP headers of the whole payload, but not the payload."""
    name = lambda x: f"<urn:page:{'null' if x is None else int(x)}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_line(uri)}")
    if revisit:
        head += [f"WARC-Refers-To: {name(first)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{_sha1(payload)}", f"WARC-Block-Digest: sha1:{_sha1(block)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte (an empty member may follow for that), without this byte."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress(record) + pack.flush()
    return out[:-1] if out[-1] == 0 else out + _EMPTY


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "2025-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per row of `pages` (page_id, url, html) below `path`.

    The payload is the html in UTF-8; null is empty. Of equal payloads of at least `min_revisit_bytes` the row with
    the smallest page_id is a response, the others revisit it. A null page_id comes after all others; rows that
    repeat the first row's page_id are responses too, as they are that record. Popular payloads are found from digests
    by partial aggregation; the join that follows can split a hot digest, as its other side has one row for each.
    An archive (a file below `archive=N/`) ends after `archive_bytes` and the record that crosses them. An empty table
    leaves a folder without archives; long payloads are one record each; other columns are not read.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"), F.max(F.octet_length("payload")).alias("size"))
    firsts = firsts.where(f"n > 1 and size >= {int(min_revisit_bytes)}").select("digest", "first", F.lit(True).alias("again"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = lambda x: None if pd.isna(x) else x
        held = 0
        for b in batches:
            made, archive = [], []
            for i, u, p, f, r in zip(b.page_id, b.url, b.payload, b["first"], b.revisit, strict=True):
                one = member(record_bytes(none(i), u, p, none(f), bool(r), date))
                made.append(one)
                archive.append(held // archive_bytes)
                held += len(one) + 1
            yield pd.DataFrame({"archive": archive, "value": made})

    joined = rows.join(firsts, "digest", "left")
    revisit = F.coalesce(F.col("again"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    ready = joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "payload", F.col("first").cast("long").alias("first"), revisit.alias("revisit"))
    made = ready.mapInPandas(build, "archive long, value binary").select("archive", F.col("value").cast("string").alias("value"))
    made.write.partitionBy("archive").option("lineSep", "\u0000").text(path)


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """The header fields of the record at `at` and where its block begins."""
    if not VERSION.match(data, at):
        return None
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    fields = {}
    for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4


def _record(data: bytes, at: int) -> tuple[dict, int] | None:
    """The record at `at` if every check holds, and where it ends."""
    if (found := _headers(data, at)) is None:
        return None
    fields, begin = found
    if not re.fullmatch(r"\d+", fields.get("content-length", "")):
        return None
    end = begin + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    block = data[begin:end]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{_sha1(block)}":
        return None
    http, blank, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    kind = fields.get("warc-type")
    size = len(payload)
    if kind == "revisit":
        declared = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size = int(declared[1]) if declared else None
    elif "warc-payload-digest" in fields and fields["warc-payload-digest"] != f"sha1:{_sha1(payload)}":
        return None
    return {"type": kind, "fields": fields, "payload": payload, "payload_bytes": size}, end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """What can be inflated of the gzip member at `at`, where its bytes end, and whether it is whole."""
    view, parts, unpack, step = memoryview(data), [], zlib.decompressobj(31), 65536
    while not unpack.eof:
        if at >= len(data):
            return b"".join(parts), len(data), False
        before = unpack.copy()
        try:
            parts.append(unpack.decompress(view[at : at + step]))
        except zlib.error:  # what lies before the fault in this stretch counts, so it is taken in ever smaller steps
            if step == 1:
                return b"".join(parts), at, False
            unpack, step = before, max(1, step // 16)
            continue
        at += step
    return b"".join(parts), min(at, len(data)) - len(unpack.unused_data), True


def _plain(data: bytes) -> Iterator[tuple[str, int, int, dict | str]]:
    """Records and gaps of bytes that are not compressed."""
    at = 0
    while at < len(data):
        if got := _record(data, at):
            yield "record", at, got[1], got[0]
            at = got[1]
            continue
        begin, next_at = at, None
        for found in VERSION.finditer(data, at + 1):
            if _record(data, found.start()):
                next_at = found.start()
                break
        at = len(data) if next_at is None else next_at
        yield "gap", begin, at, "no valid record"


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict | str]]:
    """("record", begin, end, record) and ("gap", begin, end, reason) that together cover all bytes of an archive.

    Begin and end are places in the archive's bytes; those of a record in a whole member are the member's. A member that
    is cut or does not inflate to its end is searched for whole records: they have the bytes that were read until they
    were complete, only the other bytes up to the next member or version line are a gap. Empty members are padding.
    """
    at, bad, why = 0, None, ""
    while at < len(data):
        found = None
        if data.startswith(MAGIC, at):
            content, end, whole = _inflate(data, at)
            inside = list(_plain(content))
            if whole and (not content or any(k == "record" for k, *_ in inside)):
                found = [(k, at, end, x) for k, _, _, x in inside], end
            else:
                why = why or ("no valid record in the member" if whole else "broken gzip member")
                if any(k == "record" for k, *_ in inside):
                    if bad is not None and bad < at:
                        yield "gap", bad, at, why
                    end = _ahead(data, at + 1)
                    for (kind, _, _, x), to in zip(inside, _read_for(data, at, end, [e for _, _, e, _ in inside]), strict=True):
                        if kind == "record" or at < to:
                            yield kind, at, to, x
                        at = to
                    if at < end:
                        yield "gap", at, end, "broken gzip member"
                    at, bad, why = end, None, ""
                    continue
        elif data.startswith(b"WARC/1.", at) and (got := _record(data, at)):
            found = [("record", at, got[1], got[0])], got[1]
        if found:
            if bad is not None:
                yield "gap", bad, at, why or "no member or version line"
                bad, why = None, ""
            yield from found[0]
            at = found[1]
            continue
        bad = at if bad is None else bad
        at = _ahead(data, at + 1)
    if bad is not None:
        yield "gap", bad, len(data), why or "no member or version line"


def _read_for(data: bytes, at: int, end: int, wanted: list[int], step: int = 1) -> list[int]:
    """How far a member that begins at `at` is read until its content has each of the wanted lengths; `end` at most."""
    inflater, length, found = zlib.decompressobj(31), 0, []
    for begin in range(at, end, step):
        if len(found) == len(wanted):
            break
        try:
            length += len(inflater.decompress(data[begin : min(begin + step, end)]))
        except zlib.error:
            break
        while len(found) < len(wanted) and length >= wanted[len(found)]:
            found.append(min(begin + step, end))
    return found + [end] * (len(wanted) - len(found))


def _ahead(data: bytes, at: int) -> int:
    """The next place that looks like a member or a version line."""
    return min((x for x in (data.find(MAGIC, at), data.find(b"WARC/1.", at)) if x >= 0), default=len(data))


FOUND = (
    "archive string, kind string, begin long, end long, reason string, record_type string, record_id string, uri string, "
    "refers_to string, payload_digest string, payload_bytes long, payload binary"
)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records and gaps of the archives below `path` (`kind` is record or gap; a gap has `reason`).

    `payload_digest` is that of the payload read; a revisit's digest and size are those it declares. A task holds one
    archive at a time, so archives should stay well below an executor's memory; the writer's do. No archive: no rows.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.split()[0] for f in FOUND.split(", ")]
        for batch in batches:
            for where, content in zip(batch.path, batch.content, strict=True):
                rows, held = [], 0
                for kind, begin, end, x in salvage(content):
                    if kind == "gap":
                        rows.append((where, kind, begin, end, x, None, None, None, None, None, None, None))
                    else:
                        f = x["fields"]
                        digest = f.get("warc-payload-digest", "").removeprefix("sha1:") if x["type"] == "revisit" else _sha1(x["payload"])
                        rows.append((where, kind, begin, end, None, x["type"], f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-refers-to"), digest, x["payload_bytes"], x["payload"] if payloads else None))
                        held += len(x["payload"]) if payloads else 100
                    if held > 1 << 23:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(read, FOUND)


def log_gaps(found: DataFrame, path: str) -> int:
    """Write the quarantined byte ranges (archive, begin, end, reason) below `path` as Parquet; how many there are."""
    found.where("kind = 'gap'").select("archive", "begin", "end", "reason").write.mode("append").parquet(path)
    return found.sparkSession.read.parquet(path).count()


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder, read them back: one row per record, as op1 returns it.

    Bytes that could not be read are logged beside the archives (`gaps`), and a warning says how many ranges there are.
    An empty table gives an empty result; cases of rows are as in `write_warc`.
    """
    path = fresh_path(pages.sparkSession, "warc")
    write_warc(pages, f"{path}/archives")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
    found = written(read_warc(pages.sparkSession, f"{path}/archives", payloads=False), "records")
    if gaps := log_gaps(found, f"{path}/gaps"):
        warnings.warn(f"{gaps} byte ranges of the archives could not be read; see {path}/gaps", stacklevel=2)
    back = found.where("kind = 'record'")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


#: DuckDB twin of op1: base32 from the digest's hexadecimal digits.
OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
b AS (
  SELECT p.page_id, strlen(p.html) AS payload_bytes, first,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(1 + ((('0x' || substr(hex, CAST(1 + 10 * (i // 8) AS INT), 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS BIGINT)) % 32) AS INT), 1)), 'string_agg', '') AS payload_digest
  FROM p JOIN f ON p.html = f.html
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
