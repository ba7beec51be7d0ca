"""WARC archives: write pages with duplicates as revisits, and read archives back by a salvaging reader.

Spark's own text writer and binary reader move the bytes, so archives may lie in any store Spark reaches. Every record
is a gzip member of its own; the separator that the text writer sets after each row is an empty member.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import table
from timberline.session import fresh_path, stored

_MAGIC = b"\x1f\x8b\x08"
#: An empty gzip member: valid between members, and never empty itself as the writer asks of a separator.
_BETWEEN = gzip.compress(b"", mtime=0)
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_END = b"\r\n\r\n"


# ---- writing ---------------------------------------------------------------------------------------------------


def _head(fields: list[tuple[str, str]], length: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + _END


def _clean(value: str | None) -> str:
    """A header value on one line: controls, blanks and percent signs in percent form, undone by the reader."""
    return re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One record as a gzip member, from the payload and its hex digest. A revisit holds no payload but its digest, size and the record it refers to."""
    revisit = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", f"sha1:{base32(bytes.fromhex(sha1))}"),
        ("Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [
            ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
    body = b"" if revisit else payload
    return gzip.compress(_head(fields, len(body)) + body + _END, 1, mtime=0)


def mark_revisits(pages: DataFrame, page_id: str, html: str, min_bytes: int) -> DataFrame:
    """``page_id, url, payload, digest`` (hex) ``, refers_to``: of equal payloads the largest id is the response.

    Digests alone are grouped (combined before the shuffle) and joined back by page, so that neither a payload in a third
    of all rows nor its text meets in one task.
    """
    ready = pages.withColumn("_payload", F.coalesce(F.col(html), F.lit("")).cast("binary"))
    ready = ready.withColumns({"_digest": F.sha1("_payload"), "_size": F.octet_length("_payload")})
    narrow = stored(ready.select(F.col(page_id).alias("_page"), "_digest", "_size"), "digests")
    best = narrow.groupBy(F.col("_digest").alias("_of"), F.col("_size").alias("_bytes")).agg(F.max("_page").alias("_first"))
    told = narrow.distinct().join(best, (F.col("_digest") == F.col("_of")) & (F.col("_size") == F.col("_bytes")))
    told = told.filter((F.col("_page") < F.col("_first")) & (F.col("_bytes") >= min_bytes)).select("_page", "_of", "_bytes", "_first")
    marked = ready.join(
        told, (F.col(page_id) == F.col("_page")) & (F.col("_digest") == F.col("_of")) & (F.col("_size") == F.col("_bytes")), "left"
    )
    return marked.select(F.col(page_id).alias("page_id"), F.col("url"), F.col("_payload").alias("payload"), F.col("_digest").alias("digest"), F.col("_first").alias("refers_to"))


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, files: int | None = None) -> None:
    """One record per row of ``pages`` as gzip members in archives under ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the largest id is written as response
    and the others as revisits of it; smaller payloads are all responses. Rows that repeat id and payload are all
    responses if theirs is the largest id. Null text is an empty payload, a null url an empty address; a null
    id is written as ``None`` and is never referred to. Other columns are ignored. An empty table writes no record.
    """
    marked = mark_revisits(pages.select(page_id, F.col(url).alias("url"), html), page_id, html, min_bytes)

    # Arrow keeps ids as whole numbers, null or not.
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")))
            made = [record_bytes(*(x.as_py() for x in row)) for row in rows]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])

    if files:
        marked = marked.repartition(files)
    written = marked.mapInArrow(members, "member binary")
    # The text writer passes bytes on as they are; the separator is written in Latin-1, byte for byte.
    written.select(F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option(
        "lineSep", _BETWEEN.decode("latin-1")
    ).text(path)


# ---- reading ---------------------------------------------------------------------------------------------------


def _member(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int] | None:
    """The gzip member at ``at`` and its end, if it is whole and its check sum holds."""
    gz, out = zlib.decompressobj(31), []
    try:
        while not gz.eof:
            if at >= len(data):
                return None
            out.append(gz.decompress(data[at : at + step]))
            at += step
    except zlib.error:
        return None
    return b"".join(out), min(at, len(data)) - len(gz.unused_data)


def _sound_beginning(data: bytes, at: int) -> tuple[list[tuple[dict, bytes] | None], int]:
    """What can be saved of the damaged member at ``at``: responses in front of the damage whose digest holds, None for what lies between them, and where the last ends.

    Nothing else is taken: without the check sum of the whole member only a digest tells that a record is as it was.
    """
    gz, out, reached, step, begin = zlib.decompressobj(31), bytearray(), [], 1 << 12, at
    while at < len(data) and not gz.eof:
        before = gz.copy() if step > 1 else None
        try:
            out += gz.decompress(data[at : at + step])
        except zlib.error:
            if step == 1:
                break
            # Once more, byte by byte up to the one at which decoding fails.
            gz, step = before, 1
            continue
        at = min(at + step, len(data))
        reached.append((len(out), at))
    saved: list[tuple[dict, bytes] | None] = []
    last, end = 0, begin
    for _, stop, fields, block in _plain_records(bytes(out)):
        proven = fields is not None and fields.get("warc-type") == "response" and fields.get("warc-payload-digest", "").startswith("sha1:")
        saved.append((fields, block) if proven else None)
        if proven:
            last, end = len(saved), next(place for size, place in reached if size >= stop)
    return saved[:last], end


def _record(data: bytes, at: int) -> tuple[dict, bytes, int] | None:
    """The record at ``at``: its fields, its block and its end, if version line, head, length and ending hold."""
    if not _VERSION.match(data, at):
        return None
    stop = data.find(_END, at)
    if stop < 0:
        return None
    fields = {}
    for line in data[data.index(b"\r\n", at) + 2 : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit():
        return None
    begin = stop + 4
    end = begin + int(fields["content-length"])
    if data[end : end + 4] != _END:
        return None
    return fields, data[begin:end], end + 4


def _plain_records(data: bytes) -> Iterator[tuple[int, int, dict | None, bytes | None]]:
    """``begin, end, fields, block`` of records in plain bytes; gaps have no fields."""
    at = gap = 0
    while at < len(data):
        found = _record(data, at)
        if found and _sound(found[0], found[1]):
            if gap < at:
                yield gap, at, None, None
            yield at, found[2], found[0], found[1]
            at = gap = found[2]
            continue
        # The next version line may stand inside what the broken head claimed: search from the next byte.
        later = _VERSION.search(data, at + 1)
        at = later.start() if later else len(data)
    if gap < len(data):
        yield gap, len(data), None, None


def _sound(fields: dict, block: bytes) -> bool:
    """A response's block must have the digest that its head tells."""
    told = fields.get("warc-payload-digest", "")
    return fields.get("warc-type") != "response" or not told.startswith("sha1:") or told[5:] == base32(hashlib.sha1(block).digest())


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, bytes | None]]:
    """``begin, end, fields, block`` over an archive's bytes, gzip members or plain; gaps have no fields.

    After a failed check the search goes on at the next byte that begins a valid member or a version line. Records inside
    a gzip member carry the member's place. Of a damaged member the responses before the damage are saved, if their digest holds; what lay
    between them comes out as gaps of the same place. Bytes that nothing accounts for come out as gaps, so that all places
    together cover the file once.
    """
    at = gap = 0
    version = -1
    while at < len(data):
        member = _member(data, at) if data.startswith(_MAGIC, at) else None
        plain = None if member else _record(data, at)
        if plain and not _sound(plain[0], plain[1]):
            plain = None
        if member or plain:
            if gap < at:
                yield gap, at, None, None
            end = member[1] if member else plain[2]
            if plain:
                yield at, end, plain[0], plain[1]
            else:
                for _, _, fields, block in _plain_records(member[0]):
                    yield at, end, fields, block
            at = gap = end
            continue
        if data.startswith(_MAGIC, at):
            saved, end = _sound_beginning(data, at)
            if saved:
                if gap < at:
                    yield gap, at, None, None
                for one in saved:
                    yield at, end, *(one or (None, None))
                at = gap = end
                # The rest of the damaged member is searched from its first byte.
                if data.startswith(_MAGIC, at) or _VERSION.match(data, at):
                    continue
        if version <= at:
            line = _VERSION.search(data, at + 1)
            version = line.start() if line else len(data)
        magic = data.find(_MAGIC, at + 1, version)
        at = version if magic < 0 else magic
    if gap < len(data):
        yield gap, len(data), None, None


READ_SCHEMA = "file string, begin bigint, end bigint, record_type string, record_id string, url string, payload_digest string, payload_bytes bigint, refers_to string, block binary"


def read_warc(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """Records and quarantined gaps of all archives under ``path``, as ``READ_SCHEMA`` says.

    ``record_type`` is ``gap`` for bytes that no valid record accounts for: log or store them by file, begin and end. A file is
    the unit of work and is read whole, so archives should be kept to some hundred MB, as is usual; Spark's reader refuses files over 2 GB. Empty files give no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                out, size = [], 0
                for begin, end, f, block in salvage(bytes(data)):
                    if f is None:
                        out.append((name, begin, end, "gap", None, None, None, end - begin, None, None))
                    else:
                        told = f.get("payload-length", "")
                        url = re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), f.get("warc-target-uri", ""))
                        out.append(
                            (name, begin, end, f.get("warc-type"), f.get("warc-record-id"), url, f.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                             int(told) if told.isdigit() else len(block), f.get("warc-refers-to"), block if with_block else None)
                        )
                        size += len(block) if with_block else 100
                    if size > 4_000_000:
                        yield pd.DataFrame(out, columns=columns)
                        out, size = [], 0
                if out:
                    yield pd.DataFrame(out, columns=columns)

    columns = [c.split()[0] for c in READ_SCHEMA.split(", ")]
    return files.mapInPandas(rows, READ_SCHEMA)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    back = read_warc(spark, path, with_block=False)
    # An archive that was just written has no damaged stretch: one that turns up is an error that names it.
    damage = F.raise_error(F.concat_ws(" ", F.lit("damaged bytes in"), "file", "begin", "end"))
    return back.select(
        number("record_id").try_cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.when(F.col("record_type") == "gap", damage).otherwise(F.col("record_type")).alias("record_type"),
        number("refers_to").try_cast("bigint").alias("refers_to"),
    )


OP10_SQL = """
WITH RECURSIVE p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t) AS n, sha1(t) AS hex, max(page_id) OVER (PARTITION BY t) AS best FROM p),
b AS (SELECT *, list_reduce(list_transform(range(1, 41), lambda k: format('{:04b}', strpos('0123456789abcdef', substr(hex, CAST(k AS INTEGER), 1)) - 1)), lambda a, x: a || x) AS bits FROM d)
SELECT page_id, n AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(list_reduce(list_transform(range(1, 6), lambda j: CAST(substr(bits, CAST(k * 5 + j AS INTEGER), 1) AS INTEGER)), lambda a, x: a * 2 + x) + 1 AS INTEGER), 1)), lambda a, x: a || x) AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM b
"""
