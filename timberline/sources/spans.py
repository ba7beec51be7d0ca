"""Byte ranges of files, read where they lie and without the rest of the file.

Spark's readers take whole files. Checking whether a file is still the one that was read, reading what was appended to it, and
fetching the lines of a page need a few ranges only. Ranges are rows; a task opens the file of each of its
rows and reads from there to there. Stores that only Spark's readers open are read through Spark's binary reader instead: whole
files then, up to its limit of 2 GB each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A task reads at most about so much of a range at a time, and ranges of lines are cut to this size.
STEP_BYTES = 8 << 20
CHUNK_BYTES = 64 << 20
#: What is compared at the head and at the end of a file.
PROBE_BYTES = 1 << 20
#: Stores that tasks open themselves, by the scheme of a path.
DIRECT = ("", "file", "s3", "gs", "hdfs")
RANGES = "path STRING, start BIGINT, stop BIGINT"


def scheme_of(path: str) -> str:
    head, colon, _ = path.partition(":")
    return head if colon and "/" not in head else ""


def _open(path: str) -> pa.NativeFile:
    """A file by its plain path, for reading at any place."""
    if scheme_of(path) in ("", "file"):
        return pa.OSFile("/" + path.removeprefix("file:").lstrip("/") if scheme_of(path) else path, "rb")
    from pyarrow.fs import FileSystem

    scheme, _, rest = path.partition(":")
    store, name = FileSystem.from_uri(f"{scheme}://{quote(rest.lstrip('/'))}")
    return store.open_input_file(name)


def over_ranges(ranges: DataFrame, work: Callable[[pa.NativeFile, dict], Iterator[pa.RecordBatch]], schema: str, direct: bool | None = None) -> DataFrame:
    """``work(file, row)`` for every row of ``ranges`` (``path, start, stop`` and more), in as many tasks as there are rows, up to some thousands.

    ``direct`` says whether tasks open files themselves; by default they do if the schemes of all paths are in ``DIRECT``.
    """
    spark = ranges.sparkSession
    if direct is None:
        schemes = ranges.select(F.regexp_extract("path", "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1).alias("s")).distinct().collect()
        direct = all(r["s"] in DIRECT for r in schemes)
    spread = ranges.repartition(max(1, min(ranges.count(), 4096)))
    if not direct:
        paths = [r["path"] for r in ranges.select("path").distinct().toLocalIterator()]
        if not paths:
            return spark.createDataFrame([], schema)
        whole = spark.read.format("binaryFile").load(paths).select("path", "content")
        spread = ranges.join(whole, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names if c != "content"}
                with pa.BufferReader(batch.column("content")[k].as_buffer()) if not direct else _open(row["path"]) as file:
                    yield from work(file, row)

    return spread.mapInArrow(run, schema)


# ---- identity ---------------------------------------------------------------------------------------------------


def probe_ranges(sizes: DataFrame, probe_bytes: int = PROBE_BYTES) -> DataFrame:
    """The head and the end of each file's first ``size`` bytes (``path, size``), one range where they meet; none of an empty file."""
    size, p = F.col("size"), F.lit(probe_bytes).cast("bigint")
    head, tail = F.struct(F.lit(0).cast("bigint").alias("start"), F.least(size, p).alias("stop")), F.struct((size - p).alias("start"), size.alias("stop"))
    both = F.when(size > 2 * p, F.array(head, tail)).otherwise(F.array(F.struct(F.lit(0).cast("bigint").alias("start"), size.alias("stop"))))
    return sizes.filter("size > 0").select("path", "size", F.explode(both).alias("r")).select("path", "size", "r.start", "r.stop")


def probe(ranges: DataFrame, direct: bool | None = None) -> DataFrame:
    """``path, start, stop, digest, bytes_read`` of ranges; a range that the file no longer has is without digest."""

    def work(file: pa.NativeFile, row: dict) -> Iterator[pa.RecordBatch]:
        sha, read = hashlib.sha1(), 0
        if file.size() >= row["stop"]:
            file.seek(row["start"])
            while read < row["stop"] - row["start"]:
                data = file.read(min(STEP_BYTES, row["stop"] - row["start"] - read))
                if not data:
                    break
                sha.update(data)
                read += len(data)
        whole = read == row["stop"] - row["start"]
        yield pa.RecordBatch.from_pylist([{**row, "digest": sha.hexdigest() if whole else None, "bytes_read": read}], schema=arrow)

    arrow = pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("digest", pa.string()), ("bytes_read", pa.int64())])
    return over_ranges(ranges.select("path", "start", "stop"), work, RANGES + ", digest STRING, bytes_read BIGINT", direct)


def identities(ranges: DataFrame, probed: DataFrame) -> DataFrame:
    """``path, size, file_id`` from the digests of :func:`probe_ranges`; NULL where a digest is missing. Empty files have no row."""
    parts = ranges.join(probed, ["path", "start", "stop"]).groupBy("path", "size")
    told = parts.agg(F.sort_array(F.collect_list(F.struct("start", "digest"))).alias("parts"), F.bool_and(F.col("digest").isNotNull()).alias("whole"))
    return told.select("path", "size", F.when(F.col("whole"), F.array_join(F.transform("parts", lambda p: p["digest"]), ":")).alias("file_id"))


# ---- lines ------------------------------------------------------------------------------------------------------


def lines_between(file: pa.NativeFile, start: int, stop: int, limit: int, at_line: bool, step: int = STEP_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """The lines that begin in ``[start, stop)``, with their LF, as ``number of the first, values`` per piece of the file.

    The file counts as ending at ``limit``. A range that does not begin ``at_line`` leaves its first line to the range before.
    """
    at = start if at_line else start - 1
    file.seek(at)
    rest, number, skip = b"", 0, not at_line
    while at < limit:
        data = file.read(min(step, limit - at))
        if not data:
            raise EOFError("a file is shorter than it was when it was listed")
        begin, at = at - len(rest), at + len(data)
        data = rest + data
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
        if at == limit and (not len(ends) or ends[-1] < len(data)):
            ends = np.append(ends, len(data))
        if skip and len(ends):
            begin, data, ends = begin + int(ends[0]), data[ends[0] :], ends[1:] - ends[0]
            skip = False
        elif skip:
            rest = b""
            continue
        # Lines that begin at or behind ``stop`` belong to the next range.
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        mine = int(np.searchsorted(starts + begin, stop))
        if mine:
            used = int(ends[mine - 1])
            offsets = pa.py_buffer(np.concatenate([[0], ends[:mine]]).astype(np.int32))
            yield number, pa.Array.from_buffers(pa.binary(), mine, [None, offsets, pa.py_buffer(data[:used])])
            number += mine
        if mine < len(ends) or (len(ends) and begin + int(ends[-1]) >= stop) or (not len(ends) and begin >= stop):
            return
        rest = data[int(ends[-1]) :] if len(ends) else data


def read_lines(wanted: DataFrame, chunk_bytes: int = CHUNK_BYTES, direct: bool | None = None) -> DataFrame:
    """Lines of ``wanted`` (``path, start, size``: from a line's first byte up to the size a file had) in the form that the file scan works on.

    ``path, file_size, split_start, row_id, value``: ``file_size`` counts from ``start``, ``row_id`` numbers the lines of a chunk, ``value`` has no LF.
    A BOM at the very beginning is dropped, as Spark's reader does.
    """
    chunk = F.lit(chunk_bytes).cast("bigint")
    cut = wanted.filter("size > start").select("path", F.col("start").alias("begin"), "size", F.explode(F.sequence(F.col("start"), F.col("size") - 1, chunk)).alias("start"))
    ranges = cut.withColumn("stop", F.least(F.col("start") + chunk, F.col("size")))

    def work(file: pa.NativeFile, row: dict) -> Iterator[pa.RecordBatch]:
        for number, values in lines_between(file, row["start"], row["stop"], row["size"], row["start"] == row["begin"]):
            n = len(values)
            path = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([row["path"]])).cast(pa.string())
            same = [pa.array(np.full(n, v, np.int64)) for v in (row["size"] - row["begin"], row["start"])]
            ids = pa.array(np.arange(number, number + n, dtype=np.int64))
            for k in range(0, n, 10_000):
                yield pa.RecordBatch.from_arrays([c.slice(k, 10_000) for c in (path, *same, ids, values)], names=["path", "file_size", "split_start", "row_id", "value"])

    read = over_ranges(ranges, work, "path STRING, file_size BIGINT, split_start BIGINT, row_id BIGINT, value BINARY", direct)
    ended = F.endswith(F.col("value"), F.lit(b"\n"))
    line = F.when(ended, F.substring("value", F.lit(1), F.octet_length("value") - 1)).otherwise(F.col("value"))
    bom = (F.col("split_start") == 0) & (F.col("row_id") == 0) & F.startswith(F.col("value"), F.lit(b"\xef\xbb\xbf"))
    plain = read.withColumn("value", line)
    return plain.withColumn("value", F.when(bom, F.substring("value", F.lit(4), F.octet_length("value"))).otherwise(F.col("value")).cast("string"))


def read_spans(spans: DataFrame, direct: bool | None = None) -> DataFrame:
    """``spans`` (``path, start, stop`` and more) with ``data``, their bytes: what a page's items are in their files. Meant for the rows of a page or a result."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([*spans.schema.fields, StructField("data", BinaryType())])
    arrow = to_arrow_schema(schema)

    def work(file: pa.NativeFile, row: dict) -> Iterator[pa.RecordBatch]:
        data = None
        if file.size() >= row["stop"]:
            file.seek(row["start"])
            data = file.read(row["stop"] - row["start"])
        yield pa.RecordBatch.from_pylist([{**row, "data": data}], schema=arrow)

    return over_ranges(spans, work, schema, direct)
