"""Log-shaped tables computed by Spark from the test tables, one row per line."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.functions.datetime import FORMATS
from timberline.operators.prefix import running
from timberline.plans import fixtures
from timberline.session import fresh_path, small_side, stored
from timberline.sources.files import plain_path

SOURCES = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stamp(ts_text: Column, fmt) -> Column:
    """Render ``yyyy-MM-dd HH:mm:ss[.ffffff]`` in one of the formats, with no time zone involved."""
    date = F.replace(F.substring(ts_text, 1, 10), F.lit("-"), F.lit(fmt.date_separator))
    time = F.substring(ts_text, 12, 8 if fmt.has_seconds else 5)
    shown = F.concat(date, F.lit(" "), time)
    if fmt.fraction_digits:
        micros = F.rpad(F.substring(ts_text, 21, 6), 6, "0")
        shown = F.concat(shown, F.lit(fmt.fraction_separator), F.substring(micros, 1, fmt.fraction_digits))
    return shown


def event_lines(spark: SparkSession, sf_dir: str, copies: int = 1) -> DataFrame:
    """``source_id, event_id, k, text``: six sources, one per format, with continuation lines.

    ``copies`` repeats the events with new ids, for measuring at more lines.
    """
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("string").alias("ts_text"), "user_id", "event_type", "value", "props"
    )
    if copies > 1:
        total = events.count()
        events = events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn(
            "event_id", F.col("event_id") + F.col("copy") * total
        )
    source = (F.col("user_id") % SOURCES).cast("int")
    stamp = None
    for index, fmt in enumerate(FORMATS):
        branch = (source == index, _stamp(F.col("ts_text"), fmt))
        stamp = F.when(*branch) if stamp is None else stamp.when(*branch)
    first = F.concat(
        stamp,
        F.lit(" "),
        "event_type",
        F.lit(" user="),
        F.col("user_id").cast("string"),
        F.lit(" v="),
        F.round(F.col("value") * 100).cast("bigint").cast("string"),
    )
    is_error = F.col("event_type") == "error"
    texts = F.array(
        first,
        F.when(is_error, F.concat(F.lit("  props "), "props")),
        F.when(
            is_error & (F.col("event_id") % 2 == 0),
            F.concat(F.lit("  at frame "), (F.col("event_id") % 7).cast("string")),
        ),
    )
    lines = events.select(source.alias("source_id"), "event_id", F.posexplode(texts).alias("k", "text"))
    preamble = spark.range(2).select(
        F.lit(0).alias("source_id"),
        F.lit(-1).cast("bigint").alias("event_id"),
        F.col("id").cast("int").alias("k"),
        F.concat(F.lit("-- preamble "), F.col("id").cast("string")).alias("text"),
    )
    return lines.filter(F.col("text").isNotNull()).unionByName(preamble)


def numbered(lines: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Give every row of ``key`` its ``line_no`` and ``raw_offset`` along ``order``, LF line ends assumed."""
    sized = lines.withColumn("raw_len", F.octet_length("text"))
    return running(
        sized,
        [key],
        order,
        {"line_no": ("sum", F.lit(1)), "_end": ("sum", F.col("raw_len").cast("bigint") + 1)},
    ).select(
        key,
        "line_no",
        (F.col("_end") - F.col("raw_len") - 1).alias("raw_offset"),
        "raw_len",
        "text",
        F.lit(True).alias("confirmed"),
    )


def log_lines(spark: SparkSession, sf_dir: str, copies: int = 1) -> DataFrame:
    """``source_id, line_no, raw_offset, raw_len, text, confirmed`` derived from ``events``."""
    return numbered(event_lines(spark, sf_dir, copies), "source_id", ["event_id", "k"])


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` split at LF; one source per document."""
    split = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("source_id"), F.posexplode(F.split("text", "\n")).alias("k", "text")
    )
    return split.select(
        "source_id", (F.col("k") + 1).cast("bigint").alias("line_no"), "text"
    )


def source_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_id, label, source_ordinal`` of the sources in :func:`log_lines`; display order differs from id order."""
    ids = table(spark, sf_dir, "events").select((F.col("user_id") % SOURCES).cast("int").alias("source_id")).distinct()
    return ids.select(
        "source_id",
        F.concat(F.lit("app-"), F.col("source_id").cast("string")).alias("label"),
        ((F.col("source_id") * 5 + 2) % SOURCES).cast("int").alias("source_ordinal"),
    )


def from_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run one of the SELECTs of ``fixtures`` over the given tables."""
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in names})


def path_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, fixtures.PATH_CASES)


def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, fixtures.PROFILE_TABLE)


def big_profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, fixtures.BIG_PROFILE_TABLE)


def source_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return from_sql(spark, sf_dir, fixtures.CONFIGURED_LIST), from_sql(spark, sf_dir, fixtures.OPENED_LIST)


def physical_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return from_sql(spark, sf_dir, fixtures.PHYSICAL_FILES), from_sql(spark, sf_dir, fixtures.OPEN_FILES)


def catalog_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return from_sql(spark, sf_dir, fixtures.CATALOG_CONFIGURED), from_sql(spark, sf_dir, fixtures.CATALOG_OPENED)


def datetime_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, fixtures.DATETIME_CASES)


def format_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, fixtures.FORMAT_SETTINGS)


def typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, fixtures.TYPED_ROWS)


def order_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, fixtures.ORDER_RANGES)


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, fixtures.ORDER_ROWS)


def part_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, fixtures.PART_RANGES)


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return from_sql(spark, sf_dir, fixtures.MANIFEST_OLD), from_sql(spark, sf_dir, fixtures.MANIFEST_NEW)


def supplier_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, fixtures.SUPPLIER_STATUS)


def status_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All event sources loaded, first generation."""
    return source_table(spark, sf_dir).select(
        "source_id", F.lit(1).cast("bigint").alias("generation"), F.lit("Loaded").alias("status"), F.lit(None).cast("string").alias("change_kind")
    )


def grown_sources(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines as they were, and manifests before and now: sources 1 and 5 grew, 2 shrank, 3 was replaced, 4 deleted."""
    totals = small_side(lines.groupBy("source_id").agg(F.max("line_no").alias("_all")), row_bytes=16)
    half = F.when(F.col("source_id").isin(1, 5), F.shiftright("_all", 1)).otherwise(F.col("_all"))
    before = lines.join(totals, "source_id").filter(F.col("line_no") <= half).drop("_all")

    def manifest(of: DataFrame) -> DataFrame:
        size = F.max(F.col("raw_offset") + F.col("raw_len") + 1)
        return of.groupBy("source_id").agg(size.alias("size")).withColumn("file_id", F.concat(F.lit("f"), "source_id"))

    now = manifest(lines).filter(F.col("source_id") != 4)
    now = now.withColumn("size", F.col("size") - (F.col("source_id") == 2).cast("int"))
    now = now.withColumn("file_id", F.when(F.col("source_id") == 3, "other").otherwise(F.col("file_id")))
    return before, manifest(before), now


# --- files written from the tables, so that the file source has something to read

FILE_LINES = 1 << 16


def _by_file(lines: DataFrame) -> DataFrame:
    return lines.withColumn("file_no", F.shiftright(F.col("line_no") - 1, 16))


def _write_files(spark: SparkSession, lines: DataFrame, folders: list[str], order: list[str], **options: str) -> str:
    """One text file per folder, lines in order."""
    root = fresh_path(spark, "files")
    placed = lines.repartition(*folders).sortWithinPartitions(*folders, *order)
    placed.select(*folders, "text").write.options(**options).partitionBy(*folders).text(root)
    return root


def write_event_files(spark: SparkSession, sf_dir: str) -> str:
    """Event lines as files of at most 65,536 lines; source 5 has CR LF line ends."""
    lines = _by_file(log_lines(spark, sf_dir))
    text = F.when(F.col("source_id") == 5, F.concat("text", F.lit("\r"))).otherwise(F.col("text"))
    return _write_files(spark, lines.withColumn("text", text), ["source_id", "file_no"], ["line_no"], lineSep="\n")


def write_open_files(spark: SparkSession, sf_dir: str) -> str:
    """Event lines with a separator that leaves an unfinished last line, ``# ``."""
    lines = _by_file(log_lines(spark, sf_dir))
    return _write_files(spark, lines, ["source_id", "file_no"], ["line_no"], lineSep="\n# ")


def file_source_id(path: Column) -> Column:
    part = [F.regexp_extract(path, name + "=([0-9]+)/", 1).cast("int") for name in ("source_id", "file_no")]
    return (part[1] * SOURCES + part[0]).cast("int")


def configured_from_paths(paths: DataFrame) -> DataFrame:
    """A configured source for each file but those with an id of 3 modulo 4."""
    named = paths.withColumn("source_id", file_source_id(F.col("path"))).filter(F.col("source_id") % 4 != 3)
    return named.select(
        "path", "source_id", (F.col("source_id") * 2).alias("config_pos"), F.concat(F.lit("app-"), F.col("source_id").cast("string")).alias("name")
    )


ENCODED_KINDS = 7


def encoded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines in sources of seven kinds, as bytes in ``text``; each source holds part of 4,096 documents.

    0 UTF-8; 1 Latin-1; 2 UTF-8 with BOM; 3 Latin-1; 4 ASCII with UTF-8 BOM; 5 UTF-16 BOM; 6 Latin-1.
    """
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.shiftright("doc_id", 12) * ENCODED_KINDS + F.col("doc_id") % ENCODED_KINDS).cast("int").alias("source_id"),
        F.posexplode(F.split("text", "\n")).alias("k", "text"),
    )
    kind = F.col("source_id") % ENCODED_KINDS
    first = F.row_number().over(Window.partitionBy("source_id").orderBy("doc_id", "k")) == 1

    def only(allowed: str) -> Column:
        return F.regexp_replace("text", f"[^{allowed}]", "?")

    latin = only(r"\x{01}-\x{7f}\x{c0}-\x{ff}")
    data = (
        F.when(kind.isin(1, 3, 6), F.encode(latin, "ISO-8859-1"))
        .when(kind.isin(4, 5), F.encode(only(r"\x{01}-\x{7f}"), "UTF-8"))
        .otherwise(F.encode("text", "UTF-8"))
    )
    lead = F.when(first & kind.isin(2, 4), F.unhex(F.lit("EFBBBF"))).when(first & (kind == 5), F.unhex(F.lit("FFFE")))
    return docs.withColumn("text", F.concat(F.coalesce(lead, F.unhex(F.lit(""))), data).cast("string"))


def write_growing_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Event lines as files of at most 65,536 lines, as they were and as they are: of sources 1 modulo 3 the first half of the lines, then all."""
    lines = _by_file(log_lines(spark, sf_dir))
    lines = stored(lines.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("source_id", "file_no"))), "growing")
    place = (F.col("line_no") - 1) % FILE_LINES + 1
    grows = (F.col("file_no") * SOURCES + F.col("source_id")) % 3 == 1
    was = lines.filter(~grows | (place <= F.shiftright("n", 1)))
    return tuple(_write_files(spark, some, ["source_id", "file_no"], ["line_no"], lineSep="\n") for some in (was, lines))


def sources_in(spark: SparkSession, root: str) -> DataFrame:
    """A configured source for each file under ``root``."""
    paths = spark.read.text(root).select(plain_path(F.col("_metadata.file_path")).alias("path")).distinct()
    number = file_source_id(F.col("path"))
    return paths.select("path", number.alias("source_id"), number.alias("config_pos"), F.concat(F.lit("app-"), number.cast("string")).alias("name"))


def write_encoded_files(spark: SparkSession, sf_dir: str) -> str:
    return _write_files(spark, encoded_lines(spark, sf_dir), ["source_id"], ["doc_id", "k"], lineSep="\n")


def encoded_source_id(path: Column) -> Column:
    return F.regexp_extract(path, "source_id=([0-9]+)/", 1).cast("int")


def encoding_settings(sources: DataFrame) -> DataFrame:
    """Kinds 1 and 4 name windows-1252, the former by number; kind 6 names UTF-8; the others leave it open."""
    kind = F.col("source_id") % ENCODED_KINDS
    return sources.select(
        "source_id",
        F.when(kind == 4, "windows-1252").when(kind == 6, "UTF-8").alias("encoding_name"),
        F.when(kind == 1, 1252).alias("ansi_codepage"),
    )


def configured_from_folders(paths: DataFrame) -> DataFrame:
    """A configured source for each file under ``source_id=<n>``."""
    number = F.regexp_extract("path", "source_id=([0-9]+)/", 1).cast("int")
    return paths.select(
        "path", number.alias("source_id"), number.alias("config_pos"), F.concat(F.lit("app-"), number.cast("string")).alias("name")
    )
