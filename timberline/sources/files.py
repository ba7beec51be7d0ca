"""Log files as a table of physical lines, split at LF only.

A scan numbers lines per file split and adds split offsets, so one huge file is
read by many tasks. The scanned lines are stored once: row ids must not be computed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.functions import datetime as dt
from timberline.functions import encoding as enc
from timberline.operators.prefix import running
from timberline.session import small_side, stored
from timberline.sources import spans


def scan_log_lines(spark: SparkSession, paths: str | list[str], data_sources: DataFrame | None = None) -> DataFrame:
    """``path, line_no, raw_len, line_bytes, confirmed, utf8_bom, valid8, hit, hit_key, bytes``.

    ``bytes`` is the line without its LF and without one CR right before that LF;
    ``line_bytes`` counts the separator too. The last line of a file that does not end in LF
    is unconfirmed and keeps a trailing CR. Empty files have no rows.

    The text is read once and stored with everything later steps want to know about it (size, validity as UTF-8,
    date-time at its start), so they read narrow columns and leave ``bytes`` alone.

    With ``data_sources`` the lines carry ``source_id, label, config_pos`` in place of ``path``, as from
    :func:`scan_configured_sources`, without a second join.
    """
    read = spark.read.option("lineSep", "\n").text(paths).select(
        plain_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("row_id"),
        "value",
    )
    return placed_lines(read, data_sources)


def scan_ends(wanted: DataFrame, data_sources: DataFrame | None = None, direct: bool | None = None) -> DataFrame:
    """What :func:`scan_log_lines` gives, of files from a line's first byte on: ``wanted`` is ``path, start, size``.

    The file counts as ending at ``size``, whatever was appended since. ``line_no`` counts from that first line. Bytes before ``start`` are not read.
    """
    return placed_lines(spans.read_lines(wanted, direct=direct), data_sources)


def placed_lines(read: DataFrame, data_sources: DataFrame | None = None) -> DataFrame:
    """Lines as a reader gives them, ``path, file_size, split_start, row_id, value``, numbered and stored. Row ids follow the order inside a split."""
    raw = read.select(
        "path",
        "file_size",
        "split_start",
        "row_id",
        F.octet_length("value").alias("size"),
        F.endswith("value", F.lit("\r")).alias("ends_in_cr"),
        F.is_valid_utf8("value").alias("valid8"),
        "value",
    )
    marked = dt.mark(raw, "value")
    staged = stored(marked.withColumn("bytes", F.col("value").cast("binary")).drop("value"), "lines")
    splits, named = split_offsets(staged), ["path"]
    if data_sources is not None:
        splits, named = scan_configured_sources(splits, data_sources, keep_path=True), ["source_id", "label", "config_pos"]
    placed = staged.join(small_side(splits, 64, F.octet_length("path")), ["path", "split_start"])
    line_no = F.col("_line_base") + F.col("row_id") - F.col("_first_row") + 1
    # A separator was counted for every line and the reader drops a UTF-8 BOM, so the
    # difference to the file size tells both: 0 or 3 with a final LF, -1 or 2 without.
    open_tail = (F.col("line_no") == F.col("_lines")) & F.col("_gap").isin(-1, 2)
    lines = placed.withColumn("line_no", line_no).withColumn("confirmed", ~open_tail)
    lines = lines.filter(F.col("confirmed") | (F.col("size") > 0))
    strip = F.col("confirmed") & F.col("ends_in_cr")
    return lines.select(
        *named,
        "line_no",
        (F.col("size") - strip.cast("int")).alias("raw_len"),
        (F.col("size") + F.col("confirmed").cast("int")).alias("line_bytes"),
        "confirmed",
        F.col("_gap").isin(2, 3).alias("utf8_bom"),
        "valid8",
        "hit",
        "hit_key",
        F.when(strip, F.substring("bytes", F.lit(1), F.col("size") - 1)).otherwise(F.col("bytes")).alias("bytes"),
    )


def split_offsets(staged: DataFrame) -> DataFrame:
    """One row per file split: lines and bytes before it, and what the file's totals say about its ends."""
    splits = staged.groupBy("path", "split_start").agg(
        F.count("*").alias("_n"),
        F.sum(F.col("size").cast("bigint") + 1).alias("_bytes"),
        F.min("row_id").alias("_first_row"),
        F.max("file_size").alias("_file_size"),
    )
    whole = Window.partitionBy("path")
    before = whole.orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select(
        "path",
        "split_start",
        "_first_row",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_line_base"),
        F.sum("_n").over(whole).alias("_lines"),
        (F.col("_file_size") - F.sum("_bytes").over(whole)).alias("_gap"),
    )


def plain_path(path: Column) -> Column:
    """A path as people write it: percent escapes undone, and ``file:/x`` for ``file:///x``."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^([a-zA-Z][a-zA-Z0-9]*):///", "$1:/")


def qualified(spark: SparkSession, path: str) -> str:
    """The file system's own spelling of a path, whether or not a file is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(target).toString()


def file_status(spark: SparkSession, paths: list[str]) -> list[tuple[str, str | None, str | None, int | None, int | None]]:
    """``given, path, error, size, mtime`` (ms) of configured paths: the file system's own spelling, size and time, or why a file cannot be read.

    Nothing is opened. Of folders with many configured files the listing is asked for once, of others each file.
    """
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
    targets = [(given, jvm.Path(given)) for given in paths]
    listed: dict[str, dict[str, object]] = {}
    folders: dict[str, list] = {}
    for _, target in targets:
        if target.getParent() is not None:
            folders.setdefault(target.getParent().toString(), []).append(target)
    for folder, inside in folders.items():
        if len(inside) >= 16:
            try:
                some = inside[0].getFileSystem(conf).listStatus(inside[0].getParent())
                listed[folder] = {s.getPath().getName(): s for s in some}
            except Exception:  # each file is asked for then, and says why it cannot be read
                continue
    found = []
    for given, target in targets:
        folder = target.getParent().toString() if target.getParent() is not None else ""
        try:
            status = listed.get(folder, {}).get(target.getName()) or target.getFileSystem(conf).getFileStatus(target)
            found.append((given, status.getPath().toString(), None, status.getLen(), status.getModificationTime()))
        except Exception as error:  # whatever the store says, the other sources go on
            cause = getattr(error, "java_exception", None)
            reason = cause.getClass().getSimpleName() if cause is not None else type(error).__name__
            found.append((given, None, "NOT_FOUND" if reason == "FileNotFoundException" else f"UNREADABLE: {reason}", None, None))
    return found


def find_paths(spark: SparkSession, paths: list[str]) -> list[tuple[str, str | None, str | None, int | None]]:
    """``given, path, error, size`` of configured paths, as in :func:`file_status`."""
    return [found[:4] for found in file_status(spark, paths)]


def file_manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, size, mtime`` of every file, empty ones included; contents are not read.

    Empty files are known to the reader's listing alone; their times come from the file system.
    """
    paths = [paths] if isinstance(paths, str) else paths
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    filled = found.select(F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    listed = spark.createDataFrame([(p,) for p in found.inputFiles()], "path STRING").select(plain_path(F.col("path")).alias("path"))
    conf, empty = spark._jsparkSession.sessionState().newHadoopConf(), []
    for row in listed.join(filled.select("path"), "path", "left_anti").toLocalIterator():
        target = spark._jvm.org.apache.hadoop.fs.Path(row["path"])
        empty.append((row["path"], target.getFileSystem(conf).getFileStatus(target).getModificationTime()))
    times = spark.createDataFrame(empty, "path STRING, ms BIGINT")
    return filled.unionByName(times.select("path", F.lit(0).cast("bigint").alias("size"), F.timestamp_millis("ms").alias("mtime")))


def with_identity(manifest: DataFrame, lines: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Add ``file_id``, a hash over the finished lines of each file; NULL where there are none.

    With ``previous`` (``path, size`` as of the last look) only lines inside the former size count, so that a file that grew keeps its
    identity and one that was replaced does not, whatever its size and its first lines. A file that is shorter than before has no identity: it counts as
    shrunk.
    """
    ends = running(lines, ["path"], ["line_no"], {"_end": ("sum", F.col("line_bytes").cast("bigint"))})
    ends = ends.withColumn("_end", F.col("_end") + F.when(F.col("utf8_bom"), 3).otherwise(0)).filter("confirmed")
    if previous is not None:
        before = previous.select("path", F.col("size").alias("_size"))
        ends = ends.join(small_side(before, 16, F.octet_length("path")), "path", "left").filter("_size is null or _end <= _size")
    content = F.sum(F.xxhash64("line_no", "line_bytes", "bytes").cast("decimal(20,0)"))
    ids = ends.groupBy("path").agg(F.concat_ws(":", F.count("*"), content).alias("file_id"))
    named = manifest.join(ids, "path", "left")
    if previous is None:
        return named
    shorter = named.join(small_side(before, 16, F.octet_length("path")), "path", "left")
    return shorter.withColumn("file_id", F.when(F.coalesce(F.col("size") >= F.col("_size"), F.lit(True)), F.col("file_id"))).drop("_size")


def scan_configured_sources(lines: DataFrame, data_sources: DataFrame, keep_path: bool = False) -> DataFrame:
    """Lines of configured sources with ``source_id``, ``label`` and ``config_pos``.

    ``data_sources`` is ``source_id, config_pos, name, path``, paths as the reader reports them.
    """
    named = data_sources.select("path", "source_id", F.col("name").alias("label"), "config_pos")
    joined = lines.join(small_side(named, 24, F.octet_length("path") + F.octet_length("label"), few=True), "path")
    return joined if keep_path else joined.drop("path")


def line_positions(lines: DataFrame, bom_len: Column | None = None) -> DataFrame:
    """Add ``raw_offset``, the byte offset of each line in its source.

    Where the BOM belongs to the text (``bom_len`` 0) the first line starts at 0.
    """
    lead = F.when(F.col("utf8_bom"), F.lit(3)).otherwise(F.lit(0)) if bom_len is None else bom_len
    end = running(lines, ["source_id"], ["line_no"], {"_end": ("sum", F.col("line_bytes").cast("bigint"))})
    return end.withColumn("raw_offset", F.col("_end") - F.col("line_bytes") + lead).drop("_end")


def detect_encoding(lines: DataFrame, settings: DataFrame, default_codepage: int, detect_bytes: int | None = None) -> DataFrame:
    """Per source: ``encoding, codepage, route, bom_len, warning, error``.

    ``settings`` is ``source_id, encoding_name, ansi_codepage``, one row for every source, empty ones too.
    An explicit name wins over an explicit code page, then a BOM, then validity as UTF-8 of all
    lines or of the first ``detect_bytes``, then ``default_codepage``. :func:`bad_line_counts` tells a damaged line from a code page.
    """
    # A source without a single bad line needs no closer look.
    suspects = small_side(lines.filter(~F.col("valid8")).select("source_id").distinct(), row_bytes=8, few=True)
    head = lines.join(suspects, "source_id", "left_semi").select("source_id", "line_no", "line_bytes", "raw_len", "confirmed", "valid8")
    # The last line looked at may end inside a character: it is cut off by the end of the file or by the limit.
    if detect_bytes is None:
        room = F.col("raw_len")
        head = head.withColumn("_cut", ~F.col("confirmed"))
    else:
        # Every line takes at least one byte, so the window sees at most ``detect_bytes`` lines of a source.
        before = Window.partitionBy("source_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
        room = (F.lit(detect_bytes) - F.col("_at")).cast("int")
        head = (
            head.filter(F.col("line_no") <= detect_bytes)
            .withColumn("_at", F.coalesce(F.sum("line_bytes").over(before), F.lit(0)))
            .filter(F.col("_at") < detect_bytes)
            .withColumn("_cut", (room <= F.col("raw_len")) | ~F.col("confirmed"))
        )
    # Only a cut line that is not valid as a whole has to be looked at again; one per source at most.
    doubtful = head.filter(F.col("_cut") & ~F.col("valid8")).select("source_id", "line_no", room.alias("_room"))
    inside = F.substring("bytes", F.lit(1), F.least("_room", F.octet_length("bytes")))
    rescued = (
        lines.filter(~F.col("valid8"))
        .select("source_id", "line_no", "bytes")
        .join(small_side(doubtful, row_bytes=24, few=True), ["source_id", "line_no"])
        .select("source_id", enc.valid_utf8_head(inside).alias("_rescued"))
    )
    # The reader leaves a UTF-16 BOM in place; FF and FE never occur in UTF-8.
    first2 = F.hex(F.substring("bytes", 1, 2))
    utf16 = lines.filter(~F.col("valid8") & (F.col("line_no") == 1)).select("source_id", first2.isin("FFFE", "FEFF").alias("_bom16"))
    facts = (
        lines.filter(F.col("line_no") == 1)
        .select("source_id", F.col("utf8_bom").alias("_bom8"))
        .join(head.groupBy("source_id").agg(F.bool_and(F.col("valid8") | F.col("_cut")).alias("_fine")), "source_id", "left")
        .join(rescued, "source_id", "left")
        .join(utf16, "source_id", "left")
        .select(
            "source_id",
            "_bom8",
            "_bom16",
            (F.coalesce("_fine", F.lit(True)) & F.coalesce("_rescued", F.lit(True))).alias("_valid"),
        )
    )
    known = settings.join(facts, "source_id", "left").fillna(False, ["_bom8", "_bom16"]).fillna(True, ["_valid"])
    name = F.col("encoding_name")
    named_utf8 = F.lower(F.trim(name)) == "utf-8"
    is_named = name.isNotNull()
    explicit = is_named | F.col("ansi_codepage").isNotNull()
    page = (
        F.when(is_named, enc.named_codepage(name))
        .when(F.col("ansi_codepage").isNotNull(), F.col("ansi_codepage").cast("bigint"))
        .when(~F.col("_bom8") & ~F.col("_valid"), F.lit(default_codepage).cast("bigint"))
    )
    route = (
        F.when(is_named, "named_encoding")
        .when(explicit, "ansi_codepage")
        .when(F.col("_bom8"), "utf8_bom")
        .when(F.col("_bom16"), "utf16_bom")
        .when(F.col("_valid"), "utf8_valid")
        .otherwise("default_codepage")
    )
    known = known.withColumn("codepage", page).withColumn("route", route)
    error = (
        F.when(is_named & ~named_utf8 & F.col("codepage").isNull(), "INVALID_ENCODING_NAME")
        .when(F.col("route") == "utf16_bom", "UNSUPPORTED_UTF16")
        .when(F.col("codepage").isNotNull() & ~enc.known_codepage(F.col("codepage")), "UNKNOWN_CODEPAGE")
    )
    conflict = explicit & ((F.col("_bom8") & F.col("codepage").isNotNull()) | F.col("_bom16"))
    return known.select(
        "source_id",
        F.when(error.isNotNull(), F.lit(None)).when(F.col("codepage").isNull(), "utf-8").otherwise(
            F.concat(F.lit("windows-"), F.col("codepage").cast("string"))
        ).alias("encoding"),
        F.when(error.isNull(), F.col("codepage")).cast("int").alias("codepage"),
        "route",
        F.when(F.col("_bom8") & F.col("codepage").isNull() & error.isNull(), 3).otherwise(0).alias("bom_len"),
        F.when(conflict, "BOM_CONFLICT").alias("warning"),
        error.alias("error"),
    )


def bom_conflict(decided: DataFrame) -> DataFrame:
    """Sources whose BOM contradicts their explicit setting; the setting stands."""
    return decided.filter(F.col("warning") == "BOM_CONFLICT").select("source_id", "encoding", "route", "bom_len", "warning")


def reject_unsupported(lines: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of readable sources, and an error row for each of the others."""
    errors = decided.filter(F.col("error").isNotNull()).select("source_id", "error")
    return lines.join(small_side(errors.select("source_id"), row_bytes=8, few=True), "source_id", "left_anti"), errors


def decode_lines(lines: DataFrame, decided: DataFrame) -> DataFrame:
    """Add ``text`` and ``bad_at``, the offsets of undecodable stretches within the line.

    UTF-8 and pages of one byte a character are decoded in the JVM. Other pages, and the rare UTF-8 line with bad
    bytes, go through one Arrow function, which is in the plan only if some source may call for it.
    """
    readable = decided.filter(F.col("error").isNull()).select("source_id", "codepage", "bom_len")
    # One of some sixty pages, or none.
    pages = {r["codepage"] for r in readable.select("codepage").distinct().collect()}
    chosen = small_side(readable, row_bytes=24, few=True)
    joined = lines.join(chosen, "source_id")
    # Where the BOM is not skipped it is part of the text, but the reader has dropped it.
    bom_is_text = F.col("utf8_bom") & (F.col("bom_len") == 0) & (F.col("line_no") == 1)
    bom = F.unhex(F.lit("EFBBBF"))
    joined = joined.withColumns(
        {
            "bytes": F.when(bom_is_text, F.concat(bom, F.col("bytes"))).otherwise(F.col("bytes")),
            "raw_len": F.col("raw_len") + F.when(bom_is_text, 3).otherwise(0),
            "line_bytes": F.col("line_bytes") + F.when(bom_is_text, 3).otherwise(0),
            "hit": F.when(bom_is_text, 0).otherwise(F.col("hit")),
        }
    )
    data, page = F.col("bytes"), F.col("codepage")
    text, bad_at = enc.utf8_text(data), F.array().cast("array<bigint>")
    for known in sorted(p for p in pages if p is not None and p not in enc.WIDE_PAGES):
        here = F.coalesce(page == known, F.lit(False))
        text, bad_at = F.when(here, enc.page_text(data, known)).otherwise(text), F.when(here, enc.page_gaps(data, known)).otherwise(bad_at)
    if pages - {p for p in enc.PAGES if p not in enc.WIDE_PAGES}:
        needs_codec = F.when(page.isNull(), ~F.col("valid8")).otherwise(page.isin(*enc.WIDE_PAGES))
        joined = joined.withColumn("_decoded", enc.decode_codepage(F.when(needs_codec, data), F.coalesce(page, F.lit(65001))))
        text, bad_at = F.coalesce("_decoded.text", text), F.coalesce("_decoded.bad_at", bad_at)
    return joined.withColumns({"text": text, "bad_at": bad_at}).drop("_decoded", "codepage")


def invalid_byte_report(decoded: DataFrame) -> DataFrame:
    """A row per bad stretch of bytes: ``source_id, line_no, position`` in the file, and its source's ``invalid_count``."""
    bad = decoded.filter(F.size("bad_at") > 0)
    counts = bad.groupBy("source_id").agg(F.sum(F.size("bad_at").cast("bigint")).alias("invalid_count"))
    rows = bad.select("source_id", "line_no", "raw_offset", F.explode("bad_at").alias("_in_line"))
    return rows.join(small_side(counts, row_bytes=16, few=True), "source_id").select(
        "source_id", "line_no", (F.col("raw_offset") + F.col("_in_line")).alias("position"), "invalid_count"
    )


def bad_line_counts(lines: DataFrame) -> DataFrame:
    """``source_id, line_count, bad_lines``: how many lines are not valid UTF-8."""
    return lines.groupBy("source_id").agg(F.count("*").alias("line_count"), F.count_if(~F.col("valid8")).alias("bad_lines"))


def unconfirmed_tail(lines: DataFrame) -> DataFrame:
    """``path, line_count, unconfirmed_tail`` per file with lines."""
    key = "source_id" if "source_id" in lines.columns else "path"
    return lines.groupBy(key).agg(
        F.count("*").alias("line_count"), F.bool_or(~F.col("confirmed")).alias("unconfirmed_tail")
    )
