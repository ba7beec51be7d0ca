"""Opening log files end to end: lines, encodings, profiles, formats, items and the quality summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions import datetime as dt
from timberline.functions import encoding as enc
from timberline.operators import assemble, changes, profiles, summary
from timberline.session import held, small_side, stored
from timberline.sources import files, spans, store


@dataclass
class OpenedLogs:
    """What opening a set of sources gives."""

    lines: DataFrame  # all physical lines with bytes, by source
    items: DataFrame  # item index
    formats: DataFrame  # source_id, format, route, fell_back
    encodings: DataFrame
    resolved: DataFrame
    errors: DataFrame
    line_items: DataFrame  # source_id, line_no, seq
    sizes: DataFrame  # source_id, size

    def summary(self) -> DataFrame:
        """One row per source."""
        return summary.source_summary(self.items, self.formats, self.encodings, self.resolved, self.invalid(), self.sizes)

    def invalid(self) -> DataFrame:
        """``source_id, invalid_count`` of sources with bad bytes."""
        readable, _ = files.reject_unsupported(self.lines, self.encodings)
        decoded = files.decode_lines(_split(readable, self.encodings)[1], self.encodings).filter(F.size("bad_at") > 0)
        return decoded.groupBy("source_id").agg(F.sum(F.size("bad_at").cast("bigint")).alias("invalid_count"))

    def resume_points(self) -> DataFrame:
        """Per source what reading on from its last item needs, the columns of ``RESUME``: how it is decoded and parsed, and where that item begins."""
        return _resume_points(self.encodings, self.formats, self.items)

    def item_lines(self) -> DataFrame:
        """Bodies as ordered lines, ``source_id, seq, line_no, text``: what search, extracts and ``assemble.bodies`` read.

        The text meets the stored item numbers by line, and stays where a filter drops it.
        """
        text = _decoded(self.lines, self.encodings).select("source_id", "line_no", "text")
        return text.join(self.line_items, ["source_id", "line_no"]).select("source_id", "seq", "line_no", "text")


def open_logs(
    spark: SparkSession,
    data_sources: DataFrame,
    profile_table: DataFrame | None = None,
    default_codepage: int = 1252,
    sizes_seen: DataFrame | None = None,
) -> OpenedLogs:
    """Open ``data_sources`` (``source_id, name, path, config_pos`` and optionally ``manual_profile, manual_format``).

    With ``sizes_seen`` (``source_id, size``) a file counts as ending there, whatever it has grown by since.

    ``path`` is a file's plain path. The list of paths is what the driver hands to the reader. A source that cannot be read becomes a row of
    ``errors`` and does not stop the others.
    """
    for column in ("manual_profile", "manual_format"):
        if column not in data_sources.columns:
            data_sources = data_sources.withColumn(column, F.lit(None).cast("string"))
    data_sources = held(data_sources, "sources")
    found = files.find_paths(spark, [r["path"] for r in data_sources.select("path").distinct().toLocalIterator()])
    known = spark.createDataFrame(found, "path STRING, _found STRING, _error STRING, size BIGINT")
    data_sources = held(data_sources.join(known, "path", "left"), "found")
    unread = data_sources.filter("_error is not null").select("source_id", F.col("_error").alias("error"))
    data_sources = data_sources.filter("_error is null").withColumn("path", F.col("_found")).drop("_found", "_error")
    sizes = data_sources.select("source_id", "size")
    data_sources = data_sources.drop("size")
    paths = [path for _, path, _, _ in found if path]
    if sizes_seen is None:
        lines = files.scan_log_lines(spark, paths, data_sources)
    else:
        sizes = sizes_seen.join(data_sources.select("source_id"), "source_id", "left_semi").select("source_id", "size")
        seen = data_sources.join(sizes, "source_id").select("path", F.lit(0).cast("bigint").alias("start"), "size")
        lines = files.scan_ends(seen, data_sources)
    if profile_table is None:
        resolved = data_sources.select(
            "source_id", F.lit("no_match").alias("route"), F.lit(None).cast("string").alias("profile_name")
        )
        settings = resolved.select(
            "*",
            *[F.lit(None).cast(t).alias(n) for n, t in (("profile_format", "string"), ("encoding_name", "string"), ("ansi_codepage", "int"))],
            F.lit(False).alias("profile_unresolved"),
        )
    else:
        profiles.require_valid(profile_table)
        resolved = held(profiles.resolve_profile(data_sources, profile_table), "resolved")
        settings = held(profiles.profile_settings(resolved, profile_table), "settings")
    decided = held(files.detect_encoding(lines, settings, default_codepage), "encodings")
    readable, errors = files.reject_unsupported(lines, decided)
    # Stored narrow: format choice and both passes of the assembly read it, not the lines and their joins.
    narrow = stored(_sized(readable, decided), "marked")
    inferred = assemble.infer_source_format(narrow)
    wanted = settings.join(data_sources.select("source_id", "manual_format"), "source_id")
    formats = held(assemble.format_route(wanted, inferred), "formats")
    numbered = _numbered(narrow, formats)
    parts = assemble.item_parts(numbered)
    line_items = numbered.select("source_id", "line_no", "seq")
    return OpenedLogs(lines, assemble.items_of_parts(parts), formats, decided, resolved, errors.unionByName(unread), line_items, sizes)


#: What a snapshot may carry besides, so that a reload can read on where the last one ended.
RESUME = ("encoding", "codepage", "encoding_route", "bom_len", "warning", "error", "format", "format_route", "fell_back", "last_seq", "last_line", "last_offset")


def _resume_points(encodings: DataFrame, formats: DataFrame, items: DataFrame) -> DataFrame:
    last = items.groupBy("source_id").agg(F.max(F.struct("seq", "first_line", "raw_offset")).alias("last"))
    decoded = encodings.select("source_id", "encoding", "codepage", F.col("route").alias("encoding_route"), "bom_len", "warning", "error")
    parsed = formats.select("source_id", "format", F.col("route").alias("format_route"), "fell_back")
    return decoded.join(parsed, "source_id").join(last, "source_id", "left").select(
        "source_id", *RESUME[:-3], F.col("last.seq").alias("last_seq"), F.col("last.first_line").alias("last_line"), F.col("last.raw_offset").alias("last_offset")
    )


def _seen(spark: SparkSession, data_sources: DataFrame, before: DataFrame | None, probe_bytes: int, direct: bool | None) -> DataFrame:
    """``source_id, path, size, mtime, file_id, inside_id`` of the files that are there; ``inside_id`` is the identity within the former size. Stored."""
    given = [r["path"] for r in data_sources.select("path").distinct().toLocalIterator()]
    there = [(g, path, size, mtime) for g, path, _, size, mtime in files.file_status(spark, given) if path]
    known = spark.createDataFrame(there, "path STRING, _path STRING, size BIGINT, _ms BIGINT")
    now = held(data_sources.select("source_id", "path").join(known, "path").select("source_id", F.col("_path").alias("path"), "size", F.timestamp_millis("_ms").alias("mtime")), "listed")
    # A file is looked at within its size and, to tell whether it is still the same, within its former size; where these agree, once.
    former = now.limit(0).select("source_id", "path", "size") if before is None else now.join(before.select("source_id", F.col("size").alias("_size")), "source_id").filter("size >= _size").select("source_id", "path", F.col("_size").alias("size"))
    former = held(former, "former")
    sizes = now.select("path", "size").unionByName(former.select("path", "size")).distinct()
    ranges = held(spans.probe_ranges(sizes, probe_bytes), "ranges")
    probed = held(spans.probe(ranges.select("path", "start", "stop").distinct(), direct), "probed")
    ids = spans.identities(ranges, probed)
    inside = former.join(ids, ["path", "size"], "left").select("source_id", F.col("file_id").alias("inside_id"))
    named = now.join(ids, ["path", "size"], "left").join(inside, "source_id", "left")
    return stored(named.select("source_id", "path", "size", "mtime", "file_id", "inside_id"), "snapshot")


def snapshot_files(spark: SparkSession, data_sources: DataFrame, before: DataFrame | None = None, probe_bytes: int = spans.PROBE_BYTES, direct: bool | None = None) -> DataFrame:
    """``source_id, size, mtime, file_id`` of the configured files that are there; ``before`` is the snapshot to compare with. Stored.

    The identity is made of the first and the last ``probe_bytes`` of a file, so a check reads two probes of a file that is as long as it was, and four at most.
    With ``before`` only bytes inside the former size count: a file that grew keeps its identity and one that was replaced does not, unless it begins and,
    up to the former size, ends the same. An empty file and one that is shorter than before have none. Times are not compared.
    """
    seen = _seen(spark, data_sources, before, probe_bytes, direct)
    if before is None:
        return seen.select("source_id", "size", "mtime", "file_id")
    known = seen.join(before.select("source_id", F.lit(True).alias("_known")), "source_id", "left")
    return known.select("source_id", "size", "mtime", F.when(F.col("_known"), F.col("inside_id")).otherwise(F.col("file_id")).alias("file_id"))


def reload_files(
    spark: SparkSession, data_sources: DataFrame, items_path: str, status: DataFrame, before: DataFrame, profile_table: DataFrame | None = None,
    probe_bytes: int = spans.PROBE_BYTES, direct: bool | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Compare the files with the snapshot ``before``, read again what grew or is new, and return the new status and snapshot.

    Items of rebuilt sources are appended to the store at ``items_path`` under their next generation. Shrunk, replaced and deleted sources are emptied;
    unchanged ones are not touched. A new source enters with generation 1. Both results are stored.

    The snapshot that is returned is the one the verdicts rest on, and files are read up to its sizes: what is appended meanwhile is found the next time. If ``before`` has the columns
    ``RESUME`` (join it with ``OpenedLogs.resume_points``; a snapshot that comes back has them again), sources that grew are read from their last item on, and only
    the items from there are stored; where a line that is no UTF-8 makes an earlier choice of encoding wrong, the whole source is read.
    """
    seen = _seen(spark, data_sources, before, probe_bytes, direct)
    resumes = "last_offset" in before.columns
    was = before.select("source_id", F.lit(True).alias("_known"))
    inside = seen.join(was, "source_id", "left").withColumn("file_id", F.when(F.col("_known"), F.col("inside_id")).otherwise(F.col("file_id")))
    verdicts = held(changes.compare_snapshots(before, inside, "source_id"), "verdicts")
    unknown = verdicts.filter(F.col("verdict") == "New").join(status, "source_id", "left_anti")
    fresh = unknown.select("source_id", F.lit(0).cast("bigint").alias("generation"), F.lit("Loaded").alias("status"), F.lit(None).cast("string").alias("change_kind"))
    asked = verdicts.withColumn("verdict", F.when(F.col("verdict") == "New", "Appended").otherwise(F.col("verdict")))
    again = data_sources.join(asked.filter("verdict = 'Appended'").select("source_id"), "source_id", "left_semi")
    known = status.select(*fresh.columns).unionByName(fresh)
    snapshot = seen.select("source_id", "size", "mtime", "file_id")
    points = before.select("source_id", *RESUME) if resumes else None
    if again.isEmpty():
        after = changes.reload_status(known, asked)
        return stored(after, "status"), stored(snapshot if points is None else snapshot.join(points, "source_id", "left"), "snapshot")
    ends = None
    if resumes:
        # Emptied sources hold no items to go on from.
        loaded = status.filter(F.col("status") == "Loaded").select("source_id")
        grown = asked.filter("verdict = 'Appended'").select("source_id").join(loaded, "source_id", "left_semi")
        wanted = seen.select("source_id", "path", "size").join(grown, "source_id", "left_semi").join(points, "source_id").filter("last_offset is not null and error is null")
        ends = held(wanted, "ends")
    rebuilt, made = [], []
    if ends is not None and not ends.isEmpty():
        items, sure = _read_on(spark, ends, direct)
        rebuilt.append(items)
        made.append(sure)
        ends = sure.select("source_id", F.col("from_seq"))
        again = again.join(sure.select("source_id"), "source_id", "left_anti")
    if not again.isEmpty():
        opened = open_logs(spark, again, profile_table, sizes_seen=seen.select("source_id", "size"))
        rebuilt.append(opened.items)
        made.append(opened.resume_points())
    items = rebuilt[0] if len(rebuilt) == 1 else rebuilt[0].unionByName(rebuilt[1])
    after = store.reload(items_path, items, known, asked, ends)
    if resumes:
        told = made[0].select("source_id", *RESUME) if len(made) == 1 else made[0].select("source_id", *RESUME).unionByName(made[1].select("source_id", *RESUME))
        told = held(told, "points")
        points = points.join(told.select("source_id"), "source_id", "left_anti").unionByName(told)
        snapshot = snapshot.join(points, "source_id", "left")
    return stored(after, "status"), stored(snapshot, "snapshot")


def _read_on(spark: SparkSession, ends: DataFrame, direct: bool | None) -> tuple[DataFrame, DataFrame]:
    """Items of grown sources from their last one on, and what the next reload needs, with ``from_seq``. Sources whose encoding may change are left out.

    The last item is made again, as it may go on. Lines before it are not read: all that they say about those that follow is the choice of encoding and format.
    """
    wanted = ends.select("path", F.col("last_offset").alias("start"), "size")
    named = ends.select("source_id", "path", F.lit("").alias("name"), F.lit(0).alias("config_pos"))
    lines = files.scan_ends(wanted, named, direct)
    # All lines were UTF-8 so far; one that is not makes the file one of the default code page.
    doubtful = ends.filter("encoding_route = 'utf8_valid'").select("source_id")
    bad = held(lines.filter(~F.col("valid8")).select("source_id").distinct().join(doubtful, "source_id", "left_semi"), "bad")
    sure = ends.join(bad, "source_id", "left_anti")
    lines = lines.join(small_side(bad, 8, few=True), "source_id", "left_anti")
    decided = held(sure.select("source_id", "encoding", "codepage", F.col("encoding_route").alias("route"), "bom_len", "warning", "error"), "encodings")
    narrow = stored(_sized(lines, decided), "marked")
    inferred = assemble.infer_source_format(narrow).select("source_id", F.col("format").alias("_format"), F.col("fell_back").alias("_fell_back"))
    # A format that is decided stays. One line that decides is enough, and before it all were undated.
    choice = sure.join(inferred, "source_id", "left")
    is_open = F.col("format").isNull() & ~F.col("fell_back") & (F.col("format_route") == "auto")
    formats = choice.select(
        "source_id", F.when(is_open, F.col("_format")).otherwise(F.col("format")).alias("format"), F.col("format_route").alias("route"),
        F.when(is_open, F.coalesce("_fell_back", F.lit(False))).otherwise(F.col("fell_back")).alias("fell_back"),
    )
    formats = held(formats, "formats")
    items = assemble.items_of_parts(assemble.item_parts(_numbered(narrow, formats)))
    shift = small_side(sure.select("source_id", "last_seq", "last_line", "last_offset"), 32, few=True)
    # The offsets of a range begin at its first byte; the BOM before the first line was counted there already.
    moved = items.join(shift, "source_id").withColumns(
        {"seq": F.col("seq") + F.col("last_seq"), "first_line": F.col("first_line") + F.col("last_line") - 1, "raw_offset": F.col("raw_offset") + F.col("last_offset")}
    )
    items = stored(moved.select(*items.columns), "items")
    points = _resume_points(decided, formats, items).join(sure.select("source_id", F.col("last_seq").alias("from_seq")), "source_id")
    return items, stored(points, "points")


def bodies_from_files(items: DataFrame, data_sources: DataFrame, encodings: DataFrame, direct: bool | None = None) -> DataFrame:
    """``source_id, seq, raw_text`` of the items of a page or a result, read from their files by place, as no copy of the text is needed.

    ``items`` is index rows (``source_id, seq, raw_offset, raw_len``), ``encodings`` is ``source_id, codepage, bom_len``. A body whose bytes are not there any more is NULL.
    """
    chosen = items.join(data_sources.select("source_id", "path"), "source_id").join(encodings.select("source_id", "codepage", "bom_len"), "source_id")
    # A BOM that belongs to the text lies before the first item, whose offset is 0 and whose length counts it.
    spans_of = chosen.select("source_id", "seq", "path", F.col("raw_offset").alias("start"), (F.col("raw_offset") + F.col("raw_len")).alias("stop"), "codepage")
    read = spans.read_spans(spans_of, direct)
    needs_codec = F.col("codepage").isNotNull() | ~enc.valid_utf8(F.col("data"))
    decoded = read.withColumn("_decoded", enc.decode_codepage(F.when(needs_codec, F.col("data")), F.coalesce("codepage", F.lit(65001))))
    text = F.coalesce("_decoded.text", enc.utf8_text(F.col("data")))
    return decoded.select("source_id", "seq", F.when(F.col("data").isNotNull(), F.replace(text, F.lit("\r\n"), F.lit("\n"))).alias("raw_text"))


def _numbered(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """Offsets and item numbers in one pass over the lines."""
    keyed = assemble.keyed_lines(lines, formats)
    sums = {"_end": F.col("line_bytes").cast("bigint")}
    placed = assemble.item_seq(keyed, sums=sums, keep_block=True)
    return placed.withColumn("raw_offset", F.col("_end") - F.col("line_bytes") + F.col("bom_len"))


def _special(decided: DataFrame) -> DataFrame:
    """Sources whose lines are not simply UTF-8 with the BOM skipped."""
    unusual = F.col("codepage").isNotNull() | F.col("warning").isNotNull()
    return decided.filter(F.col("error").isNull() & unusual)


def _split(lines: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that are plain UTF-8, and lines that need the decoder: those of special sources and those with bad bytes."""
    special = small_side(_special(decided).select("source_id"), row_bytes=8, few=True)
    rest = lines.join(special, "source_id", "left_anti")
    coded = lines.join(special, "source_id", "left_semi").unionByName(rest.filter(~F.col("valid8")))
    return rest.filter("valid8"), coded


def _decoded(lines: DataFrame, decided: DataFrame) -> DataFrame:
    """Lines of readable sources with ``text`` and ``text_bytes``; only lines that need it pass the Arrow decoder."""
    readable, _ = files.reject_unsupported(lines, decided)
    plain, coded = _split(readable, decided)
    columns = ["source_id", "line_no", "text"]
    text = plain.withColumn("text", F.col("bytes").cast("string")).select(*columns)
    text = text.unionByName(files.decode_lines(coded, decided).select(*columns))
    return text.withColumn("text_bytes", F.octet_length("text"))


def _sized(lines: DataFrame, decided: DataFrame) -> DataFrame:
    """Narrow lines with ``text_bytes`` and ``bom_len``. Only lines that are not plain UTF-8 are decoded for it.

    Lines in code pages that do not share ASCII's digits are parsed anew after decoding.
    """
    columns = ["source_id", "line_no", "raw_len", "line_bytes", "confirmed", "hit", "hit_key", "text_bytes", "bom_len"]

    valid, coded = _split(lines, decided)
    plain = valid.select(
        "*", F.col("raw_len").alias("text_bytes"), F.when(F.col("utf8_bom"), 3).otherwise(0).alias("bom_len")
    ).select(*columns)
    decoded = files.decode_lines(coded, decided).withColumn("text_bytes", F.octet_length("text"))
    other = decided.filter(F.col("codepage").isin(*enc.EBCDIC_PAGES)).select("source_id")
    if not other.isEmpty():
        again = dt.mark(decoded.join(other, "source_id", "left_semi").drop("hit", "hit_key"))
        decoded = decoded.join(other, "source_id", "left_anti").unionByName(again)
    return decoded.select(*columns).unionByName(plain)
