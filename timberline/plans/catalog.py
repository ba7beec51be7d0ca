"""One query per operator over the given tables. ``oracle.py`` holds the SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions import datetime as dt
from timberline.functions import encoding as enc
from timberline.operators import assemble, changes, profiles, ranges, search, summary, timeline
from timberline.plans import derive, ingest
from timberline.plans.derive import table
from timberline.session import fresh_path, stored
from timberline.sources import files, search_store, store, timeline_store
from timberline.streaming.assemble import StreamAssembler

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stored(assemble.mark_lines(derive.log_lines(spark, sf_dir)), "marked")
    return assemble.assemble_items(lines, assemble.infer_source_format(lines))


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.merged_timeline(_items(spark, sf_dir), derive.source_table(spark, sf_dir))


def _lines_with_seq(lines: DataFrame) -> DataFrame:
    return assemble.item_seq(assemble.keyed_lines(lines, assemble.infer_source_format(lines)))


def _items_and_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The item index, and bodies as ordered lines: text joined with stored item numbers."""
    text = stored(derive.log_lines(spark, sf_dir), "lines")
    narrow = stored(assemble.mark_lines(text), "marked")
    numbered = assemble.item_seq(assemble.keyed_lines(narrow, assemble.infer_source_format(narrow)), keep_block=True)
    numbers = stored(numbered, "numbered")
    lines = text.select("source_id", "line_no", "text").join(numbers.select("source_id", "line_no", "seq"), ["source_id", "line_no"])
    return assemble.items_of_parts(assemble.item_parts(numbers)), lines


# --- scans, sources, sinks


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read back from files written from ``events``; file ``f`` of source ``s`` gets id ``6 f + s``."""
    root = derive.write_event_files(spark, sf_dir)
    lines = files.scan_log_lines(spark, root)
    return lines.withColumn("source_id", derive.file_source_id(F.col("path")))


@query
def scan_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = files.line_positions(_scanned(spark, sf_dir))
    return lines.select("source_id", "line_no", "raw_offset", "raw_len", "confirmed", enc.utf8_text(F.col("bytes")).alias("text"))


@query
def unconfirmed_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = derive.write_open_files(spark, sf_dir)
    lines = files.scan_log_lines(spark, root).withColumn("source_id", derive.file_source_id(F.col("path")))
    return files.unconfirmed_tail(lines)


@query
def scan_configured_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = files.scan_log_lines(spark, derive.write_event_files(spark, sf_dir))
    configured = derive.configured_from_paths(lines.select("path").distinct())
    return files.scan_configured_sources(lines, configured).select(
        "source_id", "label", "config_pos", "line_no", enc.utf8_text(F.col("bytes")).alias("text")
    )


@query
def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.file_manifest(spark, derive.write_event_files(spark, sf_dir))
    return found.select(
        derive.file_source_id(F.col("path")).alias("source_id"), "size", F.col("mtime").isNotNull().alias("has_mtime")
    )


@query
def write_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "items")
    store.write_items(_items(spark, sf_dir), path)
    status = derive.status_table(spark, sf_dir)
    return store.read_items(spark, path, status).select(
        "source_id", "seq", "key_ms", "first_line", "continuation_count", "raw_offset", "raw_len", "generation"
    )


@query
def write_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stored(_lines_with_seq(stored(dt.mark(derive.log_lines(spark, sf_dir)), "lines")), "seq")
    items = assemble.index_of(lines.withColumn("text_bytes", F.octet_length("text")))
    view = timeline.merged_timeline(items, derive.source_table(spark, sf_dir))
    chosen = ranges.extract_ranges(view, derive.part_ranges(spark, sf_dir))
    path = fresh_path(spark, "extract")
    store.write_extract(store.extract_lines(chosen, lines), path)
    return spark.read.option("lineSep", "\n").text(path).groupBy(F.col("value").alias("text")).agg(F.count("*").alias("n"))


# --- profiles and configured sources


@query
def resolve_profile_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.resolve_profile_exact(derive.path_cases(spark, sf_dir), derive.profile_table(spark, sf_dir))


@query
def resolve_profile_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiles.resolve_profile_glob(derive.path_cases(spark, sf_dir), derive.profile_table(spark, sf_dir))
    return found.select("source_id", "glob_name", F.array_join("candidates", ",").alias("candidates"))


@query
def resolve_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiles.resolve_profile(derive.path_cases(spark, sf_dir), derive.profile_table(spark, sf_dir))
    return found.select("source_id", "route", "profile_name", F.array_join("candidates", ",").alias("candidates"))


@query
def profile_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.profile_conflicts(derive.big_profile_table(spark, sf_dir))


@query
def profile_value_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.profile_value_checks(derive.big_profile_table(spark, sf_dir))


@query
def source_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    configured, opened = derive.source_lists(spark, sf_dir)
    return profiles.source_ordinal(configured, opened)


@query
def dedupe_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, already = derive.physical_files(spark, sf_dir)
    return profiles.dedupe_sources(sources, already)


@query
def source_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.source_catalog(*derive.catalog_lists(spark, sf_dir))


@query
def close_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = derive.source_table(spark, sf_dir).filter(F.col("source_ordinal") % 3 == 1)
    return profiles.close_source(_items(spark, sf_dir), closed).groupBy("source_id").agg(F.count("*").alias("items"))


# --- encodings


def _encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of files in several encodings, and what was decided for each."""
    lines = files.scan_log_lines(spark, derive.write_encoded_files(spark, sf_dir))
    lines = lines.withColumn("source_id", derive.encoded_source_id(F.col("path")))
    settings = derive.encoding_settings(lines.select("source_id").distinct())
    return lines, files.detect_encoding(lines, settings, default_codepage=1252)


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, decided = _encoded(spark, sf_dir)
    readable, _ = files.reject_unsupported(lines, decided)
    return files.line_positions(files.decode_lines(readable, decided), F.col("bom_len"))


@query
def detect_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir)[1]


@query
def bom_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.bom_conflict(_encoded(spark, sf_dir)[1])


@query
def decode_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir).select("source_id", "line_no", "raw_offset", "text")


@query
def invalid_byte_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.invalid_byte_report(_decoded(spark, sf_dir))


@query
def reject_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, decided = _encoded(spark, sf_dir)
    readable, errors = files.reject_unsupported(lines, decided)
    counts = readable.groupBy("source_id").agg(F.count("*").alias("line_count"))
    return counts.join(errors, "source_id", "full_outer")


# --- date-times


@query
def parse_datetime_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [dt.key_with("text", f).alias("key_" + f.id[-3:]) for f in dt.FORMATS]
    return derive.datetime_cases(spark, sf_dir).select("case_id", "text", *keys)


@query
def parse_datetime_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = dt.parse_auto(derive.datetime_cases(spark, sf_dir))
    return parsed.select(
        "case_id",
        "outcome",
        "format",
        "precision",
        "key_ms",
        "matched_len",
        F.array_join(F.transform("candidates", lambda c: c["format"]), ",").alias("candidates"),
    )


def _dated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stored(dt.mark(derive.log_lines(spark, sf_dir)), "lines")
    return assemble.keyed_lines(lines, assemble.infer_source_format(lines))


@query
def comparison_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated_lines(spark, sf_dir).select("source_id", "line_no", "key_ms")


@query
def precision_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _dated_lines(spark, sf_dir)
        .filter(F.col("key_ms").isNotNull())
        .select("source_id", "line_no", dt.precision_of("format").alias("precision"))
    )


@query
def display_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated_lines(spark, sf_dir).select(
        "source_id", "line_no", dt.display_timestamp("text", "format").alias("timestamp_display")
    )


@query
def first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", timeline.first_line("text").alias("first_line"))


@query
def utf8_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("source", timeline.utf8_bytes("text").alias("n"))
    return sized.groupBy("source").agg(F.sum("n").alias("total_bytes"), F.max("n").alias("largest"))


@query
def format_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("LOG-DT-00"), (F.col("p_partkey") % 9).cast("string")).alias("format")
    )
    return asked.join(F.broadcast(dt.format_catalog(spark)), "format", "left")


# --- aggregations


@query
def infer_source_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from_events = assemble.infer_source_format(derive.log_lines(spark, sf_dir).select("source_id", "line_no", "text"))
    shifted = derive.doc_lines(spark, sf_dir).withColumn("source_id", (F.col("source_id") + 100).cast("int"))
    return from_events.unionByName(assemble.infer_source_format(shifted)).select(
        "source_id", "outcome", "format", "decided_at", "fell_back"
    )


def _routes(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    return assemble.format_route(derive.format_settings(spark, sf_dir), assemble.infer_source_format(lines))


@query
def format_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir, derive.log_lines(spark, sf_dir))


@query
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stored(assemble.mark_lines(derive.log_lines(spark, sf_dir)), "marked")
    routes = stored(_routes(spark, sf_dir, lines), "routes")
    return summary.source_summary(assemble.assemble_items(lines, routes), routes)


@query
def page_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.page_directory(_timeline(spark, sf_dir))


@query
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("variant"), F.col("value").alias("ms"))
    return summary.latency_summary(samples)


@query
def transfer_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _timeline(spark, sf_dir)
    total = view.count()
    variants = table(spark, sf_dir, "region").select(F.pow(F.lit(2), F.col("r_regionkey") + 5).cast("int").alias("max_items"))
    return summary.transfer_volume(view, summary.sample_starts(variants, 20, total), total)


# --- assembly


@query
def assemble_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, lines = _items_and_lines(spark, sf_dir)
    return items.join(assemble.bodies(lines), ["source_id", "seq"])


@query
def raw_display_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derive.numbered(
        derive.doc_lines(spark, sf_dir).withColumnRenamed("line_no", "_no"), "source_id", ["_no"]
    )
    return assemble.raw_display_items(lines)


@query
def item_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stored(assemble.mark_lines(derive.log_lines(spark, sf_dir)), "marked")
    return _lines_with_seq(lines).select("source_id", "line_no", "seq")


@query
def carry_forward_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _dated_lines(spark, sf_dir).select("source_id", (F.col("line_no") - 1).alias("seq"), "key_ms")
    return assemble.carry_forward_key(lines)


@query
def line_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.log_lines(spark, sf_dir).select("source_id", "line_no", "raw_offset", "raw_len")


# --- timeline and paging


@query
def merged_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(spark, sf_dir).select("position", "source_id", "seq", "sort_key")


@query
def single_source_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.single_source_view(_items(spark, sf_dir), 2).select("position", "source_id", "seq", "key_ms", "first_line")


@query
def fetch_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _timeline(spark, sf_dir)
    total = view.count()
    page = timeline.fetch_range(view, total // 2, max_items=400, max_bytes=15_000, total=total)
    return page.select("position", "source_id", "seq", "raw_len", "total_items", "truncated")


@query
def jump_to_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.jump_to_row(derive.typed_rows(spark, sf_dir), _timeline(spark, sf_dir).count())


@query
def hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, lines = _items_and_lines(spark, sf_dir)
    view = timeline.merged_timeline(items, derive.source_table(spark, sf_dir))
    readable = assemble.bodies(lines.filter(F.col("source_id") != 4))
    heads = derive.log_lines(spark, sf_dir)
    sources = derive.source_table(spark, sf_dir).join(assemble.infer_source_format(heads), "source_id")
    return timeline.hydrate(view, readable, sources).select(
        "position", "source_id", "seq", "first_line", "raw_text", "unreadable", "source_label", "timestamp_display", "raw_display"
    )


@query
def generation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        (F.col("o_custkey") % 8).cast("int").alias("source_id"),
        (F.col("o_orderkey") % 3).alias("expected_generation"),
    )
    return timeline.generation_guard(requests, derive.status_table(spark, sf_dir))


# --- ranges


@query
def extract_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = ranges.extract_ranges(_timeline(spark, sf_dir), derive.part_ranges(spark, sf_dir))
    return chosen.select("position", "source_id", "seq")


@query
def row_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 3).alias("row"))
    return ranges.row_selected(rows, derive.part_ranges(spark, sf_dir))


@query
def normalize_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.normalize_ranges(derive.order_ranges(spark, sf_dir), ["selection_id"])


@query
def subtract_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.subtract_rows(derive.order_ranges(spark, sf_dir), derive.order_rows(spark, sf_dir), ["selection_id"])


@query
def toggle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.toggle_rows(derive.order_ranges(spark, sf_dir), derive.order_rows(spark, sf_dir), ["selection_id"])


@query
def clamp_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.clamp_ranges(derive.order_ranges(spark, sf_dir), 60, ["selection_id"])


@query
def range_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = ranges.range_count(ranges.normalize_ranges(derive.order_ranges(spark, sf_dir), ["selection_id"]), ["selection_id"])
    between = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("selection_id"),
        ranges.range_between(F.col("o_orderkey") % 100, F.col("o_custkey") % 100).alias("r"),
    )
    return counted.join(between.select("selection_id", "r.start", "r.count"), "selection_id")


@query
def validate_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.validate_ranges(derive.order_ranges(spark, sf_dir), 100, ["selection_id"])


@query
def extract_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = ranges.normalize_ranges(derive.order_ranges(spark, sf_dir), ["selection_id"])
    return ranges.extract_verdict(_timeline(spark, sf_dir), chosen, max_lines=40, max_bytes=1200, keys=["selection_id"])


@query
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = stored(_items(spark, sf_dir), "items")
    docs = derive.numbered(derive.doc_lines(spark, sf_dir).withColumnRenamed("line_no", "_no"), "source_id", ["_no"])
    raw = assemble.raw_display_items(docs).withColumn("source_id", (F.col("source_id") + 100).cast("int"))
    return timeline.union_sources(items, raw.select(*items.columns)).select("source_id", "seq", "key_ms", "first_line", "body_bytes")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items of even and of odd sources, with the event type as identifier."""
    lines = stored(_lines_with_seq(stored(dt.mark(derive.log_lines(spark, sf_dir)), "lines")), "seq")
    items = lines.filter(F.col("key_ms").isNotNull()).select(
        "source_id", "seq", "key_ms", F.regexp_extract("text", " ([a-z]+) user=", 1).alias("ident")
    )
    return items.filter(F.col("source_id") % 2 == 0), items.filter(F.col("source_id") % 2 == 1)


@query
def time_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.time_correlate(*_sides(spark, sf_dir), tolerance_ms=60_000)


@query
def time_correlate_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.time_correlate(*_sides(spark, sf_dir), tolerance_ms=600_000, identifier="ident")


# --- changes


@query
def compare_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.compare_snapshots(*derive.manifests(spark, sf_dir))


@query
def refresh_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = derive.manifests(spark, sf_dir)
    verdicts = changes.compare_snapshots(old, new).select(
        F.regexp_extract("path", "([0-9]+)", 1).cast("int").alias("source_id"), "verdict"
    )
    failed = F.when(F.col("source_id") % 7 == 6, "input/output error")
    return changes.refresh_status(derive.supplier_status(spark, sf_dir), verdicts.withColumn("read_error", failed))


@query
def reload_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stored(assemble.mark_lines(derive.log_lines(spark, sf_dir)), "marked")
    before, old, new = derive.grown_sources(lines)
    path = fresh_path(spark, "items")
    store.write_items(assemble.assemble_items(before, assemble.infer_source_format(before)), path)
    verdicts = stored(changes.compare_snapshots(old, new, "source_id"), "verdicts")
    appended = lines.join(verdicts.filter(F.col("verdict") == "Appended").select("source_id"), "source_id", "left_semi")
    rebuilt = assemble.assemble_items(appended, assemble.infer_source_format(appended))
    after = store.reload(path, rebuilt, derive.status_table(spark, sf_dir), verdicts)
    return store.read_items(spark, path, after).select(
        "source_id", "seq", "key_ms", "first_line", "continuation_count", "generation"
    )


@query
def resync_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = derive.status_table(spark, sf_dir).withColumn(
        "status", F.when(F.col("source_id") % 4 == 1, "Changed").otherwise("Loaded")
    )
    view, generation = changes.resync_timeline(_items(spark, sf_dir), status, derive.source_table(spark, sf_dir), 1)
    return view.select("position", "source_id", "seq", F.lit(generation).alias("generation"))


@query
def reload_reads_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that grew, read from their last item on; the items of all generations put together."""
    was, now = (stored(derive.sources_in(spark, root), "configured") for root in derive.write_growing_files(spark, sf_dir))
    seen, path = ingest.snapshot_files(spark, was), fresh_path(spark, "items")
    opened = ingest.open_logs(spark, was, sizes_seen=seen)
    store.write_items(opened.items, path)
    status = was.select("source_id", F.lit(1).cast("bigint").alias("generation"), F.lit("Loaded").alias("status"), F.lit(None).cast("string").alias("change_kind"))
    before = stored(seen.join(opened.resume_points(), "source_id", "left"), "before")
    after, _ = ingest.reload_files(spark, now, path, status, before)
    return store.read_items(spark, path, after)


@query
def resync_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored view brought up to date: sources 1 and 5 grew since, 4 was closed. Items that a source gained are made from the last one on."""
    lines = stored(assemble.mark_lines(derive.log_lines(spark, sf_dir)), "marked")
    sources, path = stored(derive.source_table(spark, sf_dir), "sources"), fresh_path(spark, "view")
    was, _, _ = derive.grown_sources(lines)
    formats = stored(assemble.infer_source_format(lines), "formats")
    before, items = (stored(assemble.assemble_items(some, formats), "items") for some in (was, lines))
    timeline_store.write_view(before, sources, path, piece_rows=1 << 12)
    grown = F.col("source_id").isin(1, 5)
    last = stored(before.filter(grown).groupBy("source_id").agg(F.max("seq").alias("from_seq")), "last")
    closed = sources.filter("source_id = 4").select("source_id", F.lit(0).cast("bigint").alias("from_seq"))
    added = items.join(last, "source_id").filter("seq >= from_seq").drop("from_seq")
    timeline_store.update_view(spark, path, last.unionByName(closed), added, sources, piece_rows=1 << 12)
    view, _ = timeline_store.read_view(spark, path)
    return view.select("position", "source_id", "seq", "key_ms")


@query
def timeline_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = derive.supplier_status(spark, sf_dir)
    recorded = changes.built_from(now).withColumn(
        "generation", F.col("generation") - (F.col("source_id") % 5 == 0).cast("bigint")
    )
    return changes.timeline_staleness(recorded.filter(F.col("source_id") % 11 != 3), now)


@query
def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("source_id"), F.col("s_name").alias("label"))
    old, new = derive.manifests(spark, sf_dir)
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("int").alias("source_id")
    verdicts = changes.compare_snapshots(old, new).select(number, "verdict")
    return changes.list_sources(derive.supplier_status(spark, sf_dir), sources, new.select(number, "size"), verdicts=verdicts)


# --- filters


@query
def filter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filter_text(_items_and_lines(spark, sf_dir)[1], "at frame 3")


@query
def filter_text_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two needles, one in capitals, looked for by the signatures of stored blocks."""
    items, lines = _items_and_lines(spark, sf_dir)
    items, path = stored(items, "items"), fresh_path(spark, "search")
    search_store.write_search(lines, path)
    found = [search_store.find_text(spark, path, needle, items, fold).withColumn("needle", F.lit(needle)) for needle, fold in (("at frame 3", False), ("USER=77 ", True))]
    return found[0].unionByName(found[1])


@query
def filter_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lines = _items_and_lines(spark, sf_dir)
    return search.filter_regex(lines, "user=[0-9]*7 v=[1-3][0-9]{2}\\b", literal="user=", within_line=True)


@query
def filter_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    day5 = 1_704_412_800_000
    found = search.filter_time_range(_items(spark, sf_dir), day5, day5 + 3 * dt.DAY_MS)
    return found.select("source_id", "seq", "key_ms")


@query
def filter_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filter_source(_items(spark, sf_dir), [1, 4]).select("source_id", "seq", "key_ms")


@query
def filter_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, lines = _items_and_lines(spark, sf_dir)
    firsts = items.select("source_id", "seq", F.col("first_line").alias("line_no")).join(lines.drop("seq"), ["source_id", "line_no"])
    found = search.filter_level(firsts, "^[-0-9/:. ]+ ([a-z]+) user=", ["error", "signup"])
    return found.select("source_id", "seq", "level")


# --- streaming


@query
def stream_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stored(derive.log_lines(spark, sf_dir), "lines")
    base = fresh_path(spark, "stream")
    assembler = StreamAssembler(spark, base)
    step = lines.agg(F.max("line_no")).first()[0] // 3 + 1
    for batch in range(3):
        arrived = lines.filter((F.col("line_no") > batch * step) & (F.col("line_no") <= (batch + 1) * step))
        arrived.write.mode("append").parquet(base + "/in")
        assembler.start(spark.readStream.schema(lines.schema).parquet(base + "/in"), base + "/checkpoint").awaitTermination()
    return assembler.finish()
