"""From physical lines to logical items: format per source, continuation lines, ids, carried keys, bodies.

Lines are ``source_id, line_no, raw_offset, raw_len, text, confirmed``. The date-time
is parsed where the line is scanned; from there on only narrow columns move, never
the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import datetime as dt
from timberline.operators.prefix import BLOCK_ROWS, running
from timberline.session import small_side, small_tasks, stored

#: The most a body may have to be handed out as one value.
BODY_BYTES = 1 << 30


NARROW = ("source_id", "line_no", "raw_offset", "raw_len", "confirmed", "text_bytes", "hit", "hit_key")


def mark_lines(lines: DataFrame) -> DataFrame:
    """The narrow form of lines: position, size, and what the line start parses to, without the text.

    Store it and both the choice of format and the assembly run without touching the text again.
    """
    return _marked(lines).withColumn("text_bytes", F.octet_length("text")).select(*NARROW)


def _marked(lines: DataFrame) -> DataFrame:
    return lines if "hit" in lines.columns else dt.mark(lines)


def infer_source_format(lines: DataFrame, scan_lines: int | None = None) -> DataFrame:
    """Per source: the first line that is not NoMatch decides, among all lines or the first ``scan_lines``.

    ``format`` is NULL for raw display; ``fell_back`` tells an ambiguous hit from none at all.
    """
    head = _marked(lines if scan_lines is None else lines.filter(F.col("line_no") <= scan_lines)).select(
        "source_id", "line_no", dt.outcome_of_hit().alias("outcome"), dt.format_of_hit().alias("format")
    )
    deciding = F.when(F.col("outcome") != "NoMatch", F.struct("line_no", "outcome", "format"))
    return (
        head.groupBy("source_id")
        .agg(F.min(deciding).alias("hit"))
        .select(
            "source_id",
            F.coalesce(F.col("hit.outcome"), F.lit("NoMatch")).alias("outcome"),
            F.col("hit.format").alias("format"),
            F.col("hit.line_no").alias("decided_at"),
            F.coalesce(F.col("hit.outcome") == "Ambiguous", F.lit(False)).alias("fell_back"),
        )
    )


def format_route(settings: DataFrame, inferred: DataFrame) -> DataFrame:
    """Which rule fixed each source's format.

    ``settings`` is ``source_id, manual_format, profile_format, profile_unresolved``.
    An unresolvable profile forces raw display over everything; then manual, then
    profile, then what :func:`infer_source_format` found.
    """
    unresolved = F.coalesce(F.col("profile_unresolved"), F.lit(False))
    explicit = F.coalesce("manual_format", "profile_format")
    route = (
        F.when(unresolved, "raw_display_fallback")
        .when(F.col("manual_format").isNotNull(), "manual")
        .when(F.col("profile_format").isNotNull(), "profile")
        .otherwise("auto")
    )
    return settings.join(inferred.drop("outcome", "decided_at"), "source_id", "left").select(
        "source_id",
        F.when(~unresolved, F.coalesce(explicit, F.col("format"))).alias("format"),
        route.alias("route"),
        (unresolved | (explicit.isNull() & F.coalesce(F.col("fell_back"), F.lit(False)))).alias("fell_back"),
    )


def keyed_lines(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """Lines with ``format`` and ``key_ms`` under it; NULL where undated or raw."""
    chosen = small_side(formats.select("source_id", "format"), row_bytes=64, few=True)
    return _marked(lines).join(chosen, "source_id", "left").withColumn("key_ms", dt.key_of_hit("format")).drop("hit", "hit_key")


def item_seq(keyed: DataFrame, width: int = BLOCK_ROWS, sums: dict[str, Column] | None = None, keep_block: bool = False) -> DataFrame:
    """Add ``seq``, the 0-based number of the item each line belongs to within its source.

    Before the first dated line every line is its own item; from there on an
    item starts at each dated line. ``line_no`` must be dense and start at 1. ``sums`` names further
    running sums to take in the same pass.
    """
    dated = F.col("key_ms").isNotNull()
    sums = sums or {}
    counted = running(
        keyed,
        ["source_id"],
        ["line_no"],
        {
            "_dated": ("sum", dated.cast("bigint")),
            "_first_dated": ("min", F.when(dated, F.col("line_no"))),
            **{name: ("sum", column) for name, column in sums.items()},
        },
        width,
        keep_block=keep_block,
    )
    leading = F.col("_dated") == 0
    seq = F.when(leading, F.col("line_no") - 1).otherwise(F.col("_first_dated") + F.col("_dated") - 2)
    return counted.withColumns({"seq": seq, "starts": leading | dated}).drop("_dated", "_first_dated")


def assemble_items(lines: DataFrame, formats: DataFrame, width: int = BLOCK_ROWS) -> DataFrame:
    """The item index: one row per logical item, without bodies.

    ``lines`` is best the stored result of :func:`mark_lines`; lines with text are marked and stored here.
    ``raw_offset``/``raw_len`` span first to last line; ``body_bytes`` is the UTF-8
    size of the lines joined with LF.
    """
    narrow = lines if set(NARROW) <= set(lines.columns) else stored(mark_lines(lines), "marked")
    return items_of_parts(item_parts(item_seq(keyed_lines(narrow, formats), width, keep_block=True)))


def item_parts(numbered: DataFrame) -> DataFrame:
    """Lines of one block and one item folded into one row, stored.

    ``numbered`` comes from :func:`item_seq` with its block kept, so this needs no shuffle. An item that runs over a
    block border has one part that ``starts`` it and at most one more per block.
    """
    folded = numbered.groupBy("source_id", F.col("_block").alias("block"), "seq").agg(
        F.max("key_ms").alias("key_ms"),
        F.min("line_no").alias("first_line"),
        F.count("*").alias("lines"),
        F.min("raw_offset").alias("raw_offset"),
        F.max(F.col("raw_offset") + F.col("raw_len")).alias("raw_end"),
        F.max_by("confirmed", "line_no").alias("confirmed"),
        (F.sum(F.col("text_bytes").cast("bigint")) + F.count("*")).alias("bytes"),
        F.bool_or("starts").alias("starts"),
    )
    with small_tasks(folded.sparkSession):
        return stored(folded, "parts")


def items_of_parts(parts: DataFrame) -> DataFrame:
    """Item rows: the part that starts an item with what later blocks add to it.

    Only the few continuing parts are grouped; the items themselves are not shuffled.
    """
    more = parts.filter(~F.col("starts")).groupBy("source_id", "seq").agg(
        F.sum("lines").alias("_lines"),
        F.max("raw_end").alias("_end"),
        F.max_by("confirmed", "block").alias("_confirmed"),
        F.sum("bytes").alias("_bytes"),
    )
    zero = F.lit(0)
    return parts.filter("starts").join(small_side(more, row_bytes=48), ["source_id", "seq"], "left").select(
        "source_id",
        "seq",
        "key_ms",
        "first_line",
        (F.col("lines") + F.coalesce("_lines", zero) - 1).alias("continuation_count"),
        "raw_offset",
        (F.coalesce("_end", "raw_end") - F.col("raw_offset")).alias("raw_len"),
        F.coalesce("_confirmed", "confirmed").alias("confirmed"),
        (F.col("bytes") + F.coalesce("_bytes", zero) - 1).alias("body_bytes"),
    )


def bodies(item_lines: DataFrame, wanted: DataFrame | None = None, limit_bytes: int = BODY_BYTES) -> DataFrame:
    """Bodies of items, lines joined with LF, always one row per item: ``source_id, seq, raw_text``.

    ``item_lines`` is ``source_id, seq, line_no, text``, the form in which bodies are kept, searched and extracted; a body as one value is
    for the few items of a page or a result, ``wanted`` (``source_id, seq``). A body over ``limit_bytes`` ends the
    query with an error that names the item: read it as its lines.
    """
    lines = item_lines.select("source_id", "seq", "line_no", "text")
    if wanted is not None:
        lines = lines.join(small_side(wanted.select("source_id", "seq").distinct(), row_bytes=16), ["source_id", "seq"], "left_semi")
    size = F.sum(F.octet_length("text").cast("bigint") + 1) - 1
    name = F.concat_ws(" ", F.lit("body too large for one value: source"), "source_id", F.lit("item"), "seq")
    checked = F.when(size > limit_bytes, F.raise_error(name)).otherwise(_joined("text", "line_no"))
    return lines.groupBy("source_id", "seq").agg(checked.alias("raw_text"))


def index_of(numbered: DataFrame) -> DataFrame:
    """Item rows from lines that carry ``seq`` in any distribution, by grouping them."""
    return (
        numbered.groupBy("source_id", "seq")
        .agg(
            F.max("key_ms").alias("key_ms"),
            F.min("line_no").alias("first_line"),
            (F.count("*") - 1).alias("continuation_count"),
            F.min("raw_offset").alias("raw_offset"),
            F.max(F.col("raw_offset") + F.col("raw_len")).alias("_raw_end"),
            F.max_by("confirmed", "line_no").alias("confirmed"),
            (F.sum(F.col("text_bytes").cast("bigint")) + F.count("*") - 1).alias("body_bytes"),
        )
        .select(
            "source_id",
            "seq",
            "key_ms",
            "first_line",
            "continuation_count",
            "raw_offset",
            (F.col("_raw_end") - F.col("raw_offset")).alias("raw_len"),
            "confirmed",
            "body_bytes",
        )
    )


def raw_display_items(lines: DataFrame) -> DataFrame:
    """One undated item per line, for sources shown raw."""
    return lines.select(
        "source_id",
        (F.col("line_no") - 1).alias("seq"),
        F.lit(None).cast("bigint").alias("key_ms"),
        F.col("line_no").alias("first_line"),
        F.lit(0).cast("bigint").alias("continuation_count"),
        "raw_offset",
        F.col("raw_len").cast("bigint").alias("raw_len"),
        "confirmed",
        F.octet_length("text").cast("bigint").alias("body_bytes"),
    )


def carry_forward_key(items: DataFrame, width: int = BLOCK_ROWS) -> DataFrame:
    """Add ``sort_key``: an undated item takes the last dated key before it in its source, else the minimum."""
    last = running(
        items,
        ["source_id"],
        ["seq"],
        {"_last": ("max", F.when(F.col("key_ms").isNotNull(), F.struct("seq", "key_ms")))},
        width,
    )
    return last.withColumn("sort_key", F.coalesce("_last.key_ms", F.lit(dt.LONG_MIN))).drop("_last")


def _joined(text: str, order: str) -> Column:
    """Texts of a bounded group in order, joined with LF."""
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return F.array_join(F.transform(rows, lambda r: r[text]), "\n")
