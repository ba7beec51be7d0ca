"""Merged and single-source views, positional paging and hydration.

A timeline is ``position, source_id, seq, sort_key`` plus whatever index columns
were kept. Bodies are joined only for the rows a caller asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.datetime import LONG_MIN, display_timestamp
from timberline.operators.assemble import carry_forward_key
from timberline.operators.prefix import global_positions
from timberline.session import small_side

PAGE_ITEMS = 512
PAGE_BYTES = 2 * 1024 * 1024
# White space that the row-number input field trims.
_BLANKS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


class GenerationMismatch(ValueError):
    """The caller's view is older or newer than the stored one."""

    def __init__(self, expected: int, current: int):
        super().__init__(f"expected generation {expected}, current is {current}")
        self.expected = expected
        self.current = current


def union_sources(*item_tables: DataFrame) -> DataFrame:
    """Items of sources read by different readers as one relation."""
    result = item_tables[0]
    for other in item_tables[1:]:
        result = result.unionByName(other)
    return result


def merged_timeline(items: DataFrame, sources: DataFrame, assembled: bool = True) -> DataFrame:
    """All items ordered by (carried key, source ordinal, seq), with their ``position``.

    ``sources`` is ``source_id, source_ordinal``. Items made by the assembler are undated
    only ahead of their source's first dated item, so their carried key needs no
    window; pass ``assembled=False`` for items from elsewhere.
    """
    if assembled:
        keyed = items.withColumn("sort_key", F.coalesce("key_ms", F.lit(LONG_MIN)))
    else:
        keyed = carry_forward_key(items)
    ordinals = small_side(sources.select("source_id", "source_ordinal"), row_bytes=16, few=True)
    return global_positions(keyed.join(ordinals, "source_id"), ["sort_key", "source_ordinal", "seq"])


def single_source_view(items: DataFrame, source_id: int) -> DataFrame:
    """Items of one source, sorted in file order; ``seq`` is the position."""
    return items.filter(F.col("source_id") == source_id).withColumn("position", F.col("seq")).orderBy("position")


def fetch_range(
    view: DataFrame,
    start: int,
    max_items: int = PAGE_ITEMS,
    max_bytes: int = PAGE_BYTES,
    total: int | None = None,
) -> DataFrame:
    """One page: at most ``max_items`` items from ``start``, cut before the item that would pass ``max_bytes``.

    The first item always comes, whatever its size. Positions are compared with
    literals, so a stored timeline is read only where its row groups overlap.
    """
    total = view.count() if total is None else total
    start = min(start, total)
    page = view.filter((F.col("position") >= start) & (F.col("position") < start + max_items))
    # The window sees one page.
    so_far = F.sum("raw_len").over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    kept = page.withColumn("_bytes", so_far).filter((F.col("position") == start) | (F.col("_bytes") <= max_bytes))
    last = F.max("position").over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return kept.select(
        *view.columns, F.lit(total).cast("bigint").alias("total_items"), (last + 1 < total).alias("truncated")
    )


def page_header(view: DataFrame, start: int, total: int | None = None) -> DataFrame:
    """``start, total_items, at_end`` of a page that may have no rows."""
    total = view.count() if total is None else total
    start = min(start, total)
    return view.sparkSession.range(1).select(
        F.lit(start).cast("bigint").alias("start"), F.lit(total).cast("bigint").alias("total_items"), F.lit(start >= total).alias("at_end")
    )


def typed_number(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Add the finite number typed in column ``raw`` as DOUBLE; NULL for anything else.

    A decimal number, or whole digits with ``0x``, ``0o``, ``0b``; of these, numbers beyond 10^18 count as 10^18.
    """
    text = F.regexp_replace(F.regexp_replace(raw, "^" + _BLANKS, ""), _BLANKS + "$", "")
    value = F.when(text.rlike("^[-+.0-9eE]+$"), text.try_cast("double"))
    for prefix, digits, base, most in (("0x", "0-9a-f", 16, 14), ("0o", "0-7", 8, 19), ("0b", "01", 2, 59)):
        typed = F.regexp_extract(F.lower(text), f"^{prefix}0*([{digits}]+)$", 1)
        read = F.conv(F.when(F.length(typed) <= most, typed), base, 10).try_cast("double")
        value = value.when(typed != "", F.coalesce(read, F.lit(1e18)))
    return df.withColumn(out, value).withColumn(out, F.when(F.abs(out) < F.lit(float("inf")), F.col(out)))


def jump_to_row(requests: DataFrame, total: int, raw: str = "raw", page_items: int = PAGE_ITEMS) -> DataFrame:
    """Add ``row_index`` for a typed 1-based row number, truncated and clamped, and the size of the page it opens.

    NULL when ``raw`` is no finite number or there are no rows.
    """
    found = typed_number(requests, raw, "_value")
    row = F.greatest(F.least(F.col("_value"), F.lit(float(total))), F.lit(1.0)).cast("bigint") - 1
    found = found.withColumn("row_index", F.when(F.col("_value").isNotNull() & F.lit(total > 0), row))
    return found.select(
        *requests.columns,
        "row_index",
        F.when(
            F.col("row_index").isNotNull(),
            F.least(F.lit(page_items).cast("bigint"), F.lit(total) - F.col("row_index")),
        ).alias("page_count"),
    )


def hydrate(index_rows: DataFrame, bodies: DataFrame, sources: DataFrame) -> DataFrame:
    """Attach body, label and display time to index rows.

    ``bodies`` is ``source_id, seq, raw_text``, one row per item as from ``assemble.bodies(item_lines, index_rows)``; ``sources`` is
    ``source_id, label, format``. An item without a readable body gets an empty one and ``unreadable`` true; the others are
    not affected.
    """
    small = small_side(sources.select("source_id", "label", "format"), 32, F.octet_length("label"))
    joined = index_rows.join(bodies, ["source_id", "seq"], "left").join(small, "source_id", "left")
    joined = joined.withColumn("_first_line", first_line("raw_text"))
    dated = F.col("key_ms").isNotNull()
    return joined.select(
        *index_rows.columns,
        F.coalesce("raw_text", F.lit("")).alias("raw_text"),
        F.col("raw_text").isNull().alias("unreadable"),
        F.col("label").alias("source_label"),
        F.when(dated, display_timestamp("_first_line", "format")).alias("timestamp_display"),
        F.col("key_ms").isNull().alias("raw_display"),
    )


def first_line(text: str) -> Column:
    """Text up to the first LF."""
    return F.substring_index(text, "\n", 1)


def utf8_bytes(text: str) -> Column:
    """UTF-8 size of a text."""
    return F.octet_length(text)


def check_generation(expected: int, current: int) -> None:
    """Refuse a request made against another generation."""
    if expected != current:
        raise GenerationMismatch(expected, current)


def generation_guard(requests: DataFrame, status: DataFrame) -> DataFrame:
    """Judge many requests at once: ``ok``, ``generation_mismatch`` with the current value, or ``unknown_source``."""
    current = status.select("source_id", F.col("generation").alias("current_generation"))
    verdict = (
        F.when(F.col("current_generation").isNull(), "unknown_source")
        .when(F.col("expected_generation") == F.col("current_generation"), "ok")
        .otherwise("generation_mismatch")
    )
    return requests.join(small_side(current, row_bytes=16), "source_id", "left").withColumn("verdict", verdict)
