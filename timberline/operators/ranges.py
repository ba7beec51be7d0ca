"""Selections of row positions as ``(start, count)`` ranges, and what is done with them.

All operators take ``keys``, the columns that tell one selection from another.
Coverage is computed by a sweep over range ends: ends at the same position are summed first, so a
block of positions never holds more rows than its width, however many ranges meet there.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.operators.prefix import BLOCK_ROWS, block_of, carry_in, running
from timberline.session import small_side, small_tasks, stored

PAGE_ROWS = 4096
#: Bytes of running sums per block.
BYTES_BLOCK = 1 << 24


def _ends(ranges: DataFrame, keys: list[str], counter: str) -> DataFrame:
    """Two rows per non-empty range: +1 where it starts, -1 after it ends."""
    return ranges.filter(F.col("count") > 0).select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("start").alias("at"), F.lit(1).cast("bigint").alias(counter)),
                F.struct((F.col("start") + F.col("count")).alias("at"), F.lit(-1).cast("bigint").alias(counter)),
            )
        ).alias("_e"),
    ).select(*keys, F.col("_e.at").alias("at"), F.col(f"_e.{counter}").alias(counter))


def _spans(ranges: DataFrame, keys: list[str], counters: list[str], counter: str) -> DataFrame:
    """Non-empty ranges up to ``_stop``, counted by one of the ``counters``."""
    weights = [F.lit(int(c == counter)).cast("bigint").alias(c) for c in counters]
    return ranges.filter(F.col("count") > 0).select(*keys, "start", (F.col("start") + F.col("count")).alias("_stop"), *weights)


def _carried(spans: DataFrame, ends: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Ranges open at the beginning of a block, as rows at its first position that add to ``from_<counter>``.

    A range inside one block opens nothing in later ones, so only selections with a range over a border are looked at.
    """
    over = spans.filter(block_of(F.col("start")) != block_of(F.col("_stop")))
    if keys:
        reaching = ends.join(small_side(over.select(*keys).distinct(), 16 * len(keys), few=True), keys, "left_semi")
    else:
        reaching = ends.limit(0) if over.isEmpty() else ends
    carry = carry_in(reaching, keys, "_block", {c: ("sum", F.col(c)) for c in counters})
    opened = {f"from_{c}": F.coalesce(F.col(f"carry_{c}"), F.lit(0)) for c in counters}
    rows = carry.withColumns(opened).withColumn("at", F.shiftleft("_block", BLOCK_ROWS.bit_length() - 1))
    nothing = [F.lit(0).cast("bigint").alias(c) for c in counters]
    return rows.filter(reduce(or_, [F.col(c) != 0 for c in opened])).select(*keys, "at", "_block", *nothing, *opened)


def _sweep(spans: DataFrame, keys: list[str], counters: list[str], selected: Column) -> DataFrame:
    """Maximal stretches of positions where ``selected`` (over the running counters) holds.

    Rows are brought together by block once. A stretch that ends in its block is complete there; the ends of others, at most two per
    block, are paired afterwards.
    """
    with small_tasks(spans.sparkSession):
        spans = stored(spans, "spans")
        both = F.array(
            F.struct(F.col("start").alias("at"), *counters), F.struct(F.col("_stop").alias("at"), *[(-F.col(c)).alias(c) for c in counters])
        )
        ends = spans.select(*keys, F.explode(both).alias("_e")).select(*keys, "_e.*").withColumn("_block", block_of(F.col("at")))
        opened = [f"from_{c}" for c in counters]
        rows = ends.withColumns({c: F.lit(0).cast("bigint") for c in opened}).unionByName(_carried(spans, ends, keys, counters))
        summed = rows.groupBy(*keys, "at", "_block").agg(*[F.sum(c).alias(c) for c in (*counters, *opened)])
        local = Window.partitionBy(*keys, "_block").orderBy("at")
        now = {f"in_{c}": F.sum(F.col(c) + F.col(f"from_{c}")).over(local) for c in counters}
        before = {f"in_{c}": F.col(f"in_{c}") - F.col(c) for c in counters}
        flagged = summed.withColumns(now).withColumn("_now", selected).withColumns(before).withColumn("_before", selected)
        turns = flagged.filter(F.col("_now") != F.col("_before"))
        # Starts and ends alternate.
        paired = turns.withColumns({"_end": F.lead("at").over(local), "_first": F.lag("at").over(local).isNull()})
        swept = stored(paired.filter(F.col("_now") | F.col("_first")).select(*keys, "at", "_end", "_now"), "sweep")
    whole = swept.filter(F.col("_now") & F.col("_end").isNotNull()).select(*keys, F.col("at").alias("start"), "_end")
    loose = swept.filter(~F.col("_now") | F.col("_end").isNull()).select(*keys, "at", "_now")
    # A start and its end share the number of starts so far.
    numbered = running(loose, keys, ["at"], {"_pair": ("sum", F.col("_now").cast("bigint"))})
    joined = numbered.groupBy(*keys, "_pair").agg(F.min("at").alias("start"), F.max("at").alias("_end")).drop("_pair")
    return whole.unionByName(joined).select(*keys, "start", (F.col("_end") - F.col("start")).alias("count"))


def normalize_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Drop empty ranges and merge overlapping and adjacent ones."""
    return _sweep(_spans(ranges, keys, ["n"], "n"), keys, ["n"], F.col("in_n") > 0)


def _with_rows(ranges: DataFrame, rows: DataFrame, keys: list[str], selected: Column) -> DataFrame:
    rows = rows.select(*keys, F.col("row").alias("start"), F.lit(1).cast("bigint").alias("count"))
    spans = _spans(ranges, keys, ["n", "m"], "n").unionByName(_spans(rows, keys, ["n", "m"], "m"))
    return _sweep(spans, keys, ["n", "m"], selected)


def subtract_rows(ranges: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Remove single rows (``keys, row``), splitting ranges where needed."""
    return _with_rows(ranges, rows, keys, (F.col("in_n") > 0) & (F.col("in_m") == 0))


def toggle_rows(ranges: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Flip single rows: selected ones are removed, the others added. A row toggled twice is back where it was."""
    return _with_rows(ranges, rows, keys, (F.col("in_n") > 0) != (F.col("in_m") % 2 == 1))


def clamp_ranges(ranges: DataFrame, total: int | Column, keys: list[str]) -> DataFrame:
    """Cut ranges to ``[0, total)`` and normalise; nothing is left when there are no rows."""
    total = F.lit(total).cast("bigint") if isinstance(total, int) else total
    cut = ranges.withColumn("_end", F.least(F.col("start") + F.col("count"), total)).select(
        *keys, "start", (F.col("_end") - F.col("start")).alias("count")
    )
    return normalize_ranges(cut.filter(F.col("start") < total), keys)


def range_count(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Number of selected rows per selection."""
    return ranges.groupBy(*keys).agg(F.sum("count").alias("selected_rows"))


def select_all(spark: SparkSession, total: int) -> DataFrame:
    """The whole view as one range, or none when it is empty."""
    return spark.createDataFrame([(0, total)] if total > 0 else [], "start BIGINT, count BIGINT")


def range_between(a: Column, b: Column) -> Column:
    """The range from one row to another, both included, in either order."""
    return F.struct(F.least(a, b).alias("start"), (F.abs(a - b) + 1).alias("count"))


def validate_ranges(ranges: DataFrame, total: int | Column, keys: list[str]) -> DataFrame:
    """First violation in list order per selection: ``reason`` and ``at_pos``, both NULL when valid.

    ``ranges`` is ``keys, pos, start, count`` with distinct ``pos``. A selection with
    no row at all cannot show up here; see :func:`selection_reason`.
    """
    total = F.lit(total).cast("bigint") if isinstance(total, int) else total
    previous = running(
        ranges,
        keys,
        ["pos"],
        {"_previous": ("max", F.struct("pos", (F.col("start") + F.col("count")).alias("end")))},
        include_current=False,
    )
    reason = (
        F.when(F.col("count") == 0, "EmptyRange")
        .when(F.col("start") < F.coalesce(F.col("_previous.end"), F.lit(0)), "OverlappingOrUnordered")
        .when((F.col("start") > total) | (F.col("count") > total - F.col("start")), "OutOfBounds")
    )
    judged = previous.withColumn("_reason", reason)
    first = F.min(F.when(F.col("_reason").isNotNull(), F.struct("pos", F.col("_reason").alias("reason"))))
    return (
        judged.groupBy(*keys)
        .agg(first.alias("_hit"), F.sum("count").alias("_lines"))
        .select(
            *keys,
            F.col("_hit.reason").alias("reason"),
            F.col("_hit.pos").alias("at_pos"),
            F.when(F.col("_hit").isNull(), F.col("_lines")).alias("selected_lines"),
        )
    )


def selection_reason(ranges: DataFrame, total: int) -> str | None:
    """Why one selection is not acceptable, or None."""
    row = validate_ranges(ranges, total, []).first()
    return "NoRanges" if row is None or (row["reason"] is None and row["selected_lines"] is None) else row["reason"]


def _points(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Range ends with what they add to the number of open ranges, ends at one place summed."""
    return _ends(ranges, keys, "_open").groupBy(*keys, "at").agg(F.sum("_open").alias("_open"))


def _rows_of(ranges: DataFrame) -> DataFrame:
    """A row per selected position, by arrays of at most ``PAGE_ROWS`` entries each for anything up to 10^10 rows."""
    rows = ranges.filter(F.col("count") > 0).withColumn("_stop", F.col("start") + F.col("count")).drop("count")
    for width in (PAGE_ROWS * PAGE_ROWS, PAGE_ROWS, 1):
        cuts = F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_stop") - F.col("start") - 1) / width)), lambda k: F.col("start") + k * width
        )
        rows = rows.withColumn("_cut", F.explode(cuts)).withColumn("_stop", F.least(F.col("_cut") + width, "_stop"))
        rows = rows.drop("start").withColumnRenamed("_cut", "start")
    return rows.drop("_stop").withColumnRenamed("start", "position")


def extract_ranges(view: DataFrame, ranges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of ``view`` whose position lies in a selected range, once per selection, in no particular order.

    One selection is a sweep: range ends and rows in order of position, and rows stay where a range is open. Several selections (``keys``) are as
    large as what they select from the view, so their positions are listed and meet the rows one to one.
    """
    if keys:
        last = view.agg(F.max("position")).first()[0]
        inside = clamp_ranges(ranges, 0 if last is None else last + 1, keys)
        return view.join(_rows_of(inside), "position")
    ends = _points(ranges, []).withColumnRenamed("at", "position")
    both = view.withColumn("_open", F.lit(0).cast("bigint")).withColumn("_row", F.lit(True)).unionByName(
        ends.withColumn("_row", F.lit(False)), allowMissingColumns=True
    )
    # An end and a row at one position: the end counts first.
    swept = running(both, [], ["position", "_row"], {"_now": ("sum", F.col("_open"))})
    return swept.filter(F.col("_row") & (F.col("_now") > 0)).select(*view.columns)


def row_selected(rows: DataFrame, ranges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add ``selected`` to ``rows`` (``keys, row``), by the same sweep."""
    keys = keys or []
    asked = rows.select(*keys, F.col("row").alias("at")).distinct().withColumn("_open", F.lit(0).cast("bigint")).withColumn("_row", F.lit(True))
    both = asked.unionByName(_points(ranges, keys).withColumn("_row", F.lit(False)))
    swept = running(both, keys, ["at", "_row"], {"_now": ("sum", F.col("_open"))})
    found = swept.filter("_row").select(*keys, F.col("at").alias("row"), (F.col("_now") > 0).alias("selected"))
    return rows.join(found, [*keys, "row"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def byte_sums(view: DataFrame) -> DataFrame:
    """Per position: ``_cum``, bodies with one LF each up to and including it, and ``_bad``, bodies of unknown size. Stored."""
    size = F.coalesce(F.col("body_bytes") + 1, F.lit(0)).cast("bigint")
    unknown = F.col("body_bytes").isNull().cast("bigint")
    sums = running(view.select("position", "body_bytes"), [], ["position"], {"_cum": ("sum", size), "_bad": ("sum", unknown)})
    return stored(sums.select("position", "_cum", "_bad"), "sums")


def sized_ranges(ranges: DataFrame, sums: DataFrame) -> DataFrame:
    """Ranges inside the view with ``_before`` (bytes up to their start), ``_bytes`` and ``_unknown``: two lookups by position each.

    Looked up are the places where ranges begin or end, each once, however many ranges meet there; a few are sent to the ranges.
    """
    zero = F.lit(0).cast("bigint")
    placed = ranges.withColumn("_stop", F.col("start") + F.col("count"))
    places = placed.select(F.explode(F.array("start", "_stop")).alias("_place")).distinct()
    known = places.join(sums.withColumn("_place", F.col("position") + 1), "_place").select("_place", "_cum", "_bad")
    known = small_side(known, 24)
    first = known.select(F.col("_place").alias("start"), F.col("_cum").alias("_before"), F.col("_bad").alias("_bad_before"))
    last = known.select(F.col("_place").alias("_stop"), F.col("_cum").alias("_until"), F.col("_bad").alias("_bad_until"))
    placed = placed.join(first, "start", "left").join(last, "_stop")
    placed = placed.withColumn("_before", F.coalesce("_before", zero))
    return placed.select(
        *ranges.columns, "_before", (F.col("_until") - F.col("_before")).alias("_bytes"),
        (F.col("_bad_until") - F.coalesce("_bad_before", zero)).alias("_unknown"),
    )


def _next_sum(limits: DataFrame, sums: DataFrame) -> DataFrame:
    """For each ``_limit``: the smallest ``_cum`` above it, ``_next``. One ordered pass over both, from the top down."""
    asked = limits.select("_limit").distinct().select((-F.col("_limit")).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_value"))
    there = sums.select((-F.col("_cum")).alias("_at"), F.lit(1).alias("_kind"), (-F.col("_cum")).alias("_value"))
    passed = running(asked.unionByName(there), [], ["_at", "_kind"], {"_last": ("max", F.col("_value"))}, BYTES_BLOCK)
    return passed.filter("_kind = 0").select((-F.col("_at")).alias("_limit"), (-F.col("_last")).alias("_next"))


def extract_verdict(view: DataFrame, ranges: DataFrame, max_lines: int, max_bytes: int, keys: list[str] | None = None) -> DataFrame:
    """May these selections be extracted? One row per selection, never a partial answer.

    Too many lines is decided from ``ranges`` alone and leaves ``selected_bytes`` NULL;
    such selections are not joined to the view at all. Otherwise bodies plus one LF between items are
    summed in position order; past ``max_bytes`` the total at the first overflow is reported. A body
    of unknown size (``body_bytes`` NULL) makes the source unavailable.

    Bytes of a range are the difference of two running sums over the view, so the work follows the view and the number
    of ranges, not the rows they hold. Positions of ``view`` are dense from 0.
    """
    if not keys:
        one = ranges.withColumn("_selection", F.lit(0))
        return extract_verdict(view, one, max_lines, max_bytes, ["_selection"]).drop("_selection")
    counted = range_count(ranges, keys)
    small_enough = counted.filter(F.col("selected_rows") <= max_lines)
    wanted = ranges.join(small_enough.select(*keys), keys, "left_semi")
    last = view.agg(F.max("position")).first()[0]
    sums = byte_sums(view)
    with small_tasks(view.sparkSession):
        sized = stored(sized_ranges(clamp_ranges(wanted, 0 if last is None else last + 1, keys), sums), "sized")
    totals = sized.groupBy(*keys).agg((F.sum("_bytes") - 1).alias("_all"), (F.sum("_unknown") > 0).alias("_unreadable"))
    # Where a selection overflows: in its first range whose end is past the limit, at the first row that is.
    over = sized.join(totals.filter(F.col("_all") > max_bytes).select(*keys), keys, "left_semi")
    summed = running(over, keys, ["start"], {"_so_far": ("sum", F.col("_bytes"))})
    crossing = summed.filter((F.col("_so_far") - 1 > max_bytes) & (F.col("_so_far") - F.col("_bytes") - 1 <= max_bytes))
    crossing = crossing.withColumn("_shift", F.col("_so_far") - F.col("_bytes") - F.col("_before") - 1)
    crossing = stored(crossing.select(*keys, "_shift", (F.lit(max_bytes) - F.col("_shift")).alias("_limit")), "crossing")
    first_over = crossing.join(_next_sum(crossing, sums), "_limit").select(*keys, (F.col("_next") + F.col("_shift")).alias("_over"))
    joined = counted.join(totals, keys, "left").join(first_over, keys, "left")
    too_many = F.col("selected_rows") > max_lines
    verdict = (
        F.when(too_many, "too_many_lines")
        .when(F.col("_unreadable"), "source_unavailable")
        .when(F.col("_over").isNotNull(), "too_many_bytes")
        .otherwise("accepted")
    )
    return joined.select(
        *keys,
        verdict.alias("verdict"),
        F.col("selected_rows").alias("selected_lines"),
        F.when(~too_many & ~F.coalesce("_unreadable", F.lit(False)), F.coalesce("_over", "_all")).alias("selected_bytes"),
    )
