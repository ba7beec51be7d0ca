"""Filters over items with bodies, and time correlation between two sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.patterns import required_literals
from timberline.operators import assemble
from timberline.operators.prefix import BLOCK_ROWS, global_positions, running
from timberline.session import stored

# 2^22 ms, a little over an hour of distinct keys per block.
KEY_BLOCK = 1 << 22


def filter_text(item_lines: DataFrame, needle: str, ignore_case: bool = False) -> DataFrame:
    """``source_id, seq, raw_text`` of items whose body contains ``needle``.

    ``item_lines`` is ``source_id, seq, line_no, text``. Lines are filtered where they are read, and bodies are put together
    for the items of matching lines only. A needle of several lines is looked for by its longest line first.
    """
    fold = F.lower if ignore_case else (lambda c: c)
    longest = max(needle.split("\n"), key=len)
    hits = item_lines.filter(F.contains(fold(F.col("text")), fold(F.lit(longest))))
    found = assemble.bodies(item_lines, hits)
    return found.filter(F.contains(fold(F.col("raw_text")), fold(F.lit(needle)))) if "\n" in needle else found


def filter_regex(item_lines: DataFrame, pattern: str, literal: str | None = None, within_line: bool = False) -> DataFrame:
    """``source_id, seq, raw_text`` of items whose body matches ``pattern`` somewhere.

    The match is made on the whole body. Bodies are put together only for items with a line that holds a string that every match must hold: what the pattern's own
    letters say, or a ``literal`` without LF that the caller knows of. A caller may also know that no match reaches beyond a line (``within_line``). Where a
    pattern requires no letters, as ``[0-9]+`` does, all bodies are put together.
    """
    line = F.col("text")
    letters = (literal,) if literal else required_literals(pattern)
    conditions = [reduce(or_, [F.contains(line, F.lit(x)) for x in letters])] if letters else []
    if within_line:
        conditions.append(line.rlike(pattern))
    if not conditions:
        return assemble.bodies(item_lines).filter(F.col("raw_text").rlike(pattern))
    return assemble.bodies(item_lines, item_lines.filter(reduce(and_, conditions))).filter(F.col("raw_text").rlike(pattern))


def filter_time_range(items: DataFrame, start_ms: int, end_ms: int, undated: bool = False) -> DataFrame:
    """Items with ``start_ms <= key < end_ms``; ``undated`` also admits undated items by their carried key."""
    key = F.col("sort_key") if undated else F.col("key_ms")
    return items.filter((key >= start_ms) & (key < end_ms))


def filter_source(items: DataFrame, source_ids: Sequence[int]) -> DataFrame:
    """Items of some sources."""
    return items.filter(F.col("source_id").isin(*source_ids))


def filter_level(first_lines: DataFrame, level_pattern: str, levels: Sequence[str]) -> DataFrame:
    """Items whose level, group 1 of ``level_pattern``, is one of ``levels``; adds ``level``.

    ``first_lines`` is one row per item with the item's first line as ``text``: a level stands on the line that starts an item.
    """
    return first_lines.withColumn("level", F.regexp_extract("text", level_pattern, 1)).filter(F.col("level").isin(*levels))


def time_correlate(left: DataFrame, right: DataFrame, tolerance_ms: int, identifier: str | None = None) -> DataFrame:
    """For each dated item of ``left``: which items of ``right`` lie within the tolerance.

    The related items are consecutive in ``right`` ordered by (identifier, key),
    so they are given as a range, ``match_start`` and ``match_count``, into that order: exact, and one
    row per left item however dense the times are. That order is (identifier, key, source_id, seq), which
    :func:`related_items` resolves. ``basis`` says whether time alone or time and
    identifier were used. An item without identifier has none in common with any other: it comes back with no match.
    Neither side's items are changed or merged.
    """
    keys = [identifier] if identifier else []
    dated_right = right.filter(F.col("key_ms").isNotNull())
    dated_left = left.filter(F.col("key_ms").isNotNull())
    if identifier:
        dated_right = dated_right.filter(F.col(identifier).isNotNull())
    # Both sides shrink to distinct keys before anything is ordered.
    there = dated_right.groupBy(*keys, F.col("key_ms").alias("_at")).agg(F.count("*").alias("_n"))
    asked = dated_left.select(*keys, "key_ms").dropna().distinct()
    probes = asked.select(
        *keys, F.explode(F.array(F.col("key_ms") - tolerance_ms - 1, F.col("key_ms") + tolerance_ms)).alias("_at")
    ).distinct()
    points = there.unionByName(probes.withColumn("_n", F.lit(0).cast("bigint"))).groupBy(*keys, "_at").agg(F.sum("_n").alias("_n"))
    through = stored(running(points, keys, ["_at"], {"_through": ("sum", F.col("_n"))}, KEY_BLOCK), "through")

    def count_up_to(name: str, shift: int) -> DataFrame:
        return through.select(*keys, (F.col("_at") - shift).alias("key_ms"), F.col("_through").alias(name))

    bounds = asked.join(count_up_to("match_start", -tolerance_ms - 1), [*keys, "key_ms"]).join(
        count_up_to("_stop", tolerance_ms), [*keys, "key_ms"]
    )
    basis = "time_and_identifier" if identifier else "time"
    zero = F.lit(0).cast("bigint")
    return dated_left.join(bounds, [*keys, "key_ms"], "left").select(
        *left.columns,
        F.coalesce("match_start", zero).alias("match_start"),
        F.coalesce(F.col("_stop") - F.col("match_start"), zero).alias("match_count"),
        F.lit(tolerance_ms).cast("bigint").alias("tolerance_ms"),
        F.lit(basis).alias("basis"),
    )


def related_items(matches: DataFrame, right: DataFrame, identifier: str | None = None, width: int = BLOCK_ROWS) -> DataFrame:
    """The items of ``right`` that chosen rows of :func:`time_correlate` point to, one row per match and item.

    ``matches`` is a chosen part of its result with ``source_id, seq``: the output is as large as their ``match_count`` say. Every match gives
    the columns ``of_source_id, of_seq`` to its items. Positions are counted per identifier, so no order over all items is made.
    """
    keys = [identifier] if identifier else []
    dated = right.filter(F.col("key_ms").isNotNull())
    if identifier:
        dated = dated.filter(F.col(identifier).isNotNull())
    wanted = matches.filter(F.col("match_count") > 0).select(
        *[F.col(k).alias("_id") for k in keys], F.col("source_id").alias("of_source_id"), F.col("seq").alias("of_seq"),
        F.explode(F.sequence(F.col("match_start"), F.col("match_start") + F.col("match_count") - 1)).alias("_place"),
    )
    if identifier:
        joined = _ranked(dated, identifier, width).join(wanted.withColumnRenamed("_id", identifier), [identifier, "_place"])
    else:
        placed = global_positions(dated, ["key_ms", "source_id", "seq"]).withColumnRenamed("position", "_place")
        joined = placed.join(wanted, "_place")
    return joined.select(*right.columns, "of_source_id", "of_seq")


def _ranked(dated: DataFrame, identifier: str, width: int) -> DataFrame:
    """``dated`` with ``_place``, the number of items of the same identifier before each in the order (key, source, seq).

    Counted in three levels, so that no block holds more than ``width`` distinct keys, sources or items of one source at one key: earlier keys of the
    identifier, earlier sources at the key, earlier items of the source at the key. However many items one identifier has at one time, they are spread.
    """
    one = F.lit(1).cast("bigint")
    levels = [[identifier], [identifier, "key_ms"]]
    before = []
    for keys, order in zip(levels, ("key_ms", "source_id")):
        counts = dated.groupBy(*keys, order).agg(F.count("*").alias("_n"))
        earlier = running(counts, keys, [order], {f"_before_{order}": ("sum", F.col("_n"))}, width, include_current=False)
        before.append(earlier.drop("_n"))
    own = running(dated, [*levels[1], "source_id"], ["seq"], {"_own": ("sum", one)}, width, include_current=False)
    placed = own.join(before[0], levels[1]).join(before[1], [*levels[1], "source_id"])
    return placed.withColumn("_place", F.col("_own") + F.col("_before_key_ms") + F.col("_before_source_id")).select(*dated.columns, "_place")
