"""Per-source quality figures, page directories, and measurement arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.prefix import global_positions
from timberline.operators.ranges import byte_sums, sized_ranges
from timberline.operators.timeline import PAGE_ITEMS
from timberline.session import small_side, stored


def source_summary(
    items: DataFrame,
    formats: DataFrame,
    encodings: DataFrame | None = None,
    profiles: DataFrame | None = None,
    invalid: DataFrame | None = None,
    manifest: DataFrame | None = None,
) -> DataFrame:
    """One row per source of ``formats`` (``source_id, format, route, fell_back``), with zero counts for an empty one.

    The optional tables add encoding and route, profile and route, the number of bad bytes and the file size.
    """
    counts = items.groupBy("source_id").agg(
        F.max(F.col("raw_offset") + F.col("raw_len")).alias("content_bytes"),
        (F.count("*") + F.sum("continuation_count")).alias("line_count"),
        F.count("*").alias("item_count"),
        F.count("key_ms").alias("dated_items"),
        (F.count("*") - F.count("key_ms")).alias("undated_items"),
        F.sum("continuation_count").alias("continuation_total"),
        F.max("continuation_count").alias("longest_continuation"),
        F.bool_or(~F.col("confirmed")).alias("unconfirmed_tail"),
    )
    numbers = [c for c in counts.columns if c not in ("source_id", "unconfirmed_tail")]
    result = (
        formats.select("source_id", "format", F.col("route").alias("format_route"), "fell_back")
        .join(counts, "source_id", "left")
        .fillna(0, numbers)
        .fillna(False, ["unconfirmed_tail"])
    )
    if encodings is not None:
        result = result.join(
            encodings.select("source_id", "encoding", F.col("route").alias("encoding_route"), "warning", "error"), "source_id", "left"
        )
    if profiles is not None:
        result = result.join(
            profiles.select("source_id", "profile_name", F.col("route").alias("profile_route")), "source_id", "left"
        )
    if invalid is not None:
        counts_of = invalid.select("source_id", "invalid_count").distinct()
        result = result.join(counts_of, "source_id", "left").fillna(0, ["invalid_count"])
    if manifest is not None:
        result = result.join(manifest.select("source_id", F.col("size").alias("file_bytes")), "source_id", "left")
    return result


def page_directory(timeline: DataFrame, page: int = PAGE_ITEMS) -> DataFrame:
    """Fixed pages of a view: ``page_no, start, count, bytes``."""
    number = F.floor(F.col("position") / page).cast("bigint")
    return (
        timeline.groupBy(number.alias("page_no"))
        .agg(F.count("*").alias("count"), F.sum("body_bytes").alias("bytes"))
        .select("page_no", (F.col("page_no") * page).alias("start"), "count", "bytes")
    )


def latency_summary(samples: DataFrame, by: str = "variant", value: str = "ms", p: float = 0.95) -> DataFrame:
    """Exact ``n, median, p95, min, max`` per variant; the percentile is the nearest rank.

    Distinct values are counted first and ordered by one distributed sort, so a
    variant with most of the samples is not gathered anywhere.
    """
    counted = samples.groupBy(by, value).agg(F.count("*").alias("_n"))
    totals = samples.groupBy(by).agg(
        F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    ordered = global_positions(counted, [by, value])
    # Read twice: for the variants' first counts and for the ranks.
    upto = stored(_counts_through(ordered, "_n"), "through").join(small_side(totals, 64), by)
    starts = upto.groupBy(by).agg(F.min(F.col("_through") - F.col("_n")).alias("_base"))
    placed = upto.join(small_side(starts, 24), by).select(
        by, value, "n", "min", "max", (F.col("_through") - F.col("_base")).alias("_last"), "_n"
    )
    first = F.col("_last") - F.col("_n")

    def at(rank):
        return F.max(F.when((first <= rank) & (rank < F.col("_last")), F.col(value)))

    nearest = F.greatest(F.least(F.ceil(F.lit(p) * F.col("n")) - 1, F.col("n") - 1), F.lit(0))
    return placed.groupBy(by, "n", "min", "max").agg(
        ((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"),
        at(nearest).alias("p95"),
    ).select(by, "n", "median", "p95", "min", "max")


def _counts_through(ordered: DataFrame, count: str) -> DataFrame:
    """Running sum of ``count`` along ``position``."""
    from timberline.operators.prefix import running

    return running(ordered, [], ["position"], {"_through": ("sum", F.col(count))})


def sample_starts(variants: DataFrame, samples: int, total: int) -> DataFrame:
    """Evenly spaced sample ranges: ``max_items, sample, start`` for each row of ``variants`` (``max_items``)."""
    last_start = F.greatest(F.lit(total) - F.col("max_items"), F.lit(0))
    steps = max(samples - 1, 1)
    return variants.select(
        "max_items", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")
    ).withColumn("start", F.floor(last_start * F.col("sample") / steps).cast("bigint"))


def transfer_volume(timeline: DataFrame, starts: DataFrame, total: int) -> DataFrame:
    """Items and body bytes each sampled range returns: ``max_items, sample, start, items, bytes, truncated``."""
    last = timeline.agg(F.max("position")).first()[0]
    end = F.lit(0 if last is None else last + 1).cast("bigint")
    cut = starts.withColumn("items", F.greatest(F.least(F.col("start") + F.col("max_items"), end) - F.col("start"), F.lit(0)).cast("bigint"))
    sized = sized_ranges(cut.filter("items > 0").withColumn("count", F.col("items")), byte_sums(timeline))
    # Each body was counted with one LF.
    plain = sized.select("max_items", "sample", (F.col("_bytes") - F.col("items") + F.col("_unknown")).alias("bytes"))
    return cut.join(plain, ["max_items", "sample"], "left").select(
        "max_items", "sample", "start", "items", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"),
        (F.col("start") + F.col("items") < total).alias("truncated"),
    )
