"""Configured sources and log profiles: which profile applies to a path, and is the table sound.

``profiles`` is ``pos, name, path_pattern, priority, encoding, ansi_codepage, datetime_format``
in list order; ``sources`` has ``source_id, path`` and optionally ``manual_profile``.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.datetime import FORMATS
from timberline.functions.encoding import known_codepage, named_codepage
from timberline.functions.paths import SEPARATOR, fixed_depth, folded, is_pattern, literal_runs, pattern_regex, pattern_subject, prefix_of, segments
from timberline.operators.prefix import global_positions
from timberline.session import small_side


def resolve_profile_exact(sources: DataFrame, profiles: DataFrame) -> DataFrame:
    """``source_id, exact_name``: the first profile in list order whose plain path equals the source's."""
    exact = (
        profiles.filter(~is_pattern("path_pattern"))
        .groupBy(folded("path_pattern").alias("_path"))
        .agg(F.min_by("name", "pos").alias("exact_name"))
    )
    return sources.select("source_id", folded("path").alias("_path")).join(exact, "_path").select("source_id", "exact_name")


def glob_matches(sources: DataFrame, profiles: DataFrame) -> DataFrame:
    """``source_id, pos, name, priority`` of every pattern a path matches.

    An equi-join on the pattern's leading wildcard-free segments picks the candidates. Those whose path begins and ends as the pattern does
    and holds the longest text between two wildcards are matched by regex, as a regex that comes from a column is compiled for each row.
    """
    runs = literal_runs("path_pattern")
    patterns = profiles.filter(is_pattern("path_pattern")).select(
        "pos",
        "name",
        "priority",
        fixed_depth("path_pattern").alias("_depth"),
        pattern_regex("path_pattern").alias("_regex"),
        runs[0].alias("_begin"),
        F.element_at(runs, -1).alias("_finish"),
        F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("text"))))["text"].alias("_inside"),
        "path_pattern",
    )
    patterns = patterns.withColumn("_prefix", prefix_of("path_pattern", F.col("_depth"))).drop("path_pattern")
    # A list of paths is a small file that one task would read, and each path takes long. Dealt by id, its matches stay in one task as well.
    cut = sources.select("source_id", "path").repartition("source_id").select(
        "source_id", pattern_subject("path").alias("_subject"), F.concat(F.lit(SEPARATOR), pattern_subject("path")).alias("_whole"), segments("path").alias("_parts")
    )
    depths = F.sequence(F.lit(0), F.size("_parts"))
    paths = cut.select("source_id", "_subject", "_whole", F.posexplode(F.transform(depths, lambda d: F.array_join(F.slice("_parts", F.lit(1), d), SEPARATOR))).alias("_depth", "_prefix"))
    # A list of patterns that fits is sent to the paths: then no path is shuffled, however many share a prefix.
    texts = [F.octet_length(c) for c in ("_regex", "_prefix", "name", "_begin", "_finish", "_inside")]
    patterns = small_side(patterns, 48, reduce(add, texts))
    whole = F.col("_whole")
    likely = whole.endswith(F.col("_finish")) & F.contains(whole, F.col("_inside")) & whole.startswith(F.col("_begin"))
    return (
        paths.join(patterns, ["_depth", "_prefix"])
        .filter(likely & F.expr("_subject RLIKE _regex"))
        .select("source_id", "pos", "name", "priority")
    )


def resolve_profile_glob(sources: DataFrame, profiles: DataFrame) -> DataFrame:
    """Keep the highest priority per source; more than one left is ambiguous.

    ``source_id, glob_name, candidates``: the name is NULL when ambiguous, candidates come in list order.
    """
    # A source matches at most as many rows as the profile list is long.
    matches = glob_matches(sources, profiles).groupBy("source_id").agg(
        F.max("priority").alias("_best"), F.array_sort(F.collect_list(F.struct("pos", "name", "priority"))).alias("_all")
    )
    best = F.filter("_all", lambda c: c["priority"].eqNullSafe(F.col("_best")))
    left = matches.filter(F.col("_best").isNotNull()).select("source_id", F.transform(best, lambda c: c["name"]).alias("candidates"))
    return left.select(
        "source_id", F.when(F.size("candidates") == 1, F.col("candidates")[0]).alias("glob_name"), "candidates"
    )


def resolve_profile(sources: DataFrame, profiles: DataFrame) -> DataFrame:
    """Manual choice, then exact path, then pattern: ``source_id, route, profile_name, candidates``.

    A manual name is compared as written; an unknown one is ``manual_not_found`` and nothing else is tried.
    """
    names = profiles.groupBy("name").agg(F.min("pos").alias("_manual_pos"))
    asked = sources.withColumn("name", F.col("manual_profile")).join(names, "name", "left").drop("name")
    asked = asked.join(resolve_profile_exact(sources, profiles), "source_id", "left")
    asked = asked.join(resolve_profile_glob(sources, profiles), "source_id", "left")
    manual = F.col("manual_profile").isNotNull()
    route = (
        F.when(manual & F.col("_manual_pos").isNotNull(), "manual")
        .when(manual, "manual_not_found")
        .when(F.col("exact_name").isNotNull(), "exact")
        .when(F.col("glob_name").isNotNull(), "glob")
        .when(F.col("candidates").isNotNull(), "ambiguous")
        .otherwise("no_match")
    )
    chosen = asked.withColumn("route", route)
    name = (
        F.when(F.col("route") == "manual", F.col("manual_profile"))
        .when(F.col("route") == "exact", F.col("exact_name"))
        .when(F.col("route") == "glob", F.col("glob_name"))
    )
    return chosen.select(
        "source_id",
        "route",
        name.alias("profile_name"),
        F.when(F.col("route") == "ambiguous", F.col("candidates")).alias("candidates"),
    )


def profile_settings(resolved: DataFrame, profiles: DataFrame) -> DataFrame:
    """What a resolution means for reading: ``profile_format, encoding_name, ansi_codepage, profile_unresolved``."""
    by_name = profiles.select(
        F.col("name").alias("profile_name"),
        F.when(F.col("datetime_format") != "auto", F.col("datetime_format")).alias("profile_format"),
        F.when(F.col("encoding") != "auto", F.col("encoding")).alias("encoding_name"),
        "ansi_codepage",
    )
    return resolved.join(by_name, "profile_name", "left").select(
        "source_id",
        "route",
        "profile_name",
        "profile_format",
        "encoding_name",
        "ansi_codepage",
        F.col("route").isin("ambiguous", "manual_not_found").alias("profile_unresolved"),
    )


def _repeats(df: DataFrame, by: list[str], kind: Column) -> DataFrame:
    """Rows that are not the first of their group, with the first one's position."""
    first = df.groupBy(*by).agg(F.min("pos").alias("first_pos"), F.count("*").alias("_n")).filter(F.col("_n") > 1)
    return (
        df.join(first, by)
        .filter(F.col("pos") > F.col("first_pos"))
        .select("pos", kind.alias("conflict"), "first_pos")
    )


def profile_conflicts(profiles: DataFrame) -> DataFrame:
    """``pos, conflict, first_pos``: repeated names, repeated plain paths, repeated patterns of one priority.

    A profile with a repeated name is left out of the pattern checks.
    """
    usable = profiles.filter((F.col("name") != "") & (F.col("path_pattern") != ""))
    named = _repeats(usable, ["name"], F.lit("duplicate_name"))
    rest = usable.join(named.select("pos"), "pos", "left_anti").select(
        "pos",
        folded("path_pattern").alias("_pattern"),
        is_pattern("path_pattern").alias("_glob"),
        F.when(is_pattern("path_pattern"), F.col("priority")).otherwise(F.lit(0)).alias("_level"),
    )
    kind = F.when(F.col("_glob"), "duplicate_glob").otherwise("duplicate_exact")
    return named.unionByName(_repeats(rest, ["_pattern", "_glob", "_level"], kind))


def profile_value_checks(profiles: DataFrame) -> DataFrame:
    """``pos, violation``: every bad value of every profile."""
    name = F.col("encoding")
    checks = F.array(
        F.when(F.coalesce("name", F.lit("")) == "", "empty_name"),
        F.when(F.coalesce("path_pattern", F.lit("")) == "", "empty_path_pattern"),
        F.when(F.coalesce(name, F.lit("")) == "", "empty_encoding").when(
            (name != "auto") & ~_readable_name(name), "bad_encoding_name"
        ),
        F.when(F.col("ansi_codepage").isNotNull() & ~known_codepage(F.col("ansi_codepage")), "unknown_codepage"),
        F.when(
            ~F.coalesce(F.col("datetime_format"), F.lit("")).isin("auto", *[f.id for f in FORMATS]),
            "unknown_datetime_format",
        ),
    )
    return profiles.select("pos", F.explode(F.array_compact(checks)).alias("violation"))


def _readable_name(name: Column) -> Column:
    return (F.lower(F.trim(name)) == "utf-8") | named_codepage(name).isNotNull()


class InvalidProfiles(ValueError):
    """Profiles that resolution must not run on; ``violations`` is the table of all of them, ``pos, violation``."""

    def __init__(self, count: int, violations: DataFrame):
        first = violations.orderBy("pos").first()
        super().__init__(f"profile table: {count} violations, the first in row {first['pos']}: {first['violation']}")
        self.violations = violations


def require_valid(profiles: DataFrame) -> DataFrame:
    """``profiles`` itself, or an error naming what is wrong: resolution does not run on a bad table."""
    bad = profile_value_checks(profiles).select("pos", "violation").unionByName(
        profile_conflicts(profiles).select("pos", F.col("conflict").alias("violation"))
    )
    n = bad.count()
    if n:
        raise InvalidProfiles(n, bad)
    return profiles


def source_ordinal(configured: DataFrame, opened: DataFrame, partitions: int | None = None) -> DataFrame:
    """``source_id, path, source_ordinal``: configured ones in list order, then each opened batch by folded path.

    ``configured`` is ``source_id, path, config_pos``; ``opened`` is ``source_id, path, batch`` with batches counting up.
    """
    plain = F.replace("path", F.lit("/"), F.lit("\\"))
    listed = configured.select("source_id", "path", F.lit(-1).alias("_batch"), F.col("config_pos").cast("bigint").alias("_pos"), F.lit("").alias("_low"), F.lit("").alias("_plain"))
    added = opened.select("source_id", "path", F.col("batch").cast("int").alias("_batch"), F.lit(0).cast("bigint").alias("_pos"), F.lower(plain).alias("_low"), plain.alias("_plain"))
    ordered = global_positions(listed.unionByName(added), ["_batch", "_pos", "_low", "_plain", "source_id"], partitions)
    return ordered.select("source_id", "path", F.col("position").alias("source_ordinal"))


def dedupe_sources(sources: DataFrame, already_open: DataFrame | None = None) -> DataFrame:
    """One source per physical file: the first by ordinal, and none that is open already."""
    firsts = sources.groupBy("file_id").agg(F.min("source_ordinal").alias("source_ordinal"))
    kept = sources.join(firsts, ["file_id", "source_ordinal"], "left_semi")
    return kept if already_open is None else kept.join(already_open.select("file_id"), "file_id", "left_anti")


def source_catalog(configured: DataFrame, opened: DataFrame) -> DataFrame:
    """Configured names first in list order (``not_opened`` when absent), then the rest in opening order.

    ``configured`` is ``config_pos, name``; ``opened`` is ``target_id, source_name, origin, status``.
    Sort by ``section, place`` to list.
    """
    # A later session of the same configured name replaces an earlier one.
    is_config = (F.col("origin") == "configured") & F.col("source_name").isNotNull()
    named = opened.filter(is_config).groupBy("source_name").agg(
        F.max_by(F.struct("target_id", "status"), "target_id").alias("_session"), F.min("target_id").alias("_opened_at")
    )
    both = configured.join(named, configured["name"] == named["source_name"], "full_outer").select(
        F.when(F.col("name").isNotNull(), 0).otherwise(1).alias("section"),
        F.coalesce(F.col("config_pos").cast("bigint"), F.col("_opened_at") + (1 << 40)).alias("place"),
        F.coalesce("name", "source_name").alias("display_name"),
        F.lit("configured").alias("origin"),
        F.col("_session.target_id").alias("target_id"),
        F.coalesce(F.col("_session.status"), F.lit("not_opened")).alias("status"),
    )
    others = opened.filter(~F.coalesce(is_config, F.lit(False))).select(
        F.lit(1).alias("section"),
        F.col("target_id").cast("bigint").alias("place"),
        F.col("source_name").alias("display_name"),
        "origin",
        F.col("target_id"),
        "status",
    )
    return both.unionByName(others)


def close_source(items: DataFrame, closed: DataFrame) -> DataFrame:
    """Items without those of closed sources (``source_id``)."""
    return items.join(closed.select("source_id").distinct(), "source_id", "left_anti")
