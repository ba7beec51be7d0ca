"""Path comparison and path patterns, independent of case and of slash direction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\\"


def _as_column(path: str | Column) -> Column:
    return F.col(path) if isinstance(path, str) else path


def with_backslashes(path: str | Column) -> Column:
    """The path with one kind of separator."""
    return F.replace(_as_column(path), F.lit("/"), F.lit(SEPARATOR))


def folded(path: str | Column) -> Column:
    """The form in which two spellings of one path are equal."""
    return F.upper(with_backslashes(path))


def is_pattern(path: str | Column) -> Column:
    """Does it hold a wildcard?"""
    return _as_column(path).rlike("[*?]")


def segments(path: str | Column) -> Column:
    """The folded path cut at separators."""
    return F.split(folded(path), r"\\")


def pattern_regex(pattern: str | Column) -> Column:
    """Regex for :func:`pattern_subject`: ``*`` and ``?`` stay inside a segment, a ``**`` segment spans any number of them."""
    any_segments = F.lit(r"(?:[^\\]*\\)*")

    def one(segment: Column) -> Column:
        quoted = F.regexp_replace(segment, r"([\[\](){}.+^$|&~#-])", r"\\$1")
        inside = F.replace(F.replace(quoted, F.lit("*"), F.lit(r"[^\\]*")), F.lit("?"), F.lit(r"[^\\]"))
        return F.when(segment == "**", any_segments).otherwise(F.concat(inside, F.lit(r"\\")))

    return F.concat(F.lit("^"), F.array_join(F.transform(segments(pattern), one), ""), F.lit("$"))


def pattern_subject(path: str | Column) -> Column:
    """What :func:`pattern_regex` is matched against."""
    return F.concat(folded(path), F.lit(SEPARATOR))


def literal_runs(pattern: str | Column) -> Column:
    """The texts between wildcards; every match holds all of them in order, the first and the last at its ends.

    Both the pattern and what matches it are taken with a separator before and behind, so a ``**`` for no segments lets two of these share one.
    """
    return F.split(F.concat(F.lit(SEPARATOR), pattern_subject(pattern)), "[*?]+")


def fixed_depth(pattern: str | Column) -> Column:
    """Number of leading segments without a wildcard."""
    parts = segments(pattern)
    first_wild = F.array_position(F.transform(parts, lambda s: s.rlike("[*?]")), True)
    return F.when(first_wild > 0, first_wild - 1).otherwise(F.size(parts)).cast("int")


def prefix_of(path: str | Column, depth: Column) -> Column:
    """The first ``depth`` segments, joined."""
    return F.array_join(F.slice(segments(path), F.lit(1), depth), SEPARATOR)
