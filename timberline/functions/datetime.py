"""Line-start date-times: six fixed-width formats, precision kept, keys without a time zone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LONG_MIN = -(2**63)
DAY_MS = 86_400_000


@dataclass(frozen=True)
class Format:
    """One date-time format: how it looks and how many fraction digits it carries."""

    id: str
    pattern: str
    date_separator: str
    has_seconds: bool
    fraction_separator: str
    fraction_digits: int

    @property
    def length(self) -> int:
        return len(self.pattern)

    @property
    def precision(self) -> str:
        if self.fraction_digits:
            return {2: "centisecond", 3: "millisecond"}[self.fraction_digits]
        return "second" if self.has_seconds else "minute"


# Format ids and patterns.
FORMATS = (
    Format("LOG-DT-001", "YYYY/MM/DD HH:mm:ss.SSS", "/", True, ".", 3),
    Format("LOG-DT-002", "YYYY-MM-DD HH:mm:ss:SSS", "-", True, ":", 3),
    Format("LOG-DT-003", "YYYY/MM/DD HH:mm:ss.SS", "/", True, ".", 2),
    Format("LOG-DT-004", "YYYY/MM/DD HH:mm:ss:SS", "/", True, ":", 2),
    Format("LOG-DT-005", "YYYY/MM/DD HH:mm:ss", "/", True, "", 0),
    Format("LOG-DT-006", "YYYY/MM/DD HH:mm", "/", False, "", 0),
)
BY_ID = {f.id: f for f in FORMATS}


def _not_followed_by(fmt: Format) -> str:
    """Look-ahead that refuses input whose digits go on past what the format reads."""
    if fmt.fraction_digits:
        return "(?![0-9])"
    if fmt.has_seconds:
        # a colon may follow when no digit, or exactly two digits, come after it
        return "(?![0-9.])(?!:[0-9](?:$|[^0-9]|[0-9]{2}))"
    return "(?![0-9:.])"


def line_regex(fmt: Format) -> str:
    """Java regex that a line of this format matches at column 0; only the calendar day stays unchecked."""
    date = fmt.date_separator.join(["[0-9]{4}", "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])"])
    time = "(?:[01][0-9]|2[0-3]):[0-5][0-9]"
    if fmt.has_seconds:
        time += ":[0-5][0-9]"
    if fmt.fraction_digits:
        time += f"[{fmt.fraction_separator}][0-9]{{{fmt.fraction_digits}}}"
    return f"^{date} {time}{_not_followed_by(fmt)}"


# The expressions are written as SQL text: one parse per expression instead of one
# gateway call per node, which is what building them from Columns costs.


def _case(format_id: str, value: Callable[[Format], str]) -> str:
    return f"CASE {format_id} " + " ".join(f"WHEN '{f.id}' THEN {value(f)}" for f in FORMATS) + " END"


def _case_of_hit(hit: str, value: Callable[[Format], str]) -> str:
    return f"CASE {hit} " + " ".join(f"WHEN {i} THEN {value(f)}" for i, f in enumerate(FORMATS, 1)) + " END"


def _matches(text: str, fmt: Format) -> str:
    return f"{text} RLIKE '{line_regex(fmt)}'"


def _ms_of(text: str, seconds: str, fraction: str) -> str:
    """Epoch ms of the digits at the fixed positions; NULL for a day the calendar does not have."""

    def number(start: int, length: int) -> str:
        return f"try_cast(substring({text}, {start}, {length}) AS BIGINT)"

    day = f"CAST(unix_date(try_cast(replace(substring({text}, 1, 10), '/', '-') AS DATE)) AS BIGINT)"
    parts = [f"{day} * {DAY_MS}L", f"{number(12, 2)} * 3600000L", f"{number(15, 2)} * 60000L", seconds, fraction]
    return " + ".join(p.format(ss=number(18, 2), f2=number(21, 2), f3=number(21, 3)) for p in parts if p)


def key_with(text: str, fmt: Format) -> Column:
    """Comparison key of column ``text`` under ``fmt``: ms of the local wall clock, NULL when the line does not match."""
    seconds = "{ss} * 1000L" if fmt.has_seconds else ""
    fraction = {0: "", 2: "{f2} * 10L", 3: "{f3}"}[fmt.fraction_digits]
    return F.expr(f"CASE WHEN {_matches(text, fmt)} THEN {_ms_of(text, seconds, fraction)} END")


def key_for(text: str, format_id: str) -> Column:
    """Comparison key under the format named by column ``format_id``; a NULL format means undated."""
    seconds = _case(format_id, lambda f: "{ss} * 1000L" if f.has_seconds else "0L")
    fraction = _case(format_id, lambda f: {0: "0L", 2: "{f2} * 10L", 3: "{f3}"}[f.fraction_digits])
    matched = _case(format_id, lambda f: _matches(text, f))
    return F.expr(f"CASE WHEN {matched} THEN {_ms_of(text, seconds, fraction)} END")


def precision_of(format_id: str) -> Column:
    """Precision name of a format id column."""
    return F.expr(_case(format_id, lambda f: f"'{f.precision}'"))


def display_timestamp(text: str, format_id: str) -> Column:
    """Display form of the date-time at the start of column ``text``, to the precision it was written in."""

    def shown(fmt: Format) -> str:
        date = f"replace(substring({text}, 1, 10), '/', '-')"
        if fmt.fraction_digits:
            digits = f"substring({text}, 21, {fmt.fraction_digits})"
            return f"concat({date}, 'T', substring({text}, 12, 8), '.', {digits})"
        return f"concat({date}, 'T', substring({text}, 12, {8 if fmt.has_seconds else 5}))"

    return F.when(key_for(text, format_id).isNotNull(), F.expr(_case(format_id, shown)))


def parse_auto(df: DataFrame, text: str = "text") -> DataFrame:
    """Try all formats on ``text``.

    Adds ``candidates`` (every format that matches, in id order), ``outcome``
    (``NoMatch``, ``Matched``, or ``Ambiguous`` when formats disagree on key or
    length) and, where matched, ``format``, ``precision``, ``key_ms`` and ``matched_len``.
    """
    keys = [f"_key_{i}" for i in range(len(FORMATS))]
    tried = df.withColumns({k: key_with(text, fmt) for k, fmt in zip(keys, FORMATS)})
    hits = [
        f"CASE WHEN {k} IS NOT NULL THEN named_struct('format', '{fmt.id}', 'precision', '{fmt.precision}', "
        f"'key_ms', {k}, 'matched_len', {fmt.length}) END"
        for k, fmt in zip(keys, FORMATS)
    ]
    lengths = ", ".join(f"CASE WHEN {k} IS NOT NULL THEN {fmt.length} END" for k, fmt in zip(keys, FORMATS))
    of_keys = ", ".join(keys)
    agree = f"least({of_keys}) = greatest({of_keys}) AND least({lengths}) = greatest({lengths})"
    first = f"coalesce({', '.join(hits)})"
    return tried.selectExpr(
        *df.columns,
        f"array_compact(array({', '.join(hits)})) AS candidates",
        f"CASE WHEN coalesce({of_keys}) IS NULL THEN 'NoMatch' WHEN {agree} THEN 'Matched' ELSE 'Ambiguous' END AS outcome",
        f"CASE WHEN {agree} THEN {first} END AS _first",
    ).select(
        *df.columns, "candidates", "outcome", "_first.format", "_first.precision", "_first.key_ms", "_first.matched_len"
    )


def mark(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``hit`` and ``hit_key``: the number of the format a line matches (0 for none) and the key under it.

    Boundary rules leave one format per line, except that whatever matches 004 also matches
    005; such a line has hit 4. So two narrow columns hold all that any later choice of format needs, and
    the text is parsed once, before that choice is known. One character tells which format can match.
    """
    seconds, fraction = "{ss} * 1000L", {2: "{f2} * 10L", 3: "{f3}"}
    number = {fmt: i for i, fmt in enumerate(FORMATS, 1)}
    of = {fmt.id[-3:]: fmt for fmt in FORMATS}
    # No rule looks past the 24th character, so long lines cost no more than short ones.
    df, text = df.withColumn("_head", F.substring(text, 1, 24)), "_head"

    def at(position: int) -> str:
        return f"substring({text}, {position}, 1)"

    def hit(id_: str, otherwise: str = "0") -> str:
        return f"CASE WHEN {_matches(text, of[id_])} THEN {number[of[id_]]} ELSE {otherwise} END"

    found = (
        f"CASE WHEN {text} IS NULL OR NOT ({at(11)} = ' ' AND {at(14)} = ':') THEN 0 "
        f"WHEN {at(5)} = '-' THEN {hit('002')} WHEN {at(17)} <> ':' THEN {hit('006')} "
        f"WHEN {at(20)} = '.' THEN {hit('001', hit('003'))} "
        f"WHEN {at(20)} = ':' THEN {hit('004', hit('005'))} ELSE {hit('005')} END"
    )
    key = _ms_of(
        text,
        _case_of_hit("_hit", lambda f: seconds if f.has_seconds else "0L"),
        _case_of_hit("_hit", lambda f: fraction.get(f.fraction_digits, "0L")),
    )
    keyed = df.withColumn("_hit", F.expr(found)).withColumn("hit_key", F.expr(f"CASE WHEN _hit > 0 THEN {key} END"))
    # a day the calendar does not have
    return keyed.withColumn("hit", F.when(F.col("hit_key").isNull(), 0).otherwise(F.col("_hit"))).drop("_hit", "_head")


def key_of_hit(format_id: str) -> Column:
    """Key of a marked line under the format in column ``format_id``."""
    own = _case(format_id, lambda f: f"CASE WHEN hit = {FORMATS.index(f) + 1} THEN hit_key END")
    to_second = "CASE WHEN format_id = 'LOG-DT-005' AND hit = 4 THEN hit_key - pmod(hit_key, 1000L) END"
    return F.expr(f"coalesce({own}, {to_second.replace('format_id', format_id)})")


def outcome_of_hit() -> Column:
    """``NoMatch``, ``Matched`` or ``Ambiguous`` for a marked line."""
    return F.expr("CASE hit WHEN 0 THEN 'NoMatch' WHEN 4 THEN 'Ambiguous' ELSE 'Matched' END")


def format_of_hit() -> Column:
    """Format id of a matched, unambiguous marked line."""
    return F.expr("CASE WHEN hit NOT IN (0, 4) THEN concat('LOG-DT-00', hit) END")


def format_catalog(spark: SparkSession) -> DataFrame:
    """The six formats as a table."""
    rows = [(f.id, f.pattern, f.length, f.precision) for f in FORMATS]
    return spark.createDataFrame(rows, "format STRING, pattern STRING, matched_len INT, precision STRING")
