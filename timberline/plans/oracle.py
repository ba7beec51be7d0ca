"""SQL counterparts of the queries, for any engine with standard SQL, list and regex functions (run on DuckDB).

They state the expected result in the plainest form (whole-table windows, correlated
counts), not the way the Spark jobs compute it.
"""

from __future__ import annotations

import re

from timberline.functions.datetime import FORMATS
from timberline.plans import fixtures

SQL: dict[str, str] = {}


def _plain(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


class Ctes:
    """Named SELECTs in dependency order, so a query can ask for what it needs."""

    def __init__(self) -> None:
        self.parts: dict[str, tuple[str, tuple[str, ...]]] = {}

    def add(self, name: str, text: str, *needs: str) -> None:
        self.parts[name] = (text.strip(), needs)

    def query(self, text: str, *needs: str) -> str:
        ordered: dict[str, str] = {}

        def visit(name: str) -> None:
            if name not in ordered:
                body, below = self.parts[name]
                for other in below:
                    visit(other)
                ordered[name] = body

        for name in needs:
            visit(name)
        if not ordered:
            return text.strip()
        return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in ordered.items()) + "\n" + text.strip()


C = Ctes()
for _name in dir(fixtures):
    if _name.isupper() and not _name.startswith("_"):
        C.add(_name.lower(), _plain(getattr(fixtures, _name)))

_LONG_MIN = "(-9223372036854775807 - 1)"

# --- lines of the event sources

_MS = "(epoch_us(ts) // 1000) % 1000"
_STAMP = f"""CASE user_id % 6
 WHEN 0 THEN strftime(ts, '%Y/%m/%d %H:%M:%S.') || lpad(CAST({_MS} AS VARCHAR), 3, '0')
 WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S:') || lpad(CAST({_MS} AS VARCHAR), 3, '0')
 WHEN 2 THEN strftime(ts, '%Y/%m/%d %H:%M:%S.') || lpad(CAST({_MS} // 10 AS VARCHAR), 2, '0')
 WHEN 3 THEN strftime(ts, '%Y/%m/%d %H:%M:%S:') || lpad(CAST({_MS} // 10 AS VARCHAR), 2, '0')
 WHEN 4 THEN strftime(ts, '%Y/%m/%d %H:%M:%S')
 ELSE strftime(ts, '%Y/%m/%d %H:%M') END"""
C.add(
    "event_lines",
    f"""
SELECT CAST(user_id % 6 AS INTEGER) AS source_id, event_id, 0 AS k,
       {_STAMP} || ' ' || event_type || ' user=' || user_id || ' v=' || CAST(round(value * 100) AS BIGINT) AS text FROM events
UNION ALL SELECT CAST(user_id % 6 AS INTEGER), event_id, 1, '  props ' || props FROM events WHERE event_type = 'error'
UNION ALL SELECT CAST(user_id % 6 AS INTEGER), event_id, 2, '  at frame ' || (event_id % 7) FROM events WHERE event_type = 'error' AND event_id % 2 = 0
UNION ALL SELECT 0, -1, CAST(i AS INTEGER), '-- preamble ' || i FROM range(2) AS t(i)
""",
)
_NUMBERED = """
SELECT source_id, line_no, text, CAST(strlen(text) AS BIGINT) AS raw_len,
       CAST(sum(strlen(text) + 1) OVER (PARTITION BY source_id ORDER BY line_no) - strlen(text) - 1 AS BIGINT) AS raw_offset, TRUE AS confirmed
FROM (SELECT source_id, text, row_number() OVER (PARTITION BY source_id ORDER BY {order}) AS line_no FROM {source})
"""
C.add("log_lines", _NUMBERED.format(order="event_id, k", source="event_lines"), "event_lines")
C.add(
    "doc_split",
    "SELECT doc_id AS source_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents",
)
C.add("doc_lines", _NUMBERED.format(order="k", source="doc_split"), "doc_split")
C.add(
    "sources",
    """SELECT DISTINCT CAST(user_id % 6 AS INTEGER) AS source_id, 'app-' || (user_id % 6) AS label,
       CAST((user_id % 6 * 5 + 2) % 6 AS INTEGER) AS source_ordinal FROM events""",
)

# --- date-times, by position and character class

_D = "[0-9]"


def _shape(fmt) -> str:
    date = fmt.date_separator.join([_D * 4, _D * 2, _D * 2])
    clock = f"{_D * 2}:{_D * 2}"
    if fmt.has_seconds:
        clock += f":{_D * 2}"
    if fmt.fraction_digits:
        return f"^{date} {clock}[{fmt.fraction_separator}]{_D * fmt.fraction_digits}($|[^0-9])"
    if fmt.has_seconds:
        return f"^{date} {clock}($|[^0-9.:]|:($|[^0-9])|:{_D * 2}($|[^0-9]))"
    return f"^{date} {clock}($|[^0-9.:])"


def _key(fmt, text: str = "text") -> str:
    day = f"try_cast(replace(substr({text}, 1, 10), '/', '-') AS DATE)"
    ok = [f"regexp_matches({text}, '{_shape(fmt)}')", f"{day} IS NOT NULL"]
    ok += [f"substr({text}, 12, 2) <= '23'", f"substr({text}, 15, 2) <= '59'"]
    ms = f"({day} - DATE '1970-01-01') * 86400000 + CAST(substr({text}, 12, 2) AS BIGINT) * 3600000 + CAST(substr({text}, 15, 2) AS BIGINT) * 60000"
    if fmt.has_seconds:
        ok.append(f"substr({text}, 18, 2) <= '59'")
        ms += f" + CAST(substr({text}, 18, 2) AS BIGINT) * 1000"
    if fmt.fraction_digits:
        ms += f" + CAST(substr({text}, 21, {fmt.fraction_digits}) AS BIGINT) * {10 ** (3 - fmt.fraction_digits)}"
    return f"CASE WHEN {' AND '.join(ok)} THEN {ms} END"


def _parsed(source: str, columns: str) -> str:
    keys = ", ".join(f"{_key(f)} AS k{i}" for i, f in enumerate(FORMATS, 1))
    return f"SELECT {columns}, {keys} FROM {source}"


_COUNT = " + ".join(f"(k{i} IS NOT NULL)::INT" for i in range(1, 7))
# The formats fix length and meaning of every digit, so two hits always differ in length.
_OUTCOME = f"CASE {_COUNT} WHEN 0 THEN 'NoMatch' WHEN 1 THEN 'Matched' ELSE 'Ambiguous' END"


def _by_hit(value) -> str:
    return "CASE " + " ".join(f"WHEN k{i} IS NOT NULL THEN {value(f, i)}" for i, f in enumerate(FORMATS, 1)) + " END"


def _infer(lines: str) -> str:
    first = _by_hit(lambda f, i: f"'{f.id}'")
    return f"""
SELECT source_id, coalesce(hit.outcome, 'NoMatch') AS outcome, CASE WHEN hit.outcome = 'Matched' THEN hit.format END AS format,
       hit.line_no AS decided_at, coalesce(hit.outcome = 'Ambiguous', FALSE) AS fell_back
FROM (SELECT source_id, min_by({{'outcome': outcome, 'format': format, 'line_no': line_no}}, line_no) FILTER (WHERE outcome <> 'NoMatch') AS hit
      FROM (SELECT source_id, line_no, {_OUTCOME} AS outcome, {first} AS format
            FROM ({_parsed(lines, 'source_id, line_no')})) GROUP BY source_id)
"""


C.add("inferred", _infer("log_lines"), "log_lines")
_KEY_BY_FORMAT = "CASE format " + " ".join(f"WHEN '{f.id}' THEN {_key(f)}" for f in FORMATS) + " END"


def _keyed(lines: str, formats: str) -> str:
    return f"SELECT l.*, f.format, {_KEY_BY_FORMAT} AS key_ms FROM {lines} l LEFT JOIN {formats} f USING (source_id)"


def _assembled(keyed: str) -> str:
    """Lines with item numbers: a new item at each dated line and at each line before the first dated one."""
    return f"""
SELECT *, CAST(sum(CASE WHEN key_ms IS NOT NULL OR dated_before = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY line_no) - 1 AS BIGINT) AS seq
FROM (SELECT *, count(key_ms) OVER (PARTITION BY source_id ORDER BY line_no) AS dated_before FROM {keyed})
"""


_ITEMS = """
SELECT source_id, seq, max(key_ms) AS key_ms, min(line_no) AS first_line, count(*) - 1 AS continuation_count,
       min(raw_offset) AS raw_offset, CAST(max(raw_offset + raw_len) - min(raw_offset) AS BIGINT) AS raw_len,
       arg_max(confirmed, line_no) AS confirmed, string_agg(text, chr(10) ORDER BY line_no) AS raw_text,
       CAST(strlen(string_agg(text, chr(10) ORDER BY line_no)) AS BIGINT) AS body_bytes
FROM {lines} GROUP BY source_id, seq
"""
C.add("keyed", _keyed("log_lines", "inferred"), "log_lines", "inferred")
C.add("item_lines", _assembled("keyed"), "keyed")
C.add("items", _ITEMS.format(lines="item_lines"), "item_lines")
_MERGED = f"""
SELECT row_number() OVER (ORDER BY coalesce(key_ms, {_LONG_MIN}), source_ordinal, seq) - 1 AS position, i.*,
       coalesce(key_ms, {_LONG_MIN}) AS sort_key
FROM {{items}} i JOIN sources USING (source_id)
"""
C.add("timeline", _MERGED.format(items="items"), "items", "sources")

# --- scans, sources, sinks

C.add(
    "file_lines",
    """SELECT CAST((line_no - 1) // 65536 * 6 + source_id AS INTEGER) AS source_id, (line_no - 1) % 65536 + 1 AS line_no, text,
       source_id AS origin FROM log_lines""",
    "log_lines",
)
SQL["scan_log_lines"] = C.query(
    """
SELECT source_id, line_no, CAST(strlen(text) AS INTEGER) AS raw_len, TRUE AS confirmed, text,
       CAST(sum(strlen(text) + CASE WHEN origin = 5 THEN 2 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY line_no)
         - strlen(text) - CASE WHEN origin = 5 THEN 2 ELSE 1 END AS BIGINT) AS raw_offset
FROM file_lines""",
    "file_lines",
)
SQL["unconfirmed_tail"] = C.query(
    "SELECT source_id, count(*) + 1 AS line_count, TRUE AS unconfirmed_tail FROM file_lines GROUP BY source_id", "file_lines"
)
SQL["scan_configured_sources"] = C.query(
    "SELECT source_id, 'app-' || source_id AS label, source_id * 2 AS config_pos, line_no, text FROM file_lines WHERE source_id % 4 <> 3",
    "file_lines",
)
SQL["file_manifest"] = C.query(
    "SELECT source_id, CAST(sum(strlen(text) + CASE WHEN origin = 5 THEN 2 ELSE 1 END) AS BIGINT) AS size, TRUE AS has_mtime FROM file_lines GROUP BY source_id",
    "file_lines",
)
SQL["write_items"] = C.query(
    "SELECT source_id, seq, key_ms, first_line, continuation_count, raw_offset, raw_len, CAST(1 AS BIGINT) AS generation FROM items", "items"
)
_IN_PARTS = "EXISTS (SELECT 1 FROM part_ranges r WHERE position >= r.start AND position < r.start + r.count)"
SQL["write_extract"] = C.query(
    f"""SELECT l.text, count(*) AS n FROM item_lines l JOIN timeline t USING (source_id, seq) WHERE {_IN_PARTS} GROUP BY l.text""",
    "item_lines",
    "timeline",
    "part_ranges",
)

# --- profiles

C.add(
    "folded",
    """SELECT source_id, manual_profile, upper(replace(path, chr(92), '/')) AS p FROM path_cases""",
    "path_cases",
)
C.add(
    "patterns",
    r"""SELECT pos, name, priority, contains(path_pattern, '*') OR contains(path_pattern, '?') AS is_glob,
  upper(replace(path_pattern, chr(92), '/')) AS pattern FROM profile_table""",
    "profile_table",
)
C.add(
    "regexes",
    r"""SELECT pos, name, priority, '^' || replace(replace(replace(replace(replace(
    regexp_replace(pattern, '/[*][*]$', '<tail>'), '**/', '<any>'), '.', '[.]'), '*', '[^/]*'), '<any>', '(.*/)?'), '<tail>', '(/.*)?') || '$' AS re0
  FROM patterns WHERE is_glob""",
    "patterns",
)
C.add(
    "globs",
    """SELECT source_id, pos, name, priority FROM folded, (SELECT pos, name, priority,
   replace(replace(replace(re0, '?', '[^/]'), ')[^/]', ')?'), '((', '((') AS re FROM regexes) r WHERE regexp_matches(p, re)""",
    "folded",
    "regexes",
)
C.add(
    "exact",
    "SELECT source_id, min_by(name, pos) AS exact_name FROM folded JOIN patterns ON NOT is_glob AND p = pattern GROUP BY source_id",
    "folded",
    "patterns",
)
C.add(
    "best_globs",
    """SELECT source_id, CASE WHEN count(*) = 1 THEN min(name) END AS glob_name, string_agg(name, ',' ORDER BY pos) AS candidates
   FROM (SELECT *, rank() OVER (PARTITION BY source_id ORDER BY priority DESC) AS r FROM globs) WHERE r = 1 GROUP BY source_id""",
    "globs",
)
SQL["resolve_profile_exact"] = C.query("SELECT * FROM exact", "exact")
SQL["resolve_profile_glob"] = C.query("SELECT * FROM best_globs", "best_globs")
SQL["resolve_profile"] = C.query(
    """
SELECT source_id, route,
       CASE route WHEN 'manual' THEN manual_profile WHEN 'exact' THEN exact_name WHEN 'glob' THEN glob_name END AS profile_name,
       CASE WHEN route = 'ambiguous' THEN candidates END AS candidates
FROM (SELECT *, CASE WHEN manual_profile IS NOT NULL THEN CASE WHEN manual_profile IN (SELECT name FROM profile_table) THEN 'manual' ELSE 'manual_not_found' END
                     WHEN exact_name IS NOT NULL THEN 'exact' WHEN glob_name IS NOT NULL THEN 'glob'
                     WHEN candidates IS NOT NULL THEN 'ambiguous' ELSE 'no_match' END AS route
      FROM folded LEFT JOIN exact USING (source_id) LEFT JOIN best_globs USING (source_id))""",
    "folded",
    "exact",
    "best_globs",
    "profile_table",
)
C.add(
    "usable",
    """SELECT *, upper(replace(path_pattern, '/', chr(92))) AS pat, contains(path_pattern, '*') OR contains(path_pattern, '?') AS is_glob,
   min(pos) OVER (PARTITION BY name) AS name_first FROM big_profile_table WHERE name <> '' AND path_pattern <> ''""",
    "big_profile_table",
)
SQL["profile_conflicts"] = C.query(
    """
SELECT pos, 'duplicate_name' AS conflict, name_first AS first_pos FROM usable WHERE pos > name_first
UNION ALL
SELECT pos, CASE WHEN is_glob THEN 'duplicate_glob' ELSE 'duplicate_exact' END, first_pos
FROM (SELECT *, min(pos) OVER (PARTITION BY pat, is_glob, CASE WHEN is_glob THEN priority ELSE 0 END) AS first_pos FROM usable WHERE pos = name_first)
WHERE pos > first_pos""",
    "usable",
)
SQL["profile_value_checks"] = C.query(
    """
SELECT pos, 'empty_name' AS violation FROM big_profile_table WHERE name = ''
UNION ALL SELECT pos, 'empty_path_pattern' FROM big_profile_table WHERE path_pattern = ''
UNION ALL SELECT pos, 'empty_encoding' FROM big_profile_table WHERE encoding = ''
UNION ALL SELECT pos, 'bad_encoding_name' FROM big_profile_table WHERE encoding IN ('latin1', 'windows-0')
UNION ALL SELECT pos, 'unknown_codepage' FROM big_profile_table WHERE ansi_codepage = 99999
UNION ALL SELECT pos, 'unknown_datetime_format' FROM big_profile_table WHERE datetime_format IN ('LOG-DT-007', '', 'log-dt-001')""",
    "big_profile_table",
)
SQL["source_ordinal"] = C.query(
    """
SELECT source_id, path, row_number() OVER (ORDER BY batch, config_pos, lower(plain), plain, source_id) - 1 AS source_ordinal
FROM (SELECT source_id, path, -1 AS batch, config_pos, '' AS plain FROM configured_list
      UNION ALL SELECT source_id, path, batch, 0, replace(path, '/', chr(92)) FROM opened_list)""",
    "configured_list",
    "opened_list",
)
SQL["dedupe_sources"] = C.query(
    """
SELECT source_id, source_ordinal, file_id FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY source_ordinal) AS r FROM physical_files)
WHERE r = 1 AND file_id NOT IN (SELECT file_id FROM open_files)""",
    "physical_files",
    "open_files",
)
C.add(
    "sessions",
    """SELECT *, origin = 'configured' AND source_name IS NOT NULL AS is_named,
   CASE WHEN origin = 'configured' AND source_name IS NOT NULL THEN source_name ELSE CAST(target_id AS VARCHAR) END AS one FROM catalog_opened""",
    "catalog_opened",
)
C.add(
    "named_sessions",
    "SELECT source_name, max(target_id) AS target_id, arg_max(status, target_id) AS status, min(target_id) AS opened_at FROM sessions WHERE is_named GROUP BY source_name",
    "sessions",
)
SQL["source_catalog"] = C.query(
    """
SELECT 0 AS section, CAST(config_pos AS BIGINT) AS place, name AS display_name, 'configured' AS origin, target_id, coalesce(status, 'not_opened') AS status
FROM catalog_configured c LEFT JOIN named_sessions n ON c.name = n.source_name
UNION ALL
SELECT 1, opened_at + 1099511627776, source_name, 'configured', target_id, status FROM named_sessions WHERE source_name NOT IN (SELECT name FROM catalog_configured)
UNION ALL
SELECT 1, target_id, source_name, origin, target_id, status FROM sessions WHERE NOT is_named""",
    "sessions",
    "named_sessions",
    "catalog_configured",
)
SQL["close_source"] = C.query(
    "SELECT source_id, count(*) AS items FROM items WHERE source_id NOT IN (SELECT source_id FROM sources WHERE source_ordinal % 3 = 1) GROUP BY source_id",
    "items",
    "sources",
)

# --- encodings: what each kind of file must decode to

C.add(
    "enc_lines",
    r"""
SELECT source_id, source_id % 7 AS kind, row_number() OVER (PARTITION BY source_id ORDER BY doc_id, k) AS line_no,
       CASE WHEN source_id % 7 IN (1, 3, 6) THEN regexp_replace(line, '[^\x{01}-\x{7f}\x{c0}-\x{ff}]', '?', 'g')
            WHEN source_id % 7 IN (4, 5) THEN regexp_replace(line, '[^\x{01}-\x{7f}]', '?', 'g') ELSE line END AS text
FROM (SELECT CAST((doc_id >> 12) * 7 + doc_id % 7 AS INTEGER) AS source_id, doc_id, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)""",
)
C.add(
    "enc_sized",
    """
SELECT *, CASE WHEN kind IN (1, 3, 6) THEN length(text) ELSE strlen(text) END AS n,
       CASE WHEN line_no > 1 THEN 0 WHEN kind IN (2, 4) THEN 3 WHEN kind = 5 THEN 2 ELSE 0 END AS lead FROM enc_lines""",
    "enc_lines",
)
C.add(
    "enc_at",
    """SELECT *, CAST(sum(n + lead + 1) OVER (PARTITION BY source_id ORDER BY line_no) - n - lead - 1 AS BIGINT) AS off FROM enc_sized""",
    "enc_sized",
)
C.add(
    "enc_sources",
    r"""
SELECT source_id, kind, bool_or(regexp_matches(text, '[^\x{01}-\x{7f}]')) AS high
FROM enc_at GROUP BY source_id, kind""",
    "enc_at",
)
SQL["detect_encoding"] = C.query(
    """
SELECT source_id,
       CASE WHEN kind IN (1, 4) OR (kind = 3 AND high) THEN 'windows-1252' WHEN kind <> 5 THEN 'utf-8' END AS encoding,
       CASE WHEN kind IN (1, 4) OR (kind = 3 AND high) THEN 1252 END AS codepage,
       CASE kind WHEN 1 THEN 'ansi_codepage' WHEN 4 THEN 'named_encoding' WHEN 6 THEN 'named_encoding' WHEN 2 THEN 'utf8_bom' WHEN 5 THEN 'utf16_bom'
            WHEN 0 THEN 'utf8_valid' ELSE CASE WHEN high THEN 'default_codepage' ELSE 'utf8_valid' END END AS route,
       CASE WHEN kind = 2 THEN 3 ELSE 0 END AS bom_len, CASE WHEN kind = 4 THEN 'BOM_CONFLICT' END AS warning,
       CASE WHEN kind = 5 THEN 'UNSUPPORTED_UTF16' END AS error
FROM enc_sources""",
    "enc_sources",
)
SQL["bom_conflict"] = C.query(
    "SELECT source_id, 'windows-1252' AS encoding, 'named_encoding' AS route, 0 AS bom_len, 'BOM_CONFLICT' AS warning FROM enc_sources WHERE kind = 4",
    "enc_sources",
)
_BAD = r"[\x{c0}-\x{ff}]"
SQL["decode_lines"] = C.query(
    rf"""
SELECT source_id, line_no, CASE WHEN kind = 2 AND line_no = 1 THEN 3 ELSE off END AS raw_offset,
       CASE WHEN kind = 6 OR (kind = 3 AND NOT high) THEN regexp_replace(text, '{_BAD}', chr(65533), 'g')
            WHEN kind = 4 AND line_no = 1 THEN chr(239) || chr(187) || chr(191) || text ELSE text END AS text
FROM enc_at JOIN enc_sources USING (source_id, kind) WHERE kind <> 5""",
    "enc_at",
    "enc_sources",
)
C.add(
    "bad_bytes",
    rf"""
SELECT source_id, line_no, CAST(off + i - 1 AS BIGINT) AS position FROM (SELECT e.source_id, e.line_no, e.text, e.off, unnest(range(1, length(e.text) + 1)) AS i
  FROM enc_at e JOIN enc_sources s USING (source_id) WHERE e.kind = 6 OR (e.kind = 3 AND NOT s.high)) WHERE regexp_matches(substr(text, i, 1), '{_BAD}')""",
    "enc_at",
    "enc_sources",
)
SQL["invalid_byte_report"] = C.query(
    "SELECT source_id, line_no, position, count(*) OVER (PARTITION BY source_id) AS invalid_count FROM bad_bytes", "bad_bytes"
)
SQL["reject_unsupported"] = C.query(
    """SELECT source_id, CASE WHEN kind <> 5 THEN count(*) END AS line_count, CASE WHEN kind = 5 THEN 'UNSUPPORTED_UTF16' END AS error
FROM enc_at GROUP BY source_id, kind""",
    "enc_at",
)

# --- date-times

C.add("cases", _parsed("datetime_cases", "case_id, text"), "datetime_cases")
SQL["parse_datetime_fmt"] = C.query(
    "SELECT case_id, text, " + ", ".join(f"k{i} AS key_{f.id[-3:]}" for i, f in enumerate(FORMATS, 1)) + " FROM cases", "cases"
)
SQL["parse_datetime_auto"] = C.query(
    f"""
SELECT case_id, outcome, CASE WHEN outcome = 'Matched' THEN format END AS format, CASE WHEN outcome = 'Matched' THEN precision END AS precision,
       CASE WHEN outcome = 'Matched' THEN key_ms END AS key_ms, CASE WHEN outcome = 'Matched' THEN matched_len END AS matched_len, candidates
FROM (SELECT case_id, {_OUTCOME} AS outcome, {_by_hit(lambda f, i: f"'{f.id}'")} AS format, {_by_hit(lambda f, i: f"'{f.precision}'")} AS precision,
             {_by_hit(lambda f, i: f"k{i}")} AS key_ms, {_by_hit(lambda f, i: str(f.length))} AS matched_len,
             concat_ws(',', {", ".join(f"CASE WHEN k{i} IS NOT NULL THEN '{f.id}' END" for i, f in enumerate(FORMATS, 1))}) AS candidates
      FROM cases)""",
    "cases",
)
SQL["comparison_key"] = C.query("SELECT source_id, line_no, key_ms FROM keyed", "keyed")
SQL["precision_of"] = C.query(
    "SELECT source_id, line_no, CASE format "
    + " ".join(f"WHEN '{f.id}' THEN '{f.precision}'" for f in FORMATS)
    + " END AS precision FROM keyed WHERE key_ms IS NOT NULL",
    "keyed",
)
_SHOWN = """CASE WHEN key_ms IS NOT NULL THEN replace(substr({text}, 1, 10), '/', '-') || 'T' ||
 CASE format WHEN 'LOG-DT-006' THEN substr({text}, 12, 5) WHEN 'LOG-DT-005' THEN substr({text}, 12, 8)
      WHEN 'LOG-DT-001' THEN substr({text}, 12, 12) WHEN 'LOG-DT-002' THEN substr({text}, 12, 8) || '.' || substr({text}, 21, 3)
      ELSE substr({text}, 12, 8) || '.' || substr({text}, 21, 2) END END"""
SQL["display_timestamp"] = C.query(
    f"SELECT source_id, line_no, {_SHOWN.format(text='text')} AS timestamp_display FROM keyed", "keyed"
)
SQL["first_line"] = "SELECT doc_id, string_split(text, chr(10))[1] AS first_line FROM documents"
SQL["utf8_bytes"] = "SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes, CAST(max(strlen(text)) AS INTEGER) AS largest FROM documents GROUP BY source"
_CATALOG = ", ".join(f"('{f.id}', '{f.pattern}', {f.length}, '{f.precision}')" for f in FORMATS)
SQL["format_catalog"] = f"""
SELECT 'LOG-DT-00' || (p_partkey % 9) AS format, p_partkey, pattern, matched_len, precision
FROM part LEFT JOIN (VALUES {_CATALOG}) AS c(id, pattern, matched_len, precision) ON id = 'LOG-DT-00' || (p_partkey % 9)"""

# --- aggregations

C.add("inferred_docs", _infer("doc_lines"), "doc_lines")
SQL["infer_source_format"] = C.query(
    """SELECT * FROM inferred UNION ALL SELECT CAST(source_id + 100 AS INTEGER), outcome, format, decided_at, fell_back FROM inferred_docs""",
    "inferred",
    "inferred_docs",
)
C.add(
    "routes",
    """
SELECT source_id, CASE WHEN NOT profile_unresolved THEN coalesce(manual_format, profile_format, i.format) END AS format,
       CASE WHEN profile_unresolved THEN 'raw_display_fallback' WHEN manual_format IS NOT NULL THEN 'manual'
            WHEN profile_format IS NOT NULL THEN 'profile' ELSE 'auto' END AS route,
       profile_unresolved OR (manual_format IS NULL AND profile_format IS NULL AND i.fell_back) AS fell_back
FROM format_settings LEFT JOIN inferred i USING (source_id)""",
    "format_settings",
    "inferred",
)
SQL["format_route"] = C.query("SELECT * FROM routes", "routes")
C.add("routed_keyed", _keyed("log_lines", "routes"), "log_lines", "routes")
C.add("routed_lines", _assembled("routed_keyed"), "routed_keyed")
C.add("routed_items", _ITEMS.format(lines="routed_lines"), "routed_lines")
SQL["source_summary"] = C.query(
    """
SELECT source_id, format, route AS format_route, fell_back, content_bytes, line_count, item_count, dated_items, item_count - dated_items AS undated_items,
       line_count - item_count AS continuation_total, longest_continuation, FALSE AS unconfirmed_tail
FROM routes JOIN (SELECT source_id, max(raw_offset + raw_len) AS content_bytes, count(*) AS line_count FROM log_lines GROUP BY source_id) USING (source_id)
JOIN (SELECT source_id, count(*) AS item_count, count(key_ms) AS dated_items, max(continuation_count) AS longest_continuation FROM routed_items GROUP BY source_id) USING (source_id)""",
    "routes",
    "log_lines",
    "routed_items",
)
SQL["page_directory"] = C.query(
    "SELECT position // 512 AS page_no, position // 512 * 512 AS start, count(*) AS count, CAST(sum(body_bytes) AS BIGINT) AS bytes FROM timeline GROUP BY position // 512",
    "timeline",
)
SQL["latency_summary"] = """
SELECT variant, count(*) AS n, quantile_cont(ms, 0.5) AS median, max(ms) FILTER (WHERE r = k) AS p95, min(ms) AS min, max(ms) AS max
FROM (SELECT event_id % 4 AS variant, value AS ms, row_number() OVER (PARTITION BY event_id % 4 ORDER BY value) AS r,
             ceil(CAST(0.95 AS DOUBLE) * count(*) OVER (PARTITION BY event_id % 4)) AS k FROM events) GROUP BY variant"""
C.add("total", "SELECT count(*) AS total FROM items", "items")
C.add(
    "samples",
    """SELECT CAST(2 ** (r_regionkey + 5) AS INTEGER) AS max_items, CAST(s AS INTEGER) AS sample,
       CAST(greatest(total - 2 ** (r_regionkey + 5), 0) AS BIGINT) * s // 19 AS start, total FROM region, range(20) AS t(s), total""",
    "total",
)
SQL["transfer_volume"] = C.query(
    """
SELECT max_items, sample, start, count(position) AS items, CAST(coalesce(sum(body_bytes), 0) AS BIGINT) AS bytes, start + count(position) < max(total) AS truncated
FROM samples LEFT JOIN timeline ON position >= start AND position < start + max_items GROUP BY max_items, sample, start""",
    "samples",
    "timeline",
)

# --- assembly

SQL["assemble_items"] = C.query(
    "SELECT source_id, seq, key_ms, first_line, continuation_count, raw_offset, raw_len, confirmed, body_bytes, raw_text FROM items", "items"
)
SQL["stream_assemble"] = C.query(
    "SELECT source_id, seq, key_ms, first_line, continuation_count, raw_offset, raw_len, confirmed, body_bytes FROM items", "items"
)
SQL["raw_display_items"] = C.query(
    """SELECT source_id, line_no - 1 AS seq, CAST(NULL AS BIGINT) AS key_ms, line_no AS first_line, CAST(0 AS BIGINT) AS continuation_count, raw_offset, raw_len, confirmed,
       raw_len AS body_bytes FROM doc_lines""",
    "doc_lines",
)
SQL["item_seq"] = C.query("SELECT source_id, line_no, seq FROM item_lines", "item_lines")
SQL["carry_forward_key"] = C.query(
    f"""SELECT source_id, line_no - 1 AS seq, key_ms,
       coalesce(last_value(key_ms IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY line_no), {_LONG_MIN}) AS sort_key FROM keyed""",
    "keyed",
)
SQL["line_positions"] = C.query("SELECT source_id, line_no, raw_offset, CAST(raw_len AS INTEGER) AS raw_len FROM log_lines", "log_lines")

# --- timeline and paging

SQL["merged_timeline"] = C.query("SELECT position, source_id, seq, sort_key FROM timeline", "timeline")
SQL["single_source_view"] = C.query("SELECT seq AS position, source_id, seq, key_ms, first_line FROM items WHERE source_id = 2", "items")
SQL["fetch_range"] = C.query(
    """
SELECT position, source_id, seq, raw_len, total AS total_items, max(position) OVER () + 1 < total AS truncated
FROM (SELECT *, sum(raw_len) OVER (ORDER BY position) AS so_far FROM timeline, total WHERE position >= total // 2 AND position < total // 2 + 400)
WHERE so_far <= 15000 OR position = total // 2""",
    "timeline",
    "total",
)
SQL["jump_to_row"] = C.query(
    """
SELECT request_id, raw, row_index, CASE WHEN row_index IS NOT NULL THEN least(512, total - row_index) END AS page_count
FROM (SELECT *, CASE request_id % 11 WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 9 THEN NULL WHEN 10 THEN NULL WHEN 3 THEN 0 WHEN 6 THEN least(100, total) - 1
       WHEN 7 THEN least(31, total) - 1 WHEN 8 THEN total - 1 ELSE least(greatest(request_id, 1), total) - 1 END AS row_index FROM typed_rows, total)""",
    "typed_rows",
    "total",
)
SQL["hydrate"] = C.query(
    f"""
SELECT position, source_id, seq, first_line, CASE WHEN source_id = 4 THEN '' ELSE raw_text END AS raw_text, source_id = 4 AS unreadable, label AS source_label,
       CASE WHEN source_id <> 4 THEN {_SHOWN.format(text="raw_text")} END AS timestamp_display, key_ms IS NULL AS raw_display
FROM timeline JOIN sources USING (source_id) JOIN inferred USING (source_id)""",
    "timeline",
    "sources",
    "inferred",
)
SQL["generation_guard"] = C.query(
    """
SELECT o_orderkey AS request_id, CAST(o_custkey % 8 AS INTEGER) AS source_id, o_orderkey % 3 AS expected_generation,
       CASE WHEN s.source_id IS NOT NULL THEN CAST(1 AS BIGINT) END AS current_generation,
       CASE WHEN s.source_id IS NULL THEN 'unknown_source' WHEN o_orderkey % 3 = 1 THEN 'ok' ELSE 'generation_mismatch' END AS verdict
FROM orders LEFT JOIN sources s ON s.source_id = o_custkey % 8""",
    "sources",
)

# --- ranges, by listing rows

SQL["extract_ranges"] = C.query(f"SELECT position, source_id, seq FROM timeline WHERE {_IN_PARTS}", "timeline", "part_ranges")
SQL["row_selected"] = C.query(
    'SELECT "row", EXISTS (SELECT 1 FROM part_ranges r WHERE "row" >= r.start AND "row" < r.start + r.count) AS selected FROM (SELECT o_orderkey * 3 AS "row" FROM orders)',
    "part_ranges",
)


def _islands(rows: str) -> str:
    """Rows (selection_id, p), each once, to maximal ranges."""
    return f"""
SELECT selection_id, min(p) AS start, count(*) AS count FROM (SELECT *, p - row_number() OVER (PARTITION BY selection_id ORDER BY p) AS g FROM {rows}) GROUP BY selection_id, g"""


C.add("covered", "SELECT DISTINCT selection_id, unnest(range(start, start + count)) AS p FROM order_ranges", "order_ranges")
C.add("odd_rows", 'SELECT selection_id, "row" AS p FROM order_rows GROUP BY selection_id, "row" HAVING count(*) % 2 = 1', "order_rows")
C.add(
    "toggled",
    "(SELECT * FROM covered EXCEPT SELECT * FROM odd_rows) UNION ALL (SELECT * FROM odd_rows EXCEPT SELECT * FROM covered)",
    "covered",
    "odd_rows",
)
SQL["normalize_ranges"] = C.query(_islands("covered"), "covered")
SQL["subtract_row"] = C.query(
    _islands('(SELECT * FROM covered EXCEPT SELECT selection_id, "row" FROM order_rows)'), "covered", "order_rows"
)
SQL["toggle_rows"] = C.query(_islands("toggled"), "toggled")
SQL["clamp_ranges"] = C.query(_islands("(SELECT * FROM covered WHERE p < 60)"), "covered")
SQL["range_count"] = C.query(
    """SELECT selection_id, selected_rows, least(o_orderkey % 100, o_custkey % 100) AS start, abs(o_orderkey % 100 - o_custkey % 100) + 1 AS count
FROM (SELECT selection_id, count(*) AS selected_rows FROM covered GROUP BY selection_id) JOIN orders ON o_orderkey = selection_id""",
    "covered",
)
SQL["validate_ranges"] = C.query(
    """
SELECT selection_id, min_by(reason, pos) AS reason, min(pos) FILTER (WHERE reason IS NOT NULL) AS at_pos,
       CASE WHEN count(reason) = 0 THEN CAST(sum(count) AS BIGINT) END AS selected_lines
FROM (SELECT *, CASE WHEN count = 0 THEN 'EmptyRange' WHEN start < coalesce(lag(start + count) OVER (PARTITION BY selection_id ORDER BY pos), 0) THEN 'OverlappingOrUnordered'
                     WHEN start + count > 100 THEN 'OutOfBounds' END AS reason FROM order_ranges) GROUP BY selection_id""",
    "order_ranges",
)
SQL["extract_verdict"] = C.query(
    """
SELECT selection_id, CASE WHEN n > 40 THEN 'too_many_lines' WHEN over IS NOT NULL THEN 'too_many_bytes' ELSE 'accepted' END AS verdict, n AS selected_lines,
       CASE WHEN n <= 40 THEN CAST(coalesce(over, all_bytes) AS BIGINT) END AS selected_bytes
FROM (SELECT selection_id, count(*) AS n, min(so_far) FILTER (WHERE so_far > 1200) AS over, max(so_far) AS all_bytes
      FROM (SELECT selection_id, sum(body_bytes + 1) OVER (PARTITION BY selection_id ORDER BY p) - 1 AS so_far FROM covered JOIN timeline ON position = p)
      GROUP BY selection_id)""",
    "covered",
    "timeline",
)
SQL["union_sources"] = C.query(
    """SELECT source_id, seq, key_ms, first_line, body_bytes FROM items
UNION ALL SELECT CAST(source_id + 100 AS INTEGER), line_no - 1, NULL, line_no, raw_len FROM doc_lines""",
    "items",
    "doc_lines",
)
C.add(
    "sides",
    "SELECT source_id, seq, key_ms, regexp_extract(text, ' ([a-z]+) user=', 1) AS ident FROM item_lines WHERE key_ms IS NOT NULL",
    "item_lines",
)


def _correlate(tolerance: int, same: str, basis: str) -> str:
    return f"""
SELECT a.source_id, a.seq, a.key_ms, a.ident, count(*) FILTER (WHERE b.key_ms < a.key_ms - {tolerance}) AS match_start,
       count(*) FILTER (WHERE b.key_ms BETWEEN a.key_ms - {tolerance} AND a.key_ms + {tolerance}) AS match_count,
       CAST({tolerance} AS BIGINT) AS tolerance_ms, '{basis}' AS basis
FROM (SELECT * FROM sides WHERE source_id % 2 = 0) a LEFT JOIN (SELECT * FROM sides WHERE source_id % 2 = 1) b ON {same}
GROUP BY a.source_id, a.seq, a.key_ms, a.ident"""


SQL["time_correlate"] = C.query(_correlate(60_000, "TRUE", "time"), "sides")
SQL["time_correlate_identifier"] = C.query(_correlate(600_000, "a.ident = b.ident", "time_and_identifier"), "sides")

# --- changes

C.add(
    "verdicts",
    """
SELECT path, o.size AS old_size, n.size AS new_size,
       CASE WHEN n.size IS NULL THEN 'Deleted' WHEN o.size IS NULL THEN 'New' WHEN o.file_id <> n.file_id THEN 'Replaced'
            WHEN n.size < o.size THEN 'Shrunk' WHEN n.size > o.size THEN 'Appended' ELSE 'Unchanged' END AS verdict
FROM manifest_old o FULL JOIN manifest_new n USING (path)""",
    "manifest_old",
    "manifest_new",
)
SQL["compare_snapshots"] = C.query("SELECT * FROM verdicts", "verdicts")
SQL["refresh_status"] = C.query(
    """
SELECT source_id, CASE WHEN status <> 'Changed' AND source_id % 7 <> 6 AND verdict IN ('Shrunk', 'Replaced', 'Deleted') THEN generation + 1 ELSE generation END AS generation,
       CASE WHEN status = 'Changed' THEN 'Changed' WHEN source_id % 7 = 6 THEN 'Error' WHEN verdict IN ('Shrunk', 'Replaced', 'Deleted') THEN 'Changed' ELSE 'Loaded' END AS status,
       CASE WHEN status = 'Changed' THEN change_kind WHEN source_id % 7 <> 6 AND verdict IN ('Shrunk', 'Replaced', 'Deleted') THEN verdict END AS change_kind
FROM supplier_status JOIN verdicts ON path = '/logs/' || source_id || '.log'""",
    "supplier_status",
    "verdicts",
)
SQL["reload_sources"] = C.query(
    """SELECT source_id, seq, key_ms, first_line, continuation_count, CAST(CASE WHEN source_id IN (1, 5) THEN 2 ELSE 1 END AS BIGINT) AS generation
FROM items WHERE source_id IN (0, 1, 5)""",
    "items",
)
C.add("loaded_items", "SELECT * FROM items WHERE source_id % 4 <> 1", "items")
C.add("resynced", _MERGED.format(items="loaded_items"), "loaded_items", "sources")
SQL["resync_timeline"] = C.query("SELECT position, source_id, seq, 2 AS generation FROM resynced", "resynced")
C.add(
    "grown_lines",
    """SELECT source_id, line_no, text, CAST(strlen(text) AS INTEGER) AS raw_len, TRUE AS confirmed, count(*) OVER (PARTITION BY source_id) AS n,
       CAST(sum(strlen(text) + 1) OVER (PARTITION BY source_id ORDER BY line_no) - strlen(text) - 1 AS BIGINT) AS raw_offset FROM file_lines""",
    "file_lines",
)
C.add("grown_formats", _infer("grown_lines"), "grown_lines")
C.add("grown_keyed", _keyed("grown_lines", "grown_formats"), "grown_lines", "grown_formats")
C.add("grown_numbered", _assembled("grown_keyed"), "grown_keyed")
C.add("grown_items", _ITEMS.format(lines="grown_numbered"), "grown_numbered")
SQL["reload_reads_on"] = C.query(
    """SELECT i.source_id, CAST(CASE WHEN i.source_id % 3 = 1 AND n > 1 THEN 2 ELSE 1 END AS BIGINT) AS generation, seq, key_ms, first_line, continuation_count, raw_offset, raw_len,
       confirmed, body_bytes FROM grown_items i JOIN (SELECT source_id, count(*) AS n FROM grown_lines GROUP BY source_id) USING (source_id)""",
    "grown_items",
    "grown_lines",
)
SQL["resync_ranges"] = C.query(
    f"""SELECT row_number() OVER (ORDER BY coalesce(key_ms, {_LONG_MIN}), source_ordinal, seq) - 1 AS position, source_id, seq, key_ms
FROM items JOIN sources USING (source_id) WHERE source_id <> 4""",
    "items",
    "sources",
)
C.add("pairs", "SELECT source_id, generation FROM supplier_status WHERE status IN ('Loaded', 'CancelledPartial')", "supplier_status")
C.add(
    "recorded",
    "SELECT source_id, generation - CASE WHEN source_id % 5 = 0 THEN 1 ELSE 0 END AS generation FROM pairs WHERE source_id % 11 <> 3",
    "pairs",
)
SQL["timeline_staleness"] = C.query(
    """SELECT *, 'recorded_only' AS side FROM (SELECT * FROM recorded EXCEPT SELECT * FROM pairs)
UNION ALL SELECT *, 'current_only' FROM (SELECT * FROM pairs EXCEPT SELECT * FROM recorded)""",
    "pairs",
    "recorded",
)
SQL["list_sources"] = C.query(
    """SELECT source_id, s_name AS label, generation, status, change_kind, n.size AS size_bytes, FALSE AS has_unconfirmed_trailing_line,
  coalesce(n.size > o.size AND coalesce(n.file_id = o.file_id, TRUE), FALSE) AS update_pending
FROM supplier_status JOIN supplier ON s_suppkey = source_id LEFT JOIN manifest_new n ON n.path = '/logs/' || source_id || '.log'
LEFT JOIN manifest_old o ON o.path = n.path ORDER BY source_id""",
    "supplier_status",
    "manifest_new",
    "manifest_old",
)

# --- filters

SQL["filter_text"] = C.query("SELECT source_id, seq, raw_text FROM items WHERE contains(raw_text, 'at frame 3')", "items")
SQL["filter_text_signed"] = C.query(
    """SELECT source_id, seq, raw_text, 'at frame 3' AS needle FROM items WHERE contains(raw_text, 'at frame 3')
UNION ALL SELECT source_id, seq, raw_text, 'USER=77 ' FROM items WHERE contains(lower(raw_text), 'user=77 ')""",
    "items",
)
SQL["filter_regex"] = C.query(
    r"SELECT source_id, seq, raw_text FROM items WHERE regexp_matches(raw_text, 'user=[0-9]*7 v=[1-3][0-9]{2}\b')", "items"
)
SQL["filter_time_range"] = C.query(
    "SELECT source_id, seq, key_ms FROM items WHERE key_ms >= 1704412800000 AND key_ms < 1704672000000", "items"
)
SQL["filter_source"] = C.query("SELECT source_id, seq, key_ms FROM items WHERE source_id IN (1, 4)", "items")
SQL["filter_level"] = C.query(
    "SELECT source_id, seq, level FROM (SELECT *, regexp_extract(raw_text, '^[-0-9/:. ]+ ([a-z]+) user=', 1) AS level FROM items) WHERE level IN ('error', 'signup')",
    "items",
)
