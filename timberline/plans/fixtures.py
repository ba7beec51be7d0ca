"""Inputs of the queries as plain SELECTs over the given tables, run by Spark and by the SQL counterparts alike.

``{name}`` stands for a given table. Backslashes are written ``chr(92)``, as the engines read literals differently.
"""

PATH_CASES = """
SELECT CAST(c_custkey AS INT) AS source_id,
       CASE WHEN c_custkey % 3 = 0 THEN concat('C:/Logs/N', c_nationkey, '/s', c_custkey % 10, '/App', c_custkey, '.log')
            WHEN c_custkey % 3 = 1 THEN replace(concat('c:/logs/n', c_nationkey, '/extra/S', c_custkey % 10, '/app', c_custkey, '.LOG'), '/', chr(92))
            ELSE concat('D:/data/App', c_custkey, '.log') END AS path,
       CASE WHEN c_custkey % 17 = 0 THEN 'P1' WHEN c_custkey % 17 = 1 THEN 'nope' WHEN c_custkey % 17 = 2 THEN 'p1' END AS manual_profile
FROM {customer}
"""

PROFILE_TABLE = """
SELECT CAST(n_nationkey * 5 + v AS INT) AS pos,
       concat('P', n_nationkey * 5 + v) AS name,
       CASE WHEN v = 0 OR (v = 1 AND n_nationkey % 5 = 0) THEN replace(concat('d:/DATA/app', n_nationkey * 60 + 2, '.LOG'), '/', chr(92))
            WHEN v = 1 THEN concat('C:/Logs/N', n_nationkey, '/**')
            WHEN v = 2 THEN concat('C:/Logs/**/App?', n_nationkey % 10, '.log')
            WHEN v = 3 THEN concat('c:/logs/n*/s', n_nationkey % 10, '/app*.LOG')
            ELSE concat('**/App', n_nationkey, '*.log') END AS path_pattern,
       CAST(CASE WHEN v = 1 THEN n_nationkey % 3 WHEN v = 2 THEN 1 WHEN v = 3 THEN n_nationkey % 4 - 1 ELSE 0 END AS BIGINT) AS priority,
       'auto' AS encoding, CAST(NULL AS INT) AS ansi_codepage, 'auto' AS datetime_format
FROM {nation}, (VALUES (0), (1), (2), (3), (4)) AS variants(v)
"""

BIG_PROFILE_TABLE = """
SELECT CAST(s_suppkey AS INT) AS pos,
       CASE WHEN s_suppkey % 29 = 7 THEN '' WHEN s_suppkey % 13 = 0 THEN concat('DUP', s_suppkey % 3) ELSE concat('S', s_suppkey) END AS name,
       CASE WHEN s_suppkey % 31 = 5 THEN ''
            WHEN s_suppkey % 4 = 0 THEN concat('C:/Logs/X', s_suppkey % 9, '.log')
            WHEN s_suppkey % 4 = 1 THEN replace(concat('c:/LOGS/x', s_suppkey % 9, '.LOG'), '/', chr(92))
            WHEN s_suppkey % 4 = 2 THEN concat('C:/Logs/*', s_suppkey % 5, '.log')
            ELSE concat('C:/Logs/u', s_suppkey, '*.log') END AS path_pattern,
       CAST(s_suppkey % 3 AS BIGINT) AS priority,
       CASE s_suppkey % 7 WHEN 0 THEN 'auto' WHEN 1 THEN 'utf-8' WHEN 2 THEN ' UTF-8 ' WHEN 3 THEN 'Windows-932'
            WHEN 4 THEN 'latin1' WHEN 5 THEN 'windows-0' ELSE '' END AS encoding,
       CAST(CASE WHEN s_suppkey % 10 = 3 THEN 99999 WHEN s_suppkey % 10 = 4 THEN 1252 END AS INT) AS ansi_codepage,
       CASE s_suppkey % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'LOG-DT-003' WHEN 2 THEN 'LOG-DT-007' WHEN 3 THEN '' ELSE 'log-dt-001' END AS datetime_format
FROM {supplier}
"""

CONFIGURED_LIST = """
SELECT CAST(s_suppkey AS BIGINT) AS source_id, concat('C:/cfg/source', s_suppkey, '.log') AS path,
       CAST(1000000000 - s_suppkey AS BIGINT) AS config_pos
FROM {supplier}
"""

OPENED_LIST = """
SELECT CAST(1000000000 + c_custkey AS BIGINT) AS source_id,
       CASE WHEN c_custkey % 2 = 0 THEN concat('D:/Drop/a', c_custkey % 37, '.log')
            ELSE replace(concat('d:/drop/A', c_custkey % 37, '.LOG'), '/', chr(92)) END AS path,
       CAST(c_custkey % 4 AS INT) AS batch
FROM {customer}
"""

PHYSICAL_FILES = """
SELECT CAST(c_custkey AS BIGINT) AS source_id, CAST(c_custkey AS BIGINT) AS source_ordinal,
       CASE WHEN c_custkey % 3 = 0 THEN 'vol-hot' ELSE concat('vol-', c_custkey % 700) END AS file_id
FROM {customer}
"""

OPEN_FILES = "SELECT concat('vol-', n_nationkey) AS file_id FROM {nation}"

CATALOG_CONFIGURED = "SELECT CAST(s_suppkey AS INT) AS config_pos, concat('src', s_suppkey) AS name FROM {supplier}"

CATALOG_OPENED = """
SELECT CAST(c_custkey AS BIGINT) AS target_id,
       CASE WHEN c_custkey % 3 = 0 THEN concat('src', c_custkey % 150) WHEN c_custkey % 3 = 1 THEN concat('adhoc', c_custkey)
            WHEN c_custkey % 9 = 2 THEN concat('gone', c_custkey % 20) END AS source_name,
       CASE WHEN c_custkey % 3 = 1 THEN 'adhoc' ELSE 'configured' END AS origin,
       CASE WHEN c_custkey % 5 = 0 THEN 'error' ELSE 'ready' END AS status
FROM {customer}
"""

_DATE = """concat(CASE WHEN o_orderkey % 40 = 39 THEN '0000' ELSE substr(CAST(o_orderdate AS STRING), 1, 4) END, '{s}',
 lpad(CAST(o_orderkey % 14 AS STRING), 2, '0'), '{s}', lpad(CAST(o_custkey % 33 AS STRING), 2, '0'))"""
_HM = "concat(lpad(CAST(o_orderkey % 26 AS STRING), 2, '0'), ':', lpad(CAST(o_custkey % 62 AS STRING), 2, '0'))"
_HMS = f"concat({_HM}, ':', lpad(CAST(o_orderkey * 7 % 61 AS STRING), 2, '0'))"


def _digits(n: int) -> str:
    return f"lpad(CAST(o_orderkey * 13 % {10**n} AS STRING), {n}, '0')"


def _template(lead: str, sep: str, clock: str, *rest: str) -> str:
    return f"concat('{lead}', {_DATE.replace('{s}', sep)}, ' ', {', '.join([clock, *rest])})"


_TEMPLATES = [
    _template("", "/", _HMS, "'.'", _digits(3)),
    _template("", "-", _HMS, "':'", _digits(3)),
    _template("", "/", _HMS, "'.'", _digits(2)),
    _template("", "/", _HMS, "':'", _digits(2)),
    _template("", "/", _HMS),
    _template("", "/", _HM),
    _template("", "/", _HMS, "'.'", _digits(4)),
    _template("", "/", _HMS, "':'", _digits(1)),
    _template("", "/", _HMS, "':'", _digits(3)),
    _template("", "/", _HMS, "'.'", _digits(1)),
    _template("", "/", _HMS, "': text'"),
    _template(" ", "/", _HM),
    "''",
    _template("", "/", _HMS, "'x'"),
    _template("", "/", _HM, "'.'"),
    _template("", "/", _HMS, "':'", _digits(2), "'x'"),
    _template("", "-", _HMS, "'.'", _digits(3)),
    _template("", "/", _HM, "' text'"),
    _template("", "/", _HMS, "','", _digits(3)),
    _template("", "-", _HM),
    _template("", "/", _HMS, "':'", _digits(1), "'x'"),
    _template("", "-", _HMS, "':'", _digits(4)),
]
DATETIME_CASES = (
    "SELECT CAST(o_orderkey AS BIGINT) AS case_id, CASE (o_orderkey + o_custkey) % "
    + str(len(_TEMPLATES))
    + " "
    + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_TEMPLATES))
    + " END AS text FROM {orders}"
)

FORMAT_SETTINGS = """
SELECT DISTINCT CAST(user_id % 6 AS INT) AS source_id,
       CASE WHEN user_id % 6 = 3 THEN 'LOG-DT-004' END AS manual_format,
       CASE WHEN user_id % 6 = 1 THEN 'LOG-DT-002' WHEN user_id % 6 = 3 THEN 'LOG-DT-005' WHEN user_id % 6 = 5 THEN 'LOG-DT-006' END AS profile_format,
       user_id % 6 = 5 AS profile_unresolved
FROM {events}
"""

TYPED_ROWS = """
SELECT CAST(o_orderkey AS BIGINT) AS request_id,
       CASE o_orderkey % 11 WHEN 0 THEN CAST(o_orderkey AS STRING) WHEN 1 THEN concat(o_orderkey, '.7')
            WHEN 2 THEN concat('  ', o_orderkey, ' ') WHEN 3 THEN '-5' WHEN 4 THEN 'abc' WHEN 5 THEN '' WHEN 6 THEN '1e2'
            WHEN 7 THEN '0x1F' WHEN 8 THEN '999999999999' WHEN 9 THEN 'Infinity' ELSE '12d' END AS raw
FROM {orders}
"""

ORDER_RANGES = """
SELECT CAST(l_orderkey AS BIGINT) AS selection_id, CAST(l_linenumber AS BIGINT) AS pos,
       CAST(max((l_partkey * 7 + l_suppkey) % 90) AS BIGINT) AS start,
       CAST(max(CAST(l_quantity AS BIGINT) % 15) AS BIGINT) AS count
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""

ORDER_ROWS = """
SELECT CAST(o_orderkey AS BIGINT) AS selection_id, CAST(o_custkey % 90 AS BIGINT) AS row FROM {orders}
UNION ALL
SELECT CAST(o_orderkey AS BIGINT) AS selection_id, CAST(o_orderkey * 3 % 90 AS BIGINT) AS row FROM {orders}
"""

PART_RANGES = """
SELECT CAST(p_partkey * 13 AS BIGINT) AS start, CAST(p_partkey % 17 AS BIGINT) AS count FROM {part}
"""

MANIFEST_OLD = """
SELECT concat('/logs/', s_suppkey, '.log') AS path, concat('id', s_suppkey) AS file_id, CAST(s_suppkey * 100 + 50 AS BIGINT) AS size
FROM {supplier} WHERE s_suppkey % 10 <> 9
"""

MANIFEST_NEW = """
SELECT concat('/logs/', s_suppkey, '.log') AS path,
       CASE WHEN s_suppkey % 5 = 3 THEN concat('new', s_suppkey) ELSE concat('id', s_suppkey) END AS file_id,
       CAST(s_suppkey * 100 + 50 + CASE s_suppkey % 5 WHEN 1 THEN 7 WHEN 2 THEN -7 ELSE 0 END AS BIGINT) AS size
FROM {supplier} WHERE s_suppkey % 5 <> 0 OR s_suppkey % 10 = 9
"""

SUPPLIER_STATUS = """
SELECT CAST(s_suppkey AS INT) AS source_id, CAST(s_suppkey % 3 + 1 AS BIGINT) AS generation,
       CASE s_suppkey % 6 WHEN 0 THEN 'Changed' WHEN 1 THEN 'CancelledPartial' WHEN 2 THEN 'Error' ELSE 'Loaded' END AS status,
       CASE WHEN s_suppkey % 6 = 0 THEN 'Shrunk' END AS change_kind
FROM {supplier}
"""
