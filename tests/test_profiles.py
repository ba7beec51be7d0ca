import pytest
from pyspark.sql import functions as F

from timberline.functions.encoding import named_codepage, valid_utf8_head
from timberline.functions.paths import is_pattern, pattern_regex, pattern_subject
from timberline.operators import profiles

PROFILES = "pos INT, name STRING, path_pattern STRING, priority BIGINT, encoding STRING, ansi_codepage INT, datetime_format STRING"


def table(spark, *rows):
    return spark.createDataFrame([(i, n, p, pr, "auto", None, "auto") for i, (n, p, pr) in enumerate(rows)], PROFILES)


def resolve(spark, prof, path, manual=None):
    sources = spark.createDataFrame([(1, path, manual)], "source_id INT, path STRING, manual_profile STRING")
    r = profiles.resolve_profile(sources, prof).first()
    return r["route"], r["profile_name"], r["candidates"]


@pytest.fixture(scope="module")
def prof(spark):
    return table(
        spark,
        ("exact", "C:\\Logs\\app.log", -9),
        ("any", "C:\\Logs\\**", 0),
        ("star", "C:\\Logs\\*.log", 1),
        ("q", "C:\\Logs\\day?.txt", 5),
        ("deep", "C:\\Logs\\**\\err\\*.txt", 5),
        ("twin1", "D:\\**\\a*.log", 2),
        ("twin2", "D:\\x\\*.log", 2),
        ("dots", "E:\\a.b[1]\\(x)+*.log", 0),
        ("exact2", "c:/logs/APP.LOG", 9),
        ("head", "**\\readme.md", -1),
    )


@pytest.mark.parametrize(
    "path,manual,route,name",
    [
        ("c:/LOGS/App.LOG", None, "exact", "exact"),
        ("C:\\Logs\\other.log", None, "glob", "star"),
        ("C:\\Logs\\sub\\other.log", None, "glob", "any"),
        ("C:\\Logs", None, "glob", "any"),
        ("C:\\Logs2\\x", None, "no_match", None),
        ("C:\\Logs\\day1.txt", None, "glob", "q"),
        ("C:\\Logs\\day12.txt", None, "glob", "any"),
        ("C:\\Logs\\err\\x.txt", None, "glob", "deep"),
        ("C:\\Logs\\a\\b\\err\\x.txt", None, "glob", "deep"),
        ("C:\\Logs\\a\\err\\b\\x.txt", None, "glob", "any"),
        ("D:\\x\\ab.log", None, "ambiguous", None),
        ("D:\\y\\ab.log", None, "glob", "twin1"),
        ("E:\\A.B[1]\\(X)+1.LOG", None, "glob", "dots"),
        ("E:\\aXb[1]\\(x)+1.log", None, "no_match", None),
        ("Z:\\any\\where\\README.md", None, "glob", "head"),
        ("README.md", None, "glob", "head"),
        ("C:\\Logs\\app.log", "twin1", "manual", "twin1"),
        ("C:\\Logs\\app.log", "Twin1", "manual_not_found", None),
        ("C:\\Logs\\app.log", "", "manual_not_found", None),
    ],
)
def test_resolution(spark, prof, path, manual, route, name):
    got = resolve(spark, prof, path, manual)
    assert got[:2] == (route, name)
    assert got[2] == (["twin1", "twin2"] if route == "ambiguous" else None)


def test_bad_table_is_refused(spark):
    with pytest.raises(ValueError, match="duplicate_name"):
        profiles.require_valid(table(spark, ("a", "C:\\x", 0), ("a", "C:\\y", 0)))
    good = table(spark, ("a", "C:\\x*", 0), ("b", "C:\\X*", 1), ("c", "C:\\x", 0))
    assert profiles.require_valid(good) is good


def test_conflicts(spark):
    rows = [("a", "C:\\x", 0), ("b", "c:/X", 5), ("c", "C:\\x*", 1), ("d", "C:\\X*", 1), ("e", "C:\\x*", 2), ("a", "C:\\x", 0)]
    got = {(r["pos"], r["conflict"], r["first_pos"]) for r in profiles.profile_conflicts(table(spark, *rows)).collect()}
    assert got == {(1, "duplicate_exact", 0), (3, "duplicate_glob", 2), (5, "duplicate_name", 0)}


def test_named_codepage(spark):
    names = ["windows-932", " Windows-1252 ", "windows-0", "windows-", "windows-4294967296", "windows--1", "utf-8", "windows-1x", ""]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i INT, n STRING").orderBy("i")
    assert [r[0] for r in df.select(named_codepage(F.col("n"))).collect()] == [932, 1252] + [None] * 7


def test_valid_utf8_head_against_python(spark):
    samples = [b"", b"a", b"\xc3", b"\xe3\x81", b"\xf0\x9f\x98", b"\xc0", b"\xc1\x80", b"\xe0\x80", b"\xe0\xa0", b"\xed\xa0", b"\xed\x9f", b"\xf0\x80",
               b"\xf4\x90", b"\xf4\x8f\xbf", b"\xf5", b"\x80", b"a\xff", b"\xc3\xa9", b"\xff\xc3", b"x\xe3", b"\xf1\x80\x80", b"\xe3\x81\xe3"]

    def want(data):
        try:
            data.decode()
            return True
        except UnicodeDecodeError as e:
            return e.reason == "unexpected end of data"

    df = spark.createDataFrame([(i, bytearray(s)) for i, s in enumerate(samples)], "i INT, b BINARY").orderBy("i")
    assert [r[0] for r in df.select(valid_utf8_head(F.col("b"))).collect()] == [want(s) for s in samples]


def test_ordinals_and_duplicates(spark):
    configured = spark.createDataFrame([(1, "z", 1), (2, "a", 0)], "source_id BIGINT, path STRING, config_pos INT")
    opened = spark.createDataFrame([(3, "C:/b.log", 0), (4, "C:\\B.log", 0), (5, "C:\\a.log", 1), (6, "C:\\A.log", 0)], "source_id BIGINT, path STRING, batch INT")
    got = [r["source_id"] for r in profiles.source_ordinal(configured, opened).orderBy("source_ordinal").collect()]
    assert got == [2, 1, 6, 4, 3, 5]
    files = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x"), (3, "z")], "source_ordinal INT, file_id STRING")
    kept = profiles.dedupe_sources(files, spark.createDataFrame([("z",)], "file_id STRING"))
    assert sorted(r["source_ordinal"] for r in kept.collect()) == [0, 1]


def test_catalog_order(spark):
    configured = spark.createDataFrame([(0, "one"), (1, "two")], "config_pos INT, name STRING")
    opened = spark.createDataFrame(
        [(1, "gone", "configured", "ready"), (2, None, "adhoc", "ready"), (3, "two", "configured", "error"), (4, "x", "adhoc", "ready")],
        "target_id BIGINT, source_name STRING, origin STRING, status STRING",
    )
    rows = profiles.source_catalog(configured, opened).orderBy("section", "place").collect()
    assert [(r["display_name"], r["status"]) for r in rows] == [("one", "not_opened"), ("two", "error"), (None, "ready"), ("x", "ready"), ("gone", "ready")]


def test_globs_are_sifted_before_their_regex(spark):
    patterns = ["**", "**\\**", "*", "?", "a?", "**\\b*", "a\\**", "a\\**\\b", "a**b", "\\*", "*\\", "**\\a\\**\\b?\\*c", "a*a", "**\\ab*b\\**", "A\\*\\C", "*.*"]
    paths = ["", "a", "b", "ab", "a\\b", "a\\x\\b", "aa", "a\\", "\\a", "x\\a\\bb\\c", "a\\y\\bz\\xc", "aba", "x\\abb\\y", "a/b/c", "ab\\b", "a.b", "bb"]
    prof = table(spark, *[(p, p, 0) for p in patterns])
    sources = spark.createDataFrame(list(enumerate(paths)), "source_id INT, path STRING")
    found = profiles.glob_matches(sources, prof)
    each = sources.crossJoin(prof).filter(is_pattern("path_pattern")).select("source_id", "pos", pattern_subject("path").alias("s"), pattern_regex("path_pattern").alias("r"))
    assert {tuple(r) for r in found.select("source_id", "pos").collect()} == {tuple(r) for r in each.filter(F.expr("s RLIKE r")).select("source_id", "pos").collect()}
    # Paths are dealt out, and cheap tests come before the regex, which is compiled for each row.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [source_id" in plan
    assert 0 < plan.index("EndsWith(") < plan.index("RLIKE")
