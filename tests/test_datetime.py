import pytest
from pyspark.sql import functions as F

from timberline.functions import datetime as dt

CASES = [
    ("2031/05/17 08:47:36.729", "Matched", "LOG-DT-001", "2031-05-17T08:47:36.729"),
    ("2031-05-17 08:47:36:729", "Matched", "LOG-DT-002", "2031-05-17T08:47:36.729"),
    ("2031/05/17 08:47:36.72", "Matched", "LOG-DT-003", "2031-05-17T08:47:36.72"),
    ("2031/05/17 08:47:36:72", "Ambiguous", None, None),
    ("2031/05/17 08:47:36:72x", "Ambiguous", None, None),
    ("2031/05/17 08:47:36", "Matched", "LOG-DT-005", "2031-05-17T08:47:36"),
    ("2031/05/17 08:47", "Matched", "LOG-DT-006", "2031-05-17T08:47"),
    ("2031/05/17 08:47:36.7294", "NoMatch", None, None),
    ("2031/05/17 08:47:36:7", "NoMatch", None, None),
    ("2031/05/17 08:47:36:729", "NoMatch", None, None),
    ("2031/05/17 08:47:36:7294", "NoMatch", None, None),
    ("2031/05/17 08:47:36.7", "NoMatch", None, None),
    ("2031/05/17 08:47:364", "NoMatch", None, None),
    ("2031/05/17 08:47:36: text", "Matched", "LOG-DT-005", "2031-05-17T08:47:36"),
    ("2031/05/17 08:47:36:", "Matched", "LOG-DT-005", "2031-05-17T08:47:36"),
    ("2031/05/17 08:47:36 \t text", "Matched", "LOG-DT-005", "2031-05-17T08:47:36"),
    ("2031/02/29 00:00", "NoMatch", None, None),
    ("2031/13/01 00:00", "NoMatch", None, None),
    ("2031/00/01 00:00", "NoMatch", None, None),
    ("2031/04/31 00:00", "NoMatch", None, None),
    ("2031/04/00 00:00", "NoMatch", None, None),
    ("2028/02/29 00:00", "Matched", "LOG-DT-006", "2028-02-29T00:00"),
    ("2100/02/29 00:00", "NoMatch", None, None),
    ("2000/02/29 00:00", "Matched", "LOG-DT-006", "2000-02-29T00:00"),
    ("0000/01/01 00:00", "Matched", "LOG-DT-006", "0000-01-01T00:00"),
    ("0000/02/29 00:00", "Matched", "LOG-DT-006", "0000-02-29T00:00"),
    ("9999/12/31 23:59:59.999", "Matched", "LOG-DT-001", "9999-12-31T23:59:59.999"),
    ("2031/05/17 24:00", "NoMatch", None, None),
    ("2031/05/17 23:60", "NoMatch", None, None),
    ("2031/05/17 23:59:60", "NoMatch", None, None),
    (" 2031/05/17 08:47", "NoMatch", None, None),
    ("", "NoMatch", None, None),
    ("2031/05/17\t08:47", "NoMatch", None, None),
    ("２０３１/05/17 08:47", "NoMatch", None, None),
    ("2031/05/17 08:47:", "NoMatch", None, None),
    ("2031-05-17 08:47", "NoMatch", None, None),
    ("2031/05/17 08:47:36.72é", "Matched", "LOG-DT-003", "2031-05-17T08:47:36.72"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i INT, text STRING")
    rows = dt.parse_auto(df).withColumn("shown", dt.display_timestamp("text", "format")).collect()
    return {r["i"]: r for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_auto(parsed, i):
    _, outcome, fmt, shown = CASES[i]
    assert (parsed[i]["outcome"], parsed[i]["format"], parsed[i]["shown"]) == (outcome, fmt, shown)


def test_ambiguous_candidates(parsed):
    assert [c["format"] for c in parsed[3]["candidates"]] == ["LOG-DT-004", "LOG-DT-005"]
    assert [c["matched_len"] for c in parsed[3]["candidates"]] == [22, 19]


def test_keys(spark):
    rows = [("2031/05/17 08:47:36.72", "LOG-DT-003"), ("2031/05/17 08:47:36:72", "LOG-DT-004"), ("1970/01/01 00:00", "LOG-DT-006"),
            ("1969/12/31 23:59:59", "LOG-DT-005"), ("2031/05/17 08:47:36:72", None), ("2031/05/17 08:47:36:72", "LOG-DT-001")]
    df = spark.createDataFrame(rows, "text STRING, format STRING").coalesce(1)
    keys = [r[0] for r in df.select(dt.key_for("text", "format")).collect()]
    assert keys == [1936774056720, 1936774056720, 0, -1000, None, None]


def test_key_does_not_depend_on_time_zone(spark):
    df = spark.createDataFrame([("2024/03/31 02:30:00.000",)], "text STRING").select(dt.key_with("text", dt.BY_ID["LOG-DT-001"]))
    before = df.first()[0]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert df.select("*").first()[0] == before == 1711852200000
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_catalog(spark):
    rows = dt.format_catalog(spark).orderBy("format").collect()
    assert [r["format"] for r in rows] == [f"LOG-DT-00{i}" for i in range(1, 7)]
    assert [r["matched_len"] for r in rows] == [23, 23, 22, 22, 19, 16]
    precisions = spark.createDataFrame([(r["format"],) for r in rows], "format STRING").select(dt.precision_of("format")).collect()
    assert {p[0] for p in precisions} == {"millisecond", "centisecond", "second", "minute"}
