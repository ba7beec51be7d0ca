import random

import pytest
from pyspark.sql import functions as F

from timberline.operators import search, summary, timeline
from timberline.operators.prefix import global_positions, running
from timberline.session import stored

LOW = -(2**63)


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(4)
    rows = []
    for source in range(5):
        undated = 3 if source == 1 else (400 if source == 2 else 0)
        for seq in range(400):
            key = None if seq < undated else rng.choice([1000, 1000, rng.randrange(5000)])
            rows.append((source, seq, key, 10 + seq % 7))
    df = spark.createDataFrame(rows, "source_id INT, seq BIGINT, key_ms BIGINT, raw_len BIGINT")
    ordinals = spark.createDataFrame([(s, (s * 3 + 1) % 5) for s in range(5)], "source_id INT, source_ordinal INT")
    return rows, df, ordinals


def merged(rows):
    order = [(LOW if k is None else k, (s * 3 + 1) % 5, q, s) for s, q, k, _ in rows]
    return [(s, q) for _, _, q, s in sorted(order)]


@pytest.mark.parametrize("scatter,parts", [(False, "4"), (True, "3"), (True, "1")])
def test_merge_is_deterministic(spark, items, scatter, parts):
    rows, df, ordinals = items
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        source = df.repartition(5, F.rand(1)) if scatter else df
        for assembled in (True, False):
            view = timeline.merged_timeline(source, ordinals, assembled).orderBy("position").collect()
            assert [r["position"] for r in view] == list(range(len(rows)))
            assert [(r["source_id"], r["seq"]) for r in view] == merged(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_undated_in_the_middle_follow_their_item(spark):
    df = spark.createDataFrame([(0, 0, 10), (0, 1, None), (1, 0, 5), (1, 1, 11), (1, 2, None)], "source_id INT, seq BIGINT, key_ms BIGINT")
    ordinals = spark.createDataFrame([(0, 0), (1, 1)], "source_id INT, source_ordinal INT")
    view = timeline.merged_timeline(df, ordinals, assembled=False).orderBy("position").collect()
    assert [(r["source_id"], r["seq"]) for r in view] == [(1, 0), (0, 0), (0, 1), (1, 1), (1, 2)]


@pytest.fixture(scope="module")
def view(spark):
    rows = [(i, 100) for i in range(1000)] + [(1000, 5000)] + [(i, 100) for i in range(1001, 1100)]
    return spark.createDataFrame(rows, "position BIGINT, raw_len BIGINT")


@pytest.mark.parametrize(
    "start,items_,bytes_,first,n,truncated",
    [
        (0, 10, 10_000, 0, 10, True),
        (0, 9999, 10**9, 0, 1100, False),
        (1090, 50, 10_000, 1090, 10, False),
        (5000, 10, 10_000, None, 0, None),
        (0, 100, 1000, 0, 10, True),
        (0, 100, 999, 0, 9, True),
        (1000, 10, 50, 1000, 1, True),
        (999, 10, 5099, 999, 1, True),
        (999, 10, 5100, 999, 2, True),
        (1099, 10, 1, 1099, 1, False),
    ],
)
def test_page_limits(view, start, items_, bytes_, first, n, truncated):
    rows = timeline.fetch_range(view, start, items_, bytes_).orderBy("position").collect()
    assert len(rows) == n
    if n:
        assert rows[0]["position"] == first and rows[0]["total_items"] == 1100
        assert {r["truncated"] for r in rows} == {truncated}


def test_page_reads_only_its_row_groups(spark, view, tmp_path):
    view.write.parquet(str(tmp_path / "view"))
    page = timeline.fetch_range(spark.read.parquet(str(tmp_path / "view")), 500, 10)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(position,500)" in plan and "LessThan(position,510)" in plan


@pytest.mark.parametrize(
    "raw,row",
    [("1", 0), ("0", 0), ("-3", 0), ("100", 99), ("101", 99), ("7.9", 6), (" 7 ", 6), ("\u00a07\u3000", 6), ("1e1", 9), ("+5", 4), (".5", 0), ("0x10", 15),
     ("0b11", 2), ("0o17", 14), ("", None), ("  ", None), ("abc", None), ("Infinity", None), ("NaN", None), ("1e999", None), ("5d", None), ("1,000", None), (None, None), ("0x" + "F" * 40, 99), ("0x" + "0" * 120 + "10", 15)],
)
def test_jump(spark, raw, row):
    df = spark.createDataFrame([(raw,)], "raw STRING")
    got = timeline.jump_to_row(df, 100).first()
    assert got["row_index"] == row
    assert got["page_count"] == (None if row is None else min(512, 100 - row))
    assert timeline.jump_to_row(df, 0).first()["row_index"] is None


def test_generations(spark):
    timeline.check_generation(3, 3)
    with pytest.raises(timeline.GenerationMismatch) as error:
        timeline.check_generation(2, 3)
    assert (error.value.expected, error.value.current) == (2, 3)


def test_running_matches_a_loop(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randrange(-5, 9)) for k in range(3) for i in range(-40, 200)]
    df = spark.createDataFrame(rows, "k INT, i BIGINT, v BIGINT").repartition(6, F.rand(5))
    totals = {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v"))}
    for width, current in ((16, True), (1 << 16, False)):
        got = {(r["k"], r["i"]): (r["s"], r["hi"], r["lo"]) for r in running(df, ["k"], ["i"], totals, width, current).collect()}
        for key in range(3):
            seen = []
            for k, i, v in sorted(r for r in rows if r[0] == key):
                before = seen + [v] if current else list(seen)
                assert got[k, i] == (sum(before), max(before, default=None), min(before, default=None))
                seen.append(v)


def test_positions_with_one_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), "id")
    got = [r["id"] for r in global_positions(df, ["k", "id"], 7).orderBy("position").collect()]
    assert got == [i for _, i in sorted((i if i % 3 == 0 else -1, i) for i in range(5000))]


@pytest.mark.parametrize("identifier", [None, "ident"])
def test_correlation_against_pairs(spark, identifier):
    rng = random.Random(8)
    make = lambda s, n: [(s, i, rng.choice([None, 7, rng.randrange(10_000_000)]), rng.choice(["a", "b", None])) for i in range(n)]
    left, right = make(0, 150), make(1, 170)
    schema = "source_id INT, seq BIGINT, key_ms BIGINT, ident STRING"
    got = search.time_correlate(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 40_000, identifier).collect()
    assert len(got) == sum(1 for r in left if r[2] is not None)
    right_df = spark.createDataFrame(right, schema)
    chosen = search.time_correlate(spark.createDataFrame(left, schema), right_df, 40_000, identifier)
    listed = sorted((r["of_seq"], r["seq"]) for r in search.related_items(chosen, right_df, identifier).collect())
    by_hand = [
        (a[1], b[1]) for a in left for b in right
        if a[2] is not None and b[2] is not None and abs(a[2] - b[2]) <= 40_000 and (identifier is None or (a[3] is not None and a[3] == b[3]))
    ]
    assert listed == sorted(by_hand)
    for r in got:
        near = [b for b in right if b[2] is not None and (identifier is None or (b[3] is not None and b[3] == r["ident"]))]
        assert r["match_start"] == sum(b[2] < r["key_ms"] - 40_000 for b in near)
        assert r["match_count"] == sum(abs(b[2] - r["key_ms"]) <= 40_000 for b in near)


def test_filters(spark):
    rows = [(0, 0, 1, None, 0, "INFO Start"), (0, 1, 2, 10, 10, "ERROR stop"), (0, 1, 3, 10, 10, " more"), (1, 0, 1, 20, 20, "WARN start")]
    df = spark.createDataFrame(rows, "source_id INT, seq BIGINT, line_no BIGINT, key_ms BIGINT, sort_key BIGINT, text STRING")
    texts = lambda d: sorted(r["raw_text"] for r in d.collect())
    assert texts(search.filter_text(df, "tart")) == ["INFO Start", "WARN start"]
    assert texts(search.filter_text(df, "START", ignore_case=True)) == ["INFO Start", "WARN start"]
    assert texts(search.filter_text(df, "op\n mo")) == texts(search.filter_text(df, "more")) == ["ERROR stop\n more"]
    for known in ({}, {"within_line": True}, {"literal": "N"}, {"literal": "N", "within_line": True}):
        assert texts(search.filter_regex(df, "^(INFO|WARN)", **known)) == ["INFO Start", "WARN start"]
    assert texts(search.filter_regex(df, "stop.more".replace(".", "\\s+"))) == ["ERROR stop\n more"]
    firsts = df.filter("line_no <> 3")
    lines = lambda d: sorted(r["text"] for r in d.collect())
    assert lines(search.filter_time_range(firsts, 0, 20)) == ["ERROR stop"]
    assert lines(search.filter_time_range(firsts, 0, 20, undated=True)) == ["ERROR stop", "INFO Start"]
    assert lines(search.filter_source(firsts, [1])) == ["WARN start"]
    assert lines(search.filter_level(firsts, "^([A-Z]+) ", ["ERROR"])) == ["ERROR stop"]


def test_latency_small(spark):
    values = {0: [5.0], 1: [1.0, 2.0], 2: [float(i) for i in range(1, 21)], 3: [2.0] * 30 + [9.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "variant INT, ms DOUBLE")
    got = {r["variant"]: (r["n"], r["median"], r["p95"], r["min"], r["max"]) for r in summary.latency_summary(df).collect()}
    assert got == {0: (1, 5.0, 5.0, 5.0, 5.0), 1: (2, 1.5, 2.0, 1.0, 2.0), 2: (20, 10.5, 19.0, 1.0, 20.0), 3: (31, 2.0, 2.0, 2.0, 9.0)}


def test_one_identifier_at_one_time_is_spread(spark):
    rows = [(k % 3, k, 1000 + int(k % 5 == 0), "same", k % 7) for k in range(600)] + [(0, 700, 1500, "other", 0), (1, 701, None, "same", 0), (2, 702, 1000, None, 0)]
    right = stored(spark.createDataFrame(rows, "source_id INT, seq BIGINT, key_ms BIGINT, user STRING, extra INT"))
    left = spark.createDataFrame([(9, 0, 1000, "same"), (9, 1, 1500, "other"), (9, 2, 1001, "same")], "source_id INT, seq BIGINT, key_ms BIGINT, user STRING")
    matches = stored(search.time_correlate(left, right, 0, "user"))
    for width in (1 << 16, 4):
        got = sorted((r["of_seq"], r["source_id"], r["seq"]) for r in search.related_items(matches, right, "user", width).collect())
        want = sorted((i, r[0], r[1]) for i, key, who in ((0, 1000, "same"), (1, 1500, "other"), (2, 1001, "same")) for r in rows if r[2] == key and r[3] == who)
        assert got == want
    # Blocks of the innermost count hold no more than their width.
    ranked = search._ranked(right.filter("key_ms is not null and user is not null"), "user", 4)
    assert sorted(r["_place"] for r in ranked.filter("user = 'same'").collect()) == list(range(600))
