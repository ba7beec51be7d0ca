"""Range operators against sets of rows."""

import random

import pytest
from pyspark.sql import functions as F

from timberline.operators import ranges
from timberline.session import TASK_BYTES

SCHEMA = "sel INT, pos BIGINT, start BIGINT, count BIGINT"
KEYS = ["sel"]


def islands(rows):
    out = []
    for r in sorted(rows):
        if out and out[-1][0] + out[-1][1] == r:
            out[-1][1] += 1
        else:
            out.append([r, 1])
    return [tuple(x) for x in out]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    rows = [(s, i, rng.choice([rng.randrange(60), rng.randrange(70000)]), rng.randrange(9)) for s in range(8) for i in range(rng.randrange(1, 30))]
    rows += [(8, 0, 0, 200000), (8, 1, 65536, 10), (8, 2, 200000, 1)]
    toggles = [(s, rng.randrange(60)) for s in range(8) for _ in range(25)] + [(8, 65536), (8, 65536), (8, 70000)]
    return rows, toggles


def covered(rows):
    out = {}
    for sel, _, start, count in rows:
        out.setdefault(sel, set()).update(range(start, start + count))
    return out


def collected(df):
    out = {}
    for r in df.orderBy("sel", "start").collect():
        out.setdefault(r["sel"], []).append((r["start"], r["count"]))
    return out


def want(sets):
    return {s: islands(rows) for s, rows in sets.items() if rows}


def test_normalize(spark, data):
    df = spark.createDataFrame(data[0], SCHEMA)
    assert collected(ranges.normalize_ranges(df, KEYS)) == want(covered(data[0]))


def test_toggle_and_subtract(spark, data):
    rows, toggles = data
    df = spark.createDataFrame(rows, SCHEMA)
    flips = spark.createDataFrame(toggles, "sel INT, row BIGINT")
    flipped, cut = covered(rows), covered(rows)
    for sel, row in toggles:
        flipped[sel] ^= {row}
        cut[sel] -= {row}
    assert collected(ranges.toggle_rows(df, flips, KEYS)) == want(flipped)
    assert collected(ranges.subtract_rows(df, flips, KEYS)) == want(cut)


@pytest.mark.parametrize("total", [0, 1, 50, 65536, 10**6])
def test_clamp(spark, data, total):
    df = spark.createDataFrame(data[0], SCHEMA)
    sets = {s: {r for r in rows if r < total} for s, rows in covered(data[0]).items()}
    assert collected(ranges.clamp_ranges(df, total, KEYS)) == want(sets)


def test_row_selected_and_extract(spark, data):
    df = spark.createDataFrame(data[0], SCHEMA)
    sets = covered(data[0])
    rows = spark.createDataFrame([(s, r) for s in range(9) for r in (0, 3, 17, 4095, 4096, 65535, 65536, 199999, 200000, 200001)], "sel INT, row BIGINT")
    for r in ranges.row_selected(rows, df, KEYS).collect():
        assert r["selected"] == (r["row"] in sets[r["sel"]])
    view = spark.range(0, 80000).withColumnRenamed("id", "position")
    one = df.filter("sel = 3").drop("sel")
    assert {r[0] for r in ranges.extract_ranges(view, one).collect()} == {r for r in sets[3] if r < 80000}


@pytest.mark.parametrize(
    "rows,reason",
    [
        ([], "NoRanges"),
        ([(0, 0, 5), (1, 5, 5)], None),
        ([(0, 0, 0)], "EmptyRange"),
        ([(0, 5, 5), (1, 9, 2)], "OverlappingOrUnordered"),
        ([(0, 5, 5), (1, 0, 2)], "OverlappingOrUnordered"),
        ([(0, 5, 6)], "OutOfBounds"),
        ([(0, 5, 5), (1, 10, 0)], "EmptyRange"),
        ([(0, 11, 1), (1, 0, 0)], "OutOfBounds"),
        ([(0, 0, 10)], None),
    ],
)
def test_validate(spark, rows, reason):
    df = spark.createDataFrame(rows, "pos BIGINT, start BIGINT, count BIGINT")
    assert ranges.selection_reason(df, 10) == reason


@pytest.mark.parametrize("max_lines,max_bytes,verdict,size", [(3, 100, "accepted", 14), (2, 100, "too_many_lines", None), (3, 14, "accepted", 14), (3, 13, "too_many_bytes", 14), (3, 4, "too_many_bytes", 9)])
def test_verdict_at_its_limits(spark, max_lines, max_bytes, verdict, size):
    view = spark.createDataFrame([(i, 4) for i in range(10)], "position BIGINT, body_bytes BIGINT")
    chosen = spark.createDataFrame([(0, 1, 2), (1, 7, 1)], "pos BIGINT, start BIGINT, count BIGINT")
    row = ranges.extract_verdict(view, chosen, max_lines, max_bytes).first()
    assert (row["verdict"], row["selected_bytes"], row["selected_lines"]) == (verdict, size, 3)


def test_verdict_needs_readable_sources(spark):
    view = spark.createDataFrame([(0, 4), (1, None)], "position BIGINT, body_bytes BIGINT")
    chosen = spark.createDataFrame([(0, 0, 2)], "pos BIGINT, start BIGINT, count BIGINT")
    assert ranges.extract_verdict(view, chosen, 100, 1000).first()["verdict"] == "source_unavailable"


def test_verdict_against_sums(spark):
    rng = random.Random(11)
    sizes = [rng.randrange(0, 30) for _ in range(300)]
    view = spark.createDataFrame(list(enumerate(sizes)), "position BIGINT, body_bytes BIGINT")
    rows = [(s, i, rng.randrange(320), rng.randrange(0, 40)) for s in range(25) for i in range(rng.randrange(1, 6))]
    got = {r["sel"]: r for r in ranges.extract_verdict(view, spark.createDataFrame(rows, SCHEMA), 120, 500, KEYS).collect()}
    for s in range(25):
        mine = [r for r in rows if r[0] == s]
        picked = sorted({p for _, _, a, n in mine for p in range(a, a + n) if p < 300})
        lines, at, over = sum(r[3] for r in mine), -1, None
        for p in picked:
            at += sizes[p] + 1
            over = at if over is None and at > 500 else over
        want = ("too_many_lines", None) if lines > 120 else ("too_many_bytes", over) if over else ("accepted", at if picked else None)
        assert (got[s]["verdict"], got[s]["selected_bytes"], got[s]["selected_lines"]) == (*want, lines)


def test_a_range_of_any_length(spark):
    view = spark.range(0, 1000).withColumnRenamed("id", "position")
    huge = spark.createDataFrame([(0, 990, 10**13)], "pos INT, start BIGINT, count BIGINT")
    assert sorted(r[0] for r in ranges.extract_ranges(view, huge).collect()) == list(range(990, 1000))
    assert ranges.extract_ranges(view, huge.withColumn("sel", F.lit(1)), KEYS).count() == 10
    rows = spark.createDataFrame([(5,), (995,), (10**12,)], "row BIGINT")
    assert {r["row"]: r["selected"] for r in ranges.row_selected(rows, huge).collect()} == {5: False, 995: True, 10**12: True}


def test_small_constructors(spark):
    assert [tuple(r) for r in ranges.select_all(spark, 5).collect()] == [(0, 5)]
    assert ranges.select_all(spark, 0).count() == 0
    pair = spark.createDataFrame([(7, 3), (3, 7), (4, 4)], "a BIGINT, b BIGINT").select(ranges.range_between(F.col("a"), F.col("b")).alias("r"))
    assert [tuple(r["r"]) for r in pair.collect()] == [(3, 5), (3, 5), (4, 1)]


def test_sweeps_run_in_small_tasks(spark, data, monkeypatch):
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before, seen, keep = [spark.conf.get(n) for n in sizes], [], ranges.stored

    def noted(df, label):
        seen.append((label, [int(spark.conf.get(n)) for n in sizes]))
        return keep(df, label)

    monkeypatch.setattr(ranges, "stored", noted)
    # No key, ranges over several block borders, a block without ends in between, toggles at a border.
    rows = [(10, 65526), (65536, 1), (70000, 300000), (200000, 5), (500000, 2), (65530, 6)]
    flips = [(65535,), (65535,), (65536,), (131072,), (369999,), (370000,), (370000,), (370000,)]
    want = {p for a, n in rows for p in range(a, a + n)}
    for (p,) in flips:
        want ^= {p}
    found = ranges.toggle_rows(spark.createDataFrame(rows, "start BIGINT, count BIGINT"), spark.createDataFrame(flips, "row BIGINT"), [])
    assert sorted((r["start"], r["count"]) for r in found.collect()) == islands(want)
    assert [label for label, _ in seen] == ["spans", "sweep"]
    assert all(size <= TASK_BYTES for _, given in seen for size in given)
    assert [spark.conf.get(n) for n in sizes] == before


def test_sizes_look_up_each_place_once(spark, monkeypatch):
    view = spark.createDataFrame([(i, 4) for i in range(10)], "position BIGINT, body_bytes BIGINT")
    chosen = spark.range(500).select(F.col("id").alias("sel"), F.lit(3).cast("bigint").alias("start"), F.lit(2).cast("bigint").alias("count"))
    known, keep = [], ranges.small_side
    monkeypatch.setattr(ranges, "small_side", lambda df, *a, **k: known.append(df.count()) or keep(df, *a, **k))
    sized = ranges.sized_ranges(chosen, ranges.byte_sums(view))
    assert known == [2]
    assert {(r["_before"], r["_bytes"], r["_unknown"]) for r in sized.collect()} == {(15, 10, 0)} and sized.count() == 500
