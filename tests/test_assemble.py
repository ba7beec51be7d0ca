"""Assembly against a line-by-line state machine, and its independence of how rows are distributed."""

import random

import pytest
from pyspark.sql import functions as F

from timberline.operators import assemble, search
from timberline.session import TASK_BYTES, stored

LINES = "source_id INT, line_no BIGINT, raw_offset BIGINT, raw_len INT, text STRING, confirmed BOOLEAN"


def lines_of(sources):
    rows = []
    for source, texts in sources.items():
        at = 0
        for n, text in enumerate(texts, 1):
            size = len(text.encode())
            rows.append((source, n, at, size, text, n < len(texts) or source % 2 == 0))
            at += size + 1
    return rows


def random_sources(seed, count=6, longest=400):
    rng = random.Random(seed)
    sources = {}
    for source in range(count):
        rate = rng.choice([0.0, 0.1, 0.5, 0.95, 1.0])
        lead = rng.choice([0, 1, 5, 99, 100, 101])
        texts = [f"lead {i}" for i in range(lead)]
        for i in range(rng.randrange(1, longest)):
            stamp = f"2031/05/{rng.randrange(1, 29):02d} 10:{rng.randrange(60):02d}:00"
            texts.append("  more é" if rng.random() < rate else f"{stamp} m{i}")
        sources[source] = texts
    return sources


def expected(sources):
    """One source at a time, the rule in words: a dated line opens an item, others join a dated one."""
    out = {}
    for source, texts in sources.items():
        dated = lambda t: t[:4] == "2031"
        has_format = any(map(dated, texts))
        items = []
        for n, text in enumerate(texts, 1):
            if has_format and not dated(text) and items and dated(items[-1][1][0]):
                items[-1][1].append(text)
            else:
                items.append((n, [text]))
        out[source] = [(first, len(t) - 1, "\n".join(t)) for first, t in items]
    return out


def assembled(spark, rows, width, scatter):
    df = spark.createDataFrame(rows, LINES)
    df = df.repartition(7, F.rand(3)) if scatter else df
    df = df.withColumn("text_bytes", F.octet_length("text"))
    keyed = assemble.keyed_lines(df, assemble.infer_source_format(df))
    numbered = stored(assemble.item_seq(keyed, width, keep_block=True))
    return assemble.items_of_parts(assemble.item_parts(numbered)), numbered.select("source_id", "seq", "line_no", "text")


@pytest.mark.parametrize("seed,width,scatter", [(1, 1 << 16, False), (1, 8, True), (2, 1, True), (3, 64, True)])
def test_against_state_machine(spark, seed, width, scatter):
    sources = random_sources(seed)
    items, lines = assembled(spark, lines_of(sources), width, scatter)
    rows = items.join(assemble.bodies(lines), ["source_id", "seq"]).orderBy("source_id", "seq").collect()
    want = expected(sources)
    for source, texts in sources.items():
        mine = [r for r in rows if r["source_id"] == source]
        assert [(r["first_line"], r["continuation_count"], r["raw_text"]) for r in mine] == want[source]
        assert [r["seq"] for r in mine] == list(range(len(mine)))
        assert all(r["raw_len"] == r["body_bytes"] == len(r["raw_text"].encode()) for r in mine)
        assert [r["confirmed"] for r in mine] == [True] * (len(mine) - 1) + [source % 2 == 0]


@pytest.mark.parametrize("width", [1, 64, 128, 1 << 16])
def test_body_has_one_shape_however_many_blocks_it_spans(spark, width):
    sources = {0: ["2031/02/03 10:00:00 start"] + [f"line {i}" for i in range(999)], 1: ["2031/02/03 10:00:00 x", "y"]}
    items, lines = assembled(spark, lines_of(sources), width, True)
    bodies = {(r["source_id"], r["seq"]): r["raw_text"] for r in assemble.bodies(lines).collect()}
    assert bodies == {(0, 0): "\n".join(sources[0]), (1, 0): "2031/02/03 10:00:00 x\ny"}
    assert items.filter("source_id = 0").first()["continuation_count"] == 999
    found = search.filter_text(lines, "line 500\nline 501").collect()
    assert [(r["source_id"], r["raw_text"]) for r in found] == [(0, "\n".join(sources[0]))]
    assert search.filter_regex(lines, "line 7\\nline 8\\n").count() == search.filter_regex(lines, "line 7\\nline 8\\n", literal="line 7").count() == 1
    with pytest.raises(Exception, match="source 0 item 0"):
        assemble.bodies(lines, limit_bytes=500).collect()


def test_format_of_a_late_line(spark):
    texts = ["no date"] * 150 + ["2031/02/03 10:00:00 at last"]
    df = spark.createDataFrame(lines_of({0: texts}), LINES)
    assert assemble.infer_source_format(df).first()["decided_at"] == 151
    assert assemble.infer_source_format(df, scan_lines=100).first()["decided_at"] is None


def test_items_equal_grouping_by_seq(spark):
    df = stored(assemble.mark_lines(spark.createDataFrame(lines_of(random_sources(9)), LINES)))
    formats = assemble.infer_source_format(df)
    by_parts = assemble.assemble_items(df, formats, 16)
    by_group = assemble.index_of(assemble.item_seq(assemble.keyed_lines(df, formats)))
    assert by_parts.exceptAll(by_group).count() == by_group.exceptAll(by_parts).count() == 0


def test_parts_are_made_in_small_tasks(spark, monkeypatch):
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before, seen, keep = [spark.conf.get(n) for n in sizes], {}, assemble.stored

    def noted(df, label):
        seen[label] = [spark.conf.get(n) for n in sizes]
        return keep(df, label)

    monkeypatch.setattr(assemble, "stored", noted)
    df = spark.createDataFrame(lines_of({0: ["2031/02/03 10:00:00 x", "y", "2031/02/03 10:00:01 z"]}), LINES)
    assert assemble.assemble_items(df, assemble.infer_source_format(df)).count() == 2
    assert all(int(size) <= TASK_BYTES for size in seen["parts"])
    assert [spark.conf.get(n) for n in sizes] == before


def test_explicit_format_reads_004_and_005(spark):
    texts = ["2031/05/17 08:47:36:72 a", "2031/05/17 08:47:37 b"]
    df = spark.createDataFrame(lines_of({0: texts, 1: texts, 2: texts}), LINES)
    formats = spark.createDataFrame([(0, "LOG-DT-004"), (1, "LOG-DT-005"), (2, None)], "source_id INT, format STRING")
    keys = {}
    for r in assemble.assemble_items(df, formats).orderBy("source_id", "seq").collect():
        keys.setdefault(r["source_id"], []).append(r["key_ms"])
    assert keys == {0: [1936774056720], 1: [1936774056000, 1936774057000], 2: [None, None]}


def test_carry_forward(spark):
    rows = [(0, 0, None), (0, 1, 5), (0, 2, None), (0, 3, None), (0, 4, 3), (0, 5, None), (1, 0, None)]
    df = spark.createDataFrame(rows, "source_id INT, seq BIGINT, key_ms BIGINT")
    got = [r["sort_key"] for r in assemble.carry_forward_key(df, width=2).orderBy("source_id", "seq").collect()]
    assert got == [-(2**63), 5, 5, 5, 3, 3, -(2**63)]


def test_routes(spark):
    settings = spark.createDataFrame(
        [(0, None, None, False), (1, "LOG-DT-001", "LOG-DT-002", False), (2, None, "LOG-DT-002", False), (3, "LOG-DT-001", None, True), (4, None, None, False)],
        "source_id INT, manual_format STRING, profile_format STRING, profile_unresolved BOOLEAN",
    )
    inferred = spark.createDataFrame(
        [(0, "Matched", "LOG-DT-006", 1, False), (4, "Ambiguous", None, 1, True)], "source_id INT, outcome STRING, format STRING, decided_at BIGINT, fell_back BOOLEAN"
    )
    rows = assemble.format_route(settings, inferred).orderBy("source_id").collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("LOG-DT-006", "auto", False), ("LOG-DT-001", "manual", False), ("LOG-DT-002", "profile", False),
        (None, "raw_display_fallback", True), (None, "auto", True),
    ]
