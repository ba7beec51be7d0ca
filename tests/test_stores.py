"""The stored timeline that is updated by ranges, and search by signatures."""

import random

import pytest
from pyspark.sql import functions as F

from timberline.operators import assemble, search, timeline
from timberline.session import stored
from timberline.sources import search_store, timeline_store

ITEMS = "source_id INT, seq BIGINT, key_ms BIGINT, raw_len BIGINT"


def items_of(rng, source_id, n, first=0, base=0):
    return [(source_id, first + k, None if first + k < 3 and source_id % 2 else base + rng.randint(0, 50) * 1000, 10) for k in range(n)]


def in_order(view):
    return [(r["source_id"], r["seq"], r["key_ms"]) for r in view.orderBy("position").collect()]


def merged(spark, rows, sources):
    return in_order(timeline.merged_timeline(spark.createDataFrame(rows, ITEMS), sources))


def test_updates_equal_the_full_merge(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "view")
    sources = stored(spark.createDataFrame([(s, (s * 5 + 2) % 6) for s in range(6)], "source_id INT, source_ordinal INT"))
    rows = [r for s in range(6) for r in items_of(rng, s, 60)]
    timeline_store.write_view(spark.createDataFrame(rows, ITEMS), sources, path, piece_rows=20)
    view, generation = timeline_store.read_view(spark, path)
    assert generation == 1 and in_order(view) == merged(spark, rows, sources)
    # A tail, a whole source, a source that goes, and nothing at all.
    for cut in ({2: 55}, {0: 0, 3: 40}, {4: 0}, {}):
        new = [r for s, at in cut.items() if s != 4 for r in items_of(rng, s, rng.randint(1, 30), at, base=20_000)]
        rows = [r for r in rows if r[1] < cut.get(r[0], 1 << 40)] + new
        changed = spark.createDataFrame(list(cut.items()), "source_id INT, from_seq BIGINT")
        generation = timeline_store.update_view(spark, path, changed, spark.createDataFrame(new, ITEMS) if new else None, sources, piece_rows=20)
        view, current = timeline_store.read_view(spark, path, expected=generation)
        assert in_order(view) == merged(spark, rows, sources)
        assert sorted(r["position"] for r in view.collect()) == list(range(len(rows)))
    for start in (0, 17, len(rows) - 5, len(rows) + 9):
        page = timeline_store.fetch_page(spark, path, start, 12)
        want = timeline.fetch_range(view, start, 12)
        assert page.orderBy("position").collect() == want.select(*page.columns).orderBy("position").collect()
    with pytest.raises(timeline.GenerationMismatch):
        timeline_store.read_view(spark, path, expected=1)


def test_only_pieces_that_change_are_written(spark, tmp_path):
    path = str(tmp_path / "view")
    sources = stored(spark.createDataFrame([(0, 0), (1, 1)], "source_id INT, source_ordinal INT"))
    items = spark.range(10_000).select((F.col("id") % 2).cast("int").alias("source_id"), F.floor(F.col("id") / 2).alias("seq"), F.col("id").alias("key_ms"), F.lit(5).cast("bigint").alias("raw_len"))
    timeline_store.write_view(items, sources, path, piece_rows=500)
    changed = spark.createDataFrame([(1, 4_990)], "source_id INT, from_seq BIGINT")
    added = spark.range(4_990, 5_100).select(F.lit(1).alias("source_id"), F.col("id").alias("seq"), (F.col("id") * 2 + 1).alias("key_ms"), F.lit(5).cast("bigint").alias("raw_len"))
    timeline_store.update_view(spark, path, changed, added, sources, piece_rows=500)
    first_new = 2 << (timeline_store._TASK_BITS + timeline_store._GROUP_BITS)
    written = spark.read.parquet(path + "/rows").filter(F.col("piece") >= first_new).count()
    assert written < 1_500
    view, _ = timeline_store.read_view(spark, path)
    assert view.count() == 10_100 and view.agg(F.max("position"), F.count_distinct("position")).first()[:] == (10_099, 10_100)
    # Into an empty view.
    empty = str(tmp_path / "empty")
    timeline_store.write_view(items.limit(0), sources, empty)
    timeline_store.update_view(spark, empty, changed, added, sources)
    assert timeline_store.read_view(spark, empty)[0].count() == 110


def test_finely_cut_views_have_few_tasks_and_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(timeline_store, "CHUNK_ROWS", 400, raising=False)
    monkeypatch.setattr(timeline_store, "MOST_NAMED", 3)
    rng, path = random.Random(5), str(tmp_path / "view")
    sources = stored(spark.createDataFrame([(0, 1), (1, 0), (2, 2)], "source_id INT, source_ordinal INT"))
    rows = [(s, k, k * 10 + s, 5) for s in range(3) for k in range(800)]
    timeline_store.write_view(spark.createDataFrame(rows, ITEMS), sources, path, piece_rows=8)
    for generation in (1, 2, 3):
        if generation > 1:
            # What goes and what comes lies in several runs of pieces, which must not be cut across what stays.
            gone = {2: {1: 797}, 3: {0: 0}}[generation]
            new = [(s, at + k, rng.randrange(10, 8_000, 2_000) + k, 5) for s, at in gone.items() for k in range(40)]
            new.sort(key=lambda r: r[1])
            rows = [r for r in rows if r[1] < gone.get(r[0], 1 << 40)] + new
            changed = spark.createDataFrame(list(gone.items()), "source_id INT, from_seq BIGINT")
            timeline_store.update_view(spark, path, changed, spark.createDataFrame(new, ITEMS), sources, piece_rows=8)
        view, current = timeline_store.read_view(spark, path)
        assert current == generation and in_order(view) == merged(spark, rows, sources)
        assert sorted(r["position"] for r in view.collect()) == list(range(len(rows)))
        told = spark.read.parquet(f"{path}/manifest/generation={generation}").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        assert sum(r["n"] for r in told) == len(rows) and max(r["n"] for r in told) <= 8 and len(told) >= len(rows) / 8
        folders = [f for f in (tmp_path / "view" / "rows").iterdir() if f.is_dir()]
        assert len(folders) <= 8 * generation
        page = timeline_store.fetch_page(spark, path, 1_203, 30)
        assert page.orderBy("position").collect() == timeline.fetch_range(view, 1_203, 30).select(*page.columns).orderBy("position").collect()


WORDS = ["alpha", "Beta", "gamma ray", "zürich", "İstanbul", "K", "ok", "error=17", "σΣς", "", "  ", "x"]


def test_search_equals_a_scan(spark, tmp_path):
    rng, path = random.Random(7), str(tmp_path / "search")
    rows = [(s, k, k // 3, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 4)))) for s in range(3) for k in range(1, 9_000)]
    rows += [(1, 4_000, 4_000 // 3, "a rare needle stands here"), (2, 8_191, 8_191 // 3, "Rare Needle in 2")]
    lines = stored(spark.createDataFrame(rows, "source_id INT, line_no BIGINT, seq BIGINT, text STRING").dropDuplicates(["source_id", "line_no"]))
    items = stored(lines.groupBy("source_id", "seq").agg(F.min("line_no").alias("first_line"), (F.count("*") - 1).alias("continuation_count")))
    search_store.write_search(lines, path)
    for needle, fold in (("rare needle", False), ("RARE needle", True), ("nothing like it", False), ("k", True), ("zürich gam", False), ("σ", True), ("Beta\nerror=17", False), ("error=17 k", True)):
        got = sorted(tuple(r) for r in search_store.find_text(spark, path, needle, items, fold).collect())
        assert got == sorted(tuple(r) for r in search.filter_text(lines, needle, fold).collect()), needle
    assert search_store.candidates(spark, path, "nothing like it").count() == 0
    assert search_store.candidates(spark, path, "ok") is None


def test_blocks_without_the_needle_are_not_scanned(spark, tmp_path):
    path = str(tmp_path / "search")
    text = F.concat(F.lit("line "), F.sha2(F.col("id").cast("string"), 256), F.when(F.col("id") == 77_777, " the needle").otherwise(""))
    lines = spark.range(200_000).select(F.lit(0).alias("source_id"), (F.col("id") + 1).alias("line_no"), F.col("id").alias("seq"), text.alias("text"))
    search_store.write_search(lines, path)
    blocks = search_store.candidates(spark, path, "the needle")
    assert blocks.count() == 1
    near = search_store.lines_in(spark, path, blocks)
    near.collect()
    scan = near._jdf.queryExecution().executedPlan().collectLeaves().head()
    read = scan.metrics().apply("numOutputRows").value()
    assert near.count() == 4_096 and read < 30_000
