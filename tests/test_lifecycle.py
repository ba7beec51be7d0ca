"""Opening, storing, reloading and streaming end to end."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_assemble import LINES, lines_of, random_sources

from timberline.operators import assemble, changes, timeline
from timberline.plans.ingest import open_logs, reload_files, snapshot_files
from timberline.session import own_copies, shared_dir, stored
from timberline.sources import files, store
from timberline.streaming.assemble import StreamAssembler

STATUS = "source_id INT, generation BIGINT, status STRING, change_kind STRING"
SNAPSHOT = "path STRING, file_id STRING, size BIGINT"


@pytest.mark.parametrize("seed,batches", [(11, 4), (12, 7)])
def test_stream_equals_batch(spark, tmp_path, seed, batches):
    rows = lines_of(random_sources(seed, longest=250))
    df = stored(spark.createDataFrame(rows, LINES))
    base, rng = str(tmp_path / "out"), random.Random(seed)
    last = max(r[1] for r in rows)
    cuts = sorted(rng.sample(range(1, last), batches - 1)) + [last]
    assembler, low = StreamAssembler(spark, base), 0
    for cut in cuts:
        df.filter((F.col("line_no") > low) & (F.col("line_no") <= cut)).write.mode("append").parquet(base + "/in")
        assembler.start(spark.readStream.schema(df.schema).parquet(base + "/in"), base + "/checkpoint").awaitTermination()
        low = cut
    streamed = assembler.finish()
    batch = assemble.assemble_items(df, assemble.infer_source_format(df))
    assert streamed.exceptAll(batch).count() == batch.exceptAll(streamed).count() == 0
    bodies = {(r["source_id"], r["seq"]): r["raw_text"] for r in assemble.bodies(assembler.item_lines()).collect()}
    numbered = assemble.item_seq(assemble.keyed_lines(df, assemble.infer_source_format(df)))
    assert bodies == {(r["source_id"], r["seq"]): r["raw_text"] for r in assemble.bodies(numbered).collect()}


def test_batches_leave_no_copies(spark, tmp_path):
    assembler, seen = StreamAssembler(spark, str(tmp_path)), []
    folders = lambda: {p.name for p in Path(shared_dir(spark)).iterdir()}
    before = folders()
    for epoch in range(4):
        assembler.process(spark.createDataFrame([(0, epoch + 1, 24 * epoch, 23, "2026/07/28 10:00:00 a", True)], LINES), epoch)
        seen.append(len(folders() - before))
    assert seen == [0, 0, 0, 0]
    assert len(list((tmp_path / "held").iterdir())) == len(list((tmp_path / "sources").iterdir())) == 2


def test_repeated_epoch_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame(lines_of({0: ["2026/07/28 10:00:00 a", "b"], 1: ["x", "y"]}), LINES)
    assembler = StreamAssembler(spark, str(tmp_path))
    assembler.process(df, 0)
    more = spark.createDataFrame([(0, 3, 24, 1, "c", True)], LINES)
    for _ in range(3):
        assembler.process(more, 1)
    rows = assembler.finish().orderBy("source_id", "seq").collect()
    assert [(r["source_id"], r["continuation_count"]) for r in rows] == [(0, 2), (1, 0), (1, 0)]


def test_verdicts(spark):
    old = spark.createDataFrame([("same", "1", 5), ("grown", "2", 5), ("cut", "3", 5), ("swap", "4", 5), ("gone", "5", 5), ("empty", None, 0)], SNAPSHOT)
    new = spark.createDataFrame([("same", "1", 5), ("grown", "2", 6), ("cut", "3", 4), ("swap", "x", 5), ("new", "6", 1), ("empty", "7", 3)], SNAPSHOT)
    got = {r["path"]: r["verdict"] for r in changes.compare_snapshots(old, new).collect()}
    assert got == {"same": "Unchanged", "grown": "Appended", "cut": "Shrunk", "swap": "Replaced", "gone": "Deleted", "new": "New", "empty": "Appended"}


def test_changed_is_sticky_and_errors_pass(spark):
    status = spark.createDataFrame([(0, 1, "Changed", "Shrunk"), (1, 1, "Error", None), (2, 1, "Loaded", None), (3, 1, "Loaded", None), (4, 2, "Loaded", None)], STATUS)
    verdicts = spark.createDataFrame([(0, "Unchanged", None), (1, "Appended", None), (2, None, "locked"), (3, "Deleted", None)], "source_id INT, verdict STRING, read_error STRING")
    rows = changes.refresh_status(status, verdicts).orderBy("source_id").collect()
    assert [tuple(r)[1:] for r in rows] == [(1, "Changed", "Shrunk"), (1, "Loaded", None), (1, "Error", None), (2, "Changed", "Deleted"), (2, "Loaded", None)]


def test_open_store_reload(spark, tmp_path):
    stamp = "2026/07/28 10:00:0{} {}\n"
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("lead\n" + stamp.format(1, "a1") + "more\n")
    (folder / "b.log").write_bytes("2026/07/28 10:00:02.500 caf\xe9\n".encode("cp1252") + b"2026/07/28 10:00:03.500 x")
    (folder / "c.log").write_bytes(b"\xff\xfea\0\n\0")
    found = {r["path"].split("/")[-1]: r["path"] for r in files.scan_log_lines(spark, str(folder)).select("path").distinct().collect()}
    sources = spark.createDataFrame([(i, n[0], found[n], i) for i, n in enumerate(["a.log", "b.log", "c.log"])], "source_id INT, name STRING, path STRING, config_pos INT")
    profile = spark.createDataFrame([(0, "west", "**/b.log", 0, "windows-1252", None, "LOG-DT-001")],
                                    "pos INT, name STRING, path_pattern STRING, priority BIGINT, encoding STRING, ansi_codepage INT, datetime_format STRING")
    opened = open_logs(spark, sources, profile)
    summary = {r["source_id"]: r for r in opened.summary().collect()}
    assert [(summary[i]["line_count"], summary[i]["item_count"], summary[i]["format"]) for i in (0, 1)] == [(3, 2, "LOG-DT-005"), (2, 2, "LOG-DT-001")]
    assert (summary[1]["encoding"], summary[1]["profile_route"], summary[1]["format_route"], summary[1]["unconfirmed_tail"]) == ("windows-1252", "glob", "profile", True)
    assert (summary[2]["error"], summary[2]["line_count"]) == ("UNSUPPORTED_UTF16", 0)
    assert [(summary[i]["invalid_count"], summary[i]["file_bytes"]) for i in (0, 1)] == [(0, (folder / "a.log").stat().st_size), (0, (folder / "b.log").stat().st_size)]
    bodies = {(r["source_id"], r["seq"]): r["raw_text"] for r in assemble.bodies(opened.item_lines()).collect()}
    assert bodies == {(0, 0): "lead", (0, 1): "2026/07/28 10:00:01 a1\nmore", (1, 0): "2026/07/28 10:00:02.500 café", (1, 1): "2026/07/28 10:00:03.500 x"}
    view = timeline.merged_timeline(opened.items, sources.withColumn("source_ordinal", F.col("config_pos")))
    order = [(r["source_id"], r["seq"]) for r in view.orderBy("position").collect()]
    assert order == [(0, 0), (0, 1), (1, 0), (1, 1)]

    path, before = str(tmp_path / "items"), files.with_identity(files.file_manifest(spark, str(folder)), files.scan_log_lines(spark, str(folder)))
    before = stored(before)
    store.write_items(opened.items, path)
    with open(folder / "a.log", "a") as f:
        f.write(stamp.format(4, "a2"))
    (folder / "b.log").unlink()
    after = stored(files.with_identity(files.file_manifest(spark, str(folder)), files.scan_log_lines(spark, str(folder)), before))
    verdicts = stored(changes.compare_snapshots(before, after).join(sources.select("path", "source_id"), "path"))
    assert {r["source_id"]: r["verdict"] for r in verdicts.collect()} == {0: "Appended", 1: "Deleted", 2: "Unchanged"}
    status = spark.createDataFrame([(i, 1, "Loaded", None) for i in range(3)], STATUS)
    again = open_logs(spark, sources.filter("source_id = 0"))
    now = stored(store.reload(path, again.items, status, verdicts))
    assert [tuple(r)[:3] for r in now.orderBy("source_id").collect()] == [(0, 2, "Loaded"), (1, 2, "Changed"), (2, 1, "Loaded")]
    items = store.read_items(spark, path, now)
    assert {(r["source_id"], r["seq"], r["generation"]) for r in items.collect()} == {(0, 0, 2), (0, 1, 2), (0, 2, 2)}
    assert changes.timeline_staleness(changes.built_from(status), now).count() == 3
    assert changes.timeline_staleness(changes.built_from(now), now).count() == 0


def test_reload_files(spark, tmp_path):
    line = "2031/02/03 10:00:0{} {}\n"
    names = ["grown", "shrunk", "replaced and longer", "deleted", "new", "same"]
    for name in names:
        if name != "new":
            (tmp_path / f"{name}.log").write_text(line.format(1, "banner") + line.format(2, name))
    sources = spark.createDataFrame([(i, n, str(tmp_path / f"{n}.log"), i) for i, n in enumerate(names)], "source_id INT, name STRING, path STRING, config_pos INT")
    before, path = snapshot_files(spark, sources), str(tmp_path / "items")
    opened = open_logs(spark, sources)
    store.write_items(opened.items, path)
    assert [tuple(r) for r in opened.errors.collect()] == [(4, "NOT_FOUND")]
    with open(tmp_path / "grown.log", "a") as f:
        f.write(line.format(3, "more"))
    (tmp_path / "shrunk.log").write_text(line.format(1, "banner"))
    (tmp_path / "replaced and longer.log").write_text(line.format(1, "banner") + line.format(5, "something else") * 3)
    (tmp_path / "deleted.log").unlink()
    (tmp_path / "new.log").write_text(line.format(4, "hello"))
    status = spark.createDataFrame([(i, 1, "Loaded", None) for i in (0, 1, 2, 3, 5)], STATUS)
    now, snapshot = reload_files(spark, sources, path, status, before)
    assert {r[0]: tuple(r)[1:4] for r in now.collect()} == {
        0: (2, "Loaded", None), 1: (2, "Changed", "Shrunk"), 2: (2, "Changed", "Replaced"), 3: (2, "Changed", "Deleted"), 4: (1, "Loaded", None), 5: (1, "Loaded", None),
    }
    held = sorted((r["source_id"], r["seq"], r["generation"]) for r in store.read_items(spark, path, now).collect())
    assert held == [(0, 0, 2), (0, 1, 2), (0, 2, 2), (4, 0, 1), (5, 0, 1), (5, 1, 1)]
    assert snapshot.count() == 5
    view = timeline.merged_timeline(store.read_items(spark, path, now), sources.withColumn("source_ordinal", F.col("config_pos")))
    for generation in (1, 2):
        store.write_timeline(view, str(tmp_path / "view"), generation)
    kept, current = store.read_timeline(spark, str(tmp_path / "view"), expected=2)
    assert current == 2 and sorted(r["position"] for r in kept.collect()) == list(range(6))
    with pytest.raises(timeline.GenerationMismatch):
        store.read_timeline(spark, str(tmp_path / "view"), expected=1)


def test_extract_text_and_file_agree(spark, tmp_path):
    df = spark.createDataFrame(lines_of({0: ["2026/07/28 10:00:02 b", "c"], 1: ["2026/07/28 10:00:01 a", "", "z"]}), LINES)
    formats = assemble.infer_source_format(df)
    numbered = stored(assemble.item_seq(assemble.keyed_lines(df, formats)))
    view = timeline.merged_timeline(assemble.assemble_items(df, formats), spark.createDataFrame([(0, 0), (1, 1)], "source_id INT, source_ordinal INT"))
    lines = store.extract_lines(view, numbered)
    text = store.extract_text(lines).first()
    assert text["text"] == "2026/07/28 10:00:01 a\n\nz\n2026/07/28 10:00:02 b\nc" and text["items"] == 2
    assert text["bytes"] == len(text["text"])
    store.write_extract(lines, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == text["text"] + "\n"


def test_copies_go_with_their_scope(spark):
    with own_copies(spark):
        gone = stored(spark.range(5))
        assert gone.count() == 5
    kept = stored(spark.range(3))
    assert kept.count() == 3
    with pytest.raises(Exception):
        gone.count()
