"""Ranges of files: lines by place, identities by probes, reloads that read what was appended."""

import os
import random

import pytest
from pyspark.sql import functions as F

from timberline.operators import assemble, changes
from timberline.plans.ingest import RESUME, bodies_from_files, open_logs, reload_files, snapshot_files
from timberline.session import stored
from timberline.sources import files, spans, store

SOURCES = "source_id INT, name STRING, path STRING, config_pos INT"
STATUS = "source_id INT, generation BIGINT, status STRING, change_kind STRING"


def random_file(rng, lines):
    ends = [b"\n", b"\n", b"\r\n"]
    return b"".join(rng.choice([b"", b"x", b"\r", "é".encode(), b"\xff", b"y" * rng.randint(1, 40)]) + rng.choice(ends) for _ in range(lines)) + rng.choice([b"", b"tail", b"\r"])


@pytest.mark.parametrize("seed", range(4))
def test_lines_between(seed, tmp_path):
    import pyarrow as pa

    rng = random.Random(seed)
    for k in range(30):
        data = random_file(rng, rng.randint(0, 40))
        limit = rng.randint(0, len(data))
        path = tmp_path / f"{seed}-{k}"
        path.write_bytes(data)
        cuts = sorted({0, limit, *(rng.randint(0, limit) for _ in range(3))})
        got = []
        for a, b in zip(cuts, cuts[1:]):
            with pa.OSFile(str(path), "rb") as file:
                some = list(spans.lines_between(file, a, b, limit, a == 0, step=rng.randint(1, 30)))
            assert [n for n, _ in some] == [sum(len(v) for _, v in some[:j]) for j in range(len(some))]
            got += [x.as_py() for _, v in some for x in v]
        assert got == data[:limit].splitlines(keepends=True) if b"\r" not in data[:limit] else b"".join(got) == data[:limit]
        assert all(x.count(b"\n") <= 1 and (x.endswith(b"\n") or j == len(got) - 1) for j, x in enumerate(got))


@pytest.mark.parametrize("direct", [None, False])
def test_ends_are_what_the_scan_gives(spark, tmp_path, direct):
    rng = random.Random(5)
    for k in range(12):
        (tmp_path / f"f {k}%41.log").write_bytes((b"\xef\xbb\xbf" if k % 3 == 0 else b"") + random_file(rng, rng.randint(0, 30)))
    (tmp_path / "empty.log").write_bytes(b"")
    scanned = stored(files.scan_log_lines(spark, str(tmp_path)))
    sizes = files.file_manifest(spark, str(tmp_path)).select("path", F.lit(0).cast("bigint").alias("start"), "size")
    read = files.placed_lines(spans.read_lines(sizes, chunk_bytes=16, direct=direct))
    assert read.columns == scanned.columns
    assert read.exceptAll(scanned).count() == scanned.exceptAll(read).count() == 0 and scanned.count() > 50
    later = scanned.filter("line_no > 4")
    starts = scanned.filter("line_no <= 4").groupBy("path").agg((F.sum("line_bytes") + F.max(F.col("utf8_bom").cast("int")) * 3).alias("start"))
    tails = files.scan_ends(starts.join(sizes.drop("start"), "path"), direct=direct).withColumn("line_no", F.col("line_no") + 4)
    same = [c for c in later.columns if c != "utf8_bom"]
    assert tails.select(same).exceptAll(later.select(same)).count() == later.select(same).exceptAll(tails.select(same)).count() == 0


def test_a_check_reads_two_probes_a_file(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"{k}.log").write_bytes(bytes([65 + k]) * 100_000)
    sources = spark.createDataFrame([(k, str(k), str(tmp_path / f"{k}.log"), k) for k in range(6)], SOURCES)
    before = snapshot_files(spark, sources, probe_bytes=1000)
    sizes = spark.createDataFrame([(f"file:{tmp_path}/{k}.log", 100_000) for k in range(6)], "path STRING, size BIGINT")
    probed = spans.probe(spans.probe_ranges(sizes, 1000)).agg(F.sum("bytes_read"), F.count("*")).first()
    assert tuple(probed) == (6 * 2000, 12)
    data = bytearray((tmp_path / "1.log").read_bytes())
    data[-10] = 0
    (tmp_path / "1.log").write_bytes(data)
    (tmp_path / "2.log").write_bytes(b"C" * 100_000 + b"more")
    (tmp_path / "3.log").write_bytes(b"D" * 99_000 + b"E" * 2_000)
    (tmp_path / "4.log").write_bytes(b"E" * 99_999)
    (tmp_path / "5.log").unlink()
    os.utime(tmp_path / "0.log", (1, 1))
    got = changes.compare_snapshots(before, snapshot_files(spark, sources, before, probe_bytes=1000), "source_id")
    assert {r["source_id"]: r["verdict"] for r in got.collect()} == {0: "Unchanged", 1: "Replaced", 2: "Appended", 3: "Replaced", 4: "Shrunk", 5: "Deleted"}


def open_and_keep(spark, sources, path, status_ids):
    seen = snapshot_files(spark, sources, probe_bytes=64)
    opened = open_logs(spark, sources, sizes_seen=seen)
    store.write_items(opened.items, path)
    status = spark.createDataFrame([(i, 1, "Loaded", None) for i in status_ids], STATUS)
    return status, stored(seen.join(opened.resume_points(), "source_id", "left"))


def index(df):
    return sorted(tuple(r[c] for c in ("source_id", "seq", "key_ms", "first_line", "continuation_count", "raw_offset", "raw_len", "confirmed", "body_bytes")) for r in df.collect())


def test_reload_reads_on(spark, tmp_path):
    stamp = "2031/02/03 10:{:02d}:{:02d} {}\n"
    first = {
        "dated": "lead\n" + "".join(stamp.format(0, k, "a") + "more\n" for k in range(20)),
        "open": stamp.format(0, 1, "x") + "cut in the mid",
        "undated": "one\ntwo\nthree\n",
        "raw": "2031/02/03 10:00:00:12 ambiguous\nx\n",
        "bom": "﻿" + stamp.format(1, 1, "ü"),
        "breaks": stamp.format(1, 1, "fine"),
        "west": stamp.format(1, 1, "café"),
        "empty": "",
        "same": stamp.format(3, 3, "s"),
    }
    rounds = [
        {"dated": "goes on\n" + stamp.format(1, 0, "b"), "open": "dle\r\n" + stamp.format(0, 2, "y"), "undated": "four\n", "raw": stamp.format(5, 5, "z"), "bom": "é\n", "breaks": "ok\n", "west": "é", "empty": stamp.format(0, 0, "e")},
        {"dated": stamp.format(2, 0, "c") * 3, "undated": stamp.format(0, 9, "now dated") + "with more\n", "breaks": b"\xe9 no utf-8\n", "west": " end\n", "empty": "f"},
        {"dated": "x", "undated": "and more", "breaks": "again\n", "open": stamp.format(0, 5, "w")},
    ]
    as_bytes = lambda name, text: text if isinstance(text, bytes) else text.encode("cp1252" if name == "west" else "utf-8")
    for name, text in first.items():
        (tmp_path / f"{name}.log").write_bytes(as_bytes(name, text))
    sources = spark.createDataFrame([(i, n, str(tmp_path / f"{n}.log"), i) for i, n in enumerate(first)], SOURCES)
    path = str(tmp_path / "items")
    status, kept = open_and_keep(spark, sources, path, range(len(first)))
    for grown in rounds:
        for name, text in grown.items():
            with open(tmp_path / f"{name}.log", "ab") as f:
                f.write(as_bytes(name, text))
        status, kept = reload_files(spark, sources, path, status, kept, probe_bytes=64)
        whole = open_logs(spark, sources)
        assert index(store.read_items(spark, path, status)) == index(whole.items)
        assert set(RESUME) < set(kept.columns) and kept.count() == len(first)
    generations = {r["source_id"]: r["generation"] for r in status.collect()}
    assert generations == {0: 4, 1: 3, 2: 4, 3: 2, 4: 2, 5: 4, 6: 3, 7: 3, 8: 1}
    # Only what was made again is stored under a later generation.
    held = spark.read.parquet(path).filter("source_id = 0").groupBy("generation").count().collect()
    assert {r["generation"]: r["count"] for r in held} == {1: 21, 2: 2, 3: 4, 4: 1}
    bodies = bodies_from_files(store.read_items(spark, path, status), sources, whole.encodings).collect()
    want = {(r["source_id"], r["seq"]): r["raw_text"] for r in assemble.bodies(whole.item_lines()).collect()}
    assert {(r["source_id"], r["seq"]): r["raw_text"] for r in bodies} == want


def test_many_reloads_are_stored_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_PARTS", 2)
    line = "2031/02/03 10:00:{:02d} m\n"
    (tmp_path / "a.log").write_text(line.format(0))
    sources = spark.createDataFrame([(0, "a", str(tmp_path / "a.log"), 0)], SOURCES)
    path = str(tmp_path / "items")
    status, kept = open_and_keep(spark, sources, path, [0])
    for k in range(1, 5):
        with open(tmp_path / "a.log", "a") as f:
            f.write(line.format(k))
        status, kept = reload_files(spark, sources, path, status, kept)
        assert index(store.read_items(spark, path, status)) == index(open_logs(spark, sources).items)
    assert store.parts_of(spark, path, status).count() <= 2


def test_what_is_appended_during_a_reload_is_found_next_time(spark, tmp_path, monkeypatch):
    from timberline.plans import ingest

    line = "2031/02/03 10:00:{:02d} m\n"
    (tmp_path / "a.log").write_text(line.format(0) + line.format(1))
    (tmp_path / "b.log").write_text(line.format(0))
    sources = spark.createDataFrame([(0, "a", str(tmp_path / "a.log"), 0), (1, "b", str(tmp_path / "b.log"), 1)], SOURCES)
    for resumes in (True, False):
        path = str(tmp_path / f"items {resumes}")
        status, kept = open_and_keep(spark, sources, path, [0, 1])
        if not resumes:
            kept = kept.select("source_id", "size", "mtime", "file_id")
        with open(tmp_path / "a.log", "a") as f:
            f.write(line.format(2))
        looked = ingest._seen

        def grows_after(*args):
            found = looked(*args)
            for name in ("a", "b"):
                with open(tmp_path / f"{name}.log", "a") as f:
                    f.write(line.format(3))
            return found

        monkeypatch.setattr(ingest, "_seen", grows_after)
        status, kept = reload_files(spark, sources, path, status, kept)
        monkeypatch.setattr(ingest, "_seen", looked)
        before = index(store.read_items(spark, path, status))
        status, kept = reload_files(spark, sources, path, status, kept)
        after = index(store.read_items(spark, path, status))
        assert len(after) == len(before) + 2 and after == index(open_logs(spark, sources).items)
