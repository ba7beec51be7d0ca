"""Byte-level behaviour of the file source."""

import pytest
from pyspark.sql import functions as F

from timberline.operators import assemble
from timberline.plans.ingest import open_logs
from timberline.session import stored
from timberline.sources import files

BOM = b"\xef\xbb\xbf"
STAMP = b"2026/07/28 15:12:2%d.123 "

CONTENT = {
    "plain": b"a\nb\nc\n",
    "crlf": b"a\r\nb\r\n",
    "lone_cr": b"a\rb\n",
    "double_cr": b"a\r\r\nx\n",
    "unterminated": b"a\nb",
    "unterminated_cr": b"a\nb\r",
    "blank_lines": b"\n\n\n",
    "empty": b"",
    "bom": BOM + b"a\nb\n",
    "bom_open": BOM + b"a\nb",
    "bom_only": BOM,
    "bom_one": BOM + b"\n",
    "single_open": b"x",
    "cr_only": b"\r",
    "cr_lf": b"\r\n",
}


def write(folder, content):
    for name, data in content.items():
        (folder / f"{name}.log").write_bytes(data)
    return str(folder)


def split(data):
    """The splitting rule, byte by byte: (line, confirmed)."""
    parts = data.split(b"\n")
    lines = [(p[:-1] if p.endswith(b"\r") else p, True) for p in parts[:-1]]
    return lines + ([(parts[-1], False)] if parts[-1] else [])


def named(lines):
    return lines.withColumn("name", F.regexp_extract("path", r"([a-z0-9_]+)\.log$", 1))


@pytest.mark.parametrize("split_bytes", ["128m", "1"])
def test_line_split(spark, tmp_path, split_bytes):
    path = write(tmp_path, CONTENT)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
        rows = named(files.scan_log_lines(spark, path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, data in CONTENT.items():
        got = sorted((r["line_no"], bytes(r["bytes"]), r["confirmed"], r["utf8_bom"]) for r in rows if r["name"] == name)
        bom = data.startswith(BOM)
        want = [(i, line, ok, bom) for i, (line, ok) in enumerate(split(data[3:] if bom else data), 1)]
        assert got == want, name


def test_offsets(spark, tmp_path):
    data = {"a": BOM + "é1\r\nzwei\nx".encode(), "b": b"1\n22\r\n333\n"}
    lines = named(files.scan_log_lines(spark, write(tmp_path, data)))
    lines = lines.withColumn("source_id", F.when(F.col("name") == "a", 0).otherwise(1))
    for r in files.line_positions(lines).collect():
        whole = data[r["name"]]
        assert whole[r["raw_offset"] : r["raw_offset"] + r["raw_len"]] == bytes(r["bytes"])


def test_order_over_many_splits(spark, tmp_path):
    (tmp_path / "big.log").write_bytes(b"".join(b"%d %s\n" % (i, b"x" * (i % 50)) for i in range(1, 20001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        lines = files.scan_log_lines(spark, str(tmp_path))
        wrong = lines.filter(F.split(F.col("bytes").cast("string"), " ")[0].cast("bigint") != F.col("line_no"))
        assert (lines.count(), wrong.count()) == (20000, 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_manifest_lists_empty_files(spark, tmp_path):
    rows = named(files.file_manifest(spark, write(tmp_path, CONTENT))).collect()
    assert {r["name"]: r["size"] for r in rows} == {k: len(v) for k, v in CONTENT.items()}


ODD_NAMES = {"two words.log": b"2031/02/03 10:00:00 x\n", "caf\u00e9+1%20.log": b"a\nb\n", "nothing here.log": b""}


def test_odd_names_and_missing_files(spark, tmp_path):
    root = tmp_path / "odd"
    root.mkdir()
    for name, content in ODD_NAMES.items():
        (root / name).write_bytes(content)
    rows = files.file_manifest(spark, str(root)).collect()
    assert {r["path"].split("/")[-1]: r["size"] for r in rows} == {k: len(v) for k, v in ODD_NAMES.items()}
    assert len(rows) == 3 and all(r["mtime"] is not None for r in rows)
    wanted = [(i, n, str(root / n), i) for i, n in enumerate([*ODD_NAMES, "missing.log"])]
    opened = open_logs(spark, spark.createDataFrame(wanted, "source_id INT, name STRING, path STRING, config_pos INT"))
    assert {(r["source_id"], r["error"]) for r in opened.errors.collect()} == {(3, "NOT_FOUND")}
    assert sorted(r["source_id"] for r in opened.lines.select("source_id").collect()) == [0, 1, 1]
    assert {r["source_id"]: r["raw_text"] for r in assemble.bodies(opened.item_lines()).filter("seq = 0").collect()} == {0: "2031/02/03 10:00:00 x", 1: "a"}


def test_late_bytes_decide_and_identity_is_the_content(spark, tmp_path):
    early, late = b"x" * 70_000 + b"\n", b"\xe9t\xe9\n"
    lines = named(files.scan_log_lines(spark, write(tmp_path, {"late": early + late}))).withColumn("source_id", F.lit(0))
    settings = spark.createDataFrame([(0, None, None)], "source_id INT, encoding_name STRING, ansi_codepage INT")
    routes = [files.detect_encoding(lines, settings, 1252, limit).first()["route"] for limit in (None, 65536)]
    assert routes == ["default_codepage", "utf8_valid"]
    assert [tuple(r) for r in files.bad_line_counts(lines).collect()] == [(0, 2, 1)]

    def look(content, before=None):
        folder = str(write(tmp_path, {"log": content}))
        seen = files.with_identity(files.file_manifest(spark, folder), files.scan_log_lines(spark, folder), before)
        return stored(seen.filter("path like '%/log.log'"))

    first = look(b"banner\none\ntail")
    for content, same in ((b"banner\none\ntail and more\n", True), (b"banner\nnew\nlonger than before\n", False)):
        assert (look(content, first).first()["file_id"] == first.first()["file_id"]) is same


ENCODED = {
    # name: (bytes, encoding name, page, expected encoding, route, warning, error)
    "utf8": ("héllo\n".encode(), None, None, "utf-8", "utf8_valid", None, None),
    "utf8_bom": (BOM + b"a\n", None, None, "utf-8", "utf8_bom", None, None),
    "utf8_named_bom": (BOM + b"a\n", "UTF-8", None, "utf-8", "named_encoding", None, None),
    "latin": ("caf\xe9 au lait\n".encode("latin-1"), None, None, "windows-1252", "default_codepage", None, None),
    "cp932": ("ログ\nテスト\n".encode("cp932"), "windows-932", None, "windows-932", "named_encoding", None, None),
    "cp1252": ("caf\xe9\n".encode("cp1252"), None, 1252, "windows-1252", "ansi_codepage", None, None),
    "utf16_le": (b"\xff\xfea\0\n\0", None, None, None, "utf16_bom", None, "UNSUPPORTED_UTF16"),
    "utf16_be": (b"\xfe\xff\0a\0\n", None, None, None, "utf16_bom", None, "UNSUPPORTED_UTF16"),
    "conflict": (BOM + b"a\nb\n", "windows-932", None, "windows-932", "named_encoding", "BOM_CONFLICT", None),
    "utf16_named": (b"\xff\xfea\n", "utf-8", None, "utf-8", "named_encoding", "BOM_CONFLICT", None),
    "bad_page": (b"a\n", None, 99999, None, "ansi_codepage", None, "UNKNOWN_CODEPAGE"),
    "bad_name": (b"a\n", "latin1", None, None, "named_encoding", None, "INVALID_ENCODING_NAME"),
    "name_wins": (b"a\n", " Windows-1252 ", 932, "windows-1252", "named_encoding", None, None),
    "cut_tail": ("aé".encode()[:-1], None, None, "utf-8", "utf8_valid", None, None),
    "cut_line": ("aé".encode()[:-1] + b"\n", None, None, "windows-1252", "default_codepage", None, None),
    "late_bad": (b"x" * 65535 + b"\n\xff\xff\n", None, None, "utf-8", "utf8_valid", None, None),
    "cut_at_limit": (b"x" * 65535 + "é\n".encode(), None, None, "utf-8", "utf8_valid", None, None),
    "bad_at_limit": (b"x" * 65535 + b"\xff\n", None, None, "windows-1252", "default_codepage", None, None),
    "bad_before_limit": (b"x" * 65534 + b"\xc3\n" + b"y\n", None, None, "windows-1252", "default_codepage", None, None),
    "crlf_cut": (b"x" * 65533 + b"\xc3\r\n", None, None, "windows-1252", "default_codepage", None, None),
}


@pytest.fixture(scope="module")
def encoded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("encoded")
    path = write(folder, {k: v[0] for k, v in ENCODED.items()})
    ids = {name: i for i, name in enumerate(ENCODED)}
    table = spark.createDataFrame([(i, n, ENCODED[n][1], ENCODED[n][2]) for n, i in ids.items()], "source_id INT, name STRING, encoding_name STRING, ansi_codepage INT")
    lines = named(files.scan_log_lines(spark, path)).join(table.select("name", "source_id"), "name")
    decided = stored(files.detect_encoding(lines, table, 1252, detect_bytes=65536))
    readable, errors = files.reject_unsupported(lines, decided)
    text = files.line_positions(files.decode_lines(readable, decided), F.col("bom_len"))
    return ids, {r["source_id"]: r for r in decided.collect()}, stored(text), errors


@pytest.mark.parametrize("name", ENCODED)
def test_encoding_decision(encoded, name):
    row = encoded[1][encoded[0][name]]
    assert (row["encoding"], row["route"], row["warning"], row["error"]) == ENCODED[name][3:]


def test_decoded_text(encoded):
    ids, _, text, errors = encoded
    got = {}
    for r in text.orderBy("source_id", "line_no").collect():
        got.setdefault(r["source_id"], []).append(r["text"])
    expected = {
        "utf8": ["héllo"],
        "utf8_bom": ["a"],
        "latin": ["café au lait"],
        "cp932": ["ログ", "テスト"],
        "cp1252": ["café"],
        "conflict": [BOM.decode("cp932", "replace") + "a", "b"],
        "cut_tail": ["a�"],
    }
    for name, lines in expected.items():
        assert got[ids[name]] == lines, name
    assert {r["source_id"] for r in errors.collect()} == {ids[n] for n in ("utf16_le", "utf16_be", "bad_page", "bad_name")}
    assert not {ids[n] for n in ("utf16_le", "utf16_be", "bad_page", "bad_name")} & set(got)


def test_conflicting_bom_counts_as_text(encoded):
    ids, decided, text, _ = encoded
    rows = text.filter(F.col("source_id") == ids["conflict"]).orderBy("line_no").collect()
    assert [(r["raw_offset"], r["raw_len"]) for r in rows] == [(0, 4), (5, 1)]
    assert decided[ids["conflict"]]["bom_len"] == 0


def test_invalid_positions(spark, tmp_path):
    data = {
        "bad_utf8": b"ok\n\xff\xe3\x81x\n" + "é".encode() + b"\x80\n",
        "many": b"\xff\n" * 150,
        "bad_cp932": b"ab\n\x81\x30\n",
    }
    lines = named(files.scan_log_lines(spark, write(tmp_path, data)))
    ids = {"bad_utf8": 0, "many": 1, "bad_cp932": 2}
    lines = lines.join(spark.createDataFrame(list(ids.items()), "name STRING, source_id INT"), "name")
    settings = spark.createDataFrame([(0, "utf-8", None), (1, "utf-8", None), (2, "windows-932", None)], "source_id INT, encoding_name STRING, ansi_codepage INT")
    decoded = files.line_positions(files.decode_lines(lines, files.detect_encoding(lines, settings, 0)), F.col("bom_len"))
    report = sorted((r["source_id"], r["position"], r["line_no"], r["invalid_count"]) for r in files.invalid_byte_report(decoded).collect())
    assert [r for r in report if r[0] == 0] == [(0, 3, 2, 3), (0, 4, 2, 3), (0, 10, 3, 3)]
    assert [r[1:] for r in report if r[0] == 1] == [(2 * k, k + 1, 150) for k in range(150)]
    assert [r[1] for r in report if r[0] == 2] == [3]
    texts = [r["text"] for r in decoded.filter("source_id = 0").orderBy("line_no").collect()]
    assert texts == ["ok", "��x", "é�"]


def items_of(spark, folder, content, formats=None, scan_lines=None):
    lines = named(files.scan_log_lines(spark, write(folder, content)))
    ids = {name: i for i, name in enumerate(content)}
    lines = lines.join(spark.createDataFrame(list(ids.items()), "name STRING, source_id INT"), "name")
    lines = stored(files.line_positions(lines).withColumn("text", F.col("bytes").cast("string")))
    inferred = assemble.infer_source_format(lines, scan_lines)
    if formats:
        inferred = inferred.withColumn("format", F.coalesce(*[F.when(F.col("source_id") == ids[k], v) for k, v in formats.items()], F.col("format")))
    keyed = assemble.keyed_lines(lines.withColumn("text_bytes", F.octet_length("text")), inferred)
    numbered = assemble.item_seq(keyed, keep_block=True)
    rows = assemble.items_of_parts(assemble.item_parts(numbered)).join(assemble.bodies(numbered), ["source_id", "seq"]).orderBy("source_id", "seq").collect()
    return {name: [r for r in rows if r["source_id"] == i] for name, i in ids.items()}


def test_assembled_files(spark, tmp_path):
    dated = lambda i: b"2026/07/28 15:12:2%d.123 m%d\n" % (i, i)
    content = {
        "continuation": dated(1) + b"  one\n  two\n" + dated(2),
        "leading": b"u1\nu2\n" + dated(1),
        "open": dated(1) + b"tail\r",
        "crlf": dated(1).replace(b"\n", b"\r\n") + b"next\r\n",
        "dt004": b"2026/07/28 15:12:23:45 a\n2026/07/28 15:12:24:00 b\n",
        "dt004_named": b"2026/07/28 15:12:23:45 a\nmore\n2026/07/28 15:12:24:00 b\n",
        "late99": b"u\n" * 99 + dated(1) + b"c\n",
        "late100": b"u\n" * 100 + dated(1) + b"c\n",
        "wrong": dated(1) + b"x\n" + dated(2),
    }
    got = items_of(spark, tmp_path, content, {"dt004_named": "LOG-DT-004", "wrong": "LOG-DT-002"}, scan_lines=100)
    assert [(r["raw_text"].count("\n"), r["continuation_count"]) for r in got["continuation"]] == [(2, 2), (0, 0)]
    assert [r["key_ms"] is None for r in got["leading"]] == [True, True, False]
    assert [(r["raw_text"], r["confirmed"]) for r in got["open"]] == [("2026/07/28 15:12:21.123 m1\ntail\r", False)]
    assert [r["raw_text"] for r in got["crlf"]] == ["2026/07/28 15:12:21.123 m1\nnext"]
    assert got["crlf"][0]["raw_len"] == len(content["crlf"]) - 2
    assert [r["key_ms"] for r in got["dt004"]] == [None, None]
    assert [r["continuation_count"] for r in got["dt004_named"]] == [1, 0]
    assert (len(got["late99"]), got["late99"][-1]["continuation_count"]) == (100, 1)
    assert (len(got["late100"]), {r["key_ms"] for r in got["late100"]}) == (102, {None})
    assert [(r["key_ms"], r["continuation_count"]) for r in got["wrong"]] == [(None, 0)] * 3
    # By default all lines are looked at.
    late = items_of(spark, tmp_path, {"late100": content["late100"]})["late100"]
    assert (len(late), [r["continuation_count"] for r in late][-1], late[-1]["key_ms"] is None) == (101, 1, False)
