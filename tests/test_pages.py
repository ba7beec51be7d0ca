"""Single-byte code pages in the JVM against the byte decoder, and plans without Python."""

import random

from pyspark.sql import functions as F

from timberline.functions import encoding as enc
from timberline.session import stored
from timberline.sources import files

SINGLE = [p for p in enc.PAGES if p not in enc.WIDE_PAGES]


def test_every_byte_of_every_page(spark):
    rng = random.Random(1)
    values = [bytes(range(256)), b"", *(bytes(rng.randrange(256) for _ in range(rng.randint(1, 30))) for _ in range(5))]
    df = stored(spark.createDataFrame([(v,) for v in values], "data BINARY"))
    for page in SINGLE:
        rows = df.select("data", enc.page_text(F.col("data"), page), enc.page_gaps(F.col("data"), page)).collect()
        assert {(bytes(r[0]), r[1], tuple(r[2])) for r in rows} == {(v, *(lambda t, b: (t, tuple(b)))(*enc._decode_one(v, enc.codec_of(page)))) for v in values}, page


def test_python_only_where_it_is_needed(spark, tmp_path):
    pages = [1252, 1250, 28591, 437, 850, 1253, 932]
    for k, page in enumerate(pages):
        (tmp_path / f"{k}.log").write_bytes(bytes(range(0x20, 0x100)) + b"\n\x81\x8d x\r\nplain\n" if page != 932 else "日本\n語".encode("cp932") + b"\x81\n")
    lines = files.scan_log_lines(spark, str(tmp_path)).withColumn("source_id", F.regexp_extract("path", r"(\d)\.log$", 1).cast("int"))
    settings = spark.createDataFrame([(k, None, p) for k, p in enumerate(pages)], "source_id INT, encoding_name STRING, ansi_codepage INT")
    decided = stored(files.detect_encoding(lines, settings, 1252))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    most = files.decode_lines(lines, decided.filter("source_id <> 6"))
    assert "Python" not in plan(most) and "decode_codepage" not in plan(most)
    every = files.decode_lines(lines, decided)
    assert "decode_codepage" in plan(every)
    for df, n in ((most, 6), (every, 7)):
        rows = df.select("source_id", "bytes", "text", "bad_at").collect()
        assert {r["source_id"] for r in rows} == set(range(n))
        for r in rows:
            assert (r["text"], r["bad_at"]) == enc._decode_one(bytes(r["bytes"]), enc.codec_of(pages[r["source_id"]]))
