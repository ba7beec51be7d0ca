"""WARC: ids of any size, records saved from damaged members."""

import gzip

import pytest

from timberline.llm.warc import op10_warc, read_warc, record_bytes, salvage, write_warc


def one_member(n):
    import hashlib

    bodies = [(f"<p>page {k}</p>" * (k % 7 + 1)).encode() for k in range(n)]
    return b"".join(gzip.decompress(record_bytes(k, f"http://x/{k}", b, hashlib.sha1(b).hexdigest(), None)) for k, b in enumerate(bodies))


def ids_of(data):
    rows = list(salvage(data))
    places = sorted({(b, e) for b, e, _, _ in rows})
    assert places[0][0] == 0 and places[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(places, places[1:]))
    return [int(f["warc-record-id"][10:-1]) for _, _, f, _ in rows if f]


@pytest.mark.parametrize("level", [1, 9])
def test_records_before_the_damage_are_saved(level):
    data = gzip.compress(one_member(200), level, mtime=0)
    assert ids_of(data) == list(range(200))
    assert ids_of(data[:-5]) == list(range(200))
    flipped = bytearray(data)
    flipped[len(data) // 2] ^= 0x55
    got = ids_of(bytes(flipped))
    assert got == sorted(got) and 40 < len(got) < 200 and got[:40] == list(range(40))
    later = gzip.compress(one_member(3), mtime=0)
    assert ids_of(bytes(flipped) + later)[-3:] == [0, 1, 2]
    cut = data[: len(data) // 3]
    assert ids_of(cut)[:20] == list(range(20)) and ids_of(cut + later)[-3:] == [0, 1, 2]


def test_ids_of_any_size(spark, tmp_path):
    big = [(1 << 53) + 1, (1 << 53) + 3, (1 << 63) - 1, -(1 << 63), 0, None]
    rows = [(i, f"u{k}", "same" if k < 4 else f"own {k}") for k, i in enumerate(big)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    write_warc(df, str(tmp_path / "w"))
    got = {r["record_id"]: (r["record_type"], r["refers_to"]) for r in read_warc(spark, str(tmp_path / "w")).collect()}
    top = f"<urn:page:{(1 << 63) - 1}>"
    assert got == {f"<urn:page:{i}>": ("revisit", top) if k in (0, 1, 3) else ("response", None) for k, i in enumerate(big)}
    df.write.parquet(str(tmp_path / "pages.parquet"))
    back = {r["page_id"]: r["refers_to"] for r in op10_warc(spark, str(tmp_path)).collect()}
    assert back == {i: (1 << 63) - 1 if k in (0, 1, 3) else None for k, i in enumerate(big)}
