"""Runs of repeated words against a plain search of every period."""

import hashlib
import random
import zlib

import pytest

from timberline.llm.common import table
from timberline.llm.runs import find_runs, op11_runs, runs_of


def plain_runs(words, least=6, periods=4):
    n, out = len(words), []
    for q in range(1, n // periods + 1):
        k = 0
        while k + q < n:
            if words[k] != words[k + q]:
                k += 1
                continue
            end = k
            while end + q < n and words[end] == words[end + q]:
                end += 1
            size = end + q - k
            shorter = any(all(words[j] == words[j + d] for j in range(k, end + q - d)) for d in range(1, q))
            if size >= max(least, periods * q) and not shorter:
                out.append((k, size, q))
            k = end
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, planted=True):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def random_words(rng):
    letters = rng.choice([1, 2, 2, 3, 5])
    words = [b"%d" % rng.randrange(letters) for _ in range(rng.randint(0, 60))]
    if words and rng.random() < 0.6:
        part = [b"%d" % rng.randrange(letters) for _ in range(rng.randint(1, 9))]
        at = rng.randrange(len(words))
        words[at:at] = part * rng.randint(2, 8) + part[: rng.randrange(len(part))]
        if rng.random() < 0.4:
            words = words * rng.randint(2, 6)
    return words


@pytest.mark.parametrize("seed", range(4))
def test_against_every_period(seed):
    rng = random.Random(seed)
    for _ in range(150):
        batch = [random_words(rng) for _ in range(rng.randint(1, 5))]
        assert runs_of(batch) == [plain_runs(w) for w in batch]
    for least, periods in ((6, 3), (8, 4), (9, 2)):
        some = [random_words(rng) for _ in range(20)]
        assert runs_of(some, least, periods) == [plain_runs(w, least, periods) for w in some]


def test_long_texts_stay_quick():
    rng = random.Random(9)
    short, long = b"a", b"ab"
    while len(long) < 20_000:
        short, long = long, long + short
    fibonacci = [bytes([c]) for c in long]
    bits = [b"%d" % rng.randrange(2) for _ in range(20_000)]
    found = runs_of([[b"x"] * 20_000, bits, fibonacci, [b"%d" % (k % 500) for k in range(20_000)]])
    assert found[0] == [(0, 20_000, 1)] and found[3] == [(0, 20_000, 500)]
    assert found[1] == [r for r in found[1] if r[1] >= max(6, 4 * r[2])] and len(found[1]) > 300 and found[2] == []


def test_rows(spark, frame):
    line = "one two three four five. "
    rows = [(1, line * 5), (1, line * 5), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r"), (None, "na " * 9), (5, "é ü " * 8 + "end"), (6, "a b c"), (7, "x " * 7 + "y " * 8), (29, "w " * 40), ((1 << 53) + 1, "x " * 7)]
    rows += [(k, " ".join(str(j % 50) for j in range(k))) for k in range(90, 140)]
    df = frame(rows, "doc_id bigint, text string")
    got = find_runs(df, planted=True, with_text=False).collect()
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted([plain_row(*r) for r in rows], key=key)
    assert find_runs(df.limit(0), planted=True).collect() == []
    told = find_runs(df.filter("doc_id = 7"), with_text=True).first()
    assert told["collapsed"] == "x y" and [tuple(r) for r in told["runs"]] == [(0, 7, 1), (7, 8, 1)]


def test_query(spark, sf_dir):
    want = sorted(plain_row(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect() if len(r["text"] or "") < 6000)
    ids = {r[0] for r in want}
    got = sorted(tuple(r) for r in op11_runs(spark, sf_dir).collect() if r["doc_id"] in ids)
    assert got == want and any(r[1] for r in want)
