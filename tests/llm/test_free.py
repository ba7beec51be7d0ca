"""Chat formatting, packing, quality models, language model, near-duplicates and WARC on small tables."""

import gzip
import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from timberline.llm import backoff_lm, chat_format, minhash, packing, warc
from timberline.llm.quality_rules import FALLING, judge_quality, train
from timberline.llm.rule_ensemble import classify, fit_rules, rate_columns, train_ensemble
from timberline.llm.textstats import COUNTS, RATES, rates, text_counts, with_counts
from timberline.llm.trees import boost
from timberline.session import fresh_path


# ---- chat ------------------------------------------------------------------------------------------------------


def test_escape_is_reversible():
    rnd = random.Random(1)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|end|>", "␛", "␛1", "␛0", "\n", "<", "a", "|>", "é"]
    for _ in range(2000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(8)))
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert not any(c in chat_format.escape(text) for c in chat_format.CONTROLS)
        assert chat_format.parse_turn(chat_format.turn_template([(text, text)])) == (text, text)


def test_template_that_rewrites_history():
    def last_only(turns):  # texts of all but the last turn are cut
        return "".join(f"<{r}>{t if k == len(turns) - 1 else t[:1]};" for k, (r, t) in enumerate(turns))

    assert chat_format.locate(last_only, [("u", "hello")], ("a", "yes"))[3]
    piece, begin, end, rewrites = chat_format.locate(chat_format.turn_template, [("u", "x")], ("assistant", "a<s>b"))
    assert not rewrites and chat_format.unescape(piece[begin:end]) == "a<s>b"


def test_conversations(spark, frame):
    rows = [(1, k, "assistant" if k % 2 else "user", f"text {k} </s>") for k in range(300)]
    rows += [(2, 0, None, None), (2, None, "user", "first"), (3, 5, "assistant", ""), (3, 5, "assistant", "aa"), (3, 5, "assistant", "aa"), (None, 1, "user\nx", "y" * 200_000)]
    table = frame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat_format.chat_digests(chat_format.format_chats(table)).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted([(-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv])
        whole = chat_format.turn_template([(r, x) for _, r, x in mine])
        loss = "".join(x for _, r, x in mine if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(mine) and r.loss_chars == len(loss) and r.formatted_chars == len(whole)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.format_chats(frame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_templates_that_look_back_over_many_turns(spark, frame):
    def system(turns):  # the first turn decides how all are marked
        return "".join(f"{turns[0][1][:3]}<{r}>{t};" for r, t in turns)

    def numbered(turns):
        return "".join(f"{k}<{r}>{t};" for k, (r, t) in enumerate(turns))

    def strict(turns):
        if any(r != ("user", "assistant")[k % 2] for k, (r, _) in enumerate(turns)):
            raise ValueError("roles alternate")
        return "".join(f"<{r}>{t};" for r, t in turns)

    def forgets(turns):  # what is a hundred turns back is cut
        return "".join(f"<{r}>{t if k + 100 > len(turns) else '-'};" for k, (r, t) in enumerate(turns))

    talk = [(("user", "assistant")[k % 2], f"text {k}") for k in range(131)]
    rows = [(c, k, *x) for c, n in ((1, 65), (2, 131), (3, 3)) for k, x in enumerate(talk[:n])]
    table = frame(rows, "conv_id bigint, turn bigint, role string, text string")
    for template in (system, numbered, strict, forgets):
        got = {(r.conv_id, r.turn): (r.piece, r.text_begin, r.text_end, r.rewrites) for r in chat_format.format_chats(table, template).collect()}
        assert got == {(c, k): chat_format.locate(template, talk[:k], talk[k]) for c, k, *_ in rows}
        assert any(x[3] for x in got.values()) == (template is forgets)

    def empties(turns):
        return chat_format.turn_template([(r, t if k + 100 > len(turns) else "") for k, (r, t) in enumerate(turns)])

    with pytest.raises(Exception, match="rewrites history"):
        chat_format.chat_digests(chat_format.format_chats(table, empties)).collect()


# ---- packing ---------------------------------------------------------------------------------------------------


def test_word_cache_gives_the_ids_of_whole_texts(tokenizer):
    rnd = random.Random(2)
    letters = [" ", " ", "\n", "\t", "\x1c", "　", "a", "Bc", "'s", "é", "1", ",", "...", "<|endoftext|>", "\r", "!", "?!"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(25))) for _ in range(4000)]
    texts += ["plain words, and more.\nSecond line: it's 42!", "", " ", "\n", "a\n\nb", "x" * 5000]
    cache = packing.WordCache(tokenizer, most=300)
    for _ in range(2):
        for k in range(0, len(texts), 100):
            want = cache.encoder.encode_batch(texts[k : k + 100], add_special_tokens=False)
            assert cache.ids(texts[k : k + 100]) == [np.asarray(w.ids, "<u4").tobytes() for w in want]


def test_fullest_against_all_combinations():
    rnd = random.Random(5)
    for _ in range(200):
        counts = Counter(rnd.randrange(1, 21) for _ in range(rnd.randrange(1, 9)))
        lengths = np.array(sorted(counts, reverse=True))
        taken = packing.fullest(lengths, np.array([counts[int(x)] for x in lengths]), 20)
        rest = list((counts - Counter([max(counts)])).elements())
        sums = {0}
        for x in rest:
            sums |= {s + x for s in sums}
        best = max(s for s in sums if s + max(counts) <= 20) + max(counts)
        assert sum(k * v for k, v in taken.items()) == best and all(counts[k] >= v for k, v in taken.items()) and max(counts) in taken


def test_packing(spark, frame, tokenizer):
    rnd = random.Random(6)
    rows = [(k, " ".join(rnd.choice(["alpha", "beta,", "gamma\n", "é"]) for _ in range(rnd.randrange(0, 60)))) for k in range(80)]
    rows += [(100, None), (101, ""), (102, "word " * 500), (None, "null id"), rows[3], rows[3]]
    got = packing.pack(frame(rows, "doc_id bigint, text string").repartition(5), tokenizer, capacity=64, with_ids=True).collect()
    encoder = packing.WordCache(tokenizer).encoder
    want = Counter()
    for i, text in rows:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 64 or min(64, len(ids))
        for k, a in enumerate([0, *range(first, len(ids), 64)]):
            b = first if k == 0 else a + 64
            want[i, k, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert -(-total // 64) <= len(bins) <= -(-total // 64) + 1
    assert packing.pack(frame([], "doc_id bigint, text string"), tokenizer).count() == 0


# ---- statistics and models -------------------------------------------------------------------------------------


def counts_by_hand(text):
    text = text or ""
    words = text.encode().split()
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    inside = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(line.strip(" \t\n\x0b\x0c\r"))
        seen.add(line)
    return (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside))


def made_texts(n=120, seed=8):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        words = [rnd.choice(["the", "of", "Ärger", "x|y", "and", "　", "a\x1cb", "#", "run"]) for _ in range(rnd.randrange(0, 90))]
        text = "".join(w + rnd.choice([" ", " ", "\n", "\t", "  "]) for w in words)
        out.append((k, text.upper() if k % 3 == 0 else text))
    return out + [(n, None), (n + 1, ""), (n + 2, "again " * 3000), (n + 3, "same line\n" * 50), (None, "null id here"), (5, "second row of five")]


def test_counts_against_brute_force(spark, frame):
    rows = made_texts()
    want = Counter((i, *counts_by_hand(t)) for i, t in rows)
    got = with_counts(frame(rows, "doc_id bigint, text string")).select("doc_id", *COUNTS[:5]).collect()
    assert Counter(map(tuple, got)) == want
    assert text_counts([]).shape == (0, len(COUNTS))


def test_trees_are_monotonic_and_flat_arrays_agree():
    rng = np.random.default_rng(3)
    x = rng.random((800, 3))
    y = ((x[:, 0] + rng.normal(0, 0.15, 800) > 0.5) ^ (x[:, 1] > 0.9)).astype(float)
    forest = boost(x, y, direction=np.array([1, 0, -1]))
    base = rng.random((200, 3))
    for j, sign in ((0, 1), (2, -1)):
        steps = []
        for v in np.linspace(-0.2, 1.2, 30):
            moved = base.copy()
            moved[:, j] = v
            steps.append(forest.margin(moved))
        assert (sign * np.diff(np.array(steps), axis=0) >= -1e-12).all()

    def walk(row):
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.right[node] if row[forest.feature[node]] > forest.at[node] else forest.left[node]
            total += forest.value[node]
        return total

    assert np.allclose(forest.margin(base), [walk(r) for r in base])
    assert len(set(boost(np.zeros((0, 3)), np.zeros(0)).score(base))) == 1
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.75


@pytest.fixture(scope="module")
def labelled_dir(sf_dir):
    """Models need some hundred labels to be judged by."""
    return os.path.join(os.path.dirname(sf_dir), "sf0.01")


def test_quality_rules(spark, frame, labelled_dir):
    sf_dir = labelled_dir
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    forest = train(docs, labels)
    rows = made_texts()
    got = judge_quality(frame(rows, "doc_id bigint, text string"), forest, keep_columns=True).collect()
    assert len(got) == len(rows)
    for r in got:
        n, chars, symbols, dup, repeat = counts_by_hand(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert r.kept == (not r.base_failed and r.score >= 0.3)
    marked = judge_quality(docs, forest).join(labels, "doc_id").collect()
    assert sum(r.kept for r in marked if r.quality) >= 0.9 * sum(r.quality for r in marked)
    assert sum(r.kept for r in marked if not r.quality) <= 0.1 * sum(1 - r.quality for r in marked)
    assert judge_quality(frame([], "doc_id bigint, text string"), forest).count() == 0
    untrained = train(docs, labels.limit(0))
    assert {r.score for r in judge_quality(docs, untrained).select("score").distinct().collect()} == {0.5}
    assert set(FALLING) <= set(RATES)


def test_rule_ensemble(spark, frame, labelled_dir):
    sf_dir = labelled_dir
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_ensemble(docs, labels)
    assert 0 < len(model.rules) < 60
    marked = classify(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in marked) >= 0.9 * len(marked)
    rows = made_texts()
    got = sorted(classify(frame(rows, "doc_id bigint, text string"), model).collect(), key=repr)
    for i, text in rows:
        want = float(model.score(rates(text_counts([text or ""])))[0])
        assert any(r.doc_id == i and abs(r.score - want) < 1e-9 and r.predicted == (want >= 0.3) for r in got)
        assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for r in got if r.doc_id == i)
    assert len(got) == len(rows) and list(rate_columns()) == list(RATES)
    assert fit_rules(np.zeros((0, 11)), np.zeros(0)).rules == []


# ---- language model --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_chars,shards", [(200, 3), (10_000_000, None)])
def test_language_model_against_brute_force(spark, frame, block_chars, shards):
    rows = made_texts(60)
    texts = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in texts]
    words, pairs = Counter(), Counter()
    for (_, w), held in zip(texts, out):
        if not held:
            words.update(w)
            pairs.update(zip([b"\n", *w], w))
    n, v, prior = sum(words.values()), len(words), backoff_lm.PRIOR
    p = lambda w: (words[w] + 0.5) / (n + 0.5 * (v + 1))
    want = []
    for (i, w), held in zip(texts, out):
        score = sum(math.log10((pairs[u, x] + prior * p(x)) / (words[u] + prior)) for u, x in zip([b"\n", *w], w))
        want.append((i, held, len(w), sum(words[x] > 0 for x in w), n, round(sum(math.log10(p(x)) for x in w), 6), round(score, 6)))
    got = backoff_lm.score_texts(frame(rows, "doc_id bigint, text string"), block_chars=block_chars, shards=shards).collect()
    assert sorted([(*r[:5], round(r[5], 6), round(r[6], 6)) for r in got], key=repr) == sorted(want, key=repr)


def test_language_model_of_nothing(spark, frame):
    assert backoff_lm.score_texts(frame([], "doc_id bigint, text string")).count() == 0
    only_held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    row = backoff_lm.score_texts(frame([(only_held, "a b")], "doc_id bigint, text string")).first()
    assert row.train_tokens == 0 and row.n_known == 0 and abs(row.base_score) < 1e-9


def test_packed_keys():
    rng = np.random.default_rng(1)
    for n in (1, 2, 500):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        assert (backoff_lm._unpacked(backoff_lm._packed(keys)) == keys).all()
        near = np.uint64(2**63) + np.arange(n, dtype=np.uint64)
        assert (backoff_lm._unpacked(backoff_lm._packed(near)) == near).all()


# ---- near-duplicates -------------------------------------------------------------------------------------------


def groups_by_hand(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_duplicates_against_brute_force(spark, frame, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(120)]

    def variant(words, edits):
        words = list(words)
        for _ in range(edits):
            words[rnd.randrange(len(words))] = word()
        return " ".join(words)

    rows = [(k, variant(base, rnd.randrange(0, 7))) for k in range(0, 140)]
    common = [word() for _ in range(60)]
    rows += [(200 + k, " ".join(common + [word() for _ in range(60)])) for k in range(60)]
    rows += [(300 + k, " ".join(base)) for k in range(30)] + [(400, None), (401, ""), (402, "a b c"), (403, "A  b\nC"), (404, "a b"), (405, " \t")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(rows, "doc_id bigint, text string")).collect()}
    assert got == groups_by_hand(rows)


def test_near_duplicates_of_odd_rows(spark, frame):
    rows = [(7, "one two three four five six"), (7, "one two three four five six"), (3, "one two three four five six"), (None, "one two three four five six"), (None, "alone here"), (9, "x " * 40_000)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(frame(rows, "doc_id bigint, text string")).collect()), key=repr)
    assert got == sorted([(7, 3, False), (7, 3, False), (3, 3, True), (None, 3, False), (None, None, True), (9, 9, True)], key=repr)
    assert minhash.near_duplicates(frame([], "doc_id bigint, text string")).count() == 0


def test_near_duplicates_of_one_id_with_two_texts(spark, frame):
    rnd = random.Random(15)
    text = lambda: ["".join(rnd.choice("abcdefghij") for _ in range(4)) for _ in range(80)]
    rows, want = [], {}
    for k in range(20):
        one, two = text(), text()
        a, b, c = 10 * k + 5, 10 * k + 3, 10 * k + 8  # the near copies have a smaller and a larger id
        rows += [(a, " ".join(one)), (a, " ".join(two)), (b, " ".join([*one[:-1], "end"])), (c, " ".join(["begin", *two[1:]]))]
        want |= {x: (b, x == b) for x in (a, b, c)}
    got = minhash.near_duplicates(frame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.component_id, r.kept) for r in got} == want


def test_super_minhash_estimates():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        u = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = np.unique(u[:260]), np.unique(u[40:])
        s = minhash.super_minhash([a, b])
        errors.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.045
    assert sorted(minhash.super_minhash([np.array([5], np.uint64)])[0].astype(int)) == list(range(minhash.WIDTH))


# ---- WARC ------------------------------------------------------------------------------------------------------


def records(*payloads):
    return [warc.record_bytes(k, f"http://x/{k}", p, hashlib.sha1(p).hexdigest(), None) for k, p in enumerate(payloads)]


def read_ids(data):
    found = list(warc.salvage(data))
    edges = [(b, e) for b, e, f, _ in found]
    return [f["warc-record-id"] for _, _, f, _ in found if f], [(b, e) for b, e, f, _ in found if not f], edges


def test_salvage():
    members = records(b"one", b"two" * 5000, b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", b"")
    whole = b"".join(members)
    name = lambda *ks: [f"<urn:page:{k}>" for k in ks]
    assert read_ids(whole)[:2] == (name(0, 1, 2, 3), [])
    broken = bytearray(whole)
    broken[len(members[0]) + 30] ^= 0xFF  # a flipped byte inside the second member
    ids, gaps, edges = read_ids(bytes(broken))
    assert ids == name(0, 2, 3) and gaps == [(len(members[0]), len(members[0]) + len(members[1]))]
    assert edges[0][0] == 0 and edges[-1][1] == len(whole) and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))
    assert read_ids(b"junk" + whole + b"tail")[1] == [(0, 4), (4 + len(whole), 8 + len(whole))]
    # A record that is there to its end and has its digest is saved, though its member lacks the check sum.
    assert read_ids(whole[:-5])[0] == name(0, 1, 2, 3) and read_ids(whole[: -len(members[3]) // 2])[0] == name(0, 1, 2)
    plain = b"".join(gzip.decompress(m) for m in members)
    assert read_ids(plain)[:2] == (name(0, 1, 2, 3), [])
    hurt = plain.replace(b"Content-Length: 15000", b"Content-Length: 99999")
    assert read_ids(hurt)[0] == name(0, 2, 3) and len(read_ids(hurt)[1]) == 1
    assert read_ids(b"") == ([], [], []) and read_ids(b"\x1f\x8b\x08" * 50)[0] == []


def test_warc_round_trip(spark, frame):
    odd = "é\r\n\r\nWARC/1.1\r\n\x1f\x8b\x08 payload"
    rows = [(1, "http://a/ b%20", odd), (2, None, None), (3, "u", ""), (9, "u", odd), (9, "u", odd), (None, "n", odd), (4, "big", "x" * 300_000), (5, "u\r\nX: y", "same"), (6, "u", "same")]
    path = fresh_path(spark, "warc-test")
    warc.write_warc(frame(rows, "page_id bigint, url string, html string"), path, files=2)
    got = sorted((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.url, bytes(r.block)) for r in warc.read_warc(spark, path).collect())
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r)
    text = odd.encode()
    assert [r[1:] for r in by["<urn:page:1>"]] == [("revisit", "<urn:page:9>", len(text), "http://a/ b%20", b"")]
    assert [(r[1], r[5]) for r in by["<urn:page:9>"]] == [("response", text)] * 2
    assert by["<urn:page:None>"][0][1:3] == ("response", None)
    assert by["<urn:page:2>"][0][1:3] == ("revisit", "<urn:page:3>") and by["<urn:page:3>"][0][3] == 0
    assert by["<urn:page:5>"][0][1:5] == ("revisit", "<urn:page:6>", 4, "u\r\nX: y")
    assert by["<urn:page:4>"][0][3] == 300_000 and len(got) == len(rows)
    big = fresh_path(spark, "warc-test")
    warc.write_warc(frame(rows, "page_id bigint, url string, html string"), big, min_bytes=5)
    assert {r.record_id for r in warc.read_warc(spark, big).filter("record_type = 'revisit'").collect()} == {"<urn:page:1>"}


def test_tasks_of_a_worker_share_their_words(tokenizer):
    first = packing.word_cache(tokenizer)
    first.ids(["some words here"])
    assert packing.word_cache(tokenizer) is first and {"words", "here"} <= set(first.new[1])


def test_words_of_letters_need_no_whole_encoding(tokenizer, monkeypatch):
    texts = ["Plain Wörter, слово слова\nline two! ªº x²; it's ###", "čeština ends.\nÀ ß,, a"]
    cache = packing.WordCache(tokenizer)
    want = [np.asarray(w.ids, "<u4").tobytes() for w in cache.encoder.encode_batch(texts, add_special_tokens=False)]
    assert cache.ids(texts) == want
    cache = packing.WordCache(tokenizer)
    monkeypatch.setattr(cache, "_encode", lambda text: pytest.fail(text))
    assert cache.ids(["words of letters\nalone слово"]) == [np.asarray(cache.encoder.encode("words of letters\nalone слово").ids, "<u4").tobytes()]


def test_words_kept_beside_later_stages_are_bounded(tokenizer):
    """What a Python worker keeps when a packing task ends stays in memory beside the stages that follow."""
    cache = packing.WordCache(tokenizer)
    for k in range(0, 400_000, 40_000):
        cache.ids([" ".join(f"w{n}" for n in range(k, k + 40_000))])
    assert sum(len(x) for x in (*cache.new, *cache.old)) <= 2 * (100_000 + 40_000)
