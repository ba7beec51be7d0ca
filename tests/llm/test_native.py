"""URL filter, components, line dedup and decontamination on small tables."""

import random
from itertools import combinations

import pytest
from check import differences

from timberline.llm.components import components
from timberline.llm.decontaminate import OP8_SQL, contaminated, family, left_out
from timberline.llm.line_dedup import drop_repeated_lines
from timberline.llm.url_filter import OP2_SQL, canonical_form, judge_urls, resolved, rule_table
from pyspark.sql import functions as F


def test_components_against_union_find(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1400)]
    edges += [(k, k + 1) for k in range(2000, 2060)] + [(5, 5), (None, 3), (7, None)] + edges_of_repeat()
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, root(x)) for x in parent)
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def edges_of_repeat():
    return [(8000, 8001)] * 5 + [(8001, 8000)] * 3


def lines_by_hand(rows, min_chars=20, min_docs=3):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and i != max((h for h in holders[key(x)] if h is not None), default=None) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=repr)


def test_line_dedup_against_brute_force(spark, frame):
    rnd = random.Random(7)
    pool = [("Ähnliche Zeile Nummer %d " % k) * 2 for k in range(6)] + ["short", "", "\t \r", "  UPPER case LINE of enough length  ", "upper CASE line of enough length"]
    rows = [(k, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 8)))) for k in range(40)]
    rows += [(50, None), (51, ""), (52, "\n"), (3, "again\n" + pool[0]), (53, "\n".join([pool[1]] * 3000)), (None, pool[0]), (None, pool[0] + "\n" + pool[2])]
    rows += [rows[0], rows[0]]
    got = drop_repeated_lines(frame(rows, "doc_id bigint, text string"))
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=repr) == lines_by_hand(rows)
    assert drop_repeated_lines(frame([], "doc_id bigint, text string")).count() == 0


def test_urls(spark, frame):
    page = '<link rel="canonical" href="https://bad.example.org/es/x">'
    rows = [
        (1, "http://a.example.org/es/x", None),
        (2, "https://fine.net/p?utm_source=feed", page),
        (3, "https://other.net/q", '<meta http-equiv="refresh" content="0; url=https://fine.net/p">'),
        (4, "https://a.example.ORG/en/12", ""),
        (5, "ftp://org/fr/", None),
        (6, "http://x.com/fr/", '<link href=/de/y rel=canonical>'),
        (7, "http://x.com/de/y", None),
        (8, None, page),
        (9, "no scheme/org/", None),
        (10, "://", None),
        (1, "http://a.example.org/es/x", None),
        (11, "http://neworg/es/", None),
        (12, "https://mixed.net/", '<link rel=canonical href="https://y.com/fr/1">'),
        (13, "https://mixed.net", '<link rel=canonical href="https://y.com/de/1">'),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(frame(rows, "page_id bigint, url string, html string"), rule_table(spark)).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2] == ("fine.net", "/p", None, "block") and got[3][3] == "block"
    assert got[4] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[5] == ("org", "/fr/", "org/", "allow")
    assert got[6] == ("x.com", "/fr/", "com/fr/", "allow") and got[7][2:] == ("com/de/", "block")
    assert got[8] == ("", "", None, "allow") and got[9] == ("", "", None, "allow") and got[10] == ("", "", None, "allow")
    assert got[11] == ("neworg", "/es/", None, "allow")
    assert got[12][3] == got[13][3] == "allow"  # an allow among the aliases comes before a block
    assert judge_urls(frame([], "page_id bigint, url string, html string"), rule_table(spark)).count() == 0


LINKS = {
    "//y.com/de/1": "https://y.com/de/1", "/de/1?a=1&amp;b=2": "https://x.net/de/1?a=1&b=2", "p2.html": "https://x.net/a/b/p2.html", "../p": "https://x.net/a/p",
    "../../../q/": "https://x.net/q/", "./": "https://x.net/a/b/", "..": "https://x.net/a/", "?x=1": "https://x.net/a/b/c?x=1", "#top": None, "mailto:a@b.c": None,
    "http://z.org/k;v=1": "http://z.org/k;v=1", "c/./d/../e?f=../g": "https://x.net/a/b/c/e?f=../g",
}


def test_links_of_every_form(spark, con):
    rows = [(t, "https://x.net/a/b/c?q#f") for t in LINKS]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "t string, u string").select("t", resolved(F.regexp_replace("t", "&amp;", "&"), F.col("u"))).collect()}
    assert got == LINKS
    # Two tags of a kind, and a verdict that rests on each form: the page is blocked as its alias is.
    tags = lambda t: (f'<link rel="canonical" href="https://other.test/{t[:1]}"><link rel=canonical href="{t}">', f'<meta http-equiv=refresh content="9; url=https://o.test/"><META http-equiv="refresh" content="0;URL={t}">')
    forms = {"//y.com/de/1": "https", "/de/1": "http", "1": "http", "../de/2": "http", "?v=1&amp;w=2": "http"}
    pages, want = [], {}
    for k, (form, scheme) in enumerate(forms.items()):
        for n, html in enumerate(tags(form)):
            page = 10 * k + n
            at = f"{scheme}://s{page}.com" + ("/de/x" if form in ("1", "?v=1&amp;w=2") else "/fine/x")
            at = at.replace(".com", ".com" if form != "//y.com/de/1" else ".net")
            pages.append((page, at, html))
            want[page] = "block"
    pages.append((900, "https://calm.net/", '<link rel=canonical href="mailto:x@y.com/de/">'))
    want[900] = "allow"
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    judged = judge_urls(df, rule_table(spark))
    assert {r.page_id: r.verdict for r in judged.collect()} == want
    con.execute("CREATE OR REPLACE TEMP TABLE given_pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    more = pages + [(1000 + k, f"https://x{k}.net/a/b/c?q", f'<link rel="canonical" href="{t}">') for k, t in enumerate(LINKS)] + [(2000, None, None), (2001, "no scheme", '<link rel=canonical href="/x">')]
    con.executemany("INSERT INTO given_pages VALUES (?, ?, ?)", more)
    both = judge_urls(spark.createDataFrame(more, "page_id bigint, url string, html string"), rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")
    assert differences(both, con, OP2_SQL.replace("FROM pages", "FROM given_pages")) == []


def test_canonical_form(spark):
    rows = [("http://www.A.net/x/?utm_a=1&page=2&ref=x#top",), ("https://m.a.net/x?gclid=1",), ("nothing",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "u string").select(canonical_form(F.col("u"))).collect()]
    assert got == ["https://a.net/x?page=2", "https://a.net/x", None, None]


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_decontamination(spark, frame, limit):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (30, 12, 60, 5, 0)]
    other = lambda n: [word() for _ in range(n)]
    swapped = [w if k % 7 else "zzz" for k, w in enumerate(items[0])]
    rows = [
        (1, " ".join(other(50) + items[0] + other(20))),
        (2, " ".join(other(9) + swapped + other(9)).upper()),
        (3, " ".join(other(200))),
        (4, ", ".join(other(5) + items[2][10:35] + other(5))),
        (5, None),
        (6, ""),
        (7, " ".join(items[1])),
        (8, " ".join(items[0][:9] + other(40))),
        (9, " ".join((other(3) + items[1]) * 400)),
        (1, " ".join(other(10) + items[1])),
        (None, " ".join(items[1])),
    ]
    bench = [(k, " ".join(x)) for k, x in enumerate(items)] + [(9, None), (1, " ".join(items[1]))]
    found = contaminated(frame(rows, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string"), limit_bytes=limit).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 0), (2, 0), (4, 2), (7, 1), (9, 1), (1, 1), (None, 1)}
    assert {r.overlap for r in found if r.doc_id in (7, 4)} == {1.0}
    assert contaminated(frame([], "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")).count() == 0


def overlaps_by_hand(rows, bench, similarity=0.75, window=20):
    """Every alignment of every window, without seeds."""
    split = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    best = {}
    for i, text in rows:
        d = split(text)
        for k, item in bench:
            w = split(item)
            wide = min(window, len(w))
            for shift in range(-len(w), len(d)) if wide else ():
                equal = [0 <= shift + n < len(d) and d[shift + n] == x for n, x in enumerate(w)]
                most = max(sum(equal[b : b + wide]) for b in range(len(w) - wide + 1))
                if most >= similarity * wide:
                    best[i, k] = max(best.get((i, k), 0), most)
    return best


def substituted(rnd, words, n):
    gone = set(rnd.sample(range(len(words)), n))
    return [f"swap{k}" if k in gone else w for k, w in enumerate(words)]


def test_passages_at_any_place_of_an_item(spark, frame):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (40, 150)]
    rows = []
    for k in range(60):
        at = rnd.randrange(len(items[k % 2]) - 20)
        passage = items[k % 2][at : at + 20]
        gone = {2, 7, 12, 17} if k % 3 else {1, 5, 16}  # the middle keeps its seeds
        rows.append((k, " ".join([word() for _ in range(rnd.randrange(30))] + [w if n not in gone else "other" for n, w in enumerate(passage)] + [word() for _ in range(9)])))
    rows.append((70, " ".join([word() for _ in range(1010)] + items[1] + [word() for _ in range(2000)])))
    bench = [(k, " ".join(x)) for k, x in enumerate(items)]
    got = contaminated(frame(rows, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string"))
    want = overlaps_by_hand(rows, bench)
    assert len(want) == 61 and {(r.doc_id, r.item_id): r.matched for r in got.collect()} == want


def test_no_pattern_of_substitutions_is_missed(spark, frame):
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    other = lambda n: [word() for _ in range(n)]
    items = [other(n) for n in (200, 20, 19, 18, 17, 16, 15, 14, 13, 12, 11, 10, 9, 8, 7, 6, 5)]
    rows = [(k, " ".join(other(5) + [w if n % 4 != k else "every" for n, w in enumerate(items[0])] + other(5))) for k in range(4)]
    for n, item in enumerate(items):
        for _ in range(25):
            begin = rnd.randrange(len(item) - 19) if len(item) > 20 else 0
            passage = item[begin : begin + 20]
            rows.append((len(rows), " ".join(other(rnd.randrange(4)) + substituted(rnd, passage, len(passage) - -(-3 * len(passage) // 4)) + other(3))))
        rows.append((len(rows), " ".join(substituted(rnd, item[:20], 1 + min(len(item), 20) // 4))))
    bench = [(k, " ".join(x)) for k, x in enumerate(items)]
    got = contaminated(frame(rows, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string"))
    want = overlaps_by_hand(rows, bench)
    assert len(want) >= 4 + 25 * len(items) and {(r.doc_id, r.item_id): r.matched for r in got.collect()} == want


def test_items_of_few_tokens(spark, frame):
    clauses = ["今天天气很好我们一起去公园散步吧", "他说明天还要再来"]
    bench = [(0, "。".join(clauses)), (1, "yes"), (2, "New York"), (3, clauses[0] + "了")]
    rows = [(0, "然后。" + "，".join(clauses) + "。"), (1, "yes, New York"), (2, clauses[1]), (3, clauses[0] + "了")]
    docs, bench = frame(rows, "doc_id bigint, text string"), spark.createDataFrame([*bench, (4, "?!")], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench, few_letters=16).collect()} == {(0, 0), (3, 3)}
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == {(0, 0), (3, 3), (1, 1), (1, 2)}
    assert {tuple(r) for r in left_out(bench, 16).collect()} == {(1, "too short"), (2, "too short"), (4, "no tokens")}
    assert {tuple(r) for r in left_out(bench, 0).collect()} == {(4, "no tokens")}


def test_masks_fit_beside_every_choice_of_substitutions():
    shapes = [(n, n - (n if n < 5 else -(-3 * n // 4))) for n in range(1, 21)] + [(12, 5), (16, 8), (24, 4), (10, 0), (7, 6)]
    for wide, errors in shapes:
        masks, least = family(wide, errors)
        assert least >= 1 and (wide < 4 or errors * 2 > wide or any("0" in m for m in masks) or (wide, errors) == (24, 4))
        fewest = wide * wide
        for gone in combinations(range(wide), errors):
            hits = sum(not any(m[k - at] == "1" for k in gone if at <= k < at + len(m)) for m in masks for at in range(wide - len(m) + 1))
            fewest = min(fewest, hits)
        assert fewest == least
    assert family(50, 12) == (("111",), 1)


def test_sql_and_operator_state_the_same_rule(spark, con):
    rnd = random.Random(21)
    other = lambda n: ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    items = [other(n) for n in (40, 25, 20, 17, 9, 6, 3)]
    rows = []
    for k in range(120):
        item = items[k % len(items)]
        at = rnd.randrange(max(len(item) - 19, 1))
        part = item[at : at + 20]
        rows.append((k, " ".join(other(rnd.randrange(5)) + substituted(rnd, part, min(rnd.choice([len(part) // 4] * 3 + [len(part) // 4 + 1]), len(part))) + other(3))))
    bench = [(k, " ".join(x)) for k, x in enumerate(items)]
    got = contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string"))
    for name, some in (("d", rows), ("b", bench)):
        con.execute(f"CREATE OR REPLACE TEMP TABLE given_{name} ({'doc_id' if name == 'd' else 'item_id'} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO given_{name} VALUES (?, ?)", some)
    assert differences(got, con, OP8_SQL.replace("FROM documents", "FROM given_d").replace("FROM benchmark", "FROM given_b")) == []
    assert got.count() > 80
