"""Conversation repair against plain searches: all edit sequences, and whole strings per state."""

import hashlib
import itertools
import random
from collections import defaultdict

import pytest
from check import differences

from timberline.llm.common import table
from timberline.llm.repair import OP12_SQL, chunk_costs, crossings, damaged, digests, edits_of, repair, solve

NEXT, ROLES = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}


def lawful(initials):
    rest = initials.removeprefix("s")
    return initials == "" or (len(rest) > 0 and rest == "ua" * (len(rest) // 2))


def every_audit(rows, inserts=4):
    """All edits of ``rows`` (initial, fault) with few inserts: cost and letters of those that give a lawful order."""
    found = []
    for n in range(inserts + 1):
        for places in itertools.combinations_with_replacement(range(len(rows) + 1), n):
            steps = []
            for k in range(len(rows) + 1):
                steps += ["I"] * places.count(k)
                if k < len(rows):
                    steps.append(k)
            options = [[("I", r) for r in "ua"] if s == "I" else [("K", rows[s][0]), ("R", "u"), ("R", "a"), ("D", "")] for s in steps]
            for chosen in itertools.product(*options):
                cost, bad = 0, False
                for s, (letter, _) in zip(steps, chosen):
                    fault = "" if s == "I" else rows[s][1]
                    bad |= fault == "gone" and letter != "D"
                    cost += {"K": 0, "R": 3, "D": 4, "I": 3}[letter] + 3 * (fault == "cut" and letter != "D")
                if not bad and lawful("".join(r for _, r in chosen)):
                    found.append((cost, "".join(x for x, _ in chosen)))
    return min(found)


def code(initial, fault):
    return "sua".find(initial) % 4 + 4 * {"": 0, "cut": 1, "gone": 2}[fault]


def by_strings(rows):
    """Cost and whole audit per state of the roles so far."""
    best = {"": (0, "")}
    for initial, fault in rows:
        new = {}
        for state, (cost, audit) in best.items():
            for _ in range(4):
                made = [(4, "D", state)]
                if fault != "gone":
                    made.append((3, "R", NEXT[state]))
                    if initial == NEXT[state] or (initial == "s" and state == ""):
                        made.append((0, "K", initial))
                for more, letter, to in made:
                    one = (cost + more + 3 * (fault == "cut" and letter != "D"), audit + letter)
                    new[to] = min(new.get(to, one), one)
                state, cost, audit = NEXT[state], cost + 3, audit + "I"
        best = new
    end = {"": "", "s": "II", "u": "I", "a": ""}
    return min((c + 3 * len(end[s]), a + end[s]) for s, (c, a) in best.items())


def random_rows(rng, n):
    return [(rng.choice("suuuaaax"), rng.choice(["", "", "", "cut", "gone"])) for _ in range(n)]


def test_against_all_edits():
    rng = random.Random(1)
    for _ in range(25):
        rows = random_rows(rng, rng.randint(0, 3))
        codes = bytes(code(*r) for r in rows)
        want = every_audit(rows)
        assert by_strings(rows) == want and (solve(codes) if codes else (0, "")) == want


@pytest.mark.parametrize("seed", range(3))
def test_against_strings(seed):
    rng = random.Random(seed)
    for _ in range(400):
        rows = random_rows(rng, rng.choice([1, 2, 5, 8, 9, 17, 64, 200]))
        assert solve(bytes(code(*r) for r in rows)) == by_strings(rows)


def test_pieces_give_the_same_as_the_whole():
    rng = random.Random(5)
    for _ in range(100):
        codes = bytes(code(*r) for r in random_rows(rng, rng.randint(3, 60)))
        parts, at = [], 0
        while at < len(codes):
            size = rng.randint(1, 9)
            parts.append(codes[at : at + size])
            at += size
        cost, audit = solve(codes)
        leave = {"II": 1, "I": 2}.get(audit[len(audit.rstrip("I")) :], None)
        for end in ([leave] if leave else [0, 3]):
            states = crossings([chunk_costs(p) for p in parts], 0, end)
            made = "".join(edits_of(p, a, b) for p, a, b in zip(parts, states, states[1:]))
            if made + {1: "II", 2: "I"}.get(end, "") == audit:
                break
        else:
            raise AssertionError((codes, audit))


def plain_digests(rows):
    """Whole conversations from ``(conv_id, turn, role, text)``, nulls made spaces, faults and all, in plain Python."""
    blanks = " \t\n\x0b\x0c\r"
    made = []
    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        conversations[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    for conv, some in conversations.items():
        some.sort(key=lambda r: (r[0], r[1], r[2].encode(), hashlib.sha1(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in some:
            end = text.rstrip(blanks)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        kinds = {"blank": "gone", "duplicate": "gone", "truncated": "cut", "": ""}
        cost, audit = by_strings([(r[2][:1], kinds[f]) for r, f in zip(some, faults)])
        state, rest, out = "", list(some), []
        for letter in audit:
            row = None if letter == "I" else rest.pop(0)
            if letter == "K":
                state = row[2][:1]
                out.append(f"{row[2]}:{row[3]}")
            elif letter != "D":
                state = NEXT[state]
                out.append(f"{ROLES[state]}:{row[3] if row else ''}")
        turns = [r[1] for r in some if r[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(some, some[1:]))
        made.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()))
    return sorted(made, key=str)


def random_conversations(rng, n, longest):
    rows = []
    for conv in [None, 1 << 60, *range(n)]:
        for turn in range(rng.randint(1, longest)):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn // 2, turn * 3]), rng.choice(["user", "assistant", "system", "tool", "", None, "u"]),
                         rng.choice(["a.", "b!", "yes", "", None, " \t", "ok?  ", "é.", "x\ny.", f"{turn}."])))
    return rows


@pytest.mark.parametrize("piece_rows", [1 << 16, 3])
def test_rows(spark, frame, piece_rows):
    rng = random.Random(piece_rows)
    rows = random_conversations(rng, 40, 20) + [(7_000, k % 3, "user", "same.") for k in range(300)] + [(7_001, None, None, None)] * 50
    df = frame(rows, "conv_id bigint, turn bigint, role string, text string").withColumnRenamed("n", "gaps")
    got = sorted((tuple(r) for r in digests(repair(df, piece_rows)).collect()), key=str)
    assert got == plain_digests(rows)
    assert repair(df.limit(0)).collect() == [] and digests(repair(df.limit(0))).collect() == []


def test_one_long_conversation_lies_in_many_tasks(spark):
    rng = random.Random(8)
    rows = [(1, k, *rng.choice([("user", f"{k}."), ("assistant", f"{k}."), ("user", "again."), ("assistant", "cut")])) for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert [tuple(r) for r in digests(repair(df, 100)).collect()] == plain_digests(rows)


def test_repaired_texts(spark):
    rows = [(1, 0, "assistant", "hello."), (1, 1, "assistant", "there."), (2, 0, "user", "a."), (2, 1, "user", " ")]
    got = repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("conv_id", "at").collect()
    assert [(r["conv_id"], r["edit"], r["role"], r["text"]) for r in got if r["at"]] == [
        (1, "R", "user", "hello."), (1, "K", "assistant", "there."), (2, "K", "user", "a."), (2, "D", "user", " "), (2, "I", "assistant", ""),
    ]


def test_query_in_small_pieces(spark, con, sf_dir):
    assert differences(digests(repair(damaged(table(spark, sf_dir, "conversations")), 2)), con, OP12_SQL) == []


def test_damage_with_nulls(spark, con):
    rows = random_conversations(random.Random(3), 30, 12)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    con.execute("CREATE OR REPLACE TEMP TABLE given (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO given VALUES (?, ?, ?, ?)", rows)
    assert differences(digests(repair(damaged(df))), con, OP12_SQL.replace("FROM conversations", "FROM given")) == []
