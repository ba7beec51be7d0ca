"""Strings that every match of a pattern holds, against matches of random patterns."""

import random
import re

import pytest

from timberline.functions.patterns import required_literals
from timberline.operators import search
from timberline.session import stored
from timberline.sources import search_store
from pyspark.sql import functions as F


def random_pattern(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 4)
    inner = lambda: random_pattern(rng, depth + 1)
    if kind < 3:
        return "".join(rng.choice(["a", "b", "c", r"\.", "ab", r"\n", "é"]) for _ in range(rng.randint(1, 4)))
    if kind == 3:
        return rng.choice([".", r"\d", "[ab]", "^", "$", r"\b", "[^c]", "c?", "b*", "a+"])
    if kind == 4:
        return inner() + inner()
    if kind == 5:
        return f"({inner()}|{inner()})"
    if kind == 6:
        return f"(?:{inner()})" + rng.choice(["?", "*", "+", "{2}", "{0,2}", "{1,3}", "+?", "++"])
    if kind == 7:
        return rng.choice(["(?=%s)", "(?!%s)", "(?:%s)", "(?>%s)"]) % inner()
    return f"({inner()})"


@pytest.mark.parametrize("seed", range(3))
def test_every_match_holds_one(seed):
    rng, told = random.Random(seed), 0
    for _ in range(3000):
        pattern = random_pattern(rng)
        try:
            compiled = re.compile(pattern)
        except re.error:
            continue
        literals = required_literals(pattern)
        assert all(x and "\n" not in x for x in literals)
        told += bool(literals)
        for _ in range(30):
            text = "".join(rng.choice("aabbc.\né1") for _ in range(rng.randint(0, 14)))
            if literals and compiled.search(text):
                assert any(x in text for x in literals), (pattern, literals, text)
    assert told > 500


def test_known_patterns():
    assert required_literals(r"user=[0-9]*7 v=[1-3][0-9]{2}\b") == ("user=",)
    assert required_literals(r"(timeout|refused) after \d+") == (" after ",)
    assert required_literals(r"err(or)s? (at|in)") == ("error",)
    assert required_literals("(?i)error") == required_literals(r"\d+") == required_literals("a?b?") == required_literals(r"\Qab\E") == required_literals("(") == ()
    assert required_literals("one\nlonger line") == ("longer line",)
    assert required_literals("(alpha|beta)+") == ("alpha", "beta")


def test_search_by_pattern(spark, tmp_path):
    text = F.concat_ws(" ", F.lit("n"), (F.col("id") % 97).cast("string"), F.when(F.col("id") % 1000 == 5, "timeout").when(F.col("id") % 1500 == 7, "refused by\u00e9"))
    lines = stored(spark.range(20_000).select((F.col("id") % 2).cast("int").alias("source_id"), (F.floor(F.col("id") / 2) + 1).alias("line_no"), F.floor(F.col("id") / 6).alias("seq"), text.alias("text")))
    items = stored(lines.groupBy("source_id", "seq").agg(F.min("line_no").alias("first_line"), (F.count("*") - 1).alias("continuation_count")))
    search_store.write_search(lines, str(tmp_path / "s"))
    every = lines.groupBy("source_id", "seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), "\n").alias("raw_text"))
    for pattern in ("timeout|refused", r"n 5\d? timeout", r"refused by.\n", r"^n 1\nn 3\n"):
        want = sorted(tuple(r) for r in every.filter(F.col("raw_text").rlike(pattern)).collect())
        assert sorted(tuple(r) for r in search.filter_regex(lines, pattern).collect()) == want, pattern
        assert sorted(tuple(r) for r in search_store.find_regex(spark, str(tmp_path / "s"), pattern, items).collect()) == want, pattern
