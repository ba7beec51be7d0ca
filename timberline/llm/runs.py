"""Runs of repeated words by maximal pairs, and texts with their repetitions collapsed.

A run of period q is a maximal pair at distance q: two places whose words agree for some length l and differ right before
and right after. Its stretch has l + q words, so a limit on the stretch in periods is a limit on the distance in l, and
pairs that meet it are the runs, with nothing left to extend. Pairs are found bottom-up in the tree of LCP intervals.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from timberline.llm.common import table
from timberline.llm.textstats import groups_of

#: A stretch is a run from this many words and this many periods on.
MIN_WORDS = 6
MIN_PERIODS = 4


def word_numbers(texts: list[list[bytes]]) -> np.ndarray:
    """Numbers of all words in a row; no number serves two texts, so that nothing matches across them."""
    ids: list[int] = []
    first = 0
    for words in texts:
        known: dict[bytes, int] = {}
        ids += [first + known.setdefault(w, len(known)) for w in words]
        first += len(known)
    return np.asarray(ids, np.int64)


def repeated_suffixes(ids: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose next ``shared`` (four to eight) words stand twice, in suffix order, and the number of their group of equal words.

    Words that occur nowhere else and come after all others are taken to follow the last one. Ranks of the first ``shared`` words are doubled, for
    places that are still tied alone.
    """
    n = len(ids)
    if n <= shared:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    over = int(ids.max()) + 1
    padded = np.concatenate([ids, np.arange(over, over + shared)])

    def named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)[1]

    two = named(padded[:-1], padded[1:])
    rank = named(two[:-2], two[2:])
    for k in range(4, shared):
        rank = named(rank[:-1], padded[k : k + len(rank) - 1])
    rank = rank[:n]
    many = np.bincount(rank)
    # A rank is the number of places that come before its group, so that groups can be divided in place.
    rank = (np.cumsum(many) - many)[rank]
    size = np.bincount(rank, minlength=n + 1)
    members = np.flatnonzero(size[rank] > 1)
    group, tied, reach = rank[members], members, shared
    while len(tied):
        after = tied + reach
        key = rank[tied] << 32 | np.where(after < n, rank[np.minimum(after, n - 1)], n)
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        place = np.arange(len(tied))
        outer = np.maximum.accumulate(np.where(np.diff(key >> 32, prepend=-1) != 0, place, 0))
        inner = np.maximum.accumulate(np.where(np.diff(key, prepend=-1) != 0, place, 0))
        rank[tied] = (key >> 32) + inner - outer
        alone = np.bincount(inner, minlength=len(tied))[inner] == 1
        tied, reach = tied[~alone], 2 * reach
    order = np.argsort(rank[members], kind="stable")
    return members[order], group[order]


def common_prefixes(ids: list[int], suffixes: list[int], group: list[int], shared: int) -> list[int]:
    """Per suffix the number of words it shares with the one before it, 0 where a group begins. Linear: a place's value is at least that of the place before it less one."""
    place = {p: k for k, p in enumerate(suffixes)}
    found, n, far, last = [0] * len(suffixes), len(ids), 0, -2
    for p in sorted(suffixes):
        k = place[p]
        far = max(far - 1, shared) if p == last + 1 else shared
        last = p
        if not k or group[k] != group[k - 1]:
            far = shared
            continue
        other = suffixes[k - 1]
        top = n - max(p, other)
        while far < top and ids[p + far] == ids[other + far]:
            far += 1
        found[k] = far
    return found


def maximal_pairs(ids: list[int], suffixes: list[int], shares: list[int], periods: int) -> Iterator[tuple[int, int, int]]:
    """``place, distance, length`` of the maximal pairs that are at most ``length / (periods - 1)`` apart.

    Every LCP interval holds its places in order, each in the class of the word to its left. Intervals are joined bottom-up,
    the smaller into the larger. A pair of places from two children differs in the word after its length; it is
    maximal if the classes differ as well. Places that are so near to each other stand one period apart, so that only the
    neighbours of a place can begin a run; pairs at multiples of the period may come out besides.
    """

    def joined(one: list[int], two: list[int], length: int) -> list[int]:
        small, large = (one, two) if len(one) < len(two) else (two, one)
        most, at = length // (periods - 1), []
        for p in small:
            k = bisect_left(large, p)
            at.append(k)
            for q in large[max(k - 1, 0) : k + 1]:
                if abs(p - q) <= most:
                    first = min(p, q)
                    if not first or ids[p - 1] != ids[q - 1]:
                        found.append((first, abs(p - q), length))
        if len(small) == 1:
            large.insert(at[0], small[0])
        else:
            large += small
            large.sort()
        return large

    found: list[tuple[int, int, int]] = []
    path: list[tuple[int, list[int]]] = []
    for k, p in enumerate(suffixes):
        whole = [p]
        following = shares[k + 1] if k + 1 < len(shares) else 0
        while path and path[-1][0] > following:
            length, places = path.pop()
            whole = joined(places, whole, length)
        if path and path[-1][0] == following:
            path[-1] = (following, joined(path[-1][1], whole, following))
        elif following:
            path.append((following, whole))
        yield from found
        found.clear()


def runs_of(texts: list[list[bytes]], least: int = MIN_WORDS, periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """Per text its runs ``start, length, period`` by start, then period.

    A run is a stretch of at least ``least`` words and ``periods`` (two or more) times its smallest period that cannot be extended. Of pairs with one stretch
    the least distance is the period.
    """
    # A run of period q shares max(least, periods * q) - q words; the least of these is what places must share to matter.
    shared = min(max(least, periods * q) - q for q in range(1, least + 1))
    if not 4 <= shared <= 8 or periods < 2:
        raise ValueError("runs of this size are not looked for")
    ends = np.cumsum([len(words) for words in texts], dtype=np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    numbers = word_numbers(texts)
    suffixes, group = repeated_suffixes(numbers, shared)
    if not len(suffixes):
        return out
    ids, order = numbers.tolist(), suffixes.tolist()
    best: dict[tuple[int, int], int] = {}
    for place, distance, length in maximal_pairs(ids, order, common_prefixes(ids, order, group.tolist(), shared), periods):
        if length + distance >= least:
            stretch = (place, length + distance)
            best[stretch] = min(distance, best.get(stretch, distance))
    for (place, length), period in sorted(best.items()):
        k = int(np.searchsorted(ends, place, side="right"))
        out[k].append((place - (int(ends[k - 1]) if k else 0), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def most_periods(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; of equal ones the first, then the one of smaller period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def with_planted_period(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The query's test rule: of ids whose CRC ends in 0, the words from some place on repeat with some period."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", planted: bool = False, least: int = MIN_WORDS, periods: int = MIN_PERIODS, with_text: bool = True) -> DataFrame:
    """Per row: ``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256``, with ``runs`` (all of them) and ``collapsed`` (the text) if asked for.

    The first run columns tell of the run with the most periods, null where there is none. Words are runs without space and \\x09-\\x0D; a null or empty text
    has none. Rows that repeat an id are judged one by one, a null id stays null, other columns are ignored, and an empty table gives an empty table. Texts are
    worked on in groups of about a million characters, a longer one by itself. ``planted`` applies :func:`with_planted_period` first.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    triple = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
    fields = [StructField("doc_id", docs.schema[doc_id].dataType)]
    fields += [StructField(c, LongType()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    fields += [StructField(c, StringType()) for c in ("runs_sha256", "collapsed_sha256")]
    if with_text:
        fields += [StructField("runs", ArrayType(triple)), StructField("collapsed", StringType())]
    schema = StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, some in groups_of(batch, 1):
                ids = batch.column(0).slice(begin, end - begin)
                texts = [t.encode().split() for t in some]
                if planted:
                    texts = [with_planted_period(words, i.as_py()) for words, i in zip(texts, ids)]
                rows = []
                for words, runs in zip(texts, runs_of(texts, least, periods)):
                    best = most_periods(runs)
                    left = b" ".join(collapsed(words, runs))
                    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                    head = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
                    row = (*head, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(left).hexdigest())
                    rows.append((*row, [dict(zip(("start", "length", "period"), r)) for r in runs], left.decode()) if with_text else row)
                columns = [ids.cast(arrow.field(0).type), *[pa.array(c, arrow.field(k + 1).type) for k, c in enumerate(zip(*rows))]]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(table(spark, sf_dir, "documents"), planted=True, with_text=False)
