"""Benchmark decontamination by spaced seeds: hashes that ignore chosen token positions, so a hit survives substitutions.

DataFrame functions only. Seeds of training text are joined with those of the benchmark where the text is read; diagonals with hits
are kept. Those documents' texts are then compared with the items token by token in every
window of the diagonal, where substituted tokens count as differences and not as ends.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import table
from timberline.llm.line_dedup import ROW_KEY, row_key
from timberline.session import BROADCAST_LIMIT_BYTES, small_side, stored

#: Masks by the length of a window, for a similarity of 0.75: 1 is compared, 0 is ignored. Whichever tokens of a window of that many
#: or more are substituted, up to a quarter, some mask fits somewhere beside them; the tests go through all choices.
FAMILIES = ((12, ("111011", "1100001011", "11010011", "1001111", "111101")), (8, ("1101", "11001")), (5, ("1101", "1011")), (4, ("1101",)), (3, ("101",)), (1, ("1",)))
#: Choices of substituted tokens that are gone through to find masks for other windows, and masks of a family, at most.
MOST_CHOICES, MOST_MASKS, MOST_SPAN = 200_000, 3, 12
#: Windows of an item that are compared together, by where they begin, and tokens of a document that a row holds.
BLOCK, STRETCH = 64, 1024
#: Items of fewer tokens count as whole copies.
FEW = 5


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda x: F.xxhash64(x))


def _least(wide: int, similarity: float) -> int:
    """The fewest equal tokens of ``wide`` that are enough; a whole copy where there are fewer than ``FEW``."""
    return wide if wide < FEW else next(k for k in range(wide + 1) if k >= similarity * wide)


def _choices(wide: int, errors: int) -> np.ndarray:
    """Every way to leave all but ``errors`` of ``wide`` tokens equal, as bits."""
    return np.array([(1 << wide) - 1 - sum(1 << k for k in some) for some in combinations(range(wide), errors)], np.int64)


def hits_left(masks: tuple[str, ...], wide: int, errors: int) -> np.ndarray:
    """Per choice of substituted tokens, how often masks fit beside them."""
    equal = _choices(wide, errors)
    hits = np.zeros(len(equal), np.int64)
    for mask in masks:
        kept = sum(1 << k for k, bit in enumerate(mask) if bit == "1")
        for at in range(wide - len(mask) + 1):
            hits += equal & kept << at == kept << at
    return hits


@lru_cache(256)
def family(wide: int, errors: int) -> tuple[tuple[str, ...], int]:
    """Masks that miss no window of ``wide`` tokens with up to ``errors`` substituted, and how many hits each such window has at least.

    The given families where they hold; else the heaviest of up to ``MOST_MASKS`` masks that a greedy search finds; where there are too many
    choices to go through, the run of equal tokens that must be somewhere.
    """
    if comb(wide, errors) > MOST_CHOICES:
        return ("1" * max(wide // (errors + 1), 1),), 1
    given = next(masks for least, masks in FAMILIES if wide >= least)
    least = int(hits_left(given, wide, errors).min()) if wide < 64 else 0
    if least:
        return given, least
    for weight in range(max(wide - errors, 1), 0, -1):
        some = ["1"] if weight == 1 else [
            "1" + "".join("1" if k in inner else "0" for k in range(1, span - 1)) + "1"
            for span in range(weight, min(wide, MOST_SPAN) + 1) for inner in map(set, combinations(range(1, span - 1), weight - 2))
        ]
        fits = [hits_left((mask,), wide, errors) > 0 for mask in some] if len(some) <= 500 else []
        open_, chosen = np.ones(comb(wide, errors), bool), []
        while fits and open_.any() and len(chosen) < MOST_MASKS:
            best = max(range(len(some)), key=lambda k: int((fits[k] & open_).sum()))
            chosen.append(some[best])
            open_ &= ~fits[best]
        if fits and not open_.any():
            return tuple(chosen), int(hits_left(tuple(chosen), wide, errors).min())
    raise ValueError("no mask fits")


def _seeds(rows: DataFrame, hashes: str, masks: list[str], keep: list[str]) -> DataFrame:
    """``keep``, ``at``, ``mask`` and ``seed``: the hash of what each mask keeps from each position on, where it fits in."""
    places = sorted({k for mask in masks for k, bit in enumerate(mask) if bit == "1"})
    zipped = F.arrays_zip(*[F.slice(hashes, k + 1, F.size(hashes)) for k in places])
    beside = {k: F.col("t").getField(str(n)) for n, k in enumerate(places)}

    def seed(number: int, mask: str) -> Column:
        kept = [beside[k] for k, bit in enumerate(mask) if bit == "1"]
        return F.struct(F.lit(number).alias("mask"), F.when(kept[-1].isNotNull(), F.xxhash64(F.lit(number), *kept)).alias("seed"))

    made = rows.select(*keep, F.posexplode(zipped).alias("at", "t")).select(*keep, "at", F.inline(F.array(*[seed(n, m) for n, m in enumerate(masks)])))
    return made.filter("seed is not null")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = 0.75,
    window: int = 20,
    few_letters: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    limit_bytes: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """One row per document id and benchmark item that overlap: ``doc_id, item_id, n_hits, item_tokens, matched, overlap``.

    The pair counts if, at any alignment, at least ``similarity`` of the tokens of one window of ``window`` item tokens (the whole item if
    shorter) are equal. No such pair is missed: the masks of :func:`family` leave each such window a number of hits on its diagonal, and all windows around
    diagonals with so many hits are compared. ``overlap`` is the best share found, ``matched`` the most equal tokens, ``n_hits`` the windows that count, by where they begin in
    the item and in the document.

    Null and empty texts match nothing. Items of fewer than ``FEW`` tokens count as whole copies only; short ones like ``yes`` stand in nearly every text, and
    ``few_letters`` leaves out those that have fewer letters and digits (:func:`left_out` names them). Rows that repeat an id are taken together; a null id is an id
    of its own. Ties cannot arise. Other columns are ignored. Hits are narrow rows, one per document, item, diagonal and block of
    ``BLOCK`` item tokens, and are never collected into lists; each meets a stretch of its document.

    Seeds of the benchmark are broadcast when their measured size is within ``limit_bytes``, and joined by shuffle beyond it.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.length(F.array_join(tokens(F.col(item_text)), "")).alias("letters"),
                             token_hashes(F.col(item_text)).alias("item_hashes"))
    items = items.distinct().withColumn("item_no", F.monotonically_increasing_id())
    items = items.withColumn("item_tokens", F.size("item_hashes")).withColumn("wide", F.least(F.lit(window), "item_tokens"))
    items = items.filter((F.col("item_tokens") >= FEW) | (F.col("item_tokens") > 0) & (F.col("letters") >= few_letters))
    found = {wide: (max(_least(wide, similarity), 1), *family(wide, wide - max(_least(wide, similarity), 1))) for wide in range(1, window + 1)}
    lengths = [r.wide for r in items.select("wide").distinct().collect()]
    masks = sorted({mask for wide in lengths for mask in found[wide][1]}) or ["1"]
    shapes = F.array(*[F.struct(F.lit(enough), F.array(*[F.lit(m in own) for m in masks]), F.lit(least)) for enough, own, least in found.values()])
    items = items.withColumn("shape", F.get(shapes, F.col("wide") - 1))
    items = items.select("item_id", "item_no", "item_hashes", "item_tokens", "wide", *[F.col(f"shape.col{k}").alias(c) for k, c in ((1, "enough"), (2, "own"), (3, "least_hits"))])
    items = stored(items, "items")
    own = ["item_no", "item_tokens", "wide", "least_hits", "own"]
    placed = _seeds(items, "item_hashes", masks, own).filter(F.get("own", F.col("mask"))).withColumnRenamed("at", "item_at")
    parts = placed.select("seed", "item_no", "item_at", "least_hits", F.explode(_blocks_of("item_at")).alias("item_block")).distinct()
    parts = small_side(parts, 48, limit_bytes=limit_bytes)
    # Positions leave a document as narrow rows; nothing of the text goes with them.
    hashed = docs.select(*row_key(doc_id, text), token_hashes(F.col(text)).alias("doc_hashes"))
    hits = _seeds(hashed, "doc_hashes", masks, ROW_KEY).withColumnRenamed("at", "doc_at").join(parts, "seed")
    hits = hits.groupBy(*ROW_KEY, "item_no", "item_block", (F.col("doc_at") - F.col("item_at")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("n"), F.first("least_hits").alias("least_hits")
    )
    hits = stored(hits.filter("n >= least_hits").drop("n", "least_hits"), "hits")
    # Where the block begins in the document, which may be before its first token.
    hits = hits.withColumn("doc_from", F.col("diagonal") + BLOCK * F.col("item_block"))
    hits = hits.withColumn("stretch", F.floor(F.col("doc_from") / STRETCH).cast("int"))
    ids = small_side(hits.select(F.col("_ld_id").alias("_id")).distinct(), 16)
    wanted = docs.join(ids, F.col(doc_id).eqNullSafe(F.col("_id")), "left_semi")
    # Rows that are equal altogether are looked at once.
    wanted = wanted.select(*row_key(doc_id, text), F.col(text).alias("text")).dropDuplicates(ROW_KEY)
    wanted = wanted.select(*[F.col(c).alias(c + "_d") for c in ROW_KEY], token_hashes(F.col("text")).alias("doc_hashes"))
    cut = F.transform(
        F.sequence(F.lit(-1), F.floor(F.size("doc_hashes") / STRETCH).cast("int")),
        lambda c: F.struct(c.alias("stretch_d"), F.slice("doc_hashes", F.greatest(c * STRETCH, F.lit(0)) + 1, F.lit(STRETCH + BLOCK + window)).alias("doc_part")),
    )
    pieces = wanted.select(*[c + "_d" for c in ROW_KEY], F.inline(cut))
    same = [F.col(c).eqNullSafe(F.col(c + "_d")) for c in ROW_KEY]
    met = hits.join(pieces, same[0] & same[1] & same[2] & (F.col("stretch") == F.col("stretch_d")))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.col("item_tokens") - F.col("wide")) / BLOCK).cast("int")),
        lambda b: F.struct(b.alias("item_block"), F.slice("item_hashes", b * BLOCK + 1, F.col("wide") + (BLOCK - 1)).alias("item_part")),
    )
    theirs = items.select("item_no", "item_id", "item_tokens", "wide", "enough", F.inline(blocks))
    met = met.join(small_side(theirs, 64, 8 * F.size("item_part"), limit_bytes), ["item_no", "item_block"])

    # One step per projection, as an expression that is used twice is computed twice.
    first = F.col("doc_from") - F.greatest(F.col("stretch") * STRETCH, F.lit(0))
    equal = F.transform("item_part", lambda x, i: F.coalesce(F.get("doc_part", first + i) == x, F.lit(False)))
    own = ["_ld_id", "item_id", "item_tokens", "wide", "enough", "item_block", "doc_from"]
    sums = F.transform(F.sequence(F.lit(0), F.size("equal") - F.col("wide")), lambda b: F.size(F.filter(F.slice("equal", b + 1, F.col("wide")), lambda x: x)))
    compared = met.select(*own, equal.alias("equal")).select(*own, "equal", sums.alias("sums"))
    compared = compared.filter(F.array_max("sums") >= F.col("enough"))
    good = F.filter(F.sequence(F.lit(0), F.size("sums") - 1), lambda b: F.get("sums", b) >= F.col("enough"))
    windows = compared.select(*own, F.array_max("sums").alias("matched"), F.explode(good).alias("b"))
    once = windows.select(
        F.col("_ld_id").alias("doc_id"), "item_id", "item_tokens", "matched", "wide",
        (F.col("doc_from") + F.col("b")).alias("doc_at"), (BLOCK * F.col("item_block") + F.col("b")).alias("item_at"),
    )
    return once.groupBy("doc_id", "item_id").agg(
        F.countDistinct("doc_at", "item_at").alias("n_hits"),
        F.max("item_tokens").cast("bigint").alias("item_tokens"),
        F.max("matched").cast("bigint").alias("matched"),
        F.max(F.col("matched") / F.col("wide")).alias("overlap"),
    )


def left_out(benchmark: DataFrame, few_letters: int, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, reason`` of the items that :func:`contaminated` does not look for: those without tokens, and those that ``few_letters`` leaves out."""
    words = tokens(F.col(item_text))
    sized = benchmark.select(F.col(item_id).alias("item_id"), F.size(words).alias("n"), F.length(F.array_join(words, "")).alias("letters"))
    reason = F.when(F.col("n") == 0, "no tokens").when((F.col("n") < FEW) & (F.col("letters") < few_letters), "too short")
    return sized.select("item_id", reason.alias("reason")).filter("reason is not null")


def _blocks_of(at: str) -> Column:
    """Blocks of the item that hold position ``at``; a block also has the tokens that its last window reaches. Windows begin in one block only."""
    own = F.floor(F.col(at) / BLOCK).cast("int")
    last = F.floor((F.col("item_tokens") - F.col("wide")) / BLOCK).cast("int")
    before = F.when((F.col(at) % BLOCK < F.col("wide") - 1) & (own > 0), own - 1)
    return F.filter(F.array(F.when(own <= last, own), before), lambda b: b.isNotNull())


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, sf_dir, "benchmark"))


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
#: Every window at every alignment, from all pairs of equal tokens; no seeds.
OP8_SQL = f"""
WITH item AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
ipos AS (SELECT item_id, w, len(w) AS n, least(20, len(w)) AS wide, unnest(range(0, len(w))) AS j FROM item),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dpos AS (SELECT doc_id, i, w[i + 1] AS word FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM doc)),
diagonal AS (
  SELECT doc_id, item_id, i - j AS d, n, wide, CASE WHEN wide < {FEW} THEN wide ELSE CAST(ceil(0.75 * wide) AS BIGINT) END AS enough, list(j) AS js
  FROM dpos JOIN (SELECT *, w[j + 1] AS word FROM ipos) USING (word) GROUP BY doc_id, item_id, i - j, n, wide HAVING count(*) >= enough
), compared AS (
  SELECT doc_id, item_id, d, n, wide, b, enough, len(list_filter(js, lambda x: x >= b AND x < b + wide)) AS matched
  FROM (SELECT *, unnest(range(0, n - wide + 1)) AS b FROM diagonal)
)
SELECT doc_id, item_id, count(*) AS n_hits, CAST(max(n) AS BIGINT) AS item_tokens, CAST(max(matched) AS BIGINT) AS matched, max(matched / wide) AS overlap
FROM compared WHERE matched >= enough GROUP BY doc_id, item_id
"""
