"""Bodies stored for search: lines in blocks, and for each block the three-letter strings that it holds.

A signature has a bit for each hash of three ASCII characters in a row that a block's lines hold, lower-cased. A needle can only stand in blocks whose
signatures have all its bits, so a search reads signatures, about a fiftieth of the text, and then the blocks that are left.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.patterns import required_literals
from timberline.operators import assemble
from timberline.session import small_side, stored

BLOCK_BITS = 12
SOURCE_SHIFT = 40
BITS = 1 << 16
#: Blocks that are named one by one where text is read; more are met by a join.
MOST_NAMED = 2000
#: Parquet row groups of the text, so that a block is a good part of one.
GROUP_BYTES = 1 << 20


def block_of(source_id: Column, line_no: Column) -> Column:
    """The block of a line: 4,096 lines of one source."""
    return F.shiftleft(source_id.cast("bigint"), SOURCE_SHIFT) + F.shiftright(line_no, BLOCK_BITS)


def _places(data: np.ndarray) -> np.ndarray:
    """The bits of all three ASCII characters in a row."""
    a = data.astype(np.uint32)
    code = a[:-2] | a[1:-1] << 8 | a[2:] << 16
    code = code[(a[:-2] < 128) & (a[1:-1] < 128) & (a[2:] < 128)]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16)


def bits_of(needle: str) -> list[int]:
    """The bits that a block with ``needle`` must have; none for a needle without three ASCII characters in a row."""
    folded = "".join(c.lower() if c.isascii() else c for c in needle)
    data = np.frombuffer(folded.encode(), np.uint8)
    return sorted(set(_places(data).tolist())) if len(data) > 2 else []


def write_search(item_lines: DataFrame, path: str) -> None:
    """Store ``item_lines`` (``source_id, seq, line_no, text``) by block, with signatures beside."""
    spark = item_lines.sparkSession
    lines = item_lines.select(block_of(F.col("source_id"), F.col("line_no")).alias("block"), "source_id", "seq", "line_no", "text")
    placed = lines.repartitionByRange("block").sortWithinPartitions("block", "line_no")
    placed.write.option("compression", "zstd").option("parquet.block.size", str(GROUP_BYTES)).parquet(os.path.join(path, "lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, np.zeros(BITS, bool)

        def signature() -> pa.RecordBatch:
            words = np.packbits(bits, bitorder="little").view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([words], pa.list_(pa.int64()))], names=["block", "signature"])

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            text = batch.column(1).cast(pa.large_string()).fill_null("")
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            starts = np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1)) if len(blocks) else []
            for begin, end in zip(starts, [*starts[1:], len(blocks)]):
                if blocks[begin] != now:
                    if now is not None:
                        yield signature()
                    now, bits = int(blocks[begin]), np.zeros(BITS, bool)
                part = data[offsets[begin] : offsets[end]]
                # Strings across two lines are counted in as well: they only make a block a candidate.
                for k in range(0, max(len(part) - 2, 0), 1 << 22):
                    bits[_places(part[k : k + (1 << 22) + 2])] = True
        if now is not None:
            yield signature()

    # A block that lies in two splits has two signatures; a line has all its strings in one of them.
    text = spark.read.parquet(os.path.join(path, "lines")).select("block", F.lower("text").alias("text"))
    text.mapInArrow(run, "block BIGINT, signature ARRAY<BIGINT>").write.option("compression", "zstd").parquet(os.path.join(path, "signatures"))


def candidates(spark: SparkSession, path: str, needle: str) -> DataFrame | None:
    """``block`` of all blocks that may hold a line with ``needle``, case aside; None if it is too short to tell."""
    bits = bits_of(needle)
    if not bits:
        return None
    masks: dict[int, int] = {}
    for bit in bits:
        masks[bit // 64] = masks.get(bit // 64, 0) | 1 << bit % 64
    signed = {w: m - (1 << 64) if m >> 63 else m for w, m in masks.items()}
    held = spark.read.parquet(os.path.join(path, "signatures"))
    for word, mask in signed.items():
        held = held.filter(F.element_at("signature", word + 1).bitwiseAND(F.lit(mask)) == mask)
    return held.select("block").distinct()


def lines_in(spark: SparkSession, path: str, blocks: DataFrame | None) -> DataFrame:
    """The stored lines of some blocks. Few blocks become conditions that row groups are chosen by; many are joined."""
    lines = spark.read.parquet(os.path.join(path, "lines"))
    if blocks is None:
        return lines
    some = stored(blocks, "blocks")
    few = [r["block"] for r in some.orderBy("block").limit(MOST_NAMED + 1).collect()]
    if len(few) > MOST_NAMED:
        return lines.join(small_side(some, 8), "block", "left_semi")
    spans: list[list[int]] = []
    for block in few:
        if spans and spans[-1][1] == block - 1:
            spans[-1][1] = block
        else:
            spans.append([block, block])
    return lines.filter(_any([(F.col("block") >= a) & (F.col("block") <= b) for a, b in spans]))


def _any(conditions: list[Column]) -> Column:
    """The conditions joined by OR as a balanced tree, which stays shallow."""
    if len(conditions) < 2:
        return conditions[0] if conditions else F.lit(False)
    half = len(conditions) // 2
    return _any(conditions[:half]) | _any(conditions[half:])


def find_text(spark: SparkSession, path: str, needle: str, items: DataFrame, ignore_case: bool = False) -> DataFrame:
    """``source_id, seq, raw_text`` of items whose body contains ``needle``: what ``search.filter_text`` gives, from the store at ``path``.

    ``items`` is the item index (``source_id, seq, first_line, continuation_count``): it tells in which blocks the bodies of hits lie.
    """
    fold = F.lower if ignore_case else (lambda c: c)
    longest = max(needle.split("\n"), key=len)
    near = lines_in(spark, path, candidates(spark, path, longest))
    hits = near.filter(F.contains(fold(F.col("text")), fold(F.lit(longest)))).select("source_id", "seq")
    found = _bodies(spark, path, hits, items)
    return found.filter(F.contains(fold(F.col("raw_text")), fold(F.lit(needle)))) if "\n" in needle else found


def find_regex(spark: SparkSession, path: str, pattern: str, items: DataFrame, literals: Sequence[str] | None = None) -> DataFrame:
    """``source_id, seq, raw_text`` of items whose body matches ``pattern``: what ``search.filter_regex`` gives, from the store at ``path``.

    Blocks are chosen by the strings one of which every match must hold, from the pattern or given as ``literals``; without any, all bodies are put together.
    """
    needed = tuple(literals or required_literals(pattern))
    if not needed:
        return assemble.bodies(lines_in(spark, path, None)).filter(F.col("raw_text").rlike(pattern))
    hits = None
    for literal in needed:
        near = lines_in(spark, path, candidates(spark, path, literal))
        some = near.filter(F.contains("text", F.lit(literal))).select("source_id", "seq")
        hits = some if hits is None else hits.unionByName(some)
    return _bodies(spark, path, hits, items).filter(F.col("raw_text").rlike(pattern))


def _bodies(spark: SparkSession, path: str, hits: DataFrame, items: DataFrame) -> DataFrame:
    """Bodies of the items of ``hits`` (``source_id, seq``), read from the blocks they lie in."""
    hits = stored(hits.distinct(), "hits")
    places = items.join(small_side(hits, 16), ["source_id", "seq"], "left_semi")
    last = F.col("first_line") + F.col("continuation_count")
    numbers = F.sequence(block_of(F.col("source_id"), F.col("first_line")), block_of(F.col("source_id"), last))
    return assemble.bodies(lines_in(spark, path, places.select(F.explode(numbers).alias("block")).distinct()), hits)
