"""Order-dependent totals without a task that sees a whole source.

``carry_in`` and ``running`` work on integer order columns: rows are cut into
blocks of consecutive order values, each block is aggregated (with map-side
combine), totals run over the block table, and the rows of one block get a local
window. A source of 10^11 lines becomes about 10^6 block rows.

``global_positions`` numbers rows of any total order through a range-partitioned
sort, stored once because range bounds are sampled anew each time a plan runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.session import stored

BLOCK_ROWS = 1 << 16
BLOCKS_OF_BLOCKS = 1 << 12
_LOCAL_BITS = 33

_COMBINE = {
    "sum": lambda before, here: F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0)),
    "max": F.greatest,
    "min": F.least,
}
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def block_of(order: Column, width: int = BLOCK_ROWS) -> Column:
    """Block number of an integer order value for a power-of-two ``width``; follows the order of the values."""
    if width & (width - 1):
        raise ValueError("width must be a power of two")
    return F.shiftright(order.cast("bigint"), width.bit_length() - 1)


def carry_in(
    df: DataFrame, keys: list[str], block: str, totals: dict[str, tuple[str, Column]], prefix: str = "carry_"
) -> DataFrame:
    """Per ``(keys, block)``: each total over all earlier blocks of the same keys.

    ``totals`` maps a name to ``(kind, column)`` with kind ``sum``, ``max`` or ``min``.
    """
    per_block = df.groupBy(*keys, block).agg(*[_AGG[kind](col).alias(name) for name, (kind, col) in totals.items()])

    def through(rows: DataFrame, within: list[str], order: str) -> DataFrame:
        earlier = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        sums = [_AGG[kind](F.col(name)).over(earlier).alias(prefix + name) for name, (kind, _) in totals.items()]
        return rows.select(*keys, *[c for c in rows.columns if c in (block, "_far")], *sums)

    if keys:
        return through(per_block, keys, block)
    # Without keys the blocks themselves are cut into blocks, so that no task sees all of them.
    far = per_block.withColumn("_far", F.shiftright(F.col(block), BLOCKS_OF_BLOCKS.bit_length() - 1))
    outer = through(far.groupBy("_far").agg(*[_AGG[kind](F.col(name)).alias(name) for name, (kind, _) in totals.items()]), [], "_far")
    outer = outer.select("_far", *[F.col(prefix + name).alias("_outer_" + name) for name in totals])
    inner = through(far, ["_far"], block).join(outer, "_far")
    return inner.select(
        block, *[_COMBINE[kind](F.col("_outer_" + name), F.col(prefix + name)).alias(prefix + name) for name, (kind, _) in totals.items()]
    )


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    totals: dict[str, tuple[str, Column]],
    width: int = BLOCK_ROWS,
    include_current: bool = True,
    block: Column | None = None,
    keep_block: bool = False,
) -> DataFrame:
    """Add running totals along ``order`` within ``keys``.

    The first order column must be an integer with a bounded number of rows per
    value, or ``block`` must give such a grouping; keys are not NULL. With ``keep_block`` the
    block stays as ``_block``; rows are partitioned by it, so grouping by keys and block needs no shuffle. Sums start at 0; ``max`` and
    ``min`` over nothing are NULL.
    """
    blocked = df.withColumn("_block", block_of(F.col(order[0]), width) if block is None else block)
    offsets = carry_in(blocked, keys, "_block", totals)
    last = 0 if include_current else -1
    local = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    # Both sides are shuffled by the columns the window needs, so rows move once. The hint keeps the planner
    # from broadcasting well-compressed rows, whose estimated size may be below that of the block table.
    joined = blocked.join(offsets.hint("merge"), [*keys, "_block"])
    named = {
        name: _COMBINE[kind](F.col("carry_" + name), _AGG[kind](col).over(local))
        for name, (kind, col) in totals.items()
    }
    kept = [*df.columns, "_block"] if keep_block else df.columns
    return joined.select(*kept, *[c.alias(name) for name, c in named.items()])


def global_positions(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """Add the 0-based ``position`` of each row in the total order ``order``.

    One range shuffle; the sorted rows are stored with a row id that holds the
    partition and the index inside it, and the only other work is a count per
    partition, so no task sees more than its range.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = stored(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id()),
        "ordered",
    )
    part = F.shiftright("_row", _LOCAL_BITS)
    local = F.col("_row").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    sizes = ranked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per range partition, hence at most ``parts`` rows on either side of this window.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        ranked.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select((F.col("_offset") + local).alias("position"), *df.columns)
    )
