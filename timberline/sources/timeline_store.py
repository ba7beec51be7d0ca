"""A stored merged timeline that is brought up to date range by range.

The view lies in pieces, each a range of the order (key, source ordinal, seq), sorted inside. A manifest says where each piece begins, how many rows of
each source it holds and up to which item. What a source gained or lost is dealt out to the pieces it falls in; these alone are written anew. No row
holds its position: that is its place in the piece plus the rows of the pieces before, so that nothing behind a change has to move.

Neighbouring pieces of one writing task share a folder, the chunk, so that tasks, files and folders grow with the rows and not with how finely they are
cut. Of a chunk, the pieces no longer in the manifest are passed over.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.functions.datetime import LONG_MIN
from timberline.operators import timeline
from timberline.operators.assemble import carry_forward_key
from timberline.session import small_side, stored

ORDER = ["sort_key", "source_ordinal", "seq"]
PIECE_ROWS = 1 << 20
#: What a task writes as one chunk where pieces are smaller than that.
CHUNK_ROWS = 1 << 18
MANIFEST = "piece BIGINT, source_id INT, n BIGINT, max_seq BIGINT, low_key BIGINT, low_ordinal BIGINT, low_seq BIGINT"
#: The parts of a piece's number: the generation that wrote it, the task, and which of the task's pieces it is. All but the last are the chunk's number.
_TASK_BITS, _GROUP_BITS = 21, 21
#: More pieces or chunks than that are met by a join and not named one by one in a filter.
MOST_NAMED = 1000
_LOCAL_ROW = (1 << 33) - 1


def _keyed(items: DataFrame, sources: DataFrame, assembled: bool) -> DataFrame:
    keyed = items.withColumn("sort_key", F.coalesce("key_ms", F.lit(LONG_MIN))) if assembled else carry_forward_key(items)
    ordinals = small_side(sources.select("source_id", "source_ordinal"), row_bytes=16)
    return keyed.join(ordinals, "source_id").withColumn("source_ordinal", F.col("source_ordinal").cast("bigint"))


def _write(rows: DataFrame, path: str, generation: int, total: int, piece_rows: int) -> DataFrame:
    """Write ``rows`` (with ``_group``, ordered like ``ORDER``, about ``total``) as new pieces and return what the manifest says of them."""
    spark = rows.sparkSession
    chunk = F.lit(generation << _TASK_BITS) + F.spark_partition_id().cast("bigint")
    parts = max(1, -(-total // max(piece_rows, CHUNK_ROWS)))
    placed = rows.repartitionByRange(parts, "_group", *ORDER).withColumn("chunk", chunk).sortWithinPartitions("chunk", "_group", *ORDER)
    # A chunk lies in one task, so numbers per task will do. Along them neither the group nor the count of full pieces falls: their sum changes with either.
    numbered = placed.withColumn("row", F.monotonically_increasing_id())
    full = F.floor(F.col("row").bitwiseAND(F.lit(_LOCAL_ROW)) / piece_rows)
    cut = numbered.withColumn("piece", F.shiftleft("chunk", _GROUP_BITS) + F.col("_group") + full).drop("_group")
    cut.write.mode("append").partitionBy("chunk").parquet(os.path.join(path, "rows"))
    fresh = _rows(spark, path, cut.schema).filter(F.col("chunk") >= generation << _TASK_BITS)
    counted = fresh.groupBy("piece", "source_id").agg(F.count("*").alias("n"), F.max("seq").alias("max_seq"), F.min(F.struct(*ORDER)).alias("low"))
    told = counted.withColumn("low", F.min("low").over(Window.partitionBy("piece")))
    return told.select("piece", "source_id", "n", "max_seq", F.col("low.sort_key").alias("low_key"), F.col("low.source_ordinal").alias("low_ordinal"), F.col("low.seq").alias("low_seq"))


def _rows(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """All stored rows, of all generations. Their columns are kept beside, so that a view without rows has them too."""
    return spark.read.schema(schema or spark.read.parquet(os.path.join(path, "columns")).schema).parquet(os.path.join(path, "rows"))


def _keep(manifest: DataFrame, path: str, generation: int) -> None:
    """The manifest of a generation, written last: until then readers see the one before."""
    columns = [F.col(c.split()[0]).cast(c.split()[1]) for c in MANIFEST.split(", ")]
    manifest.select(*columns).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "manifest", f"generation={generation}"))


def current_generation(spark: SparkSession, path: str) -> int:
    """The newest generation that is complete."""
    target = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "manifest"))
    store = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    done = spark._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in store.listStatus(target)]
    return max(int(n.split("=")[1]) for n in names if "=" in n and store.exists(done(target, n + "/_SUCCESS")))


def _manifest(spark: SparkSession, path: str, generation: int) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(os.path.join(path, "manifest", f"generation={generation}"))


def write_view(items: DataFrame, sources: DataFrame, path: str, assembled: bool = True, piece_rows: int = PIECE_ROWS) -> int:
    """Merge all ``items`` into a new store at ``path``; ``sources`` is ``source_id, source_ordinal``. Returns the generation, 1."""
    rows = stored(_keyed(items, sources, assembled).withColumn("_group", F.lit(0).cast("bigint")), "keyed")
    told = _write(rows, path, 1, rows.count(), piece_rows)
    columns = rows.drop("_group").withColumns({name: F.lit(0).cast("bigint") for name in ("row", "piece", "chunk")})
    columns.limit(0).write.mode("overwrite").parquet(os.path.join(path, "columns"))
    _keep(told, path, 1)
    return 1


def update_view(
    spark: SparkSession, path: str, changed: DataFrame, added: DataFrame | None, sources: DataFrame, assembled: bool = True, piece_rows: int = PIECE_ROWS
) -> int:
    """Bring the view up to date and return its new generation.

    ``changed`` is ``source_id, from_seq``: items from that number on are out of date and go, 0 for a whole source. ``added`` has the items that come instead, if any.
    Pieces without either are not written, and chunks without any such piece are not read. Only the beginnings of the pieces, one row each, come to the driver.
    """
    before = current_generation(spark, path)
    manifest = stored(_manifest(spark, path, before), "manifest")
    bounds = manifest.groupBy("piece").agg(F.first(F.struct("low_key", "low_ordinal", "low_seq")).alias("low"), F.sum("n").alias("n")).orderBy("low").collect()
    gone = stored(changed.groupBy("source_id").agg(F.min("from_seq").cast("bigint").alias("from_seq")), "gone")
    hit = manifest.join(small_side(gone, 16), "source_id").filter("max_seq >= from_seq").select("piece").distinct()
    new = None
    if added is not None:
        new = stored(_placed(_keyed(added, sources, assembled), bounds), "added")
        hit = hit.unionByName(new.select("piece").distinct()).distinct()
    touched = {r["piece"] for r in hit.collect()}
    generation = before + 1
    if not bounds and new is not None:
        rows = new.drop("piece").withColumn("_group", F.lit(0).cast("bigint"))
        _keep(_write(rows, path, generation, new.count(), piece_rows), path, generation)
        return generation
    if not touched:
        _keep(manifest, path, generation)
        return generation
    # Touched pieces with nothing between them are one group: its rows may be cut anew, but not across what stays.
    groups, group, last = [], -1, -2
    for k, bound in enumerate(bounds):
        if bound["piece"] in touched:
            group += k != last + 1
            groups.append((bound["piece"], group, bound["n"]))
            last = k
    told = spark.createDataFrame([(p, g) for p, g, _ in groups], "piece BIGINT, _group BIGINT")
    kept = _rows_of(spark, path, sorted(touched)).drop("row", "chunk").join(small_side(gone, 16), "source_id", "left").filter("from_seq is null or seq < from_seq").drop("from_seq")
    rows = kept if new is None else kept.unionByName(new)
    total = sum(n for _, _, n in groups) + (new.count() if new is not None else 0)
    grouped = rows.join(F.broadcast(told), "piece").drop("piece")
    fresh = _write(grouped, path, generation, total, piece_rows)
    _keep(manifest.join(F.broadcast(told.select("piece")), "piece", "left_anti").unionByName(fresh), path, generation)
    return generation


def _placed(keyed: DataFrame, bounds: list) -> DataFrame:
    """``keyed`` with the ``piece`` each row falls in: the last that does not begin behind it, or the first."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*keyed.schema.fields, StructField("piece", LongType())])
    arrow = to_arrow_schema(schema)
    lows, pieces = [tuple(b["low"]) for b in bounds], [b["piece"] for b in bounds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = [("k", np.int64), ("o", np.int64), ("s", np.int64)]
        low, number = np.array(lows, kind), np.array([*pieces[:1], *pieces], np.int64)
        for batch in batches:
            rows = np.empty(batch.num_rows, kind)
            for name, column in zip("kos", ORDER):
                rows[name] = batch.column(column).to_numpy(zero_copy_only=False)
            at = np.searchsorted(low, rows, side="right") if len(low) else None
            piece = pa.array(number[at]) if len(low) else pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, piece], schema=arrow)

    return keyed.mapInArrow(run, schema)


def _among(rows: DataFrame, column: str, values: list[int]) -> DataFrame:
    """Rows whose ``column`` is one of the ``values``."""
    if len(values) <= MOST_NAMED:
        return rows.filter(F.col(column).isin(*values))
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} BIGINT")), column, "left_semi")


def _rows_of(spark: SparkSession, path: str, pieces: list[int]) -> DataFrame:
    """Rows of some pieces, found by the folders of their chunks."""
    return _among(_among(_rows(spark, path), "chunk", sorted({p >> _GROUP_BITS for p in pieces})), "piece", pieces)


def _offsets(spark: SparkSession, path: str, generation: int) -> DataFrame:
    """``piece, begin, n`` of a generation's pieces; ``begin`` is the position of the first row."""
    whole = _manifest(spark, path, generation).groupBy("piece").agg(F.first(F.struct("low_key", "low_ordinal", "low_seq")).alias("low"), F.sum("n").alias("n"))
    # One row per piece, some thousands of a million rows each.
    before = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    return whole.select("piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"), "n")


def _positions(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    first = rows.groupBy("piece").agg(F.min("row").alias("_first"))
    known = offsets.join(first, "piece")
    columns = [c for c in rows.columns if c not in ("chunk", "piece", "row")]
    return rows.join(F.broadcast(known), "piece").select((F.col("begin") + F.col("row") - F.col("_first")).alias("position"), *columns)


def read_view(spark: SparkSession, path: str, expected: int | None = None) -> tuple[DataFrame, int]:
    """The whole current view with positions, and its generation; a caller that ``expected`` another one is refused."""
    generation = current_generation(spark, path)
    if expected is not None:
        timeline.check_generation(expected, generation)
    offsets = stored(_offsets(spark, path, generation), "offsets")
    chunks = offsets.select(F.shiftright("piece", _GROUP_BITS)).distinct().collect()
    rows = _among(_rows(spark, path), "chunk", sorted(r[0] for r in chunks))
    return _positions(rows.join(F.broadcast(offsets.select("piece")), "piece", "left_semi"), offsets), generation


def fetch_page(spark: SparkSession, path: str, start: int, max_items: int = timeline.PAGE_ITEMS, max_bytes: int = timeline.PAGE_BYTES) -> DataFrame:
    """A page as from ``timeline.fetch_range``: the total comes from the manifest, and only pieces that the page touches are read."""
    told = _offsets(spark, path, current_generation(spark, path)).collect()
    total = sum(r["n"] for r in told)
    start = min(start, total)
    inside = [r["piece"] for r in told if r["begin"] < start + max_items and r["begin"] + r["n"] > start]
    if not inside:
        inside = [told[0]["piece"]] if told else [-1]
    offsets = spark.createDataFrame([tuple(r) for r in told if r["piece"] in set(inside)], "piece BIGINT, begin BIGINT, n BIGINT")
    return timeline.fetch_range(_positions(_rows_of(spark, path, inside), offsets), start, max_items, max_bytes, total)
