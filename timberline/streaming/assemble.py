"""Items from lines that arrive in batches; the result equals one batch run over all lines.

Each micro-batch is assembled by the same distributed plan as a batch job. What has to survive between
batches is one row per source (format, line and date counts) and the item still open. Lines before the one that decides a
source's format are undated whatever it will be: one item each, written at once. State is kept as tables per epoch, so a
repeated epoch starts from the same state and overwrites its own output; older epochs' state is deleted.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions import datetime as dt
from timberline.operators.assemble import index_of, infer_source_format
from timberline.operators.prefix import running
from timberline.session import discard, own_copies, small_side, stored

LINES = "source_id INT, line_no BIGINT, raw_offset BIGINT, raw_len INT, text STRING, confirmed BOOLEAN"
SOURCES = (
    "source_id INT, format STRING, decided BOOLEAN, fell_back BOOLEAN, lines_seen BIGINT, dated BIGINT, first_dated BIGINT"
)
ITEMS = (
    "source_id INT, seq BIGINT, key_ms BIGINT, first_line BIGINT, continuation_count BIGINT, "
    "raw_offset BIGINT, raw_len BIGINT, confirmed BOOLEAN, body_bytes BIGINT"
)
BODIES = "source_id INT, seq BIGINT, line_no BIGINT, text STRING"


class StreamAssembler:
    """Feeds micro-batches of lines into items stored under ``base``.

    A source's lines have to arrive in line order from batch to batch, in any order inside one.
    """

    def __init__(self, spark: SparkSession, base: str, scan_lines: int | None = None):
        self.spark = spark
        self.base = base
        self.scan_lines = scan_lines

    def start(self, lines: DataFrame, checkpoint: str):
        """Start the query over a streaming ``lines`` and process what is available now."""
        return (
            lines.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def items(self) -> DataFrame:
        """All closed items so far."""
        return self.spark.read.schema(ITEMS).parquet(os.path.join(self.base, "items")).drop("epoch")

    def item_lines(self) -> DataFrame:
        """Bodies as ordered lines, ``source_id, seq, line_no, text``, of closed items and of those still open: what search, extracts and ``assemble.bodies`` read."""
        return self.spark.read.schema(BODIES).parquet(os.path.join(self.base, "lines")).drop("epoch")

    def process(self, batch: DataFrame, epoch: int) -> None:
        """One micro-batch: close what can be closed, keep the rest for the next epoch. What is stored on the way is deleted at its end."""
        with own_copies(self.spark):
            self._process(batch, epoch)

    def _process(self, batch: DataFrame, epoch: int) -> None:
        batch = _typed(batch, LINES)
        known = self._state("sources", SOURCES, epoch)
        fresh = stored(dt.mark(batch), "batch")
        sources = stored(self._decide(known, fresh), "sources")
        numbered = stored(self._number(fresh, sources), "numbered")
        parts = _typed(index_of(numbered), ITEMS)
        closed, held = self._close(stored(parts, "parts"), self._state("held", ITEMS, epoch))
        self._write("items", closed, epoch)
        text = fresh.select("source_id", "line_no", "text").join(numbered.select("source_id", "line_no", "seq"), ["source_id", "line_no"])
        self._write("lines", _typed(text, BODIES), epoch)
        self._write("held", held, epoch)
        self._write("sources", self._counted(sources, fresh), epoch)
        # The epoch before this one may be asked for again, those before it not.
        for name in ("held", "sources"):
            discard(self.spark, self._path(name, epoch - 2))

    def finish(self) -> DataFrame:
        """End of all sources after the last stored epoch: close held items."""
        last = self.spark.read.parquet(os.path.join(self.base, "sources")).agg(F.max("epoch")).first()[0]
        self._write("items", self._state("held", ITEMS, last + 1), last + 1)
        return self.items()

    def _decide(self, known: DataFrame, fresh: DataFrame) -> DataFrame:
        """State rows of all sources with the format settled where it can be."""
        counts = fresh.groupBy("source_id").agg(F.max("line_no").alias("_to"))
        hits = infer_source_format(fresh, self.scan_lines)
        both = known.join(counts, "source_id", "full_outer").join(hits.withColumnsRenamed(
            {"format": "_format", "fell_back": "_fell_back"}
        ), "source_id", "left")
        was = F.coalesce("decided", F.lit(False))
        now = was | (F.coalesce("outcome", F.lit("NoMatch")) != "NoMatch")
        if self.scan_lines is not None:
            now = now | (F.greatest(F.coalesce("_to", F.lit(0)), F.coalesce("lines_seen", F.lit(0))) >= self.scan_lines)
        return both.select(
            "source_id",
            F.when(was, F.col("format")).otherwise(F.col("_format")).alias("format"),
            now.alias("decided"),
            F.when(was, F.col("fell_back")).otherwise(F.coalesce("_fell_back", F.lit(False))).alias("fell_back"),
            F.greatest("lines_seen", "_to").alias("lines_seen"),
            F.coalesce("dated", F.lit(0)).cast("bigint").alias("dated"),
            "first_dated",
        )

    def _keyed(self, fresh: DataFrame, sources: DataFrame) -> DataFrame:
        ready = small_side(sources.select("source_id", "format", "dated", "first_dated"), row_bytes=64)
        return fresh.join(ready, "source_id").withColumn("key_ms", dt.key_of_hit("format"))

    def _number(self, fresh: DataFrame, sources: DataFrame) -> DataFrame:
        """Narrow lines of a batch with the ``seq`` of their items."""
        dated = F.col("key_ms").isNotNull()
        keyed = stored(
            self._keyed(fresh, sources).withColumn("text_bytes", F.octet_length("text")).drop("text", "format", "hit", "hit_key"), "keys"
        )
        here = running(
            keyed,
            ["source_id"],
            ["line_no"],
            {"_n": ("sum", dated.cast("bigint")), "_first": ("min", F.when(dated, F.col("line_no")))},
        )
        total = F.col("dated") + F.col("_n")
        seq = F.when(total == 0, F.col("line_no") - 1).otherwise(F.least("first_dated", "_first") + total - 2)
        return here.withColumn("seq", seq)

    def _close(self, parts: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Join the open item of each source with its new lines, then keep the last dated one open."""
        open_items = small_side(held.select(*[F.col(c).alias(c if c in ("source_id", "seq") else "h_" + c) for c in held.columns]), row_bytes=80)
        joined = parts.join(open_items, ["source_id", "seq"], "left")
        start = F.coalesce("h_raw_offset", "raw_offset")
        grown = joined.select(
            "source_id",
            "seq",
            F.coalesce("h_key_ms", "key_ms").alias("key_ms"),
            F.coalesce("h_first_line", "first_line").alias("first_line"),
            (F.col("continuation_count") + F.coalesce(F.col("h_continuation_count") + 1, F.lit(0))).alias("continuation_count"),
            start.alias("raw_offset"),
            (F.col("raw_offset") + F.col("raw_len") - start).alias("raw_len"),
            "confirmed",
            (F.col("body_bytes") + F.coalesce(F.col("h_body_bytes") + 1, F.lit(0))).alias("body_bytes"),
        )
        # Open items that got no line in this batch; at most one per source.
        continued = joined.filter(F.col("h_first_line").isNotNull()).select("source_id", "seq")
        untouched = held.join(continued, ["source_id", "seq"], "left_anti")
        everything = stored(_typed(grown, ITEMS).unionByName(untouched), "grown")
        last = small_side(everything.groupBy("source_id").agg(F.max("seq").alias("_last")), row_bytes=16)
        marked = everything.join(last, "source_id")
        is_open = (F.col("seq") == F.col("_last")) & F.col("key_ms").isNotNull()
        return marked.filter(~is_open).drop("_last"), marked.filter(is_open).drop("_last")

    def _counted(self, sources: DataFrame, fresh: DataFrame) -> DataFrame:
        """State rows with the dates of this batch added."""
        keyed = self._keyed(fresh, sources).filter(F.col("key_ms").isNotNull())
        added = keyed.groupBy("source_id").agg(F.count("*").alias("_n"), F.min("line_no").alias("_first"))
        return sources.join(added, "source_id", "left").select(
            "source_id",
            "format",
            "decided",
            "fell_back",
            "lines_seen",
            (F.col("dated") + F.coalesce("_n", F.lit(0))).alias("dated"),
            F.least("first_dated", "_first").alias("first_dated"),
        )

    def _path(self, name: str, epoch: int) -> str:
        return os.path.join(self.base, name, f"epoch={epoch}")

    def _state(self, name: str, schema: str, epoch: int) -> DataFrame:
        """The table as the previous epoch left it."""
        if epoch == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(name, epoch - 1))

    def _write(self, name: str, df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(self._path(name, epoch))


def _typed(df: DataFrame, schema: str) -> DataFrame:
    """Columns in the order and types of a state table."""
    fields = [part.strip().split(" ") for part in schema.split(",")]
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in fields])
