"""The stored item index and extracts written as text.

Items are Parquet, partitioned by generation only and clustered by (source, seq) inside it: a reload
appends a generation for the sources it rebuilt and touches nothing else, a page read is pruned by
row-group statistics, and the number of folders does not grow with the number of sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators.changes import reload_status
from timberline.operators.timeline import check_generation
from timberline.session import small_side, stored

#: Where a generation's items lie, for generations that continue an earlier one; and the parts of one generation, at most.
PARTS = "source_id INT, generation BIGINT, stored_in BIGINT, from_seq BIGINT, to_seq BIGINT"
MOST_PARTS = 16


def write_items(items: DataFrame, path: str, generation: int = 1, mode: str = "append") -> None:
    """Store items as one generation, clustered for page reads."""
    _clustered(items.withColumn("generation", F.lit(generation).cast("bigint")), path, mode)


def _clustered(items: DataFrame, path: str, mode: str) -> None:
    items.repartitionByRange("source_id", "seq").sortWithinPartitions("source_id", "seq").write.mode(mode).partitionBy(
        "generation"
    ).parquet(path)


def read_items(spark: SparkSession, path: str, status: DataFrame) -> DataFrame:
    """Items of each source's current generation, which may lie in parts that earlier generations stored."""
    current = status.select("source_id", F.col("generation").cast("bigint").alias("generation"))
    parts = small_side(parts_of(spark, path, current), row_bytes=40, few=True)
    stored_items = spark.read.parquet(path)
    columns = [c for c in stored_items.columns if c != "generation"]
    held = stored_items.withColumnRenamed("generation", "stored_in").withColumn("stored_in", F.col("stored_in").cast("bigint"))
    inside = held.join(parts, ["source_id", "stored_in"]).filter((F.col("seq") >= F.col("from_seq")) & (F.col("to_seq").isNull() | (F.col("seq") < F.col("to_seq"))))
    return inside.select("source_id", "generation", *[c for c in columns if c != "source_id"])


def parts_of(spark: SparkSession, path: str, current: DataFrame) -> DataFrame:
    """Where the items of ``current`` (``source_id, generation``) lie: ``source_id, generation, stored_in, from_seq, to_seq``.

    A generation without an entry is whole and stored under its own number.
    """
    told = _parts_path(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(told)
    there = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)
    known = spark.read.schema(PARTS).parquet(told) if there else spark.createDataFrame([], PARTS)
    own = F.col("stored_in").isNull()
    return current.join(known, ["source_id", "generation"], "left").select(
        "source_id", "generation", F.when(own, F.col("generation")).otherwise(F.col("stored_in")).alias("stored_in"),
        F.coalesce("from_seq", F.lit(0).cast("bigint")).alias("from_seq"), "to_seq",
    )


def _parts_path(path: str) -> str:
    return path.rstrip("/") + ".parts"


def reload(path: str, rebuilt: DataFrame, status: DataFrame, verdicts: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Append what was rebuilt under its new generation and return the new status table.

    Emptied sources get a generation without rows. ``ends`` (``source_id, from_seq``) names rebuilt sources of which only the items from a number on were
    made again: what comes before stays where it is stored, and only entries that say so are written. A generation of more than ``MOST_PARTS`` parts
    is stored anew as one. Store the status only after this returns: until then readers see the old generations.
    """
    spark = rebuilt.sparkSession
    after = reload_status(status, verdicts)
    fresh = after.filter(F.col("action") == "rebuild").select("source_id", "generation")
    if ends is not None:
        cut = stored(fresh.join(ends.select("source_id", F.col("from_seq").cast("bigint").alias("cut")), "source_id"), "cuts")
        before = status.join(cut.select("source_id"), "source_id", "left_semi").select("source_id", F.col("generation").cast("bigint").alias("generation"))
        held = parts_of(spark, path, before).drop("generation").join(cut, "source_id").filter("from_seq < cut")
        kept = held.withColumn("to_seq", F.least(F.coalesce("to_seq", F.col("cut")), F.col("cut")))
        last = cut.select("source_id", F.col("generation").alias("stored_in"), F.col("cut").alias("from_seq"), F.lit(None).cast("bigint").alias("to_seq"), "cut", "generation")
        entries = stored(kept.unionByName(last), "parts")
        many = entries.groupBy("source_id").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_PARTS).select("source_id")
        many = stored(many, "many")
        if not many.isEmpty():
            old = read_items(spark, path, before.join(many, "source_id", "left_semi")).join(cut.select("source_id", "cut"), "source_id").filter("seq < cut")
            rebuilt = rebuilt.unionByName(old.select(*rebuilt.columns))
            entries = entries.join(small_side(many, 8), "source_id", "left_anti")
        entries.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in PARTS.split(", ")]).coalesce(1).write.mode("append").parquet(_parts_path(path))
    _clustered(rebuilt.join(small_side(fresh, row_bytes=16, few=True), "source_id"), path, "append")
    return after


def write_timeline(view: DataFrame, path: str, generation: int) -> None:
    """Store a merged view as one generation, sorted by position, so that a page read touches the matching row groups only."""
    placed = view.withColumn("view_generation", F.lit(generation).cast("bigint"))
    placed.repartitionByRange("position").sortWithinPartitions("position").write.mode("append").partitionBy("view_generation").parquet(path)


def read_timeline(spark: SparkSession, path: str, expected: int | None = None) -> tuple[DataFrame, int]:
    """The newest stored view and its generation; a caller that ``expected`` another one is refused."""
    views = spark.read.parquet(path)
    current = views.agg(F.max("view_generation")).first()[0]
    if expected is not None:
        check_generation(expected, current)
    return views.filter(F.col("view_generation") == current).drop("view_generation"), current


def extract_lines(positions: DataFrame, item_lines: DataFrame) -> DataFrame:
    """The text of selected items as lines in order: ``position, line_no, text``.

    Bodies are their lines joined with LF and items are joined with LF, so an extract is simply its lines.
    ``positions`` is ``position, source_id, seq``; ``item_lines`` is lines with ``seq``.
    """
    return item_lines.join(positions.select("position", "source_id", "seq"), ["source_id", "seq"]).select(
        "position", "line_no", "text"
    )


def write_extract(lines: DataFrame, path: str) -> None:
    """Write an extract as text parts whose names follow the order.

    The format ends each line with LF; the extract proper has none at its very end.
    """
    lines.repartitionByRange("position", "line_no").sortWithinPartitions("position", "line_no").select("text").write.option(
        "lineSep", "\n"
    ).text(path)


def extract_text(lines: DataFrame) -> DataFrame:
    """A small extract as one row, ``text``, ``items``, ``bytes``; judge it with ``extract_verdict`` first."""
    rows = F.array_sort(F.collect_list(F.struct("position", "line_no", "text")))
    joined = lines.agg(
        F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"), F.count_distinct("position").alias("items")
    )
    return joined.select("text", "items", F.octet_length("text").cast("bigint").alias("bytes"))
