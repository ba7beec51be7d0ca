"""From raw documents to training sequences: five operators of ``timberline.llm`` in a row.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows it is given; all but the last return the columns of
``docs``. ``run`` writes each stage's rows as Parquet in the shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import table
from timberline.llm.decontaminate import contaminated
from timberline.llm.line_dedup import drop_repeated_lines
from timberline.llm.minhash import near_duplicates
from timberline.llm.packing import pack
from timberline.llm.quality_rules import judge_quality, train
from timberline.session import small_side, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that fail the base limits or that the trees, trained on the labels, reject."""
    judged = judge_quality(docs, train(docs, table(spark, sf_dir, "labels")), keep_columns=True)
    return judged.filter("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of twenty and more characters that three documents hold stay only in the one with the largest id."""
    kept = drop_repeated_lines(docs, into="text")
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id, then text hash; a null id is the largest.

    Rows are told apart by id and text (``_keyed``), so null and repeated ids are decided row by row. Rows that are equal in both are one
    document and stay once, with the least of their other columns. Different rows without words stay.
    """
    keyed = _keyed(docs)
    found = near_duplicates(keyed.select("_row", "text"), doc_id="_row").groupBy(F.col("doc_id").alias("_row"))
    found = stored(found.agg(F.first("component_id").alias("component"), F.count(F.lit(1)).alias("copies")), "found")
    # Only groups of several rows need ids again.
    groups = found.groupBy("component").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("component")
    rank = F.struct(F.col("doc_id").isNull().alias("null_id"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    rows = keyed.select("doc_id", "_row").distinct().join(found.join(groups, "component").select("_row", "component"), "_row")
    rows = stored(rows.select("_row", "component", rank.alias("rank")), "ranked")
    first = rows.groupBy("component").agg(F.min("rank").alias("first"))
    gone = rows.join(first, "component").filter("_row <> first.row")
    left = _without(keyed, gone)
    twice = stored(found.filter("copies > 1").select("_row"), "twice")
    if not twice.isEmpty():
        more = left.join(small_side(twice, 8), "_row", "left_semi").groupBy("_row").agg(F.min(F.struct(*docs.columns)).alias("one"))
        left = _without(left, twice).select(*docs.columns).unionByName(more.select("one.*"))
    return left.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go that hold a passage of a benchmark item, and no others that share their id, null or not."""
    keyed = _keyed(docs)
    found = contaminated(keyed.select("_row", "text"), table(spark, sf_dir, "benchmark"), doc_id="_row")
    return _without(keyed, found.select(F.col("doc_id").alias("_row"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their place in sequences of 2048."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a 64-bit name of id, text and its size; a null id or text has a name of its own."""
    empty = [F.col(c).isNull() for c in ("doc_id", "text")]
    return docs.withColumn("_row", F.xxhash64(*empty, "doc_id", "text", F.octet_length("text")))


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    return keyed.join(small_side(gone.select("_row").distinct(), 8), "_row", "left_anti")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Trained scores, signatures and token ids cannot be put in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
