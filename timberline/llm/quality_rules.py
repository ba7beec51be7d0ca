"""Quality rules: fixed limits, then gradient-boosted trees over document statistics with monotonic constraints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import giving_back, table
from timberline.llm.textstats import COUNTS, RATES, groups_of, rates, text_counts, with_counts
from timberline.llm.trees import Forest, boost

#: Labelled rows a model is trained on, at most.
SAMPLE_ROWS = 20_000
#: More symbols, repeats, capitals or exclamation marks never make a text better.
FALLING = ("symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "mark_rate")
MIN_WORDS = 10


def training_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS, label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """``RATES`` and labels of at most ``most`` labelled documents, the first by hash of their id.

    Rows without label or id are left out; of labels that repeat an id the largest counts, of rows that repeat one the text of the least hash. Only the
    sample's ids, at most ``most``, are broadcast, and only its statistics, a row per id, come to the driver.
    """
    chosen = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col(label).cast("int").alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(most)
    met = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    # Map-side, each task keeps one text of an id, however many rows have it.
    one = met.groupBy("_id").agg(F.max("_y").alias("_y"), F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text"))).alias("least"))
    rows = one.select(F.struct("_id", "_y").alias("doc_id"), F.col("least.text").alias("text"))
    found = with_counts(rows).select("doc_id.*", *COUNTS).toPandas().sort_values(["_id", *COUNTS])
    return rates(found[list(COUNTS)].to_numpy(np.int64)), found["_y"].to_numpy(np.float64)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Forest:
    x, y = training_sample(docs, labels, most)
    falls = np.array([-1 if name in FALLING else 0 for name in RATES])
    return boost(x, y, direction=falls)


def judge_quality(docs: DataFrame, forest: Forest, threshold: float = 0.3, keep_columns: bool = False) -> DataFrame:
    """Per row: ``doc_id``, the base statistics, ``base_failed``, ``score`` and ``kept``; with ``keep_columns`` all columns of ``docs`` as well.

    ``base_failed``: fewer than 10 words, or more than a fifth of them in five-word windows found twice or more in the text.
    ``kept``: not ``base_failed`` and a score of at least ``threshold``. A null text has no words. Rows that repeat an id are
    judged one by one. Columns of ``docs`` named like a result are replaced. Without training rows every text scores one half.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    added = [*names, "base_failed", "score", "kept"]
    own = [c for c in (docs.columns if keep_columns else ["doc_id"]) if c not in added]
    kinds = {"base_failed": BooleanType(), "score": DoubleType(), "kept": BooleanType()}
    schema = StructType([*[docs.schema[c] for c in own], *[StructField(c, kinds.get(c, LongType())) for c in added]])
    arrow = to_arrow_schema(schema)
    n = len(own)
    text_at = own.index("text") if "text" in own else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, texts in groups_of(batch, text_at):
                counts = text_counts(texts)
                score = forest.score(rates(counts))
                failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > 20 * counts[:, 0])
                columns = [*[batch.column(k).slice(begin, end - begin) for k in range(n)], *[pa.array(counts[:, COUNTS.index(c)]) for c in names]]
                columns += [pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select(*own, *[F.col("text").alias("_text")] * (text_at == n)).mapInArrow(lambda batches: giving_back(run(batches)), schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_quality(docs, train(docs, table(spark, sf_dir, "labels")))
