"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position.

DataFrame functions only. Lines travel as two 64-bit hashes; text is read twice and shuffled once, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import BLANKS, LOWER, UPPER, lower_ascii, table
from timberline.session import stored

ROW_KEY = ["_ld_id", "_ld_text", "_ld_size"]


def line_key(line: Column) -> Column:
    """A line without blanks at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _whole(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def row_key(doc_id: str, text: str) -> list[Column]:
    """Names a row by id and content, so that rows which repeat an id keep their own lines."""
    return [
        F.col(doc_id).alias("_ld_id"),
        F.xxhash64(_whole(text)).alias("_ld_text"),
        F.octet_length(_whole(text)).alias("_ld_size"),
    ]


def line_hashes(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """Row key, position and the two hashes of every line whose key has ``min_chars`` code points."""
    lines = docs.select(*row_key(doc_id, text), F.posexplode(F.split(_whole(text), "\n", -1)).alias("pos", "line"))
    keyed = lines.select(*ROW_KEY, "pos", line_key(F.col("line")).alias("key"))
    # The leading constant seeds the second hash, which makes the two independent.
    return keyed.filter(F.length("key") >= min_chars).select(
        *ROW_KEY, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2")
    )


def repeated_hashes(lines: DataFrame, min_docs: int) -> DataFrame:
    """Hashes that at least ``min_docs`` documents hold, with the largest id holding each.

    A document counts once per hash; both steps combine before they shuffle, so a line that is in every
    document sends one row per task.
    """
    once = lines.groupBy("h1", "h2", "_ld_id").agg(F.lit(1).alias("one"))
    return (
        once.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("_ld_id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
    )


def drop_repeated_lines(
    docs: DataFrame,
    min_chars: int = 20,
    min_docs: int = 3,
    doc_id: str = "doc_id",
    text: str = "text",
    into: str = "kept_text",
) -> DataFrame:
    """All rows and columns of ``docs`` with ``n_lines``, ``n_dropped`` and the kept lines as ``into``.

    A line goes if its key (``line_key``) has at least ``min_chars`` code points, at least ``min_docs`` distinct ids
    hold it, and this row's id is not the largest of them. Null or empty text is one empty line. Rows that
    repeat an id count as one document; a null id counts as one document that is never the largest. Columns of
    ``docs`` named like a result are replaced. An empty table gives an empty table.
    """
    lines = stored(line_hashes(docs, doc_id, text, min_chars), "lines")
    over = repeated_hashes(lines, min_docs).select("h1", "h2", "keeper")
    dropped = (
        lines.join(over, ["h1", "h2"])
        .filter(~F.col("_ld_id").eqNullSafe(F.col("keeper")))
        .groupBy(*ROW_KEY)
        .agg(F.array_sort(F.collect_set("pos")).alias("drops"))
        .select(*[F.col(c).alias(c + "_d") for c in ROW_KEY], "drops")
    )
    same = [F.col(c).eqNullSafe(F.col(c + "_d")) for c in ROW_KEY]
    own = [c for c in docs.columns if c not in (into, "n_lines", "n_dropped")]
    keyed = docs.select(*[F.col(c) for c in own], _whole(text).alias("_ld_whole"), *row_key(doc_id, text))
    joined = keyed.join(dropped, same[0] & same[1] & same[2], "left")
    # One flag byte per line up to the last dropped one: looked up in constant time, however long the text is.
    gap = lambda p, i: F.concat(
        F.repeat(F.lit("0"), p - F.coalesce(F.get("drops", i - 1), F.lit(-1)) - 1), F.lit("1")
    )
    flagged = joined.withColumn("_ld_flags", F.array_join(F.transform("drops", gap), "").cast("binary")).withColumn(
        "_ld_lines", F.split("_ld_whole", "\n", -1)
    )
    stays = lambda _, i: F.coalesce(
        F.substring(F.col("_ld_flags"), i + 1, F.lit(1)) != F.lit(b"1"), F.lit(True)
    )
    kept = F.when(F.col("drops").isNull(), F.col("_ld_whole")).otherwise(
        F.array_join(F.filter("_ld_lines", stays), "\n")
    )
    return flagged.select(
        *own,
        F.size("_ld_lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("bigint").alias("n_dropped"),
        kept.alias(into),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = f"""
WITH split AS (
  SELECT doc_id, rn, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos
  FROM (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rn FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM split
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rn, doc_id
"""
