"""Snapshots compared, status kept, sources reloaded, merged views rebuilt.

A snapshot is ``source_id, file_id, size, mtime``; status is ``source_id, generation, status, change_kind``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.timeline import merged_timeline

CHANGED = ("Shrunk", "Replaced", "Deleted")


def compare_snapshots(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """Verdict per source: ``Replaced, Shrunk, Appended, Unchanged, Deleted`` or, for an unseen one, ``New``.

    The modification time does not count. An unknown identity (NULL) counts as the same file.
    """
    before = old.select(key, F.col("file_id").alias("_old_id"), F.col("size").alias("old_size"))
    after = new.select(key, F.col("file_id").alias("_new_id"), F.col("size").alias("new_size"))
    verdict = (
        F.when(F.col("new_size").isNull(), "Deleted")
        .when(F.col("old_size").isNull(), "New")
        .when(F.col("_old_id") != F.col("_new_id"), "Replaced")
        .when(F.col("new_size") < F.col("old_size"), "Shrunk")
        .when(F.col("new_size") > F.col("old_size"), "Appended")
        .otherwise("Unchanged")
    )
    return before.join(after, key, "full_outer").select(key, "old_size", "new_size", verdict.alias("verdict"))


def refresh_status(status: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Status after a check (``source_id, verdict, read_error``): changed is sticky, a failed read is an error."""
    joined = status.join(verdicts.select("source_id", "verdict", "read_error"), "source_id", "left")
    sticky = F.col("status") == "Changed"
    changed = F.col("verdict").isin(*CHANGED)
    checked = F.col("verdict").isNotNull() | F.col("read_error").isNotNull()
    new_status = (
        F.when(sticky, "Changed")
        .when(~checked, F.col("status"))
        .when(F.col("read_error").isNotNull(), "Error")
        .when(changed, "Changed")
        .otherwise("Loaded")
    )
    new_kind = F.when(sticky, F.col("change_kind")).when(
        F.col("read_error").isNull() & changed, F.col("verdict")
    )
    # Turning changed empties the source's items, which makes a new generation.
    bump = (~sticky & F.col("read_error").isNull() & F.coalesce(changed, F.lit(False))).cast("bigint")
    return joined.select(
        "source_id",
        (F.col("generation") + F.coalesce(bump, F.lit(0))).alias("generation"),
        new_status.alias("status"),
        new_kind.alias("change_kind"),
    )


def reload_status(status: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Status after an explicit reload, and ``action``: ``keep``, ``rebuild`` or ``empty``.

    Unchanged keeps generation and status; appended rebuilds the whole source;
    shrunk, replaced and deleted sources are emptied; both count the generation up.
    """
    joined = status.join(verdicts.select("source_id", "verdict"), "source_id", "left")
    changed = F.col("verdict").isin(*CHANGED)
    action = F.when(changed, "empty").when(F.col("verdict") == "Appended", "rebuild").otherwise("keep")
    moved = joined.withColumn("action", action)
    return moved.select(
        "source_id",
        (F.col("generation") + (F.col("action") != "keep").cast("bigint")).alias("generation"),
        F.when(F.col("action") == "empty", "Changed")
        .when(F.col("action") == "rebuild", "Loaded")
        .otherwise(F.col("status"))
        .alias("status"),
        F.when(F.col("action") == "empty", F.col("verdict"))
        .when(F.col("action") == "keep", F.col("change_kind"))
        .alias("change_kind"),
        "action",
    )


def reload_sources(items: DataFrame, rebuilt: DataFrame, after: DataFrame) -> DataFrame:
    """Current items after a reload: kept sources as they are, rebuilt ones from ``rebuilt``, emptied ones gone.

    ``after`` comes from :func:`reload_status`. To a stored index only ``rebuilt`` is
    appended, as a new generation; see ``store.reload``.
    """
    def of(action: str) -> DataFrame:
        return after.filter(F.col("action") == action).select("source_id", "generation")

    return items.join(of("keep"), "source_id").unionByName(rebuilt.join(of("rebuild"), "source_id"))


def resync_timeline(items: DataFrame, status: DataFrame, sources: DataFrame, generation: int) -> tuple[DataFrame, int]:
    """Merge anew over loaded sources; the view's generation counts up by one."""
    loaded = status.filter(F.col("status").isin("Loaded", "CancelledPartial")).select("source_id")
    return merged_timeline(items.join(loaded, "source_id", "left_semi"), sources), generation + 1


def built_from(status: DataFrame) -> DataFrame:
    """The (source, generation) pairs a merged view made now would rest on."""
    return status.filter(F.col("status").isin("Loaded", "CancelledPartial")).select("source_id", "generation")


def timeline_staleness(recorded: DataFrame, status: DataFrame) -> DataFrame:
    """Pairs on one side only, with ``side``; no rows means the view is current."""
    now = built_from(status)
    pairs = ["source_id", "generation"]
    gone = recorded.select(*pairs).exceptAll(now).withColumn("side", F.lit("recorded_only"))
    return gone.unionByName(now.exceptAll(recorded.select(*pairs)).withColumn("side", F.lit("current_only")))


def list_sources(
    status: DataFrame, sources: DataFrame, manifest: DataFrame, tails: DataFrame | None = None, verdicts: DataFrame | None = None
) -> DataFrame:
    """The status listing, by ``source_id``.

    ``tails`` (``source_id, unconfirmed_tail``) tells of unfinished last lines; an update is pending where ``verdicts``
    (``source_id, verdict``) say that the file has grown since it was read.
    """
    listed = status.join(sources.select("source_id", "label"), "source_id", "left").join(
        manifest.select("source_id", F.col("size").alias("size_bytes")), "source_id", "left"
    )
    no = F.lit(False)
    open_tail, pending = no, no
    if tails is not None:
        listed, open_tail = listed.join(tails.select("source_id", "unconfirmed_tail"), "source_id", "left"), F.col("unconfirmed_tail")
    if verdicts is not None:
        listed, pending = listed.join(verdicts.select("source_id", "verdict"), "source_id", "left"), F.col("verdict") == "Appended"
    return listed.select(
        "source_id", "label", "generation", "status", "change_kind", "size_bytes",
        F.coalesce(open_tail, no).alias("has_unconfirmed_trailing_line"), F.coalesce(pending, no).alias("update_pending"),
    ).orderBy("source_id")
