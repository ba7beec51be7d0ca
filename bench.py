"""Headline timings; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores. Log files are made from ``events``, repeated
``BENCH_COPIES`` times with new ids, before anything is timed.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from timberline.functions.datetime import DAY_MS
from timberline.operators import ranges, search, summary, timeline
from timberline.plans import derive, ingest
from timberline.plans.ingest import open_logs
from timberline.session import build_session, fresh_path, stored
from timberline.sources import search_store, store, timeline_store

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
COPIES = int(os.environ.get("BENCH_COPIES", "20"))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=str(4 * int(CPUS)),
        spark__ui__enabled="false",
        spark__driver__memory="12g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="timberline-bench-"),
        spark__sql__files__maxPartitionBytes="16m",
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name, work):
        start = time.perf_counter()
        result = work()
        took[name] = round(time.perf_counter() - start, 3)
        return result

    def write_logs(sf_dir: str, copies: int) -> str:
        lines = derive.log_lines(spark, sf_dir, copies)
        root = fresh_path(spark, "logs")
        placed = lines.repartition("source_id").sortWithinPartitions("source_id", "line_no")
        placed.select("source_id", "text").write.partitionBy("source_id").text(root)
        return root

    def configured_in(root: str):
        paths = spark.read.text(root).select(F.col("_metadata.file_path").alias("path")).distinct()
        return stored(derive.configured_from_folders(paths), "configured")

    # A small run of the main steps first: the figures are for a session that is up, not for loading classes.
    for _ in range(2):
        small = configured_in(write_logs(SF_DIR, 1))
        warm = open_logs(spark, small)
        run(timeline.merged_timeline(warm.items, small.withColumn("source_ordinal", F.col("config_pos"))))
        run(search.filter_text(warm.item_lines(), "at frame 3"))
    configured = configured_in(write_logs(SF_DIR, COPIES))

    def load_index() -> tuple:
        opened = open_logs(spark, configured)
        return opened, opened.items.count()

    opened, item_count = timed("load_index", load_index)
    line_count, items = opened.lines.count(), opened.items

    def merge():
        path = fresh_path(spark, "timeline")
        view = timeline.merged_timeline(items, configured.withColumn("source_ordinal", F.col("config_pos")))
        view.write.parquet(path)
        return spark.read.parquet(path)

    view = timed("merge_timeline", merge)
    total = view.count()
    timed("fetch_range_head", lambda: timeline.fetch_range(view, 0, total=total).collect())
    timed("fetch_range_middle", lambda: timeline.fetch_range(view, total // 2, total=total).collect())
    timed("fetch_range_tail", lambda: timeline.fetch_range(view, total - 300, total=total).collect())
    timed("write_items", lambda: store.write_items(items, fresh_path(spark, "items")))
    timed("page_directory", lambda: run(summary.page_directory(view)))
    timed("source_summary", lambda: opened.summary().collect())
    picked = derive.part_ranges(spark, SF_DIR)
    timed("extract_ranges", lambda: run(ranges.extract_ranges(view, picked)))
    timed("normalize_ranges", lambda: run(ranges.normalize_ranges(derive.order_ranges(spark, SF_DIR), ["selection_id"])))
    first_day = items.agg(F.min("key_ms")).first()[0]
    timed("filter_time_range", lambda: run(search.filter_time_range(items, first_day, first_day + DAY_MS)))
    even, odd = items.filter("source_id % 2 = 0"), items.filter("source_id % 2 = 1")
    timed("time_correlate", lambda: run(search.time_correlate(even, odd, 1000)))
    samples = derive.table(spark, SF_DIR, "events").select((F.col("event_id") % 4).alias("variant"), F.col("value").alias("ms"))
    timed("latency_summary", lambda: run(summary.latency_summary(samples)))

    def bodies():
        run(search.filter_text(opened.item_lines(), "at frame 3"))

    timed("filter_text_with_bodies", bodies)
    headline = dict(took)
    took.clear()

    # What stands beside the headlines: search from a store, a view updated by ranges, a check and a reload of files that hardly changed.
    kept = stored(items, "items")
    searched, viewed, held = (fresh_path(spark, name) for name in ("search", "view", "held"))
    ordinals = configured.withColumn("source_ordinal", F.col("config_pos"))
    timed("write_search", lambda: search_store.write_search(opened.item_lines(), searched))
    timed("find_text_with_bodies", lambda: run(search_store.find_text(spark, searched, "at frame 3", kept)))
    timed("find_text_rare", lambda: run(search_store.find_text(spark, searched, "user=77 v=1", kept)))
    timed("write_view", lambda: timeline_store.write_view(kept, ordinals, viewed))
    last = kept.filter("source_id = 0").agg(F.max("seq").alias("from_seq")).select(F.lit(0).alias("source_id"), "from_seq")
    tail = kept.join(F.broadcast(last), "source_id").filter("seq >= from_seq").drop("from_seq")
    timed("update_view", lambda: timeline_store.update_view(spark, viewed, last, tail, ordinals))
    timed("fetch_page", lambda: timeline_store.fetch_page(spark, viewed, total // 2).collect())
    store.write_items(kept, held)
    seen = ingest.snapshot_files(spark, configured)
    before = stored(seen.join(opened.resume_points(), "source_id", "left"), "before")
    status = configured.select("source_id", F.lit(1).cast("bigint").alias("generation"), F.lit("Loaded").alias("status"), F.lit(None).cast("string").alias("change_kind"))
    timed("check_files", lambda: ingest.snapshot_files(spark, configured, seen).collect())
    grown = configured.filter("source_id = 0").first()["path"].removeprefix("file:")
    with open(grown, "a") as f:
        f.write("  more of the last item\n" * 1000)
    timed("reload_read_on", lambda: ingest.reload_files(spark, configured, held, status, before))
    more, took = took, headline
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "beside": more,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "lines": line_count,
                "items": item_count,
                "load_lines_per_sec": round(line_count / took["load_index"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
