"""Counts of snapshots, sites and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def method_counts(pages: DataFrame, *by: str) -> DataFrame:
    """Pages by fetch method; skipped pages count under the method they were asked for with."""
    return pages.groupBy(*by, "fetch_method").agg(F.count(F.lit(1)).alias("pages"))


def fetch_summary(pages: DataFrame, *by: str) -> DataFrame:
    """Attempted, stored, skipped and reused pages and their bytes; tombstones weren't attempted."""
    tried = pages.where(~F.col("status").eqNullSafe("removed"))
    grouped = tried.groupBy(*by) if by else tried.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("page_path").isNotNull()).alias("stored_pages"),
        F.count_if(F.startswith("status", F.lit("skipped"))).alias("skipped_pages"), F.count_if(F.col("status") == "reused_not_modified").alias("reused_pages"),
        F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"),
    )


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """(source_name, snapshot_label): the label of each source that is greatest in byte order, as folders are listed."""
    return snapshots.groupBy("source_name").agg(F.max("snapshot_label").alias("snapshot_label"))


def previous_snapshot(snapshots: DataFrame, current: str = "snapshot_label") -> DataFrame:
    """Each distinct snapshot with the greatest other label of its source; null if it is the only one."""
    rows = snapshots.select("source_name", F.col(current).alias("snapshot_label")).distinct()
    # the two greatest labels of a source decide for all of them, so nothing is sorted or paired
    top = rows.groupBy("source_name").agg(F.max("snapshot_label").alias("first"))
    second = rows.join(top, "source_name").where("snapshot_label <> first").groupBy("source_name").agg(F.max("snapshot_label").alias("second"))
    best = top.join(second, "source_name", "left")
    return rows.join(best, "source_name").select("source_name", "snapshot_label", F.when(F.col("snapshot_label") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("previous_label"))


def site_overview(pages: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row per source: its latest snapshot with page, change and rating counts. The global report doesn't count chunks."""
    latest = latest_snapshots(snapshots)
    mine = pages.join(latest, ["source_name", "snapshot_label"])
    counts = mine.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("page_count"), F.count_if(F.col("change_status").isin("new", "changed")).alias("changed_pages"),
        F.count_if(F.col("change_status") == "removed").alias("removed_pages"), F.count_if(F.col("quality.rating") == "low").alias("low_quality_pages"),
    )
    return latest.join(counts, "source_name", "left").select(
        "source_name", "snapshot_label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("page_count", "changed_pages", "removed_pages", "low_quality_pages")], F.lit(0).cast("bigint").alias("chunk_count")
    )


def snapshot_message(summary: DataFrame) -> DataFrame:
    """(source_name, snapshot_label, message): a chat message of a snapshot's counts; new pages count as changed."""
    counts = ["discovered_pages", "stored_pages", "changed_pages", "unchanged_pages", "removed_pages", "high_quality_pages", "medium_quality_pages", "low_quality_pages"]
    text = F.format_string(
        "snapshot\nsource: %s\nsnapshot: %s\nstatus: %s\npages: discovered=%d stored=%d changed=%d unchanged=%d removed=%d\nquality: high=%d medium=%d low=%d\nentry: %s",
        "source_name", "snapshot_label", "status", *[F.coalesce(c, F.lit(0)).cast("bigint") for c in counts], "entry_url",
    )
    return summary.select("source_name", "snapshot_label", text.alias("message"))
