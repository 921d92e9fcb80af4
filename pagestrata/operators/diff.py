"""Comparing a snapshot's pages with those of the one before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.functions.text import sha256_hex


def content_hash(stored: Column, content: Column) -> Column:
    """The stored hash, or that of the content where none is stored."""
    return F.coalesce(stored, sha256_hex(content))


def previous_rows(previous: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """(by, lookup, previous): each earlier page, as a struct of ``columns``, by its key, its URL and its final URL.

    ``previous`` has page_key, url, final_url and idx, its place in the manifest. Of several pages for one lookup
    the last holds, and of one page the final URL before the URL before the key. What ``previous`` lacks is null.
    """
    ways = F.array(*[F.struct(F.col(c).alias("lookup"), F.lit(k).alias("way")) for k, c in enumerate(("page_key", "url", "final_url"))])
    held = F.struct(*[F.col(c) if c in previous.columns else F.lit(None).alias(c) for c in columns])
    long = previous.select(*by, "idx", held.alias("held"), F.inline(ways)).where("lookup IS NOT NULL AND lookup <> ''")
    return long.groupBy(*by, "lookup").agg(F.max_by("held", F.struct("idx", "way")).alias("previous"))


def previous_index(previous: DataFrame, *by: str) -> DataFrame:
    """(by, lookup, page_key, hash, idx) of each earlier page by its key, its URL and its final URL."""
    rows = previous_rows(previous, ["page_key", "sha256", "idx"], *by)
    return rows.select(*by, "lookup", "previous.page_key", F.col("previous.sha256").alias("hash"), "previous.idx")


def classify(has_previous: Column, before: Column, now: Column, git: bool = False) -> Column:
    """new, changed or unchanged; an earlier page without hash counts as new, in git mode as changed."""
    fresh = ~has_previous if git else ~has_previous | before.isNull()
    return F.when(fresh, "new").when(before.eqNullSafe(now) & before.isNotNull(), "unchanged").otherwise("changed")


def diff_pages(current: DataFrame, previous: DataFrame, lookup: str = "url", git: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """The current pages with ``change_status`` and ``previous_hash``, and the earlier pages that are gone as ``removed``.

    ``current`` has page_key, sha256 and the lookup column; rows whose sha256 is null were skipped: their status is
    unknown and they don't count as removed. Removed pages come once per key, with their last hash. With ``by``
    many snapshots are compared at once, each with the earlier pages of the same ``by``.
    """
    index = previous_index(previous, *by).select(*by, F.col("lookup").alias("__lookup"), F.col("hash").alias("previous_hash"), F.lit(True).alias("__known"))
    joined = current.withColumn("__lookup", F.col(lookup)).join(index, [*by, "__lookup"], "left")
    status = F.when(F.col("sha256").isNull(), "unknown").otherwise(classify(F.col("__known").isNotNull(), F.col("previous_hash"), F.col("sha256"), git))
    kept = joined.select(*by, "page_key", "sha256", "previous_hash", status.alias("change_status"))
    gone = previous.join(current.select(*by, "page_key").distinct(), [*by, "page_key"], "left_anti")
    last = gone.groupBy(*by, "page_key").agg(F.max(F.struct("idx", "sha256")).alias("p"))
    removed = last.select(*by, "page_key", F.lit(None).cast("string").alias("sha256"), F.col("p.sha256").alias("previous_hash"), F.lit("removed").alias("change_status"))
    return kept.unionByName(removed)


def summarize(changes: DataFrame, *by: str) -> DataFrame:
    """Pages by change; skipped ones aren't counted, and what is new or changed is a candidate for import."""
    count = lambda *of: F.count_if(F.col("change_status").isin(*of))
    grouped = changes.groupBy(*by) if by else changes.groupBy()
    return grouped.agg(
        count("new").alias("new_pages"), count("changed").alias("changed_pages"), count("unchanged").alias("unchanged_pages"),
        count("removed").alias("removed_pages"), count("new", "changed").alias("import_candidates"),
    )


#: What a page that wasn't fetched again keeps of the earlier one.
CARRIED = ["page_key", "fetch_method", "content_type", "sha256", "raw_sha256", "etag", "last_modified", "byte_size", "normalization", "quality", "page_path", "snapshot_label"]


def reuse(current: DataFrame, previous: DataFrame, lookup: str = "url", by: tuple[str, ...] = ()) -> DataFrame:
    """The current rows with ``previous``, the whole earlier page found by its key, URL or final URL, null if there is none."""
    index = previous_rows(previous, CARRIED, *by).withColumnRenamed("lookup", "__lookup")
    return current.withColumn("__lookup", F.col(lookup)).join(index, [*by, "__lookup"], "left").drop("__lookup")
