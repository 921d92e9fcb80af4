"""Which pages of a snapshot are imported: eligible ones, one per content, of enough signal, in chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.functions.text import ascii_lower


def eligible(all_pages: bool, has_previous: Column) -> Column:
    """A stored page that is new, changed or of unknown change, or any stored page if asked for or without an earlier snapshot."""
    stored = F.col("page_path").isNotNull()
    fresh = F.coalesce(F.col("change_status").isin("new", "changed", "unknown"), F.lit(True))
    return stored if all_pages else stored & (~has_previous | fresh)


def canonical_key() -> Column:
    """What the canonical page of a group is the least of: plain, short and shallow addresses first."""
    address = F.coalesce(F.nullif("final_url", F.lit("")), F.nullif("url", F.lit("")), F.replace("page_path", F.lit("\\"), F.lit("/")), F.lit(""))
    plain = F.regexp_replace(address, "/+$", "")
    lower = ascii_lower(plain)
    depth = F.size(F.filter(F.split(plain, "/"), lambda s: (s != "") & ~s.contains(":")))
    return F.struct(
        plain.rlike("[?#]").cast("int").alias("queried"), lower.endswith(".md").cast("int").alias("markdown"), lower.rlike("/index([.]md)?$").cast("int").alias("indexed"),
        depth.alias("depth"), F.octet_length(plain).alias("bytes"), plain.alias("address"),
    )


def mark_duplicates(pages: DataFrame, order: str = "idx", *by: str) -> DataFrame:
    """Adds ``canonical_idx`` and ``is_canonical``: of the pages with one sha256 the canonical one comes first.

    Pages without hash are groups of their own. The canonical page is found with a mergeable minimum and joined
    back, so that a content found on very many pages isn't sorted in one task.
    """
    group = F.coalesce("sha256", F.concat(F.lit("row:"), F.col(order).cast("string")))
    keyed = pages.withColumn("__group", group)
    best = keyed.groupBy(*by, "__group").agg(F.min(F.struct(canonical_key().alias("k"), F.col(order).alias("idx")))["idx"].alias("canonical_idx"), F.count(F.lit(1)).alias("group_size"))
    joined = keyed.join(best, [*by, "__group"])
    return joined.withColumn("is_canonical", F.col("canonical_idx") == F.col(order)).drop("__group")


def with_status(marked: DataFrame, include_low_signal: bool = False) -> DataFrame:
    """Adds ``item_status``; the signal is judged after the canonical page is chosen, so a weak one skips its group."""
    weak = F.coalesce(F.col("low_signal"), F.lit(False)) & F.lit(not include_low_signal)
    return marked.withColumn("item_status", F.when(~F.col("is_canonical"), "skipped_duplicate").when(weak, "skipped_low_signal").otherwise("planned"))


def plan(pages: DataFrame, all_pages: bool = False, include_low_signal: bool = False, has_previous: Column | None = None) -> DataFrame:
    """Each eligible page with its item status: planned, skipped_duplicate or skipped_low_signal.

    ``pages`` has idx, page_key, url, final_url, page_path, sha256, change_status and low_signal (null passes).
    """
    earlier = F.lit(True) if has_previous is None else has_previous
    return with_status(mark_duplicates(pages.where(eligible(all_pages, earlier))), include_low_signal)


def artifacts(planned: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(page_key, idx, ordinal, artifact): the chunks of each planned page in order, or the page itself if it has none."""
    pages = planned.where("item_status = 'planned'").select("page_key", "idx", "page_path")
    if chunks is None:
        return pages.select("page_key", "idx", F.lit(0).cast("bigint").alias("ordinal"), F.col("page_path").alias("artifact"))
    parts = chunks.select("page_key", "ordinal", F.col("chunk_id").alias("__chunk"))
    joined = pages.join(parts, "page_key", "left")
    return joined.select("page_key", "idx", F.coalesce("ordinal", F.lit(0).cast("bigint")).alias("ordinal"), F.coalesce("__chunk", "page_path").alias("artifact"))


def counters(pages: DataFrame, planned: DataFrame, parts: DataFrame, all_pages: bool = False) -> DataFrame:
    """One row of counts: pages, skipped as unchanged, duplicate or weak, selected pages and their artifacts."""
    unchanged = F.lit(0) if all_pages else F.count_if(F.col("change_status") == "unchanged")
    one = pages.agg(F.count(F.lit(1)).alias("total_pages"), unchanged.cast("bigint").alias("skipped_unchanged"))
    two = planned.agg(
        F.count_if(F.col("item_status") == "planned").alias("selected_pages"), F.count_if(F.col("item_status") == "skipped_duplicate").alias("skipped_duplicates"),
        F.count_if(F.col("item_status") == "skipped_low_signal").alias("skipped_low_signal"),
    )
    three = parts.agg(F.count(F.lit(1)).alias("selected_artifacts"))
    key = F.lit(1).alias("__one")
    return one.select(key, "*").join(two.select(key, "*"), "__one").join(three.select(key, "*"), "__one").drop("__one")


def deliver(parts: DataFrame, send) -> DataFrame:
    """Calls ``send(page_key, artifact) -> bool`` for each artifact on the executors.

    Returns (page_key, artifacts, failed): a page fails if any artifact does. ``send`` may run again for the same
    artifact if an executor is lost, so it must be safe to repeat.
    """
    import pandas as pd

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"page_key": batch["page_key"], "ok": [bool(send(k, a)) for k, a in zip(batch["page_key"], batch["artifact"])]})

    done = parts.select("page_key", "artifact").mapInPandas(run, "page_key string, ok boolean")
    return done.groupBy("page_key").agg(F.count(F.lit(1)).alias("artifacts"), F.count_if(~F.col("ok")).alias("failed"))


def search(chunks: DataFrame, text: str) -> DataFrame:
    """Chunks that contain a text, letter case aside; a convenience beside external retrieval."""
    return chunks.where(F.contains(F.lower("markdown"), F.lit(text.lower())))



