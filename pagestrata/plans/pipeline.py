"""From responses or files to a snapshot: the page rows, their chunks and the summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.functions import classify, urls
from pagestrata.functions.text import sha256_hex
from pagestrata.operators import chunk, diff, frontier, html, import_plan, normalize, quality, summary
from pagestrata.session import cut
from pagestrata.sources import files, store

QUALITY_COLUMNS = [
    "score", "rating", "word_count", "non_empty_lines", "text_lines", "heading_count", "code_block_count", "link_count", "residual_html_tags", "residual_mdx_components", "title_present", "text_density", "low_signal_reasons",
]


@dataclass
class Snapshot:
    """The tables of one snapshot; nothing is computed before one of them is written or collected."""

    pages: DataFrame
    chunks: DataFrame

    def diff(self) -> DataFrame:
        return diff.summarize(self.pages)

    def quality(self) -> DataFrame:
        flat = self.pages.where("quality IS NOT NULL").select("quality.*")
        return quality.summarize(flat)

    def fetch(self) -> DataFrame:
        return summary.fetch_summary(self.pages)


def _documents(rows: DataFrame, git: bool, previous: DataFrame | None) -> Snapshot:
    """The common part: rows with page_key, url, final_url, fetch_method, status, raw_sha256 and markdown (null if skipped).

    A row with ``held``, the earlier page of an answer that says it is unchanged, takes over what that page had.
    """
    clean = normalize.normalize_pages(rows.where("markdown IS NOT NULL").select("page_key", "markdown"), ["page_key"])
    scored = quality.score_pages(clean)
    texts = cut(scored.select(
        "page_key", "markdown", sha256_hex(F.col("markdown")).alias("sha256"), F.octet_length("markdown").cast("bigint").alias("byte_size"),
        F.struct(
            F.lit(True).alias("applied"), F.lit("markdown_cleanup_v2").alias("normalizer"), "profiles_applied", "changed", "boilerplate_blocks_removed", "component_wrappers_removed", "duplicate_headings_removed",
            "asset_lines_removed", "blank_lines_collapsed",
        ).alias("normalization"),
        F.struct(*[F.col(c).cast("float").alias(c) if c == "text_density" else F.col(c) for c in QUALITY_COLUMNS]).alias("quality"),
    ))
    pages = rows.drop("markdown").join(texts.drop("markdown"), "page_key", "left")
    kept = F.lit(False)
    if "held" in rows.columns:
        kept = F.col("held").isNotNull()
        types = dict(pages.dtypes)
        carry = [c for c in diff.CARRIED if c in types and c != "page_key"]
        pages = pages.withColumns({c: F.when(kept, F.col(f"held.{c}").cast(types[c])).otherwise(F.col(c)) for c in carry})
        pages = pages.withColumns({"reused_from_snapshot": F.col("held.snapshot_label"), "byte_size": F.when(kept & F.col("held.page_path").isNull(), 0).otherwise(F.col("byte_size"))})
    if previous is None:
        done = pages.withColumn("change_status", F.when(F.col("sha256").isNull(), "unknown").otherwise("new"))
    else:
        changes = diff.diff_pages(pages.select("page_key", "sha256", "url"), previous, "page_key" if git else "url", git).select("page_key", "change_status").distinct()
        done = pages.join(changes, "page_key", "full").withColumn("status", F.when(F.col("change_status") == "removed", "removed").otherwise(F.col("status")))
        if git and "snapshot_label" in previous.columns:
            label = previous.agg(F.max("snapshot_label").alias("label")).first().label  # one snapshot has one label
            done = done.withColumn("reused_from_snapshot", F.when(F.col("change_status") == "unchanged", F.lit(label)))
    stem = F.when(F.lit(git), F.regexp_replace("page_key", "[.]mdx?$", "")).otherwise(urls.storage_stem(F.col("final_url")))
    stored = F.col("sha256").isNotNull() & F.coalesce(~kept | F.col("held.page_path").isNotNull(), F.lit(True)) if "held" in rows.columns else F.col("sha256").isNotNull()
    if "held" in rows.columns:
        done = done.withColumn("change_status", F.when(F.coalesce(kept, F.lit(False)), "unchanged").otherwise(F.col("change_status")))
    placed = done.withColumn("page_path", F.when(stored, F.concat(F.lit("pages/"), urls.markdown_path(stem)))).withColumn("metadata_path", urls.metadata_path(F.col("page_path")))
    return Snapshot(placed.drop("held"), chunk.chunk_pages(texts, ["page_key"]))


def snapshot_of_responses(responses: DataFrame, previous: DataFrame | None = None, previous_chunks: DataFrame | None = None, keep_chrome: bool = False) -> Snapshot:
    """A snapshot of HTTP responses (the columns of ``sources.http.RESPONSE``, optionally rendered_html).

    A 304 answer keeps what the earlier page had, found by its key, URL or final URL, and its chunks; without an
    earlier page it is skipped. HTML is turned to Markdown, from the rendered page where there is one; anything
    else is skipped with its status. ``previous`` is the earlier snapshot's pages with idx. The raw hash is that of
    the bytes in ``raw``, or of the body where a response has no bytes.
    """
    rendered = F.col("rendered_html") if "rendered_html" in responses.columns else F.lit(None).cast("string")
    found = responses.withColumn("previous", F.lit(None).cast("struct<page_key:string>")) if previous is None else diff.reuse(responses, previous)
    route = classify.response_route(F.col("status_code"), F.col("previous").isNotNull(), F.col("final_url"), F.col("content_type"))
    routed = found.withColumn("route", route)
    again = F.col("route") == "reuse"
    source = F.coalesce(rendered, F.col("body"))
    markdown = F.when(F.col("route") == "markdown", F.col("body")).when(F.col("route") == "html", html.html_to_markdown(source, keep_chrome))
    method = F.when(F.col("route") == "html", F.when(rendered.isNotNull(), "headless_html_fallback").otherwise("html_fallback")).otherwise("markdown_negotiation")
    status = F.when(F.col("route") == "skip", classify.skipped_status(F.col("status_code"))).when(again, "reused_not_modified").otherwise("stored")
    raw = F.coalesce("raw", F.encode("body", "UTF-8")) if "raw" in responses.columns else F.encode("body", "UTF-8")
    rows = routed.select(
        F.when(again, F.col("previous.page_key")).otherwise(F.col("final_url")).alias("page_key"), "url", "final_url", method.alias("fetch_method"), status.alias("status"), "content_type", "etag", "last_modified",
        F.when(~again, F.sha2(raw, 256)).alias("raw_sha256"), markdown.alias("markdown"), *([F.when(again, F.col("previous")).alias("held")] if previous is not None else []),
    )
    made = _documents(rows, False, previous)
    if previous_chunks is None:
        return made
    kept = rows.where("status = 'reused_not_modified'").select("page_key").distinct()
    copied = previous_chunks.select(*made.chunks.columns).join(kept, "page_key", "left_semi")
    return Snapshot(made.pages, made.chunks.unionByName(copied))


def snapshot_of_tree(spark: SparkSession, root: str, repo: str, ref: str, previous: DataFrame | None = None, docs_path: str | None = None) -> Snapshot:
    """A snapshot of a checked-out repository; the documentation's folder is found if it isn't given."""
    tree = files.markdown_tree(spark, root)
    folder = docs_path if docs_path is not None else (frontier.docs_root(tree).first().root or "")
    inside = tree.where(F.startswith("path", F.lit(folder + "/"))) if folder else tree
    key = urls.relative_to(F.col("path"), F.lit(folder))
    rows = inside.select(
        urls.git_page_id(F.lit(repo), F.lit(ref), key).alias("url"), F.lit("git_checkout").alias("fetch_method"), F.lit("stored").alias("status"), urls.content_type_of(F.col("path")).alias("content_type"),
        F.sha2("raw", 256).alias("raw_sha256"), F.col("body").alias("markdown"), key.alias("page_key"),
    ).withColumn("final_url", F.col("url"))
    return _documents(rows, True, previous)


def store_snapshot(made: Snapshot, root: str, source: str, label: str) -> None:
    """Writes the pages and chunks of a snapshot."""
    store.write_snapshot(made.pages, root, "pages", source, label)
    store.write_snapshot(made.chunks, root, "chunks", source, label)


def _before(spark: SparkSession, root: str, source: str, label: str) -> str | None:
    try:
        return store.previous_label(spark, root, source, label)
    except Exception as trouble:  # nothing is stored yet
        if "PATH_NOT_FOUND" in str(trouble) or "UNABLE_TO_INFER_SCHEMA" in str(trouble):
            return None
        raise


def previous_pages(spark: SparkSession, root: str, source: str, label: str) -> DataFrame | None:
    """The pages of the snapshot before ``label``, numbered, or None if there is none."""
    before = _before(spark, root, source, label)
    if before is None:
        return None
    rows = store.read_snapshots(spark, root, "pages").where((F.col("source_name") == source) & (F.col("snapshot_label") == before))
    return rows.withColumn("snapshot_label", F.col("snapshot_label").cast("string")).withColumn("idx", F.xxhash64("page_key"))


def previous_chunks(spark: SparkSession, root: str, source: str, label: str) -> DataFrame | None:
    """The chunks of the snapshot before ``label``, or None if there is none."""
    before = _before(spark, root, source, label)
    if before is None:
        return None
    return store.read_snapshots(spark, root, "chunks").where((F.col("source_name") == source) & (F.col("snapshot_label") == before))


def plan_import(spark: SparkSession, root: str, source: str, label: str | None = None, all_pages: bool = False, include_low_signal: bool = False) -> tuple[DataFrame, DataFrame]:
    """The import items and artifacts of a stored snapshot, the latest if none is named."""
    chosen = store.snapshot_or_latest(spark, root, source, label)
    mine = lambda t: store.read_snapshots(spark, root, t).where((F.col("source_name") == source) & (F.col("snapshot_label") == chosen))
    low = quality.is_low_signal(F.col("quality.rating"), F.col("quality.word_count"), F.col("quality.score"))
    pages = mine("pages").withColumn("low_signal", low).withColumn("idx", F.xxhash64("page_key"))
    planned = import_plan.plan(pages, all_pages, include_low_signal, F.lit(store.previous_label(spark, root, source, chosen) is not None))
    return planned, import_plan.artifacts(planned, mine("chunks"))


def probe(documents: DataFrame, *keep: str) -> DataFrame:
    """One report per probed address: its kind, mode, index and sitemap findings and what is advised.

    ``documents`` has url, final_url, content_type, requested_root, llms_body and robots_body (null if absent). Columns named in ``keep`` go along.
    """
    markdown = classify.markdown_supported(F.col("content_type"))
    kind = classify.input_kind(F.col("final_url"), F.col("requested_root"), F.col("content_type"), markdown)
    llms = F.col("llms_body").isNotNull()
    bare = F.filter(F.split("llms_body", "\n"), lambda x: F.trim(x) != "")
    sitemaps = F.coalesce(F.regexp_count(F.col("robots_body"), F.lit("(?im)^[ \\t]*sitemap:")), F.lit(0))
    base = documents.select(*keep, "url", "final_url", kind.alias("detected_input_kind"), markdown.alias("markdown_supported"), llms.alias("llms_available"), urls.index_link_count(F.coalesce("llms_body", F.lit(""))).alias("llms_links"), F.slice(bare, 1, 8).alias("llms_preview"), sitemaps.alias("sitemaps"), "requested_root")
    advice = classify.recommendations(F.col("detected_input_kind"), F.col("markdown_supported"), F.col("llms_available"), F.col("sitemaps"))
    return base.select("*", classify.suggested_mode(F.col("detected_input_kind")).alias("suggested_mode"), advice.alias("recommendations"), classify.promotes_to_root(F.col("final_url"), F.col("requested_root"), F.col("detected_input_kind"), urls.site_root(F.col("final_url")), F.col("llms_available"), F.col("sitemaps")).alias("promoted"))
