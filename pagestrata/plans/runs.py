"""Whole runs over a source: discovery, snapshot, manifest, import, verification and message."""

from __future__ import annotations

import subprocess
from collections.abc import Callable
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata import schemas
from pagestrata.operators import chunk, diff, frontier, import_plan, quality, summary
from pagestrata.plans import pipeline
from pagestrata.plans.registry import Registry, Source
from pagestrata.session import cut
from pagestrata.sources import git, headless, http, store


class DiscoveryError(RuntimeError):
    """An index that a run can't do without couldn't be read."""


def init(root: str) -> Registry:
    """The registry below ``root``, written if there is none yet."""
    held = Registry(f"{root}/config.json")
    if not held.path.exists():
        held.save()
    return held


def required(documents: DataFrame, what: str) -> DataFrame:
    """The documents (url, body, status_code, error), all of which must have been read."""
    bad = documents.where("error IS NOT NULL OR status_code NOT BETWEEN 200 AND 299").select("url", "status_code", "error").first()
    if bad is not None:
        raise DiscoveryError(f"{what}: {bad.url}: {bad.error or f'status {bad.status_code}'}")
    return documents


def optional(documents: DataFrame, what: str) -> tuple[DataFrame, list[str]]:
    """The documents that were read, and a note if one wasn't."""
    good = "error IS NULL AND status_code BETWEEN 200 AND 299"
    bad = documents.where(f"NOT coalesce({good}, false)").select("url", "status_code", "error").first()
    return documents.where(good), [] if bad is None else [f"skipped optional {what}: {bad.url}: {bad.error or f'status {bad.status_code}'}"]


def discover(seed: DataFrame, from_root: bool, llms: DataFrame | None = None, llms_full: DataFrame | None = None, sitemaps: DataFrame | None = None, sitemap_roots: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """The frontier (url, discovered_from) and the notes of a discovery, from documents already fetched.

    From a site's root the index and the sitemaps must be readable, the full index needn't be. Otherwise, and
    where nothing is found, the seed (url) stands alone.
    """
    notes: list[str] = []
    if not from_root:
        return frontier.or_seed(seed.limit(0).select("url", F.lit("seed_page").alias("discovered_from")), seed), ["kept the entry as a seed"]
    parts = {}
    if llms is not None:
        parts["llms_txt"] = frontier.index_links(required(llms, "index")).select("url")
    if llms_full is not None:
        good, notes = optional(llms_full, "full index")
        parts["llms_full_txt"] = frontier.index_links(good).select("url")
    if sitemaps is not None and sitemap_roots is not None:
        parts["sitemap"] = frontier.walk_sitemaps(required(sitemaps, "sitemap"), sitemap_roots).select("url")
    if not parts:
        return frontier.or_seed(seed.limit(0).select("url", F.lit("seed_page").alias("discovered_from")), seed), ["no index and no sitemap was found"]
    return frontier.or_seed(frontier.merge(parts), seed), notes


def status_of(stored: int, discovered: int) -> str:
    """fetched, discovered or scaffolded: how far a snapshot came."""
    return "fetched" if stored else "discovered" if discovered else "scaffolded"


def write_manifest(made: pipeline.Snapshot, found: DataFrame, root: str, source: Source, label: str, ref: str, previous_label: str | None, notes: list[str]) -> dict:
    """Writes a snapshot's manifest and discovery as JSON: a header of one document, and the pages and addresses as lines."""
    spark = made.pages.sparkSession
    fetched, changes, rated = (df.first().asDict() for df in (made.fetch(), made.diff(), made.quality()))
    parts = chunk.summarize(made.chunks, ["page_key"]).first().asDict()
    discovery = frontier.adapters(found).first().asDict()
    header = {
        "schema_version": schemas.MANIFEST_VERSION, "created_at": datetime.now(UTC).isoformat(), "source_name": source.name, "entry_url": source.entry_url, "source_kind": source.source_kind, "version_strategy": source.version_strategy,
        "source_ref": ref, "snapshot_label": label, "status": status_of(fetched["stored_pages"], discovery["frontier_count"]), "previous_snapshot_label": previous_label, "discovery": discovery, "fetch": fetched | {"chunking": parts, "quality": rated},
        "diff": changes | {"previous_snapshot_label": previous_label}, "notes": notes,
    }
    where = f"source_name={source.name}/snapshot_label={label}"
    spark.createDataFrame(pd.DataFrame({"value": [_json(header)]})).coalesce(1).write.mode("overwrite").text(f"{root}/manifest/{where}")
    store.export_json(made.pages, f"{root}/manifest_pages/{where}")
    store.export_json(found, f"{root}/discovery/{where}")
    return header


def _json(value: dict) -> str:
    import json

    return json.dumps(value, ensure_ascii=False, default=str)


def sync_http(
    spark: SparkSession, root: str, source: Source, label: str, found: DataFrame, notes: list[str] = (), proxy: str | None = None, browser: str | None = None,
    request: Callable[..., dict] = http.get, send: Callable[[str, str], bool] | None = None,
) -> dict:
    """Fetches the frontier, makes, stores and describes the snapshot, and imports it if the source asks for it."""
    previous, chunks = pipeline.previous_pages(spark, root, source.name, label), pipeline.previous_chunks(spark, root, source.name, label)
    before = None if previous is None else previous.select("snapshot_label").first().snapshot_label
    asked = found
    if previous is not None:
        tags = diff.previous_rows(previous, ["etag", "last_modified"]).select(F.col("lookup").alias("url"), "previous.etag", "previous.last_modified")
        asked = found.join(tags, "url", "left")
    responses = cut(http.fetch(asked, request, http.first_given(proxy, source.proxy_url)))
    if browser:
        thin = responses.where(pipeline.classify.is_html_response(F.col("content_type")) & pipeline.classify.needs_rendering(F.col("body"), pipeline.html.html_to_markdown(F.col("body"))))
        rendered = headless.render(thin, browser, http.first_given(proxy, source.proxy_url)).select("url", "rendered_html")
        responses = cut(responses.join(rendered, "url", "left"))
    made = pipeline.snapshot_of_responses(responses.where("error IS NULL"), previous, chunks)
    return _finish(spark, root, source, label, label, made, found, before, [*notes], send)


def sync_git(spark: SparkSession, root: str, source: Source, label: str, folder: str, ref: str | None = None, proxy: str | None = None, send: Callable[[str, str], bool] | None = None) -> dict:
    """Clones the source's repository into ``folder``, makes, stores and describes the snapshot of its documentation."""
    wanted = ref or source.default_ref
    commit = git.checkout(source.repo_url, folder, wanted, http.first_given(proxy, source.proxy_url))
    previous = pipeline.previous_pages(spark, root, source.name, label)
    before = None if previous is None else previous.select("snapshot_label").first().snapshot_label
    made = pipeline.snapshot_of_tree(spark, folder, source.repo_url, wanted or commit, previous, source.docs_path)
    found = made.pages.where("status = 'stored'").select("url", F.lit("seed_page").alias("discovered_from"))
    return _finish(spark, root, source, label, wanted or commit, made, found, before, [f"commit {commit}"], send)


def _finish(spark, root, source, label, ref, made, found, before, notes, send) -> dict:
    pipeline.store_snapshot(made, root, source.name, label)
    stored = pipeline.Snapshot(*(store.read_snapshots(spark, root, t).where((F.col("source_name") == source.name) & (F.col("snapshot_label") == label)) for t in ("pages", "chunks")))
    header = write_manifest(stored, found, root, source, label, ref, before, notes)
    if source.auto_import and send is not None:
        header["import"] = import_snapshot(spark, root, source.name, label, send, source.import_all_pages, source.import_low_signal)
    return header


def import_snapshot(spark: SparkSession, root: str, source: str, label: str | None, send: Callable[[str, str], bool], all_pages: bool = False, low_signal: bool = False) -> dict:
    """Delivers a snapshot's planned artifacts and logs what became of each page; returns the counts."""
    chosen = store.snapshot_or_latest(spark, root, source, label)
    planned, parts = pipeline.plan_import(spark, root, source, chosen, all_pages, low_signal)
    done = cut(import_plan.deliver(parts, send))
    pages = store.read_snapshots(spark, root, "pages").where((F.col("source_name") == source) & (F.col("snapshot_label") == chosen))
    counts = import_plan.counters(pages, planned, parts, all_pages).first().asDict()
    several = F.col("artifacts") > 1  # only pages of several artifacts count theirs as chunks
    told = done.agg(
        F.count_if(F.col("failed") == 0).alias("imported_pages"), F.count_if(F.col("failed") > 0).alias("failed_pages"),
        F.coalesce(F.sum(F.when(several, F.col("artifacts") - F.col("failed"))), F.lit(0)).alias("imported_chunks"), F.coalesce(F.sum(F.when(several, F.col("failed"))), F.lit(0)).alias("failed_chunks"),
    ).first().asDict()
    store.export_json(done.withColumn("status", F.when(F.col("failed") > 0, "failed").otherwise("imported")), f"{root}/import_log/source_name={source}/snapshot_label={chosen}")
    return counts | told


def verify(spark: SparkSession, root: str, source: str, query: str, command: list[str], label: str | None = None) -> dict:
    """Asks the external retrieval program for ``query`` and logs what it said."""
    chosen = store.snapshot_or_latest(spark, root, source, label)
    started = datetime.now(UTC).isoformat()
    done = subprocess.run([*command, query], capture_output=True, text=True)
    told = {"started_at": started, "finished_at": datetime.now(UTC).isoformat(), "query": query, "success": done.returncode == 0, "exit_code": done.returncode, "stdout": done.stdout.strip(), "stderr": done.stderr.strip()}
    store.export_json(spark.createDataFrame([told]), f"{root}/verify_log/source_name={source}/snapshot_label={chosen}")
    return told | {"snapshot_label": chosen}


def notify(header: dict, send: Callable[[str], None]) -> str:
    """Sends the message of a snapshot's manifest and returns it."""
    spark = SparkSession.active()
    changes, fetched, rated = header["diff"], header["fetch"], header["fetch"]["quality"]
    row = {
        "source_name": header["source_name"], "snapshot_label": header["snapshot_label"], "status": header["status"], "entry_url": header["entry_url"] or "", "discovered_pages": header["discovery"]["frontier_count"], "stored_pages": fetched["stored_pages"],
        "changed_pages": changes["new_pages"] + changes["changed_pages"], "unchanged_pages": changes["unchanged_pages"], "removed_pages": changes["removed_pages"],
        **{f"{r}_quality_pages": rated[f"{r}_quality_pages"] for r in ("high", "medium", "low")},
    }
    text = summary.snapshot_message(spark.createDataFrame([row])).first().message
    send(text)
    return text
