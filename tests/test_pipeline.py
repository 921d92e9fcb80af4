import http.server
import json
import threading

import pytest

from pagestrata.operators import import_plan, summary
from pagestrata.plans import pipeline, registry, report
from pagestrata.sources import files, http as http_source, store
from pagestrata.streaming import incremental

RESPONSES = "url string, final_url string, status_code int, content_type string, etag string, last_modified string, body string"
LONG = "# Title\n\n" + "\n\n".join("This line has a number of plain words for the score." for _ in range(12))


def response(path, code=200, kind="text/markdown", body=LONG):
    return (f"https://s.t/{path}", f"https://s.t/{path}", code, kind, None, None, body)


def test_two_snapshots_and_an_import(spark, tmp_path):
    root = str(tmp_path / "store")
    assert pipeline.previous_pages(spark, root, "s", "v1") is None
    first = spark.createDataFrame([response("a"), response("b", body=LONG + "\nb"), response("c", kind="text/html", body="<h1>C</h1><p>text</p>"), response("d", 500), response("e", kind="image/png")], RESPONSES)
    made = pipeline.snapshot_of_responses(first)
    pipeline.store_snapshot(made, root, "s", "v1")
    rows = {r.url[-1]: r for r in store.read_snapshots(spark, root, "pages").collect()}
    assert {k: (r.status, r.change_status, r.fetch_method) for k, r in rows.items()} == {
        "a": ("stored", "new", "markdown_negotiation"), "b": ("stored", "new", "markdown_negotiation"), "c": ("stored", "new", "html_fallback"),
        "d": ("skipped_http_500", "unknown", "markdown_negotiation"), "e": ("skipped_non_markdown", "unknown", "markdown_negotiation"),
    }
    assert rows["a"].page_path == "pages/s.t/a.md" and rows["a"].quality.rating == "high" and rows["d"].page_path is None
    second = spark.createDataFrame([response("a", 304, None, None), response("b", body=LONG + "\nchanged"), response("n", body=LONG + "\nn"), response("d", 500)], RESPONSES)
    made = pipeline.snapshot_of_responses(second, pipeline.previous_pages(spark, root, "s", "v2"), pipeline.previous_chunks(spark, root, "s", "v2"))
    pipeline.store_snapshot(made, root, "s", "v2")
    pages = store.read_snapshots(spark, root, "pages").where("snapshot_label = 'v2'")
    assert {r.page_key[-1]: (r.status, r.change_status) for r in pages.collect()} == {
        "a": ("reused_not_modified", "unchanged"), "b": ("stored", "changed"), "n": ("stored", "new"), "d": ("skipped_http_500", "unknown"), "c": ("removed", "removed"), "e": ("removed", "removed"),
    }
    assert store.snapshot_or_latest(spark, root, "s") == "v2" and store.previous_label(spark, root, "s", "v2") == "v1"
    with pytest.raises(LookupError):
        store.snapshot_or_latest(spark, root, "s", "v9")
    planned, parts = pipeline.plan_import(spark, root, "s")
    assert {r.page_key[-1]: r.item_status for r in planned.collect()} == {"b": "planned", "n": "planned"}
    # the page that wasn't fetched again has all that it had, and its chunks
    a, was = pages.where("page_key LIKE '%/a'").first(), rows["a"]
    same = ["page_path", "metadata_path", "sha256", "raw_sha256", "byte_size", "normalization", "quality", "content_type", "fetch_method"]
    assert [a[c] for c in same] == [was[c] for c in same] and a.reused_from_snapshot == "v1" and a.byte_size > 0
    everything, artifacts = pipeline.plan_import(spark, root, "s", all_pages=True)
    assert {r.page_key[-1]: r.item_status for r in everything.collect()} == {"a": "planned", "b": "planned", "n": "planned"}
    assert {r.page_key[-1] for r in artifacts.where("artifact NOT LIKE 'pages/%'").collect()} == {"a", "b", "n"}
    assert parts.count() == 2 and import_plan.search(store.read_snapshots(spark, root, "chunks"), "PLAIN words").count() > 0
    page = report.snapshot_html("s", made.diff().first().asDict(), pages)
    assert "https://s.t/b" in page and "changed" in page and "<b>1</b>" in page
    assert summary.fetch_summary(pages).first().stored_pages == 3


def test_not_modified_without_an_earlier_page_is_skipped(spark):
    previous = spark.createDataFrame([("k", "https://s.t/u", "https://s.t/f", "h", "v1", 1)], "page_key string, url string, final_url string, sha256 string, snapshot_label string, idx long")
    rows = spark.createDataFrame([response("f", 304, None, None), response("x", 304, None, None)], RESPONSES)
    out = {r.url[-1]: r for r in pipeline.snapshot_of_responses(rows, previous).pages.where("status <> 'removed'").collect()}
    assert (out["f"].page_key, out["f"].status, out["f"].sha256, out["f"].page_path, out["f"].byte_size) == ("k", "reused_not_modified", "h", None, 0)
    assert (out["x"].status, out["x"].change_status) == ("skipped_http_304", "unknown")


def test_raw_hash_is_of_the_bytes(spark, tmp_path):
    import hashlib

    raw = b"# A \xff\n\nbody"
    (tmp_path / "a.md").write_bytes(raw)
    made = pipeline.snapshot_of_tree(spark, str(tmp_path), "https://g/r.git", "main", docs_path="")
    assert made.pages.first().raw_sha256 == hashlib.sha256(raw).hexdigest()
    row = (*response("a", body=raw.decode("utf-8", "replace")), bytearray(raw))
    assert pipeline.snapshot_of_responses(spark.createDataFrame([row], RESPONSES + ", raw binary")).pages.first().raw_sha256 == hashlib.sha256(raw).hexdigest()


def test_tree(spark, tmp_path):
    for name, body in {"docs/guide/intro.md": "# Intro\n\nHello", "docs/api.mdx": "# A\n\n<Info>\n    x\n</Info>", "docs/meta.json": "{}", "README.md": "# R"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    made = pipeline.snapshot_of_tree(spark, str(tmp_path), "https://g/r.git", "main")
    assert {(r.page_key, r.url, r.content_type, r.page_path) for r in made.pages.collect()} == {
        ("guide/intro.md", "git+https://g/r.git#main:guide/intro.md", "text/markdown", "pages/guide/intro.md"), ("api.mdx", "git+https://g/r.git#main:api.mdx", "text/mdx", "pages/api.md"),
    }
    assert files.file_tree(spark, str(tmp_path)).count() == 4 and made.chunks.count() == 2


def test_fetching(spark):
    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            fresh = self.headers.get("If-None-Match") == "e1"
            self.send_response(404 if self.path == "/no" else 304 if fresh else 200)
            self.send_header("Content-Type", "text/markdown")
            self.send_header("ETag", "e1")
            self.send_header("x-markdown-tokens", "12")
            self.end_headers()
            if not fresh:
                self.wfile.write(b"# hi")

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    rows = spark.createDataFrame([(base + "/a", None), (base + "/b", "e1"), (base + "/no", None), ("http://127.0.0.1:1/x", None)], "url string, etag string")
    out = {r.url[len(base) :]: r for r in http_source.fetch(rows).collect()}
    server.shutdown()
    assert (out["/a"].status_code, out["/a"].body, out["/a"].markdown_tokens, out["/b"].status_code, out["/no"].status_code) == (200, "# hi", 12, 304, 404)
    assert any(r.error for r in out.values())


def test_manifests_are_migrated(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": 4, "source_name": "s", "pages": [{"page_key": "p", "change_status": "changed"}, {"page_key": "q"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"schema_version": 7, "source_name": "t", "pages": []}))
    done = store.migrated_manifests(store.read_manifests(spark, str(tmp_path)))
    rows = {r.source_name: r for r in done.collect()}
    assert rows["s"].schema_version == 7 and rows["s"].diff.import_candidates == 1 and rows["t"].diff is None
    assert store.migration_counts(done).first().asDict() == {"scanned": 2, "rewritten": 1}


def test_registry(tmp_path):
    path = tmp_path / "config.json"
    made = registry.Registry(path)
    made.add(registry.Source("b-docs", "https://b", tags=[" Docs", "docs", ""]))
    made.add(registry.Source("a", source_kind="git_docs", repo_url="https://g"))
    for bad in (registry.Source("Bad Name"), registry.Source("a"), registry.Source("c", source_kind="git_docs"), registry.Source("d", source_kind="x")):
        with pytest.raises(ValueError):
            made.add(bad)
    made.set_auto_import("a", "run", all_pages=True)
    assert made.set_auto_import("a").import_command is None
    again = registry.Registry(path)
    assert [s.name for s in again.list()] == ["a", "b-docs"] and again.get("b-docs").tags == ["docs"] and not again.migrate()
    with pytest.raises(LookupError):
        again.get("zz")
    assert registry.first_given(None, " ", "x", "y") == "x"


def test_probe(spark):
    rows = [("https://s.t/docs/a", "https://s.t/docs/a", "text/html", False, "# x\n\n- [a](/b)\n", "Sitemap: https://s.t/s.xml"), ("https://s.t/", "https://s.t/", "text/markdown", True, None, None)]
    out = pipeline.probe(spark.createDataFrame(rows, "url string, final_url string, content_type string, requested_root boolean, llms_body string, robots_body string")).orderBy("url").collect()
    assert [(r.detected_input_kind, r.suggested_mode, r.promoted, r.llms_links, r.sitemaps) for r in out] == [("site_root", "discovery_root", False, 0, 0), ("content_page", "hybrid_seed", True, 1, 1)]
    assert out[1].llms_preview == ["# x", "- [a](/b)"]


def test_stream_of_snapshots(spark, tmp_path):
    schema = "source_name string, snapshot_label string, page_key string, fetched_at timestamp, status string, sha256 string"
    snapshots = spark.createDataFrame([("s", "v2", "v1", "fetched"), ("s", "v1", None, "fetched")], "source_name string, snapshot_label string, previous_snapshot_label string, status string")
    seen = []
    (tmp_path / "in").mkdir()
    stream = incremental.arriving_pages(spark, str(tmp_path / "in"), schema)

    def run(rows):
        spark.createDataFrame(rows, schema).withColumn("fetched_at", __import__("pyspark.sql.functions", fromlist=["x"]).current_timestamp()).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.track_changes(stream, snapshots, str(tmp_path / "store"), lambda df, n: seen.append({tuple(r) for r in df.collect()}), str(tmp_path / "checkpoint")).awaitTermination()

    run([("s", "v1", "a", None, "stored", "1"), ("s", "v2", "a", None, "stored", "2")])
    run([("s", "v1", "late", None, "stored", "3")])
    assert seen == [{("s", "v2", "a", "changed")}, {("s", "v2", "a", "changed"), ("s", "v2", "late", "removed")}]
