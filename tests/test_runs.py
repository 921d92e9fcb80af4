import json
import os
import stat

import pytest

from pagestrata.plans import runs
from pagestrata.plans.registry import Source
from pagestrata.sources import git, headless, store

DOCUMENTS = "url string, body string, status_code int, error string"
LONG = "# Title\n\n" + "\n\n".join("This line has a number of plain words for the score." for _ in range(12))


def reader():
    """Answers to requests; made in a function, so that workers get it by value."""
    long = LONG

    def read(url, etag=None, last_modified=None, proxy=None):
        name = url.rsplit("/", 1)[1]
        out = dict.fromkeys(["url", "final_url", "status_code", "content_type", "etag", "last_modified", "markdown_tokens", "original_tokens", "content_signal", "body", "raw", "error"])
        if etag:
            return out | {"url": url, "final_url": url, "status_code": 304}
        body = f"{long}\n{name}" if name != "app" else '<html><body><div id="__next"></div></body></html>'
        return out | {"url": url, "final_url": url, "status_code": 200, "content_type": "text/html" if name == "app" else "text/markdown", "etag": f"tag-{name}", "body": body, "raw": body.encode()}

    return read


def program(path, text):
    path.write_text(f"#!/bin/sh\n{text}\n")
    os.chmod(path, os.stat(path).st_mode | stat.S_IEXEC)
    return str(path)


def test_two_runs_over_http(spark, tmp_path):
    root = str(tmp_path / "root")
    held = runs.init(root)
    source = held.add(Source("s", "https://s.t/", auto_import=True))
    assert [x.name for x in runs.init(root).list()] == ["s"]
    browser = program(tmp_path / "browser", 'echo "<html><body><h1>Rendered</h1><p>words of the page</p></body></html>"')
    found = spark.createDataFrame([(f"https://s.t/{n}", "sitemap") for n in ("a", "b", "app")], "url string, discovered_from string")
    first = runs.sync_http(spark, root, source, "v1", found, browser=browser, request=reader(), send=lambda key, artifact: not key.endswith("/b"))
    assert first["status"] == "fetched" and first["fetch"]["stored_pages"] == 3 and first["diff"]["new_pages"] == 3 and first["discovery"]["adapters"] == ["sitemap"]
    assert first["import"]["imported_pages"] + first["import"]["failed_pages"] == first["import"]["selected_pages"] and first["import"]["failed_pages"] == 1
    pages = {r.url[12:]: r for r in store.read_snapshots(spark, root, "pages").collect()}
    assert pages["app"].fetch_method == "headless_html_fallback" and pages["a"].etag == "tag-a"
    second = runs.sync_http(spark, root, source, "v2", found, browser=browser, request=reader())
    assert (second["fetch"]["reused_pages"], second["diff"]["unchanged_pages"], second["diff"]["removed_pages"], second["previous_snapshot_label"]) == (3, 3, 0, "v1")
    assert second["fetch"]["chunking"] == first["fetch"]["chunking"]
    header = json.loads(spark.read.text(f"{root}/manifest").where("snapshot_label = 'v2'").first().value)
    assert header["source_name"] == "s" and spark.read.json(f"{root}/manifest_pages/source_name=s/snapshot_label=v2").count() == 3
    sent = []
    assert runs.notify(second, sent.append) == sent[0] and "unchanged=3" in sent[0]
    told = runs.verify(spark, root, "s", "lamp", [program(tmp_path / "search", 'echo "found $1"; exit 3')])
    assert (told["stdout"], told["exit_code"], told["success"], told["snapshot_label"]) == ("found lamp", 3, False, "v2")


def test_failures_of_a_discovery(spark):
    seed = spark.createDataFrame([("https://h.t/",)], "url string")
    documents = lambda *rows: spark.createDataFrame(rows, DOCUMENTS)
    good, bad = ("https://h.t/llms.txt", "- [a](/a)", 200, None), ("https://h.t/llms-full.txt", None, None, "timed out")
    found, notes = runs.discover(seed, True, documents(good), documents(bad))
    assert {tuple(r) for r in found.collect()} == {("https://h.t/a", "llms_txt")} and "timed out" in notes[0]
    with pytest.raises(runs.DiscoveryError, match="status 500"):
        runs.discover(seed, True, documents(("https://h.t/llms.txt", "", 500, None)))
    with pytest.raises(runs.DiscoveryError):
        runs.discover(seed, True, sitemaps=documents(bad), sitemap_roots=seed.withColumnRenamed("url", "root"))
    for from_root in (True, False):
        found, notes = runs.discover(seed, from_root)
        assert [tuple(r) for r in found.collect()] == [("https://h.t/", "seed_page")] and notes


def test_repository_runs(spark, tmp_path):
    repo, root = tmp_path / "repo", str(tmp_path / "root")
    (repo / "docs").mkdir(parents=True)
    ask = lambda *a: git.run(["-c", "user.name=t", "-c", "user.email=t@t", *a], str(repo))
    ask("init", "--quiet", "--initial-branch=main")
    (repo / "docs/a.md").write_text(LONG)
    (repo / "docs/b.md").write_text(LONG + "\nb")
    ask("add", "."), ask("commit", "--quiet", "-m", "one"), ask("tag", "v1")
    (repo / "docs/b.md").write_text(LONG + "\nchanged")
    (repo / "docs/c.md").write_text("# C")
    ask("add", "."), ask("commit", "--quiet", "-m", "two")
    source = Source("g", source_kind="git_docs", repo_url=str(repo), default_ref="main")
    first = runs.sync_git(spark, root, source, "l1", str(tmp_path / "w1"), "v1")
    second = runs.sync_git(spark, root, source, "l2", str(tmp_path / "w2"))
    assert (first["diff"]["new_pages"], second["diff"]["new_pages"], second["diff"]["changed_pages"], second["diff"]["unchanged_pages"]) == (2, 1, 1, 1)
    rows = {r.page_key: r.reused_from_snapshot for r in store.read_snapshots(spark, root, "pages").where("snapshot_label = 'l2'").collect()}
    assert rows == {"a.md": "l1", "b.md": None, "c.md": None} and second["source_ref"] == "main" and first["source_ref"] == "v1"
    with pytest.raises(RuntimeError, match="git checkout"):
        git.checkout(str(repo), str(tmp_path / "w3"), "no-such-ref")


def test_browsers(spark, tmp_path):
    pages = spark.createDataFrame([("https://s.t/a",), ("https://s.t/bad",)], "url string")
    tool = program(tmp_path / "b", 'for last; do :; done; case "$last" in *bad) echo "no" >&2; exit 2;; esac; echo "$@"')
    out = {r.url[-3:]: r for r in headless.render(pages, tool, "http://p:1").collect()}
    assert "--proxy-server=http://p:1" in out["t/a"].rendered_html and out["bad"].error == "exit 2: no" and out["bad"].rendered_html is None
    assert headless.render(pages, str(tmp_path / "none")).where("error IS NOT NULL").count() == 2
    assert headless.browser(None, " ", "mine") == "mine"
