"""The inputs and expectations of the operators over pages, as table-driven cases."""

import random

import pytest
from pyspark.sql import functions as F

from pagestrata.functions import classify, text, urls
from pagestrata.operators import chunk, diff, frontier, html, import_plan, normalize, quality


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


URLS = [
    (urls.normalized, " Example.com ", "https://example.com/"), (urls.normalized, "http://A.b/C?d#e", "http://a.b/C?d#e"), (urls.normalized, "https://", None), (urls.normalized, None, None),
    (urls.canonical, "https://a.b#x", "https://a.b/"), (urls.canonical, "https://a.b/c/?q=1#x", "https://a.b/c/?q=1"), (urls.canonical, "https://a.b?q=1", "https://a.b/?q=1"),
    (urls.site_root, "https://a.b/c?d", "https://a.b/"), (urls.host, "https://u@A.b:80/c", "a.b"), (urls.query, "https://a.b/c", None), (urls.query, "https://a.b/c?x#y", "x"),
    (urls.ref_label, "main@2026/03/07", "main-2026-03-07"), (urls.ref_label, "--a  b--", "a-b"), (urls.path_segment, "///", "index"),
    (urls.storage_stem, "https://docs.a.b/guide/x y/", "docs.a.b/guide/x-y"), (urls.storage_stem, "https://a.b", "a.b/index"),
    (urls.markdown_path, "a/b.mdx", "a/b.md"), (urls.markdown_path, "a/b", "a/b.md"), (urls.markdown_path, "a/b.md", "a/b.md"),
    (urls.is_docs_path, "/docs/overview", True), (urls.is_docs_path, "/guides/x", True), (urls.is_docs_path, "/start/x", True), (urls.is_docs_path, "/blog/x", False), (urls.is_docs_path, "/pricing", False), (urls.is_docs_path, "/", False),
    (urls.valid_source_name, "Lamp Docs", False), (urls.valid_source_name, "a-b_1", True), (urls.valid_source_name, "a\n", False),
    (text.trimmed, "　 a b \n", "a b"), (text.word_count, "a b　c\n", 3), (text.ascii_lower, "AÉ", "aÉ"), (text.percent_decoded, "a%20b+c", "a b+c"), (text.percent_decoded, "%zz", "%zz"),
    (text.html_escaped, "<a href=\"x\">&</a>", "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"),
    (urls.index_link_count, "# a\n- [x](/y)\nhttps://a.b\n- z", 2),
]


@pytest.mark.parametrize("function,given,expected", URLS)
def test_addresses_and_text(spark, function, given, expected):
    assert value(spark, function(F.lit(given).cast("string"))) == expected


def test_storage_of_queries_and_chunks(spark):
    stem = value(spark, urls.storage_stem(F.lit("https://a.b/c?page=2")))
    assert stem.startswith("a.b/c--q-") and len(stem) == len("a.b/c--q-") + 8
    assert [value(spark, urls.chunk_path(F.lit("a/b.md"), F.lit(n))) for n in (7, 1000)] == ["a/b__chunk-007.md", "a/b__chunk-1000.md"]
    assert value(spark, urls.clean_tags(F.lit([" Docs", "docs", "", "API"]))) == ["api", "docs"]
    header = F.lit('</llms.txt>; rel="llms-txt", <https://a.b/x>; rel=next')
    assert value(spark, urls.link_with_rel(header, "next")) == "https://a.b/x" and value(spark, urls.link_with_rel(header, "prev")) is None


@pytest.mark.parametrize("link,expected", [
    ("https://a.b/x#y", "https://a.b/x"), ("/r/s", "https://a.b/r/s"), ("../u/./v", "https://a.b/u/v"), ("./w?q", "https://a.b/d/w?q"), ("https://o.p/x", None), ("bare.md", None), ("#f", None), ("", None), ("mailto:x@y", None),
])
def test_links_are_resolved(spark, link, expected):
    assert value(spark, urls.resolved_link(F.lit("https://a.b/d/e"), F.lit(link))) == expected


@pytest.mark.parametrize("url,root,kind,markdown,expected,mode", [
    ("https://a.b/llms.txt", False, None, False, "llms_txt", "discovery_root"), ("https://a.b/llms-full.txt", True, None, False, "llms_full_txt", "discovery_root"), ("https://a.b/robots.txt", False, None, False, "robots_txt", "discovery_root"),
    ("https://a.b/x/sitemap-2.xml", True, None, False, "sitemap", "discovery_root"), ("https://a.b/docs", True, None, False, "site_root", "discovery_root"), ("https://a.b/x.PDF", False, None, False, "pdf_file", "single_file"),
    ("https://a.b/x", False, "application/pdf", False, "pdf_file", "single_file"), ("https://a.b/x.docx", False, None, False, "office_document", "single_file"), ("https://a.b/x.mdx", False, None, False, "markdown_file", "single_file"),
    ("https://a.b/openapi.yml", False, None, False, "openapi_spec", "single_file"), ("https://a.b/x.json", False, None, False, "json_file", "single_file"), ("https://a.b/x.htm", False, None, False, "html_file", "single_file"),
    ("https://a.b", False, None, False, "site_root", "discovery_root"), ("https://a.b/x", False, "text/markdown", True, "markdown_endpoint", "hybrid_seed"), ("https://a.b/x", False, "", False, "content_page", "hybrid_seed"),
    ("https://a.b/x", False, "image/png", False, "unknown", "single_document"),
])
def test_input_kinds(spark, url, root, kind, markdown, expected, mode):
    found = classify.input_kind(F.lit(url), F.lit(root), F.lit(kind).cast("string"), F.lit(markdown))
    assert value(spark, found) == expected and value(spark, classify.suggested_mode(found)) == mode


def test_responses(spark):
    route = lambda code, url, kind: value(spark, classify.response_route(F.lit(code), F.lit(True), F.lit(url), F.lit(kind)))
    assert [route(304, "https://a.b/x", None or ""), route(200, "https://a.b/x.md", ""), route(200, "https://a.b/x.txt", "text/plain"), route(200, "https://a.b/x", "text/plain"), route(200, "https://a.b/x", "TEXT/html"), route(500, "https://a.b/x.md", "")] == [
        "reuse", "markdown", "skip", "markdown", "html", "skip"]
    assert value(spark, classify.needs_rendering(F.lit('<div id="__NEXT"></div>'), F.lit("short"))) and not value(spark, classify.needs_rendering(F.lit("<article>x</article>"), F.lit("short")))
    assert value(spark, classify.recommendations(F.lit("llms_txt"), F.lit(True), F.lit(True), F.lit(0))) == ["expand_index", "negotiate_markdown", "use_llms_index"]


NORMALIZE = {
    "index": ("> ## Documentation Index\n> see llms.txt\n\n# Kites\n\n# Kites\n\n\nThey fly", "# Kites\n\nThey fly\n"),
    "mintlify": ("<Info>\n    text\n</Info>\n<Tab title=\"Amiga\">\n    x\n</Tab>\n```ts title=\"a\"\nc\n```\nA <Tooltip tip=\"t\">word</Tooltip>.\n<img src=\"x\">", "Note:\ntext\n### Amiga\nx\n```ts\nc\n```\nA word.\n"),
    "card": ("<Card title=\"Cockpit\" href=\"/fly\">\n  body\n</Card>", "## Cockpit\nSource: /fly\n  body\n"),
    "docusaurus": ("import X from 'y';\n<TabItem value=\"zig\">\n    i\n</TabItem>\n<details>\n<summary>Deeper</summary>\n    t\n</details>", "### zig\ni\n## Deeper\nt\n"),
    "gitbook": ("{% hint style=\"warning\" %}\nc\n{% endhint %}\n{% tabs %}\n{% tab title=\"Lua\" %}\n    a\n{% endtab %}\n{% endtabs %}", "Warning:\nc\n### Lua\na\n"),
    "mkdocs": ("!!! note \"Mind this\"\n    b\n\n=== \"Ada\"\n    c\nback\n    kept", "Note: Mind this\nb\n\n### Ada\nc\nback\n    kept\n"),
    "nextra": ("<Callout type=\"warning\" title=\"Draft\">\nx\n</Callout>\n<VPCard title=\"Shell\" href=\"/sh\" desc=\"d\" />\n<Badge type=\"x\" />\n<Foo>lost</Foo>", "Warning: Draft\nx\n## Shell\nSource: /sh\nd\n"),
    "unknown callout": ("!!! my-own_kind\n\n!!! odd \"Title\"", "My Own Kind:\n\nTitle:\n"),
    "comments": ("a\n<!-- x -->\n{/* y */}\nexport const a = 1\nb", "a\nb\n"),
    "line ends": ("\r\n\ta\r\n\r\n\r\nb \r\n", "a\n\nb\n"),
    "null": (None, None), "empty": ("", "\n"), "blank": (" \n　", "\n"),
}


def test_normalizer(spark):
    rows = spark.createDataFrame([(k, given, "own") for k, (given, _) in NORMALIZE.items()], "name string, markdown string, changed string")
    out = {r.name: r for r in normalize.normalize_pages(rows, ["name"]).collect()}
    assert {k: r.markdown for k, r in out.items()} == {k: expected for k, (_, expected) in NORMALIZE.items()}
    index = out["index"]
    assert (index.boilerplate_blocks_removed, index.component_wrappers_removed, index.duplicate_headings_removed, index.blank_lines_collapsed) == (1, 3, 1, 2)
    assert out["nextra"].profiles_applied == ["nextra", "mintlify", "vitepress", "mdx"] and out["mintlify"].asset_lines_removed == 1
    assert out["empty"].changed is False and out["null"].changed is None
    assert normalize.normalize_pages(rows.limit(0), ["name"]).count() == 0


def fold_dedent(lines):
    """Dedenting as a plain loop, for lines of a small alphabet."""
    out, on = [], False
    for line in lines:
        if on and line.strip():
            if line.startswith("    "):
                line = line[4:]
            elif line.strip() != "</Info>":
                on = False
        bare = line.strip()
        if bare == "<Info>":
            out.append("Note:")
            on = True
        elif bare == "</Info>":
            on = False
        else:
            out.append(line.rstrip())
    kept, last = [], None
    for line in out:
        if line.startswith("#") and line == last:
            continue
        last = line or last
        if line or not kept or kept[-1]:
            kept.append(line)
    return "\n".join(kept).strip() + "\n"


def test_random_lines_match_a_plain_loop(spark):
    rng = random.Random(5)
    alphabet = ["<Info>", "</Info>", "", "text", "    in", "        deep", "# H", "# H", "  two", "    </Info>"]
    rows = [(k, "x\n" + "\n".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25)))) for k in range(300)]
    out = {r.k: r.markdown for r in normalize.normalize_pages(spark.createDataFrame(rows, "k int, markdown string"), ["k"]).collect()}
    assert out == {k: fold_dedent(t.split("\n")) for k, t in rows}


HTML = '<html><head><title>t</title></head><body><!-- c --><nav>menu</nav><h1>A &amp; B</h1><script>"</p>"</script><p>One <b>bold <a class="x" href="/u">link</a><p>Two<br>three<ul><li>i</ul><pre>code</pre><footer>f</footer></body></html>'


def test_html(spark):
    out = value(spark, html.html_to_markdown(F.lit(HTML)))
    assert out == "# A & B\n\nOne bold [link](/u)\n\nTwo\nthree\n- i\n\n```\ncode\n```\n"
    assert value(spark, html.page_title(F.lit(out))) == "A & B" and value(spark, html.html_to_markdown(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("markdown,score,rating,reasons,low", [
    ("# T\n\n" + "\n".join(["many words are on this line of text here"] * 12), 100, "high", [], False),
    ("<div>\n<Card/>\nshort", 0, "low", ["missing_title", "very_short", "too_few_lines", "residual_html"], True),
    ("", 0, "low", ["missing_title", "empty_content", "too_few_lines", "low_text_density"], True), (None, None, None, None, None),
])
def test_quality(spark, markdown, score, rating, reasons, low):
    row = quality.score_pages(spark.createDataFrame([(markdown,)], "markdown string")).first()
    assert (row.rating, row.low_signal_reasons, row.low_signal) == (rating, reasons, low)
    assert row.score == score or score == 0 and row.score < 30


def fold_chunks(words, target, overlap):
    """The ranges of blocks of each chunk, as a plain loop over block sizes."""
    out, s, n = [], 0, len(words)
    while s < n:
        e = s + 1
        while e < n and sum(words[s:e]) < target:
            e += 1
        out.append((s, e))
        if e == n:
            break
        j = e - 1
        while j > s and sum(words[j:e]) < overlap:
            j -= 1
        s = e if j == s else j
    return out


def test_random_packs_match_a_plain_loop(spark):
    rng = random.Random(6)
    sizes = {k: [rng.choice([1, 3, 10, 50, 300]) for _ in range(rng.randint(1, 14))] for k in range(60)}
    rows = [(k, "\n\n".join(" ".join([f"b{i}"] * n) for i, n in enumerate(words))) for k, words in sizes.items()]
    pages = spark.createDataFrame(rows, "k int, markdown string")
    for target, overlap in ((220, 40), (8, 0), (1, 5), (60, 100)):
        got = {}
        for r in chunk.chunk_pages(pages, ["k"], target_words=target, overlap_words=overlap).orderBy("k", "ordinal").collect():
            ids = [int(b.split()[0][1:]) for b in r.markdown.split("\n\n")]
            got.setdefault(r.k, []).append((ids[0], ids[-1] + 1))
        assert got == {k: fold_chunks(words, target, overlap) for k, words in sizes.items()}, (target, overlap)


def test_sections_and_fences(spark):
    md = "pre\n\n#### deep\nx\n## two ##\ny\n# one\nz\n\n```\na\n\nb\n```\nafter\n~~~\nopen\n\nend"
    pages = spark.createDataFrame([("p", md), ("n", None), ("b", " \n ")], "page_key string, markdown string")
    rows = chunk.chunk_pages(pages, ["page_key"], target_words=1, overlap_words=99).orderBy("ordinal").collect()
    assert [(r.heading, r.section_path, r.markdown) for r in rows] == [
        (None, [], "pre"), ("deep", ["deep"], "#### deep\nx"), ("two", ["deep", "two"], "## two ##\ny"), ("one", ["one"], "# one\nz"), ("one", ["one"], "```\na\n\nb\n```"), ("one", ["one"], "after\n~~~\nopen\n\nend"),
    ]
    assert len({r.chunk_id for r in rows}) == 6 and chunk.summarize(chunk.chunk_pages(pages.limit(0), ["page_key"]), ["page_key"]).first().chunk_count == 0


def test_diff(spark):
    current = spark.createDataFrame([("intro", "u1", "h1"), ("ref", "u2", "h2"), ("bad", "u3", None), ("nohash", "u4", "h4")], "page_key string, url string, sha256 string")
    previous = spark.createDataFrame([("intro", "u1", None, "h0", 1), ("other", None, "u1", "h1", 2), ("removed", None, None, "h9", 3), ("bad", "u3", None, "h3", 4), ("nohash", "u4", None, None, 5)], "page_key string, url string, final_url string, sha256 string, idx int")
    out = {r.page_key: r.change_status for r in diff.diff_pages(current, previous).collect()}
    assert out == {"intro": "unchanged", "ref": "new", "bad": "unknown", "nohash": "new", "other": "removed", "removed": "removed"}
    git = {r.page_key: r.change_status for r in diff.diff_pages(current, previous, git=True).collect()}
    assert git["nohash"] == "changed"
    assert diff.summarize(diff.diff_pages(current, previous)).first().asDict() == {"new_pages": 2, "changed_pages": 0, "unchanged_pages": 1, "removed_pages": 2, "import_candidates": 2}
    held = diff.reuse(spark.createDataFrame([("u1",), ("u2",), ("removed",)], "url string"), previous)
    assert {r.url: r.previous and (r.previous.page_key, r.previous.sha256, r.previous.etag) for r in held.collect()} == {"u1": ("other", "h1", None), "u2": None, "removed": ("removed", "h9", None)}
    many = diff.diff_pages(current.withColumn("v", F.lit(1)), previous.withColumn("v", F.col("idx") % 2), by=("v",))
    assert {(r.v, r.page_key): r.change_status for r in many.collect()} == {
        (1, "intro"): "changed", (1, "ref"): "new", (1, "bad"): "unknown", (1, "nohash"): "new", (1, "removed"): "removed", (0, "other"): "removed", (0, "bad"): "removed",
    }


def test_import_plan(spark):
    rows = [(1, "guide/index.md", "h", "new", False), (2, "guide", "h", "new", False), (3, "same", "k", "unchanged", False), (4, "weak", "w", "changed", True), (5, "weak/longer", "w", "changed", False), (6, "n", None, "unknown", None), (7, "m", None, None, None)]
    pages = spark.createDataFrame([(i, k, f"https://a.b/{k}", None, k, h, s, low) for i, k, h, s, low in rows], "idx int, page_key string, url string, final_url string, page_path string, sha256 string, change_status string, low_signal boolean")
    planned = import_plan.plan(pages)
    assert {r.idx: r.item_status for r in planned.collect()} == {1: "skipped_duplicate", 2: "planned", 4: "skipped_low_signal", 5: "skipped_duplicate", 6: "planned", 7: "planned"}
    chunks = spark.createDataFrame([("guide", 1, "c1"), ("guide", 2, "c2")], "page_key string, ordinal long, chunk_id string")
    parts = import_plan.artifacts(planned, chunks)
    assert {(r.page_key, r.artifact) for r in parts.collect()} == {("guide", "c1"), ("guide", "c2"), ("n", "n"), ("m", "m")}
    counts = import_plan.counters(pages, planned, parts).first().asDict()
    assert counts == {"total_pages": 7, "skipped_unchanged": 1, "selected_pages": 3, "skipped_duplicates": 2, "skipped_low_signal": 1, "selected_artifacts": 4}
    sent = {r.page_key: (r.artifacts, r.failed) for r in import_plan.deliver(parts, lambda page, artifact: artifact != "c2").collect()}
    assert sent == {"guide": (2, 1), "n": (1, 0), "m": (1, 0)}


def test_frontier(spark, tmp_path):
    index = "# x\n- [a](/a#f) [b](https://s.t/b)\n- [o](https://o.p/) [m](mailto:x@y.z) see <https://s.t/c>, [a](/a)\n"
    docs = spark.createDataFrame([("https://s.t/llms.txt", index), ("https://s.t/none", None)], "url string, body string")
    assert {r.url for r in frontier.index_links(docs).collect()} == {"https://s.t/a", "https://s.t/b", "https://s.t/c"}
    sitemaps = spark.createDataFrame([
        ("r", "<sitemapindex><sitemap><loc>https://s.t/n.xml</loc></sitemap><sitemap><loc>https://s.t/r</loc></sitemap></sitemapindex>"),
        ("https://s.t/n.xml", '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://s.t/p?a=1&amp;b=2#f </loc></url><url><loc>https://s.t</loc></url></urlset>'), ("x", "plain"), ("y", None),
    ], "url string, body string")
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    roots = spark.createDataFrame([("r",)], "root string")
    assert {r.url for r in frontier.walk_sitemaps(sitemaps, roots).collect()} == {"https://s.t/p?a=1&b=2", "https://s.t/"}
    with pytest.raises(ValueError):
        frontier.walk_sitemaps(sitemaps, roots, limit=1)
    robots = spark.createDataFrame([("r", "User-agent: *\nSITEMAP: https://s.t/a.xml \r\n sitemap:https://s.t/a.xml\n#sitemap: no")], "url string, body string")
    assert [r.sitemap for r in frontier.robots_sitemaps(robots).orderBy("position").collect()] == ["https://s.t/a.xml"] * 2
    merged = frontier.merge({"sitemap": docs.select("url"), "seed_page": docs.select("url").limit(1)})
    assert frontier.adapters(merged).first().frontier_count == 2
    assert frontier.or_seed(merged.limit(0), spark.createDataFrame([("https://s.t#x",)], "url string")).first().url == "https://s.t/"
    tree = spark.createDataFrame([("README.md",), ("x/y/z.md",), ("content/docs/a.mdx",), ("content/docs/meta.json",)], "path string")
    assert frontier.docs_root(tree).first().root == "content/docs" and frontier.docs_root(tree.where("path LIKE 'x%'")).first().root == "x/y"
    assert [tuple(r) for r in frontier.git_frontier(tree, "https://g/r.git", "main", "content/docs").collect()] == [("git+https://g/r.git#main:a.mdx", "a.mdx", "seed_page", "text/mdx")]
    assert frontier.navigation_files(tree).count() == 1
