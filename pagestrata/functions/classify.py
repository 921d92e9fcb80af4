"""What an address or a response is, as ordered CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagestrata.functions import urls
from pagestrata.functions.text import ascii_lower, trimmed

#: The suggested mode of each kind of input.
MODES = {
    "llms_txt": "discovery_root", "llms_full_txt": "discovery_root", "sitemap": "discovery_root", "robots_txt": "discovery_root", "site_root": "discovery_root",
    "content_page": "hybrid_seed", "markdown_endpoint": "hybrid_seed",
    "markdown_file": "single_file", "pdf_file": "single_file", "office_document": "single_file", "openapi_spec": "single_file", "json_file": "single_file", "html_file": "single_file",
    "unknown": "single_document",
}
#: Signs of a page that a script renders.
DYNAMIC_MARKERS = ['id="__next"', 'id="__docusaurus"', "data-reactroot", "window.__next_data__", 'type="module"', "vite"]


def input_kind(url: Column, requested_root: Column, content_type: Column, markdown_supported: Column) -> Column:
    """The kind of an input; the first rule that fits holds."""
    path = F.lower(urls.path(url))
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(path.rlike("/llms[.]txt$"), "llms_txt")
        .when(path.rlike("/llms-full[.]txt$"), "llms_full_txt")
        .when(path.rlike("/robots[.]txt$"), "robots_txt")
        .when(path.rlike("sitemap[.]xml$|sitemap.*[.]xml$"), "sitemap")
        .when(requested_root, "site_root")
        .when(path.endswith(".pdf") | kind.startswith("application/pdf"), "pdf_file")
        .when(path.rlike("[.](doc|docx|ppt|pptx|xls|xlsx)$"), "office_document")
        .when(path.rlike("[.]mdx?$"), "markdown_file")
        .when(path.rlike("(openapi|swagger)[.]json$|openapi[.]ya?ml$"), "openapi_spec")
        .when(path.endswith(".json") | kind.startswith("application/json"), "json_file")
        .when(path.rlike("[.]html?$"), "html_file")
        .when(path.isin("/", ""), "site_root")
        .when(markdown_supported, "markdown_endpoint")
        .when(kind.startswith("text/html") | (kind == ""), "content_page")
        .otherwise("unknown")
    )


def suggested_mode(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in MODES.items() for x in pair]), kind)


def markdown_supported(content_type: Column) -> Column:
    return F.coalesce(content_type.startswith("text/markdown"), F.lit(False))


def is_markdown_response(url: Column, content_type: Column) -> Column:
    path, kind = ascii_lower(urls.path(url)), ascii_lower(F.coalesce(content_type, F.lit("")))
    return kind.startswith("text/markdown") | path.rlike("[.]mdx?$") | (kind.startswith("text/plain") & ~path.endswith(".txt"))


def is_html_response(content_type: Column) -> Column:
    return ascii_lower(F.coalesce(content_type, F.lit(""))).startswith("text/html")


def needs_rendering(html: Column, markdown: Column) -> Column:
    """Thin Markdown from a page with many scripts or a sign of a script framework."""
    lower = ascii_lower(html)
    marked = F.lit(False)
    for marker in DYNAMIC_MARKERS:
        marked = marked | lower.contains(marker)
    scripts = F.regexp_count(lower, F.lit("<script")) >= 5
    return (scripts | marked) & (F.octet_length(trimmed(markdown)) < 400)


def promotes_to_root(url: Column, requested_root: Column, kind: Column, root: Column, llms_available: Column, sitemaps: Column) -> Column:
    """Whether a content page on the root's host should be crawled as part of the whole site."""
    return ~requested_root & (kind == "content_page") & urls.same_host(url, root) & urls.is_docs_path(urls.path(url)) & (llms_available | (sitemaps > 0))


def response_route(status_code: Column, has_previous: Column, url: Column, content_type: Column) -> Column:
    """What becomes of a response: reuse, markdown, html or skip."""
    good = status_code.between(200, 299)
    return (
        F.when((status_code == 304) & has_previous, "reuse")
        .when(good & is_markdown_response(url, content_type), "markdown")
        .when(good & is_html_response(content_type), "html")
        .otherwise("skip")
    )


def skipped_status(status_code: Column) -> Column:
    return F.when(status_code.between(200, 299), "skipped_non_markdown").otherwise(F.concat(F.lit("skipped_http_"), status_code.cast("string")))


def recommendations(kind: Column, markdown: Column, llms_available: Column, sitemaps: Column) -> Column:
    """The codes of what is advised, in order: how to treat the input, how to fetch it, where to find its pages."""
    treat = (
        F.when(kind.isin("llms_txt", "llms_full_txt"), "expand_index")
        .when(kind.isin("sitemap", "robots_txt"), "discovery_seed")
        .when(kind.isin("pdf_file", "office_document", "markdown_file", "openapi_spec", "json_file"), "single_asset")
        .when(kind.isin("content_page", "markdown_endpoint"), "page_seed")
    )
    return F.array_compact(F.array(
        treat,
        F.when(markdown, "negotiate_markdown").otherwise("extract_html"),
        F.when(llms_available, "use_llms_index"),
        F.when(sitemaps > 0, "seed_from_sitemaps"),
        F.when(~llms_available & (sitemaps == 0), "expect_partial_coverage"),
    ))
