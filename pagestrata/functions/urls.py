"""Addresses, paths and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagestrata.functions.text import ascii_lower, sha256_hex, trimmed

# Patterns that both engines read alike.
ORIGIN = "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
QUERY = "^[^?#]*[?]([^#]*)"
#: What marks a path as documentation.
DOCS_MARKERS = "doc|guide|manual|reference|learn|tutorial|api|sdk|start"


def origin(url: Column) -> Column:
    return F.regexp_extract(url, ORIGIN, 1)


def host(url: Column) -> Column:
    """The lower-case host without port and user; null if there is none."""
    found = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(found != "", found)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def query(url: Column) -> Column:
    """The query without its question mark; null if there is none."""
    return F.when(url.rlike("^[^?#]*[?]"), F.regexp_extract(url, QUERY, 1))


def normalized(text: Column) -> Column:
    """A typed address as a URL: https unless http is given, lower-case host, at least a root path; null without a host."""
    bare = trimmed(text)
    full = F.when(bare.rlike("^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))
    rest = F.substring(full, F.length(origin(full)) + 1, F.length(full))
    slash = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host(full).isNotNull(), F.concat(F.lower(origin(full)), slash))


def canonical(url: Column) -> Column:
    """Without fragment and with at least a root path; the query and a final slash stay."""
    bare = F.regexp_replace(url, "#.*$", "")
    rest = F.substring(bare, F.length(origin(bare)) + 1, F.length(bare))
    return F.when(path(bare) == "", F.concat(origin(bare), F.lit("/"), rest)).otherwise(bare)


def site_root(url: Column) -> Column:
    return F.concat(origin(url), F.lit("/"))


def same_host(a: Column, b: Column) -> Column:
    return F.coalesce(host(a) == host(b), F.lit(False))


def valid_source_name(name: Column) -> Column:
    return name.rlike("^[a-z0-9_-]+\\z")


def ref_label(text: Column) -> Column:
    """Signs other than letters, digits, dot, dash and underscore become single dashes, none at the ends."""
    dashed = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]", "-"), "--+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def path_segment(text: Column) -> Column:
    label = ref_label(text)
    return F.when(label == "", "index").otherwise(label)


def storage_stem(url: Column) -> Column:
    """Where a page is stored: host and path segments, with a short hash of the query if there is one."""
    inner = F.regexp_replace(path(url), "^/+|/+$", "")
    segments = F.when(inner == "", F.lit("index")).otherwise(F.array_join(F.transform(F.split(inner, "/"), path_segment), "/"))
    stem = F.concat_ws("/", path_segment(F.coalesce(host(url), F.lit("unknown-host"))), segments)
    return F.concat(stem, F.coalesce(F.concat(F.lit("--q-"), F.substring(sha256_hex(query(url)), 1, 8)), F.lit("")))


def markdown_path(stem: Column) -> Column:
    return (
        F.when(stem.endswith(".md"), stem)
        .when(stem.endswith(".mdx"), F.concat(F.regexp_replace(stem, "([.]mdx)+$", ""), F.lit(".md")))
        .otherwise(F.concat(stem, F.lit(".md")))
    )


def metadata_path(page_path: Column) -> Column:
    return F.concat(page_path, F.lit(".json"))


def chunk_path(stem: Column, ordinal: Column) -> Column:
    return F.concat(F.regexp_replace(stem, "[.]md$", ""), F.lit("__chunk-"), F.format_string("%03d", ordinal), F.lit(".md"))


def git_page_id(repo: Column, ref: Column, relative: Column) -> Column:
    return F.concat(F.lit("git+"), repo, F.lit("#"), ref, F.lit(":"), relative)


def content_type_of(file_path: Column) -> Column:
    return F.when(file_path.endswith(".mdx"), "text/mdx").otherwise("text/markdown")


def clean_tags(tags: Column) -> Column:
    """Trimmed lower-case tags, each once, sorted; blank and null ones are dropped."""
    plain = F.transform(tags, lambda t: ascii_lower(trimmed(t)))
    return F.array_sort(F.array_distinct(F.filter(plain, lambda t: t.isNotNull() & (t != ""))))


def default_label(requested: Column, default_ref: Column, day: Column) -> Column:
    return F.coalesce(requested, default_ref, F.concat(F.lit("snapshot-"), F.date_format(day, "yyyyMMdd")))


def is_docs_path(url_path: Column) -> Column:
    return F.lower(F.regexp_replace(url_path, "^/+|/+$", "")).rlike(DOCS_MARKERS)


def relative_to(file_path: Column, root: Column) -> Column:
    inside = F.when(F.startswith(file_path, root), F.substring(file_path, F.length(root) + 1, F.length(file_path))).otherwise(file_path)
    return F.replace(F.regexp_replace(inside, "^/+", ""), F.lit("\\"), F.lit("/"))


def link_with_rel(header: Column, rel: str) -> Column:
    """The target of the first entry of a Link header that has the given relation."""
    entries = F.filter(F.split(header, ","), lambda e: e.contains(f'rel="{rel}"') | e.contains(f"rel={rel}"))
    target = F.regexp_extract(F.try_element_at(entries, F.lit(1)), "<([^>]*)>", 1)
    return F.when(target != "", target)


def index_link_count(body: Column) -> Column:
    """Lines of an index document that hold a link."""
    return F.size(F.filter(F.split(body, "\n"), lambda line: line.contains("](") | line.contains("https://")))


def resolved_link(base: Column, link: Column) -> Column:
    """A link of a page as an absolute URL on the page's host, else null.

    Kept are http(s) links and those that begin with ``/``, ``./`` or ``../``; dot segments are resolved.
    Anything else, bare relative names included, is dropped.
    """
    absolute = link.rlike("^https?://")
    rooted = link.startswith("/") & ~link.startswith("//")
    dotted = link.startswith("./") | link.startswith("../")
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    joined = F.when(rooted, link).when(dotted, F.concat(F.when(folder == "", "/").otherwise(folder), link))
    cleaned = F.when(joined.isNotNull(), F.concat(origin(base), without_dots(joined)))
    target = F.when(absolute, link).otherwise(cleaned)
    return F.when((link != "") & ~link.startswith("#") & same_host(base, target), canonical(target))


def without_dots(rooted_path: Column) -> Column:
    """A rooted path without ``.`` and ``..`` segments; its query and fragment are left alone."""
    tail = F.regexp_extract(rooted_path, "^[^?#]*(.*)$", 1)
    parts = F.split(F.regexp_extract(rooted_path, "^([^?#]*)", 1), "/")
    last = F.element_at(parts, -1)
    walk = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when((p == ".") | (p == "") & (F.size(done) == 0), done)
        .otherwise(F.array_append(done, p)),
    )
    ended = F.when(last.isin(".", "..") & (F.size(walk) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(walk, "/"), ended, tail)
