"""The set of page addresses of a site, from its indexes, sitemaps and robots files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.functions import urls
from pagestrata.functions.text import ascii_lower, lines, trimmed
from pagestrata.session import cut

#: Where an address may come from, strongest first.
ORIGINS = ["seed_page", "llms_txt", "llms_full_txt", "sitemap"]
MAX_SITEMAPS = 32
LINK = "\\]\\(([^)]*)\\)"
#: The signs stripped from a bare address in running text.
WRAPPING = "\"'`()[]<>{},"


def entry_kind(url: Column) -> Column:
    """How an entry address is read: as an index, a sitemap, a robots file or by probing."""
    path = F.lower(urls.path(url))
    return (
        F.when(path.rlike("/llms(-full)?[.]txt$"), "llms_index").when(path.contains("sitemap") & path.endswith(".xml"), "sitemap")
        .when(path.endswith("/robots.txt"), "robots").otherwise("probe")
    )


def index_links(documents: DataFrame) -> DataFrame:
    """Distinct (url, index_url) of the links and bare addresses in index documents (url, body), on the document's host.

    Links are resolved against the document; other hosts, fragments and bare relative names are dropped.
    """
    held = documents.where("body IS NOT NULL").select(F.col("url").alias("base"), F.explode(lines(F.col("body"))).alias("line"))
    marked = held.select("base", F.explode(F.regexp_extract_all("line", F.lit(LINK), F.lit(1))).alias("link"))
    linked = marked.select("base", urls.resolved_link(F.col("base"), trimmed(F.col("link"))).alias("url"))
    tokens = held.select("base", F.explode(F.split("line", "[ \\t\\r\\f\\v]+")).alias("token"))
    bare = tokens.select("base", F.btrim("token", F.lit(WRAPPING)).alias("link")).where(F.col("link").rlike("^https?://"))
    named = bare.select("base", urls.resolved_link(F.col("base"), F.col("link")).alias("url"))
    return linked.unionByName(named).where("url IS NOT NULL").select("url", F.col("base").alias("index_url")).distinct()


def robots_sitemaps(documents: DataFrame) -> DataFrame:
    """(robots_url, position, sitemap) of the sitemap lines of robots files (url, body), in their order, repeats kept."""
    held = documents.where("body IS NOT NULL").select(F.col("url").alias("robots_url"), F.posexplode(lines(F.col("body"))).alias("position", "line"))
    bare = trimmed(F.col("line"))
    return held.where(ascii_lower(F.substring(bare, 1, 8)) == "sitemap:").select("robots_url", "position", trimmed(F.substring(bare, 9, 2**31 - 1)).alias("sitemap"))


def sitemap_entries(documents: DataFrame) -> DataFrame:
    """Distinct (sitemap_url, kind, url) of sitemap documents (url, body): kind is page or sitemap.

    Bodies that aren't XML have no entries; an address is canonical, and one without a host is dropped.
    """
    held = documents.select(F.col("url").alias("sitemap_url"), F.col("body")).where(F.try_to_binary("body", F.lit("utf-8")).isNotNull() & F.col("body").rlike("<(urlset|sitemapindex)[^>]*>"))
    found = held.select(
        "sitemap_url",
        F.explode(F.concat(
            F.transform(F.expr("xpath(body, '//url/loc/text()')"), lambda u: F.struct(F.lit("page").alias("kind"), u.alias("loc"))),
            F.transform(F.expr("xpath(body, '//sitemap/loc/text()')"), lambda u: F.struct(F.lit("sitemap").alias("kind"), u.alias("loc"))),
        )).alias("e"),
    )
    url = urls.canonical(trimmed(F.col("e.loc")))
    return found.where(urls.host(trimmed(F.col("e.loc"))).isNotNull()).select("sitemap_url", "e.kind", url.alias("url")).distinct()


def walk_sitemaps(documents: DataFrame, roots: DataFrame, limit: int = MAX_SITEMAPS) -> DataFrame:
    """Distinct (root, url) of the pages reached from root sitemaps (root) through nested ones.

    A round follows one level of nesting, all roots at once. A root from which more than ``limit`` documents are
    reached is an error, as a site that large is to be given in parts.
    """
    entries = sitemap_entries(documents)
    reached = roots.select("root", F.col("root").alias("sitemap_url")).distinct()
    new = reached
    nested = entries.where("kind = 'sitemap'").select("sitemap_url", F.col("url").alias("child"))
    for _ in range(limit):
        step = new.join(nested, "sitemap_url").select("root", F.col("child").alias("sitemap_url")).distinct()
        new = cut(step.join(reached, ["root", "sitemap_url"], "left_anti"))
        if new.isEmpty():
            break
        reached = cut(reached.unionByName(new))
        worst = reached.groupBy("root").count().agg(F.max("count")).first()[0]
        if worst > limit:
            raise ValueError(f"more than {limit} sitemap documents below one root")
    pages = entries.where("kind = 'page'").select("sitemap_url", "url")
    return reached.join(pages, "sitemap_url").select("root", "url").distinct()


def merge(frontiers: dict[str, DataFrame]) -> DataFrame:
    """(url, discovered_from) of frontiers by origin: each address once, with its strongest origin."""
    rank = F.array_position(F.array(*[F.lit(o) for o in ORIGINS]), F.col("discovered_from"))
    all_rows = reduce(DataFrame.unionByName, [df.select("url", F.lit(name).alias("discovered_from")) for name, df in frontiers.items()])
    return all_rows.where("url IS NOT NULL").groupBy("url").agg(F.min_by("discovered_from", rank).alias("discovered_from"))


def or_seed(frontier: DataFrame, seed: DataFrame) -> DataFrame:
    """The frontier, or the seed address (url) alone where it is empty."""
    any_row = frontier.select(F.lit(1).alias("__any")).limit(1)
    fallback = seed.select(F.lit(1).alias("__any"), urls.canonical(F.col("url")).alias("url"), F.lit("seed_page").alias("discovered_from"))
    return frontier.unionByName(fallback.join(any_row, "__any", "left_anti").select("url", "discovered_from"))


def adapters(frontier: DataFrame, *by: str) -> DataFrame:
    """The sorted origins that are present."""
    grouped = frontier.groupBy(*by) if by else frontier.groupBy()
    return grouped.agg(F.array_sort(F.collect_set("discovered_from")).alias("adapters"), F.count(F.lit(1)).alias("frontier_count"))


def docs_root(files: DataFrame) -> DataFrame:
    """(root): where the documentation of a file tree (path) lies: the first candidate folder that holds Markdown, else the shallowest."""
    # The candidates, in order.
    candidates = ["docs", "apps/docs/content", "content/docs", "apps/v4/content/docs", "website/content"]
    md = files.where(F.col("path").rlike("[.]mdx?$"))
    rank = F.coalesce(*[F.when(F.startswith(F.col("path"), F.lit(c + "/")), F.lit(k)) for k, c in enumerate(candidates)], F.lit(len(candidates)))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    named = F.when(rank < len(candidates), F.element_at(F.array(*[F.lit(c) for c in candidates]), F.least(rank + 1, F.lit(len(candidates))))).otherwise(folder)
    depth = F.size(F.filter(F.split(named, "/"), lambda s: s != ""))
    return md.where((rank < len(candidates)) | (folder != "")).agg(F.min(F.struct(rank.alias("rank"), depth.alias("depth"), named.alias("root")))["root"].alias("root"))


def git_frontier(files: DataFrame, repo: str, ref: str, root: str) -> DataFrame:
    """(url, page_key, discovered_from, content_type) of the Markdown files (path) below a root, by path."""
    relative = urls.relative_to(F.col("path"), F.lit(root))
    inside = files.where(F.col("path").rlike("[.]mdx?$") & (F.startswith(F.col("path"), F.lit(root + "/")) | F.lit(root == "")))
    return inside.select(
        urls.git_page_id(F.lit(repo), F.lit(ref), relative).alias("url"), relative.alias("page_key"), F.lit("seed_page").alias("discovered_from"), urls.content_type_of(F.col("path")).alias("content_type")
    )


def navigation_files(files: DataFrame) -> DataFrame:
    """The files (path) that describe a site's navigation."""
    return files.where(F.regexp_extract("path", "([^/]*)$", 1).isin("meta.json", "docs.json", "mint.json")).select("path")
