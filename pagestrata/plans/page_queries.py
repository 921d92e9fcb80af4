"""Queries of the operators over addresses, pages, quality, chunks, changes and imports, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.functions import classify, text, urls
from pagestrata.operators import chunk, diff, frontier, html, import_plan, normalize, quality, ranks, snapshot_merkle, summary
from pagestrata.plans import pipeline
from pagestrata.plans.corpus_queries import P3_SQL
from pagestrata.plans.normalize_sql import NORMAL_SQL, NORMALIZED_SQL
from pagestrata.session import cut
from pagestrata.sources.tables import table

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# What the SQL texts share.
WS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def ltrim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+', '')"


def lines_sql(c: str) -> str:
    return f"CASE WHEN length({c}) = 0 THEN [] ELSE string_split(replace(regexp_replace({c}, '\\r?\\n$', ''), chr(13) || chr(10), chr(10)), chr(10)) END"


def words_sql(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^{WS}]+'))"


ORIGIN, HOST, PATH = (f"regexp_extract(url, '{p}', 1)" for p in (urls.ORIGIN, urls.HOST, urls.PATH))


def label_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '[^A-Za-z0-9._-]', '-', 'g'), '--+', '-', 'g'), '^-+|-+$', '', 'g')"


def segment_sql(c: str) -> str:
    return f"coalesce(nullif({label_sql(c)}, ''), 'index')"


def _urls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("url").where("url IS NOT NULL").distinct()


@query(f"""SELECT url, {ORIGIN} AS origin, nullif(lower({HOST}), '') AS host, {PATH} AS path,
  CASE WHEN regexp_matches(url, '^[^?#]*[?]') THEN regexp_extract(url, '{urls.QUERY}', 1) END AS query
  FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)""")
def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("url")
    return _urls(spark, folder).select("url", urls.origin(u).alias("origin"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query(u).alias("query"))


@query(f"""WITH u AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS url FROM pages WHERE url IS NOT NULL)
  SELECT DISTINCT CASE WHEN {PATH} = '' THEN {ORIGIN} || '/' || substr(url, length({ORIGIN}) + 1) ELSE url END AS canonical, {ORIGIN} || '/' AS site_root FROM u""")
def url_canonical(spark: SparkSession, folder: str) -> DataFrame:
    bare = F.regexp_replace("url", "#.*$", "")
    return _urls(spark, folder).select(urls.canonical(F.col("url")).alias("canonical"), urls.site_root(bare).alias("site_root")).distinct()


@query(f"""WITH u AS (SELECT DISTINCT url, regexp_replace({PATH}, '^/+|/+$', '', 'g') AS inner_path FROM pages WHERE url IS NOT NULL),
  s AS (SELECT url, concat_ws('/', {segment_sql(f"coalesce(nullif(lower({HOST}), ''), 'unknown-host')")},
    CASE WHEN inner_path = '' THEN 'index' ELSE array_to_string(list_transform(string_split(inner_path, '/'), lambda x: {segment_sql('x')}), '/') END)
    || CASE WHEN regexp_matches(url, '^[^?#]*[?]') THEN '--q-' || substr(sha256(regexp_extract(url, '{urls.QUERY}', 1)), 1, 8) ELSE '' END AS stem FROM u),
  m AS (SELECT url, stem, CASE WHEN stem LIKE '%.md' THEN stem WHEN stem LIKE '%.mdx' THEN regexp_replace(stem, '([.]mdx)+$', '') || '.md' ELSE stem || '.md' END AS page_path FROM s)
  SELECT url, stem, page_path, page_path || '.json' AS metadata_path, regexp_replace(stem, '[.]md$', '') || '__chunk-' || '007' || '.md' AS chunk_path FROM m""")
def url_storage(spark: SparkSession, folder: str) -> DataFrame:
    stem = urls.storage_stem(F.col("url"))
    paths = _urls(spark, folder).select("url", stem.alias("stem")).withColumn("page_path", urls.markdown_path(F.col("stem")))
    return paths.select("*", urls.metadata_path(F.col("page_path")).alias("metadata_path"), urls.chunk_path(F.col("stem"), F.lit(7)).alias("chunk_path"))


@query(f"""SELECT DISTINCT url, regexp_matches(lower(regexp_replace({PATH}, '^/+|/+$', '', 'g')), '{urls.DOCS_MARKERS}') AS is_docs FROM pages WHERE url IS NOT NULL""")
def url_docs_like(spark: SparkSession, folder: str) -> DataFrame:
    return _urls(spark, folder).select("url", urls.is_docs_path(urls.path(F.col("url"))).alias("is_docs"))


@query(f"""SELECT doc_id, {label_sql("concat(source, '@', lang, '/', doc_id)")} AS label, regexp_matches(source, '^[a-z0-9_-]+$') AS valid_name
  FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def labels_sanitized(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    return docs.select("doc_id", urls.ref_label(F.concat("source", F.lit("@"), "lang", F.lit("/"), "doc_id")).alias("label"), urls.valid_source_name(F.col("source")).alias("valid_name"))


@query("""SELECT name, array_to_string(list_sort(list_distinct(list_filter(list_transform(tags, lambda t: lower(trim(t))), lambda t: t IS NOT NULL AND t <> ''))), ',') AS tags,
  coalesce(default_ref, 'snapshot-' || strftime(created_at, '%Y%m%d')) AS default_label FROM sources""")
def sources_registry(spark: SparkSession, folder: str) -> DataFrame:
    label = urls.default_label(F.lit(None).cast("string"), F.col("default_ref"), F.col("created_at"))
    tags = F.when(F.col("tags").isNotNull(), F.array_join(urls.clean_tags(F.col("tags")), ","))
    return table(spark, folder, "sources").select("name", tags.alias("tags"), label.alias("default_label"))


_KIND_SQL = f"""CASE WHEN regexp_matches(lower({PATH}), '/llms[.]txt$') THEN 'llms_txt' WHEN regexp_matches(lower({PATH}), '/llms-full[.]txt$') THEN 'llms_full_txt'
  WHEN regexp_matches(lower({PATH}), '/robots[.]txt$') THEN 'robots_txt' WHEN regexp_matches(lower({PATH}), 'sitemap.*[.]xml$') THEN 'sitemap'
  WHEN lower({PATH}) LIKE '%.pdf' OR lower(coalesce(content_type, '')) LIKE 'application/pdf%' THEN 'pdf_file'
  WHEN regexp_matches(lower({PATH}), '[.](doc|docx|ppt|pptx|xls|xlsx)$') THEN 'office_document'
  WHEN regexp_matches(lower({PATH}), '[.]mdx?$') THEN 'markdown_file' WHEN regexp_matches(lower({PATH}), '(openapi|swagger)[.]json$|openapi[.]ya?ml$') THEN 'openapi_spec'
  WHEN lower({PATH}) LIKE '%.json' OR lower(coalesce(content_type, '')) LIKE 'application/json%' THEN 'json_file'
  WHEN regexp_matches(lower({PATH}), '[.]html?$') THEN 'html_file' WHEN {PATH} IN ('/', '') THEN 'site_root'
  WHEN content_type LIKE 'text/markdown%' THEN 'markdown_endpoint'
  WHEN lower(coalesce(content_type, '')) LIKE 'text/html%' OR coalesce(content_type, '') = '' THEN 'content_page' ELSE 'unknown' END"""


@query(f"""SELECT kind, CASE WHEN kind IN ('llms_txt', 'llms_full_txt', 'sitemap', 'robots_txt', 'site_root') THEN 'discovery_root' WHEN kind IN ('content_page', 'markdown_endpoint') THEN 'hybrid_seed'
  WHEN kind = 'unknown' THEN 'single_document' ELSE 'single_file' END AS mode, count(*) AS pages FROM (SELECT {_KIND_SQL} AS kind FROM pages WHERE url IS NOT NULL) GROUP BY ALL""")
def input_kinds(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").where("url IS NOT NULL").select("url", "content_type")
    kind = classify.input_kind(F.col("url"), F.lit(False), F.col("content_type"), classify.markdown_supported(F.col("content_type")))
    return pages.select(kind.alias("kind")).withColumn("mode", classify.suggested_mode(F.col("kind"))).groupBy("kind", "mode").agg(F.count(F.lit(1)).alias("pages"))


@query(f"""WITH p AS (SELECT page_key, url, content_type, CASE WHEN status LIKE 'skipped_http_%' THEN CAST(substr(status, 14) AS INT) WHEN status = 'reused_not_modified' THEN 304 ELSE 200 END AS code
    FROM pages WHERE url IS NOT NULL AND status IS NOT NULL AND status <> 'removed')
  SELECT route, count(*) AS pages FROM (SELECT CASE WHEN code = 304 THEN 'reuse'
    WHEN code BETWEEN 200 AND 299 AND (lower(coalesce(content_type, '')) LIKE 'text/markdown%' OR regexp_matches(lower({PATH}), '[.]mdx?$') OR (lower(coalesce(content_type, '')) LIKE 'text/plain%' AND lower({PATH}) NOT LIKE '%.txt')) THEN 'markdown'
    WHEN code BETWEEN 200 AND 299 AND lower(coalesce(content_type, '')) LIKE 'text/html%' THEN 'html' ELSE 'skip' END AS route FROM p) GROUP BY 1""")
def response_routes(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").where("url IS NOT NULL AND status IS NOT NULL AND status <> 'removed'")
    code = F.when(F.startswith("status", F.lit("skipped_http_")), F.substring("status", 14, 9).try_cast("int")).when(F.col("status") == "reused_not_modified", 304).otherwise(200)
    route = classify.response_route(code, F.lit(True), F.col("url"), F.col("content_type"))
    return pages.select(route.alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("pages"))


_TRIMMED_LINES = f"list_filter({lines_sql('markdown')}, lambda x: {trim_sql('x')} <> '')"
_METRICS_SQL = rf"""WITH l AS (SELECT body_id, source_name, markdown, {_TRIMMED_LINES} AS ls FROM page_bodies),
m AS (SELECT body_id, source_name,
  len(regexp_extract_all(markdown, '[A-Za-z0-9][A-Za-z0-9''_-]*')) AS word_count,
  CASE WHEN markdown IS NOT NULL THEN len(ls) END AS non_empty_lines,
  CASE WHEN markdown IS NOT NULL THEN len(list_filter(ls, lambda x: NOT starts_with({ltrim_sql('x')}, '```') AND regexp_matches(x, '[A-Za-z0-9]'))) END AS text_lines,
  CASE WHEN markdown IS NOT NULL THEN len(list_filter(ls, lambda x: starts_with({ltrim_sql('x')}, '#'))) END AS heading_count,
  CASE WHEN markdown IS NOT NULL THEN len(list_filter(ls, lambda x: starts_with({ltrim_sql('x')}, '```'))) // 2 END AS code_block_count,
  len(regexp_extract_all(markdown, '\[[^\]]+\]\([^)]+\)')) AS link_count,
  len(regexp_extract_all(markdown, '<[a-z][^>]*>')) AS residual_html_tags,
  len(regexp_extract_all(markdown, '</?[A-Z][A-Za-z0-9]*(?:[ \t\n\r\f\v][^>]*)?>')) AS residual_mdx_components,
  CASE WHEN markdown IS NOT NULL THEN coalesce(starts_with({ltrim_sql('ls[1]')}, '# '), false) END AS title_present FROM l),
s AS (SELECT *, CASE WHEN non_empty_lines = 0 THEN 0.0 ELSE round(text_lines / non_empty_lines, 4) END AS text_density,
  (text_lines * 100 < non_empty_lines * 45 OR non_empty_lines = 0) AS thin45, (text_lines * 100 < non_empty_lines * 60 OR non_empty_lines = 0) AS thin60,
  (heading_count = 0 AND word_count > 60) AS weak FROM m),
q AS (SELECT *, CASE WHEN word_count IS NOT NULL THEN CAST(greatest(0, least(100,
    CASE WHEN word_count = 0 THEN 0 ELSE 100 - CASE WHEN title_present THEN 0 ELSE 12 END - CASE WHEN word_count < 15 THEN 45 WHEN word_count < 40 THEN 25 WHEN word_count < 80 THEN 10 ELSE 0 END END
    - CASE WHEN non_empty_lines <= 3 THEN 20 ELSE 0 END - CASE WHEN thin45 THEN 20 WHEN thin60 THEN 10 ELSE 0 END
    - CASE WHEN residual_html_tags > 0 THEN least(residual_html_tags * 3, 24) ELSE 0 END
    - CASE WHEN residual_mdx_components > 0 THEN least(residual_mdx_components * 4, 20) ELSE 0 END - CASE WHEN weak THEN 8 ELSE 0 END)) AS INT) END AS score,
  CASE WHEN word_count IS NOT NULL THEN concat_ws(',', CASE WHEN NOT title_present THEN 'missing_title' END,
    CASE WHEN word_count = 0 THEN 'empty_content' WHEN word_count < 15 THEN 'very_short' WHEN word_count < 40 THEN 'short_content' END,
    CASE WHEN non_empty_lines <= 3 THEN 'too_few_lines' END, CASE WHEN thin45 THEN 'low_text_density' END, CASE WHEN residual_html_tags > 0 THEN 'residual_html' END,
    CASE WHEN residual_mdx_components > 0 THEN 'residual_mdx' END, CASE WHEN weak THEN 'weak_structure' END) END AS reasons FROM s),
r AS (SELECT *, CASE WHEN score >= 75 THEN 'high' WHEN score >= 45 THEN 'medium' WHEN score IS NOT NULL THEN 'low' END AS rating FROM q)
"""
_METRICS = ["word_count", "non_empty_lines", "text_lines", "heading_count", "code_block_count", "link_count", "residual_html_tags", "residual_mdx_components", "title_present", "text_density", "score", "rating", "reasons", "low_signal"]


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_pages(table(spark, folder, "page_bodies").select("body_id", "source_name", "markdown"))


@query(_METRICS_SQL + f"SELECT body_id, {', '.join(_METRICS[:-1])}, rating = 'low' AND (word_count < 40 OR score < 30) AS low_signal FROM r")
def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = _scored(spark, folder).withColumn("reasons", F.array_join("low_signal_reasons", ","))
    return scored.select("body_id", *_METRICS)


@query(_METRICS_SQL + """SELECT source_name, count(score) AS pages_scored, count(*) FILTER (rating = 'high') AS high_quality_pages, count(*) FILTER (rating = 'medium') AS medium_quality_pages,
  count(*) FILTER (rating = 'low') AS low_quality_pages, count(*) FILTER (NOT title_present) AS missing_title_pages,
  count(*) FILTER (residual_html_tags > 0 OR residual_mdx_components > 0) AS residual_markup_pages FROM r GROUP BY 1""")
def quality_summary(spark: SparkSession, folder: str) -> DataFrame:
    return quality.summarize(_scored(spark, folder), "source_name")


_SECTIONS_SQL = rf"""WITH RECURSIVE p AS (SELECT body_id, {lines_sql('markdown')} AS ls FROM page_bodies WHERE markdown IS NOT NULL),
x AS (SELECT body_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM p),
t AS (SELECT *, length(regexp_extract({ltrim_sql('line')}, '^(#*)', 1)) AS marks, {ltrim_sql('line')} AS s FROM x),
h AS (SELECT body_id, pos, line, CASE WHEN marks BETWEEN 1 AND 6 AND {trim_sql('substr(s, marks + 1)')} <> '' THEN marks END AS level,
  CASE WHEN marks BETWEEN 1 AND 6 AND {trim_sql('substr(s, marks + 1)')} <> '' THEN {trim_sql(f"regexp_replace({trim_sql('substr(s, marks + 1)')}, '^#+|#+$', '', 'g')")} END AS title FROM t),
n AS (SELECT *, count(level) OVER w AS section FROM h WINDOW w AS (PARTITION BY body_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, CASE WHEN section > 0 THEN section - 1 + least(0, min(level - section) OVER w) END AS depth FROM n WINDOW w AS (PARTITION BY body_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
sec AS (SELECT body_id, pos, line, section, CASE WHEN section > 0 THEN last_value(title IGNORE NULLS) OVER w END AS heading,
  CASE WHEN section > 0 THEN [{', '.join(f"last_value(CASE WHEN level IS NOT NULL AND depth = {k} THEN title END IGNORE NULLS) OVER w" for k in range(6))}][1:depth + 1] ELSE [] END AS section_path
  FROM d WINDOW w AS (PARTITION BY body_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, CASE WHEN starts_with({trim_sql('line')}, '```') OR starts_with({trim_sql('line')}, '~~~') THEN 1 ELSE 0 END AS fence FROM sec),
i AS (SELECT *, coalesce(sum(fence) OVER (PARTITION BY body_id, section ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM f),
e AS (SELECT *, ({trim_sql('line')} = '' AND NOT inside) AS blank, coalesce(lag(fence = 1 AND inside) OVER (PARTITION BY body_id, section ORDER BY pos), false) AS closed FROM i),
b AS (SELECT *, sum(CASE WHEN blank OR closed THEN 1 ELSE 0 END) OVER (PARTITION BY body_id, section ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM e),
g AS (SELECT body_id, section, block, any_value(heading) AS heading, any_value(section_path) AS section_path, {trim_sql("string_agg(line, chr(10) ORDER BY pos)")} AS markdown FROM b WHERE NOT blank GROUP BY 1, 2, 3),
blk AS (SELECT *, {words_sql('markdown')} AS word_count FROM g WHERE markdown <> '')
"""


@query(_SECTIONS_SQL + "SELECT DISTINCT body_id, section, heading, array_to_string(section_path, ' > ') AS section_path FROM sec")
def sections(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunk.with_sections(table(spark, folder, "page_bodies"), ["body_id"])
    return rows.select("body_id", "section", "heading", F.array_join("section_path", " > ").alias("section_path")).distinct()


@query(_SECTIONS_SQL + "SELECT body_id, section, CAST(block AS BIGINT) AS block, word_count, sha256(markdown) AS sha256 FROM blk")
def markdown_blocks(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunk.blocks(chunk.with_sections(table(spark, folder, "page_bodies"), ["body_id"]), ["body_id"])
    return rows.select("body_id", "section", F.col("block").cast("bigint").alias("block"), "word_count", F.sha2("markdown", 256).alias("sha256"))


_CHUNKS_SQL = _SECTIONS_SQL + rf""",
v AS (SELECT body_id, section, any_value(heading) AS heading, any_value(section_path) AS section_path, list(markdown ORDER BY block) AS mds, list(greatest(word_count, 1) ORDER BY block) AS ws FROM blk GROUP BY 1, 2),
sums AS (SELECT *, len(ws) AS n, list_transform(range(0, len(ws) + 1), lambda k: coalesce(list_sum(ws[1:k]), 0)) AS p FROM v),
walk AS (
  SELECT body_id, section, n, p, 0 AS s, CAST(coalesce(nullif(list_position(list_transform(p[2:], lambda y: y >= 220), true), 0), n) AS BIGINT) AS e FROM sums
  UNION ALL
  SELECT body_id, section, n, p, s2 AS s, CAST(s2 + coalesce(nullif(list_position(list_transform(p[s2 + 2:], lambda y: y - p[s2 + 1] >= 220), true), 0), n - s2) AS BIGINT) AS e
  FROM (SELECT *, CASE WHEN j = s THEN e ELSE j END AS s2 FROM (
    SELECT *, coalesce(list_max(list_filter(range(s, e), lambda q: p[e + 1] - p[q + 1] >= 40)), s) AS j FROM walk WHERE e < n))),
parts AS (SELECT w.body_id, w.section, w.s, w.e, sums.heading, sums.section_path, {trim_sql("array_to_string(sums.mds[w.s + 1:w.e], chr(10) || chr(10))")} AS markdown FROM walk w JOIN sums USING (body_id, section)),
c AS (SELECT *, row_number() OVER (PARTITION BY body_id ORDER BY section, s, e) AS ordinal FROM parts)
"""


@query(_CHUNKS_SQL + f"""SELECT body_id, ordinal, heading, array_to_string(section_path, ' > ') AS section_path, {words_sql('markdown')} AS word_count, sha256(markdown) AS sha256,
  strlen(markdown) AS byte_size, sha256(concat_ws('::', body_id, ordinal, array_to_string(section_path, ' > '))) AS chunk_id FROM c""")
def chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunk.chunk_pages(table(spark, folder, "page_bodies"), ["body_id"])
    return rows.withColumn("section_path", F.array_join("section_path", " > ")).select("body_id", "ordinal", "heading", "section_path", "word_count", "sha256", "byte_size", "chunk_id")


@query(_CHUNKS_SQL + "SELECT count(*) AS chunk_count, count(DISTINCT body_id) AS chunked_pages, round(count(*) / count(DISTINCT body_id), 4) AS average_chunks_per_page FROM c")
def chunk_summary(spark: SparkSession, folder: str) -> DataFrame:
    return chunk.summarize(chunk.chunk_pages(table(spark, folder, "page_bodies"), ["body_id"]), ["body_id"])


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.sha256_hex(F.col("text")).alias("sha256"))


def _snapshot_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of pages with its place in its snapshot's manifest."""
    order = ["page_key", "fetched_at", "status", "sha256", "change_status", "url", "final_url"]
    pages = table(spark, folder, "pages").select("source_name", "snapshot_label", *order, "page_path", F.struct("quality.rating", "quality.word_count", "quality.score").alias("quality"))
    return ranks.with_row_number(pages, ["source_name", "snapshot_label"], order, "idx")


_IDX_SQL = """i AS (SELECT *, row_number() OVER (PARTITION BY source_name, snapshot_label ORDER BY page_key NULLS FIRST, fetched_at NULLS FIRST, status NULLS FIRST, sha256 NULLS FIRST, change_status NULLS FIRST, url NULLS FIRST, final_url NULLS FIRST) AS idx FROM pages),
k AS (SELECT *, regexp_replace(coalesce(nullif(final_url, ''), nullif(url, ''), replace(page_path, '\\', '/'), ''), '/+$', '') AS plain,
  coalesce(sha256, 'row:' || idx) AS grp FROM i),
o AS (SELECT *, first_value(idx) OVER (PARTITION BY source_name, snapshot_label, grp ORDER BY regexp_matches(plain, '[?#]'), lower(plain) LIKE '%.md', regexp_matches(lower(plain), '/index([.]md)?$'),
  len(list_filter(string_split(plain, '/'), lambda s: s <> '' AND NOT contains(s, ':'))), strlen(plain), plain, idx) AS canonical_idx,
  count(*) OVER (PARTITION BY source_name, snapshot_label, grp) AS group_size FROM k)"""


@query(f"WITH {_IDX_SQL} SELECT source_name, snapshot_label, sha256, canonical_idx, any_value(group_size) AS group_size FROM o WHERE sha256 IS NOT NULL GROUP BY ALL")
def canonical_pages(spark: SparkSession, folder: str) -> DataFrame:
    marked = import_plan.mark_duplicates(_snapshot_pages(spark, folder), "idx", "source_name", "snapshot_label")
    return marked.where("sha256 IS NOT NULL").select("source_name", "snapshot_label", "sha256", F.col("canonical_idx").cast("bigint").alias("canonical_idx"), "group_size").distinct()


# Every fetched snapshot and the one before it; keys carry their source and snapshot.
_DIFF_SQL = P3_SQL.split("now AS (")[0] + """
cur AS (SELECT concat_ws('|', p.source_name, p.snapshot_label, l.page_key) AS page_key, l.sha AS sha256 FROM pairs p JOIN live l USING (source_name, snapshot_label)),
prev AS (SELECT concat_ws('|', p.source_name, p.snapshot_label, l.page_key) AS page_key, l.sha AS sha256 FROM pairs p JOIN live l ON l.source_name = p.source_name AND l.snapshot_label = p.previous_label),
d AS (SELECT c.page_key, c.sha256, p.sha256 AS previous_hash, CASE WHEN c.sha256 IS NULL THEN 'unknown' WHEN p.page_key IS NULL OR p.sha256 IS NULL THEN 'new'
    WHEN c.sha256 = p.sha256 THEN 'unchanged' ELSE 'changed' END AS change_status FROM cur c LEFT JOIN prev p USING (page_key)
  UNION ALL SELECT page_key, NULL, sha256, 'removed' FROM prev ANTI JOIN cur USING (page_key))"""


def _diffed(spark: SparkSession, folder: str) -> DataFrame:
    pairs = snapshot_merkle.snapshot_pairs(table(spark, folder, "snapshots"))
    live = snapshot_merkle.live_pages(table(spark, folder, "pages"))
    key = F.concat_ws("|", "source_name", "snapshot_label", "page_key")
    empty = F.lit(None).cast("string")
    current = pairs.join(live, ["source_name", "snapshot_label"]).select(key.alias("page_key"), F.col("sha").alias("sha256"), key.alias("url"))
    earlier = pairs.join(live.withColumnRenamed("snapshot_label", "previous_label"), ["source_name", "previous_label"])
    previous = earlier.select(key.alias("page_key"), F.col("sha").alias("sha256"), empty.alias("url"), empty.alias("final_url"), F.xxhash64("page_key").alias("idx"))
    return diff.diff_pages(current, previous)


@query(_DIFF_SQL + " SELECT * FROM d")
def diff_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _diffed(spark, folder)


@query(_DIFF_SQL + """ SELECT count(*) FILTER (change_status = 'new') AS new_pages, count(*) FILTER (change_status = 'changed') AS changed_pages, count(*) FILTER (change_status = 'unchanged') AS unchanged_pages,
  count(*) FILTER (change_status = 'removed') AS removed_pages, count(*) FILTER (change_status IN ('new', 'changed')) AS import_candidates FROM d""")
def diff_summary(spark: SparkSession, folder: str) -> DataFrame:
    return diff.summarize(_diffed(spark, folder))


_PLAN_SQL = f"""WITH src AS (SELECT * FROM pages WHERE page_path IS NOT NULL AND coalesce(change_status IN ('new', 'changed', 'unknown'), true)),
{_IDX_SQL.replace('FROM pages)', 'FROM pages), ii AS (SELECT * FROM i WHERE page_path IS NOT NULL AND coalesce(change_status IN (' + chr(39) + 'new' + chr(39) + ', ' + chr(39) + 'changed' + chr(39) + ', ' + chr(39) + 'unknown' + chr(39) + '), true))').replace('FROM i),' + chr(10) + 'o AS', 'FROM ii),' + chr(10) + 'o AS')},
z AS (SELECT source_name, snapshot_label, page_key, idx, CASE WHEN idx <> canonical_idx THEN 'skipped_duplicate'
  WHEN coalesce(quality.rating = 'low' AND (quality.word_count < 40 OR quality.score < 30), false) THEN 'skipped_low_signal' ELSE 'planned' END AS item_status FROM o)"""


def _planned(spark: SparkSession, folder: str) -> DataFrame:
    low = quality.is_low_signal(F.col("quality.rating"), F.col("quality.word_count"), F.col("quality.score"))
    pages = _snapshot_pages(spark, folder).withColumn("low_signal", low).where(import_plan.eligible(False, F.lit(True)))
    marked = import_plan.mark_duplicates(pages, "idx", "source_name", "snapshot_label")
    return import_plan.with_status(marked)


@query(_PLAN_SQL + " SELECT source_name, snapshot_label, page_key, idx, item_status FROM z")
def import_items(spark: SparkSession, folder: str) -> DataFrame:
    return _planned(spark, folder).select("source_name", "snapshot_label", "page_key", F.col("idx").cast("bigint").alias("idx"), "item_status")


@query(_PLAN_SQL + """ SELECT source_name, snapshot_label, count(*) FILTER (item_status = 'planned') AS selected_pages, count(*) FILTER (item_status = 'skipped_duplicate') AS skipped_duplicates,
  count(*) FILTER (item_status = 'skipped_low_signal') AS skipped_low_signal FROM z GROUP BY ALL""")
def import_counters(spark: SparkSession, folder: str) -> DataFrame:
    count = lambda s: F.count_if(F.col("item_status") == s)
    return _planned(spark, folder).groupBy("source_name", "snapshot_label").agg(
        count("planned").alias("selected_pages"), count("skipped_duplicate").alias("skipped_duplicates"), count("skipped_low_signal").alias("skipped_low_signal")
    )


@query("SELECT source_name, fetch_method, count(*) AS pages FROM pages GROUP BY ALL")
def method_counts(spark: SparkSession, folder: str) -> DataFrame:
    return summary.method_counts(table(spark, folder, "pages"), "source_name")


@query("""SELECT source_name, snapshot_label, count(*) AS attempted, count(page_path) AS stored_pages, count(*) FILTER (starts_with(status, 'skipped')) AS skipped_pages,
  count(*) FILTER (status = 'reused_not_modified') AS reused_pages, CAST(coalesce(sum(byte_size), 0) AS BIGINT) AS bytes FROM pages WHERE status IS DISTINCT FROM 'removed' GROUP BY ALL""")
def fetch_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summary.fetch_summary(table(spark, folder, "pages"), "source_name", "snapshot_label")


@query("SELECT source_name, max(snapshot_label) AS snapshot_label FROM snapshots GROUP BY 1")
def latest_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return summary.latest_snapshots(table(spark, folder, "snapshots"))


@query("""SELECT a.source_name, a.snapshot_label, max(b.snapshot_label) AS previous_label FROM (SELECT DISTINCT source_name, snapshot_label FROM snapshots) a
  LEFT JOIN (SELECT DISTINCT source_name, snapshot_label FROM snapshots) b ON a.source_name = b.source_name AND a.snapshot_label <> b.snapshot_label GROUP BY ALL""")
def previous_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return summary.previous_snapshot(table(spark, folder, "snapshots"))


@query("""WITH l AS (SELECT source_name, max(snapshot_label) AS snapshot_label FROM snapshots GROUP BY 1),
  c AS (SELECT source_name, count(*) AS page_count, count(*) FILTER (change_status IN ('new', 'changed')) AS changed_pages, count(*) FILTER (change_status = 'removed') AS removed_pages,
    count(*) FILTER (quality.rating = 'low') AS low_quality_pages FROM pages JOIN l USING (source_name, snapshot_label) GROUP BY 1)
  SELECT source_name, snapshot_label, coalesce(page_count, 0) AS page_count, coalesce(changed_pages, 0) AS changed_pages, coalesce(removed_pages, 0) AS removed_pages,
    coalesce(low_quality_pages, 0) AS low_quality_pages, CAST(0 AS BIGINT) AS chunk_count FROM l LEFT JOIN c USING (source_name)""")
def site_overview(spark: SparkSession, folder: str) -> DataFrame:
    return summary.site_overview(table(spark, folder, "pages"), table(spark, folder, "snapshots"))


@query("""WITH c AS (SELECT source_name, snapshot_label, count(*) AS d, count(page_path) AS st, count(*) FILTER (change_status IN ('new', 'changed')) AS ch, count(*) FILTER (change_status = 'unchanged') AS un,
    count(*) FILTER (change_status = 'removed') AS re, count(*) FILTER (quality.rating = 'high') AS hi, count(*) FILTER (quality.rating = 'medium') AS me, count(*) FILTER (quality.rating = 'low') AS lo FROM pages GROUP BY ALL),
  s AS (SELECT DISTINCT source_name, snapshot_label, status, entry_url FROM snapshots)
  SELECT source_name, snapshot_label, printf('snapshot\nsource: %s\nsnapshot: %s\nstatus: %s\npages: discovered=%d stored=%d changed=%d unchanged=%d removed=%d\nquality: high=%d medium=%d low=%d\nentry: %s',
    source_name, snapshot_label, status, d, st, ch, un, re, hi, me, lo, entry_url) AS message FROM s JOIN c USING (source_name, snapshot_label)""".replace("\\n", "' || chr(10) || '"))
def snapshot_messages(spark: SparkSession, folder: str) -> DataFrame:
    status, rating = F.col("change_status"), F.col("quality.rating")
    counts = table(spark, folder, "pages").groupBy("source_name", "snapshot_label").agg(
        F.count(F.lit(1)).alias("discovered_pages"), F.count("page_path").alias("stored_pages"), F.count_if(status.isin("new", "changed")).alias("changed_pages"),
        F.count_if(status == "unchanged").alias("unchanged_pages"), F.count_if(status == "removed").alias("removed_pages"), F.count_if(rating == "high").alias("high_quality_pages"),
        F.count_if(rating == "medium").alias("medium_quality_pages"), F.count_if(rating == "low").alias("low_quality_pages"),
    )
    heads = table(spark, folder, "snapshots").select("source_name", "snapshot_label", "status", "entry_url").distinct()
    return summary.snapshot_message(heads.join(counts, ["source_name", "snapshot_label"]))


def _index_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each page's own address and text, taken as an index document."""
    bodies = table(spark, folder, "page_bodies").where("page_key LIKE 'https://%'")
    return bodies.select(F.col("page_key").alias("url"), F.col("markdown").alias("body"))


@query(rf"""WITH d AS (SELECT page_key AS base, {lines_sql('markdown')} AS ls FROM page_bodies WHERE page_key LIKE 'https://%' AND markdown IS NOT NULL),
  x AS (SELECT base, unnest(ls) AS line FROM d),
  a AS (SELECT base, {trim_sql(f"unnest(regexp_extract_all(line, '{frontier.LINK}', 1))")} AS link FROM x),
  b AS (SELECT base, trim(unnest(regexp_split_to_array(line, '[ \t\r\f\v]+')), '"''`()[]<>{{}},') AS link FROM x),
  u AS (SELECT base, CASE WHEN regexp_matches(link, '^https?://') THEN link WHEN link LIKE '/%' AND link NOT LIKE '//%' THEN regexp_extract(base, '{urls.ORIGIN}', 1) || link END AS url
    FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE regexp_matches(link, '^https?://')) WHERE link <> ''),
  v AS (SELECT base, regexp_replace(url, '#.*$', '') AS url FROM u WHERE url IS NOT NULL AND lower({HOST}) = lower(regexp_extract(base, '{urls.HOST}', 1)) AND {HOST} <> '')
  SELECT DISTINCT CASE WHEN {PATH} = '' THEN {ORIGIN} || '/' || substr(url, length({ORIGIN}) + 1) ELSE url END AS url, base AS index_url FROM v""")
def index_links(spark: SparkSession, folder: str) -> DataFrame:
    return frontier.index_links(_index_documents(spark, folder))


@query("""WITH s AS (SELECT DISTINCT url, source_name FROM pages WHERE url LIKE 'https://%' AND status = 'stored'), m AS (SELECT DISTINCT url, source_name FROM pages WHERE url LIKE 'https://%' AND fetch_method = 'markdown_negotiation'),
  a AS (SELECT url, 3 AS r FROM s UNION ALL SELECT url, 1 FROM m UNION ALL SELECT entry_url, 0 FROM sources WHERE entry_url IS NOT NULL)
  SELECT url, ['seed_page', 'llms_txt', 'llms_full_txt', 'sitemap'][min(r) + 1] AS discovered_from FROM a GROUP BY 1""")
def frontier_merged(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").where("url LIKE 'https://%'")
    parts = {
        "sitemap": pages.where("status = 'stored'").select("url").distinct(),
        "llms_txt": pages.where("fetch_method = 'markdown_negotiation'").select("url").distinct(),
        "seed_page": table(spark, folder, "sources").select(F.col("entry_url").alias("url")),
    }
    return frontier.merge(parts)


@query("""SELECT array_to_string(list_sort(list(DISTINCT discovered_from)), ',') AS adapters, count(*) AS frontier_count FROM (""" + SQL["frontier_merged"] + ")")
def frontier_adapters(spark: SparkSession, folder: str) -> DataFrame:
    return frontier.adapters(frontier_merged(spark, folder)).withColumn("adapters", F.array_join("adapters", ","))


@query("""SELECT entry_url || 'robots.txt' AS robots_url, CAST(unnest([1, 2]) AS INT) AS position, unnest([entry_url || 'sitemap.xml', entry_url || 'more/sitemap.xml']) AS sitemap FROM sources WHERE entry_url IS NOT NULL""")
def robots_sitemaps(spark: SparkSession, folder: str) -> DataFrame:
    entry = F.col("entry_url")
    body = F.concat(F.lit("User-agent: *\nSitemap: "), entry, F.lit("sitemap.xml\r\n sitemap:"), entry, F.lit("more/sitemap.xml \nDisallow: /x"))
    return frontier.robots_sitemaps(table(spark, folder, "sources").where("entry_url IS NOT NULL").select(F.concat(entry, F.lit("robots.txt")).alias("url"), body.alias("body")))


@query("SELECT DISTINCT source_name AS sitemap_url, 'page' AS kind, regexp_replace(url, '#.*$', '') AS url FROM pages WHERE url LIKE 'https://%'")
def sitemap_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A sitemap document per bucket of a source's pages, read back."""
    pages = table(spark, folder, "pages").where("url LIKE 'https://%'").select("source_name", "url").distinct()
    entry = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    files = pages.groupBy("source_name", F.pmod(F.xxhash64("url"), F.lit(64)).alias("part")).agg(F.array_join(F.collect_list(entry), "").alias("e"))
    body = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.col("e"), F.lit("</urlset>"))
    return frontier.sitemap_entries(files.select(F.col("source_name").alias("url"), body.alias("body")))


@query("""SELECT doc_id, '# ' || lang || ' ' || doc_id || chr(10) || chr(10) || 'Kept [link](/p/' || doc_id || ') & more' || chr(10) || chr(10) || '- one' || chr(10) || '- two' || chr(10) AS markdown FROM documents WHERE lang IS NOT NULL""")
def html_to_markdown(spark: SparkSession, folder: str) -> DataFrame:
    page = F.concat(
        F.lit("<html><head><title>x</title></head><body><nav>menu</nav><script>var a = '</p>';</script><h1>"), "lang", F.lit(" "), F.col("doc_id").cast("string"), F.lit('</h1><p>Kept <a class="l" href="/p/'),
        F.col("doc_id").cast("string"), F.lit('">link</a> &amp; more</p><ul><li>one<li>two</ul><footer>end</footer></body></html>'),
    )
    return table(spark, folder, "documents").where("lang IS NOT NULL").select("doc_id", html.html_to_markdown(page).alias("markdown"))


def _html_sql(page: str) -> str:
    """The converter's replacements, one inside the other, around an expression of a page."""
    gone = "|".join(f"<{t}\\b[^>]*>.*?</{t}\\s*>" for t in ("script", "style", "head", "nav", "footer"))
    steps = [("(?s)<!--.*?-->", ""), (f"(?is){gone}", ""), *[(f"(?is)<h{n}\\b[^>]*>(.*?)</h{n}\\s*>", "\n\n" + "#" * n + " \\1\n\n") for n in range(1, 7)]]
    steps += [("(?is)<pre\\b[^>]*>(.*?)</pre\\s*>", "\n\n```\n\\1\n```\n\n"), ("(?i)<li\\b[^>]*>", "\n- "), ('(?is)<a\\b[^>]*\\bhref="([^"]*)"[^>]*>(.*?)</a\\s*>', "[\\2](\\1)")]
    steps += [("(?i)</?strong\\b[^>]*>", "**"), ("(?i)<br\\s*/?>", "\n"), ("(?i)</?p\\b[^>]*>", "\n\n"), ("(?s)<[a-zA-Z/!][^>]*>", "")]
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    for pattern, by in steps:
        page = f"regexp_replace({page}, {quoted(pattern)}, {quoted(by)}, 'g')"
    for name, sign in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")]:
        page = f"replace({page}, {quoted(name)}, {quoted(sign)})"
    page = f"regexp_replace({page}, '\n[ \\t]*\n(?:[ \\t]*\n)+', '\n\n', 'g')"
    return f"{trim_sql(page)} || chr(10)"


_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def _escaped(text: Column) -> Column:
    for sign, name in _ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def _escaped_sql(text: str) -> str:
    for sign, name in _ESCAPES:
        text = f"replace({text}, '{sign}', '{name}')"
    return text


_PAGE_AROUND = "<html><head><title>x</title></head><body><nav>menu</nav><p>", "</p><footer>end</footer></body></html>"


@query(f"SELECT doc_id, sha256({_html_sql("page")}) AS markdown FROM (SELECT doc_id, '{_PAGE_AROUND[0]}' || {_escaped_sql("coalesce(text, '')")} || '{_PAGE_AROUND[1]}' AS page FROM documents)")
def html_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The whole text of every document, escaped, in a page that is converted."""
    page = F.concat(F.lit(_PAGE_AROUND[0]), _escaped(F.coalesce("text", F.lit(""))), F.lit(_PAGE_AROUND[1]))
    return table(spark, folder, "documents").select("doc_id", F.sha2(html.html_to_markdown(page), 256).alias("markdown"))


# Markdown marks, once escaped, and the tags that a page has in their places.
_TAGS = [
    ("```[a-z]*\n([^`]*)```", "<pre class=\"c\">", "</pre>"), ("\n### ([^\n]*)", "\n<h3 id=\"x\">", "</h3>"), ("\n## ([^\n]*)", "\n<H2>", "</H2>"), ("\n# ([^\n]*)", "\n<h1>", "</h1>"), ("\n[-*] ([^\n]*)", "\n<li>", "</li>"),
    ("[*][*]([^*\n]*)[*][*]", "<strong>", "</strong>"), ("\n\n([^\n<][^\n]*)", "\n\n<p>", "</p><br/><!-- p -->"),
]


def _page_of_sql(markdown: str) -> str:
    page = f"regexp_replace(chr(10) || {_escaped_sql(markdown)}, '\\[([^\\]\n]*)\\]\\(([^)\n]*)\\)', '<a class=\"l\" href=\"\\2\">\\1</a>', 'g')"
    for pattern, before, behind in _TAGS:
        page = f"regexp_replace({page}, '{pattern}', '{before}\\1{behind}', 'g')"
    return f"'<html><head><style>p</style></head><body><nav><a href=\"/\">x</a></nav><script>var a = 1 < 2;</script>' || {page} || '<footer>&copy; end</footer></body></html>'"


@query(f"SELECT body_id, sha256({_html_sql("page")}) AS markdown FROM (SELECT body_id, {_page_of_sql("markdown")} AS page FROM page_bodies)")
def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every page body written with tags, and converted back."""
    page = F.regexp_replace(F.concat(F.lit("\n"), _escaped(F.col("markdown"))), "\\[([^\\]\n]*)\\]\\(([^)\n]*)\\)", '<a class="l" href="$2">$1</a>')
    for pattern, before, behind in _TAGS:
        page = F.regexp_replace(page, pattern, f"{before}$1{behind}")
    page = F.concat(F.lit('<html><head><style>p</style></head><body><nav><a href="/">x</a></nav><script>var a = 1 < 2;</script>'), page, F.lit("<footer>&copy; end</footer></body></html>"))
    return table(spark, folder, "page_bodies").select("body_id", F.sha2(html.html_to_markdown(page), 256).alias("markdown"))


_LINKS_SQL = SQL["index_links"].split("x AS (SELECT base", 1)[1]


@query(f"""WITH d AS (SELECT DISTINCT p.url AS base, {lines_sql('markdown')} AS ls FROM page_bodies b JOIN pages p USING (source_name, snapshot_label, page_key) WHERE p.url IS NOT NULL AND markdown IS NOT NULL),
  x AS (SELECT base{_LINKS_SQL}""")
def index_links_by_address(spark: SparkSession, folder: str) -> DataFrame:
    """As index_links, for the bodies of all pages: their addresses are those of ``pages``."""
    keys = ["source_name", "snapshot_label", "page_key"]
    addresses = table(spark, folder, "pages").where("url IS NOT NULL").select(*keys, "url").distinct()
    bodies = table(spark, folder, "page_bodies").join(addresses, keys).select("url", F.col("markdown").alias("body"))
    return frontier.index_links(bodies)


# Every kind of markup that the normalizer knows, with a page's source and text in its slots.
DRESS_BEFORE = """> ## Documentation Index
> llms.txt of {source}

# {source}
# {source}


import Tabs from "x";
export const a = 1;
{{/* note */}}
<!-- comment -->
<Tabs>
<Tab title="{source}">
    {text}
</Tab>
</Tabs>
<Card title="{source}" href="/x" desc="about">
    in a card
</Card>
<VPCard text="{source}" />
{{% hint style="warning" title="{source}" %}}
    hinted
{{% endhint %}}
{{% tabs %}}
{{% tab title="{source}" %}}
\ttabbed
{{% endtab %}}
{{% endtabs %}}
!!! own-kind
    body
??? danger "{source}"
    body
=== "Python"
    code
<details>
<summary>{source}</summary>
    more
</details>
<img src="x" />
Text with <Tooltip tip="t">inline</Tooltip> and <Badge text="b" /> behind
<Badge type="tip" text="x" />
<Callout type="info">
    called
</Callout>
<Note>
noted
</Note>
```js title="a"
x
```
<Unknown prop="1">
</Unknown>
"""


def _dressed(spark: SparkSession, folder: str) -> DataFrame:
    source = F.coalesce("source_name", F.lit(""))
    pieces = {"{source}": source, "{text}": F.replace("markdown", F.lit("\n"), F.lit("\n    "))}
    parts = re.split(r"(\{source\}|\{text\})", DRESS_BEFORE.replace("{{", "{").replace("}}", "}"))
    return table(spark, folder, "page_bodies").select("body_id", F.concat(*[pieces.get(p, F.lit(p)) for p in parts]).alias("markdown"))


_DRESSED_SQL = "SELECT body_id, " + " || ".join(
    {"{source}": "coalesce(source_name, '')", "{text}": "replace(markdown, chr(10), chr(10) || '    ')"}.get(p, "'" + p.replace("'", "''") + "'")
    for p in re.split(r"(\{source\}|\{text\})", DRESS_BEFORE.replace("{{", "{").replace("}}", "}"))
) + " AS markdown FROM page_bodies"


def _normalized(pages: DataFrame) -> DataFrame:
    rows = normalize.normalize_pages(pages, ["body_id"])
    return rows.withColumn("profiles_applied", F.array_join("profiles_applied", ",")).withColumn("markdown", F.sha2("markdown", 256))


@query(NORMALIZED_SQL)
def normalized_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _normalized(table(spark, folder, "page_bodies"))


@query(f"WITH dressed AS ({_DRESSED_SQL}), " + NORMALIZED_SQL.removeprefix("WITH ").replace("FROM page_bodies", "FROM dressed", 1))
def normalized_markup(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's text inside every kind of markup, normalized."""
    return _normalized(_dressed(spark, folder))


@query(f"""WITH {NORMAL_SQL}, made AS MATERIALIZED (SELECT body_id, NULL AS source_name, markdown FROM normal)
  SELECT * FROM ({_CHUNKS_SQL.replace("page_bodies", "made")} SELECT body_id, ordinal, {words_sql("markdown")} AS word_count, sha256(markdown) AS sha256, array_to_string(section_path, ' > ') AS section_path FROM c)
  JOIN ({_METRICS_SQL.replace("page_bodies", "made")} SELECT body_id, score, rating FROM r) USING (body_id)""")
def page_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Normalize, score and chunk every page: one row per chunk with its page's score."""
    pages = cut(normalize.normalize_pages(table(spark, folder, "page_bodies"), ["body_id"]).select("body_id", "markdown"))
    scored = quality.score_pages(pages).select("body_id", "score", "rating")
    parts = chunk.chunk_pages(pages, ["body_id"]).select("body_id", "ordinal", "word_count", "sha256", F.array_join("section_path", " > ").alias("section_path"))
    return parts.join(scored, "body_id")


@query("""SELECT DISTINCT 'https://' || source_name || '.test/' || substr(md5(url), 1, 2) || '/sitemap.xml' AS root, regexp_replace(url, '#.*$', '') AS url
  FROM pages WHERE url LIKE 'https://%' AND source_name IS NOT NULL""")
def sitemap_walk(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of each source in sitemaps three levels deep, reached again from their roots."""
    pages = table(spark, folder, "pages").where("url LIKE 'https://%' AND source_name IS NOT NULL").select("source_name", "url").distinct()
    hashed = pages.withColumn("h", F.md5("url"))
    base = F.concat(F.lit("https://"), "source_name", F.lit(".test/"), F.substring("h", 1, 2), F.lit("/"))
    name = lambda n: F.concat(base, F.substring("h", 3, n), F.lit("-sitemap.xml"))
    # the last digit of a hash has 16 values: a quarter of them share a sitemap of sitemaps
    quarter = F.concat(base, F.floor(F.conv(F.substring("h", 3, 1), 16, 10).cast("int") / 4).cast("string"), F.lit("-index.xml"))
    root = F.concat(base, F.lit("sitemap.xml"))
    link = lambda kind, loc: F.concat(F.lit(f"<{kind}><loc>"), F.replace(loc, F.lit("&"), F.lit("&amp;")), F.lit(f"</loc></{kind}>"))

    def level(document: Column, kind: str, loc: Column) -> DataFrame:
        links = hashed.select(document.alias("url"), link(kind, loc).alias("link")).distinct().groupBy("url").agg(F.array_join(F.collect_list("link"), "").alias("links"))
        tag = "urlset" if kind == "url" else "sitemapindex"
        return links.select("url", F.concat(F.lit(f"<{tag}>"), "links", F.lit(f"</{tag}>")).alias("body"))

    documents = level(root, "sitemap", quarter).unionByName(level(quarter, "sitemap", name(1))).unionByName(level(name(1), "url", F.col("url")))
    return frontier.walk_sitemaps(documents, hashed.select(root.alias("root")).distinct())


_PROBED_SQL = f"""probed AS (SELECT DISTINCT p.source_name, p.snapshot_label, p.page_key, p.url, p.content_type, p.fetch_method, b.markdown,
    CASE WHEN contains(b.markdown, '](') THEN b.markdown END AS llms, CASE WHEN p.fetch_method = 'markdown_negotiation' THEN 'User-agent: *' || chr(10) || ' sitemap: ' || p.url || 'a.xml' || chr(10) || 'Sitemap:b' END AS robots
  FROM pages p JOIN page_bodies b USING (source_name, snapshot_label, page_key) WHERE p.url IS NOT NULL)"""


@query(f"""WITH {_PROBED_SQL}, k AS (SELECT *, {_KIND_SQL} AS kind, coalesce(content_type LIKE 'text/markdown%', false) AS md, llms IS NOT NULL AS has, CASE WHEN robots IS NULL THEN 0 ELSE 2 END AS maps,
    list_filter(string_split(llms, chr(10)), lambda x: trim(x, ' ') <> '') AS bare FROM probed)
  SELECT url, sha256(coalesce(llms, '')) AS llms, kind AS detected_input_kind, md AS markdown_supported, has AS llms_available, coalesce(len(list_filter(string_split(llms, chr(10)), lambda x: contains(x, '](') OR contains(x, 'https://'))), 0) AS llms_links,
    CASE WHEN llms IS NOT NULL THEN sha256(array_to_string(bare[1:8], chr(10))) END AS llms_preview, maps AS sitemaps,
    CASE WHEN kind IN ('llms_txt', 'llms_full_txt', 'sitemap', 'robots_txt', 'site_root') THEN 'discovery_root' WHEN kind IN ('content_page', 'markdown_endpoint') THEN 'hybrid_seed' WHEN kind = 'unknown' THEN 'single_document' ELSE 'single_file' END AS suggested_mode,
    concat_ws(',', CASE WHEN kind IN ('llms_txt', 'llms_full_txt') THEN 'expand_index' WHEN kind IN ('sitemap', 'robots_txt') THEN 'discovery_seed'
      WHEN kind IN ('pdf_file', 'office_document', 'markdown_file', 'openapi_spec', 'json_file') THEN 'single_asset' WHEN kind IN ('content_page', 'markdown_endpoint') THEN 'page_seed' END,
      CASE WHEN md THEN 'negotiate_markdown' ELSE 'extract_html' END, CASE WHEN has THEN 'use_llms_index' END, CASE WHEN maps > 0 THEN 'seed_from_sitemaps' END, CASE WHEN NOT has AND maps = 0 THEN 'expect_partial_coverage' END) AS recommendations,
    kind = 'content_page' AND {HOST} <> '' AND regexp_matches(lower(regexp_replace({PATH}, '^/+|/+$', '', 'g')), '{urls.DOCS_MARKERS}') AND (has OR maps > 0) AS promoted FROM k""")
def probe_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The report of a probe at each page's address, with its text as the index that was found there."""
    keys = ["source_name", "snapshot_label", "page_key"]
    pages = table(spark, folder, "pages").where("url IS NOT NULL").select(*keys, "url", "content_type", "fetch_method")
    rows = pages.join(table(spark, folder, "page_bodies").select(*keys, "markdown"), keys).distinct()
    robots = F.when(F.col("fetch_method") == "markdown_negotiation", F.concat(F.lit("User-agent: *\n sitemap: "), "url", F.lit("a.xml\nSitemap:b")))
    seen = rows.select("url", F.col("url").alias("final_url"), "content_type", F.lit(False).alias("requested_root"), F.when(F.contains("markdown", F.lit("](")), F.col("markdown")).alias("llms_body"), robots.alias("robots_body"))
    report = pipeline.probe(seen, "llms_body")
    return report.select(
        "url", F.sha2(F.coalesce("llms_body", F.lit("")), 256).alias("llms"), "detected_input_kind", "markdown_supported", "llms_available", "llms_links", F.sha2(F.array_join("llms_preview", "\n"), 256).alias("llms_preview"), "sitemaps",
        "suggested_mode", F.array_join("recommendations", ",").alias("recommendations"), "promoted",
    )


_PAIRS_SQL = """pairs AS (SELECT DISTINCT source_name, snapshot_label, previous_snapshot_label AS previous_label FROM snapshots
    WHERE status = 'fetched' AND previous_snapshot_label IS NOT NULL AND source_name IS NOT NULL AND snapshot_label IS NOT NULL)"""
_PREVIOUS_SQL = f"""WITH {_PAIRS_SQL}, {_IDX_SQL.split('k AS (')[0].rstrip().rstrip(',')},
  old AS (SELECT p.source_name, p.snapshot_label, p.previous_label, i.page_key, i.url, i.final_url, i.sha256, i.quality.score AS score, i.quality.rating AS rating, i.page_path, i.idx FROM pairs p JOIN i ON i.source_name = p.source_name AND i.snapshot_label = p.previous_label),
  ways AS (SELECT *, unnest([page_key, url, final_url]) AS lookup, unnest([0, 1, 2]) AS way FROM old),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_name, snapshot_label, lookup ORDER BY idx DESC, way DESC) AS r FROM ways WHERE lookup <> '') WHERE r = 1),
  cur AS (SELECT p.previous_label, i.* FROM pairs p JOIN i USING (source_name, snapshot_label))"""


def _compared(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All rows of every fetched snapshot, and those of the snapshot before it under the same label."""
    rows = cut(_snapshot_pages(spark, folder))
    pairs = snapshot_merkle.snapshot_pairs(table(spark, folder, "snapshots"))
    current = rows.join(pairs, ["source_name", "snapshot_label"])
    previous = rows.withColumnRenamed("snapshot_label", "previous_label").join(pairs, ["source_name", "previous_label"])
    return current, previous


@query(_PREVIOUS_SQL + """ SELECT c.source_name, c.snapshot_label, c.idx, c.page_key, c.url, b.page_key AS previous_key, b.sha256 AS previous_sha256, b.score AS previous_score, b.previous_label AS reused_from_snapshot
  FROM cur c JOIN best b ON b.source_name = c.source_name AND b.snapshot_label = c.snapshot_label AND b.lookup = c.url WHERE c.status = 'reused_not_modified'""")
def reused_pages(spark: SparkSession, folder: str) -> DataFrame:
    """What each page that was answered as not modified takes over from the snapshot before."""
    current, previous = _compared(spark, folder)
    by = ("source_name", "snapshot_label")
    held = diff.reuse(current.where("status = 'reused_not_modified'").drop("previous_label"), previous.withColumn("label", F.col("previous_label")), by=by)
    kept = held.where("previous IS NOT NULL").join(snapshot_merkle.snapshot_pairs(table(spark, folder, "snapshots")), list(by))
    return kept.select(
        *by, F.col("idx").cast("bigint").alias("idx"), "page_key", "url", F.col("previous.page_key").alias("previous_key"), F.col("previous.sha256").alias("previous_sha256"),
        F.col("previous.quality.score").alias("previous_score"), F.col("previous_label").alias("reused_from_snapshot"),
    )


def _address_sql(git: bool) -> str:
    fresh = "b.lookup IS NULL" if git else "b.lookup IS NULL OR b.sha256 IS NULL"
    lookup = "page_key" if git else "url"
    return _PREVIOUS_SQL + f""" SELECT c.source_name, c.snapshot_label, c.page_key, c.sha256, b.sha256 AS previous_hash, CASE WHEN c.sha256 IS NULL THEN 'unknown' WHEN {fresh} THEN 'new'
      WHEN b.sha256 = c.sha256 THEN 'unchanged' ELSE 'changed' END AS change_status FROM cur c LEFT JOIN best b ON b.source_name = c.source_name AND b.snapshot_label = c.snapshot_label AND b.lookup = c.{lookup}
    UNION ALL SELECT source_name, snapshot_label, page_key, NULL, sha256, 'removed' FROM (SELECT *, row_number() OVER (PARTITION BY source_name, snapshot_label, page_key ORDER BY idx DESC) AS r
      FROM old ANTI JOIN (SELECT DISTINCT source_name, snapshot_label, page_key FROM cur) USING (source_name, snapshot_label, page_key)) WHERE r = 1"""


@query(_address_sql(False))
def diff_by_address(spark: SparkSession, folder: str) -> DataFrame:
    """Every delivered row against the snapshot before, found by its URL among the earlier keys, URLs and final URLs."""
    current, previous = _compared(spark, folder)
    return diff.diff_pages(current, previous, by=("source_name", "snapshot_label"))


@query(_address_sql(True))
def diff_by_path(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a repository is compared: by page key, and an earlier page without a hash is changed."""
    current, previous = _compared(spark, folder)
    return diff.diff_pages(current, previous, "page_key", True, ("source_name", "snapshot_label"))


@query("""SELECT body_id, coalesce(((len(regexp_extract_all(lower(markdown), '<script')) >= 5 OR """ + " OR ".join(f"contains(lower(markdown), '{m}')" for m in classify.DYNAMIC_MARKERS) + f""")
  AND strlen({trim_sql("markdown")}) < 400), false) AS needs_rendering FROM page_bodies""")
def pages_to_render(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "page_bodies")
    return rows.select("body_id", F.coalesce(classify.needs_rendering(F.col("markdown"), F.col("markdown")), F.lit(False)).alias("needs_rendering"))


@query("""SELECT url, '/' || substr(md5(url), 1, 3) || '/llms.txt' AS target FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)""")
def index_link_headers(spark: SparkSession, folder: str) -> DataFrame:
    """The index that the Link header of each address names."""
    header = F.concat(F.lit('</a>; rel="next", </'), F.substring(F.md5("url"), 1, 3), F.lit('/llms.txt>; rel="llms-txt", </z>; rel="llms-txt"'))
    return _urls(spark, folder).select("url", urls.link_with_rel(header, "llms-txt").alias("target"))
