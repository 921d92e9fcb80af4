"""Queries of the operators for training text, with their SQL where whole tables can be done in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagestrata.llm import boilerplate, encoding, harm, leaks, page_quality, repeated_lines, splitting
from pagestrata.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.boilerplate_lines(table(spark, folder, "page_bodies"))


def _hashes(pages: DataFrame) -> DataFrame:
    return pages.select("body_id", F.sha2("markdown", 256).alias("markdown"))


def p1_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The hash of each page's main body."""
    return _hashes(boilerplate.main_bodies(table(spark, folder, "page_bodies")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return page_quality.pages_without_prose(table(spark, folder, "page_bodies"))


def p2_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return page_quality.page_statistics(table(spark, folder, "page_bodies"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_pieces(spark, folder).select("draft_id").distinct()


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_drafts(table(spark, folder, "chunk_drafts"), table(spark, folder, "chunk_configs"))


def p4_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces of each draft make together: its words in order, with pieces over the limit and gaps counted."""
    drafts, configs = table(spark, folder, "chunk_drafts"), table(spark, folder, "chunk_configs")
    limits = splitting.with_limits(drafts, configs).select("draft_id", "target_words").distinct()
    pieces = splitting.split_drafts(drafts, configs).drop("section_path").distinct().join(limits, "draft_id")
    words = F.regexp_extract_all("markdown", F.lit(f"[^{splitting.WHITE_SPACE}]+"), F.lit(0))
    new = F.slice(words, F.col("overlap").cast("int") + 1, F.size(words))
    behind = Window.partitionBy("draft_id").orderBy("piece_no")
    end = F.coalesce(F.lag(F.col("first_word") + F.col("words")).over(behind), F.lit(0))
    told = pieces.select("draft_id", "piece_no", new.alias("new"), (F.col("words") > F.col("target_words")).alias("over"), (F.col("first_word") + F.col("overlap") != end).alias("gap"), (F.size(words) != F.col("words")).alias("wrong"))
    parts = F.array_sort(F.collect_list(F.struct("piece_no", "new")))
    whole = F.flatten(F.transform(parts, lambda p: p["new"]))
    return told.groupBy("draft_id").agg(
        F.size(whole).cast("bigint").alias("words"), F.sha2(F.array_join(whole, " "), 256).alias("sha256"), F.count_if("over").alias("too_long"), F.count_if("gap").alias("gaps"), F.count_if("wrong").alias("miscounted")
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, folder, "page_bodies"))


def p5_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The hash of each page without its repeated lines."""
    pages = table(spark, folder, "page_bodies")
    return _hashes(repeated_lines.without_lines(pages, repeated_lines.repeated_lines(pages)))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encode_texts(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_documents(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_passages(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The hash of each document that holds no test item."""
    kept = leaks.without_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return kept.select("doc_id", F.sha2("text", 256).alias("text"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return harm.harmful_documents(table(spark, folder, "documents"))


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    return harm.score_documents(table(spark, folder, "documents"))


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    return harm.rates_by_source(table(spark, folder, "documents"))


WS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

P4_LARGE = f"""
WITH l AS (
  SELECT config_id, max(target_words) AS target_words, bool_or(is_default) AS is_default
  FROM chunk_configs WHERE config_id IS NOT NULL AND target_words IS NOT NULL GROUP BY 1),
large AS (
  SELECT draft_id, regexp_extract_all(markdown, '[^{WS}]+') AS words FROM chunk_drafts d
  JOIN l ON l.config_id = coalesce(d.config_id, (SELECT min(config_id) FROM l WHERE is_default))
  WHERE len(regexp_extract_all(markdown, '[^{WS}]+')) > target_words)
"""
P4_SQL = P4_LARGE + "SELECT DISTINCT draft_id FROM large"
P4_COVERAGE_SQL = P4_LARGE + """
SELECT DISTINCT draft_id, len(words) AS words, sha256(array_to_string(words, ' ')) AS sha256,
  CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS miscounted FROM large
"""

P5_SQL = r"""
WITH p AS (
  SELECT body_id, source_name, page_key, string_split(markdown, chr(10)) AS ls FROM page_bodies
  WHERE body_id IS NOT NULL AND source_name IS NOT NULL AND page_key IS NOT NULL AND markdown IS NOT NULL),
lines AS (
  SELECT body_id, source_name, page_key, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM p),
keyed AS (
  SELECT body_id, source_name, page_key, line_no,
    trim(regexp_replace(lower(regexp_replace(regexp_replace(line, '\]\([^)]*\)', ']', 'g'), 'https?://[^\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*', ' ', 'g')), '[^\p{L}]+', ' ', 'g')) AS words
  FROM lines),
kept AS (SELECT * FROM keyed WHERE len(words) - len(replace(words, ' ', '')) >= 2),
least AS (
  SELECT source_name, greatest(4, (count(DISTINCT page_key) * 15 + 99) // 100) AS least FROM page_bodies
  WHERE body_id IS NOT NULL GROUP BY 1),
hits AS (
  SELECT source_name, words FROM kept JOIN least USING (source_name)
  GROUP BY 1, 2, least HAVING count(DISTINCT page_key) >= least)
SELECT DISTINCT body_id, CAST(line_no AS BIGINT) AS line_no FROM kept SEMI JOIN hits USING (source_name, words)
"""

P5_BODIES_SQL = f"""
WITH f AS ({P5_SQL}), drops AS (SELECT body_id, list(line_no) AS lines FROM f GROUP BY 1)
SELECT body_id, sha256(array_to_string(list_filter(string_split(markdown, chr(10)), lambda x, i: NOT coalesce(list_contains(lines, i - 1), false)), chr(10))) AS markdown
FROM page_bodies LEFT JOIN drops USING (body_id)
"""

P8_SQL = r"""
WITH dw AS (
  SELECT DISTINCT doc_id, regexp_extract_all(lower(replace(replace(text, chr(173), ''), chr(8203), '')), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower(replace(replace(prompt, chr(173), ''), chr(8203), '')), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE prompt IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM dw WHERE len(w) >= 12),
ig AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM iw WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""

P8_PASSAGES_SQL = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(lower(replace(replace(text, chr(173), ''), chr(8203), '')), '[\p{L}\p{N}]+') AS w
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)),
iw AS (
  SELECT item_id, row_number() OVER () AS i, regexp_extract_all(lower(replace(replace(prompt, chr(173), ''), chr(8203), '')), '[\p{L}\p{N}]+') AS w
  FROM (SELECT DISTINCT item_id, prompt FROM eval_items WHERE prompt IS NOT NULL AND item_id IS NOT NULL)),
dg AS (
  SELECT doc_id, d, unnest(range(len(w) - 11)) AS dp, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g
  FROM dw WHERE len(w) >= 12),
ig AS (
  SELECT item_id, i, unnest(range(len(w) - 11)) AS ip, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g
  FROM iw WHERE len(w) >= 12),
runs AS (
  SELECT doc_id, item_id, d, i, dp, ip, dp - row_number() OVER (PARTITION BY d, i, dp - ip ORDER BY dp) AS run FROM dg JOIN ig USING (g))
SELECT DISTINCT doc_id, item_id, doc_word, item_word, words FROM (
  SELECT doc_id, item_id, min(dp) AS doc_word, min(ip) AS item_word, count(*) + 11 AS words FROM runs GROUP BY doc_id, item_id, d, i, dp - ip, run)
"""

P8_KEPT_SQL = f"SELECT doc_id, sha256(text) AS text FROM documents ANTI JOIN ({P8_SQL}) USING (doc_id)"

QUERIES = {
    "p1_found": p1_found,
    "p1_bodies": p1_bodies,
    "p2_found": p2_found,
    "p2_statistics": p2_statistics,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_coverage": p4_coverage,
    "p5_found": p5_found,
    "p5_bodies": p5_bodies,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_passages": p8_passages,
    "p8_kept": p8_kept,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_rates": p9_rates,
}
SQL = {
    "p4_found": P4_SQL,
    "p4_coverage": P4_COVERAGE_SQL,
    "p5_found": P5_SQL,
    "p5_bodies": P5_BODIES_SQL,
    "p8_found": P8_SQL,
    "p8_passages": P8_PASSAGES_SQL,
    "p8_kept": P8_KEPT_SQL,
}
