"""Queries of the core operators over snapshots and manifests, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.operators import schema_drift, snapshot_merkle
from pagestrata.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_merkle.snapshot_changes(table(spark, folder, "pages"), table(spark, folder, "snapshots"))


def p3_change_counts(spark: SparkSession, folder: str) -> DataFrame:
    return p3_found(spark, folder).groupBy("source_name", "snapshot_label", "change").agg(F.count(F.lit(1)).alias("pages"))


def _read(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.read_files(table(spark, folder, "manifest_files"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.schema_changes(table(spark, folder, "manifest_files"))


def p6_path_types(spark: SparkSession, folder: str) -> DataFrame:
    times = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_written", "last_written")}
    return schema_drift.path_type_statistics(_read(spark, folder)).withColumns(times)


def p6_file_types(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.file_type_statistics(_read(spark, folder))


def p6_table(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.consistent_table(_read(spark, folder))


def p6_casts(spark: SparkSession, folder: str) -> DataFrame:
    """Of each path of the one consistent table: its type, its values, those that it can't hold, and the sum of its numbers."""
    rows = schema_drift.consistent_table(_read(spark, folder))
    return rows.groupBy("file_kind", "path", "column_type").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("cast_failed").alias("failed"), F.sum("as_integer").alias("integers"), F.count("as_decimal").alias("decimals"), F.count_if("as_boolean").alias("trues")
    )


P3_SQL = """
WITH pairs AS (
  SELECT DISTINCT source_name, snapshot_label, previous_snapshot_label AS previous_label FROM snapshots
  WHERE status = 'fetched' AND previous_snapshot_label IS NOT NULL),
ranked AS (
  SELECT source_name, snapshot_label, page_key, status,
    lower(trim(sha256, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160))) AS sha,
    row_number() OVER (PARTITION BY source_name, snapshot_label, page_key
      ORDER BY fetched_at DESC NULLS LAST, status DESC NULLS LAST,
        lower(trim(sha256, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160))) DESC NULLS LAST) AS r
  FROM pages),
live AS (SELECT * FROM ranked WHERE r = 1 AND status IS DISTINCT FROM 'removed'),
now AS (SELECT p.*, l.page_key, l.sha FROM pairs p JOIN live l USING (source_name, snapshot_label)),
before AS (
  SELECT p.*, l.page_key, l.sha FROM pairs p
  JOIN live l ON l.source_name = p.source_name AND l.snapshot_label = p.previous_label),
merged AS (
  SELECT coalesce(n.source_name, b.source_name) AS source_name,
    coalesce(n.snapshot_label, b.snapshot_label) AS snapshot_label,
    coalesce(n.page_key, b.page_key) AS page_key,
    CASE WHEN b.page_key IS NULL THEN 'added' WHEN n.page_key IS NULL THEN 'removed'
      WHEN n.sha <> b.sha THEN 'changed' END AS change
  FROM now n FULL JOIN before b ON n.source_name = b.source_name AND n.snapshot_label = b.snapshot_label
    AND n.previous_label = b.previous_label AND n.page_key = b.page_key)
SELECT DISTINCT source_name, snapshot_label, page_key, change FROM merged WHERE change IS NOT NULL
"""

_FILES_SQL = """
one AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY arrived_at DESC NULLS LAST, written_at DESC NULLS LAST, install_id DESC NULLS LAST,
      file_kind DESC NULLS LAST, source_name DESC NULLS LAST, body DESC NULLS LAST) AS r FROM manifest_files WHERE file_id IS NOT NULL) WHERE r = 1),
readable AS (SELECT * FROM one WHERE json_valid(body)),
tree AS (SELECT f.file_id, f.file_kind, j.id, j.parent, j.key, j.value, j.type FROM readable f, json_tree(CAST(f.body AS JSON)) j),
entries AS (
  SELECT t.file_id, t.file_kind, t.id, t.key AS path, '' AS above, t.type, t.value FROM tree t JOIN tree r ON r.file_id = t.file_id AND r.id = t.parent AND r.parent IS NULL AND r.type = 'OBJECT'
  UNION ALL
  SELECT t.file_id, t.file_kind, t.id, e.path || '.' || t.key, e.path, t.type, t.value FROM entries e JOIN tree t ON t.file_id = e.file_id AND t.parent = e.id
  WHERE e.type = 'OBJECT' AND NOT (coalesce(e.file_kind, '') = 'config' AND e.path = 'sources')),
typed AS (
  SELECT * REPLACE (CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object'
    WHEN 'DOUBLE' THEN CASE WHEN regexp_full_match(CAST(value AS VARCHAR), '-?[0-9]+') THEN 'integer' ELSE 'decimal' END ELSE 'integer' END AS type)
  FROM entries QUALIFY row_number() OVER (PARTITION BY file_id, path ORDER BY id DESC) = 1)
"""

P6_TYPES_SQL = f"""WITH RECURSIVE {_FILES_SQL}
SELECT t.file_kind, path, type AS raw_type, count(*) AS files, strftime(min(written_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS first_written,
  strftime(max(written_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last_written FROM typed t JOIN readable USING (file_id) GROUP BY ALL"""

P6_FILES_SQL = f"""WITH RECURSIVE {_FILES_SQL}
SELECT file_id, type AS raw_type, count(*) AS paths FROM typed GROUP BY ALL"""

P6_CASTS_SQL = f"""WITH RECURSIVE {_FILES_SQL},
counted AS (SELECT file_kind, path, type, count(*) AS files FROM typed GROUP BY ALL),
columns_ AS (SELECT file_kind, path, CASE WHEN t = 'null' THEN 'string' ELSE t END AS column_type FROM (
  SELECT file_kind, path, arg_max(type, (type <> 'null', files, type)) AS t FROM counted GROUP BY 1, 2)),
held AS (SELECT t.file_kind, t.path, column_type, t.type, CASE WHEN t.type = 'string' THEN json_extract_string(t.value, '$') WHEN t.type <> 'null' THEN CAST(t.value AS VARCHAR) END AS v
  FROM typed t JOIN columns_ c ON c.path = t.path AND c.file_kind IS NOT DISTINCT FROM t.file_kind),
cast_ AS (SELECT *, CASE WHEN column_type = 'integer' AND type IN ('integer', 'string') AND regexp_full_match(trim(v), '[+-]?[0-9]+') THEN TRY_CAST(trim(v) AS BIGINT) END AS i,
  CASE WHEN column_type = 'decimal' AND type IN ('decimal', 'string', 'integer') THEN TRY_CAST(v AS DOUBLE) END AS d,
  CASE WHEN column_type = 'boolean' AND type IN ('boolean', 'string') THEN CASE WHEN lower(trim(v)) IN ('true', 't', 'yes', 'y', '1') THEN true WHEN lower(trim(v)) IN ('false', 'f', 'no', 'n', '0') THEN false END END AS b FROM held)
SELECT file_kind, path, column_type, count(*) AS files, count(*) FILTER (v IS NOT NULL AND CASE column_type WHEN 'string' THEN false WHEN 'list' THEN type <> 'list' WHEN 'object' THEN type <> 'object' ELSE i IS NULL AND d IS NULL AND b IS NULL END) AS failed,
  CAST(sum(i) AS BIGINT) AS integers, count(d) AS decimals, count(*) FILTER (b) AS trues FROM cast_ GROUP BY ALL"""

P6_SQL = f"""WITH RECURSIVE {_FILES_SQL},
pairs AS (SELECT file_id, lag(file_id) OVER (PARTITION BY install_id, file_kind, source_name ORDER BY written_at NULLS FIRST, file_id) AS old_id FROM readable),
now AS (SELECT p.file_id, t.path, t.above, t.type, t.value FROM pairs p JOIN typed t USING (file_id) WHERE old_id IS NOT NULL),
old AS (SELECT p.file_id, t.path, t.above, t.type, t.value FROM pairs p JOIN typed t ON t.file_id = p.old_id),
added AS (SELECT n.* FROM now n ANTI JOIN old USING (file_id, path)),
came AS (SELECT a.* FROM added a LEFT JOIN old o ON o.file_id = a.file_id AND o.path = a.above WHERE a.above = '' OR o.type = 'object'),
removed AS (SELECT o.* FROM old o ANTI JOIN now USING (file_id, path)),
gone AS (SELECT r.* FROM removed r LEFT JOIN now n ON n.file_id = r.file_id AND n.path = r.above WHERE r.above = '' OR n.type = 'object'),
both_sides AS (SELECT DISTINCT value FROM (SELECT value FROM came UNION ALL SELECT value FROM gone)),
-- a value by its leaves in order of their paths, so that the order of keys doesn't matter
canon AS (
  SELECT CAST(b.value AS VARCHAR) AS value, string_agg(j.fullkey || chr(1) || j.type || chr(1) || CASE WHEN j.type IN ('OBJECT', 'ARRAY') THEN '' ELSE CAST(j.value AS VARCHAR) END, chr(2) ORDER BY j.fullkey) AS text
  FROM both_sides b, json_tree(b.value) j GROUP BY 1),
moved AS (
  SELECT g.file_id, g.path AS field, c.path AS new_field FROM gone g JOIN came c ON c.file_id = g.file_id AND c.type = g.type AND g.type <> 'null'
  JOIN canon x ON x.value = CAST(g.value AS VARCHAR) JOIN canon y ON y.value = CAST(c.value AS VARCHAR) WHERE x.text = y.text)
SELECT file_id, 'renamed' AS change, field, new_field FROM moved
UNION SELECT file_id, 'removed', path, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.file_id = g.file_id AND m.field = g.path)
UNION SELECT file_id, 'added', path, '' FROM came c WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.file_id = c.file_id AND m.new_field = c.path)
UNION SELECT n.file_id, 'retyped', n.path, '' FROM now n JOIN old o USING (file_id, path) WHERE n.type <> 'null' AND o.type <> 'null' AND n.type <> o.type
"""

QUERIES = {
    "p3_found": p3_found,
    "p3_change_counts": p3_change_counts,
    "p6_found": p6_found,
    "p6_path_types": p6_path_types,
    "p6_file_types": p6_file_types,
    "p6_table": p6_table,
    "p6_casts": p6_casts,
}
SQL = {
    "p3_found": P3_SQL,
    "p3_change_counts": f"SELECT source_name, snapshot_label, change, count(*) AS pages FROM ({P3_SQL}) GROUP BY ALL",
    "p6_found": P6_SQL,
    "p6_path_types": P6_TYPES_SQL,
    "p6_file_types": P6_FILES_SQL,
    "p6_casts": P6_CASTS_SQL,
}
