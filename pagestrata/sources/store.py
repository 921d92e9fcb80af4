"""Snapshots as partitioned Parquet, and manifests in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata import schemas
from pagestrata.operators import diff, summary


def write_snapshot(rows: DataFrame, root: str, table: str, source: str, snapshot: str) -> None:
    """Writes one table of a snapshot to ``root/table/source_name=…/snapshot_label=…``; a snapshot written again replaces itself."""
    rows.drop("source_name", "snapshot_label").write.mode("overwrite").parquet(f"{root}/{table}/source_name={source}/snapshot_label={snapshot}")


def read_snapshots(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All snapshots of a table; filters on source_name and snapshot_label prune partitions."""
    return spark.read.option("basePath", f"{root}/{table}").option("mergeSchema", True).parquet(f"{root}/{table}")


def labels(spark: SparkSession, root: str, table: str = "pages") -> DataFrame:
    """(source_name, snapshot_label) of the stored snapshots, from the folders alone."""
    return read_snapshots(spark, root, table).select(F.col("source_name").cast("string").alias("source_name"), F.col("snapshot_label").cast("string").alias("snapshot_label")).distinct()


def snapshot_or_latest(spark: SparkSession, root: str, source: str, snapshot: str | None = None) -> str:
    """The given label, which must exist, or the greatest one of the source."""
    mine = labels(spark, root).where(F.col("source_name") == source)
    if snapshot is None:
        found = summary.latest_snapshots(mine).first()
    else:
        found = mine.where(F.col("snapshot_label") == snapshot).first()
    if found is None:
        raise LookupError(f"no snapshot {snapshot or ''} of {source}".replace("  ", " "))
    return found.snapshot_label


def previous_label(spark: SparkSession, root: str, source: str, current: str) -> str | None:
    """The greatest label of the source other than ``current``."""
    return labels(spark, root).where((F.col("source_name") == source) & (F.col("snapshot_label") != current)).agg(F.max("snapshot_label")).first()[0]


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests in JSON, one file each, in the declared schema; what a file lacks is null."""
    return spark.read.schema(schemas.MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("file", F.col("_metadata.file_path"))


def migrated_manifests(manifests: DataFrame) -> DataFrame:
    """The manifests in the current version, a missing diff filled in from the pages; ``rewritten`` tells which changed.

    The earlier snapshot of a filled-in diff isn't known.
    """
    old = F.coalesce("schema_version", F.lit(0)) < schemas.MANIFEST_VERSION
    pages = manifests.select("file", F.explode("pages").alias("p")).select("file", F.coalesce("p.change_status", F.lit("unknown")).alias("change_status"))
    counts = diff.summarize(pages, "file").select("file", F.struct(F.lit(None).cast("string").alias("previous_snapshot_label"), "new_pages", "changed_pages", "unchanged_pages", "removed_pages", "import_candidates").alias("__diff"))
    joined = manifests.join(counts, "file", "left")
    filled = F.when(old & F.col("diff").isNull(), F.col("__diff")).otherwise(F.col("diff"))
    return joined.withColumns({"rewritten": old, "diff": filled, "schema_version": F.when(old, schemas.MANIFEST_VERSION).otherwise(F.col("schema_version"))}).drop("__diff")


def migration_counts(migrated: DataFrame) -> DataFrame:
    return migrated.agg(F.count(F.lit(1)).alias("scanned"), F.count_if("rewritten").alias("rewritten"))


def export_json(rows: DataFrame, path: str) -> None:
    """One JSON document per row, for readers outside of Spark."""
    rows.write.mode("overwrite").json(path)
