"""Taking in snapshots as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagestrata.operators import snapshot_merkle


def arriving_pages(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of the page files that are put into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(folder)


def newest_per_page(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Counts of pages per source and day of fetching, closed once the watermark has passed; later rows are dropped from these counts only."""
    day = F.window("fetched_at", "1 day")
    return stream.withWatermark("fetched_at", lateness).groupBy("source_name", day).agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("page_key").alias("pages"))


def track_changes(stream: DataFrame, snapshots: DataFrame, store: str, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends arriving pages to ``store`` and hands the changes of the snapshots they belong to on to ``sink``.

    A batch is written under its own number, so one that is repeated after a failure replaces itself. Late rows
    count for the snapshot they name: its changes, and those of the snapshot after it, are derived again.
    """

    def take(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
        touched = batch.select("source_name", F.col("snapshot_label").alias("__touched")).distinct()
        affected = snapshots.join(touched, "source_name").where((F.col("snapshot_label") == F.col("__touched")) | (F.col("previous_snapshot_label") == F.col("__touched"))).select(*snapshots.columns).distinct()
        pages = batch.sparkSession.read.option("basePath", store).parquet(store)
        sink(snapshot_merkle.snapshot_changes(pages, affected), number)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
