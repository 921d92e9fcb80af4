"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Settings that any session of this library wants; size-dependent ones are left to the cluster.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("pagestrata")
    conf = BASE_CONF | {
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make reliable checkpoints possible.

    The shared folder that the cluster names in ``spark.checkpoint.dir`` is used as it is. A folder of
    our own is set only where none is named, and only in local mode, where every task sees it.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().isDefined():
        return
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="pagestrata-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written copy.

    Used where one result feeds several branches: it is computed once and survives lost executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A written side of a join is broadcast up to this size.
BROADCAST_BYTES = 16 << 20


def broadcast_if_small(written: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A side of a join, with a broadcast hint if its rows weigh at most ``limit`` bytes.

    A join that learns this only while it runs has already moved its other side. ``written`` is read once more,
    so it should be the result of ``cut`` or a table.
    """

    def weight(field: T.StructField):
        size = {T.StringType: F.octet_length, T.BinaryType: F.octet_length, T.ArrayType: lambda c: 8 * F.size(c)}.get(type(field.dataType))
        return F.coalesce(size(F.col(field.name)), F.lit(0)) + 16 if size else F.lit(16)

    held = written.agg(F.sum(reduce(lambda a, b: a + b, map(weight, written.schema)))).first()[0] or 0
    return F.broadcast(written) if held <= limit else written
