"""Row numbers within groups of any size.

A window over a whole group sorts it in one task. Here rows are parted by ranges of (group, order), so a large
group is spread over many tasks; each range is numbered by itself, and the counts of the ranges before it are added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.session import cut


def with_row_number(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """The rows with their place, from 1, in their group by ``order``, nulls first; nulls in ``by`` form a group.

    ``order`` must tell the rows of a group apart, or equal ones are numbered in any order. The rows are written
    once, as the ranges are drawn from a sample and must hold for all that is read from them.
    """
    keys = [F.col(c) for c in [*by, *order]]
    ranged = cut(rows.repartitionByRange(*[k.asc_nulls_first() for k in keys]).withColumn("__range", F.spark_partition_id()))
    inside = Window.partitionBy("__range", *by).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = ranged.withColumn("__place", F.row_number().over(inside))
    # one row for each range of a group
    sizes = ranged.groupBy("__range", *by).agg(F.count(F.lit(1)).alias("__rows"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__rows").over(earlier), F.lit(0))
    offsets = sizes.select(F.col("__range").alias("__of_range"), *[F.col(c).alias(f"__of_{c}") for c in by], before.alias("__before"))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__of_{c}")), by, F.col("__range") == F.col("__of_range"))
    return numbered.join(offsets, same).select(*rows.columns, (F.col("__place") + F.col("__before")).alias(name))
