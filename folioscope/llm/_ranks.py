"""Ranks within groups of any size: rows are sorted over partitions by range, so that no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm import _text


def ranked(rows: DataFrame, groups: list[str], order: list[Column], rank: str = "rank", total: str = "total") -> DataFrame:
    """rows with each one's rank from 0 within its group, and the group's size.

    Groups are columns without nulls. `rows` is read twice (Spark samples it for the ranges), so it should be a written
    table. Rows are written in order once more, so that ranks within a partition and the sizes of its parts speak of the
    same partitions; only sizes (a row for each group and partition that has it) are summed up group by group. Rows that
    are equal in `order` are ranked in any order.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in groups]
    placed = _text.checkpointed(rows.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order))
    placed = placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part", *groups).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    own = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_size").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", *groups, (before - F.col("_first")).alias("_shift"), F.sum("_size").over(own).alias(total))
    return placed.join(sizes, ["_part", *groups]).withColumn(rank, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
