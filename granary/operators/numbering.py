"""Numbers of rows within groups that may be of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.tables import cut_lineage


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """rows with their number in their group by order, from 1.

    Rows are sorted by range of group and order, so a large group lies in several partitions. Those are numbered where
    they are; what a partition adds is how many rows of the group the partitions before it hold, from one count for each
    group and partition.
    """
    placed = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumns({"__at": F.monotonically_increasing_id(), "__part": F.spark_partition_id()})
    placed = cut_lineage(placed)  # the ranges must not be drawn anew
    counts = placed.groupBy(*group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__part")) - F.col("__n")
    offsets = counts.select(*(F.col(g).alias(f"__g{k}") for k, g in enumerate(group)), F.col("__part").alias("__p"), (before - F.col("__first")).alias("__offset"))
    same = F.col("__part") == F.col("__p")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    return placed.join(offsets, same).select(*rows.columns, (F.col("__at") + F.col("__offset") + 1).alias(name))
