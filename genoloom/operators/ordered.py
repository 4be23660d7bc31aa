"""Positions of rows within groups, in order, without ever holding a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.session import materialize


def ordered_positions(df: DataFrame, groups: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """df with a 0-based long column: the row's place in its group by ``order``.

    Rows are range-partitioned by (groups, order), so a hot group is spread over many blocks; the counts of each block and
    group, at most blocks + groups rows, give the offsets. Groups must not be null; rows that tie in ``order`` come in
    some order, fixed for this table by the blocks that are written.
    """
    keys = [F.col(g) for g in groups] + order
    blocks = materialize(df.repartitionByRange(*keys).withColumn("_block", F.spark_partition_id()), "ordered")
    by_block = ["_block", *groups]
    counts = blocks.groupBy(*by_block).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by_block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*by_block).orderBy(*order)) - 1
    placed = blocks.withColumn("_local", local).join(offsets, by_block)
    return placed.withColumn(name, F.col("_local") + F.col("_before")).drop("_block", "_local", "_before")
