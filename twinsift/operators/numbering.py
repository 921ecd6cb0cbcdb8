"""Gapless numbering: inside groups of any size, and in the order of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsift.lineage import cut


def gapless_slots(df: DataFrame, group: str, keys: list[str], slot: str, rows_per_bucket: int = 20_000) -> DataFrame:
    """Number the rows of each ``group`` from 0 without gaps, in no group-wide order.

    Rows are dealt into (group, bucket) cells by a hash of ``keys``; only a cell is ever sorted in one task and
    the cells' offsets come from their counts, so a group may hold any share of the rows.  Rows that are equal
    in all ``keys`` share a cell and have its next numbers in any order: give keys that tell rows apart.
    ``df`` is read twice: cut its lineage.
    """
    buckets = max(1, -(-df.count() // rows_per_bucket))
    cells = df.withColumn("_cell", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    counts = cells.groupBy(group, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy(group, "_cell").orderBy(*keys))
    numbered = cells.withColumn("_in", inside).join(offsets, [group, "_cell"])
    return numbered.withColumn(slot, (F.col("_first") + F.col("_in") - 1).cast("long")).drop("_cell", "_in", "_first")


def order_numbers(values: DataFrame, column: str, number: str, per_range: int = 20_000) -> DataFrame:
    """``column, number``: the place from 0 of each of ``values`` (distinct), in byte order with null last.

    Ranges of the order are numbered each in its own task; a task over all has a row per range.
    """
    order = F.col(column).asc_nulls_last()
    n = max(1, -(-values.count() // per_range))
    ranges = cut(values.select(column).repartitionByRange(n, order).withColumn("_r", F.spark_partition_id()))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    first = ranges.groupBy("_r").agg(F.count("*").alias("n")).select("_r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("_r").orderBy(order))
    return ranges.withColumn("_in", inside).join(F.broadcast(first), "_r").select(column, (F.col("first") + F.col("_in") - 1).alias(number))
