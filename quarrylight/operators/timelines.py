"""Order within groups: clusters by gaps, serial numbers, forward fills, pairs of rows, groups of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def gap_clusters(df: DataFrame, keys: list[str], top: str, bottom: str, order: str, gap: int) -> DataFrame:
    """`df` with `cluster`: rows by (top, order); one that begins more than `gap` below the lowest end so far opens a new cluster."""
    w = W.partitionBy(*keys).orderBy(top, order)
    before = F.max(bottom).over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.coalesce((F.col(top) - F.col("cluster") > gap).cast("long"), F.lit(0))
    return df.withColumn("cluster", before).withColumn("cluster", fresh).withColumn("cluster", F.sum("cluster").over(w.rowsBetween(W.unboundedPreceding, 0)))


def serial_fill(df: DataFrame, keys: list[str], stated: Column, *order: str) -> DataFrame:
    """`df` with `serial`: stated numbers stay, others go on from the highest lead before them."""
    w = W.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("serial", stated).withColumn("serial_place", F.row_number().over(w))
    ahead = F.max(F.col("serial") - F.col("serial_place")).over(W.partitionBy(*keys).orderBy("serial_place").rowsBetween(W.unboundedPreceding, -1))
    filled = F.coalesce("serial", F.col("serial_place") + F.greatest(F.lit(0), F.coalesce("serial_ahead", F.lit(0)))).cast("long")
    return df.withColumn("serial_ahead", ahead).withColumn("serial", filled).drop("serial_place", "serial_ahead")


def filled(df: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """`df` with the last value that is not null, its own row's included."""
    return df.withColumn(name, F.last(value, True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def groups_of(df: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """`df` with `part`: rows of a group in their order, `size` by `size`."""
    return df.withColumn("part", F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1) / size))


def followed(df: DataFrame, keys: list[str], order: str, first: Column, second: Column, value: str) -> DataFrame:
    """Rows that fulfil `first` and whose next row fulfils `second`, with the next row's value as `next_value`."""
    w = W.partitionBy(*keys).orderBy(order)
    both = df.withColumn("next_ok", F.lead(second).over(w)).withColumn("next_value", F.lead(value).over(w))
    return both.filter(first & F.coalesce("next_ok", F.lit(False))).drop("next_ok")
