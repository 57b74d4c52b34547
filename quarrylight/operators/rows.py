"""Keep-first, diversification, promotion, upsert and delete: window and join forms of ordered list handling."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Sides of at most so many rows and bytes are broadcast; larger ones are joined as Spark sees fit.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 32 << 20


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint where it has at most `rows` rows and their texts and lists `size` bytes; the look stops one row later."""
    some = df.limit(rows + 1)
    wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary", "array", "struct", "map")]
    n, held = some.agg(F.count("*"), F.coalesce(F.sum(sum(wide, F.lit(16 * len(df.columns)))), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df


def shared_dir(df: DataFrame) -> str:
    """The folder of spark.checkpoint.dir; without one in local mode a temporary folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        path = context.getConf().get("spark.checkpoint.dir")
        if not path and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="quarrylight-"))
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """`df` computed once and its lineage cut, by a checkpoint in the shared folder."""
    shared_dir(df)
    return df.checkpoint()


def stored(df: DataFrame, **options) -> DataFrame:
    """`df` written as a Parquet table in the shared folder, with the writer's options, and read again; it is deleted when the process ends."""
    path = f"{shared_dir(df)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(where)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, keys: list[str], *order: str | Column) -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def ordinals(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Rows numbered from 1 over the whole table by `order`, which tells them apart: each range of it counts its own rows and begins where those before it end, so that no task has all."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("__range", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))  # a row a partition
    before = sizes.withColumn("__before", F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1))).select("__range", F.coalesce("__before", F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(before), "__range").withColumn(name, (F.col("__before") + F.col("__in") + 1).cast("int")).drop("__range", "__in", "__before")


def keep_first(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key; Spark limits groups before the shuffle."""
    return numbered(df, "__rn", keys, *order).filter("__rn = 1").drop("__rn")


def diversify(df: DataFrame, query: str, group: str, cap: int, limit: int, protected: Column) -> DataFrame:
    """At most `cap` rows a group and `limit` a query by `rank`; protected rows are not capped by group."""
    capped = numbered(df, "__n", [query, group], "rank").filter(protected | (F.col("__n") <= cap)).drop("__n")
    return numbered(capped, "position", [query], "rank").filter(F.col("position") <= limit)


def promote(df: DataFrame, query: str, tier: Column) -> DataFrame:
    """Rows of lower tiers to the front, otherwise in the order of `rank`; the new order is `position`."""
    return numbered(df, "position", [query], tier, "rank")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` with the rows of `new` put in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_where(df: DataFrame, condition: Column | None) -> DataFrame:
    """Rows that do not satisfy `condition` (null: they stay); a delete without a condition is refused."""
    if condition is None:
        raise ValueError("a delete needs a condition")
    return df.filter(~F.coalesce(condition, F.lit(False)))
