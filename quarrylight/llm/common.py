"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it; `bytes.split()` cuts at the same six characters.
WHITE = r"[\x20\x09-\x0D]+"

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where none is set a temporary one, in local mode only."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = path.get() if path.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quarrylight-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder, with the writer's options, and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarrylight/{name}-{uuid.uuid4().hex}"
    with no_shuffle_files(spark):
        df.write.options(**options).parquet(path)
    _remember(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarrylight_path = path
    return out


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """As `written`, in as many buckets by `column` as joins have partitions: joins on it leave the table where it is."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarrylight/{name}-{uuid.uuid4().hex}"
    table = f"quarrylight_{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with no_shuffle_files(spark):
        df.repartition(n, column).write.format("parquet").bucketBy(n, column).option("path", path).saveAsTable(table)
    _remember(spark, path)
    out = spark.table(table)
    out._quarrylight_path, out._quarrylight_table = path, table
    return out


@contextmanager
def no_shuffle_files(spark: SparkSession):
    """Inside, a query's shuffle files go when it ends: what it made is a table, which nothing recomputes from them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _remember(spark: SparkSession, path: str) -> None:
    if not _scratch:
        atexit.register(_drop_all)
    _scratch.append((spark, path))


def drop(df: DataFrame) -> None:
    """Delete a table made by `written` or `bucketed` that no later plan reads."""
    path, table = getattr(df, "_quarrylight_path", None), getattr(df, "_quarrylight_table", None)
    if table:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _scratch[:] = [x for x in _scratch if x[1] != path]


def _drop_all() -> None:
    for spark, path in list(_scratch):
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone by now
            return


#: Bits of a sieve: 8 MB.
SIEVE_BITS = 26


def sieve(rows: DataFrame, column: str, wanted: DataFrame, inside: bool = True) -> DataFrame:
    """`rows` less most of those whose `column` is not in the same column of `wanted`; an exact join is to follow.  With `inside` false the rows that are left out, none of which is in `wanted`.

    A bitmap of hashed values is broadcast, 8 MB at most however many there
    are, so that rows which no join partner waits for are never shuffled.  The more values, the
    more others pass.
    """
    bucket, bitmap = fresh(rows, "bucket", "bitmap")
    place = F.pmod(F.xxhash64(column), F.lit(1 << SIEVE_BITS)) + 1
    bits = wanted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(bitmap))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    tested = rows.withColumn(bucket, F.bitmap_bucket_number(place)).join(F.broadcast(bits), bucket, "inner" if inside else "left")
    return tested.filter(F.coalesce(F.getbit(byte, at % 8), F.lit(0)) == int(inside)).drop(bucket, bitmap)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, column: str = "text") -> Column:
    return F.coalesce(docs[column], F.lit(""))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names made of `names` that `docs` does not have, whatever their case."""
    taken = {c.lower() for c in docs.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once a row: a lambda variable holds it."""
    return F.transform(F.array(value), body)[0]


def bucket_of(column: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; null ids count as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus
