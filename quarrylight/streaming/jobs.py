"""Streams: sessions with a cap, daily usage, late rows, caches with expiry, incremental ingest by content hash."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylight.sources.tables import Table

SESSION = "key long, started long, ended long, n int"


def sessions(stream: DataFrame, key: str, ts: str, gap: str, delay: str, most: int = 40, least: int = 3) -> DataFrame:
    """key, started, ended (microseconds), n of sessions that the watermark has closed.

    A session ends with a pause longer than `gap` or with its `most`-th row; ones
    of fewer than `least` rows are not given.  Rows wait in the state until the
    watermark has passed them, so that their order is their time; later ones are late
    (see late_rows).  What waits of a key is its rows within `delay`: a key that brings more than
    a task holds in that time needs a shorter delay or a finer key.
    """
    spark = stream.sparkSession
    pause = spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {gap})").head()[0]

    def run(names: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, start, end, n = state.get if state.exists else ([], 0, 0, 0)
        passed = state.getCurrentWatermarkMs() * 1000
        waiting = sorted([*waiting, *(int(t) for f in frames for t in f["at"] if t >= passed)])
        done = []

        def close() -> None:
            if n >= least:
                done.append((names[0], start, end, n))

        ready = [t for t in waiting if t < passed]
        for t in ready:
            if n and (t - end > pause or n >= most):
                close()
                n = 0
            if not n:
                start = t
            end, n = t, n + 1
        waiting = waiting[len(ready) :]
        if n and end + pause < passed and not (waiting and waiting[0] - end <= pause):
            close()
            n = 0
        if n or waiting:
            state.update((waiting, start, end, n))
            due = waiting[0] if waiting else end + pause
            state.setTimeoutTimestamp(max(due, passed) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(done, columns=["key", "started", "ended", "n"])

    timed = stream.withWatermark(ts, delay).select(F.col(key).cast("long").alias("key"), ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    return timed.groupBy("key").applyInPandasWithState(run, SESSION, "waiting array<long>, started long, ended long, n int", "append", GroupStateTimeout.EventTimeTimeout)


def daily_usage(stream: DataFrame, ts: str, kind: str, value: str, delay: str = "1 hour") -> DataFrame:
    """Rows and sum of `value` by day and `kind`; days are given once the watermark has passed them."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("day"), kind, "n", "total")


def late_rows(stream: DataFrame, spark: SparkSession, ts: str, delay_seconds: int, late: str, checkpoint: str, onward=None):
    """Rows that come later than `delay_seconds` behind the latest time seen before their batch go to the table `late`, for a batch run; `onward(batch, number)` gets the others.

    The latest time is kept beside the table, a row a batch, so that a batch that
    runs again judges as it did before.
    """

    def write(batch: DataFrame, number: int) -> None:
        seen = Table(spark, f"{late}_seen", "batch long, latest timestamp", key="batch")
        before = seen.read().filter(F.col("batch") < number).agg(F.max("latest")).first()[0]
        time_ = F.col(ts).cast("timestamp")
        is_late = F.lit(False) if before is None else F.coalesce(time_ < F.lit(before) - F.expr(f"INTERVAL {delay_seconds} SECONDS"), F.lit(False))
        batch.filter(is_late).write.mode("overwrite").parquet(f"{late}/batch={number}")
        if onward is not None:
            onward(batch.filter(~is_late), number)
        latest = batch.agg(F.max(time_).alias("latest")).withColumn("batch", F.lit(number).cast("long"))
        if latest.first().latest is not None:
            seen.upsert(latest.select("batch", "latest"))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_with_expiry(stream: DataFrame, key: str, ts: str, value: str, ttl: str, delay: str) -> DataFrame:
    """(key, value, at, live): each change of a key's newest value, and a row with live = false when it has run out after `ttl`."""
    pause = stream.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {ttl})").head()[0]

    def run(names: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value_, at = state.get if state.exists else (None, -1)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(names[0], value_, at, False)], columns=["key", "value", "at", "live"])
            return
        old = at
        for frame in frames:
            for v, t in zip(frame["value"], frame["at"], strict=True):
                if int(t) >= at:
                    value_, at = v, int(t)
        state.update((value_, at))
        state.setTimeoutTimestamp(max((at + pause) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(names[0], value_, at, True)] if at > old else [], columns=["key", "value", "at", "live"])

    timed = stream.withWatermark(ts, delay).select(F.col(key).cast("string").alias("key"), ts, F.col(value).cast("string").alias("value"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    return timed.groupBy("key").applyInPandasWithState(run, "key string, value string, at long, live boolean", "value string, at long", "append", GroupStateTimeout.EventTimeTimeout)


def ingest(stream: DataFrame, spark: SparkSession, target: str, checkpoint: str, key: str, text: str, order: str | None = None):
    """Append rows of new or changed text to `target`, a Parquet folder by batch; a batch that runs again replaces what it wrote.

    Of a key's rows in a batch the last by `order` counts (the greatest text where there is no order).  What is known is a
    state table by the hash of the key, of which a batch reads and writes the parts that its keys are in, and not the target.
    """
    kinds = dict(stream.dtypes)

    def write(batch: DataFrame, number: int) -> None:
        state = Table(spark, f"{target}_state", f"{key} {kinds[key]}, sha string, batch long, before string, part string", key=key, part="part")
        rank = [F.col(order)] if order else []
        said = F.coalesce(text, F.lit(""))
        last = batch.groupBy(key).agg(F.max(F.struct(*rank, said.alias("_t"), F.struct(*batch.columns).alias("_row"))).alias("m")).select("m._row.*") if order else batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), said).alias("r")).select("r.*")
        rows = last.withColumn("sha", F.sha1(said)).withColumn("part", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(64)).cast("string"))
        parts = [r.part for r in rows.select("part").distinct().collect()]  # 64 at most
        known = state.read(parts).select(key, F.col("sha").alias("now"), "batch", "before")
        # a batch that runs again compares with what was known before it
        both = rows.join(known, key, "left").withColumn("old", F.when(F.col("batch") == number, F.col("before")).otherwise(F.col("now")))
        fresh = both.filter(F.col("old").isNull() | (F.col("old") != F.col("sha")))
        fresh.select(*batch.columns, "sha").write.mode("overwrite").parquet(f"{target}/batch={number}")
        state.upsert(fresh.select(key, "sha", F.lit(number).cast("long").alias("batch"), F.col("old").alias("before"), "part"))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
