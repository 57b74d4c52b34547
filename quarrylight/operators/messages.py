"""Chat messages: validity, episodes, their text and hashes, registry of chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrylight.functions import text, urls
from quarrylight.operators import rows


def valid(messages: DataFrame) -> DataFrame:
    """Messages (chat_id, message_id, body, sent_at text, deleted, from_me) that count: not deleted, with a body and a time; body is cleaned and `ts` added."""
    df = messages.withColumn("body", text.cleaned(F.coalesce("body", F.lit("")))).withColumn("ts", text.iso_time(F.col("sent_at")))
    return df.filter(~F.coalesce("deleted", F.lit(False)) & (F.col("body") != "") & F.col("ts").isNotNull())


def sessions(df: DataFrame, keys: list[str], ts: str, order: str, gap: int, most: int = 40) -> DataFrame:
    """`df` with `session` and `part`: a pause of more than `gap` microseconds opens a session, which is cut into parts of `most` rows."""
    at = W.partitionBy(*keys).orderBy(ts, order)
    pause = F.timestamp_diff("MICROSECOND", F.lag(ts).over(at), F.col(ts))
    df = df.withColumn("session", F.coalesce((pause > max(gap, 1)).cast("int"), F.lit(0)))
    df = df.withColumn("session", F.sum("session").over(at))
    place = F.row_number().over(W.partitionBy(*keys, "session").orderBy(ts, order))
    return df.withColumn("part", F.floor((place - 1) / max(most, 1)))


def episodes(messages: DataFrame, gap_minutes: int = 720, most: int = 40, least: int = 3) -> DataFrame:
    """(chat_id, episode_id, messages, started_at, ended_at, transcript, content_sha1) of valid messages; parts of fewer than `least` go."""
    df = sessions(messages, ["chat_id"], "ts", "message_id", max(gap_minutes, 1) * 60_000_000, most)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX")
    who = F.when(F.col("from_me"), "True").otherwise("False")
    said = F.struct("ts", "message_id", F.concat(iso, F.lit("|"), who, F.lit("|"), "body").alias("line"), F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("] "), F.when(F.col("from_me"), "Us").otherwise("Them"), F.lit(": "), "body").alias("shown"))
    found = df.groupBy("chat_id", "session", "part").agg(F.array_sort(F.collect_list(said)).alias("m")).filter(F.size("m") >= max(least, 1))
    first, last = F.col("m")[0], F.element_at("m", -1)
    key = F.concat_ws("|", "chat_id", first["message_id"].cast("string"), last["message_id"].cast("string"))
    lines = lambda field: F.array_join(F.transform("m", lambda x: x[field]), "\n")
    return found.select("chat_id", F.sha1(key).alias("episode_id"), F.size("m").alias("messages"), first["ts"].alias("started_at"), last["ts"].alias("ended_at"), lines("shown").alias("transcript"), F.sha1(lines("line")).alias("content_sha1"))


def dry_summary(episodes_: DataFrame) -> DataFrame:
    """Episodes with a summary that no model writes: who, when, how many."""
    return episodes_.withColumn("summary", F.concat(F.lit("Chat "), "chat_id", F.lit(" with "), F.col("messages").cast("string"), F.lit(" messages, "), text.date_range(F.col("started_at"), F.col("ended_at"))))


def episode_text(chat: Column, started: Column, ended: Column, summary: Column, transcript: Column) -> Column:
    """What an episode is embedded as."""
    return F.concat_ws("\n", F.concat(F.lit("Chat: "), chat), F.concat(F.lit("Date: "), text.date_range(started, ended)), F.concat(F.lit("Summary: "), summary), transcript)


def changed(episodes_: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """Episodes with a status: new, changed or skipped against known (episode_id, content_sha1); `force` skips none."""
    both = episodes_.join(known.select("episode_id", F.col("content_sha1").alias("old")), "episode_id", "left")
    status = F.when(F.col("old").isNull(), "new").when((F.col("old") != F.col("content_sha1")) | F.lit(force), "changed").otherwise("skipped")
    return both.withColumn("status", status).drop("old")


def orphans(stored: DataFrame, episodes_: DataFrame) -> DataFrame:
    """Stored episodes of chats that were read again and no longer have them: a late message changes an episode's id."""
    again = stored.join(episodes_.select("chat_id").distinct(), "chat_id", "left_semi")
    return again.join(episodes_.select("episode_id"), "episode_id", "left_anti")


def invites(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """Sources (url, chat_id, invite) with an address that opens: their own invite, else the registry's (chat_id, invite)."""
    known = rows.keep_first(registry.filter(F.trim("invite") != ""), ["chat_id"], "invite").select("chat_id", F.col("invite").alias("registered"))
    both = sources.join(known, "chat_id", "left")
    invite = F.coalesce(F.nullif(F.trim("invite"), F.lit("")), F.col("registered"))
    return both.withColumn("invite", invite).withColumn("open_url", urls.chat_url(invite, F.col("chat_id"))).drop("registered")


def live(cache: DataFrame, now: Column) -> DataFrame:
    """Rows of a cache (expires_at) that have not run out."""
    return cache.filter(F.col("expires_at") > now)
