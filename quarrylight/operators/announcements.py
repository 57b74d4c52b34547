"""Press releases and events: what a page's embedded record says of them, and their text from its visible lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight import config
from quarrylight.functions import text, urls
from quarrylight.operators import sections

SECTION_NAMES = {"press_release": "Press Releases", "event": "Events"}


def visible_lines(html: Column) -> Column:
    """The texts between a page's tags, a line each, without scripts and styles; blank ones go."""
    seen = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", "\n")
    broken = F.regexp_replace(seen, r"(?s)<[^>]+>", "\n")
    return F.filter(F.transform(F.split(text.unescaped(broken), "\n"), text.strip), lambda x: x != "")


def dated(line: Column) -> Column:
    """Whether a line begins with a date: 2024-05-01, or May 1, 2024."""
    return line.rlike(r"^\d{4}-\d{2}-\d{2}") | line.rlike(r"^[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}")


def body_lines(lines: Column, most: int = 40) -> Column:
    """The lines after a title that are text, as one pass with what was taken so far as its state.

    Short lines count only beside a short beginning (a date, a source) or if
    they are dates; the first line has 20 characters or more; after `most` long ones no more is taken, as the
    format has it.
    """
    empty = F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("taken"))

    def step(state: Column, line: Column) -> Column:
        taken, n = state["taken"], F.size(state["taken"])
        more = F.concat(taken, F.array(line))
        head = F.coalesce(F.length(F.get(taken, F.lit(0))) < 60, F.lit(False)) & (n <= 2)
        short = (F.length(line) < 40) & (n >= 1)
        kept = F.when(short & ~head & ~dated(line), taken).when(~short & (F.length(line) < 20) & (n == 0), taken).otherwise(more)
        done = ~short & (F.size(kept) > n) & (F.size(kept) >= most)
        return F.when(state["done"], state).otherwise(F.struct(done.alias("done"), kept.alias("taken")))

    return F.aggregate(lines, empty, step, lambda s: s["taken"])


def taken_lines(lines: Column, name: Column, most: int = 40, paragraphs: int = 12) -> Column:
    """struct<titled, lines>: the text under `name` (lower case), from the line after the first that has it, or is in it, to one that ends articles; without such a line the first long ones."""
    low = F.transform(lines, lambda x: F.lower(x))
    start = F.coalesce(F.array_position(F.transform(low, lambda x: (name != "") & (F.contains(x, name) | F.contains(name, x))), True), F.lit(0)).cast("int")
    rest = F.slice(lines, start + 1, F.greatest(F.size(lines) - start, F.lit(0)))
    stop = F.array_position(F.transform(rest, lambda x: F.lower(x).rlike("^(?:" + "|".join(config.ANNOUNCEMENT_ENDS) + ")")), True).cast("int")
    whole = F.when(stop > 0, F.slice(rest, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(rest)
    long = F.slice(F.filter(lines, lambda x: F.length(x) >= 80), 1, paragraphs)
    return F.struct((start > 0).alias("titled"), F.when(start > 0, body_lines(whole, most)).otherwise(long).alias("lines"))


def body(lines: Column, title: Column, most: int = 40, paragraphs: int = 12) -> Column:
    """The text of `taken_lines` under a title, without the ends of cut texts."""
    taken = taken_lines(lines, F.lower(text.cleaned(F.coalesce(title, F.lit("")))), most, paragraphs)
    return text.without_crumbs(F.array_join(taken["lines"], "\n\n"))


def details(pages: DataFrame) -> DataFrame:
    """(url, kind, title, date, time, place, partners, body, problem) of pages (url, html) of press releases and events.

    What the embedded record of the page's slug says comes first, the page's
    own lines after it.  `place` is a release's publication and an
    event's location.  `problem` says why a page is left out: it is of an event to come, a form to be
    told of one, or has no text.
    """
    url = urls.canonicalised(F.col("url"))
    df = pages.select(url.alias("url"), "html").withColumn("kind", urls.page_kind(F.col("url"))).filter(F.col("kind").isin(*SECTION_NAMES))
    slug = F.element_at(F.filter(F.split(F.regexp_replace(F.col("url"), r"[?#].*$", ""), "/"), lambda x: x != ""), -1)
    df = df.withColumn("slug", slug).withColumn("records", sections.embedded_objects(F.col("html"))).withColumn("lines", visible_lines(F.col("html")))
    df = df.withColumn("r", F.get(F.filter("records", lambda x: F.get_json_object(x, "$.slug") == F.col("slug")), F.lit(0)))
    said = lambda *names: F.coalesce(*(F.nullif(text.cleaned(F.get_json_object("r", f"$.{n}")), F.lit("")) for n in names))
    press = F.col("kind") == "press_release"
    h1 = F.nullif(text.cleaned(text.unescaped(F.regexp_replace(F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1), "<[^>]+>", ""))), F.lit(""))
    title = F.coalesce(said("title"), F.when(press, h1), F.nullif(F.replace("slug", F.lit("-"), F.lit(" ")), F.lit("")), F.lit("Press Release"))
    df = df.withColumn("title", title).withColumn("own", body(F.col("lines"), F.col("title"))).withColumn("told", text.without_crumbs(F.coalesce(said("description"), F.lit(""))))
    release = F.when((F.length("own") < 80) & (F.length("told") > 40) & ~F.startswith("told", F.lit("$")), F.col("told")).otherwise(F.col("own"))
    event = F.when(F.length("told") < 40, F.col("own")).otherwise(F.col("told"))
    first, last = said("startTime"), said("endTime")
    partner = lambda x: F.when(F.get_json_object(x, "$.name").isNotNull(), F.get_json_object(x, "$.name")).when(F.get_json_object(x, "$.title").isNotNull(), F.get_json_object(x, "$.title")).when(~F.startswith(x, F.lit("{")), x)
    partners = F.filter(F.transform(F.coalesce(F.from_json(F.get_json_object("r", "$.partners"), "array<string>"), F.array().cast("array<string>")), lambda x: text.cleaned(partner(x))), lambda x: F.coalesce(x, F.lit("")) != "")
    kind = F.lower(F.coalesce(F.get_json_object("r", "$.type"), F.lit("")))
    to_come = ~press & ((F.lower(F.coalesce(F.get_json_object("r", "$.isUpcomingEvents"), F.lit(""))) == "true") | F.contains(kind, F.lit("upcoming")))
    form = ~press & (F.col("told") == "") & (kind == "") & F.contains(F.array_join("lines", " "), F.lit("Notify Me"))
    df = df.withColumn("body", F.when(press, release).otherwise(event))
    problem = F.when(to_come, "an event to come").when(form, "a form").when(F.col("body") == "", "no text")
    times = F.when(~press, F.when(first.isNotNull() & last.isNotNull(), F.concat(first, F.lit(" – "), last)).otherwise(first))
    return df.select("url", "kind", "title", said("date", "publishedAt").alias("date"), times.alias("time"), said("location").alias("place"), F.when(~press, partners).alias("partners"), "body", problem.alias("problem"))


def parts(found: DataFrame) -> DataFrame:
    """(url, ordinal, heading_path, text): the body of each detail without a problem, two paragraphs a part."""
    df = found.filter("problem IS NULL").select("url", F.posexplode(sections.paragraphs(F.col("body"))).alias("n", "text"))
    return df.filter(F.length("text") >= 12).select("url", (F.col("n") + 1).alias("ordinal"), F.concat(F.lit("body > part-"), (F.col("n") + 1).cast("string")).alias("heading_path"), "text")
