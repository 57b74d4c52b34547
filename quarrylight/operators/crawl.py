"""Discovery of pages: sitemaps, links, paging and crawls by levels over a table of pages, whose fetching is a boundary."""

from __future__ import annotations

import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import urls
from quarrylight.operators import rows
from quarrylight.sources.tables import Table

HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""


def hrefs(html: Column) -> Column:
    """Targets of anchors that lead to pages, in order."""
    found = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(HREF), F.lit(1)), lambda x: F.trim(F.replace(x, F.lit("&amp;"), F.lit("&"))))
    return F.filter(found, lambda x: (x != "") & ~x.rlike(r"(?i)^(#|mailto:|tel:|javascript:)"))


def links(pages: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """(url, pos, target, kind) of the links of pages (url, html), absolute and canonical, each once a page; only of `domains` where they are given."""
    df = pages.select("url", F.posexplode(hrefs(F.col("html"))).alias("pos", "href")).withColumn("target", urls.canonicalised(F.col("href"), F.col("url")))
    df = rows.keep_first(df, ["url", "target"], "pos")
    if domains:
        df = df.filter(urls.allowed(F.col("target"), domains))
    t = F.col("target")
    return df.select("url", "pos", "target", F.when(urls.blog_post(t), "post").when(urls.pagination(t), "pagination").when(urls.category(t), "category").when(urls.listing(t), "listing").otherwise("page").alias("kind"))


def sitemap(locations: DataFrame, maps: DataFrame) -> DataFrame:
    """Addresses of sitemaps `locations` (url) and of those they index, two levels; `maps` has (url, xml)."""
    loc = lambda d: d.select(F.explode(F.array_distinct(F.regexp_extract_all("xml", F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)))).alias("loc"), F.col("xml").rlike("(?i)<sitemapindex").alias("index"))
    top = loc(maps.join(locations, "url", "left_semi"))
    inner = loc(maps.join(top.filter("index").select(F.col("loc").alias("url")), "url", "left_semi")).filter("NOT index")
    return top.filter("NOT index").select("loc").unionByName(inner.select("loc")).distinct()


def last_page(said: Column, most: int = 200) -> Column:
    """The number of pages that a pager tells of: `1 2 3 ... 9 >` or `page 2 / 9`; 1 where it tells nothing."""
    slash = F.regexp_extract(said, r"(?i)\bpage\s+\d+\s*(?:/|of)\s*(\d+)", 1).try_cast("int")
    row = F.regexp_extract(said, r"\b1\s+2\s+(?:\d+\s+)*(?:(?:…|\.\.\.)\s*)?(\d+)\s*(?:>|›|»|Next)", 1).try_cast("int")
    return F.least(F.greatest(F.coalesce(slash, row, F.lit(1)), F.lit(1)), F.lit(most))


def inferred_pages(listings: DataFrame) -> DataFrame:
    """(url, page, target): pages 2 to N of listings (url, pager)."""
    n = last_page(F.col("pager"))
    more = F.when(n >= 2, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    return listings.select("url", F.explode(more).alias("page")).withColumn("target", F.concat(urls.listing_base(F.col("url")), F.lit("page/"), F.col("page").cast("string"), F.lit("/")))


def paged(items: DataFrame, keep: list[str], most: int = 50) -> DataFrame:
    """Rows (page, pos, ...) of a paged listing until a page brings nothing new: pages after the first without a new key, and beyond `most`, go; keys once."""
    first = rows.keep_first(items.filter(F.col("page") <= most), keep, "page", "pos")
    fresh = first.select("page").distinct()
    every = items.select("page").distinct().filter(F.col("page") <= most)
    dry = every.join(fresh, "page", "left_anti").agg(F.min("page").alias("stop"))
    return first.join(F.broadcast(dry)).filter(F.col("stop").isNull() | (F.col("page") < F.col("stop"))).drop("stop")  # one row


def crawl(seeds: DataFrame, edges: DataFrame, levels: int = 2, cap: int = 0, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """(url, level, found_on): what is reached from seeds (url) along edges (url, pos, target) within `levels`, each address at its first level.

    A level is one join with the pages found at the one before, less what is known;
    of several pages that lead to an address the smallest counts; `cap` above 0 is the most children that a
    page gives, by the order of its links.  Every level is computed once.
    """
    edges = rows.settled(edges.select("url", "pos", "target"))
    seen = seeds.select("url", F.lit(0).alias("level"), F.lit(None).cast("string").alias("found_on")).distinct()
    frontier = seen
    for level in range(1, levels + 1):
        out = keep(edges.join(frontier.select("url"), "url", "left_semi"))
        if cap > 0:
            out = rows.numbered(out, "place", ["url"], "pos").filter(F.col("place") <= cap)
        new = out.groupBy(F.col("target").alias("next")).agg(F.min("url").alias("found_on"))
        new = new.join(seen.select(F.col("url").alias("next")), "next", "left_anti")
        frontier = rows.settled(new.select(F.col("next").alias("url"), F.lit(level).alias("level"), "found_on"))
        seen = seen.unionByName(frontier)
    return seen


#: What is known of an address: where it was found, the listing that its page belongs to, what came when it was asked for (status null: not asked yet, 0: nothing came).
SEEN = "url string, level int, found_on string, base string, status int, final_url string, html string"


def crawl_live(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], levels: int = 2, cap: int = 0, domains: list[str] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda d: d, state: Table | None = None) -> DataFrame:
    """Rows of SEEN that are reached from seeds (url), each level's pages fetched before the next one's addresses are known.

    `fetch` gives (url, status, final_url, html) of addresses (url).  A page that
    answers under another address is registered under that one too, which then
    is not asked for again; its links count from there.  `cap` above 0 is the
    most children that a listing gives over all its pages.  `keep` drops
    links (url, pos, target, kind).  A level is one commit to `state`, from which a crawl
    that was stopped goes on, or one to more levels; addresses from which nothing came are asked for again then.
    """
    spark = seeds.sparkSession
    state = state or Table(spark, f"{rows.shared_dir(seeds)}/crawl-{uuid.uuid4().hex}", SEEN, key="url")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("found_on", "string"), ("base", "string"), ("status", "int"), ("final_url", "string"), ("html", "string"))]
    first = seeds.select(urls.canonicalised(F.col("url")).alias("url")).distinct()
    fresh = rows.stored(first.join(state.read().select("url"), "url", "left_anti"))
    if fresh.head(1):
        state.upsert(fresh.select("url", F.lit(0).alias("level"), *nothing))
    for level in range(levels + 1):
        known = rows.stored(state.read().drop("html"))
        waiting = known.filter((F.col("level") == level) & (F.coalesce("status", F.lit(0)) == 0)).select("url", "level", "found_on", "base")
        if not waiting.head(1):
            continue
        final = F.when(F.coalesce(F.trim("final_url"), F.lit("")) == "", F.col("url")).otherwise(urls.canonicalised(F.col("final_url")))
        got = rows.stored(waiting.join(fetch(waiting.select("url")), "url", "left").select(*waiting.columns, F.coalesce("status", F.lit(0)).alias("status"), final.alias("final_url"), "html"))
        # pages under the addresses that they answer from
        turned = got.filter("status > 0 AND final_url <> url").withColumn("found_on", F.col("url")).withColumn("url", F.col("final_url"))
        alias = rows.keep_first(turned, ["url"], "found_on").join(known.select("url"), "url", "left_anti")
        met = rows.stored(got.withColumn("html", F.when(F.col("url") == F.col("final_url"), F.col("html"))).unionByName(alias))
        pages = rows.keep_first(met.unionByName(turned).filter("url = final_url AND html IS NOT NULL AND status BETWEEN 1 AND 399"), ["url"], "found_on")
        came = known.filter("status > 0").select(F.col("final_url").alias("url"))
        out = keep(links(pages.join(came, "url", "left_anti").select("url", "html"), domains))
        now = known.join(met.select("url"), "url", "left_anti").unionByName(met.drop("html"))
        names = now.select(F.explode(F.array("url", "final_url")).alias("target"))
        new = rows.keep_first(out, ["target"], "url", "pos").join(names, "target", "left_anti").withColumn("base", urls.listing_base(F.col("url")))
        if cap > 0:
            had = now.groupBy("base").agg(F.count("*").alias("had"))
            new = rows.numbered(new, "place", ["base"], "url", "pos").join(had, "base", "left").filter(F.col("place") + F.coalesce("had", F.lit(0)) <= cap)
        # those of the last level wait for a deeper crawl
        state.upsert(met.unionByName(new.select(F.col("target").alias("url"), F.lit(level + 1).alias("level"), F.col("url").alias("found_on"), "base", *nothing[2:])))
    return state.read().filter(F.col("level") <= levels)


def empty_listings(found: DataFrame, listings: DataFrame) -> DataFrame:
    """Listings (url) with how many children a crawl has from each; `empty` where there is none."""
    n = found.filter("found_on IS NOT NULL").groupBy(F.col("found_on").alias("url")).agg(F.count("*").alias("children"))
    return listings.select("url").join(n, "url", "left").select("url", F.coalesce("children", F.lit(0)).alias("children"), F.col("children").isNull().alias("empty"))


def get(url: str, tries: int, wait: float, open_=urllib.request.urlopen, sleep=time.sleep) -> tuple[int, str, str]:
    """(status, final address, body): answers of 500 and above, and lost connections, are tried again after a wait that doubles; the last failure is raised."""
    for n in range(tries):
        try:
            with open_(url, timeout=30) as answer:
                if answer.status < 500:
                    return answer.status, answer.geturl(), answer.read().decode("utf-8", "replace")
                problem: Exception = OSError(f"status {answer.status} of {url}")
        except OSError as e:
            if getattr(e, "code", 500) < 500:
                return e.code, url, ""
            problem = e
        if n + 1 < tries:
            sleep(wait * 2**n)
    raise problem


def fetched(found: DataFrame, delay: float = 1.0, tries: int = 3, tasks: int = 8, fetch: Callable[[str], tuple[int, str, str]] | None = None) -> DataFrame:
    """(url, status, final_url, html) of addresses (url): hosts stay together in a task, which waits between its requests; where nothing comes the status is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = fetch or (lambda u: get(u, tries, delay))
        first = True
        for batch in batches:
            for url in batch.column(0).to_pylist():
                if not first:
                    time.sleep(delay)
                first = False
                try:
                    status, final, html = one(url)
                except OSError:
                    status, final, html = 0, url, None
                yield pa.record_batch([pa.array([url]), pa.array([status], pa.int32()), pa.array([final]), pa.array([html], pa.string())], ["url", "status", "final_url", "html"])

    host = F.lower(urls.part(F.col("url"), 2))
    return found.select("url").distinct().repartition(tasks, host).mapInArrow(run, "url string, status int, final_url string, html string")


def api_pages(spark: SparkSession, call: Callable[[int], list[dict]], schema: str, most: int = 50) -> DataFrame:
    """Rows of a paged API with page and pos; a page a task; `call` gives a page's rows and is called on executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column(0).to_pylist():
                got = call(page)
                yield pa.RecordBatch.from_pylist([{"page": page, "pos": i, **{f.name: row.get(f.name) for f in names}} for i, row in enumerate(got)], arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = StructType.fromDDL(f"page long, pos long, {schema}")
    names, arrow = StructType.fromDDL(schema), to_arrow_schema(full)
    return spark.range(1, most + 1, 1, most).mapInArrow(run, full)


def details(ids: DataFrame, call: Callable[[str], dict | None], schema: str) -> DataFrame:
    """Records of an API by id: `ids` (id), each asked once; what `call` gives null for is left out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = StructType.fromDDL(f"id string, {schema}")
    names, arrow = StructType.fromDDL(schema), to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(i, call(i)) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist([{"id": i, **{f.name: r.get(f.name) for f in names}} for i, r in got if r is not None], arrow)

    return ids.select(F.col("id").cast("string")).distinct().mapInArrow(run, full)


def messages(spark: SparkSession, call: Callable[[str, int], list[dict]], chats: DataFrame, schema: str, size: int = 100, most: int = 100) -> DataFrame:
    """Messages of chats (chat_id) by offsets until a page is short, empty or brings nothing new; each message (id) once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chat in batch.column(0).to_pylist():
                seen: set = set()
                for n in range(most):
                    got = call(chat, n * size)
                    new = [m for m in {m["id"]: m for m in reversed(got)}.values() if m["id"] not in seen][::-1]
                    seen.update(m["id"] for m in new)
                    if new:
                        yield pa.RecordBatch.from_pylist([{"chat_id": chat, **{f.name: m.get(f.name) for f in names}} for m in new], arrow)
                    if len(got) < size or not new:
                        break

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = StructType.fromDDL(f"chat_id string, {schema}")
    names, arrow = StructType.fromDDL(schema), to_arrow_schema(full)
    return chats.select(F.col("chat_id").cast("string")).distinct().mapInArrow(run, full)
