"""Structure of pages, files and nested objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import pages
from quarrylight.plans import Slate, read
from quarrylight.sources import files, sinks

slate = Slate()


def html_blocks(spark, sf_dir):
    """Blocks of every page."""
    found = read(spark, sf_dir, "pages").select("page_id", F.inline(pages.html_blocks("html")))
    return found.select("page_id", "pos", "kind", F.sha1("text").alias("sha"))


def table_pairs(spark, sf_dir):
    """Order lines as text blocks of a page: odd ones on the left, each with the nearest free one on the right."""
    line = read(spark, sf_dir, "lineitem")
    top = F.col("l_partkey") % 1000
    side = F.when(F.col("l_linenumber") % 2 == 1, "left").otherwise("right")
    blocks = line.select(F.col("l_orderkey").alias("page"), side.alias("side"), top.alias("top"), (top + 40).alias("bottom"), F.concat_ws(" ", "l_returnflag", "l_linenumber").alias("text"))
    return pages.pair_blocks(blocks, most=200)


@slate("SELECT conv_id, turn, text AS plain FROM conversations")
def rich_text(spark, sf_dir):
    """Turns as nodes with children, flattened to what they say."""
    half = F.expr("length(text) div 2")
    child = lambda x: F.array(F.struct(x.alias("text")))
    node = F.struct(F.left("text", half).alias("text"), child(F.substring(F.col("text"), half + 1, F.length("text"))).alias("children"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("text").isNotNull(), pages.rich_text(F.to_json(node))).alias("plain"))


@slate("""SELECT event_id, concat_ws(' | ', event_type, CASE WHEN user_id % 3 <> 0 THEN user_id::VARCHAR END, 'a "b", c') AS flat FROM events""")
def csv_flat_text(spark, sf_dir):
    """Lines of CSV with quoted and empty cells as flat text."""
    user = F.when(F.col("user_id") % 3 != 0, F.col("user_id").cast("string")).otherwise("")
    line = F.concat_ws(",", "event_type", user, F.lit('" a ""b"", c"'))
    return read(spark, sf_dir, "events").select("event_id", files.joined_cells(line).alias("flat"))


@slate("SELECT DISTINCT url AS loc FROM pages WHERE NOT regexp_matches(url, '[<\\s]')")
def sitemap_scan(spark, sf_dir):
    """The addresses of sitemaps, one of every fifty pages."""
    maps = read(spark, sf_dir, "pages").groupBy(F.expr("page_id div 50")).agg(F.array_join(F.collect_list(F.concat(F.lit("<url><LOC> "), "url", F.lit("\n</loc></url>"))), "").alias("xml"))
    return maps.select(F.explode(files.sitemap_locs(F.col("xml"))).alias("loc")).distinct()


@slate("""WITH slugs AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(url, '/+$', ''), '^https?://', ''), '[^\\p{L}\\p{N}_-]+', '_', 'g') AS s FROM pages)
    SELECT page_id, CASE WHEN length(s) <= 120 THEN s ELSE s[:100] || '_' || sha1(url)[:12] END AS name FROM slugs""")
def artifact_names(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", sinks.artifact_name(F.col("url")).alias("name"))


@slate("""SELECT 'r' || r_regionkey AS id, r_name AS path FROM region
    UNION ALL SELECT 'n' || n_nationkey, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 's' || s_suppkey, r_name || '/' || n_name || '/' || s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def folder_tree(spark, sf_dir):
    """Regions, nations and suppliers as folders, with their paths."""
    level = lambda name, own, parent, title: read(spark, sf_dir, name).select(F.concat(F.lit(own[0]), own[2:]).alias("id"), parent.alias("parent_id"), F.col(title).alias("name"))
    top = level("region", "r:r_regionkey", F.lit(None).cast("string"), "r_name")
    nodes = top.unionByName(level("nation", "n:n_nationkey", F.concat(F.lit("r"), "n_regionkey"), "n_name")).unionByName(level("supplier", "s:s_suppkey", F.concat(F.lit("n"), "s_nationkey"), "s_name"))
    return files.folder_paths(nodes, top.select("id"))


@slate("""SELECT event_id, 'w' || (user_id % 10) AS text, floor(value)::INT AS conf FROM events WHERE user_id % 10 <> 0 AND event_type <> 'error'
    UNION ALL SELECT event_id, 'x', 7 FROM events""")
def ocr_words(spark, sf_dir):
    """Words of recognised pages; blank ones and ones of no confidence go."""
    word = F.when(F.col("user_id") % 10 == 0, " ").otherwise(F.concat(F.lit(" w"), (F.col("user_id") % 10).cast("string")))
    conf = F.when(F.col("event_type") == "error", "-1").otherwise(F.col("value").cast("string"))
    box = F.array(F.lit(1), F.lit(2), F.lit(3)).alias
    data = read(spark, sf_dir, "events").select("event_id", F.array(word, F.lit("x"), F.lit("y")).alias("text"), F.array(conf, F.lit("7.0"), F.lit("?")).alias("conf"), *map(box, ("left", "top", "width", "height")))
    return files.ocr_words(data, ["event_id"]).select("event_id", "text", "conf")


@slate("""SELECT event_id, list_filter(['e' || event_id, CASE WHEN event_type = 'error' THEN 'u' || user_id END], lambda x: x IS NOT NULL) AS ids FROM events""")
def failed_ids(spark, sf_dir):
    """Ids of failed jobs out of lines of a log."""
    second = F.when(F.col("event_type") == "error", F.concat(F.lit(', {"id": "u'), "user_id", F.lit('"}'))).otherwise("")
    line = F.concat(F.lit('12:00 done {"failed": [{"id": "e'), "event_id", F.lit('"}'), second, F.lit("]} ok"))
    return read(spark, sf_dir, "events").select("event_id", files.failed_ids(line).alias("ids"))


@slate("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE ['pdf', 'csv', 'xlsx'][doc_id % 4 + 1] END AS kind FROM documents""")
def file_dispatch(spark, sf_dir):
    """The kind of a file by its type or its name."""
    no = F.col("doc_id") % 4
    name = F.when(no == 0, "A.PDF").when(no == 1, "b").when(no == 2, "c.xlsx").otherwise("d.txt")
    return read(spark, sf_dir, "documents").select("doc_id", files.file_kind(name, F.when(no == 1, "text/csv")).alias("kind"))


@slate("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, 'top') AS name FROM events")
def nested_first(spark, sf_dir):
    """A field of the nested attributes where it is there, else the one beside them."""
    nested = F.when(F.col("event_id") % 2 == 0, F.struct(F.col("event_type").alias("name")))
    said = F.from_json(F.to_json(F.struct(nested.alias("attributes"), F.lit("top").alias("name"))), "attributes struct<name:string>, name string")
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.coalesce(said["attributes"]["name"], said["name"]).alias("name"))


QUERIES, ORACLES = slate.queries | {"html_blocks": html_blocks, "table_pairs": table_pairs}, slate.oracles
