"""Answers that catalogs give to a table of questions, by route."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight import config
from quarrylight.functions import text
from quarrylight.operators import announcements, catalogs, reports
from quarrylight.plans import Slate, read

slate = Slate()
ASKED = ("concat('Compare Nation ', (conv_id * 7 + turn) % 25, ' with nation ', (conv_id * 11) % 25)", "concat('How many packages in NATION ', conv_id % 25, '?')", "concat('list all funds of nation ', (conv_id + turn) % 25)", "'how many packages are under economy or promo?'", "''", "concat('difference between Nation ', 2 + conv_id % 7)")


def questions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users say, each with something asked of a catalog, or nothing."""
    said = read(spark, sf_dir, "conversations").filter("role = 'user'")
    which = F.expr("(CASE " + " ".join(f"WHEN (conv_id + turn) % 6 = {i} THEN {a}" for i, a in enumerate(ASKED)) + " END)")
    return said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat("text", F.lit("\n"), which).alias("question"))


def catalogs_of(spark: SparkSession, sf_dir: str) -> catalogs.Catalogs:
    """Nations with suppliers as funds and their customers' segments as packages, kinds of parts as services, and nations of a region compared on each other's pages."""
    nation, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    listed = lambda df, key, order, name, price, cur: reports.in_order([key], df, order, F.struct(F.col(name).alias("name"), price.alias("price"), F.lit(cur).alias("currency")), "l")
    funds = listed(read(spark, sf_dir, "supplier").filter("s_acctbal > 0"), "s_nationkey", "s_suppkey", "s_name", F.col("s_acctbal"), "usd").select(F.col("s_nationkey").alias("n_nationkey"), F.col("l").alias("funds"))
    segments = read(spark, sf_dir, "customer").filter("c_nationkey % 6 <> 5").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").cast("double").alias("n"))
    packages = listed(segments, "c_nationkey", "c_mktsegment", "c_mktsegment", F.col("n"), "aed").select(F.col("c_nationkey").alias("n_nationkey"), F.col("l").alias("packages"))
    none = F.array().cast("array<struct<name:string,price:double,currency:string>>")
    text = lambda prefix: F.concat(F.lit(prefix), k.cast("string"))
    countries = nation.join(funds, "n_nationkey", "left").join(packages, "n_nationkey", "left").select(
        text("Nation ").alias("name"), text("n").alias("shortcode"), text("Nation-").alias("slug"), F.when(k % 9 == 8, "").otherwise(text("https://www.example.com/country-overview/nation-")).alias("source_url"), F.coalesce("funds", none).alias("funds"), F.coalesce("packages", none).alias("packages"),
    )
    parts = read(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.when(F.contains("p_name", F.lit("gear")), " ").otherwise(F.col("p_name")).alias("p")).distinct()
    services = reports.in_order(["name"], parts, "p", F.struct(F.col("p").alias("name")), "packages").withColumn("source_url", F.lit(""))
    peers = nation.select("n_regionkey", F.col("n_nationkey").alias("peer"))
    pairs = nation.select("n_regionkey", F.col("n_nationkey").alias("of")).join(peers, "n_regionkey").filter("of <> peer OR of % 4 <> 3")
    field = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    p = F.col("peer")
    fields = F.array(field("Region", F.concat(F.lit("number <"), F.col("n_regionkey").cast("string"), F.lit(">"))), field("VAT Rate", F.concat(p.cast("string"), F.lit("  %"))), field("Banking", F.when(p % 3 == 0, "").when(p % 3 == 1, "easy & fast").otherwise("slow")), field("Region", F.concat(F.lit("seen from "), F.col("of").cast("string"))))
    compared = pairs.select(F.concat(F.lit("nation-"), F.col("of").cast("string")).alias("page"), p.alias("pos"), F.when(p % 2 == 0, F.concat(F.lit("nation-"), p.cast("string"))).alias("slug"), F.concat(F.lit("Nation "), p.cast("string")).alias("name"), F.when(p % 2 == 1, F.concat(F.lit("N"), p.cast("string"))).alias("shortcode"), fields.alias("fields"))
    return catalogs.Catalogs(countries, services, compared)


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern.replace(chr(39), chr(39) * 2)}')"


_CASE = "CASE " + " ".join(f"WHEN (conv_id + turn) % 6 = {i} THEN {a}" for i, a in enumerate(ASKED)) + " END"
_ESC = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_MONEY = "CASE WHEN x.price = floor(x.price) THEN x.price::BIGINT::VARCHAR ELSE printf('%.2f', x.price) END"


def _esc(said: str) -> str:
    return _ESC.format(said)


@slate(rf"""
    WITH q AS (SELECT conv_id * 1000 + turn AS query_id, text || chr(10) || ({_CASE}) AS question FROM conversations WHERE role = 'user'),
    n AS (SELECT n_nationkey AS k, n_regionkey AS region, 'Nation ' || n_nationkey AS name, CASE WHEN n_nationkey % 9 = 8 THEN '' ELSE 'https://www.example.com/country-overview/nation-' || n_nationkey END AS url FROM nation),
    named AS (SELECT query_id, question, k, name, url FROM q, n WHERE contains(lower(question), lower(name))),
    wanted AS (SELECT query_id, k, name, url, row_number() OVER (PARTITION BY query_id ORDER BY -length(name), name) AS ord FROM named WHERE {_has('question', config.COMPARE_QUERY)} QUALIFY count(*) OVER (PARTITION BY query_id) >= 2),
    compared AS (SELECT a.k AS page, b.k AS peer, a.region FROM n a JOIN n b USING (region) WHERE a.k <> b.k OR a.k % 4 <> 3),
    hits AS (
        SELECT w.query_id, p.k AS peer, p.name, p.url, p.ord, (c.page <> c.peer)::INT AS away, c.page, c.region
        FROM wanted w JOIN compared c ON c.page = w.k JOIN wanted p ON p.query_id = w.query_id AND p.k = c.peer
        QUALIFY row_number() OVER (PARTITION BY w.query_id, p.k ORDER BY away, w.ord, c.peer) = 1),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY away, ord) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM hits QUALIFY n >= 2),
    cells AS (
        SELECT query_id, place, 'VAT Rate' AS key, peer || ' %' AS value, 2 AS pos FROM placed
        UNION ALL SELECT query_id, place, 'Banking', CASE WHEN peer % 3 = 1 THEN 'easy & fast' ELSE 'slow' END, 3 FROM placed WHERE peer % 3 <> 0
        UNION ALL SELECT query_id, place, 'Region', 'seen from ' || page, 1 FROM placed),
    keyed AS (SELECT query_id, key, CASE key WHEN 'VAT Rate' THEN 4 WHEN 'Banking' THEN 10 ELSE 13 END AS tier, min(place * 10 + pos) AS seen FROM cells GROUP BY ALL),
    grid AS (SELECT k.query_id, k.key, k.tier, k.seen, p.place, p.name, c.value FROM keyed k JOIN placed p USING (query_id) LEFT JOIN cells c ON c.query_id = k.query_id AND c.place = p.place AND c.key = k.key),
    lines AS (SELECT query_id, tier, seen, key, '<tr><th scope="row">' || {_esc('key')} || '</th>' || string_agg('<td>' || {_esc("coalesce(value, '—')")} || '</td>', '' ORDER BY place) || '</tr>' AS line FROM grid GROUP BY query_id, tier, seen, key),
    body AS (SELECT query_id, string_agg(line, chr(10) ORDER BY tier, seen, key) AS body FROM lines GROUP BY ALL),
    peers AS (SELECT query_id, place, 'Comparison peer: ' || name || coalesce(chr(10) || string_agg(key || ': ' || value, chr(10) ORDER BY tier, seen, key) FILTER (value IS NOT NULL), '') AS said FROM grid GROUP BY query_id, place, name),
    heads AS (
        SELECT query_id, string_agg(name, ' vs ' ORDER BY place) AS titles, string_agg('<th>' || {_esc('name')} || '</th>', '' ORDER BY place) AS th,
            string_agg('<li><a href="' || url || '" target="_blank" rel="noopener noreferrer">' || name || '</a></li>', chr(10) ORDER BY place) FILTER (url <> '') AS links, count(*) AS n,
            string_agg(url, ' ' ORDER BY place) AS urls
        FROM placed GROUP BY query_id),
    compares AS (
        SELECT h.query_id, 'compare' AS route, h.n,
            '<p>Comparison of <strong>' || titles || '</strong> from the country overview tables:</p>' || chr(10) || '<div class="compare-table-wrap">' || chr(10) || '<table class="compare-table">' || chr(10) || '<thead><tr><th>Criteria</th>' || th || '</tr></thead>' || chr(10) || '<tbody>' || chr(10) || body || chr(10) || '</tbody>' || chr(10) || '</table>' || chr(10) || '</div>' || chr(10)
            || coalesce('<p><strong>Source pages:</strong></p>' || chr(10) || '<ul>' || chr(10) || links || chr(10) || '</ul>', '') AS answer,
            urls, (SELECT string_agg(said, chr(10) || chr(10) ORDER BY place) FROM peers p WHERE p.query_id = h.query_id) AS texts
        FROM heads h JOIN body USING (query_id)),
    meant AS (SELECT query_id, question, k, name, url FROM named WHERE {_has('question', config.LOCATION_COUNT)} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(name) DESC, name) = 1),
    funds AS (SELECT s_nationkey AS k, list({{'name': s_name, 'price': s_acctbal, 'currency': 'USD'}} ORDER BY s_suppkey) AS l FROM supplier WHERE s_acctbal > 0 GROUP BY 1),
    segments AS (SELECT c_nationkey AS k, c_mktsegment AS s, count(*)::DOUBLE AS n FROM customer WHERE c_nationkey % 6 <> 5 GROUP BY ALL),
    packages AS (SELECT k, list({{'name': s, 'price': n, 'currency': 'AED'}} ORDER BY s) AS l FROM segments GROUP BY 1),
    chosen AS (
        SELECT m.*, CASE WHEN {_has('question', config.FUNDS_CUE)} AND NOT {_has('question', config.PACKAGES_CUE)} THEN 'funds' WHEN p.l IS NOT NULL THEN 'packages' ELSE 'funds' END AS kind, f.l AS f, p.l AS p
        FROM meant m LEFT JOIN funds f USING (k) LEFT JOIN packages p USING (k)),
    items AS (SELECT *, coalesce(CASE WHEN kind = 'funds' THEN f ELSE p END, []) AS l FROM chosen),
    counts AS (
        SELECT query_id, 'location_count' AS route, 1 AS n,
            name || ' has ' || len(l) || ' ' || kind || CASE WHEN len(l) = 0 THEN '.' ELSE ':' || chr(10) || array_to_string(list_transform(list_slice(l, 1, CASE WHEN {_has('question', config.LIST_WORD)} OR len(l) <= 12 THEN len(l) ELSE 8 END), lambda x, i: i || '. ' || x.name || ' (from ' || x.currency || ' ' || {_MONEY} || ')'), chr(10))
                || CASE WHEN {_has('question', config.LIST_WORD)} OR len(l) <= 12 THEN '' ELSE chr(10) || 'and ' || (len(l) - 8) || ' more' END END AS answer,
            CASE WHEN url = '' THEN 'catalog://' || name ELSE url END AS urls,
            'Country: ' || name || chr(10) || kind || ' count: ' || len(l) || CASE WHEN len(l) = 0 THEN '' ELSE chr(10) || array_to_string(list_transform(l, lambda x: x.name), chr(10)) END AS texts
        FROM items),
    parts AS (SELECT p_type AS service, list(DISTINCT p_name ORDER BY p_name) AS l FROM part WHERE NOT contains(p_name, 'gear') GROUP BY 1),
    served AS (
        SELECT query_id, question, service, l FROM q JOIN parts ON contains(lower(question), lower(service)) WHERE {_has('question', config.SERVICE_COUNT)}
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(service) DESC, service) = 1),
    services AS (
        SELECT query_id, 'service_count' AS route, 1 AS n,
            service || ' has ' || len(l) || ' packages: ' || CASE WHEN len(l) <= 40 OR {_has('question', config.LIST_WORD)} THEN array_to_string(l, '; ') ELSE array_to_string(l[1:8], '; ') || ' and ' || (len(l) - 8) || ' more' END AS answer,
            'catalog://' || service AS urls, 'Service: ' || service || chr(10) || 'Package count: ' || len(l) || chr(10) || 'Packages:' || chr(10) || array_to_string(l, chr(10)) AS texts
        FROM served),
    every AS (SELECT *, 0 AS tier FROM compares UNION ALL SELECT *, 1 FROM counts UNION ALL SELECT *, 2 FROM services)
    SELECT query_id, route, n::INT AS n, answer, urls, texts FROM every QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tier) = 1""")
def catalog_answers(spark, sf_dir):
    """Comparisons and counts that users' turns ask for, with their sources."""
    found = catalogs.answers(questions_of(spark, sf_dir), catalogs_of(spark, sf_dir))
    joined = lambda field, by: F.array_join(F.transform("sources", lambda s: s[field]), by)
    return found.select("query_id", "route", F.size("sources").alias("n"), "answer", joined("source_url", " ").alias("urls"), joined("chunk_text", "\n\n").alias("texts"))


@slate(r"""
    WITH t AS (SELECT lower(text) AS low, conv_id * 1000 + turn AS query_id FROM conversations),
    w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')[1:3]) AS name FROM benchmark)
    SELECT query_id, name FROM t, w WHERE contains(low, name)""")
def names_contained(spark, sf_dir):
    """Names, here the first words of items, that whole turns contain."""
    first = F.slice(F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, 3)
    names = read(spark, sf_dir, "benchmark").select(F.explode(first).alias("name"))
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))
    return catalogs.names_in(turns, names).select("query_id", "name")


_ENDS = "^(?:" + "|".join(config.ANNOUNCEMENT_ENDS) + ")"


@slate(rf"""
    WITH seen AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS lines FROM documents),
    named AS (SELECT doc_id, lines, lower(coalesce(lines[1 + doc_id % 3], '')) AS name FROM seen),
    cut AS (SELECT *, list_position(list_transform(lines, lambda x: name <> '' AND (contains(lower(x), name) OR contains(name, lower(x)))), true) AS start FROM named),
    rest AS (SELECT *, CASE WHEN start > 0 THEN lines[start + 1:] ELSE [] END AS under FROM cut),
    ended AS (SELECT *, list_position(list_transform(under, lambda x: regexp_matches(lower(x), '{_ENDS}')), true) AS stop FROM rest),
    whole AS (SELECT *, CASE WHEN stop > 0 THEN under[1:stop - 1] ELSE under END AS kept FROM ended),
    told AS (SELECT doc_id, start, lines, list_reduce(list_transform(kept, lambda x: [x]), lambda acc, x: CASE
            WHEN acc[1] = 'done' THEN acc
            WHEN length(x[1]) < 40 AND len(acc) > 1 THEN CASE WHEN (length(acc[2]) < 60 AND len(acc) <= 3) OR regexp_matches(x[1], '^\d{{4}}-\d{{2}}-\d{{2}}') OR regexp_matches(x[1], '^[A-Za-z]{{3,9}}\s+\d{{1,2}},?\s+\d{{4}}') THEN list_concat(acc, x) ELSE acc END
            WHEN length(x[1]) < 20 AND len(acc) = 1 THEN acc
            WHEN len(acc) >= 40 THEN list_concat(['done'], list_concat(acc[2:], x))
            ELSE list_concat(acc, x) END, ['going'])[2:] AS taken FROM whole),
    chosen AS (SELECT doc_id, start > 0 AS titled, CASE WHEN start > 0 THEN taken ELSE list_filter(lines, lambda x: length(x) >= 80)[1:12] END AS taken FROM told)
    SELECT doc_id, coalesce(titled, false) AS titled, len(taken)::INT AS n, md5(trim(regexp_replace(array_to_string(taken, chr(10) || chr(10)), '{config.CRUMBS}', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS body FROM chosen""")
def announcement_bodies(spark, sf_dir):
    """What counts as text under a title, here one of a document's first lines, by the lines of whole documents."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), text.strip), lambda x: x != "")
    df = read(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")).withColumn("name", F.coalesce(F.get("lines", (F.col("doc_id") % 3).cast("int")), F.lit("")))
    kept = df.withColumn("taken", announcements.taken_lines(F.col("lines"), F.lower("name")))
    return kept.select("doc_id", F.col("taken.titled").alias("titled"), F.size("taken.lines").alias("n"), F.md5(text.without_crumbs(F.array_join("taken.lines", "\n\n"))).alias("body"))


QUERIES, ORACLES = slate.queries, slate.oracles
