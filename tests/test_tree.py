"""A page's tree as rows, and cards found in it against a walk up the tree."""

import re

from pyspark.sql import functions as F

from quarrylight import engine, jobs
from quarrylight.functions import text
from quarrylight.operators import tree

CARD = '<div class="card"><div><h3 aria-label="{0}">x</h3></div><p>Some words of what it is about</p><span>Starting from</span> <b>AED {1}</b></div>'
PAGES = [
    ("one", "<html><body><div id=a>" + CARD.format("Gold visa card", "1,200") + CARD.format("Silver visa card", "900") + CARD.format("Gold visa card", "1") + "</div><script>Starting from AED 5</script></body></html>"),
    ("two", "<div><section><h2>A heading with no price in reach</h2></section><p>USD 5</p></div><div><p>A paragraph that gives the title</p><b>Starting from</b> USD 77.50 a year</div><ul><li>Starting from USD 1 with no title in its element</li></ul><h2>Alone in the page</h2>"),
    ("long", "<div><h2>Heading of a long page</h2><p>" + "word " * 900 + "</p><div><h3>Inner heading of it</h3><p>Starting from SAR 40 for all that it has</p></div></div>"),
    ("deep", "<div>" * 30 + "<h2>Deep down in here</h2>" + "</div>" * 30 + "<p>Starting from GBP 8 and then some more words</p>"),
    ("none", None),
    ("empty", ""),
    ("bare", "Starting from EUR 9 without any element"),
]


def walked(html):
    """Cards by walking up from each heading and each starting price, one node at a time."""
    reader = tree._Reader()
    reader.feed(html or "")
    reader.close()
    rows = [dict(zip(("pre", "last", "parent", "tag", "label", "text", "up", "block"), r, strict=True)) for r in reader.rows()]
    clean = lambda t: re.sub(r"\s+([,.;:!?])", r"\1", re.sub(r"[ \t]+", " ", t)).strip()
    price = lambda t: re.search(r"(?i)(AED|SAR|USD|SGD|EUR|GBP)\s*[\d,]+(?:\.\d+)?", t)
    whole = lambda n: " ".join("x" * 3_000 if r["text"] is None else r["text"] for r in rows[n["pre"] : n["last"] + 1] if r["tag"] == "#text")
    found, seen = [], set()

    def add(title, body):
        title, body = clean(title), clean(body)
        if len(title) >= 8 and title not in seen and price(body):
            seen.add(title)
            found.append((title, body))

    for h in rows:
        if h["tag"] not in ("h2", "h3"):
            continue
        node, body = h, None
        for _ in range(10):
            if node is None:
                break
            t = whole(node)
            if "starting from" in t.lower() and price(t) and 40 < len(t) < 2500:
                body = t
                break
            node = rows[node["parent"]] if node["parent"] is not None else None
        if body is None:
            node = rows[h["parent"]] if h["parent"] is not None else None
            while node is not None and node["tag"] != "div":
                node = rows[node["parent"]] if node["parent"] is not None else None
            body = whole(node) if node is not None and len(whole(node)) <= 2500 else None
        if body is not None:
            add(h["label"] or whole(h), body)
    for s in rows:
        if s["tag"] != "#text" or "starting from" not in (s["text"] or "").lower():
            continue
        node = rows[s["parent"]] if s["parent"] is not None else None
        for _ in range(8):
            if node is None:
                break
            t = whole(node)
            if price(t) and 20 < len(t) < 2500:
                inner = rows[node["pre"] + 1 : node["last"] + 1]
                title = next((r["label"] or whole(r) for r in inner if r["tag"] in ("h2", "h3", "h4")), None)
                title = title or next((clean(whole(r)) for r in inner if r["tag"] == "p" and 12 < len(clean(whole(r))) < 120 and "starting" not in whole(r).lower()), None)
                if title:
                    add(title, t)
                break
            node = rows[node["parent"]] if node["parent"] is not None else None
    return found


def test_cards_match_a_walk(spark):
    df = spark.createDataFrame(PAGES, "url string, html string")
    got = {}
    for r in tree.service_cards(df).collect():
        got.setdefault(r.url, {})[r.ordinal] = (r.title, r.text)
    for url, html in PAGES:
        wanted = walked(html)
        assert [got.get(url, {})[k] for k in sorted(got.get(url, {}))] == wanted, url
    assert [t for t, _ in walked(PAGES[0][1])] == ["Gold visa card", "Silver visa card"] and [t for t, _ in walked(PAGES[1][1])] == ["A heading with no price in reach", "A paragraph that gives the title"]
    assert ("Inner heading of it", "Inner heading of it Starting from SAR 40 for all that it has") in walked(PAGES[2][1])


def test_trees_of_whole_pages(spark):
    """Every node lies within what holds it, and short elements have the text of their parts."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = {}
    for r in tree.nodes(pages, "page_id").collect():
        rows.setdefault(r.page_id, []).append(r)
    assert len(rows) == pages.filter("length(trim(html)) > 0").count()
    for found in rows.values():
        found.sort(key=lambda r: r.pre)
        assert [r.pre for r in found] == list(range(len(found)))
        for r in found:
            assert r.up[0] == r.pre and (r.parent is None or (found[r.parent].pre < r.pre and found[r.parent].last >= r.last and r.up[1] == r.parent))
            whole = " ".join(x.text for x in found[r.pre : r.last + 1] if x.tag == "#text" and x.text is not None)
            long = any(x.tag == "#text" and x.text is None for x in found[r.pre : r.last + 1])
            assert long or r.text == (whole if len(whole) <= tree.LONGEST else None)


def test_ingest_keeps_the_cards_of_a_listing(spark, tmp_path):
    store = engine.VectorStore(spark, str(tmp_path / "c"), 16)
    ingest = jobs.Ingest(spark, store, engine.HashedBag(16), str(tmp_path / "s"))
    page = "<html><body><article><h2>What this service is about</h2><p>A paragraph of more than twenty characters.</p></article>" + PAGES[0][1] + "</body></html>"
    ingest.pages(spark.createDataFrame([("https://www.example.com/services/visa", page)], "url string, html string"))
    assert {"Catalog > Gold visa card", "Catalog > Silver visa card"} <= {r.heading_path for r in store.rows().collect()}


def test_cards_of_no_pages(spark):
    assert tree.service_cards(spark.createDataFrame([], "url string, html string")).count() == 0
    assert spark.range(1).select(text.cleaned(F.lit(None).cast("string"))).first()[0] is None
