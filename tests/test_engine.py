"""The engine over its boundaries, the ingest jobs, the command line and serving."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from quarrylight import cli, config, engine, jobs, serve
from quarrylight.functions import predicates, urls
from quarrylight.operators import crawl, messages, payloads, reports, retrieval, sections
from quarrylight.plans import focus, pages as page_plans
from quarrylight.operators import pages as page_ops

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    made = engine.VectorStore(spark, f"{path}/chunks", 64)
    ingest = jobs.Ingest(spark, made, engine.HashedBag(64), f"{path}/state")
    page = lambda title, said: f"<html><body><article><h1>{title}</h1><h2>Introduction to {title} in general</h2><p>{said} " + "and more of it in many words. " * 10 + "</p></article></body></html>"
    site = [("https://www.example.com/services/visa/gold", page("Gold visa", "The golden visa needs a passport")), ("https://www.example.com/services/visa/silver", page("Silver visa", "The silver visa needs a photo")), ("https://www.example.com/", page("Home", "Welcome"))]
    counted = ingest.pages(spark.createDataFrame(site, "url string, html string"))
    again = ingest.pages(spark.createDataFrame(site, "url string, html string"))
    chat = [("g1", i, f"Message {i} about the fee for PM1234", f"2024-01-01T10:0{i}:00Z", False, i % 2 == 0) for i in range(5)]
    chats = ingest.chats(spark.createDataFrame(chat, "chat_id string, message_id long, body string, sent_at string, deleted boolean, from_me boolean"))
    return made, ingest, counted, again, chats, path


def test_ingest_counts_and_skips(store):
    made, ingest, counted, again, chats, _ = store
    assert (counted["new"], counted["seen"]) == (2, 2) and (again["skipped"], again["new"], again["chunks"]) == (2, 0, 0)
    assert chats["new"] == 1 and made.describe_stats()["by_source"] == {"website": 2, "whatsapp": 1}


def test_a_changed_page_replaces_its_chunks(spark, tmp_path):
    made = engine.VectorStore(spark, str(tmp_path / "c"), 16)
    ingest = jobs.Ingest(spark, made, engine.HashedBag(16), str(tmp_path / "s"))
    html = lambda n: "<article>" + "".join(f"<h2>Heading number {i} of the page</h2><p>Text {n} under heading {i} that is long enough</p>" for i in range(n)) + "</article>"
    load = lambda n: ingest.pages(spark.createDataFrame([("https://www.example.com/blog/a", html(n))], "url string, html string"), "blog")
    assert load(3)["chunks"] == 3 and load(2)["changed"] == 1
    assert made.table.read().count() == 2 and made.table.read(["drive"]).count() == 0
    ingest.purge("blog")
    assert made.table.read().count() == 0 and ingest.state.read().count() == 0


def test_engine_answers(spark, store):
    made, *_ = store
    qe = engine.QueryEngine(spark, made, engine.HashedBag(64), least=0.05)
    got = qe.ask("golden visa passport")
    said = [x["source_url"] for x in got["sources"]]
    assert "https://www.example.com/services/visa/gold/" in said and "[Source 1]" in got["answer"]
    assert {s["source_type"] for s in qe.ask("golden visa passport", source="whatsapp")["sources"]} == {"whatsapp"}
    assert any("PM1234" in s["chunk_text"] for s in qe.inspect_retrieve("fee for PM1234"))
    kinds = [e["type"] for e in qe.ask_stream("golden visa passport")]
    assert kinds[0] == "sources" and "done" in kinds[-2:] and set(kinds[1:-2]) <= {"token"}
    assert engine.QueryEngine(spark, made, engine.HashedBag(64), least=2).ask("unheard of zebra")["answer"] == config.EMPTY_ANSWERS["all"]
    with pytest.raises(ValueError):
        qe.ask("x", source="nowhere")
    with pytest.raises(Exception, match="vector"):
        made.upsert_chunks(made.table.read().withColumn("embedding", F.array(F.lit(1.0).cast("float"))))


def test_commands(spark, store, tmp_path, capsys):
    path = store[-1]
    spark.createDataFrame([("c1", "golden visa passport", ["https://www.example.com/services/visa/gold"], ["passport"], ["golden"], None, ["visa"])], "case_id string, query string, refs array<string>, needles array<string>, must array<string>, forbid array<string>, tags array<string>").write.parquet(str(tmp_path / "cases"))
    got = {r.tag: r for r in cli.run(spark, ["eval-rag", "--input", str(tmp_path / "cases"), "--store", path, "--dim", "64", "--min-score", "0.05"]).collect()}
    assert got["overall"].hit == got["visa"].recall == 1.0 and got["overall"].included == 1.0 and got["overall"].forbidden_ok is None
    assert cli.run(spark, ["inspect", "--store", path, "--dim", "64"])["store"]["vectors"] == 3
    assert "gold" in json.dumps(cli.run(spark, ["query", "--question", "golden visa passport", "--store", path, "--dim", "64", "--min-score", "0.05"]))
    assert cli.run(spark, ["build-pricing-index", "--store", path, "--dim", "64", "--output", str(tmp_path / "index")])["codes"] == 1
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "p.csv").write_text('Name,Fee\n"Visa, gold\nclass",100\n')
    assert cli.run(spark, ["drive-ingest", "--input", str(tmp_path / "f"), "--store", str(tmp_path / "s"), "--dim", "64"])["chunks"] == 1
    assert cli.run(spark, ["drive-purge", "--store", str(tmp_path / "s"), "--dim", "64"])["vectors"] == 0


def test_serving(spark, store):
    qe = engine.QueryEngine(spark, store[0], engine.HashedBag(64), least=0.05)
    server = serve.serve(qe, 0, lambda: [{"chat_id": "1@g.us", "invite": "x"}])
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    get = lambda path: json.load(urllib.request.urlopen(base + path))
    post = lambda said: urllib.request.urlopen(urllib.request.Request(base + "/api/chat/stream", json.dumps(said).encode())).read().decode()
    try:
        assert get("/api/health")["status"] == "ok" and get("/api/internal/whatsapp/invite?chat_id=1@g.us")["invite"] == "x" and len(get("/api/internal/whatsapp/chats")["chats"]) == 1
        assert "golden" in post({"question": "golden visa passport"})
        for bad in ({"question": ""}, {"question": "x" * 2001}, {"question": "x", "source": "nowhere"}, {"question": "x", "history": [{}] * 9}):
            with pytest.raises(urllib.error.HTTPError):
                post(bad)
    finally:
        server.shutdown()


def test_retrieval_matches_a_loop(spark):
    """The whole pipeline against lists, one question at a time."""
    questions = focus.questions_of(spark, SF).select("query_id", "question", retrieval.search_text(F.col("question"), F.col("prior")).alias("search_text"))
    asked = {r.query_id: r for r in retrieval.asked(questions).collect()}
    chunks = focus.chunks_of(spark, SF)
    every = chunks.crossJoin(retrieval.asked(questions).select("query_id")).withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(0)).withColumn("lexical", F.lit(False))
    facts = {(r.query_id, r.chunk_id): r for r in retrieval.described(every.join(retrieval.asked(questions), "query_id")).collect()}
    start = {}
    for r in focus.matches_of(spark, SF).collect():
        start.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.score))
    got = {}
    for r in focus.retrieve_questions(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.position, r.chunk_id, r.score))
    ids = [r.chunk_id for r in chunks.collect()]
    up = lambda s, by: min(0.99, s + by) if by > 0 else max(0.01, s + by)
    for q, a in asked.items():
        f = lambda c, q=q: facts[q, c]
        rows = [(c, s, False) for _, c, s in sorted(start.get(q, []))]

        def merge(hits, rows):
            seen, out = set(), []
            for row in [(c, 1.0, True) for c in hits] + rows:
                if row[0] not in seen:
                    seen.add(row[0])
                    out.append(row)
            return out

        def prefer(rows, hit, order):
            exact = sorted([r for r in rows if hit(r[0])], key=order)
            if not exact:
                return rows
            return exact if a.fee else exact + [r for r in rows if not hit(r[0]) and not f(r[0]).pricing]

        code, title = lambda c, f=f: f(c).code_hit, lambda c, f=f: f(c).title_hit
        coded = sorted((min(x for x in a.codes if x in json.dumps([f(c).doc_title, f(c).heading_path, f(c).chunk_text]).upper().replace("-", "").replace(" ", "")), c) for c in ids if code(c))
        rows = prefer(merge([c for _, c in coded], rows), code, lambda r: 0)
        titled = sorted((c for c in ids if title(c)), key=lambda c: (-f(c).title_length, c)) if not a.package else []
        if titled:
            rows = prefer(merge(titled, rows), title, lambda r: -f(r[0]).title_length)

        def focus_packages(rows):
            kept = [r for r in rows if not (f(r[0]).pricing and not f(r[0]).detail)]
            new = []
            for c, s, x in kept or rows:
                if f(c).detail and (kept or not f(c).pricing):
                    s = up(s, 0.22)
                    if a.documents:
                        s = up(s, 0.18) if f(c).root in config.DOCUMENT_SECTIONS else up(s, -0.12) if f(c).root in ("faq", "faqs") else s
                new.append((c, s, x))
            return sorted(new, key=lambda r: -r[1])

        if a.package:
            rows = focus_packages(rows)
        elif a.fee:
            quiet = [r for r in rows if not f(r[0]).noise]
            rows = sorted(quiet or rows, key=lambda r: (not f(r[0]).pricing, -r[1]))
        rows.sort(key=lambda r: not code(r[0]))
        if a.package:
            rows = focus_packages(rows)
        else:
            if any(title(r[0]) for r in rows):
                rows = [r for r in rows if title(r[0]) or not a.fee]
                rows.sort(key=lambda r: (0, -f(r[0]).title_length) if title(r[0]) else (1, 0))
            if a.wide:
                hit = lambda c, f=f: f(c).section and f(c).country_hit
                new = []
                for c, s, x in rows:
                    if hit(c):
                        s = up(s, 0.18)
                        if "compare" in a.targets and f(c).root == "compare":
                            s = up(s, {0: 0.35, 1: 0.28}.get(f(c).heading_path.count(">"), -0.08))
                    new.append((c, s, x))
                rows = sorted(new, key=lambda r: -r[1]) if any(hit(c) for c, *_ in new) else new
                if a.countries:
                    rows = [r for r in rows if not f(r[0]).section or f(r[0]).country_hit]
        rows = [r for r in rows if r[1] >= config.MIN_SCORE or r[2] or code(r[0]) or title(r[0])]
        if a.package:
            first, rest, seen = [], [], set()
            for r in rows:
                if f(r[0]).detail and f(r[0]).root in config.PACKAGE_SECTIONS:
                    key = f(r[0]).source_url.rstrip("/").lower(), f(r[0]).root
                    if key not in seen:
                        seen.add(key)
                        first.append(r)
                else:
                    rest.append(r)
            rows = (first + rest)[: max(3 * a.max_returned, 24)]
        out, per = [], {}
        for c, s, _ in rows:
            url = f(c).source_url
            safe = not a.package and (code(c) or title(c) or (a.wide and f(c).section and f(c).country_hit))
            if safe or per.get(url, 0) < a.max_per_url:
                per[url] = per.get(url, 0) + 1
                out.append((c, round(s, 6)))
        assert [(c, s) for _, c, s in sorted(got.get(q, []))] == out[: max(a.max_returned, 1)], a.question


def test_filters_and_addresses(spark):
    rows = spark.createDataFrame([("website", "x.org", 1), ("blog", "x.org", 2), ("drive", "example.com", 3), ("drive", "x.org", None)], "source_type string, source_domain string, n int")
    count = lambda c: rows.filter(c).count()
    assert [count(predicates.source_filter(s, F.col("source_type"), F.col("source_domain"))) for s in ("all", "website", "drive", "whatsapp")] == [4, 3, 2, 0]
    with pytest.raises(ValueError):
        predicates.source_filter("nowhere", F.col("source_type"), F.col("source_domain"))
    assert count(predicates.compiled({"source_type": "drive", "n": {"$eq": 3}})) == 1 and count(predicates.compiled({"$or": [{"n": 1}, {"source_type": {"$in": ["blog"]}}]})) == 2 and count(predicates.compiled({})) == 4
    base = "https://A.example.com/x/y.html?q=1#z"
    cases = {"b/../c": "https://A.example.com/x/c", "/q": "https://A.example.com/q", "//h.org/p": "https://h.org/p", "?k=2": "https://A.example.com/x/y.html?k=2", "#t": "https://A.example.com/x/y.html?q=1#t", "mailto:a@b": "mailto:a@b", "../../up": "https://A.example.com/up", "": "https://A.example.com/x/y.html?q=1"}
    got = spark.createDataFrame([(u, base) for u in cases], "u string, b string").select("u", urls.resolved(F.col("u"), F.col("b")).alias("r"), urls.canonicalised(F.col("u"), F.col("b")).alias("c")).collect()
    assert {r.u: r.r for r in got} == cases
    keep = spark.createDataFrame([("HTTP://E.com/services/funds/?Countries=a&x=1&authority=b",)], "u string").select(urls.canonicalised(F.col("u")).alias("c")).first().c
    assert keep == "http://e.com/services/funds/?Countries=a&authority=b"


def test_page_sections_match_a_loop(spark):
    """Sections of real pages against a loop over their blocks."""
    import hashlib
    import re

    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    flat = lambda t: re.sub(r"[ \t\n\r\f\v]+([,.;:!?])", r"\1", re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t.replace("\xa0", " "))).strip(" \t\n\r\f\v"))
    want = set()
    for page, h in html.items():
        path, found, seen = [None] * 3, {}, set()
        for _, kind, t in page_ops.blocks_of(h):
            t = flat(t)
            if len(t.strip()) < config.MIN_BLOCK_CHARS or re.search(config.NOISE_TEXT, t) or (kind, t) in seen:
                continue
            seen.add((kind, t))
            if kind in ("h2", "h3", "h4"):
                n = int(kind[1]) - 2
                path[n:] = [t] + [None] * (2 - n)
            else:
                found.setdefault(tuple(p for p in path if p) or ("Introduction",), []).append(t)
        want |= {(page, i + 1, " > ".join(p), hashlib.sha1("\n\n".join(ts).encode()).hexdigest()) for i, (p, ts) in enumerate(found.items())}
    assert set(map(tuple, page_plans.page_sections(spark, SF).collect())) == want


def test_fetching_tries_again():
    waits, calls = [], []

    class Answer:
        status = 200

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def geturl(self):
            return "https://x.org/final"

        def read(self):
            return b"body"

    def open_(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("lost")
        return Answer()

    assert crawl.get("https://x.org", 3, 0.5, open_, waits.append) == (200, "https://x.org/final", "body") and waits == [0.5, 1.0]
    calls[:] = []
    with pytest.raises(OSError):
        crawl.get("https://x.org", 2, 0.5, open_, waits.append)


def test_scans_of_apis(spark):
    data = list(range(25))
    rows = crawl.api_pages(spark, lambda page: [{"id": i} for i in data[(page - 1) * 10 : page * 10]], "id long", 5)
    assert sorted(r.id for r in crawl.paged(rows, ["id"]).collect()) == data
    chats = spark.createDataFrame([("a",), ("b",)], "chat_id string")
    call = lambda chat, at: [{"id": i, "body": chat} for i in range(at, min(at + 10, 23))] + ([{"id": 0, "body": chat}] if at == 10 else [])
    got = crawl.messages(spark, call, chats, "id long, body string", size=10).collect()
    assert sorted((r.chat_id, r.id) for r in got) == [(c, i) for c in "ab" for i in range(23)]


def test_curated_records(spark):
    bios = spark.createDataFrame([("Ann", "Head", "Leads")], "name string, role string, bio string")
    answers = spark.createDataFrame([("Q?", "A")], "question string, answer string")
    press = spark.createDataFrame([("T", "S")], "title string, summary string")
    assert payloads.records(bios, answers, press, ["Ann"], 1).count() == 3
    for names, n in ((["Bob"], 1), (["Ann"], 2)):
        with pytest.raises(ValueError):
            payloads.records(bios, answers, press, names, n)


def test_texts_of_pages(spark):
    df = spark.createDataFrame([(r'x={\"slug\":\"a\",\"type\":\"t\",\"n\":\"b {c} \"} {"slug":"z"}', "p1\n\np2\n\np3")], "s string, p string")
    r = df.select(sections.embedded_objects(F.col("s")).alias("o"), sections.paragraphs(F.col("p")).alias("g")).first()
    assert [json.loads(x)["slug"] for x in r.o] == ["a"] and r.g == ["p1\n\np2", "p3"]
    html = "<h1> A <b>title</b></h1><meta name='author' content='Ann'><time datetime='2024-05-01'></time><a href='/blog/category/tax'>Tax</a>"
    h = spark.createDataFrame([(html, "https://e.com/p")], "h string, u string")
    got = h.select(sections.page_title(F.col("h")).alias("t"), sections.page_author(F.col("h")).alias("a"), sections.page_date(F.col("h")).alias("d"), sections.page_category(F.col("h"), F.col("u")).alias("c")).first()
    assert (got.t, got.a, got.d, tuple(got.c)) == ("A title", "Ann", "2024-05-01", ("Tax", "https://e.com/blog/category/tax/"))
    study = spark.createDataFrame([(1, 0, "heading", "The task at hand"), (1, 1, "text", "a"), (1, 2, "heading", "The result"), (1, 3, "text", "b"), (2, 0, "text", "x"), (2, 1, "text", "y"), (2, 2, "text", "z")], "key long, pos long, kind string, text string")
    assert sorted((r.key, r.heading, r.text) for r in payloads.case_study_sections(study).collect()) == [(1, "The result", "b"), (1, "The task at hand", "a"), (2, "Part 1", "x\n\ny"), (2, "Part 2", "z")]


def test_comparison_and_episode_states(spark):
    fields = spark.createDataFrame([("A", 1, "VAT Rate", "5"), ("A", 2, "VAT Rate", "6"), ("B", 3, "Zeal", "x|y")], "peer string, pos long, key string, value string")
    assert reports.comparison_markdown(reports.comparison(fields, ["A", "B"]), ["A", "B"]).split("\n")[2:] == ["| VAT Rate | 6 | — |", "| Zeal | — | x|y |"]
    ep = spark.createDataFrame([("c", "e1", "h1"), ("c", "e2", "h2")], "chat_id string, episode_id string, content_sha1 string")
    old = spark.createDataFrame([("c", "e1", "h0"), ("c", "e9", "h9"), ("d", "e8", "h8")], "chat_id string, episode_id string, content_sha1 string")
    assert {r.episode_id: r.status for r in messages.changed(ep, old).collect()} == {"e1": "changed", "e2": "new"}
    assert [r.episode_id for r in messages.orphans(old, ep).collect()] == ["e9"]


def test_functions_without_a_query(spark):
    from quarrylight.functions import text
    from quarrylight.operators import timelines

    one = spark.createDataFrame([("ﬁne № 5", '<script>{"slug":"a","type":"t","title":"A"} {"slug":"a","type":"u"}</script>', None)], "t string, html string, n string").withColumn("url", F.lit("u"))
    r = one.select(text.compatible(F.col("t")).alias("k"), text.string_list(F.col("n"), False).alias("l"), text.run_id(F.lit("2024-05-01 10:20:30").cast("timestamp")).alias("run"), text.date_range(F.lit("2024-05-01").cast("date"), F.lit("2024-05-03").cast("date")).alias("d")).first()
    assert (r.k, r.l, r.run, r.d) == ("fine No 5", [], "20240501T102030Z", "1 May 2024 to 3 May 2024")
    assert [(c.slug, c.title) for c in sections.embedded_catalog(one).collect()] == [("a", "A")]
    first = spark.createDataFrame([(1, 1, "Cards", "x")], "key long, ordinal long, heading_text string, text string")
    then = spark.createDataFrame([(1, 1, "cards ", "y" * 50), (1, 2, "New", "z" * 50), (1, 3, "Short", "z")], "key long, ordinal long, heading_text string, text string")
    assert [(x.ordinal, x.heading_text) for x in sections.assembled("key", first, then).orderBy("ordinal").collect()] == [(1, "Cards"), (2, "New")]
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "b")], "k long, pos long, v string")
    assert [x.f for x in timelines.filled(rows, ["k"], "pos", F.col("v"), "f").orderBy("pos").collect()] == ["a", "a", "b"]
    got = payloads.package_record(spark.createDataFrame([("p", '{"title": "T", "description": "A long introduction"}'), ("q", "{}")], "key string, payload string"), ["introduction", "faqs"])
    assert {x.key: (x.sections_present, x.missing) for x in got.collect()} == {"p": (["introduction"], ["faqs"]), "q": ([], ["introduction", "faqs"])}
    product = payloads.product_sections(spark.createDataFrame([("p", '{"attributes": {"productName": "P", "description": "It is a product", "startingPrice": "7", "currency": "usd"}}')], "key string, payload string"))
    assert [(x.path, x.text) for x in product.orderBy("ordinal").collect()] == [("introduction", "It is a product"), ("pricing", "Package: P\nStarting from: usd 7")]
    card = spark.createDataFrame([("", "Title", None, "s", "1200.0", "aed", 1)], "productName string, title string, name string, slug string, price string, currency string, rank int")
    got = card.select(payloads.listing_card(F.struct("*")).alias("c")).first().c
    assert (got.name, got.slug, got.price, got.tags) == ("Title", "s", "AED 1200", ["Best Seller"])
    ids = spark.createDataFrame([("1",), ("2",), ("1",)], "id string")
    assert [(x.id, x.name) for x in crawl.details(ids, lambda i: {"name": f"n{i}"} if i == "1" else None, "name string").collect()] == [("1", "n1")]
    now = F.lit("2024-05-02").cast("timestamp")
    cache = spark.createDataFrame([("a", "2024-05-01"), ("b", "2024-05-03")], "k string, e string").withColumn("expires_at", F.col("e").cast("timestamp"))
    assert [x.k for x in messages.live(cache, now).collect()] == ["b"]
    flags = spark.createDataFrame([("Sorry, I could not find that", "Get notified soon", "c1", "Root/Fees")], "a string, b string, id string, p string")
    f = flags.select(predicates.refusal(F.col("a")).alias("r"), predicates.notify_form(F.col("b")).alias("n"), predicates.listed(F.col("id"), F.col("p"), ["c1"]).alias("l"), predicates.path_has(F.col("p"), "fees").alias("p"), predicates.long_enough(F.col("a"), 100).alias("s"), predicates.upcoming(F.lit("2030-01-01").cast("date"), F.lit("2024-01-01").cast("date")).alias("u"), predicates.toc_list(F.lit("- Introduction\n- Guide\n- x")).alias("t")).first()
    assert tuple(f) == (True, True, True, True, False, True, True)


def test_events_come_in_order(spark):
    from quarrylight.plans import wording

    rows = {}
    for r in wording.answer_events(spark, SF).collect():
        rows.setdefault(r.query_id, []).append((r.seq, r.type, r.payload))
    for events in rows.values():
        kinds = [k for _, k, _ in sorted(events)]
        assert kinds[0] == "sources" and "done" in kinds[-2:] and set(kinds) <= {"sources", "token", "done", "related"} and (kinds[-1] in ("done", "related"))
