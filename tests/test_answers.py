"""Search by words in blocks, fused lists, catalog answers and the engine's four routes."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight import config, engine
from quarrylight.operators import catalogs, lexical, rows

# BM25 in blocks


def plain_bm25(docs, questions, k, k1=1.5, b=0.75):
    held = {i: collections.Counter(re.findall("[a-z]{3,}", (t or "").lower())) for i, t in docs}
    n, mean = len(held), sum(sum(c.values()) for c in held.values()) / max(len(held), 1)
    df = collections.Counter(w for c in held.values() for w in c)
    out = []
    for q, said in questions:
        asked = set(re.findall("[a-z]{3,}", (said or "").lower()))
        scores = {}
        for i, c in held.items():
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * sum(c.values()) / mean)) for w in asked if c[w])
            if round(s, 6) > 0:
                scores[i] = round(s, 6)
        out += [(q, i, s, r + 1) for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return out


@pytest.mark.parametrize("k", [1, 5, 40])
def test_blocks_give_what_all_documents_give(spark, monkeypatch, k):
    rng = np.random.default_rng(k)
    words = ["".join(rng.choice(list("abcde"), 3)) for _ in range(60)]
    share = 1 / np.arange(1, 61)
    docs = [(i, None if i % 50 == 7 else " ".join(rng.choice(words, rng.integers(0, 30), p=share / share.sum()))) for i in range(700)]
    docs += [(1_000 + i, docs[3][1]) for i in range(30)]
    questions = [(i, " ".join(rng.choice(words, 3))) for i in range(25)] + [(90, None), (91, ""), (92, "zzzz")]
    monkeypatch.setattr(lexical, "SHARD_DOCS", 150)
    monkeypatch.setattr(lexical, "BLOCK", 8)
    monkeypatch.setattr(lexical, "GROUP", 9)
    made = lexical.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = [tuple(r) for r in lexical.top_k(made, spark.createDataFrame(questions, "query_id long, query string"), k).select("query_id", "doc_id", "score", "rank").collect()]
    wanted = plain_bm25(docs, questions, k)
    assert [(q, i, r) for q, i, _, r in sorted(got)] == [(q, i, r) for q, i, _, r in sorted(wanted)]
    assert np.allclose([s for *_, s, _ in sorted(got)], [s for *_, s, _ in sorted(wanted)], atol=2e-6)


def test_blocks_out_of_reach_are_not_read():
    shard = lexical.Gathered()
    for i in range(640):
        shard.add(i, ["rare"] * (9 if i == 5 else 1) + ["pad"] * (1 if i < 64 else 50))
    row = shard.closed(50.0, 1.5, 0.75)
    made = lexical.Shard(*(row.column(row.schema.get_field_index(c))[0].values.to_numpy() for c in lexical.COLUMNS))
    best = lexical.Best(3)
    read = made.best([(0, 1.0)], best)
    assert best.ids.tolist() == [5, 0, 1] and read == 4 < made.n_blocks


def test_no_documents_or_questions(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "words")], "query_id long, query string")
    assert lexical.top_k(lexical.index(docs), asked, 5).count() == 1
    assert lexical.top_k(lexical.index(docs), asked.limit(0), 5).count() == 0
    assert lexical.top_k(lexical.index(docs.limit(0)), asked, 5).count() == 0


def test_fusion(spark):
    lists = lambda data: spark.createDataFrame(data, "query_id long, doc_id long, rank int")
    got = lexical.fused([(lists([(1, 7, 1), (1, 8, 2)]), 0.4), (lists([(1, 8, 1), (1, 9, 2), (2, 3, 1)]), 0.6)], 2).collect()
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in got) == [(1, 8, 1), (1, 9, 2), (2, 3, 1)]
    assert {r.doc_id: r.score for r in got}[8] == round(0.4 / 62 + 0.6 / 61, 9)


# catalogs


def known(spark):
    item = "array<struct<name:string,price:double,currency:string>>"
    countries = [
        ("Cayman Island", "cym", "cayman-islands", "https://www.example.com/c/cym", [], []),
        ("British Virgin Islands", "vg", "british-virgin-islands", "", [("Fund A", 5.0, "usd"), ("Fund B", None, None)], []),
        ("UAE", "ae", "uae", "https://www.example.com/c/ae", [("F", 1.0, "aed")], [(f"Licence {i}", float(i), "aed") for i in range(15)]),
        ("Ireland", "ie", "Ireland", "https://www.example.com/c/ie", [], [("Only one", 2.5, "eur")]),
    ]
    peer = lambda page, pos, slug, name, code, fields: (page, pos, slug, name, code, fields)
    cayman = [("Setup Timeline", "2–5 days"), ("Zoning", "a < b"), ("Banking", ""), ("Banking", "hard"), ("Banking", "Moderate")]
    compared = [
        peer("cayman-islands", 0, "cayman-islands", "Cayman Island", "cym", cayman),
        peer("cayman-islands", 1, None, "British Virgin Islands", None, [("Setup Timeline", "1–3 days")]),
        peer("cayman-islands", 2, None, None, "AE", [("Tax Incentives", "Free zone benefits")]),
        peer("uae", 0, "UAE", "UAE", "ae", [("Tax Incentives", "of its own page"), ("Visa Application", "Linked")]),
        peer("uae", 1, "nowhere", "Atlantis", "xx", [("Banking", "wet")]),
    ]
    services = [("Visa Services", "https://www.example.com/s/visa", [("Gold",), (" ",), ("Silver",)]), ("Attestation", "", [(f"P{i}",) for i in range(50)])]
    return catalogs.Catalogs(
        spark.createDataFrame(countries, f"name string, shortcode string, slug string, source_url string, funds {item}, packages {item}"),
        spark.createDataFrame(services, "name string, source_url string, packages array<struct<name:string>>"),
        spark.createDataFrame(compared, "page string, pos int, slug string, name string, shortcode string, fields array<struct<key:string,value:string>>"),
    )


QUESTIONS = [
    (1, "Compare Cayman Island with British Virgin Islands & UAE"),
    (2, "compare Ireland and BVI"),
    (3, "how many packages in UAE"),
    (4, "list all packages in the UAE"),
    (5, "How many funds are in the BVI?"),
    (6, "how many packages for visa"),
    (7, "how many packages are under attestation"),
    (8, "what is a visa"),
    (9, None),
    (10, "compare UAE with Atlantis, how many packages there in UAE"),
    (11, "how many licences in Luxembourg"),
    (12, "ksa vs uae vs bvi"),
]


@pytest.fixture(scope="module")
def answered(spark):
    asked = spark.createDataFrame(QUESTIONS, "query_id long, question string")
    return {r.query_id: r for r in catalogs.answers(asked, known(spark)).collect()}


def test_routes(answered):
    assert {q: r.route for q, r in answered.items()} == {1: "compare", 3: "location_count", 4: "location_count", 5: "location_count", 6: "service_count", 7: "service_count", 10: "location_count"}
    # no page says anything of Ireland, and neither of those of 12 has a row about the British Virgin Islands


def test_comparison_has_every_row(answered):
    r = answered[1]
    assert [s.doc_title for s in r.sources] == ["Cayman Island", "UAE", "British Virgin Islands"]
    table = re.findall(r'<tr><th scope="row">(.*?)</th>(.*?)</tr>', r.answer)
    assert [(k, re.findall("<td>(.*?)</td>", cells)) for k, cells in table] == [
        ("Setup Timeline", ["2–5 days", "—", "1–3 days"]),
        ("Visa Application", ["—", "Linked", "—"]),
        ("Tax Incentives", ["—", "of its own page", "—"]),
        ("Banking", ["Moderate", "—", "—"]),
        ("Zoning", ["a &lt; b", "—", "—"]),
    ]
    assert "compare-table" in r.answer and r.answer.count("<li>") == 2
    assert r.sources[0].chunk_text == "Comparison peer: Cayman Island\nSetup Timeline: 2–5 days\nBanking: Moderate\nZoning: a < b" and [s.score for s in r.sources] == [0.99, 0.98, 0.97]


def test_counts(answered):
    assert answered[3].answer.startswith("UAE has 15 packages:\n1. Licence 0") and answered[3].answer.endswith("and 7 more")
    assert answered[4].answer.count("Licence") == 15
    assert answered[5].answer == "British Virgin Islands has 2 funds:\n1. Fund A (from USD 5)\n2. Fund B" and answered[5].sources[0].source_url == "catalog://British Virgin Islands"
    assert answered[6].answer == "Visa Services has 2 packages: Gold; Silver" and answered[6].sources[0].chunk_text.endswith("Gold\nSilver")
    assert answered[7].answer.endswith("and 42 more")


def test_names_in_groups(spark, monkeypatch):
    monkeypatch.setattr(catalogs, "NAMES_BYTES", 150)
    names = spark.createDataFrame([(n,) for n in ("UAE", "uae", "Nation 1", "Nation 12", " ", None, "é É", "b")], "name string")
    texts = spark.createDataFrame([(1, "the uae and nation 12"), (2, None), (3, "É é É"), (4, "")], "query_id long, question string")
    got = sorted(tuple(r) for r in catalogs.names_in(texts, names).collect())
    assert got == [(1, "Nation 1"), (1, "Nation 12"), (1, "UAE"), (1, "uae"), (3, "é É")]
    assert catalogs.names_in(texts, names.limit(0)).count() == 0


# the engine


@pytest.fixture(scope="module")
def asking(spark, tmp_path_factory):
    store = engine.VectorStore(spark, str(tmp_path_factory.mktemp("answers")), 64)
    said = [("a", "website", "The golden visa needs a passport"), ("b", "website", "A silver visa needs a photo"), ("c", "drive", "A golden handshake in a file"), ("d", "whatsapp", "golden message of a chat")]
    chunks = spark.createDataFrame([(i, f"https://www.example.com/{i}", kind, "example.com" if kind == "website" else "", "page", f"Title {i}", "Part", t, "x") for i, kind, t in said], "chunk_id string, source_url string, source_type string, source_domain string, page_kind string, doc_title string, heading_path string, chunk_text string, content_sha1 string")
    store.upsert_chunks(engine.HashedBag(64).embed_texts(chunks, "chunk_text"))
    return engine.QueryEngine(spark, store, engine.HashedBag(64), least=0.05, known=known(spark))


def test_all_four_routes(spark, asking):
    asked = spark.createDataFrame([(*q, "all", "") for q in QUESTIONS] + [(20, "golden visa passport", "all", "")], "query_id long, question string, source string, prior string")
    got = {r.query_id: r for r in asking.answers(asked).collect()}
    assert len(got) == len(QUESTIONS) + 1
    assert (got[1].route, got[3].route, got[6].route, got[20].route) == ("compare", "location_count", "service_count", "retrieve")
    assert "<table" in got[1].answer and "[Source 1]" in got[20].answer and got[20].sources[0].chunk_id == "a"
    assert asking.ask("how many packages for visa")["answer"] == "Visa Services has 2 packages: Gold; Silver"


def test_each_question_searches_its_own_source(spark, asking):
    asked = spark.createDataFrame([(i, "golden passport photo", s, "") for i, s in enumerate(config.SOURCES)], "query_id long, question string, source string, prior string")
    found = collections.defaultdict(set)
    for r in asking.retrieve(asked).collect():
        found[r.query_id].add(r.source_type)
    assert found == {0: {"website", "drive", "whatsapp"}, 1: {"website"}, 2: {"drive"}, 3: {"whatsapp"}}


def test_prompts_hold_history_and_streams_give_the_answer(asking):
    class Model(engine.Extractive):
        asked = []

        def generate_stream(self, prompt, sources):
            self.asked.append(prompt)
            yield from super().generate_stream(prompt, sources)

    model = Model()
    qe = engine.QueryEngine(asking.spark, asking.store, asking.embedder, model, 0.05, asking.known)
    history = [{"role": "user", "content": "tell me of visas"}, {"role": "assistant", "content": "which?"}, {"role": "tool", "content": "no"}]
    for question in ("golden visa passport", "how many packages for visa"):
        events = list(qe.ask_stream(question, history=history))
        tokens = [e["payload"] for e in events if e["type"] == "token"]
        assert "".join(tokens) == qe.ask(question, history=history)["answer"] and len(tokens) > 3
        assert [e["type"] for e in events][0] == "sources" and events[0]["payload"]
    assert len(model.asked) == 1 and model.asked[0].startswith("User: tell me of visas\nAssistant: which?\n\n[Source 1] Title a — Part\n") and model.asked[0].endswith("Question: golden visa passport")


def test_hybrid_fuses_both_lists(spark, asking):
    q = asking.embedder.embed_texts(spark.createDataFrame([("x", "silver photo"), ("y", "golden")], "query_id string, question string"), "question").withColumnRenamed("embedding", "query")
    got = {(r.query_id, r["rank"]): r.chunk_id for r in asking.store.hybrid(q, 3).collect()}
    assert got["x", 1] == "b" and {got["y", i] for i in (1, 2, 3)} == {"a", "c", "d"}


def test_stored_tables_cut_lineage(spark):
    df = rows.stored(spark.range(5).withColumn("r", F.rand()))
    assert df.collect() == df.collect()
