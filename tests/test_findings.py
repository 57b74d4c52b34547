"""What the reviews found: work done once for what is equal, and results that depend on neither sizes nor batches."""

import hashlib
import tracemalloc
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarrylight import engine
from quarrylight.functions import hashes, text
from quarrylight.llm import bpe, html_extract
from quarrylight.operators import retrieval, rows, sections, vectors
from quarrylight.plans import documents, evaluate, focus, records

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_equal_vectors_stand_for_their_ids(spark):
    rng = np.random.default_rng(3)
    kinds = rng.integers(-2, 3, (12, 4)).astype(float).tolist() + [[0.0] * 4, None]
    chunks = spark.createDataFrame([(i, i % 5, kinds[int(k)]) for i, k in enumerate(rng.integers(0, 14, 300))], "vec_id long, label int, embedding array<float>").repartition(7)
    questions = spark.createDataFrame([(i, 0, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(20)], "query_id long, query_label int, query array<float>")
    plain, once = (sorted(map(tuple, f(chunks, questions, 6).collect())) for f in (vectors.top_k, vectors.top_k_of_copies))
    assert plain == once and len(plain) > 100


def test_vectors_of_another_width_change_nothing(spark):
    rows = [(i, 0, [1.0, float(i)]) for i in range(8)]
    questions = spark.createDataFrame([(1, 0, [1.0, 2.0])], "query_id long, query_label int, query array<float>")
    schema = "vec_id long, label int, embedding array<float>"
    found = [vectors.top_k(spark.createDataFrame(x, schema).coalesce(1), questions, 3).collect() for x in (rows, rows + [(9, 0, [1.0, 2.0, 3.0])])]
    assert found[0] == found[1] and found[0][0].vec_id == 2


def test_equal_questions_are_searched_once(spark, monkeypatch):
    searched = []
    monkeypatch.setattr(focus, "top_k_of_copies", lambda made, asked, k: searched.append(asked.count()) or vectors.top_k_of_copies(made, asked, k))
    q = focus.questions_of(spark, SF)
    for query in (focus.score_gate, focus.lexical_merge):
        assert {r.query_id for r in query(spark, SF).select("query_id").collect()} <= {r.query_id for r in q.collect()}
    assert searched == [q.select("question").distinct().count()] * 2 and searched[0] < q.count()


def test_texts_do_not_travel_with_candidates(spark):
    """Facts of texts are made below the join with candidates, whose windows and joins hold no text."""
    assert "chunk_text" not in plan(focus.protected_caps(spark, SF)).split("Join")[0]
    assert "chunk_text" not in plan(focus.lexical_title_join(spark, SF))


def test_lists_of_hits_are_numbered_once(spark):
    for query in (focus.lexical_code_join, focus.lexical_title_join):
        assert "windowspecdefinition(wanted" in plan(query(spark, SF)) and "windowspecdefinition(query_id" not in plan(query(spark, SF))
    index = spark.createDataFrame([("PM1", "b"), ("PM1", "a"), ("PM2", "a"), ("PM2", "c"), ("PM3", "d")], "code string, chunk_id string")
    asked = spark.createDataFrame([(1, ["PM2", "PM1"]), (2, ["PM1", "PM2"]), (3, ["PM2"]), (4, []), (5, ["PM9"])], "query_id long, codes array<string>")
    got = sorted(map(tuple, retrieval.code_ids(asked, index).select("query_id", "pos", "chunk_id").collect()))
    assert got == [(q, p, c) for q in (1, 2) for p, c in ((1, "a"), (2, "b"), (3, "c"))] + [(3, 1, "a"), (3, 2, "c")]


def test_titles_of_hits(spark):
    chunks = spark.createDataFrame([(str(i), "u", "website", "", "", "", f"Title: {t}") for i, t in enumerate(["Annual Licence Renewal Support", "annual licence renewal support", "Licence Renewal Support x", "Nothing of the kind here"])], ", ".join(f"{c} string" for c in retrieval.CHUNK))
    asked = spark.createDataFrame([(1, "ANNUAL licence renewal support x?"), (2, "annual licence renewal support X?"), (3, "annual licence renewal support"), (4, "none")], "query_id long, question string")
    got = sorted((r.query_id, r.pos, r.chunk_id) for r in retrieval.title_hits(asked, chunks).collect())
    assert got == [(q, p, c) for q in (1, 2) for p, c in ((1, "0"), (2, "1"), (3, "2"))] + [(3, 1, "0"), (3, 2, "1")]


def test_one_list_is_dealt_to_many_tasks(spark, monkeypatch):
    """Hits of one list go to tasks in even parts, however many questions want it, and whether or not those are broadcast."""
    found = spark.range(6_400).select(F.array(F.lit("x")).alias("wanted"), F.col("id").cast("string").alias("chunk_id"))
    hits = rows.numbered(found, "pos", ["wanted"], "chunk_id")
    asking = spark.range(2_100).select(F.when(F.col("id") > 0, F.col("id")).alias("query_id"), F.array(F.when(F.col("id") < 2_090, "x").otherwise("y")).alias("wanted"))
    dealt = retrieval.to_questions(hits, asking)
    tasks = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 6_400 * 2_090 and max(tasks) < sum(tasks) / 20
    monkeypatch.setattr(rows, "broadcast_if_small", lambda df: df)
    shuffled = retrieval.to_questions(hits, asking)
    said = [df.agg(F.count("*"), F.count("query_id"), F.sum(F.xxhash64("query_id", "chunk_id", "pos").cast("decimal(38,0)"))).first() for df in (dealt, shuffled)]
    plain = hits.join(asking, "wanted").agg(F.count("*"), F.count("query_id"), F.sum(F.xxhash64("query_id", "chunk_id", "pos").cast("decimal(38,0)"))).first()
    assert said == [plain, plain]


def test_texts_of_answers_are_normalised_once_a_row(spark):
    said = plan(evaluate.eval_verdicts(spark, SF))
    assert said.count("[a-z0-9%]+") == 3  # the answer, a phrase and a country
    got = spark.sql("SELECT ' The  GOLD-visa, 5%. É x' AS t UNION ALL SELECT NULL UNION ALL SELECT ' -- '").select(text.matchable(F.col("t"))).collect()
    assert [r[0] for r in got] == ["the gold visa 5% x", "", ""]


def test_first_match_takes_the_first_in_the_file(spark, tmp_path):
    """Lines of one number in an order: the first row of the file wins, however the file is dealt to tasks."""
    spark.createDataFrame([(7,)], "o_orderkey int").write.parquet(f"{tmp_path}/orders.parquet")
    rows = spark.range(60_000).select(F.lit(7).alias("l_orderkey"), F.col("id").alias("l_partkey"), (F.lit(2) - (F.col("id") > 40_000).cast("int")).alias("l_linenumber"))
    rows.coalesce(1).write.option("parquet.block.size", 64 << 10).option("parquet.page.row.count.limit", 500).parquet(f"{tmp_path}/lineitem.parquet")
    assert all(f"{n}#" in plan(records.first_lookup(spark, str(tmp_path))) for n in ("file", "row"))
    assert records.first_lookup(spark, str(tmp_path)).first()["part"] == 40_001


def test_first_match_passes_over_rows_without_a_part_or_a_number(spark, tmp_path):
    spark.range(1, 6).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, None, 1), (1, 5, 2), (2, 7, None), (2, 8, 9), (3, None, None), (4, 3, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = sorted((r.id, r.detail, r.part) for r in records.first_lookup(spark, str(tmp_path)).collect())
    assert found == sorted(con.execute(records.ORACLES["first_lookup"]).fetchall()) and [r[2] for r in found] == [5, 8, None, None, None]


def test_token_windows_hold_one_text_at_a_time(spark):
    texts = pa.array(["word and more " * 400, None, "", "é€ " * 900] * 150)
    cut = sections.bpe_windows(spark, f"{documents.TOKENIZERS}/byte_bpe_50k.json").func
    cut(texts[:4])
    tracemalloc.start()
    found = cut(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(texts) and found[0].as_py()[1]["start"] > 0 and len(found[1]) == 1
    assert peak < 3.5 * texts.nbytes, (peak, texts.nbytes)


def test_a_search_holds_few_scores_at_once():
    rng = np.random.default_rng(5)
    block = SimpleNamespace(value=(np.arange(2_048), np.zeros(2_048, np.int64), vectors.unit_rows(pa.array(list(rng.normal(size=(2_048, 64)))))[0]))
    batch = pa.record_batch([pa.array(np.arange(4_096)), pa.array(np.zeros(4_096, np.int64)), pa.array(list(rng.normal(size=(4_096, 64)).astype(np.float32)))], ["vec_id", "label", "embedding"])
    tracemalloc.start()
    (found,) = vectors._nearest(block, 20, None)([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows >= 20 * 2_048 and peak < 64 << 20, peak


def test_words_of_many_texts_are_hashed_at_a_time():
    texts = ["", " \n", "x" * 15 + " " + "x" * 16 + "\ty", "\x00a a\x00 a", "É" * 7 + "  Ü " + "b" * 300, *(("w%d " % i) * (i % 5) + "z" * (i % 40) for i in range(3_000))]
    row, found = hashes.word_hashes([engine.lowered(t) for t in texts])
    words = [(i, w) for i, t in enumerate(texts) for w in t.lower().encode().split()]
    assert row.tolist() == [i for i, _ in words]
    assert found.tolist() == [int.from_bytes(hashlib.md5(w).digest()[:4], "big") for _, w in words]


def test_the_whole_pipeline_reads_texts_once(spark, monkeypatch):
    """What steps after the search read is a table without whole texts."""
    seen = []
    whole = retrieval.retrieve
    monkeypatch.setattr(retrieval, "retrieve", lambda q, near, chunks: seen.append(chunks) or whole(q, near, chunks))
    assert focus.retrieve_questions(spark, SF).count() > 0
    assert "documents.parquet" not in plan(seen[0]) and not any("documents.parquet" in f for f in seen[0].inputFiles())
    assert seen[0].agg(F.max(F.length("chunk_text"))).first()[0] <= 120


def test_merges_by_any_number_of_ranks():
    rng = np.random.default_rng(11)
    ranks = {bytes([b]): b for b in range(256)}
    at = 300
    while at < 400_000:  # more ranks than three levels of 64 held
        known = list(ranks)
        ranks.setdefault(known[int(rng.choice([97, 98, 99, *range(256, len(known))]))] + known[97 + int(rng.integers(3))], at)
        at += int(rng.integers(1, 2_000))
    coder = bpe.Bpe(ranks, r"\S+")

    def plain(piece: bytes) -> list[int]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    for n in (1, 2, 3, 10, 40, 300):
        for _ in range(20):
            piece = bytes(rng.integers(97, 100, n).astype(np.uint8))
            assert coder.merge(piece) == plain(piece) and coder.decode(coder.merge(piece)) == piece
    assert not coder.buckets and not any(coder.leaves)


def test_large_trees_are_aligned_like_small_ones():
    rng = np.random.default_rng(2)

    def tree(n):
        top = html_extract.Node("ul")
        for _ in range(n):
            item = html_extract.Node("li", f"li.{rng.integers(3)}")
            item.children = [html_extract.Leaf(f"t{rng.integers(40)}", 0.0, False, False) for _ in range(rng.integers(1, 3))]
            item.size += len(item.children)
            top.children.append(item)
            top.size += item.size
        return top

    def best(a, b):
        if isinstance(a, html_extract.Leaf):
            return 1 + (a.text == b.text)
        if a.label != b.label:
            return 0
        row = [0] * (len(b.children) + 1)
        for x in a.children:
            above, row = row, [0]
            for j, y in enumerate(b.children):
                row.append(max(row[j], above[j + 1], above[j] + best(x, y)))
        return 1 + row[-1]

    a, b = tree(150), tree(170)
    assert a.size * b.size > 40_000  # beyond which siblings were matched by runs of labels
    size, pairs = html_extract.align(a, b)
    assert size == best(a, b) > html_extract.in_order(a, b)[0]
    items = {id(leaf): i for t in (a, b) for i, item in enumerate(t.children) for leaf in item.children}
    places = [(items[id(x)], items[id(y)]) for x, y in pairs]
    assert places == sorted(places) and len(pairs) > 100
    deep = ["<div>" * 400 + f"{said} <p>end</p>" for said in ("one", "two")]
    assert [x["slot"] for x in html_extract.page_blocks(*deep)] == [0, 1]
