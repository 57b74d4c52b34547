"""Chunks by tokens: windows over ids against a loop, and what ingest makes of them."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quarrylight import engine, jobs
from quarrylight.operators import sections
from quarrylight.plans import documents

SF = "/root/testdata/sf0.001"
FILE = f"{documents.TOKENIZERS}/byte_bpe_50k.json"
tokenizers = pytest.importorskip("tokenizers")


def plain(encoder, said, most, overlap):
    """Windows one after another over the ids; decoded where that gives whole characters."""
    found = encoder.encode(said, add_special_tokens=False)
    if len(found.ids) <= most:
        return [(said, len(found.ids), said)]
    out, start = [], 0
    while True:
        end = min(start + most, len(found.ids))
        piece = said[found.offsets[start][0] : found.offsets[end - 1][1]].strip()
        if piece:
            out.append((piece, end - start, encoder.decode(found.ids[start:end], skip_special_tokens=False).strip()))
        if end == len(found.ids):
            return out
        start = max(end - overlap, start + 1)


@pytest.fixture(scope="module")
def encoder():
    made = tokenizers.Tokenizer.from_file(FILE)
    made.encode_special_tokens = True
    return made


@pytest.mark.parametrize("most,overlap", [(7, 3), (1, 0), (5, 9), (400, 80)])
def test_windows_match_a_loop(spark, encoder, most, overlap):
    texts = ["", " ", "word", "one two three four five six seven eight nine ten", "日本語のテキスト 🦜🦜🦜 é" * 4, "   \n\n   " * 9, "<|endoftext|> is text here " * 3]
    texts += [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()] if most == 400 else []
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = {r.i: r.w for r in df.select("i", sections.bpe_windows(spark, FILE, most, overlap)(F.col("t")).alias("w")).collect()}
    for i, said in enumerate([*texts, ""]):
        wanted = plain(encoder, said, most, overlap)
        assert [(w.text, w.tokens) for w in got[i]] == [x[:2] for x in wanted], said
        assert all(said[w.start : w.end] == w.text for w in got[i])
        assert all(w.text == whole for w, (_, _, whole) in zip(got[i], wanted, strict=True) if "�" not in whole)


def test_the_query_matches_a_loop(spark, encoder):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {}
    for r in documents.bpe_chunks(spark, SF).collect():
        got.setdefault(r.doc_id, {})[r.chunk_index] = (r.tokens, r.sha)
    for i, said in texts.items():
        wanted = [(n, hashlib.sha1(piece.encode()).hexdigest()) for piece, n, _ in plain(encoder, said, 400, 80)]
        assert [got[i][k] for k in sorted(got[i])] == wanted


def test_ingest_by_tokens_and_normal_forms(spark, tmp_path):
    store = engine.VectorStore(spark, str(tmp_path / "c"), 16)
    ingest = jobs.Ingest(spark, store, engine.HashedBag(16), str(tmp_path / "s"), FILE)
    html = "<article><h2>The ﬁrst heading of a page</h2><p>" + "internationalisation " * 300 + "costs １００ ﬁxed ﬀees …</p></article>"
    assert ingest.pages(spark.createDataFrame([("https://www.example.com/blog/a", html)], "url string, html string"), "blog")["chunks"] == 2
    rows = sorted((r.chunk_text, r.heading_path) for r in store.rows().collect())
    assert any("costs 100 fixed ffees..." in t for t, _ in rows) and all("The first heading" in h for _, h in rows)
