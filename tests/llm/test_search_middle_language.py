"""Ranked search, fill-in-the-middle and language ID against plain versions, on test tables and on odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import fill_middle, language_id, lexical_search, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n .,;"),
    (None, "a cat without a number"),
    (5, "cat " * 30_000),
    (6, "x" * 100_000),
    (7, "the cat sat"),
    (7, "the cat sat"),
    (8, "The CAT, sat; ÉCOLE Straße 猫が"),
    (9, "cat sat the"),
    (10, "<P> the cat sat <S>"),
    (11, "12 34 \x0b\x85  cat\x00sat"),
    (12, "İstanbul ﬁne K"),
    (-5, "sat the cat"),
]
CLASHING = "text_ h1 h2 form n item rank terms vector held_out score label lang_pred output ids bounds".split()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "en") for r in ODD], "doc_id long, text string, lang string").repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


# Ranked search


def plain_search(docs, questions, k):
    """Every document scored for every question, by the formula."""
    held = [(i, TERM.findall((t or "").translate(LOW))) for i, t in docs]
    held = [(i, collections.Counter(w), len(w)) for i, w in held if w]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = collections.Counter(w for _, tf, _ in held for w in tf)
    out = []
    for item, said in questions:
        asked = {w for w in TERM.findall((said or "").translate(LOW)) if w in df}
        scores = []
        for i, tf, n in held:
            m = 100 - 50 + 50 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 20 * m)) for w in asked if w in tf)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if absent else i, -s) for r, (s, absent, i) in enumerate(sorted(scores)[:k])]
    return out


def searched(docs, questions, k, **options):
    index = lexical_search.build(docs)
    rows = [(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical_search.search(index, questions, k, **options).collect()]
    index.close()
    return rows


QUESTIONS = [(1, "the cat"), (2, None), (3, "..."), (4, "école STRASSE straße"), (5, "no such thing"), (6, "cat cat CAT"), (7, "猫が x"), (8, "cat sat 12")]
by_all = lambda rows: sorted(rows, key=repr)


@pytest.mark.parametrize("k", [1, 2, 3, 50])
def test_search_of_odd_rows(spark, odd, none, k):
    questions = spark.createDataFrame([(*q, "x") for q in QUESTIONS], "item_id long, text string, score string")
    wanted = by_all(plain_search(ODD, QUESTIONS, k))
    assert by_all(searched(odd, questions, k)) == wanted
    assert by_all(searched(clashing(odd), questions, k)) == wanted
    assert searched(none, questions, k) == [] and searched(odd, questions.limit(0), k) == []


def test_search_in_small_shards_and_blocks(spark, monkeypatch):
    """Ties across shards, tasks and blocks of questions; repeated and null item ids are questions of their own."""
    rng = np.random.default_rng(3)
    docs = [(int(i), " ".join(rng.choice(["a", "b", "c", "d", "e", "É"], rng.integers(0, 6)))) for i in rng.permutation(400)]
    questions = [(i % 20, " ".join(rng.choice(["a", "b", "c", "É", "z"], 3))) for i in range(60)] + [(None, "a b"), (None, "c")]
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 7)
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 13)
    made = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(questions, "item_id long, text string")
    assert by_all(searched(made, asked, 10)) == by_all(plain_search(docs, questions, 10))


def test_ties_are_cut_by_id():
    best = lexical_search.Winners(3)
    best.add(np.array([5, 7, 5, 5, 0]), np.array([10, 20, 30, 40, 50]), np.zeros(5, bool))
    assert best.ids.tolist() == [20, 10, 30]
    best.add(np.array([5, 5, 9]), np.array([1, 99, 100]), np.zeros(3, bool))
    assert best.ids.tolist() == [100, 20, 1] and best.scores.tolist() == [9, 7, 5]


def test_wide_counts_do_not_overflow():
    shard = lexical_search.Shard()
    shard.add(1, [b"a"] * 100_000)
    row = shard.closed(10**11, 10**13)
    m = 50 + 50 * 100_000 * 10**11 // 10**13
    assert row["impacts"][0].as_py() == [10**9 * 100_000 // (1000 * 100_000 + 20 * m)]


# Fill-in-the-middle


def plain_middle(doc_id, text, seed=1):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in fill_middle.MARKS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (tokens[:one], tokens[one:two], tokens[two:]))
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_of_odd_rows(spark, odd, none):
    wanted = by_all([(i, *plain_middle(i, t), t or "") for i, t in ODD])
    for docs in (odd, clashing(odd)):
        rows = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored())
        assert by_all([tuple(r) for r in rows.collect()]) == wanted
    assert fill_middle.fill_in_middle(none).count() == 0


def test_middle_with_broken_marks(spark):
    """Texts whose parts end or begin with pieces of marks are rebuilt exactly."""
    rng = np.random.default_rng(5)
    pieces = ["<", "<P", "<S", "<M", "P>", "S>", ">", "M>", "ab", "é", "😀", "\n"]
    docs = [(i, "".join(rng.choice(pieces, rng.integers(0, 12)))) for i in range(2_000)]
    rows = fill_middle.fill_in_middle(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("back", fill_middle.restored())
    assert by_all([tuple(r) for r in rows.collect()]) == by_all([(i, *plain_middle(i, t), t) for i, t in docs])


def test_middle_in_small_chunks(spark, monkeypatch):
    docs = [(i, t) for i, t in enumerate([t for _, t in ODD] * 3)]
    monkeypatch.setattr(fill_middle.chunks, "__defaults__", (40,))
    rows = fill_middle.fill_in_middle(spark.createDataFrame(docs, "doc_id long, text string"), seed=9)
    assert by_all([tuple(r) for r in rows.collect()]) == by_all([(i, *plain_middle(i, t, 9)) for i, t in docs])


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "bc", "x"), ("aa", "b", "c"), ("<<P>>", "P", "M")])
def test_marks_that_two_readings_share_are_refused(marks):
    with pytest.raises(ValueError):
        fill_middle.check_marks(marks)


@pytest.mark.parametrize("density", [0.0, 0.01, 0.5, 1.0])
def test_rank_and_select(density):
    rng = np.random.default_rng(7)
    for size in (0, 1, 63, 64, 65, 511, 512, 513, 5_000):
        flags = rng.random(size) < density
        bits = fill_middle.Bits(flags)
        at = np.arange(size + 1)
        assert bits.total == flags.sum()
        assert (bits.rank(at) == np.concatenate(([0], np.cumsum(flags)))).all()
        ones = np.flatnonzero(flags)
        assert bits.select(np.arange(bits.total + 2)).tolist() == [*ones.tolist(), size, size]


# Language ID


def plain_grams(text):
    """Counts of three letters of the lower-cased text, anything between letters being one space."""
    low = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    low = re.sub(" +", " ", low)
    return collections.Counter(low[i : i + 3] for i in range(len(low) - 2))


def plain_vector(text, dim):
    out = np.zeros(dim)
    draw = lambda c: np.random.default_rng([language_id.SEED, ord(c)]).integers(0, 2, dim, np.int8) * 2.0 - 1
    for g, n in plain_grams(text).items():
        a, b, c = map(draw, g)
        out += n * np.roll(a, 2) * np.roll(b, 1) * c
    return out


def test_vectors_match_a_plain_version():
    texts = [t or "" for _, t in ODD if len(t or "") < 1_000] + ["", "a", "Zwölf Boxkämpfer jagen Viktor", "ab ab ab " * 50]
    found = language_id.Space(256).bundled(texts)
    for text, vector in zip(texts, found, strict=True):
        assert vector.tolist() == plain_vector(text, 256).tolist()
    summed = language_id.Space(256).bundled(texts, np.arange(len(texts)) % 2)
    assert summed.tolist() == [found[k::2].sum(axis=0).tolist() for k in (0, 1)]


def test_profiles_and_predictions_match_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    local = docs.collect()
    side = lambda r: zlib.crc32(str(r.doc_id).encode()) % 3
    vectors = {r.doc_id: language_id.Space(language_id.DIM).bundled([r.text or ""])[0] for r in local}
    sums = collections.defaultdict(lambda: np.zeros(language_id.DIM))
    for r in local:
        if side(r) != 1 and r.lang and r.text:
            sums[r.lang] += vectors[r.doc_id]
    for r in queries.op13_language_id(spark, SF).collect():
        v = vectors[r.doc_id]
        cosines = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in sums.items()} if v.any() else {}
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if cosines:
            assert r.lang_pred == max(sorted(cosines), key=lambda k: round(cosines[k], 9))
            assert r.score == pytest.approx(max(0, max(cosines.values())), abs=1e-8)


def test_languages_of_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in queries.op13_language_id(spark, sf).collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)


def test_language_of_odd_rows(spark, odd, none):
    taught = spark.createDataFrame([(i, "the cat sat on the mat and then", "en") for i in range(9)] + [(9 + i, "die Katze saß auf der Matte und dann", "de") for i in range(9)] + [(3, None, "fr"), (4, "le chat", None), (5, "123", "xx")], "doc_id long, text string, lang string")
    profiles = language_id.fit(taught)
    assert profiles.languages == ["de", "en"]
    for docs in (odd, clashing(odd)):
        rows = language_id.identify(docs, profiles).collect()
        assert sorted((-9 if r.doc_id is None else r.doc_id) for r in rows) == sorted((-9 if i is None else i) for i, _ in ODD)
        got = {r.doc_id: (r.lang_pred, r.score) for r in rows}
        assert all(got[i] == ("und", 0) for i in (1, 2, 3)) and got[7][0] == "en" and 0 < got[7][1] <= 1
        assert all(0 <= s <= 1 and name in ("en", "de", "und") for name, s in got.values())
    nothing = language_id.fit(none)
    assert language_id.identify(none, profiles).count() == 0
    assert {(r.lang_pred, r.score) for r in language_id.identify(odd, nothing).collect()} == {("und", 0.0)}


def test_equal_profiles_go_by_name():
    vectors = np.ones((2, language_id.DIM))
    names, scores = language_id.Profiles(["aa", "bb"], vectors, (language_id.DIM, 3, 1)).predict(["some text", None, "5"])
    assert names[0] == "aa" and names[1:] == ["und", "und"] and scores[1:].tolist() == [0, 0]
