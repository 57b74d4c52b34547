import collections
import hashlib
import math
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import oracle
from quarrylight.llm import bpe, chat_format, exact_dedup, html_extract, lm_score, near_dedup, packing, pii, quality_rules, queries, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, kept string, n_words string, spans string"
#: Nulls, empty and blank texts, a very long word and text, repeated rows, ties, clashing columns.
#: Runs that make Java recurse, where a pattern lets it, or take time with the square of their length.
LONG_RUNS = ["7" * 100_000, "a@b" + ".c" * 20_000, "/ " * 50_000 + "a", "1." * 30_000, "+1 " + "(" * 50_000, "| " * 20_000]
ODD = [
    (1, None, "x", "y", "z"),
    (2, "", "x", "y", "z"),
    (3, " \t\n ", None, None, None),
    (None, "no id here but words", "x", "y", "z"),
    (5, "a" * 50_000, "x", "y", "z"),
    (6, "The cat sat on the mat. " * 4_000, "x", "y", "z"),
    (7, "same text  here", "x", "y", "z"),
    (7, "same text  here", "x", "y", "z"),
    (8, "same text here", "x", "y", "z"),
    *((20 + i, t, "x", "y", "z") for i, t in enumerate(LONG_RUNS)),
]
#: Names that operators use inside, in other letters too.
CLASHING = "facts text_ TID_ spans_ terms_ gone_ all_ rid rid_ digest id comp bands held_out score n component_id keep_id __text __rid __facts words label host h"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_oracle(spark, name):
    assert oracle.compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], SF) is None


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.select("doc_id", "text", *[F.lit("x").alias(c) for c in CLASHING.split()])


def operators():
    ranks = f"{queries.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
    machine = toxicity.train([], np.empty(0))
    return {
        "lm": (lm_score.score, lambda r: (r.n_tokens, r.n_known), lambda t: (len(t.split()) + 1,)),
        "quality": (quality_rules.quality_rules, lambda r: (r.n_words, r.word_chars), lambda t: (len(t.split()), sum(map(len, t.split())))),
        "pii": (pii.sanitise, lambda r: ([(s.kind, s.start, s.end) for s in r.base_spans],), lambda t: (list(plain_spans(t)),)),
        "near": (lambda d: near_dedup.near_duplicates(d, 3, 85), lambda r: (r.n_shingles,), lambda t: (len({tuple(x) for x in zip(*(t.split()[k:] for k in range(3)))}) if len(t.split()) > 2 else min(1, len(t.split())),)),
        "exact": (exact_dedup.exact_dedup, lambda r: (r.text_sha256,), lambda t: (hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t).encode()).hexdigest(),)),
        "bpe": (lambda d: bpe.encode_digests(d, ranks, queries.pre_token_pattern()), lambda r: (r.decoded_sha256,), lambda t: (hashlib.sha256(t.encode()).hexdigest(),)),
        "toxicity": (lambda d: toxicity.score(d, machine), lambda r: (r.score, r.predicted), lambda t: (0.5, 1)),
    }


@pytest.mark.parametrize("name", list(operators()))
def test_odd_rows_and_empty_tables(odd, clashing, none, name):
    """Every row gives its own values, whatever else it holds; extra columns change nothing."""
    operator, values, expected = operators()[name]
    wanted = sorted((-1 if i is None else i, *map(repr, expected(t or ""))) for i, t, *_ in ODD)
    for docs in (odd, clashing):
        rows = operator(docs).collect()
        got = sorted((-1 if r.doc_id is None else r.doc_id, *map(repr, values(r)[: len(wanted[0]) - 1])) for r in rows)
        assert got == wanted
    assert operator(none).count() == 0


def test_packing_of_odd_rows(spark, odd, none):
    file = f"{queries.TOKENIZERS}/byte_bpe_50k.json"
    encoder = packing.library_encoder(open(file, "rb").read())
    rows = packing.pack(odd, file).collect()
    lengths = collections.Counter()
    for r in rows:
        lengths[r.doc_id] += r.length
    wanted = collections.Counter()
    for i, t, *_ in ODD:
        wanted[i] += len(encoder.encode(t or "")) // 4 + 1
    assert lengths == wanted and packing.pack(none, file).count() == 0


def test_windows_are_near_equal_and_cut_little():
    rng = np.random.default_rng(4)
    for sizes in ([1023] * 40, [1] * 2000, [512, 513] * 30, rng.integers(1, 1024, 512).tolist(), [7], []):
        found = packing.windows(sizes, 1024)
        assert all(sum(hi - lo for _, lo, hi in w) <= 1024 for w in found)
        pieces = sorted(p for w in found for p in w)
        assert len(found) <= -(-sum(sizes) // 1024) * (1 + packing.RISE) + 1
        for i, size in enumerate(sizes):
            mine = [(lo, hi) for k, lo, hi in pieces if k == i]
            assert mine[0][0] == 0 and mine[-1][1] == size and all(a[1] == b[0] for a, b in zip(mine, mine[1:]))  # noqa: B905
        assert len(pieces) <= len(sizes) + 2 * len(found)


def test_fit_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "a", 1), (2, "same", 1), (2, "same", 1), (3, "x " * 50_000, 0)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, 0), (2, 1), (3, None), (9, 1)], "doc_id long, toxic int")
    assert 0 < toxicity.fit(docs, labels).scores([toxicity.terms("same")])[0] < 1
    assert toxicity.fit(docs, labels.limit(0)).scores([toxicity.terms("")])[0] == 0.5
    assert toxicity.fit(docs.limit(0), labels).bias == 0


def test_pages_of_odd_forms(spark):
    deep = lambda tag: f"<{tag}>" * 5000 + "low" + f"</{tag}>" * 5000
    wide = "<table>" + "".join(f"<tr><td>cell {i}</td></tr>" for i in range(10_000)) + "</table>"
    same = "<div><p>twice</p><p>own words</p><p>twice</p></div>"
    kept = "<article><div class='section-header'><h2>Head</h2></div><p class='share-price'>Price</p><p class='related-work'>Work</p><div class='post-comments'>I say</div><div id=ad-3>Buy</div></article>"
    rows = [(1, "http://a.example/", deep("div")), (2, "http://b.example/", deep("span")), (3, "http://c.example/1", wide), (4, "http://c.example/2", wide), (5, None, None), (None, "x", "<p>no id"), (6, "http://d.example/", same), (6, "http://d.example/", same), (7, "http://e.example/", kept)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = html_extract.extract(docs.select("*", *[F.lit("x").alias(c) for c in CLASHING.split()])).collect()
    texts = collections.defaultdict(list)
    for r in out:
        texts[r.page_id].append(r.text)
    assert len(out) == len(rows) and texts[1] == ["low"] and texts[2] == ["low"] and texts[5] == [""] and texts[None] == ["no id"]
    assert texts[3][0].split("\n\n") == [f"cell {i}" for i in range(10_000)]
    assert texts[6] == ["twice\n\nown words\n\ntwice"] * 2 and texts[7] == ["Head\n\nPrice\n\nWork"]
    assert html_extract.extract(docs.limit(0)).count() == 0


def test_alignment_matches_brute_force():
    rng = np.random.default_rng(8)

    def tree(depth):
        node = html_extract.Node("div", f"d{rng.integers(2)}")
        for _ in range(rng.integers(0, 4)):
            child = html_extract.Leaf("t%d" % rng.integers(2), 0.0, False, False) if depth == 0 or rng.random() < 0.4 else tree(depth - 1)
            node.children.append(child)
            node.size += getattr(child, "size", 1)
        return node

    def best(a, b):
        if isinstance(a, html_extract.Leaf) or isinstance(b, html_extract.Leaf):
            return 1 + (a.text == b.text) if isinstance(a, html_extract.Leaf) and isinstance(b, html_extract.Leaf) else 0
        return 1 + forest(a.children, b.children) if a.label == b.label else 0

    def forest(xs, ys):
        if not xs or not ys:
            return 0
        return max(forest(xs[1:], ys), forest(xs, ys[1:]), best(xs[0], ys[0]) + forest(xs[1:], ys[1:]))

    def weight(pairs):
        return sum(1 + (a.text == b.text) for a, b in pairs)

    for _ in range(150):
        a, b = tree(2), tree(2)
        size, pairs = html_extract.align(a, b)
        assert size == best(a, b) and weight(pairs) <= size and len({id(x) for x, _ in pairs}) == len(pairs) == len({id(y) for _, y in pairs})
        loose, some = html_extract.in_order(a, b) if a.label == b.label else (0, [])
        assert loose <= size and len({id(y) for _, y in some}) == len(some)


def test_exact_dedup_keeps_one_row_of_repeated_ids(odd):
    rows = exact_dedup.exact_dedup(odd).filter("doc_id in (7, 8)").collect()
    assert [r.keep_id for r in rows] == [7, 7, 7] and sum(r.kept for r in rows) == 1


def test_misra_gries_finds_frequent_digests(spark):
    rows = [(bytes([i % 7]),) for i in range(300)] + [(b"hot",)] * 200 + [(i.to_bytes(4, "big"),) for i in range(2000)]
    found = {bytes(r.digest) for r in exact_dedup.frequent_digests(spark.createDataFrame(rows, "digest binary").repartition(5), 16).collect()}
    assert b"hot" in found and len(found) <= 16


def test_near_duplicates_match_brute_force(documents, texts):
    sets = {i: set(near_dedup.shingles(t, 3).tolist()) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    for r in near_dedup.near_duplicates(documents, 3, 85).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)


def test_packing_round_trip(spark, texts):
    encoder = packing.library_encoder(open(f"{queries.TOKENIZERS}/byte_bpe_50k.json", "rb").read())
    ids = {i: encoder.encode(t) + bytes(4) for i, t in texts.items()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in queries.op9_packing(spark, SF).collect():
        assert zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) // 4
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for found, end in [(pieces[i], len(d) // 4) for i, d in ids.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == end if end is not None else at <= 1024


def test_encoders_match_libraries():
    import tiktoken
    from tokenizers import Tokenizer

    file = open(f"{queries.TOKENIZERS}/byte_bpe_multi_50k.tiktoken", "rb").read()
    theirs = tiktoken.Encoding("own", pat_str=queries.pre_token_pattern(), mergeable_ranks=bpe.read_ranks(file), special_tokens={})
    coder, mine = bpe.coder(file, queries.pre_token_pattern())
    json = open(f"{queries.TOKENIZERS}/byte_bpe_50k.json", "rb").read()
    library, packed = Tokenizer.from_buffer(json), packing.library_encoder(json)
    library.encode_special_tokens = True
    rng = np.random.default_rng(3)
    cases = ["", " ", "  a  b\n c", "a \n b ", "it's don't\t1.234", "日本語 テキスト です", "\x1c a b", "x" * 3000]
    cases += ["".join(rng.choice(list("aab é\n'.1"), rng.integers(0, 60))) for _ in range(400)]
    for text in cases:
        ids = np.frombuffer(mine.encode(text), "<u4").tolist()
        assert ids == theirs.encode_ordinary(text) and coder.decode(ids) == text.encode()
        assert np.frombuffer(packed.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def plain_spans(text):
    """The contract's patterns as they are written there."""
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text) if kind != "ip" or re.search(r"[0-9]\.[0-9]+\.[0-9]", text) else ():
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 16 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 8 <= len(d) <= 15):
                yield kind, m.start(), m.end()


def test_base_spans_match_brute_force(spark, texts):
    rng = np.random.default_rng(6)
    cases = dict(texts) | {-1: "a@b.c_x@y.zz ..a@b..c 1.2.3.256 0001.2.3.4 4785 3805 9239 1139 +1 (338) 555-7198 +12"}
    cases |= {-2 - i: "".join(rng.choice(list("1234 -.+()a@%5\n"), rng.integers(5, 90))) for i in range(400)}
    for r in pii.sanitise(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect():
        assert [(s.kind, s.start, s.end) for s in r.base_spans] == list(plain_spans(cases[r.doc_id]))


def test_disclosing_terms_are_found(spark):
    rows = [(i, f"filler{i} words go here the kingpin of harbour met bob@mail.example about trade{i}") for i in range(6)]
    rows += [(100 + i, f"clean text number {i} about harbour and words here the go of met about") for i in range(60)]
    out = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "kingpin" not in out[0].sanitised and "harbour" in out[0].sanitised and "bob@" not in out[0].sanitised
    assert all(not out[100 + i].spans for i in range(60))


def test_terms_beside_rare_entities_match_brute_force(spark):
    """An address in one text gives away the names and numbers beside it that stand nowhere else, and nothing more."""
    rows = [(1, "Yesterday Quorvin Hale wrote from q.hale@mail.example about flat B7x and the harbour . Distant " + "filler " * 40 + "Zebulon"), (2, "Yesterday the harbour was calm . Distant"), (3, "Write to q.hale@mail.example or Hale , room K9 ."), (4, "no names here")]
    rows += [(10 + i, f"plain text {i} about the calm harbour") for i in range(40)]
    out = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    terms = {i: [s.value for s in r.spans if s.kind == "term"] for i, r in out.items()}
    n = len(rows)
    texts = {i: t.split() for i, t in rows}
    near = {i: set((t[: t.index("q.hale")][-pii.CONTEXT :] + " " + t[t.index("example") + 7 :][: pii.CONTEXT]).split()) for i, t in rows if "q.hale" in t}
    wanted = {w for w in set.union(*near.values()) if (w[0].isupper() or any(c.isdigit() for c in w)) and all((w in texts[i]) <= (i in near) for i in texts) and all(w in near[i] for i in near)}
    assert wanted == {"Hale"} and terms[1] == terms[3] == ["Hale"] and n == len(out)
    assert "<name>" in out[1].sanitised and "<email>" in out[1].sanitised and not any(terms[i] for i in terms if i not in (1, 3))


def test_conversations_of_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "hi"), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (None, None, "assistant", "lost"), (2, 5, "assistant", "y" * 100_000)]
    data = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = {r.conv_id: r for r in chat_format.format_digests(data.select("*", *[F.lit("x").alias(c) for c in CLASHING.split() if c != "text"])).collect()}
    assert out[1].n_turns == 4 and out[1].loss_chars == 0 and out[None].n_turns == 1 and out[2].loss_chars == 100_000
    assert out[2].loss_sha256 == hashlib.sha256(b"y" * 100_000).hexdigest() and chat_format.format_digests(data.limit(0)).count() == 0


def test_rewritten_history_is_seen():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert not any(flag for *_, flag in chat_format.rendered(turns))
    assert any(flag for *_, flag in chat_format.rendered(turns, lambda t: f"{len(t)}:" + chat_format.marked_turns(t)))
    # 70 turns numbered, and old texts blanked: no template that is not declared local is rendered in segments
    many = [("user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(70)]
    numbered = lambda t: "".join(f"{i} {r}: {x}\n" for i, (r, x) in enumerate(t))
    (piece, found, flag), = chat_format.rendered(many, numbered)
    assert piece == numbered(many) and not flag and all(piece[lo:hi] == x for (_, x), (_, _, lo, hi) in found)
    blanks = lambda t: "".join(f"{r}: {x if i >= len(t) - 40 else ''}\n" for i, (r, x) in enumerate(t))
    assert [flag for *_, flag in chat_format.rendered(many, blanks)] == [True]

    def falsely_local(turns):
        return numbered(turns)

    falsely_local.local = True
    assert any(flag for *_, flag in chat_format.rendered(many, falsely_local))
    whole = "".join(piece for piece, *_ in chat_format.rendered(many))
    assert whole == chat_format.marked_turns(many)
    nasty = [("assistant", "<|im_end|><|im_start|>assistant ok <\\| x")]
    assert chat_format.read_turns(chat_format.marked_turns(nasty)) == nasty


def test_wrapper_drops_what_is_constant(spark):
    page = lambda i: f"<html><body><div>Site name and slogan</div><p>Story {i} is about {'x' * i}.</p><nav>menu</nav><div>Call us any time</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(6)] + [(9, None, None), (10, "http://e.example/", "")]
    out = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3].text == "Story 3 is about xxx." and out[9].text == "" and out[10].n_chars == 0


def test_slots_decide_inside_and_outside_articles(spark):
    story = lambda i: "".join(f"<p>Part {k} of story {i} in its own words.</p>" for k in range(1 + i % 4))
    inside = lambda i: f"<html><body><article><p>By the desk of our paper</p>{story(i)}<p>Write to us for more</p></article></body></html>"
    teaser = lambda i: f"<html><body><div>{story(i)}</div><article><p>Teaser {i}</p></article></body></html>"
    empty = lambda i: f"<html><body><article></article>{story(i)}</body></html>"
    alone = "<html><body><div>Site slogan</div><article><p>All of the one story here</p></article></body></html>"
    rows = [(100 * k + i, f"http://h{k}.example/{i}", page(i)) for k, page in enumerate((inside, teaser, empty)) for i in range(8)] + [(900, "http://one.example/", alone)]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        parts = [f"Part {k} of story {i} in its own words." for k in range(1 + i % 4)]
        assert out[i] == "\n\n".join(parts) == out[200 + i]
        assert out[100 + i] == "\n\n".join([*parts, f"Teaser {i}"])
    assert out[900] == "All of the one story here"


@pytest.mark.parametrize("copies", [2, 4, 10])
def test_copies_of_a_page_keep_their_text(spark, copies):
    page = lambda head, said: f"<html><body><div>Site slogan</div><article><h1>{head}</h1><p>{said}</p></article></body></html>"
    rows = [(i, "http://copies.example/a", page("One headline", "The whole story of one page.")) for i in range(copies)] + [(99, "http://copies.example/b", page("Another headline", "A different story."))]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {out[i] for i in range(copies)} == {"One headline\n\nThe whole story of one page."} and out[99] == "Another headline\n\nA different story."


def test_recurring_headings_stay_with_their_text(spark):
    page = lambda i: f"<html><body><p>Menu of the site</p><article><h1>Weekly digest</h1><p>News {i} of a week</p><h2>References</h2><p>Paper {i}</p><h2>More from us</h2><p>Write to the desk</p></article></body></html>"
    # one page has a text of its own where all others have the constant one
    rows = [(i, f"http://heads.example/{i}", page(i)) for i in range(9)] + [(9, "http://heads.example/9", page(9).replace("Write to the desk", "Only here"))]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"Weekly digest\n\nNews {i} of a week\n\nReferences\n\nPaper {i}" for i in range(9))
    assert out[9] == "Weekly digest\n\nNews 9 of a week\n\nReferences\n\nPaper 9\n\nMore from us\n\nOnly here"


def test_base_score_matches_brute_force(documents, texts):
    counts = collections.Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*t.encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    for r in lm_score.score(documents).collect():
        words = [*texts[r.doc_id].encode().lower().split(), b""]
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r.score <= 0


def test_scores_are_probabilities():
    """After a text the probabilities of all bytes and the end add up to 1, whatever stands beside it in a batch."""
    code = lm_score.Code(np.random.default_rng(1).integers(0, 9, (256, 257)))
    tables = [np.random.default_rng(k).integers(-4000, 4000, 1 << 18).astype(np.int16) for k in range(len(lm_score.ORDERS))]
    for prefix in (b"", b"some text " * 60):
        n = len(prefix)
        alone = [lm_score.log_probabilities([prefix + bytes([b])], code, tables)[0][n] for b in range(256)]
        end = lm_score.log_probabilities([prefix], code, tables)[0][n]
        assert abs(np.exp([*alone, end]).sum() - 1) < 1e-3
        beside = lm_score.log_probabilities([b"x" * 5000, prefix, b"", prefix + b"z"], code, tables)
        assert len(beside[1]) == n + 1 and np.isclose(beside[1][n], end, rtol=1e-4) and np.isclose(beside[3][n], alone[ord("z")], rtol=1e-4)


def following(texts):
    """How often each byte, or the end, follows each byte; a text begins after a zero."""
    out = np.zeros((256, 257), np.int64)
    for t in texts:
        for a, b in zip([0, *t], [*t, lm_score.END], strict=True):
            out[a, b] += 1
    return out


def test_bit_counts_match_brute_force():
    texts = [b"abracadabra abracadabra", b"", b"abrasive"]
    code, bits = lm_score.Code(following(texts)), 16
    counts = [np.zeros(2 << bits, np.int32) for _ in lm_score.ORDERS]
    lm_score.count_into(counts, code, texts)
    for k, order in enumerate(lm_score.ORDERS):
        plain = collections.Counter()
        for t in texts:
            for i, symbol in enumerate([*t, lm_score.END]):
                symbol += 257 * (t[i - 1] if i else 0)
                h = int.from_bytes((bytes(order) + t)[i : i + order], "big")
                place = (h * int(lm_score._MIX[k]) % 2**64) >> 32  # as hashed
                lo = int(code.offset[symbol])
                for e in range(lo, lo + int(code.length[symbol])):
                    plain[(place + int(code.step[e])) % (1 << bits) * 2 + int(code.bit[e])] += 1
        assert {int(i): int(counts[k][i]) for i in np.flatnonzero(counts[k])} == plain


def peak_bytes(call):
    call()  # tables and powers that are kept
    tracemalloc.start()
    try:
        call()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_work_arrays_stay_small():
    """A count makes nothing of a table's size, and a step nothing of a group's; nodes that paths begin with lie side by side."""
    code = lm_score.Code(np.random.default_rng(1).integers(0, 9, (256, 257)))
    counts = [np.zeros(2 << 21, np.int32) for _ in lm_score.ORDERS]
    assert peak_bytes(lambda: lm_score.count_into(counts, code, [b"a short text"])) < 1 << 20
    tables = [np.zeros(1 << 16, np.int16) for _ in lm_score.ORDERS]
    texts = [np.random.default_rng(i).integers(97, 123, 8000).astype(np.uint8).tobytes() for i in range(100)]
    few, many = (peak_bytes(lambda n=n: lm_score.log_probabilities(texts[:n], code, tables)) - n * 4 * 8000 for n in (10, 100))
    assert many < 1.5 * few
    assert 0 <= code.step.min() and code.step.max() < 256


def test_words_and_segments_of_many_texts_equal_each_ones():
    rng = np.random.default_rng(4)
    texts = ["", " ", "a", "\n\nTwo  Words\t", "x\x0by\x0cz\r\n\x1c\u00a0\u2003Ä É", "b" * 40, *("".join(rng.choice(list("abc \u00e9\n"), n)) for n in (15, 16, 17, 20, 900, 5000, 0, 3000))]
    words, owner = lm_score.words_of(pa.array(texts))
    assert list(zip(owner.tolist(), words.to_pylist(), strict=True)) == [(i, w) for i, t in enumerate(texts) for w in lm_score.lowered(t).split()]
    data = [lm_score.lowered(t) for t in texts]
    together = lm_score.segments_of(data)
    assert len(together) == len(data) and sum(len(x[0]) for x in together) > 20
    for one, t in zip(together, data, strict=True):
        assert all(np.array_equal(a, b) for a, b in zip(one, lm_score.segments(t), strict=True))
    assert lm_score.segments_of([]) == []


def test_segments_cover_and_repeat():
    rng = np.random.default_rng(2)
    passage = bytes(rng.integers(97, 123, 3000).astype(np.uint8))
    a, b = b"first words " * 3 + passage, b"something else before it " + passage + b" and after"
    (sa, ka, na), (sb, kb, nb) = lm_score.segments(a), lm_score.segments(b)
    assert sa.min() >= lm_score.CONTEXT and (np.diff(sa) > 0).all()
    shared = set(zip(ka.tolist(), na.tolist(), strict=True)) & set(zip(kb.tolist(), nb.tolist(), strict=True))
    inside = [x for x in sa[:-1] if x >= 36 + 16]
    assert len(shared) >= len(inside) - 1 > 3
    assert not len(lm_score.segments(b"a" * 100_000)[0]) > 2


def test_scores_match_brute_force(spark, documents, texts):
    """bits from the operator's own arrays, segments counted plainly; a copied text scores far above others."""
    rng = np.random.default_rng(9)
    twin = "".join(rng.choice(list("abcdefgh "), 3000))
    one, other, alone, *_ = [i for i in range(10_001, 10_100) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = list(texts.items())[:120] + [(one, twin), (other, twin), (alone, "".join(rng.choice(list("abcdefgh "), 3000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    data = {i: lm_score.lowered(t) for i, t in rows}
    train = [data[i] for i, _ in rows if not held[i]]
    code, bits = lm_score.Code(following(train)), lm_score.table_bits(sum(len(t) + 1 for t in train))
    counts = [np.zeros(2 << b, np.int32) for b in bits]
    lm_score.count_into(counts, code, train)
    tables = [lm_score.odds(c.astype(np.int64)) for c in counts]
    cut = {i: [x.tolist() for x in lm_score.segments(t)] for i, t in data.items()}
    every = collections.Counter(k for i in data for k in cut[i][1])
    total = collections.Counter(k for i in data if not held[i] for k in cut[i][1])
    pairs = collections.Counter(p for i in data if not held[i] for p in zip(cut[i][1], cut[i][2], strict=True))
    for r in lm_score.score(docs).collect():
        t = data[r.doc_id]
        logs = lm_score.log_probabilities([t], code, tables)[0].astype(float)
        start, key, after = cut[r.doc_id]
        mine = [(n, k, a, logs[s:e].sum(), total[k], pairs[k, a]) for n, (s, e, k, a) in enumerate(zip(start, [*start[1:], len(t)][: len(start)], key, after, strict=True)) if every[k] > 1 and total[k]]
        assert math.isclose(r.score, (logs.sum() + lm_score.segment_gain(mine, held[r.doc_id])) / math.log(10), rel_tol=1e-4)
    per = {r.doc_id: r.bits_per_byte for r in lm_score.score(docs).collect()}
    assert max(per[one], per[other]) < 0.5 * per[alone]


def test_machine_learns_a_pair():
    rng = np.random.default_rng(0)
    rows = [np.array(sorted({int(a), int(b), 5 + int(c)})) for a, b, c in zip(rng.choice([1, 2], 3000), rng.choice([3, 4], 3000), rng.integers(0, 40, 3000), strict=True)]
    labels = np.array([float((1 in r) == (3 in r)) for r in rows])
    machine = toxicity.train(rows, labels)
    assert ((machine.scores(rows) >= 0.5) == labels).mean() > 0.9


def near_groups(sets, percent):
    """The smallest id of each id's component, by comparing all pairs."""
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_pipeline_matches_brute_force(spark, documents, texts):
    """All five stages plainly: quality by its own SQL and lines, the others by comparing all rows."""
    import corpus_pipeline

    judged = {r.doc_id: r for r in quality_rules.quality_rules(documents).collect()}
    docs = {i: (judged[i].cleaned if judged[i].lost_share > 0 else t) for i, t in texts.items() if judged[i].kept}
    assert {r.doc_id: r.text for r in corpus_pipeline.quality(spark, documents, SF).collect()} == docs
    for i, t in list(docs.items()):
        good = [x for x in texts[i].split("\n") if x.split()]
        assert set(t.split("\n")) <= set(texts[i].split("\n")) and sum(map(len, t.split("\n"))) >= 0.5 * sum(map(len, good))
    first = {}
    for i in sorted(docs):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", docs[i]), i)
    docs = {i: docs[i] for i in first.values()}
    root = near_groups({i: set(near_dedup.shingles(t, 5).tolist()) for i, t in docs.items()}, 80)
    docs = {i: t for i, t in docs.items() if root[i] == i}
    table = spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string")
    docs = {r.doc_id: r.sanitised for r in pii.sanitise(table).collect()}
    assert not any(list(plain_spans(t)) for t in docs.values())
    encoder = packing.library_encoder(open(f"{queries.TOKENIZERS}/byte_bpe_50k.json", "rb").read())
    ids = {i: encoder.encode(t) + bytes(4) for i, t in docs.items()}
    pieces, filled = collections.defaultdict(list), collections.defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        assert zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) // 4
        pieces[r.doc_id].append((r.start, r.length))
        filled[r.sequence_id] += r.length
    assert pieces.keys() == ids.keys() and max(filled.values()) <= 1024
    for i, found in pieces.items():
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == len(ids[i]) // 4


def test_stages_on_odd_rows(spark):
    import corpus_pipeline

    text = " ".join(f"word{i} tells{i} more{i}." for i in range(40))
    rows = [(1, None), (2, ""), (None, text), (3, text), (3, text), (4, text + " bob@mail.example"), (5, "9" * 100_000), (6, "/ " * 50_000 + "a"), (7, " ".join(f"w{i}" for i in range(100_000)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    odd = docs.select("*", *[F.lit("x").alias(c) for c in CLASHING.split() if c not in docs.columns])
    ids = lambda d: sorted(-1 if r.doc_id is None else r.doc_id for r in d.collect())
    wanted = {"quality rules": [-1, 3, 3, 4, 7], "exact dedup": [1, 3, 4, 5, 6, 7], "near dedup": [-1, 1, 2, 3, 3, 5, 6, 7], "pii": [-1, 1, 2, 3, 3, 4, 5, 6, 7]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        if name != "packing":
            assert out.columns == docs.columns and ids(out) == wanted[name], name
        else:
            assert {r.doc_id for r in out.collect()} == {None, 1, 2, 3, 4, 5, 6, 7}
        assert stage(spark, odd.limit(0), SF).count() == 0
