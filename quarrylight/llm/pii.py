"""Information-theoretic sanitisation, in DataFrame functions only.

Patterns find what identifies people outright: addresses, numbers, cards and
phones.  Such a value is a protected entity.  Other words may give it away:
over all distinct texts, a word w that occurs in n(w) of them, and in n(w, e) of
these within CONTEXT characters of the entity e, discloses it by the share
n(w, e) / n(w) of its texts and by the pointwise mutual information
log2(share / p(e)) as a part of what there is to know, log2(1 / p(e)).  Words
above both thresholds are removed from the texts that have the entity if they
occur nowhere without it, and generalised by their shape otherwise.

An entity seen in a few texts only (most are: an address stands in its owner's
text) gives too little evidence for common words; there a word counts if it
is written like a name or a number and stands in no text without the entity, and
it is generalised, not removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import WHITE, drop, fresh, let, text_of, written

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    # the contract's patterns, with what keeps them linear: a run is entered at its start only (or where the last match
    # ended), and the last group is possessive, as nothing follows it: Java would recurse once for each of its turns
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)",
    "card": r"[0-9]([\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this needs no search for the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"([0-9][\x20-]?){16}", "phone": r"\+[0-9]"}
#: An entity or word in so many distinct texts has evidence of its own; below that a word must look like a name or number.
MIN_TEXTS = 3
MIN_SHARE = 0.8
MIN_DISCLOSURE = 0.9
#: Characters before and after an entity whose words go with it.
CONTEXT = 100
#: Words of rare entities that count: with a capital letter first or a digit in it.
NAMELIKE = r"^[^\p{L}\p{N}]*(\p{Lu}|[^\s]*[0-9])"
GENERAL = {"email": "<email>", "ip": "<ip>", "card": "<card>", "phone": "<phone>"}
#: A word with one of these inside is an entity itself, or part of one.
ENTITY = r"@[A-Za-z0-9-]+\.|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]|[0-9]{4}"
#: Matches that are added up at a time, see found.
BLOCK = 256


def found(text: Column, pattern: Column) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points.

    What lies between the matches has the lengths from which places follow.
    They are added up in blocks: appending to one long array would copy it each time.
    """
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    pieces = lambda t: F.arrays_zip(F.transform(F.split(t, pattern, -1), lambda g: F.length(g)).alias("gap"), F.regexp_extract_all(t, pattern, 0).alias("value"))

    def step(acc: Column, x: Column) -> Column:
        lo = acc["at"] + x["gap"]
        hi = lo + F.coalesce(F.length(x["value"]), F.lit(0))
        span = F.struct(lo.alias("start"), hi.alias("end"), x["value"].alias("value"))
        return F.struct(hi.alias("at"), F.when(x["value"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], span)).alias("out"))

    def block(acc: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.array_append(acc["blocks"], d["out"]).alias("blocks")))

    def blocks(all_: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(all_) - 1, F.lit(BLOCK)), lambda i: F.slice(all_, i + 1, F.lit(BLOCK)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,value:string>>>").alias("blocks"))
        return F.aggregate(cut, start, block, lambda acc: F.flatten(acc["blocks"]))

    return let(pieces(text), blocks)


def mentions(text: Column) -> Column:
    """array<struct<entity, words>> of the values that identify someone, with the words around each."""

    def near(gaps: Column, values: Column) -> Column:
        before = lambda g: F.when(F.length(g) > CONTEXT, F.regexp_replace(F.right(g, F.lit(CONTEXT)), r"^[^\x20\x09-\x0D]+", "")).otherwise(g)
        after = lambda g: F.when(F.length(g) > CONTEXT, F.regexp_replace(F.left(g, F.lit(CONTEXT)), r"[^\x20\x09-\x0D]+$", "")).otherwise(g)
        return F.transform(values, lambda v, i: F.struct(v.alias("entity"), F.array_distinct(F.split(F.concat(before(F.get(gaps, i)), F.lit(" "), after(F.get(gaps, i + 1))), WHITE)).alias("words")))

    def of(kind: str) -> Column:
        pattern = F.lit(PATTERNS[kind])
        both = let(F.split(text, pattern, -1), lambda gaps: near(gaps, F.regexp_extract_all(text, pattern, 0)))
        hits = F.filter(both, lambda m: passes(kind, m["entity"]))
        return F.when(text.rlike(HINTS[kind]), hits).otherwise(F.array().cast("array<struct<entity:string,words:array<string>>>"))

    return F.concat(*map(of, KINDS))


def luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits holds."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        # a part may be longer than a number holds: without leading zeros it has three digits at most
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> by kind as listed, then by place."""

    def of(kind: str) -> Column:
        hits = F.filter(found(text, F.lit(PATTERNS[kind])), lambda m: passes(kind, m["value"]))
        named = F.transform(hits, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
        return F.when(text.rlike(HINTS[kind]), named).otherwise(F.array().cast(SPANS))

    return F.concat(*map(of, KINDS))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def disclosing_terms(texts: DataFrame) -> DataFrame:
    """(entity, term, removed): words that disclose an entity, from `texts` (tid, text, mentions), one row per distinct text.

    Counts run over all texts with map-side aggregation; only words that go
    with an entity are counted on, and a mention gives a bounded number of them.
    """
    n = texts.count()
    beside = texts.select("tid", F.explode("mentions").alias("m")).select("tid", "m.entity", "m.words")
    held = beside.groupBy("entity").agg(F.count_distinct("tid").alias("ne"))
    words = beside.select("tid", "entity", F.explode("words").alias("term")).filter((F.col("term") != "") & ~F.contains("term", F.col("entity")) & ~F.contains("entity", F.col("term")) & ~F.col("term").rlike(ENTITY))
    pairs = words.distinct().groupBy("entity", "term").agg(F.count("*").alias("nte")).join(held, "entity")
    rare = (F.col("ne") < MIN_TEXTS) & (F.col("nte") == F.col("ne")) & F.col("term").rlike(NAMELIKE)
    pairs = written(pairs.filter((F.col("nte") >= MIN_TEXTS) | rare), "pairs")
    candidates = pairs.select("term").distinct()
    counts = texts.select(F.explode(F.array_distinct(F.split("text", WHITE))).alias("term")).groupBy("term").agg(F.count("*").alias("nt")).join(candidates, "term")
    share = F.col("nte") / F.col("nt")
    known = F.log2(F.lit(float(max(n, 1))) / F.col("ne"))
    disclosed = F.when(known > 0, (known + F.log2(share)) / known).otherwise(0.0)
    enough = F.when(F.col("nte") >= MIN_TEXTS, share >= MIN_SHARE).otherwise(share == 1)
    kept = written(pairs.join(counts, "term").filter(enough & (disclosed >= MIN_DISCLOSURE)).select("entity", "term", ((share == 1) & (F.col("nte") >= MIN_TEXTS)).alias("removed")), "terms")
    drop(pairs)
    return kept


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with base_spans, spans (array<struct<kind, start, end, value>>) and sanitised.

    Null texts count as empty and have no spans.  A base span of one kind may
    overlap one of another: all are listed, and the sanitised text replaces
    their union once, by the kind that begins first.  Copies of a text are one piece of
    evidence.  Columns of these names in `docs` are replaced; other columns,
    repeated rows and null ids pass through, whatever their names; an empty table
    gives an empty result.  A text of any length is read whole.  `docs` must read
    the same twice.
    """
    rest = [c for c in docs.columns if c not in ("base_spans", "spans", "sanitised")]
    text_, tid_, spans_, terms_, gone_, all_ = fresh(docs, "text_", "tid_", "spans_", "terms_", "gone_", "all_")
    text = text_of(docs, text_col)
    keyed = docs.select(*[docs[c] for c in rest], text.alias(text_), F.unhex(F.sha2(text, 256)).alias(tid_))
    marked = keyed.withColumn(spans_, F.explode(F.array(base_spans(F.col(text_)))))
    slim = keyed.select(F.col(tid_).alias("tid"), F.col(text_).alias("text"))
    some = F.when(F.col("text").rlike("[@0-9]"), mentions(F.col("text"))).otherwise(F.array().cast("array<struct<entity:string,words:array<string>>>"))
    distinct = written(slim.groupBy("tid").agg(F.first("text").alias("text")).withColumn("mentions", some), "texts")
    terms = disclosing_terms(distinct)
    hit = distinct.select("tid", F.explode(F.transform("mentions", lambda m: m["entity"])).alias("entity")).distinct()
    per_text = written(hit.join(terms, "entity").groupBy("tid").agg(F.collect_set("term").alias("terms"), F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("gone")), "disclosing")
    drop(terms)
    drop(distinct)

    found_ = per_text.select(F.col("tid").alias(tid_), F.col("terms").alias(terms_), F.col("gone").alias(gone_))
    both = marked.join(found_, tid_, "left")
    words = F.filter(found(F.col(text_), F.lit(r"[^\x20\x09-\x0D]+")), lambda w: F.array_contains(F.col(terms_), w["value"]))
    extra = F.filter(words, lambda m: ~F.exists(F.col(spans_), lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    extra = F.transform(extra, lambda m: F.struct(F.lit("term").alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    all_spans = F.when(F.col(terms_).isNull(), F.col(spans_)).otherwise(F.concat(F.col(spans_), extra))
    spanned = both.withColumn(all_, F.explode(F.array(all_spans)))
    return spanned.select(*[F.col(f"`{c}`") for c in rest], F.col(spans_).alias("base_spans"), F.col(all_).alias("spans"), redacted(F.col(text_), F.col(all_), F.col(gone_)).alias("sanitised"))


def redacted(text: Column, spans: Column, gone: Column) -> Column:
    """The text with every span replaced by its kind, spans of removed terms by nothing."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"), s["value"].alias("value"))))
    kinds = F.create_map(*[F.lit(x) for pair in GENERAL.items() for x in pair])

    def step(acc: Column, s: Column) -> Column:
        inside = -s["neg"] <= acc["at"]
        joined = s["start"] < acc["at"]
        shape = F.when(s["value"].rlike("[0-9]"), F.lit("<number>")).when(s["value"].rlike(NAMELIKE), F.lit("<name>")).otherwise(F.lit("<term>"))
        term = F.when(F.coalesce(F.array_contains(gone, s["value"]), F.lit(False)), F.lit("")).otherwise(shape)
        label = F.when(s["kind"] == "term", term).otherwise(F.element_at(kinds, s["kind"]))
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        grown = F.when(joined, acc["out"]).otherwise(F.concat(acc["out"], F.array(before, label)))
        return F.struct(F.when(inside, acc["at"]).otherwise(-s["neg"]).alias("at"), F.when(inside, acc["out"]).otherwise(grown).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    made = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(made)
