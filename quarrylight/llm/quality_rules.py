"""Line-first quality rules, in DataFrame functions only.

Each line of a text is judged by itself: by its punctuation, by whether it is
navigation, and by phrases of boilerplate.  Failing lines are removed; a
document that loses too much of its text by that is rejected, as is one that
fails the base rules on length and repetition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import WHITE, fresh, let, text_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
#: Phrases that mark a line of at most BOILERPLATE_WORDS words as boilerplate.
BOILERPLATE = r"(?i)\b(all rights reserved|cookies? (policy|settings|preferences)|accept (all )?cookies|we use cookies|privacy policy|terms (of|and) (use|service|conditions)|subscribe to our|sign (up|in) (for|to|now)|log ?in|click here|read more|share (this|on)|follow us|skip to (main )?content|powered by|enable javascript|lorem ipsum|add to cart|back to top)\b"
BOILERPLATE_WORDS = 25
#: A line with this many separators, or with one to so many words, is navigation. The possessive ++ gives the same
#: matches as + (what may follow a separator takes no other) and keeps Java from recursing over long lines.
NAVIGATION = r"([|»›•·].*){3}|^\s*(([|»›•·/>]|\w+\s*[|»›•·])\s*)++\w*\s*[|»›•·]?\s*$"
#: A letter or digit repeated far beyond words, or no letter at all, is no sentence.
NO_SENTENCE = r"^[^\p{L}]*$|(.)\1{19}"
MAX_SYMBOL_SHARE = 0.1
#: Punctuation marks; a line in which they are more than this share of the characters is a list of marks, leaders or an address bar.
MARKS = ".,;:!?()[]{}_=~^/-+@"
MAX_MARK_SHARE = 0.3
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST_SHARE = 50, 50, 0.5


def line_fails(line: Column) -> Column:
    """Whether a line that has a word is to be removed."""
    words = F.size(F.split(F.trim(line), WHITE))
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    marks = F.length(line) - F.length(F.translate(line, MARKS, ""))
    return line.rlike(NO_SENTENCE) | (symbols > MAX_SYMBOL_SHARE * F.length(line)) | (marks > MAX_MARK_SHARE * F.length(line)) | line.rlike(NAVIGATION) | ((words <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE))


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of three words that occurs twice or more in `words`."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def places(grams: Column) -> Column:
        keyed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return let(keyed, lambda s: F.array_sort(F.transform(F.filter(F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), (F.coalesce(F.get(s, k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False))).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"])))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    counted = let(hashes, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(places(g), covered)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(counted)


def quality_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_share, cleaned and kept.

    Null counts as no text; a text without words fails the base rules.  Lines
    without a word are neither removed nor counted.  Columns of these names in
    `docs` are replaced; other columns, repeated rows and null ids pass
    through, whatever their names; an empty table gives an empty result.  A
    text of any length is read whole, in time that grows with its length.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_share", "cleaned", "kept"]
    text = text_of(docs, text_col)
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    good = lambda xs: F.filter(xs, lambda x: ~line_fails(x))
    chars = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    facts = F.struct(
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("repeat"))).alias("words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), chars(x).alias("chars"), good(x).alias("good"))).alias("lines"),
    )
    kept_cols = [docs[c] for c in docs.columns if c not in names]
    # one evaluation of the facts for all columns: explode stops them from being inlined once for each use
    (held,) = fresh(docs, "facts")
    rows = docs.select(*kept_cols, F.explode(F.array(facts)).alias(held))
    f = F.col(held)
    base_failed = (f["words"]["n"] < MIN_WORDS) | (100 * f["words"]["repeat"] > MAX_REPEAT_PERCENT * f["words"]["n"])
    lost = F.when(f["lines"]["chars"] > 0, 1 - chars(f["lines"]["good"]) / f["lines"]["chars"]).otherwise(F.lit(1.0))
    return rows.select(
        *[c for c in rows.columns if c != held],
        f["words"]["n"].alias("n_words"),
        f["word_chars"].alias("word_chars"),
        f["n_symbols"].alias("n_symbols"),
        f["lines"]["dup"].alias("n_dup_lines"),
        f["words"]["repeat"].alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        lost.alias("lost_share"),
        F.array_join(f["lines"]["good"], "\n").alias("cleaned"),
        (~base_failed & (lost <= MAX_LOST_SHARE)).alias("kept"),
    )
