"""Text functions on columns, all inside the JVM but one."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight import config

BLANK = r"^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, BLANK, "")


def normalised(c: Column) -> Column:
    """No-break spaces and runs of blanks to one space, three and more line ends to two, stripped."""
    c = F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def cleaned(c: Column) -> Column:
    """`normalised` without white space before closing punctuation."""
    return F.regexp_replace(normalised(c), r"[ \t\n\r\f\v]+([,.;:!?])", "$1")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def words(c: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_extract_all(c, F.lit(r"([^ \t\n\r\f\v]+)"), 1)


def terms(c: Column) -> Column:
    """Runs of three and more letters a-z of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z]{3,})"), 1)


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def money(c: Column) -> Column:
    """Whole numbers without decimals, others with two."""
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(F.format_string("%.2f", c))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Text with the characters that HTML's references stand for."""
    return texts.map(lambda t: None if t is None else html.unescape(t))


def compatible(c: Column) -> Column:
    """Compatibility forms (NFKC), which no built-in gives; ASCII texts never leave the JVM's value for the function's."""
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(_nfkc(c))


def without_crumbs(c: Column) -> Column:
    """Without the ends of cut texts, such as Read More."""
    return strip(F.regexp_replace(c, config.CRUMBS, ""))


def service_codes(c: Column) -> Column:
    """Codes as PM and digits, each once, in their order."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(config.SERVICE_CODE), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.concat(F.lit("PM"), x)))


def row_title(c: Column) -> Column:
    """What stands after Title: on a line of its own; empty if nothing does."""
    return strip(F.regexp_extract(F.coalesce(c, F.lit("")), config.ROW_TITLE, 1))


def heading_root(path: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(path, F.lit("")), ">", 1)))


def heading_depth(path: Column) -> Column:
    return F.regexp_count(F.coalesce(path, F.lit("")), F.lit(">"))


def once(value: Column, said: Callable[[Column], Column]) -> Column:
    """What `said` makes of a value that is computed once for a row, however often it is asked for, also within lists."""
    return F.get(F.transform(F.array(value), said), F.lit(0))


def matchable(c: Column) -> Column:
    """Lower-case letters, digits and percent signs, all else one space."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9%]+"), F.lit(0)), " ")


def match_tokens(c: Column, stop: tuple[str, ...] = config.STOP_WORDS) -> Column:
    """Distinct words of three letters or more that are no stop words."""
    return F.array_except(F.filter(F.split(matchable(c), " "), lambda t: F.length(t) > 2), F.array(*map(F.lit, stop)))


def escaped(c: Column) -> Column:
    """Text as it stands in HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def section_label(heading: Column) -> Column:
    """The label of the first alias that a heading has; other headings as slugs with underscores."""
    label = F.lit(None).cast("string")
    for pattern, name in reversed(config.SECTION_ALIASES):
        label = F.when(heading.rlike(pattern), name).otherwise(label)
    return F.coalesce(label, F.replace(slug(heading), F.lit("-"), F.lit("_")))


def stated_total(c: Column) -> Column:
    """The total that a page states: `Showing 9 out of 117 packages` or `Result - 41 Packages`."""
    first = F.regexp_extract(c, r"(?i)\bout\s+of\s+(\d+)", 1)
    second = F.regexp_extract(c, r"(?i)\bresults?\s*[-:]?\s*(\d+)", 1)
    return F.coalesce(first.try_cast("int"), second.try_cast("int"))


def related_questions(c: Column) -> Column:
    """Up to three questions of 8 to 120 characters out of a model's JSON list, fenced or within other words."""
    inside = F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), "```(?:json)?", ""), r"(?s)(\[.*\])", 1)
    found = F.coalesce(F.from_json(inside, "array<string>"), F.array().cast("array<string>"))
    clean = F.transform(found, lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")))
    return F.slice(F.filter(clean, lambda x: F.length(x).between(8, 120)), 1, 3)


def leading_serial(c: Column) -> Column:
    """struct<sr, text>: a number before the text, and the text without it; null and all of it where there is none."""
    no = F.regexp_extract(c, r"^(\d+)\s+(.+)$", 1)
    return F.struct(F.when(no != "", no.try_cast("int")).alias("sr"), F.when(no != "", F.regexp_extract(c, r"^(\d+)\s+(.+)$", 2)).otherwise(c).alias("text"))


def fact_line(serial: Column, left: Column, right: Column) -> Column:
    return F.concat(serial.cast("string"), F.lit(". "), F.coalesce(left, F.lit("")), F.when(F.coalesce(right, F.lit("")) != "", F.concat(F.lit(": "), right)).otherwise(""))


def table_row(*cells: Column) -> Column:
    """A row of a table in markdown; bars within cells are escaped."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")) for c in cells)), F.lit(" |"))


def starting_price(c: Column) -> Column:
    """struct<currency, amount> of `starting from AED 1,200`, or null."""
    pattern = r"(?i)(?:starting|starts)\s+(?:from|at)\s*:?\s*([A-Z]{3}|[$€£])\s*([0-9][0-9,]*(?:\.[0-9]+)?)"
    amount = F.replace(F.regexp_extract(c, pattern, 2), F.lit(","), F.lit("")).try_cast("double")
    return F.when(amount.isNotNull(), F.struct(F.upper(F.regexp_extract(c, pattern, 1)).alias("currency"), amount.alias("amount")))


def numbered_list(items: Column) -> Column:
    """Lines `1. title: note` of structs with title, name and note; the first of title and name that says something."""
    first = lambda x: F.coalesce(F.nullif(F.trim(x["title"]), F.lit("")), F.nullif(F.trim(x["name"]), F.lit("")), F.lit("Untitled"))
    note = lambda x: F.when(F.coalesce(F.trim(x["note"]), F.lit("")) != "", F.concat(F.lit(": "), F.trim(x["note"]))).otherwise("")
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), first(x), note(x))), "\n")


def string_list(c: Column, is_list: bool) -> Column:
    """A value or list of values as a list without blanks."""
    values = c if is_list else F.array(c)
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def rank_tags(rank: Column) -> Column:
    return F.when(rank > 0, F.array(F.lit("Best Seller"))).otherwise(F.array().cast("array<string>"))


def priced(amount: Column, currency: Column) -> Column:
    """Currency in capitals and the amount, whole or with two places; what is no number stays as it is."""
    number = amount.try_cast("double")
    shown = F.when(number.isNull(), amount).otherwise(money(number))
    return F.when(amount.isNull() | (F.trim(amount) == ""), None).when(F.coalesce(F.trim(currency), F.lit("")) == "", shown).otherwise(F.concat(F.upper(F.trim(currency)), F.lit(" "), shown))


def iso_time(c: Column) -> Column:
    """A timestamp of ISO form, Z or no zone being UTC; null for what is none."""
    ok = c.rlike(r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([Zz]|[+-]\d{2}:?\d{2})?)?\s*$")
    return F.when(ok, F.try_to_timestamp(F.trim(c)))


def date_range(first: Column, last: Column) -> Column:
    """`1 Jan 2024` or `1 Jan 2024 to 3 Jan 2024`."""
    day = lambda c: F.date_format(c, "d MMM yyyy")
    return F.when(day(first) == day(last), day(first)).otherwise(F.concat(day(first), F.lit(" to "), day(last)))


def run_id(now: Column) -> Column:
    return F.date_format(now, "yyyyMMdd'T'HHmmss'Z'")


def member_count(c: Column) -> Column:
    """How many members a chat's JSON tells of: a number, a list, or an object with one of either."""
    number = lambda p: F.get_json_object(c, p).try_cast("int")
    length = lambda p: F.json_array_length(F.get_json_object(c, p))
    return F.coalesce(number("$.member_count"), number("$.members_count"), length("$.members"), length("$.participants"), F.size(F.json_object_keys(F.get_json_object(c, "$.members"))))
