"""Predicates on questions, chunks and blocks: what routes, focuses and filters ask."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight import config
from quarrylight.functions import text, urls


def said(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def source_filter(source: str, source_type: Column, domain: Column, site: str = config.SITE_DOMAIN) -> Column:
    """Rows of a source; `all` is no filter, a name that is none an error. Type is a partition column, so that files are pruned."""
    name = (source or "all").strip().lower()
    if name not in config.SOURCES:
        raise ValueError(f"unknown source {source!r}")
    if name == "all":
        return F.lit(True)
    if name == "website":
        return source_type.isin("blog", "website") | F.coalesce(domain == site, F.lit(False))
    return source_type == name


def compiled(query: dict | None) -> Column:
    """A metadata filter as a condition: {"a": 1, "b": {"$eq": 2}} all hold, {"$or": [...]} one does; empty is no filter."""
    every = []
    for key, value in (query or {}).items():
        if key in ("$or", "$and"):
            parts = [compiled(x) for x in value]
            every.append(reduce(lambda a, b: a | b, parts, F.lit(False)) if key == "$or" else reduce(lambda a, b: a & b, parts, F.lit(True)))
        elif isinstance(value, dict):
            for name, wanted in value.items():
                made = {"$eq": lambda c, w: c == w, "$ne": lambda c, w: c != w, "$in": lambda c, w: c.isin(*w), "$gte": lambda c, w: c >= w, "$lte": lambda c, w: c <= w}
                if name not in made:
                    raise ValueError(f"unknown operator {name!r}")
                every.append(F.coalesce(made[name](F.col(key), wanted), F.lit(False)))
        else:
            every.append(F.coalesce(F.col(key) == value, F.lit(False)))
    return reduce(lambda a, b: a & b, every, F.lit(True))


def fee_question(q: Column) -> Column:
    return said(q).rlike(config.FEE_QUERY)


def pricing_row(title: Column, heading: Column, body: Column) -> Column:
    return said(title).rlike(config.PRICING_TITLE) | said(heading).rlike(config.PRICING_TITLE) | said(body).rlike(config.PRICING_ROW)


def vendor_noise(title: Column, heading: Column, body: Column) -> Column:
    """Rows about payment vendors that are no pricing rows."""
    return ~pricing_row(title, heading, body) & F.concat_ws(" ", said(title), said(heading), said(body)).rlike(config.VENDOR_NOISE)


def package_question(q: Column) -> Column:
    return said(q).rlike(config.PACKAGE_INTENT)


def documents_question(q: Column) -> Column:
    return said(q).rlike(config.DOCUMENTS_QUERY)


def product_detail_row(kind: Column, url: Column) -> Column:
    return F.coalesce(kind == "product_detail", F.lit(False)) | F.lower(said(url)).contains("/product-details/")


def list_question(q: Column) -> Column:
    return said(q).rlike(config.LIST_INTENT)


def cued(t: Column, cues: tuple) -> Column:
    """The labels of all cues that `t` has, without repeats."""
    named = [F.when(t.rlike(pattern), F.array(*map(F.lit, labels))).otherwise(F.array().cast("array<string>")) for pattern, labels in cues]
    return F.array_distinct(F.concat(*named))


def section_targets(q: Column) -> Column:
    """Sections that the last line of a question names, else those that the whole names, else all."""
    lines = F.filter(F.split(said(q), "\n"), lambda x: F.trim(x) != "")
    last, whole = cued(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")), config.SECTION_CUES), cued(said(q), config.SECTION_CUES)
    return F.when(F.size(last) > 0, last).when(F.size(whole) > 0, whole).otherwise(F.array(*map(F.lit, config.CATALOG_SECTIONS)))


def country_tokens(q: Column) -> Column:
    return cued(said(q), config.COUNTRY_CUES)


def of_country(tokens: Column, title: Column, url: Column) -> Column:
    """Whether a chunk is of one of the countries; short tokens must be a segment of the path, others may stand in title or address. No tokens: any."""
    segments = F.split(F.lower(urls.site_path(said(url))), "/")
    where = F.concat_ws(" ", F.lower(said(title)), F.lower(said(url)))
    match = F.exists(tokens, lambda t: F.when((F.length(t) <= 3) & t.rlike("^[a-z]+$"), F.array_contains(segments, t)).otherwise(F.contains(where, t)))
    return (F.size(tokens) == 0) | match


def section_row(kind: Column, source_type: Column, heading: Column, targets: Column, kinds: tuple[str, ...] = ("country_overview", "product_detail", "service_landing")) -> Column:
    """Whether a chunk is one of the wanted sections of the website's catalog."""
    ours = said(kind).isin(*kinds) | said(source_type).isin("website", "")
    return ours & F.array_contains(targets, text.heading_root(heading))


def elliptical(q: Column) -> Column:
    return said(q).rlike(config.ELLIPTICAL)


def service_count_question(q: Column) -> Column:
    return said(q).rlike(config.SERVICE_COUNT)


def location_count_question(q: Column) -> Column:
    return said(q).rlike(config.LOCATION_COUNT)


def compare_question(q: Column) -> Column:
    return said(q).rlike(config.COMPARE_QUERY)


def noise_text(t: Column, least: int = config.MIN_BLOCK_CHARS) -> Column:
    low = F.trim(said(t))
    return (F.length(low) < least) | low.rlike(config.NOISE_TEXT)


def noise_heading(t: Column) -> Column:
    return said(t).rlike(config.BYLINE_HEADING) | said(t).rlike(config.TOC_HEADING) | said(t).rlike(config.BREADCRUMB_HEADING)


def toc_list(t: Column) -> Column:
    """A list of three lines or more of which two, and half, are what contents name."""
    lines = F.filter(F.split(said(t), "\n"), lambda x: F.trim(x) != "")
    words = F.array(*map(F.lit, config.TOC_WORDS))
    hits = F.size(F.filter(lines, lambda x: F.exists(words, lambda w: F.contains(F.lower(x), w))))
    return (F.size(lines) >= 3) & (hits >= F.greatest(F.lit(2).cast("long"), F.floor(F.size(lines) / 2)))


def refusal(answer: Column) -> Column:
    """A short answer that says nothing was found."""
    return (F.length(said(answer)) < 220) & F.lower(said(answer)).rlike("could not find|couldn't find|no information|not available in|don't have|do not have")


def upcoming(event_date: Column, today: Column) -> Column:
    """Events that are still to come are left out of what is indexed."""
    return F.coalesce(event_date > today, F.lit(False))


def notify_form(t: Column) -> Column:
    return F.lower(said(t)).rlike("notify me|get notified|coming soon")


def long_enough(t: Column, least: int) -> Column:
    return F.length(text.cleaned(said(t))) >= least


def listed(id_: Column, name: Column, wanted: list[str]) -> Column:
    """Whether id or name is on a list; an empty list allows all."""
    return F.lit(True) if not wanted else id_.isin(*wanted) | name.isin(*wanted)


def path_has(path: Column, needle: str | None) -> Column:
    return F.lit(True) if not needle else F.contains(F.lower(path), F.lit(needle.lower()))
