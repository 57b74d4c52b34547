"""Measures of retrieval and answers over tables of cases; a measure that a case does not ask for is null and out of every mean."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight import config
from quarrylight.functions import predicates, text

EMPTY = "array<string>"


def listed(c: Column) -> Column:
    """A list without blanks; null is empty."""
    return text.string_list(c, True)


def prefix_hit(url: Column, refs: Column) -> Column:
    """Whether an address is, or goes on from, one of the references."""
    return F.exists(listed(refs), lambda r: F.startswith(F.coalesce(url, F.lit("")), r))


def hit_at_k(cases: DataFrame, found: DataFrame, k: int = 5) -> DataFrame:
    """(case_id, hit): 1 if one of the first k rows is at a reference, 0 if none is or nothing was found, null for cases without references."""
    best = found.filter(F.col("rank") <= k).join(cases.select("case_id", "refs"), "case_id").groupBy("case_id").agg(F.max(prefix_hit(F.col("url"), F.col("refs")).cast("double")).alias("hit"))
    wanted = F.size(listed(F.col("refs"))) > 0
    return cases.select("case_id", "refs").join(best, "case_id", "left").select("case_id", F.when(wanted, F.coalesce("hit", F.lit(0.0))).alias("hit"))


def share(needles: Column, within: Column) -> Column:
    """The share of needles that a text has, in any case; null without needles."""
    wanted = listed(needles)
    low = F.lower(F.coalesce(within, F.lit("")))
    return F.when(F.size(wanted) > 0, F.size(F.filter(wanted, lambda n: F.contains(low, F.lower(n)))) / F.size(wanted))


def context_recall(cases: DataFrame, found: DataFrame, k: int = 5) -> DataFrame:
    """(case_id, recall): the share of needles in the texts of the first k rows, joined by line ends in their order."""
    context = found.filter(F.col("rank") <= k).groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n").alias("context"))
    return cases.select("case_id", "needles").join(context, "case_id", "left").select("case_id", share(F.col("needles"), F.col("context")).alias("recall"))


def answer_measures(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """(case_id, included, forbidden_ok): the share of what an answer must include, and whether it says nothing that is forbidden (1 or 0)."""
    a = F.lower(F.coalesce("answer", F.lit("")))
    bad = listed(F.col("forbid"))
    ok = F.when(F.size(bad) > 0, (~F.exists(bad, lambda n: F.contains(a, F.lower(n)))).cast("double"))
    return cases.select("case_id", "must", "forbid").join(answers, "case_id", "left").select("case_id", share(F.col("must"), F.col("answer")).alias("included"), ok.alias("forbidden_ok"))


def means(scored: DataFrame, measures: list[str]) -> DataFrame:
    """(tag, cases, mean of each measure) by tag, a case counting in each of its tags, and `overall`."""
    aggs = [F.count("*").alias("cases"), *(F.avg(m).alias(m) for m in measures)]
    by_tag = scored.select(F.explode("tags").alias("tag"), *measures).groupBy("tag").agg(*aggs)
    return by_tag.unionByName(scored.agg(*aggs).select(F.lit("overall").alias("tag"), "*"))


def gate(now: DataFrame, base: DataFrame, most: float = config.MAX_DROP) -> DataFrame:
    """(metric, delta, failed): a metric fails that fell by more than `most`; one that is missing on a side is skipped."""
    both = now.select("metric", F.col("value").alias("now")).join(base.select("metric", F.col("value").alias("base")), "metric", "full_outer")
    delta = F.col("now") - F.col("base")
    return both.select("metric", delta.alias("delta"), F.coalesce(delta < -most, F.lit(False)).alias("failed"))


def settings(spark, grid: dict[str, list]) -> DataFrame:
    """Every combination of a grid's values, a column a setting."""
    return reduce(lambda d, item: d.select("*", F.explode(F.array(*map(F.lit, item[1]))).alias(item[0])), grid.items(), spark.range(1)).drop("id")


def sweep(found: DataFrame, questions: int, grid: dict[str, list], kept: Column, floor: float) -> DataFrame:
    """The grid's settings with cost, gain and winner, measured on what was found (query_id, hit, ...).

    A row counts under a setting if `kept` says so; cost is how many do, gain
    the share of all questions that keep a hit.  The winner reaches the floor if one does, then has
    the most gain, the least cost and the smallest settings.  The grid is a few rows, which every found row meets.
    """
    grids = settings(found.sparkSession, grid)
    met = found.join(F.broadcast(grids), kept).groupBy(*grid).agg(F.count("*").alias("cost"), F.countDistinct(F.when(F.col("hit"), F.col("query_id"))).alias("hits"))
    df = grids.join(met, list(grid), "left").select(*grid, F.coalesce("cost", F.lit(0)).alias("cost"), F.round(F.coalesce("hits", F.lit(0)) / F.lit(max(questions, 1)), 6).alias("gain"))
    best = df.agg(F.min(F.struct((F.col("gain") < floor).alias("below"), (-F.col("gain")).alias("loss"), "cost", *grid)).alias("b")).select(*(F.col(f"b.{k}").alias(k) for k in grid)).withColumn("winner", F.lit(True))
    return df.join(F.broadcast(best), list(grid), "left").withColumn("winner", F.coalesce("winner", F.lit(False)))  # one row


def coverage(answer: Column, phrases: Column, plain: bool = False) -> Column:
    """The share of phrases that an answer covers: as a whole, or by 70 % (banker's rounding, at least one) of its first eight words of three letters.

    Words may stand within others.  Phrases under four characters, or without such
    a word, are not asked for; if none is, all is covered.  `plain`: the answer is `text.matchable` already.
    """
    words = lambda f: F.slice(F.filter(F.split(f, " "), lambda t: F.length(t) > 2), 1, 8)
    given = F.transform(F.transform(F.coalesce(phrases, F.array().cast(EMPTY)), text.matchable), lambda f: F.struct(f.alias("f"), words(f).alias("words")))
    asked = F.filter(given, lambda x: (F.length(x["f"]) >= 4) & (F.size(x["words"]) > 0))
    need = lambda x: F.greatest(F.lit(1), F.bround(F.size(x["words"]) * F.lit(0.7)).cast("int"))
    hit = lambda a, x: F.contains(a, x["f"]) | (F.size(F.filter(x["words"], lambda w: F.contains(a, w))) >= need(x))
    share = lambda v: F.when(F.size(v["asked"]) == 0, 1.0).otherwise(F.size(F.filter(v["asked"], lambda x: hit(v["a"], x))) / F.size(v["asked"]))
    return text.once(F.struct((answer if plain else text.matchable(answer)).alias("a"), asked.alias("asked")), share)


def leaks(answer: Column, countries: Column, allowed: Column, plain: bool = False) -> Column:
    """Countries that an answer names and should not; `plain` as in `coverage`."""
    a = F.concat(F.lit(" "), answer if plain else text.matchable(answer), F.lit(" "))
    named = lambda v: F.filter(v["countries"], lambda c: F.contains(v["a"], F.concat(F.lit(" "), text.matchable(c), F.lit(" "))) & ~F.array_contains(v["allowed"], c))
    return text.once(F.struct(a.alias("a"), countries.alias("countries"), allowed.alias("allowed")), named)


def verdict(answer: Column, covered: Column, leaked: Column, compare: Column) -> Column:
    """N/A, FAIL, PARTIAL or PASS by refusal, leaks outside comparisons, and coverage."""
    return (
        F.when(answer.isNull(), "N/A").when(predicates.refusal(answer), "FAIL").when((F.size(leaked) > 0) & ~compare, F.when(covered < 0.5, "FAIL").otherwise("PARTIAL"))
        .when(covered >= 0.75, "PASS").when(covered >= 0.4, "PARTIAL").otherwise("FAIL")
    )


def verdict_table(graded: DataFrame, key: str) -> DataFrame:
    """Verdicts by key, the pass rate of what was graded, and a place by FAIL + half of PARTIAL, the worst first."""
    n = lambda s: F.count_if(F.col("verdict") == s)
    t = graded.groupBy(key).agg(n("PASS").alias("passed"), n("PARTIAL").alias("partly"), n("FAIL").alias("failed"), n("N/A").alias("ungraded"), F.avg(F.when(F.col("verdict") != "N/A", (F.col("verdict") == "PASS").cast("int"))).alias("pass_rate"))
    return t.withColumn("weight", F.col("failed") + 0.5 * F.col("partly")).withColumn("place", F.expr(f"row_number() OVER (ORDER BY failed + 0.5 * partly DESC, passed, {key})"))


def same_package(a: Column, b: Column) -> Column:
    """Whether two names mean one package: one within the other, or half of the shorter one's words in common."""
    x, y = text.matchable(a), text.matchable(b)
    s, t = text.match_tokens(a), text.match_tokens(b)
    enough = F.size(F.array_intersect(s, t)) >= F.floor((F.least(F.size(s), F.size(t)) + 1) / 2)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x) | ((F.least(F.size(s), F.size(t)) > 0) & enough))


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id) of names (id, name) that share enough words: joined on words, so that only names with one in common meet."""
    words = lambda d, side: d.select(F.col("id").alias(f"{side}_id"), F.size(text.match_tokens(F.col("name"))).alias(f"{side}_n"), F.explode(text.match_tokens(F.col("name"))).alias("word"))
    both = words(left, "left").join(words(right, "right"), "word").groupBy("left_id", "right_id", "left_n", "right_n").agg(F.count("*").alias("shared"))
    return both.filter(F.col("shared") >= F.floor((F.least("left_n", "right_n") + 1) / 2)).select("left_id", "right_id")


def plain(c: Column) -> Column:
    """Lower-case letters and digits, all else one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def telling(c: Column) -> Column:
    """The distinct words of a plain name that tell packages apart."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda w: (F.length(w) > 2) & ~w.isin(*config.PACKAGE_STOPS)))


def same_package(expected: Column, found: Column) -> Column:
    """Whether one name is in the other, or they share most of the shorter one's telling words; an empty name is none."""
    e, f = plain(expected), plain(found)
    et, ft = telling(e), telling(f)
    shared = F.size(F.array_intersect(et, ft)) >= F.greatest(F.lit(1), F.floor((F.least(F.size(et), F.size(ft)) + 1) / 2))
    return (e != "") & (f != "") & (F.contains(f, e) | F.contains(e, f) | ((F.size(et) > 0) & (F.size(ft) > 0) & shared))


def same_service(expected: Column, found: Column) -> Column:
    """Whether one name is in the other, or both have a word of one family."""
    e, f = plain(expected), plain(found)
    family = F.lit(False)
    for words in config.SERVICE_FAMILIES:
        pattern = "|".join(words)
        family = family | (e.rlike(pattern) & f.rlike(pattern))
    return (e != "") & (f != "") & (F.contains(f, e) | F.contains(e, f) | family)


def failures(cases: DataFrame, found: DataFrame) -> DataFrame:
    """(case_id, bucket): why cases (case_id, service, package, answer) failed, by their first three rows (case_id, rank, service, package, section).

    Nothing found; another service; another package, at least in the first
    place; the right package with a full answer from several sections, with one narrow section
    alone, or with too little.
    """
    named = found.filter(F.col("rank") <= 3).select("case_id", "rank", F.col("service").alias("found_service"), F.col("package").alias("found_package"), "section")
    both = named.join(cases.select("case_id", "service", "package"), "case_id")
    both = both.withColumn("right", same_package(F.col("package"), F.col("found_package"))).withColumn("near", F.col("right") | same_service(F.col("service"), F.col("found_service")))
    root = F.lower(F.trim(F.substring_index(F.coalesce("section", F.lit("")), ">", 1)))
    top = both.groupBy("case_id").agg(
        F.min_by("right", "rank").alias("first"), F.max("right").alias("any"), F.max("near").alias("any_near"), F.lower(F.coalesce(F.min_by("section", "rank"), F.lit(""))).alias("section"),
        F.countDistinct(F.when(F.col("right") & (root != ""), root)).alias("sections"),
    )
    several = F.col("sections") >= 2
    bucket = (
        F.when(F.col("first").isNull(), "no_retrieval").when(~F.col("any_near") & ~F.col("any"), "cross_service_bleed").when(~F.col("first"), "cross_package_bleed")
        .when(several & (F.length(plain(F.col("answer"))) > 80), "correct_retrieval_wrong_answer").when(F.col("section").isin(*config.NARROW_SECTIONS) & ~several, "wrong_section_right_package").otherwise("right_chunk_incomplete")
    )
    return cases.select("case_id", "answer").join(top, "case_id", "left").select("case_id", bucket.alias("bucket"))


def most_common(df: DataFrame, column: str, n: int = 12, least: int = 1) -> DataFrame:
    """The n most frequent values that occur `least` times or more; ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), column).limit(n)


def run(cases: DataFrame, retrieve: Callable[[DataFrame], DataFrame], answer: Callable[[DataFrame, DataFrame], DataFrame] | None = None, k: int = 5) -> DataFrame:
    """Cases (case_id, query, refs, needles, must, forbid, tags) with hit, recall, included and forbidden_ok.

    `retrieve` gives (case_id, rank, url, text) for (case_id, query); `answer` (case_id,
    answer) for both, and without it what is said of answers is null.
    """
    found = retrieve(cases.select("case_id", "query"))
    scored = cases.join(hit_at_k(cases, found, k), "case_id").join(context_recall(cases, found, k), "case_id")
    if answer is None:
        return scored.select("*", F.lit(None).cast("double").alias("included"), F.lit(None).cast("double").alias("forbidden_ok"))
    return scored.join(answer_measures(cases, answer(cases.select("case_id", "query"), found)), "case_id")
