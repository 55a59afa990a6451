"""Numbers in snippets, agreement between domains, and weighted scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fold
from .market import domain

RANGE_K = r"(?i)(?<![\w.])(\d+(?:[.,]\d+)?)\s*k?\s*(?:-|to)\s*(\d+(?:[.,]\d+)?)\s*k(?![\w.])"
NUMBER = r"(?<![\w.])(\d+(?:[.,]\d+)?\s*[kK]|\d{1,3}(?:[ .,\x{a0}]\d{3})+|\d{5,7})(?![\w.])"
MONTH = r"\b(?:monthly|per\s+month|a\s+month|/mo|/month|mesicne|mesic|month)\b"
YEAR = r"\b(?:annual|annually|yearly|per\s+year|a\s+year|/yr|/year|p\.?a\.?|rocne)\b"
LEAST = 10_000
# Weights of the score's components, in the order they are added up.
WEIGHTS = [("skills", 0.35), ("experience", 0.30), ("education", 0.20), ("soft_signals", 0.15)]


def _thousands(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double") * 1000


def snippet_numbers(text: Column) -> Column:
    """Numbers of at least 10,000: both ends of ranges in k, then the other numbers; what lies in a range counts once."""
    low, high = F.regexp_extract_all(text, F.lit(RANGE_K), F.lit(1)), F.regexp_extract_all(text, F.lit(RANGE_K), F.lit(2))
    ends = F.flatten(F.transform(F.arrays_zip(low.alias("a"), high.alias("b")), lambda p: F.array(_thousands(p["a"]), _thousands(p["b"]))))
    rest = F.regexp_extract_all(F.regexp_replace(text, RANGE_K, " "), F.lit(NUMBER), F.lit(1))
    plain = F.transform(rest, lambda t: F.when(t.rlike("[kK]$"), _thousands(F.regexp_replace(t, r"\s*[kK]$", ""))).otherwise(F.regexp_replace(t, r"\D", "").try_cast("double")))
    return F.filter(F.concat(ends, plain), lambda v: v >= LEAST)


def period_hint(text: Column) -> Column:
    """'month', 'year', 'ambiguous' when both are named, else null."""
    t = F.regexp_replace(fold(text), r"[^\x00-\x7f]", "")
    m, y = t.rlike(MONTH), t.rlike(YEAR)
    return F.when(m & y, "ambiguous").when(m, "month").when(y, "year")


def rubric(values: DataFrame, key: str, source: str, value: str, period: str) -> DataFrame:
    """(key, tier, reason, sources, comparable, spread) by how well the sources' medians agree.

    One row of `values` per number; a null value marks a source without numbers.  Blank sources are left
    out.  Medians are exact.
    """
    v = values.where(F.col(source).isNotNull() & (F.trim(source) != ""))
    per = v.groupBy(key, source).agg(
        F.median(value).alias("med"),
        F.collect_set(F.when(F.col(value).isNotNull() & (F.col(period) != "ambiguous"), F.col(period))).alias("ps"),
        F.bool_or(F.col(value).isNotNull() & (F.col(period) == "ambiguous")).alias("amb"),
    )
    mid = per.groupBy(key).agg(
        F.count("*").alias("sources"), F.count("med").alias("comparable"), F.median("med").alias("mm"), F.max("med").alias("hi"), F.min("med").alias("lo"),
        F.bool_or(F.coalesce("amb", F.lit(False)) | (F.size("ps") > 1)).alias("ambiguous"), F.size(F.array_distinct(F.flatten(F.collect_list("ps")))).alias("periods"),
    )
    # The largest distance from the median of medians is that of its highest or lowest source.
    spread = F.when((F.col("mm") > 0) & (F.col("comparable") > 0), F.greatest(F.col("hi") - F.col("mm"), F.col("mm") - F.col("lo")) / F.col("mm"))
    few, none = F.col("sources") < 2, F.col("comparable") == 0
    cases = [
        (few & none, None, "insufficient_numeric_evidence"), (few, "Low", "fewer_than_two_domains"), (F.col("ambiguous"), None, "ambiguous_period"),
        (F.col("comparable") < F.col("sources"), None, "insufficient_numeric_evidence"), (F.col("periods") > 1, None, "mixed_period"), (F.col("mm") <= 0, None, "invalid_median"),
        (spread > 0.5, "Low", "source_disagreement"), (F.col("sources") == 2, "Medium", "two_domains"), (spread >= 0.25, "Medium", "moderate_spread"),
    ]
    tier = reason = None
    for cond, t, r in cases:
        tier = F.when(cond, F.lit(t)) if tier is None else tier.when(cond, F.lit(t))
        reason = F.when(cond, F.lit(r)) if reason is None else reason.when(cond, F.lit(r))
    return mid.select(key, tier.otherwise("High").alias("tier"), reason.otherwise("three_plus_domains_agree").alias("reason"), "sources", "comparable", F.round(spread, 6).alias("spread"))


def result_values(results: DataFrame) -> DataFrame:
    """(cv_id, domain, value, period): the numbers of each search result's body; one row with a null value where it has none."""
    r = results.where("cv_id is not null").select("cv_id", "result_id", "href", "body").distinct()
    return r.select("cv_id", domain(F.col("href")).alias("domain"), F.explode_outer(snippet_numbers(F.col("body"))).alias("value"), period_hint(F.col("body")).alias("period"))


def weighted_total(components: DataFrame, key: str, name: str, score: str) -> DataFrame:
    """(key, total): the components' scores by their fixed weights, added in fixed order as DOUBLE and rounded half up; absent ones count 0."""
    per = components.groupBy(key).agg(*[F.max(F.when(F.col(name) == n, F.col(score))).alias(n) for n, _ in WEIGHTS])
    total = F.lit(0.0)
    for n, w in WEIGHTS:
        total = total + F.coalesce(F.col(n).cast("double"), F.lit(0.0)) * F.lit(w)
    return per.select(key, F.floor(total + 0.5).cast("int").alias("total"))


# Degrees as they are written, in two levels.
DOCTORATE = r"(?i)(?:^|[^\p{L}\p{N}_])(?:ph\.?\s*d\.?|doctorate|dphil|csc\.?|drsc\.?)(?:[^\p{L}\p{N}_]|$)"
MASTERS = r"(?i)(?:^|[^\p{L}\p{N}_])(?:m\.?\s*sc\.?|m\.?\s*eng\.?|master(?:['’]s|s)?|mgr\.?|ing\.|mba)(?:[^\p{L}\p{N}_]|$)"


def education_level(slices: DataFrame, key: str, section: str = "section", body: str = "body") -> DataFrame:
    """(key, floor): 86 for a doctorate in the education section, 66 for a master's, else null; no row without the section."""
    e = slices.where(F.col(section) == "education").groupBy(key).agg(F.max(F.when(F.col(body).rlike(DOCTORATE), 86).when(F.col(body).rlike(MASTERS), 66)).alias("floor"))
    return e.select(key, F.col("floor").cast("int"))


def retry_merge(scores: DataFrame, key: str, name: str, attempt: str, score: str, replaceable: str) -> DataFrame:
    """(key, name, score): the first attempt's score of each name (ties: the highest); the replaceable name takes the highest over all attempts.

    Aggregates, so a hot key shrinks before the shuffle; null scores and attempts come last.
    """
    per = scores.groupBy(key, name).agg(F.min(F.struct(F.col(attempt).isNull(), F.col(attempt), F.col(score).isNull(), (-F.col(score)).alias("n"))).alias("first"), F.max(score).alias("top"))
    return per.select(key, name, F.when(F.col(name) == replaceable, F.col("top")).otherwise(-F.col("first.n")).alias(score))


SECTION_MISSES = 2


def score_gates(attempts: DataFrame, components: DataFrame, key: str = "cv_id") -> DataFrame:
    """(key, failure, missing): whether a score stands, and the names it lacks, in order.

    attempts: key, attempt, section_misses; components: key, name of the verified components of all attempts.  More
    than SECTION_MISSES missed sections in any attempt fail the score ('section_blind'); else a missing experience
    does ('missing_experience'); other missing names count as zero.  A key without attempts gives no row.
    """
    blind = attempts.groupBy(key).agg((F.max("section_misses") > SECTION_MISSES).alias("_blind"))
    names = F.array(*[F.lit(n) for n in sorted(n for n, _ in WEIGHTS)])
    have = components.groupBy(key).agg(F.collect_set("name").alias("_have"))
    out = blind.join(have, key, "left").withColumn("_missing", F.array_except(names, F.coalesce("_have", F.array().cast("array<string>"))))
    failure = F.when(F.col("_blind"), "section_blind").when(F.array_contains("_missing", "experience"), "missing_experience")
    return out.select(key, failure.alias("failure"), F.array_join("_missing", ",").alias("missing"))
