"""Labels, evidence and roles of a profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compose, each, fold, normalised, squeeze, strip
from .sections import anchorable
from .verify import quote_exists, source_index

# Skill labels with their words; soft signals with theirs, a star for any ending.
SKILLS = [
    ("Python", "python"), ("SQL", "sql|postgresql|mysql|bigquery|snowflake"), ("PyTorch", "pytorch"), ("TensorFlow", "tensorflow"), ("scikit-learn", "scikit-learn|sklearn"),
    ("pandas", "pandas"), ("Spark", "spark|pyspark|databricks"), ("Airflow", "airflow"), ("dbt", "dbt"), ("Docker", "docker"), ("Kubernetes", "kubernetes"), ("Kafka", "kafka"),
    ("MLflow", "mlflow"), ("LightGBM", "lightgbm"), ("XGBoost", "xgboost"), ("Looker", "looker"), ("Tableau", "tableau"), ("Power BI", "power bi|powerbi"), ("AWS", "aws"),
    ("Azure", "azure"), ("GCP", "gcp|google cloud"), ("Terraform", "terraform"), ("FastAPI", "fastapi"), ("LLM", "llm|large language model|large language models"),
    ("RAG", "rag|retrieval augmented"), ("vector databases", "vector database|vector databases"),
]
SOFT_SIGNALS = [
    ("leadership", "led|lead|managed|managed two|řídil|řídila"), ("mentorship", "mentor*|coached|trained|kouč*|školil"),
    ("stakeholder communication", "stakeholder*|executive*|presented|communicated|prezentoval*"), ("cross-team work", "cross-team|cross functional|cross-functional|napříč týmy"),
    ("ownership", "owned|ownership|accountable|zodpověd*|vlastnil"),
]
# Weights of the evidence fields.
EVIDENCE_WEIGHTS = {"experience": 3, "education": 2, "skills": 1, "soft_signals": 1}
# Words of seniority with band and whether they manage, and role nouns; accents folded.
SENIORITY = [
    ("junior", "junior", False), ("jr", "junior", False), ("senior", "senior", False), ("sr", "senior", False), ("staff", "staff", False), ("principal", "staff", False), ("lead", "senior", False),
    ("head of", "head", True), ("head", "head", True), ("director of", "director", True), ("director", "director", True), ("vp", "director", True), ("chief", "director", True),
    ("manager", "senior", True), ("manazer", "senior", True), ("vedouci", "head", True), ("reditel", "director", True),
]
ROLE_NOUNS = "scientist engineer analyst developer consultant analytik vyvojar".split()
DENIED_HEADLINES = ["member of staff", "data gardener", "founding engineer", "ai whisperer"]
BANDS = ["junior", "mid", "senior", "staff", "head", "director"]


def needle(words: str) -> str:
    """Pattern of a label's words, bounded by what is neither letter, digit nor underscore."""
    parts = [w.replace(".", r"\.").replace("*", r"[\p{L}\p{N}_]*") for w in words.split("|")]
    return r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(parts) + r")(?:[^\p{L}\p{N}_]|$)"


def labels(low: Column, groups: list[tuple[str, str]]) -> Column:
    """Labels whose words occur in a composed lower-case text, in the groups' order."""
    # Most words are absent, which a plain search tells faster than the bounded pattern.
    there = lambda words: reduce(lambda a, b: a | b, [low.contains(w.rstrip("*")) for w in words.split("|")])
    return F.array_compact(F.array(*[F.when(there(words) & low.rlike(needle(words)), F.lit(label)) for label, words in groups]))


def salvage(df: DataFrame, key: str, text: str, claims: DataFrame | None = None) -> DataFrame:
    """(key, kind, pos, quote, found): lines that stand in for missing skills and soft signals.

    Per kind that the kept claims (key, field, anchor_quote) don't have, the first anchorable line with one of its
    words whose quote isn't used yet and verifies in the text; the second kind doesn't take the first one's line.
    Without claims both kinds are missing.
    """
    ls = anchorable(df, key, text).withColumn("low", F.lower(compose(F.col("quote"))))
    ls = ls.select(key, "pos", "quote", normalised(F.col("quote")).alias("_n"), labels(F.col("low"), SKILLS).alias("skills"), labels(F.col("low"), SOFT_SIGNALS).alias("soft"))
    hit = lambda col: F.when(F.size(col) > 0, F.struct("pos", "quote", "_n", F.array_join(F.slice(F.col(col), 1, 4), ", ").alias("found")))
    # One pass: a document's lines meet once, and the choices come from its lines with words, in order.
    per = ls.groupBy(key).agg(F.array_sort(F.collect_list(hit("skills"))).alias("skills"), F.array_sort(F.collect_list(hit("soft"))).alias("softs"))
    per = per.where((F.size("skills") > 0) | (F.size("softs") > 0)).join(df.select(key, normalised(F.col(text)).alias("_t")), key)
    stands = lambda xs: F.filter(xs, lambda x: quote_exists(x["_n"], F.col("_t")))
    per = per.select(key, stands("skills").alias("skills"), stands("softs").alias("softs"))
    if claims is not None:
        had = claims.where("anchor_quote is not null").groupBy(key).agg(
            F.collect_set(normalised(F.col("anchor_quote"))).alias("_used"), F.bool_or(F.col("field") == "skills").alias("_sk"), F.bool_or(F.col("field") == "soft_signals").alias("_so")
        )
        per = per.join(had, key, "left")
    else:
        per = per.withColumns({"_used": F.array().cast("array<string>"), "_sk": F.lit(False), "_so": F.lit(False)})
    fresh = lambda xs: F.filter(xs, lambda x: ~F.array_contains(F.coalesce("_used", F.array().cast("array<string>")), x["_n"]))
    per = per.withColumn("skill", F.when(~F.coalesce("_sk", F.lit(False)), F.try_element_at(fresh("skills"), F.lit(1))))
    unused = F.filter(fresh("softs"), lambda x: F.col("skill").isNull() | (x["_n"] != F.col("skill._n")))
    soft = F.when(~F.coalesce("_so", F.lit(False)), F.try_element_at(unused, F.lit(1)))
    both = F.array(F.struct(F.lit("skills").alias("kind"), F.col("skill").alias("p")), F.struct(F.lit("soft_signals").alias("kind"), soft.alias("p")))
    return each(per, [key], both, "c").where("c.p is not null").select(key, "c.kind", "c.p.pos", "c.p.quote", "c.p.found")


def evidence_score(claims: DataFrame) -> DataFrame:
    """(cv_id, score): every distinct quote counts once, with its best field's weight."""
    weight = F.coalesce(*[F.when(F.col("field") == k, F.lit(v)) for k, v in EVIDENCE_WEIGHTS.items()], F.lit(0))
    keyed = claims.where("anchor_quote is not null").select("cv_id", F.replace(F.lower(squeeze(compose(F.col("anchor_quote")))), F.lit("ß"), F.lit("ss")).alias("k"), weight.alias("w"))
    return keyed.groupBy("cv_id", "k").agg(F.max("w").alias("w")).groupBy("cv_id").agg(F.sum("w").cast("int").alias("score"))


def classify(title: Column) -> Column:
    """struct(band, management) by the longest word of seniority present, else mid for a role noun, else null."""
    t = fold(title)
    at = lambda w: t.rlike(rf"(?:^|[^a-z0-9_]){w}(?:[^a-z0-9_]|$)")
    hit = None
    for w, b, m in [*sorted(SENIORITY, key=lambda x: -len(x[0])), ("(?:" + "|".join(ROLE_NOUNS) + ")", "mid", False)]:
        found = F.struct(F.lit(b).alias("band"), F.lit(m).alias("management"))
        hit = F.when(at(w), found) if hit is None else hit.when(at(w), found)
    return hit.otherwise(F.struct(F.lit(None).cast("string").alias("band"), F.lit(None).cast("boolean").alias("management")))


def rank(band: Column) -> Column:
    """0 for null, else the band's place from 1."""
    return F.coalesce(F.array_position(F.array(*[F.lit(b) for b in BANDS]), band), F.lit(0)).cast("int")


def title_shaped(title: Column) -> Column:
    """A classifiable title: not blank or denied, at most 90 characters and 8 words, no sentence punctuation."""
    t = squeeze(title)
    n = F.size(F.regexp_extract_all(t, F.lit(r"[0-9A-Za-z\x{c0}-\x{17e}&]+"), F.lit(0)))
    return (t != "") & (F.length(t) <= 90) & ~fold(t).isin(DENIED_HEADLINES) & ~t.rlike("[.,;:!?]") & (n <= 8) & classify(t)["band"].isNotNull()


def tagline(title: Column) -> Column:
    return title.rlike("[|@&]")


_AT = r"(?i)\s+at\s+"
_DURATION = r"(?iU)\b\d+\s+(?:years?|months?|tenure|let|měsíc|měsíce|měsíců|mesic|mesice|mesicu)\b.*$"
MANAGEMENT = [w for w, _, m in SENIORITY if m]


def title_prefixes(text: Column) -> Column:
    """Distinct candidates for a title in an experience line: before ' at ' and whole, then the same of what stands before the first comma."""
    whole = squeeze(text)
    head = F.element_at(F.split(whole, ","), 1)
    clean = lambda x: squeeze(F.regexp_replace(F.regexp_replace(x, _DURATION, ""), "^[ –—,-]+|[ –—,-]+$", ""))
    cut = lambda x: F.element_at(F.split(x, _AT), 1)
    return F.array_distinct(F.filter(F.transform(F.array(cut(whole), whole, cut(head), head), clean), lambda x: x != ""))


def has_management_word(title: Column) -> Column:
    return fold(title).rlike(r"(?:^|[^a-z0-9_])(?:" + "|".join(sorted(MANAGEMENT, key=lambda w: (-len(w), w))) + r")(?:[^a-z0-9_]|$)")


def denied(title: Column) -> Column:
    return F.trim(fold(title)).isin(DENIED_HEADLINES)


def title_candidates(titles: Column) -> Column:
    """array<struct<title, band, management, rank>> of all title-shaped candidates of an array of experience lines, in order."""
    found = F.filter(F.flatten(F.transform(titles, title_prefixes)), title_shaped)
    # In two steps, so that a title is classified once.
    classed = F.transform(found, lambda t: F.struct(t.alias("title"), classify(t).alias("c")))
    return F.transform(classed, lambda x: F.struct(x["title"].alias("title"), x["c"]["band"].alias("band"), x["c"]["management"].alias("management"), rank(x["c"]["band"]).alias("rank")))


def floored(band: Column, management: Column, years: Column, led: Column) -> Column:
    """A band raised by tenure - eight years are senior, four mid - and to staff after eight for a non-manager who has led; never lowered."""
    at = lambda b: F.lit(BANDS.index(b))
    floor = F.when(years >= 8, at("senior")).when(years >= 4, at("mid")).otherwise(at("junior"))
    staff = F.when(~management & (years >= 8) & led, at("staff")).otherwise(at("junior"))
    return F.get(F.array(*[F.lit(b) for b in BANDS]), F.greatest(rank(band) - 1, floor, staff))


def normalise_roles(rows: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(cv_id, canonical_role, band, management, source) of rows(cv_id, detected_role, years, titles array<string> in CV order).

    A classifiable headline stands ('market_token'), unless it ranks no higher than a mid role and the current
    title - the first title-shaped candidate - does ('experience_recovery').  A denied headline or a tagline takes the
    highest title ('named_headline', 'tagline_shape'; ties to the first).  What is left is 'unrecognized', mid, and
    takes a verdict (cv_id, canonical_role, band, management, confidence) of confidence 0.6 or more
    ('llm_fallback').  All bands are floored by years and management history.  Null roles count as blank, null
    years as 0, null titles as none.
    """
    r = rows.select("cv_id", F.coalesce("detected_role", F.lit("")).alias("_role"), F.coalesce("years", F.lit(0)).alias("_years"), F.coalesce("titles", F.array().cast("array<string>")).alias("_titles"))
    r = r.withColumn("_d", strip(F.col("_role"))).withColumn("_cands", title_candidates(F.filter("_titles", lambda t: t.isNotNull())))
    r = r.withColumns({"_c": classify(F.col("_d")), "_denied": denied(F.col("_d")), "_tag": tagline(F.col("_d")), "_current": F.get("_cands", F.lit(0))})
    r = r.withColumn("_best", F.array_max(F.transform("_cands", lambda c, i: F.struct(c["rank"].alias("rank"), (-i).alias("i")))))
    r = r.withColumn("_peak", F.get("_cands", -F.col("_best.i"))).withColumn("_led", F.exists("_cands", lambda c: has_management_word(c["title"])))
    named = F.col("_c.band").isNotNull() & ~F.col("_denied") & ~F.col("_tag")
    low = rank(F.col("_c.band")) <= 1 + BANDS.index("mid")
    recovered = named & low & F.coalesce(F.col("_current.rank") > rank(F.col("_c.band")), F.lit(False))
    peak = ~named & (F.col("_denied") | F.col("_tag")) & F.col("_peak").isNotNull()
    pick = lambda a, b, c, d: F.when(recovered, a).when(named, b).when(peak, c).otherwise(d)
    r = r.withColumns({
        "source": pick(F.lit("experience_recovery"), F.lit("market_token"), F.when(F.col("_denied"), "named_headline").otherwise("tagline_shape"), F.lit("unrecognized")),
        "canonical_role": pick(F.lower("_current.title"), F.lower("_d"), F.lower("_peak.title"), F.when(F.col("_d") == "", "unknown").otherwise(F.lower("_d"))),
        "band": pick(F.col("_current.band"), F.col("_c.band"), F.col("_peak.band"), F.lit("mid")),
        "management": pick(F.col("_current.management"), F.col("_c.management"), F.col("_peak.management"), F.lit(False)),
    })
    if verdicts is not None:
        v = verdicts.where("confidence >= 0.6 and canonical_role is not null and band is not null").groupBy("cv_id").agg(F.min(F.struct("canonical_role", "band", "management")).alias("_v"))
        r = r.join(v, "cv_id", "left").withColumn("_use", (F.col("source") == "unrecognized") & F.col("_v").isNotNull())
        take = lambda a, b: F.when(F.col("_use"), a).otherwise(F.col(b))
        r = r.withColumns({"canonical_role": take(F.lower(strip(F.col("_v.canonical_role"))), "canonical_role"), "band": take(F.col("_v.band"), "band"), "management": take(F.coalesce("_v.management", F.lit(False)), "management"), "source": take(F.lit("llm_fallback"), "source")})
    return r.select("cv_id", "canonical_role", floored(F.col("band"), F.col("management"), F.col("_years"), F.col("_led")).alias("band"), "management", "source")


LEAST_EVIDENCE = 3


def evidence_gate(scores: DataFrame, cvs: DataFrame) -> DataFrame:
    """(cv_id, score, enough): every CV with the score of its evidence, 0 where it has none, and whether that is LEAST_EVIDENCE or more."""
    return cvs.select("cv_id").distinct().join(scores, "cv_id", "left").select("cv_id", F.coalesce("score", F.lit(0)).alias("score"), (F.coalesce("score", F.lit(0)) >= LEAST_EVIDENCE).alias("enough"))


def override_years(stated: Column, counted: Column) -> Column:
    """struct(years, changed): the years counted from the dates where there are any, else the stated ones; changed if they differ by one or more."""
    return F.struct(F.coalesce(counted, stated).alias("years"), F.coalesce(F.abs(counted - stated) >= 1, F.lit(False)).alias("changed"))


def titles_in_order(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """(cv_id, titles): the texts of a CV's experience claims in the order their quotes stand in it, those not found last."""
    c = claims.where("field = 'experience'").select("cv_id", "candidate_id", "attempt", "ord", F.col("text").alias("title"), "anchor_quote").dropDuplicates(["candidate_id"])
    at = source_index(F.coalesce("anchor_quote", F.lit("")), F.col("text"))
    placed = c.join(documents.select("cv_id", "text"), "cv_id").select("cv_id", F.struct(at.alias("at"), "attempt", "ord", "candidate_id", "title").alias("x"))
    return placed.groupBy("cv_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["title"]).alias("titles"))
