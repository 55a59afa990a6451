"""Recommended actions: phrase and employer filters in their order, pooling, and likeness to boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import compose, fold, ngrams, normalised, squeeze, words
from .tenure import PRESENT, with_work_lines
from .verify import quote_span

# Phrases that spoil an action, in the order they are reported, and softeners.
BANNED = ["phd", "found a startup", "improve communication", "learn more", "network more"]
SOFTENERS = r"(?:^|[^\p{L}\p{N}_])(?:consider|explore|look into)(?:[^\p{L}\p{N}_]|$)"
SHINGLE, LIKENESS = 4, 0.6


def banned_phrase(text: Column) -> Column:
    """First banned phrase in the text once lower-cased and without ASCII punctuation; null if none."""
    t = squeeze(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", ""))
    out = None
    for p in BANNED:
        hit = t.rlike(r"(?:^|[^\p{L}\p{N}_])phd") if p == "phd" else F.instr(t, p) > 0
        out = F.when(hit, F.lit(p)) if out is None else out.when(hit, F.lit(p))
    return out


def drop_reason(what: Column, mechanism: Column) -> Column:
    """The first reason against an action: a banned phrase in either text, else a softener in `what`; null if it stands."""
    banned = banned_phrase(F.concat_ws(" ", what, mechanism))
    return F.when(banned.isNotNull(), F.concat(F.lit("banned:"), banned)).when(F.lower(what).rlike(SOFTENERS), "softener")


def match_form(text: Column) -> Column:
    """Folded letters and digits, everything else one blank."""
    return squeeze(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " "))


def hint_segments(headers: Column) -> Column:
    """What an employer may be called: the parts of each header between dashes and the whole header, in match form; blanks are no name."""
    parts = lambda h: F.concat(F.split(h, r"(?U)\s+-\s+|[—–]"), F.array(h))
    return F.filter(F.transform(F.flatten(F.transform(F.filter(headers, lambda h: h.isNotNull()), parts)), match_form), lambda s: s != "")


def names_match(a: Column, b: Column) -> Column:
    """Whether the words of one name stand next to each other in the other."""
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return F.contains(pad(a), pad(b)) | F.contains(pad(b), pad(a))


def _violation(setting: Column, target: Column, t: Column, now: Column, then: Column, whole_past: Column, hinted: Column) -> Column:
    enough = F.length(F.regexp_replace(t, " ", "")) >= 2
    copied = ~F.array_contains(now, t) & F.array_contains(whole_past, t)
    is_now, is_past = F.exists(now, lambda x: names_match(t, x)), F.exists(then, lambda x: names_match(t, x))
    return (
        F.when(F.coalesce(setting != "current_employer", F.lit(True)), F.lit(None))
        .when(F.coalesce(target, F.lit("")) == "", F.when(hinted, "missing_target"))
        .when(enough & copied, "closed_employer_target").when(enough & is_now, F.lit(None)).when(enough & is_past, "closed_employer_target")
        .when(hinted, "unverified_target_employer")
    )


def with_violation(df: DataFrame, setting: str, target: str, current: str, closed: str, out: str) -> DataFrame:
    """df with `out`, why the employer an action names can't be, or null: 'missing_target', 'closed_employer_target' or 'unverified_target_employer'.

    Only actions at the current employer are checked.  current, closed: arrays of timeline headers, empty or null
    for none.
    """
    none = F.array().cast("array<string>")
    df = df.withColumns({"_cur": F.coalesce(current, none), "_past": F.coalesce(closed, none), "_tm": match_form(F.coalesce(target, F.lit("")))})
    whole = F.transform(F.filter("_past", lambda h: h.isNotNull()), match_form)
    df = df.withColumns({"_now": hint_segments(F.col("_cur")), "_then": hint_segments(F.col("_past")), "_whole": whole})
    why = _violation(F.col(setting), F.col(target), F.col("_tm"), F.col("_now"), F.col("_then"), F.col("_whole"), F.size("_cur") > 0)
    return df.withColumn(out, why).drop("_cur", "_past", "_tm", "_now", "_then", "_whole")


def filter_actions(actions: DataFrame, hints: DataFrame) -> DataFrame:
    """actions with target_employer sanitised, `reason` and `detail`: the first check an action fails, or null.

    actions: cv_id, what, mechanism, setting, target_employer, quote_found (of its anchor, existence only) and the quote itself;
    hints: cv_id, current, closed (arrays of headers).  In order: a banned phrase, a softener, an anchor that isn't
    there, an employer that can't be.  A target outside the current employer's setting is dropped without a reason.
    The detail is the phrase, the first 120 characters of the quote (null without one), or the first 40 of the target.
    """
    a = actions.withColumn("target_employer", F.when(F.col("setting") == "current_employer", F.col("target_employer"))).join(hints, "cv_id", "left")
    soft = F.regexp_extract(F.lower("what"), r"(?:^|[^\p{L}\p{N}_])(consider|explore|look into)(?:[^\p{L}\p{N}_]|$)", 1)
    a = a.withColumns({"_ban": banned_phrase(F.concat_ws(" ", "what", "mechanism")), "_soft": F.nullif(soft, F.lit("")), "_lost": ~F.coalesce("quote_found", F.lit(False))})
    a = with_violation(a, "setting", "target_employer", "current", "closed", "_off")
    first = lambda ban, soft, lost, off: F.when(F.col("_ban").isNotNull(), ban).when(F.col("_soft").isNotNull(), soft).when(F.col("_lost"), lost).otherwise(off)
    missing = F.col("_off") == "missing_target"
    reason = first("ban_phrase", "softener_phrase", "unverified_anchor", F.when(missing, "unverified_target_employer").otherwise(F.col("_off")))
    detail = first(F.col("_ban"), F.col("_soft"), F.substring("anchor_quote", 1, 120), F.when(missing, "missing_target").when(F.col("_off").isNotNull(), F.substring("target_employer", 1, 40)))
    return a.select(*actions.columns, reason.alias("reason"), detail.alias("detail"))


def employer_hints(timeline: DataFrame, experience: DataFrame, documents: DataFrame) -> DataFrame:
    """(cv_id, current, closed, source): the headers of a CV's running and closed stints; without any stint the claims near a present word.

    timeline: cv_id, pos, header, is_current; experience: cv_id, claim, anchor_quote; documents: cv_id, text.  A claim's
    surroundings reach half way to the neighbouring quotes in the work section (or the text), in normalised form;
    claims that are equal but for case and blanks count once, the first one found.
    """
    put = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "header")))), lambda x: x["header"])
    found = timeline.groupBy("cv_id").agg(put(F.col("is_current")).alias("current"), put(~F.col("is_current")).alias("closed")).withColumn("source", F.lit("timeline"))
    rest = documents.join(found.select("cv_id"), "cv_id", "left_anti")
    scope = with_work_lines(rest.select("cv_id", "text"), "text", "_w").select("cv_id", normalised(F.coalesce(F.array_join("_w", "\n"), F.col("text"))).alias("_t"))
    placed = experience.join(scope, "cv_id").withColumn("_s", quote_span(F.col("anchor_quote"), F.col("_t"))).where("_s is not null")
    spans = placed.groupBy("cv_id").agg(F.first("_t").alias("_t"), F.array_sort(F.collect_list(F.struct(F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), "claim"))).alias("_x"))

    def near(x: Column, i: Column) -> Column:
        before, after = F.get("_x", i - 1), F.get("_x", i + 1)
        begin = F.when(i > 0, F.floor((before["end"] + x["start"]) / 2)).otherwise(F.lit(0)).cast("int")
        end = F.when(after.isNotNull(), F.floor((x["end"] + after["start"]) / 2)).otherwise(F.length("_t")).cast("int")
        around = F.substring("_t", begin + 1, F.greatest(end - begin, F.lit(0)))
        return F.when(fold(around).rlike(r"(?U)\b(?:" + "|".join(PRESENT) + r")\b"), x["claim"])

    claims = spans.select("cv_id", F.array_compact(F.transform("_x", near)).alias("_c"))
    claims = claims.withColumn("_keys", F.transform("_c", lambda c: F.lower(squeeze(c))))
    once = F.filter("_c", lambda c, i: F.array_position("_keys", F.get("_keys", i)) == i + 1)
    fallback = documents.select("cv_id").distinct().join(found.select("cv_id"), "cv_id", "left_anti").join(claims.select("cv_id", once.alias("current")), "cv_id", "left")
    none = F.array().cast("array<string>")
    return found.unionByName(fallback.select("cv_id", F.coalesce("current", none).alias("current"), none.alias("closed"), F.lit("anchor_fallback").alias("source")))


ENOUGH, MOST = 3, 5


def pool(actions: DataFrame, key: str, text: str, order: list[str], k: int = MOST, attempt: str | None = None) -> DataFrame:
    """(key, rn, text): the first k distinct actions over all attempts, compared by their squeezed lower-case text.  k is the feature.

    With `attempt`, attempts after the first one that has brought the pool to ENOUGH actions don't count.
    """
    rows = actions.where(F.col(text).isNotNull()).withColumn("_k", F.lower(squeeze(compose(F.col(text)))))
    # The first of each text by an aggregate, which shrinks repeated ones before the shuffle.
    first = F.min(F.struct(*order, F.col(text).alias("_text")))
    once = rows.groupBy(key, "_k").agg(first.alias("_f"))
    ranked = once.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("_f")))
    if attempt is not None:
        full = ranked.where(F.col("rn") == ENOUGH).select(key, F.col(f"_f.{attempt}").alias("_last"))
        ranked = ranked.join(full, key, "left").where(F.col("_last").isNull() | (F.col(f"_f.{attempt}") <= F.col("_last")))
    return ranked.where(F.col("rn") <= k).select(key, "rn", F.col("_f._text").alias(text))


def plain_words(text: Column) -> Column:
    """Words of a composed text in lower case, without ASCII punctuation."""
    return words(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", ""))


def boilerplate(df: DataFrame, key: str, text: str, baseline: list[str], n: int = SHINGLE, likeness: float = LIKENESS) -> DataFrame:
    """(key, likeness, flagged): the highest Jaccard likeness of a text's n-word shingles to any baseline text.

    The baseline is a fixed list given as a parameter; its shingles are literals in the plan, so every text is
    scored in one pass without a join.  Texts under n words have likeness 0.
    """
    g = df.select(key, compose(F.col(text)).alias("t")).select(key, ngrams(plain_words(F.col("t")), n).alias("g"))
    spark: SparkSession = df.sparkSession
    base = [r[0] for r in spark.createDataFrame([(b,) for b in baseline], "b string").select(ngrams(plain_words(F.col("b")), n)).collect()]
    scores = [F.size(F.array_intersect("g", F.array(*[F.lit(x) for x in b]))) / F.size(F.array_union("g", F.array(*[F.lit(x) for x in b]))) for b in base if b]
    best = F.greatest(*scores, F.lit(0.0)) if scores else F.lit(0.0)
    best = F.when(F.size("g") > 0, best).otherwise(0.0)
    return g.select(key, F.round(best, 6).alias("likeness"), (best > likeness).alias("flagged"))
