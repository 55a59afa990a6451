"""Claims against the documents they quote: existence, overlap, and the two-phase gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import compose, content_tokens, jaccard, normalised, occurrences, squeeze, word_count
from .sections import section_key, with_slices

MIN_OVERLAP = 0.1


def quote_exists(quote: Column, text: Column) -> Column:
    """Rule on normalised forms: under six words never; six or seven words exactly once; eight or more at least once."""
    n = word_count(quote)
    hits = occurrences(text, quote)
    return F.when(n >= 8, F.coalesce(hits >= 1, F.lit(False))).when(n >= 6, F.coalesce(hits == 1, F.lit(False))).otherwise(F.lit(False))


def verify_quotes(claims: DataFrame, documents: DataFrame, sections: bool = False) -> DataFrame:
    """claims(candidate_id, cv_id, text, anchor_quote, anchor_section) with quote_found, overlap and section_missed.

    With `sections`, a quote is looked for in the slice of its section where the document has one, and in the
    whole text otherwise (section_missed).  A null quote isn't found; no content tokens give a null overlap,
    which passes.  Redelivered claims count once.
    """
    c = claims.select("candidate_id", "cv_id", "attempt", "field", "ord", F.col("text").alias("claim"), "anchor_quote", "anchor_section").dropDuplicates(["candidate_id"])
    c = c.withColumn("_q", normalised(F.col("anchor_quote")))
    # Composed once, then laid out for the join.  The exchange also keeps the step of Python out of the projections
    # above it, which Spark would otherwise evaluate inside one another.
    docs = documents.select("cv_id", compose(F.col("text")).alias("text")).repartition("cv_id")
    if sections:
        docs = with_slices(docs, "text").withColumn("slices", F.transform("slices", lambda x: F.struct(x["section"].alias("section"), squeeze(F.lower(x["body"])).alias("body"))))
    joined = c.join(docs.withColumn("_t", squeeze(F.lower("text"))).drop("text"), "cv_id", "left")
    if sections:
        own = F.try_element_at(F.filter("slices", lambda x: x["section"] == section_key(F.col("anchor_section"))), F.lit(1))["body"]
        joined = joined.withColumn("_b", own).withColumn("section_missed", F.col("anchor_section").isNotNull() & F.col("_b").isNull()).withColumn("_t", F.coalesce("_b", "_t")).drop("_b", "slices")
    else:
        joined = joined.withColumn("section_missed", F.lit(False))
    joined = joined.withColumn("quote_found", F.coalesce(quote_exists(F.col("_q"), F.col("_t")), F.lit(False)))
    return joined.withColumn("overlap", jaccard(content_tokens(F.col("claim")), content_tokens(F.col("anchor_quote")))).drop("_q", "_t")


def quote_span(quote: Column, text: Column) -> Column:
    """struct(start, end) of a quote's first place in its text, both in their normalised form; null where it isn't there."""
    n, h = normalised(quote), normalised(text)
    at = F.instr(h, n) - 1
    return F.when((n != "") & (at >= 0), F.struct(at.alias("start"), (at + F.length(n)).alias("end")))


def source_index(quote: Column, text: Column) -> Column:
    """Where a quote begins in its text, as composed and in lower case; the text's length where it isn't there, so it sorts last."""
    n, h = F.lower(compose(quote)), F.lower(compose(text))
    at = F.instr(h, n)
    return F.when(at > 0, at - 1).otherwise(F.length(h))


def gate(verified: DataFrame) -> DataFrame:
    """verified with its verdict: 'missing_quote', 'kept' (overlap passes or has no signal) or 'suspect'."""
    return verified.withColumn("verdict", F.when(~F.col("quote_found"), "missing_quote").when(F.col("overlap").isNull() | (F.col("overlap") >= MIN_OVERLAP), "kept").otherwise("suspect"))


def adjudicate(gated: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Suspects settled by judge verdicts (cv_id, suspect_ord, verdict).

    A CV's verdicts count only if there is exactly one, true or false, for each of its suspects and none besides;
    otherwise all its suspects are kept (fail open).
    """
    order = Window.partitionBy("cv_id").orderBy("field", "ord", "candidate_id")
    suspects = gated.where("verdict = 'suspect'").withColumn("suspect_ord", F.row_number().over(order) - 1)
    want = suspects.groupBy("cv_id").agg(F.count("*").alias("_want"))
    have = verdicts.groupBy("cv_id").agg(
        F.count("*").alias("_rows"), F.countDistinct(F.when(F.col("verdict").isNotNull(), F.col("suspect_ord"))).alias("_ords"), F.min("suspect_ord").alias("_lo"), F.max("suspect_ord").alias("_hi")
    )
    whole = want.join(have, "cv_id").where("_rows = _want and _ords = _want and _lo = 0 and _hi = _want - 1").select("cv_id")
    no = verdicts.join(whole, "cv_id", "left_semi").where("not verdict").select("cv_id", "suspect_ord")
    dropped = suspects.join(no, ["cv_id", "suspect_ord"]).select("candidate_id", F.lit("dropped_by_judge").alias("_final"))
    return gated.join(dropped, "candidate_id", "left").withColumn("verdict", F.coalesce("_final", F.when(F.col("verdict") == "suspect", "kept").otherwise(F.col("verdict")))).drop("_final")


def drop_counts(settled: DataFrame) -> DataFrame:
    """(cv_id, kept, existence_dropped, compat_dropped) after adjudication."""
    n = lambda v, name: F.count_if(F.col("verdict") == v).alias(name)
    return settled.groupBy("cv_id").agg(n("kept", "kept"), n("missing_quote", "existence_dropped"), n("dropped_by_judge", "compat_dropped"))


def gate_counts(gated: DataFrame) -> DataFrame:
    """Per CV how many claims each verdict got."""
    return gated.groupBy("cv_id").agg(*[F.count_if(F.col("verdict") == v).alias(n) for v, n in (("kept", "kept"), ("missing_quote", "missing_quotes"), ("suspect", "suspects"))])


def first_verified(gated: DataFrame, key: str = "cv_id", name: str = "field") -> DataFrame:
    """The first kept claim of each name over all attempts: a failed one before it doesn't count."""
    w = Window.partitionBy(key, name).orderBy("attempt", "ord", "candidate_id")
    return gated.where("verdict = 'kept'").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def component_counts(verified: DataFrame, name: str = "field") -> DataFrame:
    """(cv_id, attempt, returned, verified, dropped, section_misses) of a scoring attempt's components.

    The first component of a name whose quote stands counts; others of that name, and those whose quote doesn't
    stand, are dropped.  What follows a counted one of its name isn't looked up any more, so misses no section.
    """
    w = Window.partitionBy("cv_id", "attempt", name).orderBy("ord", "candidate_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = verified.withColumn("_done", F.coalesce(F.max(F.col("quote_found").cast("int")).over(w), F.lit(0)) == 1)
    counted = F.count_if(~F.col("_done") & F.col("quote_found"))
    return rows.groupBy("cv_id", "attempt").agg(
        F.count("*").alias("returned"), counted.alias("verified"), (F.count("*") - counted).alias("dropped"), F.count_if(~F.col("_done") & F.col("section_missed")).alias("section_misses")
    )
