"""Gates of an estimate - sources, currency, period, range - and the ranks of confidence in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .market import MONTHLY

TIERS = ["Low", "Medium", "High"]


def estimate_gates(estimates: DataFrame, inputs: DataFrame) -> DataFrame:
    """(estimate_id, failure, currency, period_mismatch, midpoint, kept, dropped) of each estimate.

    estimates: estimate_id, cv_id, low, high, currency, period, urls array<string>; inputs: cv_id, url.  An estimate
    keeps the URLs, repeats included, that were among its CV's inputs.  The first failure counts: no such source, a
    currency that isn't three capitals once trimmed and in capitals, low not below high.  A period that isn't the
    currency's usual one is only marked.  The midpoint, rounded down, stands where nothing failed.
    """
    e = estimates.withColumn("currency", F.upper(F.trim(F.coalesce("currency", F.lit("")))))
    urls = inputs.where("url is not null").select("cv_id", "url").distinct().withColumn("hit", F.lit(1))
    # Only the URLs themselves meet the inputs; the estimates are joined by their id.
    found = e.select("estimate_id", "cv_id", F.explode("urls").alias("url")).join(urls, ["cv_id", "url"]).groupBy("estimate_id").agg(F.sum("hit").alias("kept"))
    e = e.join(found, "estimate_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)).cast("int"))
    failure = (
        F.when(F.col("kept") == 0, "no_verifiable_sources").when(~F.col("currency").rlike(r"^[A-Z]{3}$"), "invalid_currency_shape").when(F.coalesce(F.col("low") >= F.col("high"), F.lit(True)), "invalid_range")
    )
    usual = F.when(F.col("currency").isin(MONTHLY), "month").otherwise("year")
    size = F.greatest(F.coalesce(F.size("urls"), F.lit(0)), F.lit(0))
    return e.select(
        "estimate_id", failure.alias("failure"), "currency", F.coalesce(F.col("period") != usual, F.lit(True)).alias("period_mismatch"),
        F.when(failure.isNull(), F.expr("cast(floor((low + high) / 2) as bigint)")).alias("midpoint"), "kept", (size - F.col("kept")).alias("dropped"),
    )


def _rank(tier: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier)


def _tier(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in TIERS]), (rank - 1).cast("int"))


def capped_tier(model: Column, rubric: Column) -> Column:
    """The model's tier, lowered to that of its sources where these say something; never raised."""
    return F.when(rubric.isNull() | (_rank(rubric) >= _rank(model)), model).otherwise(rubric)


def cv_floor(dropped: Column, role_resolved: Column, located: Column, provenance: Column) -> Column:
    """The highest tier that the quality of a CV allows."""
    return F.when(dropped >= 2, "Low").when((dropped == 1) | ~role_resolved, "Medium").when(~located, "Medium").when(provenance == "default", "Medium").otherwise("High")


def final_tier(salary: Column, floor: Column) -> Column:
    """The lower of both; null where either is."""
    return F.when(salary.isNotNull() & floor.isNotNull(), _tier(F.least(_rank(salary), _rank(floor))))
