"""Events of runs: cost and time, rates, and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cost_rollup(events: DataFrame, run: str, event: str, call: str, cost: str, payload: str, duration_path: str) -> DataFrame:
    """(run, calls, cost, duration): the run's calls, the sum of their cost (rounded to cents) and of the whole-number durations in their payload."""
    c = events.where(F.col(event) == call)
    d = F.get_json_object(payload, duration_path)
    return c.groupBy(run).agg(F.count("*").alias("calls"), F.round(F.sum(cost), 2).alias("cost"), F.coalesce(F.sum(F.when(d.rlike(r"^-?\d+$"), d.try_cast("long"))), F.lit(0)).alias("duration"))


def outcome_rates(events: DataFrame, run: str, event: str, bad: str, limit: float = 0.25) -> DataFrame:
    """(run, events, bad, rate, failed): share of bad events and whether it is above the limit."""
    g = events.groupBy(run).agg(F.count("*").alias("events"), F.count_if(F.col(event) == bad).alias("bad"))
    return g.select(run, "events", "bad", F.round(F.col("bad") / F.col("events"), 6).alias("rate"), (F.col("bad") / F.col("events") > limit).alias("failed"))


def pair_delta(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, delta): absolute difference of a value between two runs over the same keys; null where either lacks it."""
    return a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full").select(key, F.abs(F.col("_a") - F.col("_b")).alias("delta"))


MARKDOWN_SPECIAL = r"\`*_{}[]<>()#+-.!|"


def escape_markdown(text: Column) -> Column:
    """Backslashes before Markdown's special characters."""
    return F.regexp_replace(text, r"([\\`*_{}\[\]<>()#+\-.!|])", r"\\$1")


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def money(n: Column) -> Column:
    """Whole number with commas between thousands."""
    return F.format_number(n, 0)


# The least actions of a full plan, and the share of failed plans that fails a corpus.
FULL_PLAN, MOST_FAILED = 3, 0.25


def plan_status(actions: Column, failed: Column, cascade: Column) -> Column:
    """'ok' from three actions on, 'degraded' with fewer, 'skipped' where an earlier stage failed, else 'failed'."""
    return F.when(~failed & (actions >= FULL_PLAN), "ok").when(~failed & (actions > 0), "degraded").when(failed & cascade, "skipped").otherwise("failed")


def corpus_summary(events: DataFrame, run: str, event: str, value: str, payload: str) -> DataFrame:
    """One row over all runs: reports, plans by status, drops and retries, cost and latency, and whether too many plans failed.

    Of an event table: purchases are actions, clicks drops, views retries, errors failures; a run with a signup and no
    purchase but errors counts as cascaded.  Skipped runs count on neither side of the share of failures.  No events give no row.
    """
    n = lambda e: F.count_if(F.col(event) == e)
    whole = F.get_json_object(payload, "$.k")
    per = events.groupBy(run).agg(
        n("purchase").alias("actions"), n("click").alias("drops"), n("view").alias("retries"), n("error").alias("errors"), n("signup").alias("signups"),
        F.coalesce(F.sum(F.when(whole.rlike(r"^-?\d+$"), whole.try_cast("long"))), F.lit(0)).alias("latency"), F.round(F.sum(F.col(value)), 2).alias("cost"),
    )
    failed = (F.col("actions") == 0) & (F.col("errors") > 0)
    per = per.withColumn("status", plan_status(F.col("actions"), failed, F.col("signups") > 0))
    is_ = lambda s: F.count_if(F.col("status") == s)
    ran = F.count("*") - is_("skipped")
    out = per.agg(
        F.count("*").alias("reports"), *[is_(s).alias(s) for s in ("ok", "degraded", "skipped", "failed")], F.sum("drops").alias("drops"), F.sum("retries").alias("retries"),
        F.round(F.sum("cost"), 2).alias("cost"), F.round(F.avg("latency"), 4).alias("avg_latency"), F.max("latency").alias("max_latency"), F.coalesce(is_("failed") / F.nullif(ran, F.lit(0)) > MOST_FAILED, F.lit(False)).alias("too_many_failed"),
    )
    return out.where("reports > 0")
