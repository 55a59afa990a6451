"""Queries of the general training-data operators: intervals (p3), units (p4) and timestamps (p5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, timestamps, units
from ..session import table


def _p3_found(spark, d):
    return intervals.employment_periods(table(spark, d, "employer_entries"))


def _p3_recorded(spark, d):
    """Periods and gaps of the recorded months alone."""
    e = table(spark, d, "employer_entries").where("start_months is not null")
    rows = e.select("cv_id", "start_months", F.least(F.coalesce("end_months", F.lit(24317)), F.lit(24317)).alias("end_months"))
    return intervals.merge_intervals(rows, "cv_id", "start_months", "end_months")


def _pay_tables(spark, d):
    return [table(spark, d, t) for t in ("search_results", "market_specs", "market_ref", "fx_rates", "pay_periods")]


def _p4_found(spark, d):
    return units.yearly_euros(*_pay_tables(spark, d))


def _p4_unit_segments(spark, d):
    """Level segments of every query text's pay history, as if all units were the market's own."""
    return units.unit_segments(units.read_pay(*_pay_tables(spark, d)).select("source", "day", (F.col("high") * F.col("rate")).alias("v")))


def _p5_found(spark, d):
    return timestamps.entry_dates(table(spark, d, "employer_entries"))


def _p4_decisions(spark, d):
    return units.unit_decisions(*_pay_tables(spark, d))


def _p5_decisions(spark, d):
    return timestamps.reading_decisions(table(spark, d, "employer_entries"))


QUERIES = {"p3_found": _p3_found, "p3_recorded": _p3_recorded, "p4_found": _p4_found, "p4_unit_segments": _p4_unit_segments, "p4_decisions": _p4_decisions, "p5_found": _p5_found, "p5_decisions": _p5_decisions}

SQL = {
    "p3_recorded": """WITH e AS (SELECT DISTINCT cv_id, start_months AS s, least(coalesce(end_months, 24317), 24317) AS e FROM employer_entries WHERE start_months IS NOT NULL AND cv_id IS NOT NULL), v AS (SELECT * FROM e WHERE s < e),
w AS (SELECT *, max(e) OVER (PARTITION BY cv_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM v), i AS (SELECT *, sum(CASE WHEN seen IS NULL OR s > seen THEN 1 ELSE 0 END) OVER (PARTITION BY cv_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM w),
p AS (SELECT cv_id, min(s) AS s, max(e) AS e FROM i GROUP BY cv_id, island), g AS (SELECT cv_id, e AS s, lead(s) OVER (PARTITION BY cv_id ORDER BY s) AS e FROM p)
SELECT cv_id, 'period' AS kind, CAST(s AS BIGINT) AS start_months, CAST(e AS BIGINT) AS end_months FROM p UNION ALL SELECT cv_id, 'gap', CAST(s AS BIGINT), CAST(e AS BIGINT) FROM g WHERE e IS NOT NULL""",
}
