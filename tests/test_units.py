import itertools

import numpy as np
import pytest

from sparkfolio.operators.units import currency_of, number, parse_pay, segment, unit_decisions, unit_segments, yearly_euros

CASES = [
    ("Praha | data analyst | 115–140 thousand a month | 832 open positions", "CZK", (115000, 140000, None, "month")),
    ("€19 500-28 000 per year is the usual range (Dublin, 2024).", "EUR", (19500, 28000, "EUR", "year")),
    ("Nástup ihned, 27 dní dovolené, mzda 4k - 4,5k €/měs., bonus 18 %.", "CZK", (4000, 4500, "EUR", "month")),
    ("0.58 – 0.72 million Ft monthly.", "HUF", (580000, 720000, "HUF", "month")),
    ("Das Gehalt liegt in Zürich bei 47'000 bis 74'000 SFr. im Jahr (2024).", "CHF", (47000, 74000, "CHF", "year")),
    ("daily rate €370 - €470.", "EUR", (370, 470, "EUR", "day")),
    ("Geboten werden rund 82 000 euro und 20 Urlaubstage, Prämie bis 5 %.", "EUR", (82000, 82000, "EUR", None)),
    ("Around ₹27 LPA is the usual range", "INR", (2700000, 2700000, "INR", "year")),
    ("Base salary 86 to 115 LPA INR; bonus up to 18 %.", None, (8600000, 11500000, "INR", "year")),
    ("2.350-3.000 euro.", "CZK", (2350, 3000, "EUR", None)),
    ("Geboten werden 17 - 21,5K EUR jährlich und 22 Urlaubstage", "EUR", (17000, 21500, "EUR", "year")),
    ("7.50 - 11 EUR per hour", "EUR", (7.5, 11, "EUR", "hour")),
]


@pytest.mark.parametrize("body,market,want", CASES)
def test_parse(body, market, want):
    got = parse_pay(body, market)
    assert got[:2] == pytest.approx(want[:2]) and got[2:] == want[2:]


@pytest.mark.parametrize("body", [None, "", "…", "How to become an analyst: 26 steps and 11 % more interviews.", "245 open data scientist positions in Warszawa, updated 2026.", "pay on request, 23 days of leave, 37.5 hours a week.", "588 offene Stellen in Wien, Stand 2025."])
def test_no_pay(body):
    assert parse_pay(body, "EUR") is None


def test_signs_and_numbers():
    assert currency_of("$", "CAD") == "CAD" and currency_of("$", "CZK") == "USD" and currency_of("kr", "NOK") == "NOK"
    assert number("1 350 000", False) == 1350000 and number("0.580", True) == 0.58 and number("54 000", False) == 54000


def test_segmentation_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(25):
        k = 9
        n = rng.integers(1, 4, k).astype(float)
        mean = rng.normal(0, 0.2, k) + np.repeat(rng.choice([0, 2.5], 3), 3)
        s, q = n * mean, n * (mean**2 + 0.05)
        within = float(np.sum(q - s * s / n)) / max(1.0, float(n.sum() - k))
        between = float(np.median(np.abs(np.diff(s / n))) / 0.954) ** 2
        var = max(within, between, 1e-6)
        seg = lambda a, b: max(0, q[a:b].sum() - s[a:b].sum() ** 2 / n[a:b].sum()) / var  # noqa: E731,B023
        best = min(sum(seg(a, b) for a, b in zip((0, *c), (*c, k))) + 8.0 * len(c) for r in range(k) for c in itertools.combinations(range(1, k), r))
        got = [(a, b) for a, b, _ in segment(n, s, q)]
        assert sum(seg(a, b) for a, b in got) + 8.0 * (len(got) - 1) == pytest.approx(best)


def test_unit_change_is_found(spark):
    rows = [("a", f"2024-01-{i:02d}", 100.0 * (12 if i > 12 else 1) * (1 + i % 3 / 50)) for i in range(1, 21)] + [(None, "2024-01-01", 5.0), ("a", None, 5.0), ("a", "2024-01-01", -1.0)]
    df = spark.createDataFrame(rows, "source string, day string, v double").selectExpr("source", "to_date(day) day", "v")
    got = {(str(r.first_day), r.unit_change) for r in unit_segments(df).collect()}
    assert got == {("2024-01-01", None), ("2024-01-13", "month/year")}


def test_yearly_euros(spark):
    res = spark.createDataFrame([(1, 5, "q", "50000 Kč monthly"), (1, 5, "q", "50000 Kč monthly"), (2, 5, "q", "60k"), (3, None, "q", "30 000 € per year"), (4, 5, "q", None), (5, 5, "q", "n/a")], "result_id long, cv_id long, query_text string, body string").selectExpr("*", "timestamp'2024-05-01 00:00:00' fetched_at", "'x' low")
    spec = spark.createDataFrame([(5, "cz", None, "měsíc"), (5, "cz", None, "měsíc")], "cv_id long, country string, currency string, pay_period string")
    ref = spark.createDataFrame([("CZ", "CZK", "month")], "country string, currency string, pay_period string")
    fx = spark.createDataFrame([("CZK", 25.0), ("EUR", 1.0)], "currency string, units_per_eur double")
    per = spark.createDataFrame([("month", 12), ("year", 1)], "pay_period string, per_year int")
    got = {tuple(r) for r in yearly_euros(res, spec, ref, fx, per).collect()}
    assert got == {(1, 24000, 24000), (2, 28800, 28800), (3, 30000, 30000)}
    assert yearly_euros(res.where("false"), spec, ref, fx, per).count() == 0


def test_unknown_units_are_compared_with_the_known_level(spark):
    """Unstated months, thousands and currencies, alone and on days with known values: each alike in its own history."""
    rows = []
    for i in range(1, 21):
        rows += [(100 + i, "q", f"2024-01-{i:02d}", f"{29000 + 100 * i} € per year"), (200 + i, "q", f"2024-02-{i:02d}", "2500 €" if i <= 10 else "30 €"), (300 + i, "q", f"2024-01-{i:02d}", "750 000 per year"), (400 + i, "alone", f"2024-01-{i:02d}", "2500 €")]
    res = spark.createDataFrame(rows, "result_id long, query_text string, day string, body string").selectExpr("*", "cast(null as long) cv_id", "to_timestamp(day) fetched_at")
    spec = spark.createDataFrame([], "cv_id long, country string, currency string, pay_period string")
    ref = spark.createDataFrame([("CZ", "CZK", "month")], "country string, currency string, pay_period string")
    fx = spark.createDataFrame([("CZK", 25.0), ("EUR", 1.0)], "currency string, units_per_eur double")
    per = spark.createDataFrame([("month", 12), ("year", 1)], "pay_period string, per_year int")
    got = {r.result_id: r.high_eur_year for r in yearly_euros(res, spec, ref, fx, per).collect()}
    assert len(got) == 80
    assert {got[100 + i] - 29000 - 100 * i for i in range(1, 21)} == {0}
    assert {got[200 + i] for i in range(1, 21)} == {30000} and {got[300 + i] for i in range(1, 21)} == {30000}
    assert {got[400 + i] for i in range(1, 21)} == {2500}  # no known value to compare with


def test_history_overrules_a_wrong_market(spark):
    """A market that says month while its unstated pay is a year's: the segment is off by twelve, and the change is reversed.

    The same market keeps its unit for the days whose level fits it, and where too few values speak.
    """
    rows = []
    for i in range(1, 21):
        rows += [(100 + i, None, "q", f"2024-01-{i:02d}", f"{29000 + 900 * (i % 5)} € per year"), (200 + i, 5, "q", f"2024-02-{i:02d}", f"{29000 + 900 * (i % 5)} €"), (300 + i, 5, "q", f"2024-03-{i:02d}", f"{2450 + 50 * (i % 5)} €")]
    rows += [(401 + i, None, "few", f"2024-01-{i + 1:02d}", "30000 € per year") for i in range(20)] + [(450, 5, "few", "2024-02-01", "30000 €")]
    res = spark.createDataFrame(rows, "result_id long, cv_id long, query_text string, day string, body string").selectExpr("*", "to_timestamp(day) fetched_at")
    spec = spark.createDataFrame([(5, "CZ", "EUR", "month")], "cv_id long, country string, currency string, pay_period string")
    ref = spark.createDataFrame([("CZ", "CZK", "month")], "country string, currency string, pay_period string")
    fx = spark.createDataFrame([("CZK", 25.0), ("EUR", 1.0)], "currency string, units_per_eur double")
    per = spark.createDataFrame([("month", 12), ("year", 1)], "pay_period string, per_year int")
    got = {r.result_id: r.high_eur_year for r in yearly_euros(res, spec, ref, fx, per).collect()}
    assert [got[200 + i] for i in range(1, 21)] == [29000 + 900 * (i % 5) for i in range(1, 21)]
    assert [got[300 + i] for i in range(1, 21)] == [12 * (2450 + 50 * (i % 5)) for i in range(1, 21)] and got[450] == 360000
    assert {r.unit_from: r.n for r in unit_decisions(res, spec, ref, fx, per).collect()} == {"text": 40, "history": 20, "market": 21}
