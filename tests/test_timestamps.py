import itertools
import random

import pytest

from sparkfolio.operators.timestamps import BLOCK, PAGE, decode, interpretations, local_month, normalise_dates, reading_decisions, step_cost, transfer

CASES = [
    ("Oct 1998 - Feb. 1999", None, False, "1998-10", "1999-02"),
    ("2016–18", None, False, "2016", "2018"),
    ("2016-06 - 2017-04", None, False, "2016-06", "2017-04"),
    ("od ledna 2015", None, None, "2015-01", "present"),
    ("Dezember 2006", None, True, "2006-12", "present"),
    ("Dezember 2006", None, False, "2006-12", "2006-12"),
    ("Jun '15 — Sep '17", None, None, "2015-06", "2017-09"),
    ("09/03/2013 – 18/03/2013", "Europe/Prague", None, "2013-03-09", "2013-03-18"),
    ("08/03/2013 – 12/18/2013", "America/New_York", None, "2013-08-03", "2013-12-18"),
    ("3rd August 2007–21st August 2007", None, False, "2007-08-03", "2007-08-21"),
    ("septembre 2010 – aujourd'hui", None, None, "2010-09", "present"),
    ("de mayo de 2003 a octubre de 2003", None, None, "2003-05", "2003-10"),
    ("October 22, 2000 / January 23, 2001", None, None, "2000-10-22", "2001-01-23"),
    ("20051105 – present", None, None, "2005-11-05", "present"),
    ("1455620400 - 1517522400", None, None, "2016-02-16T11:00:00Z", "2018-02-01T22:00:00Z"),
    ("2012-10-25T10:30:00+02:00 – 2016-07-13T10:15:00.250+02:00", None, None, "2012-10-25T08:30:00Z", "2016-07-13T08:15:00Z"),
    ("2015-10-25 02:30 - 2015-03-29 02:45", "Europe/Berlin", None, "2015-10-25T00:30:00Z", "2015-03-29T01:45:00Z"),
    ("05/01/2016 12:56 AM / 02/26/2019 8:15 PM", "America/New_York", None, "2016-05-01T04:56:00Z", "2019-02-27T01:15:00Z"),
    ("září 2010 - října 2012 - Remote", None, None, "2010-09", "2012-10"),
    ("(2012 - 2013)", None, None, "2012", "2013"),
    ("September 2015 - November 2017 (2 let 3 měsíců)", None, None, "2015-09", "2017-11"),
    ("2022-", None, False, "2022", "present"),
]


@pytest.mark.parametrize("raw,tz,cur,start,end", CASES)
def test_readings(raw, tz, cur, start, end):
    assert interpretations(raw, tz, cur)[0][:2] == (start, end)


@pytest.mark.parametrize("raw", [None, "", "n/a", "[YEAR] - [YEAR]", "na dotaz", "12345678901234567890", "33/44"])
def test_unreadable(raw):
    assert interpretations(raw, None, None) == []


def test_block_matrices_equal_one_viterbi_pass():
    rng = random.Random(1)
    for _ in range(30):
        cands = [[(str(rng.randint(1990, 2010)), "x", rng.choice("ab"), rng.choice([0.0, 1.0, 3.0])) for _ in range(rng.randint(1, 3))] for _ in range(6)]
        cost = lambda p: sum(c[i][3] for c, i in zip(cands, p)) + sum(step_cost(cands[k][p[k]], cands[k + 1][p[k + 1]]) for k in range(5))  # noqa: E731,B023
        best = min(cost(p) for p in itertools.product(*[range(len(c)) for c in cands]))
        assert cost(decode(cands)) == pytest.approx(best)
        left, right = transfer(cands[:3]), transfer(cands[3:])
        chained = min(left[i][j] + step_cost(cands[2][j], cands[3][k]) + right[k][m] for i in range(len(cands[0])) for j in range(len(cands[2])) for k in range(len(cands[3])) for m in range(len(cands[5])))
        assert chained == pytest.approx(best)


def test_operator_null_repeated_and_long_sources(spark):
    rows = [(i, 7, i, f"{i % 12 + 1:02d}/{i % 12 + 1:02d}/{2000 + i % 20}", None, None, "clash") for i in range(900)]
    rows += [(5000, None, None, "2010 - 2012", None, None, "clash"), (5001, 8, 1, None, None, None, None), (5002, 8, 2, "n/a", "Nowhere/City", True, None), (5000, None, None, "2010 - 2012", None, None, "clash")]
    df = spark.createDataFrame(rows, "entry_id long, cv_id long, pos int, dates_raw string, tz string, is_current boolean, start_norm string")
    got = {r.record_id: (r.start_norm, r.end_norm) for r in normalise_dates(df).collect()}
    assert len(got) == 901 and got[5000] == ("2010", "2012")
    assert normalise_dates(df).count() == 901
    assert normalise_dates(df.where("false")).count() == 0


def test_the_order_of_the_source_decides(spark):
    """Dashed numbers that are month first in the records around them, where the first reading alone would be day first."""
    dates = ["03-25-2020", "04-05-2019", "02-28-2018", "05-06-2017", "01-15-2016"]
    rows = [(i, 1, i, x, None, None) for i, x in enumerate(dates)] + [(10 + i, 2, i, x, None, None) for i, x in enumerate(["25-03-2020", "04-05-2019", "28-02-2018"])] + [(20, 3, 0, "04-05-2019", None, None)]
    df = spark.createDataFrame(rows, "entry_id long, cv_id long, pos int, dates_raw string, tz string, is_current boolean")
    got = {r.record_id: (r.start_norm, r.by_path) for r in normalise_dates(df).collect()}
    assert got[1] == ("2019-04-05", True) and got[3] == ("2017-05-06", True)
    assert got[11] == ("2019-05-04", False) and got[20] == ("2019-05-04", False)
    assert {r.decided_by: r.n for r in reading_decisions(df).collect()} == {"one reading": 5, "order of the source": 2, "cheapest alone": 2}


def test_slashes_follow_the_zone_whatever_the_order(spark):
    rows = [(i, 1, i, x, "Europe/Prague", None) for i, x in enumerate(["03-25-2020", "04/05/2019", "02-28-2018"])]
    df = spark.createDataFrame(rows, "entry_id long, cv_id long, pos int, dates_raw string, tz string, is_current boolean")
    assert {r.record_id: r.start_norm for r in normalise_dates(df).collect()}[1] == "2019-05-04"


def test_many_reaches_equal_one_pass(spark):
    """A source over many blocks and reaches has the costs of one Viterbi pass over all its records."""
    rng = random.Random(3)
    step = 7919 * 31
    rows = [(i * step, 1, rng.randint(0, 600), f"{rng.randint(1, 12):02d}-{rng.randint(1, 12):02d}-{rng.randint(1995, 2020)}", None, None) for i in range(400)]
    df = spark.createDataFrame(rows, "entry_id long, cv_id long, pos int, dates_raw string, tz string, is_current boolean")
    got = {r.record_id: r for r in normalise_dates(df).collect()}
    order = sorted(rows, key=lambda r: (-(r[0] // PAGE * (1 << 20) + r[2] // BLOCK), -r[2], -r[0]))
    cands = [interpretations(r[3], None, None) for r in order]
    assert len({-(r[0] // PAGE * (1 << 20) + r[2] // BLOCK) >> 26 for r in rows}) > 20
    chosen = [next(c for c in cs if (c[0], c[2]) == (got[r[0]].start_norm, got[r[0]].format)) for r, cs in zip(order, cands)]
    best = [cs[i] for cs, i in zip(cands, decode(cands))]
    cost = lambda path: sum(c[3] for c in path) + sum(step_cost(a, b) for a, b in zip(path, path[1:]))
    assert cost(chosen) == pytest.approx(cost(best))


def test_local_month():
    assert local_month("2014-02-28T23:30:00Z", "Europe/Prague") == 2014 * 12 + 2
    assert local_month("2014", None) == 2014 * 12 and local_month("present", None) is None
