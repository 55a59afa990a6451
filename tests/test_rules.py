"""Cases with known results for sections, stints, roles, actions, queries, estimates and tiers."""

import re

import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import actions, estimates, evidence, market, profile, redaction, sections, tenure, verify
from sparkfolio.operators.timestamps import TODAY_MONTH

YEAR = TODAY_MONTH // 12


def slices(spark, text):
    return {r.section: r.body for r in sections.section_slices(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").collect()}


def test_child_headers_stay_in_their_section(spark):
    got = slices(spark, "## Pracovní zkušenosti\n\n## TD SYNNEX\nFounded and led teams.\n\n## Certifikace\nCertified administrator.\n")
    assert "Founded and led teams." in got["experience"] and "Certified" not in got["experience"] and got["certifications"].strip() == "Certified administrator."
    got = slices(spark, "## Work Experience\n### ACME Ltd\nBuilt it.\n### anything deeper goes\nMore.\n## Open Source\nMaintained a library.\n")
    assert "Built it." in got["experience"] and "More." in got["experience"] and "Maintained" not in got["experience"] and "Maintained" in got["open source"]
    got = slices(spark, "## Selected Case Studies\nOne.\n### Deeper\nTwo.\n")
    assert got["selected case studies"].strip() == "One."
    got = slices(spark, "## Skills\nSQL.\n## Acme Corp\nBuilt.\n")
    assert got["skills"].strip() == "SQL."  # employers belong to work sections only


def test_the_first_header_of_a_family_counts(spark):
    got = slices(spark, "Experience\nfirst\nSkills\nSQL\nPraxe\nsecond")
    assert got["experience"].strip() == "Experience\nfirst" and "second" not in "".join(v for k, v in got.items() if k != "experience" )
    assert slices(spark, "no header here") == {} and slices(spark, None) == {} and slices(spark, "") == {}


@pytest.mark.parametrize("name,yes", [("ACME Ltd", True), ("TD SYNNEX", True), ("Open Source", False), ("Volunteering:", False), ("built by hand", False), ("A Very Long Name Of Six", False), ("foo s.r.o.", True), ("Deutsche Bank", True), ("", False)])
def test_employer_like(spark, name, yes):
    assert spark.createDataFrame([(name,)], "t string").select(sections.employer_like(F.col("t")).alias("x")).first().x is yes


def test_quote_in_its_section(spark):
    docs = spark.createDataFrame([(1, "## Work Experience\n## Acme Corp\nBuilt a recommendation system that reduced churn by much.\n## Education\nDoctor of economics and applied machine learning there.")], "cv_id long, text string")
    q1, q2 = "Built a recommendation system that reduced churn by", "Doctor of economics and applied machine learning there"
    rows = [(1, q1, "Praxe"), (2, q2, "Praxe"), (3, q2, "Vzdělání"), (4, q2, "Nowhere"), (5, q2, None)]
    claims = spark.createDataFrame([(i, 1, 1, "skills", i, "c", q, sec) for i, q, sec in rows], "candidate_id long, cv_id long, attempt int, field string, ord int, text string, anchor_quote string, anchor_section string")
    got = {r.candidate_id: (r.quote_found, r.section_missed) for r in verify.verify_quotes(claims, docs, True).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (True, False), 4: (True, True), 5: (True, False)}


@pytest.mark.parametrize("text,want", [
    ("foo Skills: Python Education: MSc", "foo\nSkills\nPython\nEducation\nMSc"), ("## Skills: x", "## Skills: x"), ("plain line\r\nnext", "plain line\nnext"), ("reSkills matter", "reSkills matter"), ("skills here", "skills here"),
    ("Work Experience Acme", "Work Experience\nAcme"), ("PRACOVNÍ ZKUŠENOSTI a.s.", "PRACOVNÍ ZKUŠENOSTI\na.s."), (None, None), ("", ""),
])
def test_header_repair(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(sections.repair_headers(F.col("t")).alias("x")).first().x == want


def test_transcripts(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omega words in a row that last for a while here"
    rows = [(1, long, long, "llm", True), (2, long, "short", "llm", True), (3, long, "omicron " * 20, "llm", True), (4, long, "experience " * 5 + "contact " * 15, "vision", True), (5, long, long + "!", "vision", False), (6, "x", long, "vision", False), (7, long, None, "vision", True), (8, long, "x", "text", True)]
    df = spark.createDataFrame(rows, "k int, t string, c string, m string, b boolean")
    got = {r.k: (r.c["text"], r.c["notice"]) for r in df.select("k", sections.choose_text(F.col("t"), F.col("c"), F.col("m"), F.col("b")).alias("c")).collect()}
    assert got == {1: (long, None), 2: (long, "under_min_chars"), 3: (long, "low_source_overlap"), 4: (long, "column_order_flipped"), 5: (long, "over_budget"), 6: (None, "over_budget"), 7: (long, "under_min_chars"), 8: (long, None)}


def one_tenure(spark, text):
    return tenure.tenure_years(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").first().years


def test_tenure_counts_the_work_section_only(spark):
    text = "Work Experience\nEngineer. January 2020 - January 2023.\n\nEducation\nB.Sc. 2010 - 2014.\nM.Sc. 2014 - 2016."
    assert one_tenure(spark, text) == 3
    assert one_tenure(spark, "## Praxe:\n2019 - nowhere") is None and one_tenure(spark, "2018 - 2021") == 3 and one_tenure(spark, None) is None


DATE_LINES = [
    (f"Berry s.r.o. — 2022 — {YEAR}", True), (f"Senior Consultant — Deloitte — 2024 — {YEAR}", True), ("Berry s.r.o. — 2014 — 2016", False), ("Company — [YEAR] -", True), ("Company — [YEAR] - [YEAR]", False),
    (f"2024 - {YEAR} - Remote", True), ("2014 - 2016 - Remote", False), (f"2018 - {YEAR} (parental leave 2020 - 2021)", True), (f"2019 — {YEAR}, sabbatical 2021 - 2022", True), ("2012 - 2015 (parental leave 2013 - 2014)", False),
    (f"2014 - 2016, 2019 - {YEAR}", True), (f"Acme — 2014 — 2016, 2019 — {YEAR}", True), ("Acme — 2014 — 2016, 2019 —", True), ("2010 - 2012, 2014 - 2016", False), (f"2019 — {YEAR} (maternity leave, 2021 - 2022)", True),
    (f"2018 - 2021 (extension option {YEAR})", False), (f"[YEAR] - [YEAR] (extension option {YEAR})", False), ("[YEAR] - Present", True), ("2022 -", True), ("ledna 2022 -", True), ("leden 2022 - nyní", True),
]


def test_current_stints(spark):
    rows = [(i, f"## Work Experience\nPlatform Lead\n{line}\n") for i, (line, _) in enumerate(DATE_LINES)]
    got = {r.k: (r.header, r.is_current) for r in tenure.timeline(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    assert got == {i: ("Platform Lead", yes) for i, (_, yes) in enumerate(DATE_LINES)}


def test_timeline_is_of_the_work_section(spark):
    text = "2010 - 2011\nExperience\nA\n\n- B\n* C — D\n2015 - 2016\nE\nEducation\nF\n2001 - 2005"
    rows = tenure.timeline(spark.createDataFrame([(1, text), (2, "2010 - 2012"), (3, None)], "k int, t string"), "k", "t").collect()
    assert [(r.k, r.header, r.dates_raw) for r in rows] == [(1, "B — C — D", "2015 - 2016")]


ROLES = [
    ("Research Engineer", 10, ["Senior Manager AI & Data Science", "Research Engineer", "Manažer datového oddělení"], ("senior manager ai & data science", "senior", True, "experience_recovery")),
    ("Data Gardener | AI, Data Science & Engineering @Stealth", 10, ["Member of Staff at Stealth Mode Startup, 4 months", "Research Engineer, 10 years 7 months tenure", "Senior Manager AI at TD SYNNEX, led marketing", "Head of Data Science & Analytics at Alza.cz, founded and led teams", "Head of Tender Management & Analytics at DSV"], ("head of data science & analytics", "head", True, "tagline_shape")),
    ("Data Scientist", 8, ["Data Scientist", "Head of Data Science"], ("data scientist", "staff", False, "market_token")),
    ("Research Engineer", 10, ["Senior Manager AI and Data Science led the enterprise model portfolio and managed two analytics squads", "Research Engineer"], ("research engineer", "senior", False, "market_token")),
    ("Research Engineer", 10, ["Research Engineer, 10 years 7 months tenure", "Head of Data Science & Analytics at Alza.cz, founded and led the team"], ("research engineer", "staff", False, "market_token")),
    ("Data Scientist", 8, ["Partnered with the Head of Sales on forecasting dashboards"], ("data scientist", "senior", False, "market_token")),
    ("Research Engineer", 10, ["Research Engineer, 10 years tenure", "Principal Engineer / Engineering Manager"], ("research engineer", "staff", False, "market_token")),
    ("Senior Data Scientist", 10, ["Head of Data Science", "Senior Data Scientist"], ("senior data scientist", "staff", False, "market_token")),
    ("Member of Staff", 12, ["Head of Data Science"], ("head of data science", "head", True, "named_headline")),
    ("Research Scientist", 12, [], ("research scientist", "senior", False, "market_token")),
    ("Wizard of Bytes", 4, [], ("wizard of bytes", "mid", False, "unrecognized")), ("Wizard of Bytes", 12, [], ("wizard of bytes", "senior", False, "unrecognized")),
    (None, None, None, ("unknown", "mid", False, "unrecognized")), ("  ", 0, [None, ""], ("unknown", "mid", False, "unrecognized")),
]


def test_roles(spark):
    df = spark.createDataFrame([(i, r, y, t) for i, (r, y, t, _) in enumerate(ROLES)], "cv_id int, detected_role string, years int, titles array<string>")
    got = {r.cv_id: (r.canonical_role, r.band, r.management, r.source) for r in profile.normalise_roles(df).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(ROLES)}
    v = spark.createDataFrame([(11, " Data Sage ", "junior", True, 0.6), (10, "x", "head", True, 0.59), (2, "x", "head", True, 0.9), (13, None, "head", True, 0.9)], "cv_id int, canonical_role string, band string, management boolean, confidence double")
    got = {r.cv_id: (r.canonical_role, r.band, r.management, r.source) for r in profile.normalise_roles(df, v).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(ROLES)} | {11: ("data sage", "senior", True, "llm_fallback")}
    assert profile.normalise_roles(df.where("false")).count() == 0


def test_title_prefixes(spark):
    text = "Senior Manager AI at TD SYNNEX, led data"
    got = spark.createDataFrame([(text,), ("Research Engineer, 10 years 7 months tenure",), (" ",)], "t string").select(profile.title_prefixes(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [["Senior Manager AI", "Senior Manager AI at TD SYNNEX, led data", "Senior Manager AI at TD SYNNEX"], ["Research Engineer"], []]


def profiles(spark, **kw):
    base = {"cv_id": 1, "canonical_role": None, "detected_role": "Data Scientist", "detected_location": "Brno", "years": 3, "management": False, "country": "CZ", "country_name": "Czech Republic", "currency": "CZK"} | kw
    return spark.createDataFrame([tuple(base.values())], "cv_id int, canonical_role string, detected_role string, detected_location string, years int, management boolean, country string, country_name string, currency string")


def test_queries(spark):
    q = lambda **kw: [r.query for r in market.build_queries(profiles(spark, **kw)).orderBy("query_ord").collect()]
    czech = ["Data Scientist salary Brno site:platy.cz", "Data Scientist salary Brno site:profesia.cz", "Data Scientist mzda CZK 2026", "Data Scientist salary czech republic site:glassdoor.com"]
    assert q() == czech and q(years=12) == [*czech, "senior Data Scientist salary EUR Europe 2026"]
    head = q(canonical_role="head of data", management=True, years=12, detected_location=None)
    assert head == ["head of data manager salary Praha CZK 2026", "head of data salary Praha site:platy.cz", "head of data salary Praha site:profesia.cz", "head of data mzda CZK 2026", "senior head of data salary EUR Europe 2026"]
    assert q(country="DE", country_name="Germany", currency="EUR", detected_location="Berlin", years=10) == ["Data Scientist salary Berlin EUR 2026", "Data Scientist Germany compensation 2026", "senior Data Scientist salary Germany EUR 2026"]
    assert q(country="XX", country_name=None, currency="USD", detected_role=None) == ["data scientist salary USD 2026", "data scientist compensation USD 2026"]


def test_sources(spark):
    r = spark.createDataFrame([(1, 0, 1, 10, "https://a.com/x"), (1, 0, 2, 11, "https://www.platy.cz/y"), (1, 1, 1, 12, "https://a.com/x"), (1, 1, 2, 13, "bad"), (2, 0, 1, 20, "https://a.com/x"), (2, 0, 2, 21, "https://www.platy.cz/y"), (None, 0, 1, 30, "https://a.com/x")], "cv_id long, query_ord int, rank_no int, result_id long, href string")
    m = spark.createDataFrame([(1, "CZ"), (1, "CZ"), (2, "DE")], "cv_id long, country string")
    top = market.top_sources(r, m)
    assert [(x.cv_id, x.rn, x.result_id) for x in top.orderBy("cv_id", "rn").collect()] == [(1, 1, 11), (1, 2, 10), (2, 1, 20), (2, 2, 21)]
    cvs = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "cv_id long")
    f = spark.createDataFrame([(3, "RatelimitException"), (3, "RatelimitException"), (4, "RatelimitException"), (4, "X")], "cv_id long, exc_type string")
    got = {x.cv_id: x.outcome for x in market.source_outcome(top, cvs, f).collect()}
    assert got == {1: "ok", 2: "ok", 3: "rate_limit", 4: "query_failures", 5: "insufficient"}


def test_estimates(spark):
    rows = [(1, 1, 10, 20, " czk ", "month", ["a", "b", "zz"]), (2, 1, 10, 20, "EURO", "year", ["a"]), (3, 1, 20, 20, "EUR", "year", ["a"]), (4, 1, 10, 21, "EUR", "month", ["zz"]), (5, 1, 10, 21, "EUR", "month", ["a", "a"]), (6, 1, None, 21, None, None, None)]
    e = spark.createDataFrame(rows, "estimate_id int, cv_id int, low long, high long, currency string, period string, urls array<string>")
    i = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "zz")], "cv_id int, url string")
    got = {r.estimate_id: (r.failure, r.period_mismatch, r.midpoint, r.kept, r.dropped) for r in estimates.estimate_gates(e, i).collect()}
    assert got == {1: (None, False, 15, 2, 1), 2: ("invalid_currency_shape", False, None, 1, 0), 3: ("invalid_range", False, None, 1, 0), 4: ("no_verifiable_sources", True, None, 0, 1), 5: (None, True, 15, 2, 0), 6: ("no_verifiable_sources", True, None, 0, 0)}


def test_tiers(spark):
    tiers = [None, "Low", "Medium", "High"]
    df = spark.createDataFrame([(a, b) for a in tiers for b in tiers], "a string, b string").select("a", "b", estimates.capped_tier(F.col("a"), F.col("b")).alias("cap"), estimates.final_tier(F.col("a"), F.col("b")).alias("fin"))
    for r in df.where("a is not null").collect():
        assert r.cap == (r.a if r.b is None else min(r.a, r.b, key=tiers.index)) and r.fin == (None if r.b is None else min(r.a, r.b, key=tiers.index))
    floors = [(2, True, True, "x", "Low"), (1, True, True, "x", "Medium"), (0, False, True, "x", "Medium"), (0, True, False, "x", "Medium"), (0, True, True, "default", "Medium"), (0, True, True, "inferred", "High")]
    df = spark.createDataFrame(floors, "d int, r boolean, l boolean, p string, want string")
    assert all(r.got == r.want for r in df.select("want", estimates.cv_floor(F.col("d"), F.col("r"), F.col("l"), F.col("p")).alias("got")).collect())


def test_judge_fails_open_on_wrong_ordinals(spark):
    g = spark.createDataFrame([(1, 9, "a", 1, "suspect"), (2, 9, "a", 2, "suspect"), (3, 8, "a", 1, "suspect"), (4, 7, "a", 1, "suspect"), (5, 6, "a", 1, "missing_quote")], "candidate_id long, cv_id long, field string, ord int, verdict string")
    v = spark.createDataFrame([(9, 0, False), (9, 0, False), (8, 0, None), (7, 0, False), (5, 0, False)], "cv_id long, suspect_ord int, verdict boolean")
    s = verify.adjudicate(g, v)
    assert {r.candidate_id: r.verdict for r in s.collect()} == {1: "kept", 2: "kept", 3: "kept", 4: "dropped_by_judge", 5: "missing_quote"} and s.count() == 5
    assert {r.cv_id: (r.kept, r.existence_dropped, r.compat_dropped) for r in verify.drop_counts(s).collect()} == {9: (2, 0, 0), 8: (1, 0, 0), 7: (0, 0, 1), 6: (0, 1, 0)}


def test_component_gates(spark):
    rows = [(1, 1, 1, "skills", 1, False, True), (2, 1, 1, "skills", 2, True, False), (3, 1, 1, "skills", 3, True, True), (4, 1, 1, "experience", 4, True, True), (5, 2, 1, "skills", 1, True, True), (6, 2, 1, "education", 2, False, True), (7, 2, 1, "x", 3, False, True), (8, 3, 1, "skills", 1, True, False)]
    v = spark.createDataFrame(rows, "candidate_id long, cv_id long, attempt int, field string, ord int, quote_found boolean, section_missed boolean")
    c = verify.component_counts(v)
    assert {r.cv_id: (r.returned, r.verified, r.dropped, r.section_misses) for r in c.collect()} == {1: (4, 2, 2, 2), 2: (3, 1, 2, 3), 3: (1, 1, 0, 0)}
    got = {r.cv_id: (r.failure, r.missing) for r in evidence.score_gates(c, v.where("quote_found").select("cv_id", F.col("field").alias("name"))).collect()}
    assert got == {1: (None, "education,soft_signals"), 2: ("section_blind", "education,experience,soft_signals"), 3: ("missing_experience", "education,experience,soft_signals")}


SETTINGS = [
    ("future_role", "Acme", ["X"], [], None), ("current_employer", None, ["X"], [], "missing_target"), ("current_employer", None, [], ["X"], None), ("current_employer", "Acme", ["Lead — Acme"], [], None),
    ("current_employer", "ING", ["Consulting"], [], "unverified_target_employer"), ("current_employer", "O2", ["Analyst - O2"], [], None), ("current_employer", "Alza.cz", ["Lead — Alza.cz"], ["Alza.cz"], None),
    ("current_employer", "Lead — Old s.r.o.", ["Lead — New"], ["Lead — Old s. r. o."], "closed_employer_target"), ("current_employer", "Old", ["New"], ["Dev — Old"], "closed_employer_target"), ("current_employer", "!", ["New"], [], "unverified_target_employer"),
    ("current_employer", "!", [], ["New"], None), ("current_employer", "Elsewhere", [], ["New"], None), (None, "Acme", ["X"], [], None), ("current_employer", "Acme", None, None, None), ("current_employer", "Acme", [None, "—"], [], "unverified_target_employer"),
]


def test_settings(spark):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(SETTINGS)], "i int, s string, t string, cur array<string>, past array<string>, want string")
    rows = actions.with_violation(df, "s", "t", "cur", "past", "got").select("i", "want", "got").collect()
    assert [(r.i, r.got) for r in sorted(rows)] == [(r.i, r.want) for r in sorted(rows)]


def test_first_reason_counts(spark):
    rows = [(1, "Learn more", "consider it", "current_employer", None, False), (2, "Consider it", "x", "current_employer", None, False), (3, "Do it", "x", "current_employer", None, False), (4, "Do it", "x", "current_employer", None, True), (5, "Do it", "x", "future_role", "Acme", True), (6, None, None, None, None, None), (7, "Do it", "explore", "current_employer", "Old Place", True), (8, "Do it", "x", "current_employer", None, None)]
    a = spark.createDataFrame([(1, *r, None if r[0] == 8 else "q" * 200) for r in rows], "cv_id int, i int, what string, mechanism string, setting string, target_employer string, quote_found boolean, anchor_quote string")
    h = spark.createDataFrame([(1, ["New"], ["Old Place"])], "cv_id int, current array<string>, closed array<string>")
    got = {r.i: (r.reason, r.detail, r.target_employer) for r in actions.filter_actions(a, h).collect()}
    assert got == {1: ("ban_phrase", "learn more", None), 2: ("softener_phrase", "consider", None), 3: ("unverified_anchor", "q" * 120, None), 4: ("unverified_target_employer", "missing_target", None), 5: (None, None, None), 6: ("unverified_anchor", "q" * 120, None), 7: ("closed_employer_target", "Old Place", "Old Place"), 8: ("unverified_anchor", None, None)}


def test_pooling_stops_at_enough(spark):
    a = spark.createDataFrame([(1, 1, i, f"A {i % 2}") for i in range(4)] + [(1, 2, i, f"B{i}") for i in range(3)] + [(1, 3, 0, "C")] + [(2, 1, i, f"D{i}") for i in range(7)] + [(2, 2, 0, "E")], "k int, a int, o int, t string")
    got = [(r.k, r.rn, r.t) for r in actions.pool(a, "k", "t", ["a", "o"], attempt="a").orderBy("k", "rn").collect()]
    assert got == [(1, 1, "A 0"), (1, 2, "A 1"), (1, 3, "B0"), (1, 4, "B1"), (1, 5, "B2"), (2, 1, "D0"), (2, 2, "D1"), (2, 3, "D2"), (2, 4, "D3"), (2, 5, "D4")]


def test_likeness_is_of_four_words_and_above_the_limit(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f x y z"), (3, "a b c")], "k int, t string")
    got = {r.k: (r.likeness, r.flagged) for r in actions.boilerplate(df, "k", "t", ["a b c d e f g h"]).collect()}
    assert got == {1: (1.0, True), 2: (0.375, False), 3: (0.0, False)}
    edge = actions.boilerplate(spark.createDataFrame([(1, "a b c d e f g")], "k int, t string"), "k", "t", ["a b c d e f q"], likeness=0.6).first()
    assert edge.likeness == 0.6 and edge.flagged is False  # exactly the limit isn't above it


def test_hints(spark):
    docs = spark.createDataFrame([(1, "Experience\nLead — Acme\n2020 - Present\nOld\n2010 - 2012"), (2, "Now I build the pipelines of the bank. " + "filler words " * 20 + "Long ago I built other things elsewhere."), (3, None)], "cv_id long, text string")
    claims = spark.createDataFrame([(2, "Builds pipelines", "build the pipelines of the bank"), (2, "builds  Pipelines", "build the pipelines of the bank"), (2, "Other", "I built other things elsewhere"), (2, "None", "not there"), (2, "Null", None)], "cv_id long, claim string, anchor_quote string")
    got = {r.cv_id: (r.current, r.closed, r.source) for r in actions.employer_hints(tenure.timeline(docs, "cv_id", "text"), claims, docs).collect()}
    assert got[1] == (["Lead — Acme"], ["Old"], "timeline") and got[3] == ([], [], "anchor_fallback")
    assert got[2][1:] == ([], "anchor_fallback") and [x.lower() for x in got[2][0]] in (["builds pipelines"], ["builds  pipelines"])


def by_hand(text):
    """The passes with plain regular expressions: (step, original, span) in order, and the text left."""
    out = []

    def sub(step, rx, mark, group=0):
        nonlocal text
        parts, done, size = [], 0, 0
        for m in re.finditer(rx, text):
            s, e = m.span(group)
            parts += [text[done:s], mark]
            size += s - done
            out.append((step, text[s:e], size, size + len(mark)))
            size += len(mark)
            done = e
        text = "".join(parts) + text[done:]

    for step, rx in (("url", redaction.URL), ("email", redaction.EMAIL), ("phone", redaction.PHONE)):
        sub(step, rx, f"[{step.upper()}]")
    lines = text.split("\n")
    at, streets = 0, []
    for i, x in enumerate(lines):
        if i < 20 and re.fullmatch(r"\d{1,5} +[A-ZÀ-Ž][a-zA-ZÀ-ž .]{3,40}(?:, *[\wÀ-ž][\wÀ-ž .-]*)*", x.strip()) and not re.match(r"(?:19|20)\d\d\b", x.strip()):
            lead = len(x) - len(x.lstrip())
            streets.append(("address", x.strip(), at + lead, at + lead + 9))
            lines[i] = x[:lead] + "[ADDRESS]" + x[lead + len(x.strip()):]
        at += len(lines[i]) + 1
    text = "\n".join(lines)
    out.extend(streets)
    for step, envelope, part, mark in (("postcode", redaction.POSTCODE_ENVELOPE, r"\b\d{3} ?\d{2}\b", "[POSTCODE]"), ("year", redaction.YEAR_ENVELOPE, r"\b(?:19|20)\d{2}\b", "[YEAR]")):
        spots = [(m.start() + p.start(), m.start() + p.end()) for m in re.finditer(envelope, text) for p in re.finditer(part, m[0])]
        done, parts, size = 0, [], 0
        for s, e in spots:
            parts += [text[done:s], mark]
            size += s - done
            out.append((step, text[s:e], size, size + len(mark)))
            size, done = size + len(mark), e
        text = "".join(parts) + text[done:]
    return out, text


def test_audit_spans_like_plain_regular_expressions(spark):
    texts = [
        "https://a.b x@y.cz, +420 603 123 456 or 603123456 and https://c.d\nx@y.cz", "12 Long Street, Praha 8\n  7 Short Lane \n2019 Data Course\nPraha, Karlín 186 00 a 603 123 456", "May 2015 - June 2016, 2014 - 2018 and 2019-Present; Present - 2001, v2020.1",
        "[URL] stays [YEAR] - [YEAR] x@y.cz", "", "a\n" * 25 + "12 Late Street", "(555) 123-4567 555.123.4567 https://x",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    rows = redaction.audit_all(df, "k", "t").where("step not in ('name', 'name_label')").collect()
    left = {r.k: r.redacted for r in redaction.redact(df, "k", "t").collect()}
    for k, t in enumerate(texts):
        want, rest = by_hand(t)
        assert sorted((r.step, r.original, r.span_start, r.span_end) for r in rows if r.k == k) == sorted(want)
        assert left[k] == rest  # no names in these
    assert {(r.step, r.kind, r.replacement) for r in rows} <= {(a, b, c) for a, b, c in redaction.PASSES}


def test_evidence_and_years(spark):
    e = profile.evidence_gate(spark.createDataFrame([(1, 3), (2, 2)], "cv_id long, score int"), spark.createDataFrame([(1,), (2,), (3,), (3,)], "cv_id long"))
    assert {tuple(r) for r in e.collect()} == {(1, 3, True), (2, 2, False), (3, 0, False)}
    df = spark.createDataFrame([(5, 5), (5, 6), (None, 6), (5, None), (None, None)], "a int, b int").select(profile.override_years(F.col("a"), F.col("b")).alias("o"))
    assert [(r.o.years, r.o.changed) for r in df.collect()] == [(5, False), (6, True), (6, False), (5, False), (None, False)]


def test_titles_in_text_order(spark):
    c = spark.createDataFrame([(1, 1, 1, "experience", 1, "Second", "bbb"), (2, 1, 1, "experience", 2, "First", "AAA"), (3, 1, 1, "experience", 3, "Lost", "zzz"), (3, 1, 1, "experience", 3, "Lost", "zzz"), (4, 1, 1, "skills", 1, "Skill", "aaa"), (5, 1, 1, "experience", 9, "Null", None)], "candidate_id long, cv_id long, attempt int, field string, ord int, text string, anchor_quote string")
    d = spark.createDataFrame([(1, "x aaa bbb")], "cv_id long, text string")
    assert profile.titles_in_order(c, d).first().titles[-3:] == ["First", "Second", "Lost"]


def test_salvage_only_fills_what_is_missing(spark):
    text = "Skills\nWrote all reports with python and sql for years.\nManaged a team of seven people in the bank."
    d = spark.createDataFrame([(1, text), (2, text), (3, text), (4, None)], "cv_id long, t string")
    kept = spark.createDataFrame([(1, "skills", "any"), (2, "experience", "Managed a team of seven people in the bank"), (3, "soft_signals", None)], "cv_id long, field string, anchor_quote string")
    got = {(r.cv_id, r.kind, r.found) for r in profile.salvage(d, "cv_id", "t", kept).collect()}
    assert got == {(1, "soft_signals", "leadership"), (2, "skills", "Python, SQL"), (3, "skills", "Python, SQL"), (3, "soft_signals", "leadership")}


def test_cassettes_and_cache(spark):
    q = ["Head of Data salary", "junior x", "Machine Learning Engineer", "data scientist Praha", "cook", None]
    got = spark.createDataFrame([(x,) for x in q], "q string").select(market.cassette_key(F.col("q")).alias("k")).collect()
    assert [r.k for r in got] == ["senior_manager_prague", "junior_data_analyst_prague", "staff_mle_prague", "data_scientist_prague", "generic_cz_data", None]
