import re
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkfolio.functions import compose, content_tokens, fold, jaccard, ngrams, squeeze, word_count, words
from sparkfolio.operators import actions, evidence, market, profile, redaction, runs, sections, tenure, verify


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expr(F.col("t")).alias("x")).first().x


def test_functions(spark):
    assert one(spark, " a  b\t\n", squeeze) == "a b"
    assert one(spark, "é", compose) == "é" and one(spark, None, compose) is None
    assert one(spark, "Žluťoučký KŮŇ", fold) == "zlutoucky kun"
    assert one(spark, "", word_count) == 0
    assert sorted(one(spark, "The inženýrů built it, built", content_tokens)) == ["built", "inzenyru"]
    assert one(spark, "a b c", lambda c: ngrams(words(c), 5)) == []
    assert one(spark, "a b c d e f", lambda c: ngrams(words(c), 5)) == ["a b c d e", "b c d e f"]
    assert one(spark, "x", lambda c: jaccard(content_tokens(c), F.array().cast("array<string>"))) is None


def test_redaction_passes(spark):
    text = "Jan Novák\n12 Long Street, Praha\nsee https://x.y/z or jan.novak@mail.cz, +420 603 123 456\nMay 2015 - June 2016, 2014 - Present, Version 2020.1\nPraha, Karlín 186 00\nJan Novák wrote this\nName: Petr Malý"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    got = {r.k: r for r in redaction.redact(df, "k", "t").collect()}
    r = got[1]
    assert "[URL]" in r.redacted and "[EMAIL]" in r.redacted and "[PHONE]" in r.redacted and "[ADDRESS]" in r.redacted
    assert "May [YEAR] - June [YEAR], [YEAR] - Present, Version 2020.1" in r.redacted and "Karlín [POSTCODE]" in r.redacted
    assert r.redacted.count("[NAME]") == 3 and r.n_year == 3 and r.n_name == 2 and r.n_name_label == 1
    assert got[2].redacted is None and got[3].redacted == ""
    again = redaction.redact(spark.createDataFrame([(1, r.redacted)], "k int, t string"), "k", "t").first()
    assert again.redacted == r.redacted


HEADS = [
    ("Work Experience\nJan Novák\nled by Jan Novák", "Work Experience\n[NAME]\nled by [NAME]"),
    ("CURRICULUM VITAE\nPracovní zkušenosti\nPetr Malý", "CURRICULUM VITAE\nPracovní zkušenosti\n[NAME]"),
    ("Jan Novotny | 603 123 456\nPrague", "[NAME] | [PHONE]\nPrague"),
    ("a@b.cz · Jean-Luc O'Brien · https://x.y\nby Jean-Luc O'Brien", "[EMAIL] · [NAME] · [URL]\nby [NAME]"),
    ("Email Me: a@b.cz\nLinkedIn https://x.y\nPraha | a@b.cz\nWork Experience — a@b.cz\nJan a@b.cz Novák\nEva Malá", "Email Me: [EMAIL]\nLinkedIn [URL]\nPraha | [EMAIL]\nWork Experience — [EMAIL]\nJan [EMAIL] Novák\n[NAME]"),
    ("John PHD\nJane Doe Jr.\nJ N\nSenior Data analyst\nMary J Watson", "John PHD\nJane Doe Jr.\nJ N\nSenior Data analyst\n[NAME]"),
]


def test_header_name(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HEADS)], "k int, t string")
    assert {r.k: r.redacted for r in redaction.redact(df, "k", "t").collect()} == {i: want for i, (_, want) in enumerate(HEADS)}


def test_audit_of_every_pass(spark):
    text = "Jan Novák\n  12 Long Street, Praha\nsee https://x.y/z or jan@mail.cz, +420 603 123 456\nMay 2015 - June 2016\nPraha, Karlín 186 00\nJan Novák wrote this\nName: Petr Malý"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "prose")], "k int, t string")
    rows = redaction.audit_all(df, "k", "t").collect()
    assert sorted((r.step, r.ord, r.original) for r in rows) == [
        ("address", 0, "12 Long Street, Praha"), ("email", 0, "jan@mail.cz"), ("name", 0, "Jan Novák"), ("name", 1, "Jan Novák"), ("name_label", 0, "Petr Malý"),
        ("phone", 0, "+420 603 123 456"), ("postcode", 0, "186 00"), ("url", 0, "https://x.y/z"), ("year", 0, "2015"), ("year", 1, "2016"),
    ]
    assert {r.k for r in rows} == {1}
    n = {r.k: r.asDict() for r in redaction.redact(df, "k", "t").collect()}
    assert all(n[k][f"n_{step}"] == sum(r.k == k and r.step == step for r in rows) for k in n for step in redaction.KINDS)
    kinds = {r.k: r.asDict() for r in redaction.kind_counts(redaction.audit_all(df, "k", "t"), df, "k").collect()}
    assert kinds[1] == {"k": 1, "url": 1, "email": 1, "phone": 1, "year": 2, "address": 2, "name": 3} and sum(kinds[4].values()) == 4


def test_phone_pattern_like_python(spark):
    samples = ["603123456", "x603 123 456y", "1603123456", "(555) 123-4567", "555.123.4567", "v1.2.3", "+1 555 123 4567", "12-603123456"]
    df = spark.createDataFrame([(s,) for s in samples], "t string").select("t", F.regexp_extract_all("t", F.lit(f"({redaction.PHONE})"), F.lit(1)).alias("x"))
    assert {r.t: r.x for r in df.collect()} == {s: re.findall(redaction.PHONE, s) for s in samples}


def test_sections(spark):
    text = "Jana\n## Education\nEducation\nMgr. in statistics at the university of Brno.\nSkills:\nPython, SQL\nWORK EXPERIENCE\n- Led a small team of five engineers for years."
    df = spark.createDataFrame([(1, text), (2, None)], "k int, t string")
    ann = {r.k: r.annotated for r in sections.annotate(df, "k", "t").collect()}
    assert ann[1].count("## Education") == 1 and "## Skills:\nSkills:" in ann[1] and ann[2] is None
    assert {(r.section, r.n_lines) for r in sections.section_sizes(df, "k", "t").collect()} == {("", 1), ("education", 1), ("skills", 1), ("experience", 1)}
    quotes = {(r.quote, r.section) for r in sections.anchorable(df, "k", "t").collect()}
    assert quotes == {("Mgr. in statistics at the university of Brno", "education"), ("Led a small team of five engineers for years", "experience")}
    assert evidence.education_level(sections.section_slices(df, "k", "t"), "k").collect()[0].floor == 66
    assert one(spark, "experience x skills y languages z contact", sections.order_ok) is False
    assert one(spark, "```json\n{}\n```", sections.strip_fences) == "{}"


@pytest.mark.parametrize("text,years", [
    ("Sept 2015 - Jan 2026", 10), ("ledna 2017 - ledna 2021", 4), ("January 2020 - nyní", 6), ("2015 - 2020\n2018 - 2023", 8), ("2015 - 2017\n2020 - 2023", 5), ("prose", None), ("January 2020 - January 2018", None), ("January 2026 - Present", 0),
])
def test_tenure(spark, text, years):
    assert tenure.tenure_years(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").first().years == years


def test_timeline(spark):
    text = "Experience\nWork\nAcme\n• Analyst\n[YEAR] - [YEAR]\n\nBeta — Developer\n2014 - 2016 - Remote\nGamma\n[YEAR] -"
    got = [tuple(r)[2:] for r in tenure.timeline(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("pos").collect()]
    assert got == [("Work — Acme — Analyst", "[YEAR] - [YEAR]", False), ("Beta — Developer", "2014 - 2016 - Remote", False), ("Gamma", "[YEAR] -", True)]


def test_quote_rule(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g. x a b c d e f y one two three four five six seven eight one two three four five six seven eight")], "cv_id long, text string")
    quotes = ["a b c d e", "b c d e f g", "a b c d e f", "one two three four five six seven eight", None, ""]
    claims = spark.createDataFrame([(i, 1, 1, "skills", i, "claim", q, None) for i, q in enumerate(quotes)], "candidate_id long, cv_id long, attempt int, field string, ord int, text string, anchor_quote string, anchor_section string")
    got = {r.candidate_id: r.quote_found for r in verify.verify_quotes(claims, docs).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False, 5: False}


def test_fail_open(spark):
    g = spark.createDataFrame([(1, 9, "a", 1, "suspect"), (2, 9, "a", 2, "suspect"), (3, 8, "a", 1, "suspect"), (4, 8, "a", 2, "kept")], "candidate_id long, cv_id long, field string, ord int, verdict string")
    v = spark.createDataFrame([(9, 0, False), (8, 0, False)], "cv_id long, suspect_ord int, verdict boolean")
    got = {r.candidate_id: r.verdict for r in verify.adjudicate(g, v).collect()}
    assert got == {1: "kept", 2: "kept", 3: "dropped_by_judge", 4: "kept"}


def test_profile(spark):
    assert one(spark, "PySpark and power bi, ledger", lambda c: profile.labels(F.lower(c), profile.SKILLS)) == ["Spark", "Power BI"]
    assert one(spark, "mentored; ledger", lambda c: profile.labels(c, profile.SOFT_SIGNALS)) == ["mentorship"]
    c = spark.createDataFrame([("Head of Data",), ("Vedoucí týmu",), ("Wizard",), ("Data Scientist",), ("Staff Manager",), (None,)], "t string").select(profile.classify(F.col("t")).alias("c"))
    assert [(r.c.band, r.c.management) for r in c.collect()] == [("head", True), ("head", True), (None, None), ("mid", False), ("senior", True), (None, None)]
    e = spark.createDataFrame([(1, "skills", "A  b"), (1, "experience", "a b"), (1, "skills", None), (2, "soft_signals", "x")], "cv_id long, field string, anchor_quote string")
    assert {tuple(r) for r in profile.evidence_score(e).collect()} == {(1, 3), (2, 1)}


def test_market(spark):
    d = spark.createDataFrame([(1, "uk", None), (2, "AQ", "Prague"), (3, "AQ", "Berlin"), (4, None, None), (4, None, None)], "cv_id long, detected_country string, detected_location string")
    assert {(r.cv_id, r.country, r.currency, r.period, r.provenance) for r in market.resolve_markets(d).collect()} == {(1, "GB", "GBP", "year", "cv_explicit"), (2, "CZ", "CZK", "month", "inferred"), (3, "XX", "USD", "year", "default"), (4, "XX", "USD", "year", "default")}
    assert one(spark, "https://u@www.Platy.cz:80/x?y", market.host) == "u@www.Platy.cz:80"
    assert [one(spark, x, market.tld) for x in ("a.b.cz", "local", "", None)] == [".cz", "local", "(empty)", "(empty)"]


def numbers(text):
    spans, out = [], []
    parse = lambda t: float(t[:-1].strip().replace(",", ".")) * 1000 if t[-1] in "kK" else float(re.sub(r"\D", "", t))
    for m in re.finditer(evidence.RANGE_K, text):
        spans.append(m.span())
        out += [parse(m[1] + "k"), parse(m[2] + "k")]
    for m in re.finditer(evidence.NUMBER.replace(r"\x{a0}", "\xa0"), text):
        if all(m.end() <= a or m.start() >= b for a, b in spans):
            out.append(parse(m[1]))
    return sorted(v for v in out if v >= 10_000)


def test_snippet_numbers_like_brute_force(spark):
    texts = ["50-70k and 120 000 Kč", "10k to 12,5k", "year 2024, 9999, 12345", "1.234.567 or 55k", "abc", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", evidence.snippet_numbers(F.col("t")).alias("x"))
    assert {r.t: sorted(r.x) for r in df.collect()} == {t: numbers(t) for t in texts}
    assert [one(spark, t, evidence.period_hint) for t in ("CZK per month", "p.a.", "monthly, annually", "x")] == ["month", "year", "ambiguous", None]


@pytest.mark.parametrize("values,tier,reason", [
    ([("a", 100e3, None), ("b", 105e3, None), ("c", 110e3, None)], "High", "three_plus_domains_agree"), ([("a", 50e3, None), ("b", 100e3, None), ("c", 200e3, None)], "Low", "source_disagreement"),
    ([("a", 100e3, None), ("b", 110e3, None)], "Medium", "two_domains"), ([("a", 100e3, "month"), ("b", 110e3, "year")], None, "mixed_period"), ([("a", 1e5, None)], "Low", "fewer_than_two_domains"),
    ([("a", None, None)], None, "insufficient_numeric_evidence"), ([("a", 1e5, "month"), ("a", 1e5, "year"), ("b", 1e5, None)], None, "ambiguous_period"), ([("a", 1e5, None), ("b", None, None)], None, "insufficient_numeric_evidence"),
])
def test_rubric(spark, values, tier, reason):
    df = spark.createDataFrame([(1, *v) for v in values], "k int, s string, v double, p string")
    r = evidence.rubric(df, "k", "s", "v", "p").first()
    assert (r.tier, r.reason) == (tier, reason)


def test_score(spark):
    c = spark.createDataFrame([(1, "skills", 80), (1, "experience", 60), (1, "education", 40), (1, "soft_signals", 100), (2, "skills", 1), (2, "experience", 57), (2, "education", 14), (2, "soft_signals", 15)], "k int, n string, s int")
    assert {tuple(r) for r in evidence.weighted_total(c, "k", "n", "s").collect()} == {(1, 69), (2, 23)}


def test_actions(spark):
    reasons = {t: one(spark, t, lambda c: actions.drop_reason(c, F.lit(""))) for t in ("Get a Ph.D.", "Use GraphDB", "Consider dbt", "Learn\nmore SQL", "Build it")}
    assert reasons == {"Get a Ph.D.": "banned:phd", "Use GraphDB": None, "Consider dbt": "softener", "Learn\nmore SQL": "banned:learn more", "Build it": None}
    a = spark.createDataFrame([(1, i, f"Do  {i % 6}") for i in range(12)] + [(1, 99, None)], "k int, o int, t string")
    assert [r.t for r in actions.pool(a, "k", "t", ["o"]).orderBy("rn").collect()] == [f"Do  {i}" for i in range(5)]
    b = actions.boilerplate(spark.createDataFrame([(1, "one two three four five six!"), (2, "one two"), (3, None)], "k int, t string"), "k", "t", ["One two three four five six"])
    assert {r.k: (r.likeness, r.flagged) for r in b.collect()} == {1: (1.0, True), 2: (0.0, False), 3: (0.0, False)}


def test_runs(spark):
    assert one(spark, "a*b_[c](d)", runs.escape_markdown) == r"a\*b\_\[c\]\(d\)"
    assert one(spark, "<a href='x'>&\"", runs.escape_html) == "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"
    e = spark.createDataFrame([(1, "call", 0.1, '{"k": 5}'), (1, "call", 0.2, '{"k": "x"}'), (1, "other", 9.0, None)], "r int, e string, c double, p string")
    assert tuple(runs.cost_rollup(e, "r", "e", "call", "c", "p", "$.k").first()) == (1, 2, 0.3, 5)


def test_long_files_stay_whole(spark, tmp_path):
    from sparkfolio.sources import read_documents

    (tmp_path / "a.txt").write_text("x" * 60_000 + "end")
    assert [(r.text[-3:], len(r.text), r.problem) for r in read_documents(spark, str(tmp_path)).collect()] == [("end", 60_003, None)]
    assert [(r.text, r.problem) for r in read_documents(spark, str(tmp_path), max_chars=3).collect()] == [("xxx", "cut to 3 of 60003 characters")]


def test_sources(spark, tmp_path):
    from sparkfolio.sources import read_cassettes, read_documents

    d = tmp_path / "docs"
    d.mkdir()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(d / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (d / "b.txt").write_text("one\r\ntwo")
    (d / "c.docx").write_bytes(b"not a zip")
    (d / "e.doc").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.problem) for r in read_documents(spark, str(d)).collect()}
    assert got["a.docx"] == ("Hello\nCell", None) and got["b.txt"] == ("one\ntwo", None)
    assert got["c.docx"] == (None, "content doesn't fit the suffix") and got["e.doc"][1] == "unsupported suffix"
    (tmp_path / "c.json").write_text('{"q": [{"href": "http://a", "body": "x"}, {"url": "http://b"}]}')
    assert [tuple(r) for r in read_cassettes(spark, str(tmp_path / "c.json")).orderBy("rank").collect()] == [("q", 0, "http://a", "x"), ("q", 1, "http://b", "")]
