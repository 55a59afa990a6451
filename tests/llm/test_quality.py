import numpy as np
import pytest

from sparkfolio.llm import quality

PROSE = "The team wrote the tests for the index. It was a pleasure to work with everyone.\nThe offer depends on what the candidate has used before."
LIST = "\n".join(f"- item {w}" for w in "alpha beta gamma delta".split())
TABLE = "\n".join(f"{i}\tcity\t{i * 7}\tn/a" for i in range(6))


def stats(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as n_words")
    return {r.doc_id: r for r in quality.statistics(df).collect()}


def test_statistics(spark):
    s = stats(spark, [PROSE, LIST, TABLE, None, "", "  ", "a; b; c", "é" * 20000])
    assert s[0].n_lines == 2 and s[0].n_words == 26 and s[0].punct_end_share == 1.0 and s[0].common_share > 0.3 and s[0].cell_share == 0
    assert s[1].bullet_share == 1.0 and s[2].cell_share == 1.0 and s[2].bullet_share == 0
    for k in (3, 4, 5):
        assert s[k].n_words == 0 and s[k].n_lines == 0 and s[k].mean_word_len == 0.0
    assert s[6].separators == 2 and s[7].mean_word_len == 20000


def test_top_line_is_the_commonest_line(spark):
    s = stats(spark, ["head\nx\nmiddle\nx\nx\nfoot", "a\nb\nb\n\nb \nc\r\nc\nc", "a\nb\nc", "a\na", None, "x\n" * 9])
    assert [round(s[i].top_line_share, 6) for i in range(6)] == [0.5, round(3 / 7, 6), round(1 / 3, 6), 0.0, 0.0, 1.0]


def test_labels():
    assert [quality.label(t, "en") for t in (PROSE, LIST, TABLE, "a, b, c, d")] == ["prose", "list", "table", "list"]
    assert quality.label(PROSE, None) == "junk" and quality.label(None, None) == "junk"


def test_induction_learns_thresholds():
    rng = np.random.default_rng(0)
    X = rng.uniform(0, 1, (1500, len(quality.FEATURES)))
    f, g = quality.FEATURES.index("cell_share"), quality.FEATURES.index("bullet_share")
    y = np.where(X[:, f] >= 0.7, "table", np.where(X[:, g] >= 0.6, "list", "prose"))
    rules = quality.induce(X, y)
    out = np.full(len(X), "prose", object)
    left = np.ones(len(X), bool)
    for cls, rule in rules:
        m = left & quality._covers(rule, X)
        out[m] = cls
        left &= ~m
    assert (out == y).mean() > 0.98
    assert quality.to_case(rules).startswith("CASE WHEN n_words = 0 THEN 'junk' WHEN cell_share >=")


def test_classes(spark):
    rows = []
    for i in range(120):
        rows += [(4 * i, PROSE + f" Point {i}.", "en"), (4 * i + 1, LIST + f"\n- more {i}", "en"), (4 * i + 2, TABLE + f"\n{i}\tx\ty\tz", "en"), (4 * i + 3, f"\x01{i}%%$$##@@!!{{{{ }}}} \x02\n00 ff 1{i}", None)]
    rows += [(9000, None, None), (9001, " ", None), (0, rows[0][1], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.text_class for r in quality.document_classes(df).collect()}
    want = {i: quality.label(t, x) for i, t, x in rows}
    assert sum(got[k] == want[k] for k in want) / len(want) > 0.97 and got[9000] == got[9001] == "junk" and len(got) == len(want)
    assert quality.not_prose(df.where("false")).count() == 0


@pytest.mark.parametrize("rule", [[], [("table", [(9, ">=", 0.5)])]])
def test_case_is_sql(spark, rule):
    assert spark.createDataFrame([(0,)], "n_words int").selectExpr("*", "0.0 as bullet_share").selectExpr(quality.to_case(rule) + " as c").first().c == "junk"


def test_measures_count_blanks_of_every_kind(spark):
    rows = [(1, "\u00a0\u00a0"), (2, "Hello\u00a0the\u2003world.\n\u3000\n\u2014 a"), (3, None), (4, ""), (3, None)]
    got = {r.doc_id: r for r in quality.measures(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 4 and all(got[k].n_words == 0 and got[k].mean_word_len == 0 and got[k].punct_end_share == 0 for k in (1, 3, 4))
    assert got[2].n_words == 5 and got[2].mean_word_len == 3.2 and got[2].punct_end_share == 0.5 and got[2].symbol_ratio == 0.0625 and got[2].common_share == 0.4
