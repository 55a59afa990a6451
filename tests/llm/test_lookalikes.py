import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparkfolio.llm.lookalikes import matches_by_look, one_form, targets_of

ALPHABET = "abcíěŘ \n\t  ​﻿­ＡｂеоѕΟνﬁ‑́̌̃́xyž"


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return {r.k: r.f for r in one_form(df, "k", "t", "f").collect()}


def test_cases(spark):
    got = forms(spark, ["Ａbc oо ﬁn  x\n", None, "", "plain", "​", "Převěl", "á", "ni​́", "x" * 50000 + "о"])
    assert got[0] == "Abc oo fin  x " and got[1] is None and got[2] == "" and got[3] == "plain" and got[4] == ""
    assert got[5] == "Převěl" and got[6] == "á" and got[7] == "ní" and got[8] == "x" * 50000 + "o"


def test_characters_above_the_first_plane(spark):
    got = forms(spark, ["\U0001d402\U0001d41a\U0001d42d \U0001d7d7", "c\U000e0001a\U000e0100t", "\U0002f800", "\U0001f600 x"])
    assert got == {0: "Cat 9", 1: "cat", 2: "\u4e3d", 3: "\U0001f600 x"}


def test_other_scripts(spark):
    got = forms(spark, ["\u13aa\u13e2 \ua4d0\ua4f3 \u0585\u057d \u2c9f ᴄ", "\u13a0ata"])
    assert got == {0: "AP BO ou o c", 1: "Data"}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(ALPHABET, max_size=14), min_size=20, max_size=60))
def test_like_unicode(spark, texts):
    """Decomposition, order of marks and recomposition agree with NFC wherever at most one mark of a base composes."""
    got = forms(spark, texts)
    for k, t in enumerate(texts):
        want = unicodedata.normalize("NFD", "".join(targets_of(c) for c in t))
        assert unicodedata.normalize("NFD", got[k]) == want


def test_marks_in_any_order_are_one_form(spark):
    a, b, c = forms(spark, ["ạ́", "ạ́", "ạ́"]).values()
    assert a == b == c


def test_matches(spark):
    q = spark.createDataFrame(
        [(1, 9, "cаt sat"), (2, 9, "the cat"), (3, 9, "Cat"), (4, 9, None), (5, 9, ""), (6, 9, "​"), (7, 8, "cаt"), (8, None, "cаt"), (1, 9, "cаt sat"), (9, 9, "ｃat sat")],
        "candidate_id long, cv_id long, anchor_quote string",
    ).selectExpr("*", "'x' as text")
    t = spark.createDataFrame([(9, "the cat sat"), (7, None)], "cv_id long, text string").selectExpr("*", "'y' as anchor_quote")
    assert {r.candidate_id for r in matches_by_look(q, t).collect()} == {1, 9}
    assert matches_by_look(q.where("false"), t).count() == 0
