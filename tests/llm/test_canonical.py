import random

import pytest

from sparkfolio.llm.canonical import Matcher, Trie, all_matches, allowed, core_of, found_roles

ROLES = [(1, "junior data analyst", "junior", False, "junior datový analytik"), (2, "data analyst", "mid", False, "datový analytik"), (3, "senior data analyst", "senior", False, "senior datový analytik"), (4, "staff data analyst", "staff", False, "staff datový analytik"), (5, "machine learning engineer", "mid", False, "inženýr strojového učení"), (6, "head of analytics", "head", True, "vedoucí analytiky")]


def distance(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_trie_equals_brute_force():
    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    t = Trie()
    for i, w in enumerate(words):
        t.add(w, i)
    for _ in range(150):
        q = "".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))
        for limit in (0, 1, 2):
            assert t.search(q, limit) == {i: d for i, w in enumerate(words) if (d := distance(q, w)) <= limit}


@pytest.mark.parametrize("value,role", [
    ("Jr. Data Anlst", 1), ("data analsyt", 2), ("Analyst, Data (Sr)", 3), ("Principal datovy analytik | SQL", 4), ("ML Eng. at Acme", 5), ("Head Of Analytics – Praha", 6), ("head, analytics", 6),
    ("Data Analyst, 5 years", 2), ("Data-Analyst (m/f/d)", 2), ("Coffee Evangelist", 0), ("Data Entry Clerk", 0), ("!!!", 0), ("x" * 3000, 0),
])
def test_match(value, role):
    assert Matcher(ROLES).match(value)[0] == role


def test_length_dependent_distance():
    assert [allowed(n) for n in (3, 5, 11, 12, 40)] == [0, 1, 1, 2, 2] and core_of("Senior Data Analyst at Foo") == ("data analyst", "senior")


def test_operator(spark):
    roles = spark.createDataFrame(ROLES, "role_id int, canonical_role string, seniority_band string, is_management boolean, title_cs string")
    rows = [(i, "Data Analyst") for i in range(300)] + [(900, None), (901, "  "), (902, "Gardener"), (902, "Gardener"), (None, "Data Analyst")]
    df = spark.createDataFrame(rows, "cv_id long, detected_role string").selectExpr("*", "1 as role_id", "'s' as salt")
    got = {tuple(r) for r in found_roles(df, roles).collect()}
    assert got == {(i, 2) for i in range(300)} | {(902, 0)}
    assert found_roles(df.where("false"), roles).count() == 0


def test_all_entries_within_the_distance(spark):
    """Every entry, against the distance to every path; role 0 where none is near."""
    m = Matcher(ROLES)
    values = ["data analyst", "dta anlyst", "head of analytic", "ml engineer", "gardener", "Sr data analsyt"]
    for v in values:
        core = core_of(v)[0]
        want = {}

        def walk(node, path):
            for occupation in node[1]:
                for c in {core, core.replace(" ", "")}:
                    if (d := distance(c, path)) <= allowed(len(c)):
                        want[occupation] = min(d, want.get(occupation, 99))
            for ch, child in node[0].items():
                walk(child, path + ch)

        walk(m.trie.root, "")
        assert m.all_within(v) == {m._entry(o, core_of(v)[1]): d for o, d in want.items()}
        assert m.match(v)[1] == min(want.values(), default=-1)
    roles = spark.createDataFrame(ROLES, "role_id int, canonical_role string, seniority_band string, is_management boolean, title_cs string")
    df = spark.createDataFrame([(v,) for v in values + [None, " ", "gardener"]], "detected_role string")
    got = {(r.detected_role, r.role_id, r.distance) for r in all_matches(df, roles).collect()}
    assert got == {(v, e, d) for v in values for e, d in (m.all_within(v) or {0: -1}).items()}
    assert all_matches(df.where("false"), roles).count() == 0
