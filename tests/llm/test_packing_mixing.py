import os
import random

import pytest

from sparkfolio.llm import mixing, packing

pytestmark = pytest.mark.skipif(not os.path.exists(packing.TOKENIZER_FILE), reason="no tokenizer file")


def test_pack_is_whole_and_tight():
    rng = random.Random(6)
    for _ in range(20):
        items = [(i, rng.randint(1, 100)) for i in range(rng.randint(0, 120))]
        out = packing.pack(items, 100)
        assert sorted(x for b in out for x in b) == sorted(items) and all(sum(s for _, s in b) <= 100 for b in out)
        assert len(out) <= len(packing.best_fit(items, 100))


def test_near_the_least_number():
    """Items cut from full containers: the optimum is known."""
    rng = random.Random(9)
    items = []
    for _ in range(60):
        a, b = sorted(rng.sample(range(5, 95), 2))
        items += [a, b - a, 100 - b]
    out = packing.pack(list(enumerate(items)), 100)
    assert len(out) <= 62


def fewest(sizes, capacity):
    """Brute force over all assignments."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i]:
                go(i + 1, rooms[:j] + [rooms[j] - sizes[i]] + rooms[j + 1:])
        go(i + 1, rooms + [capacity - sizes[i]])

    go(0, [])
    return best


def test_search_finds_the_least_number():
    rng, better = random.Random(11), 0
    for _ in range(120):
        sizes = [rng.randint(15, 60) for _ in range(rng.randint(3, 9))]
        want = fewest(sorted(sizes, reverse=True), 100)
        assert packing.least_containers(sizes, 100) <= want
        got = packing.pack(list(enumerate(sizes)), 100)
        assert len(got) == want and sorted(x for c in got for x in c) == sorted(enumerate(sizes))
        better += want < len(packing.best_fit(list(enumerate(sizes)), 100))
    assert better  # best fit alone isn't enough


def test_search_where_filling_each_fullest_is_wrong():
    # The fullest filling beside 60 is 40, which leaves 39 + 39 + 39 with too little beside them.
    sizes = [55, 45, 44, 30, 29, 28, 27, 21, 21]
    assert len(packing.pack(list(enumerate(sizes)), 100)) == fewest(sizes, 100)
    assert packing.search([60, 60, 60], 100, 3) is None and packing.search([50, 50], 100, 2) == [[50, 50]]
    assert packing.search([55, 45, 44, 30, 29, 28, 27, 21, 21], 100, 4, nodes=0) is None


def test_dominated():
    assert packing.dominated([30], 10, {10: 1}, [10, 30])  # what fits beside
    assert packing.dominated([30], 10, {38: 1}, [30, 38])  # in place of one
    assert packing.dominated([30, 25], 5, {58: 1}, [25, 30, 58])  # in place of two
    assert not packing.dominated([30, 25], 2, {20: 1, 33: 1}, [20, 25, 30, 33])


def test_completion_finds_perfect_fillings():
    sizes = packing._Sizes([60, 50, 33, 26, 14, 7])
    assert sum(packing.complete(60, 40, sizes, 1000)) == 40  # 33 + 7, where the greedy choice finds it too
    sizes = packing._Sizes([50, 30, 25, 25, 19])
    assert sum(packing.complete(50, 50, sizes, 1000)) == 50  # 25 + 25, where best fit takes 30 + 19


def test_completion_takes_any_number_of_items():
    assert packing.complete(60, 104, packing._Sizes([60, 50, *[13] * 8])) == [13] * 8  # best fit takes 50 + 4 * 13
    rng = random.Random(4)
    for tables in (1, 3, 64):
        for _ in range(100):
            items = [rng.randint(3, 60) for _ in range(rng.randint(1, 14))]
            first, rest = max(items), sorted(items)[:-1]
            room = rng.randint(0, 200)
            sums = {0}
            for x in rest:
                sums |= {x + y for y in sums}
            got = packing.complete(first, room, packing._Sizes(items), tables)
            assert sum(got) == max(x for x in sums if x <= room) and all(got.count(x) <= rest.count(x) for x in got)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "5 as tokens", "'c' as part")


def test_pack_documents(spark):
    rng = random.Random(7)
    rows = [(i, "word " * rng.randint(1, 60), "a") for i in range(300)] + [(900, "word " * 1000, "a"), (901, None, "a"), (902, "", None), (1, "word", "a"), (None, "x", "a")]
    limits = spark.createDataFrame([("small", 64), ("big", 256), ("big", 128), (None, 3)], "container_kind string, capacity_tokens int")
    out = packing.pack_documents(docs(spark, rows), limits).toPandas()
    size = {r.doc_id: r.tokens for r in packing.token_counts(docs(spark, rows)).collect()}
    for kind, cap in (("small", 64), ("big", 256), ("big", 128)):
        o = out[(out.container_kind == kind) & (out.capacity_tokens == cap)]
        assert o.groupby("container").tokens.sum().max() <= cap
        assert o.groupby("doc_id").tokens.sum().to_dict() == {k: v for k, v in size.items() if v}
        assert set(o[o.groupby("doc_id").part.transform("nunique") > 1].doc_id) == {k for k, v in size.items() if v > cap}
    assert packing.packing_report(packing.pack_documents(docs(spark, rows), limits)).toPandas().fill.min() > 0.9
    assert packing.pack_documents(docs(spark, rows).where("false"), limits).count() == 0


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, "word " * rng.randint(1, 40), "abc"[min(2, i % 7 // 3)]) for i in range(2000)] + [(9000, "word", None), (9001, None, "a"), (9002, "word", "zz"), (1, "word", "a")]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.19, 4), ("none", 0.01, 4)], "source string, target_share double, max_repeats int")
    sel = mixing.mix_sources(docs(spark, rows), targets)
    got = {r.source: r for r in mixing.mix_report(sel, targets).collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.19)):
        assert got[s].reached_share == pytest.approx(share / 0.99, abs=0.01)
        assert got[s].most_uses <= got[s].max_repeats
    assert got["none"].tokens == 0
    assert {tuple(r) for r in sel.collect()} == {tuple(r) for r in mixing.mix_sources(docs(spark, rows), targets).collect()}
    assert mixing.mix_sources(docs(spark, rows).where("false"), targets).count() == 0
    more = mixing.mix_sources(docs(spark, rows), targets, total_tokens=10**9)
    assert {r.source: r.most_uses for r in mixing.mix_report(more, targets).collect()} == {"a": 1, "b": 2, "c": 4, "none": 0}
