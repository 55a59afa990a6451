import numpy as np
import pytest

from sparkfolio.llm import pii
from sparkfolio.llm.boosting import BoostedTrees

FIRST, LAST = "Anna Petr Jana Lukas Marta Ivan Nora Karel Emma Leo".split(), "Velmirek Brodasov Karlinek Halvezon Misbutek Drovanek Snoravik Tormidek Plevasov Zembirek".split()


def sample():
    rng = np.random.default_rng(1)
    pick = lambda a: a[int(rng.integers(len(a)))]
    texts, log = [], []
    for i in range(260):
        n, m = f"{pick(FIRST)} {pick(LAST)}", f"{pick(FIRST)} {pick(LAST)}"
        ph = f"+420 {rng.integers(600, 799)} {rng.integers(100, 999)} {rng.integers(100, 999)}"
        mail = f"{n.split()[0].lower()}.{n.split()[1].lower()}{i}@mail.example"
        street = f"{pick(['Lipová', 'Javorová', 'Na Stráni'])} {rng.integers(1, 200)}"
        birth = next(f"8{rng.integers(0, 9)}0{rng.integers(1, 9)}1{rng.integers(0, 9)}/{x:04d}" for x in [int(rng.integers(1000, 9000))])
        d = int(birth.replace("/", ""))
        birth = f"{str(d - d % 11 if str(d - d % 11)[:6] == birth[:6] else d + 11 - d % 11)[:6]}/{str(d - d % 11 if str(d - d % 11)[:6] == birth[:6] else d + 11 - d % 11)[6:]}"
        texts.append(f"{n}\nData Analyst\n{mail}, {ph}, Brno\nAdresa: {street}, 602 00 Brno\nRodné číslo: {birth}\n\nWork\nMy line manager was {m} who helped.\nOur supplier {pick(LAST)} & {pick(LAST)} s.r.o delivered module {rng.integers(1, 9)}.{rng.integers(1, 40)}.{rng.integers(100, 4000)} on time.\nThe budget of {rng.integers(10, 90)} 400 000 EUR covered contract {rng.integers(100000, 990000)}/{rng.integers(1000, 9000)} as well.\nTicket #{rng.integers(1000000, 9000000)} was closed.\nData Platform and Power Tools in use at Nordvale Labs.")
        log += [(n, "[NAME]"), (m, "[NAME]"), (ph, "[PHONE]"), (mail, "[EMAIL]"), (street, "[ADDRESS]"), (f"{rng.integers(100000, 990000)}/{rng.integers(10000, 90000)}"[:11], "[PHONE]")]
    return texts, log


@pytest.fixture(scope="module")
def detector():
    return pii.Detector(*sample())


def found(detector, text, whole=False):
    return {(k, text[s:e]) for k, s, e, _ in detector.mentions_batch([text], whole)[0]}


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    X = rng.normal(size=(2000, 6))
    y = ((X[:, 0] > 0) & (X[:, 1] > 0.5)).astype(int)
    m = BoostedTrees().fit(X[:1500], y[:1500]).calibrate(X[1500:], y[1500:])
    assert ((m.predict(X[1500:]) >= m.threshold) == y[1500:]).mean() > 0.97


def test_mentions(detector):
    text = sample()[0][3]
    got = found(detector, text)
    lines = text.split("\n")
    assert ("name", lines[0]) in got and ("email", lines[2].split(",")[0]) in got and ("phone", lines[2].split(", ")[1]) in got
    assert ("address", lines[3][8:].split(",")[0]) in got and ("identity", lines[4].split(": ")[1]) in got
    assert ("name", lines[7][20:].split(" who")[0]) in got and len(got) == 6


def test_hidden_characters_and_empty_texts(detector):
    text = sample()[0][5]
    name = text.split("\n")[0]
    disguised = text.replace(name, name.replace("a", "а", 1))
    assert ("name", name.replace("a", "а", 1)) in found(detector, disguised)
    assert found(detector, "") == set() and found(detector, "\n" * 5000) == set()


@pytest.mark.parametrize("at", ["@", " at ", "[at]", "[AT]", " (AT) ", "{at}", "[ at ]", "[arroba]", "(arobase)", "(ZAVINAC)", "[zavináč]", "{ Arroba }"])
def test_every_form_of_an_email_is_a_candidate(at):
    text = f"jana.nova{at}mail.example"
    assert ("email", 0, len(text)) in pii.spans_of(text)


def test_fold_keeps_places():
    for t in ("Jаna Nováková", "a​b", "ﬁx ＡＢ", "plain"):
        f, place = pii.folded(t)
        assert place is None or len(place) == len(f) + 1
    assert pii.folded("a​b")[1] == [0, 2, 3]


def test_operator(spark):
    texts, log = sample()
    cvs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, "")], "cv_id long, text string").selectExpr("*", "'k' as kind")
    lg = spark.createDataFrame([(i, o, r) for i, (o, r) in enumerate(log)] + [(0, *log[0]), (9999, None, "[NAME]"), (9998, "", None)], "redaction_id long, original string, replacement string").selectExpr("*", "1 as cv_id", "'t' as text")
    rows = pii.found_mentions(cvs, lg).collect()
    assert len(rows) == len(set(rows)) and {r.field for r in rows} == {pii.TEXT_FIELD, pii.LOG_FIELD}
    per = [r for r in rows if r.field == pii.TEXT_FIELD]
    assert len(per) > 5.8 * len(texts) * 0.97
    red = {r.cv_id: r for r in pii.redact_texts(cvs, lg).collect()}
    assert red[1000].text is None and red[1001].text == "" and "[NAME]" in red[3].text and "@" not in red[3].text.replace("data@scale", "")
