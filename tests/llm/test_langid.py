import pandas as pd
import pytest

from sparkfolio.llm import langid

SAMPLES = {
    "en": "the team wrote the tests and the documentation for the search index which had none before and everyone was happy with that",
    "de": "das Team hat die Dokumentation geschrieben und alle waren damit sehr zufrieden weil es vorher keine gegeben hatte",
    "fr": "l'équipe a écrit la documentation et les essais pour le moteur de recherche et tout le monde était content du résultat",
    "es": "el equipo escribió la documentación y las pruebas para el buscador y todos estaban muy contentos con el resultado",
    "cs": "tým napsal dokumentaci a testy pro vyhledávač a všichni byli s výsledkem velmi spokojeni protože předtím žádné nebyly",
    "sk": "tím napísal dokumentáciu a testy pre vyhľadávač a všetci boli s výsledkom veľmi spokojní pretože predtým žiadne neboli",
}


@pytest.fixture(scope="module")
def models():
    return langid.train(pd.DataFrame([(k, v + ". " + " ".join(reversed(v.split()))) for k, v in SAMPLES.items() for _ in range(9)], columns=["lang", "text"]))


def test_label_sets():
    assert langid.label_set("cz+EN") == {"cs", "en"} and langid.label_set("fr-FR, German") == {"fr", "de"}
    assert langid.label_set("unknown") == langid.label_set(None) == langid.label_set("") == frozenset()


LABELS = ["cz+EN", "fr-FR, German", "unknown", None, "", "Čeština / Slovak", "de_AT;es", "_cs", "cs - en", "EN", "Español", "cs,cs", "Französisch"]


def test_label_columns(spark):
    df = spark.createDataFrame([(x,) for x in LABELS], "label string")
    got = [r.n for r in df.select(langid.named_languages(df.label).alias("n")).collect()]
    assert got == [sorted(langid.label_set(x)) for x in LABELS]


def test_classes_and_rejection(models):
    for k, v in SAMPLES.items():
        assert models.classify(" ".join(v.split()[3:12]))[0] == k
        assert models.classify(langid.strip_accents(v))[0] == k
    assert models.classify("")[0] is None and models.classify("123 456")[0] is None and models.classify("汚灥樠敳湳獯汩 qzxwv kjhgf zxcvb qwrtp")[0] is None


def test_a_batch_equals_single_texts(models):
    texts = [*SAMPLES.values(), "", "ab", "x" * 5000]
    for a, b in zip(models.classify_all(texts), [models.classify(t) for t in texts]):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-4)


def test_probabilities_sum_to_one_at_most(models):
    import numpy as np

    chars = "abcdefghijklmnopqrstuvwxyzáéíóúýčďěňřšťůžäöüßñçèàôľ '"
    text = langid.clean(SAMPLES["cs"])[:12]
    for k in range(len(models.langs)):
        total = 0.0
        for c in chars:
            with_c, without = models.entropies([text + c])[0][k] * len(text), models.entropies([text])[0][k] * (len(text) - 1)
            total += np.exp(-(with_c - without))
        assert 0.5 < total <= 1.01


def test_repairs(spark):
    docs = spark.createDataFrame([(i, k, v + ". " + " ".join(reversed(v.split()))) for i, (k, v) in enumerate((k, v) for k, v in SAMPLES.items() for _ in range(9))] + [(999, None, None)], "doc_id long, lang string, text string")
    en, de = SAMPLES["en"] + ".", SAMPLES["de"] + "."
    cvs = spark.createDataFrame([(1, f"Name\n\n{en}\n\n{de}"), (2, f"{en}\n\nSkills"), (3, en), (4, en), (5, "Short line."), (6, None), (7, "")], "cv_id long, text string").selectExpr("*", "'z' as lang")
    fix = spark.createDataFrame([(2, "de"), (3, "English"), (4, None), (4, None), (1, "en+de")], "cv_id long, source_language string")
    got = {tuple(r) for r in langid.language_repairs(cvs, fix, docs).collect()}
    assert got == {(1, 2, "en"), (1, 3, "de"), (2, 0, "en"), (4, 0, "en")}
