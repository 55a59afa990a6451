"""Per-document text statistics, and an ordered rule list that tells prose from lists, tables and junk.

All statistics are built-in SQL expressions over whole texts.  An ordered rule list is induced by
incremental reduced-error pruning on a bounded sample of labelled documents; its thresholds are exported
to one SQL CASE expression, which classifies every document natively.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import BLANK
from .sampling import lowest_hashes

# The commonest words of the six languages.
COMMON_WORDS = (
    "the of and to in a is that for it was on with as be by are this have from which had has not they their but been who will more"
    " se na je v že jsem do s z i by pro o k po od až co jak který která které jsme při také jsou byl tak než"
    " der die das und in zu den von mit ist des auf für ich sich dem ein eine wird sind im als auch es an nach wir aus bei"
    " le la les de des et en un une du est que dans pour qui par sur au avec il ne pas plus nous sont mais d l j"
    " el los las del y que un una por con para es se su al lo como más o pero sus desde hace me"
    " som sa že na ktorý ktorá ktoré pre pri tým má sme ako bol alebo so zo"
)
#: Bound of the training sample: documents without a language and with one (lowest hash of the id first).
JUNK_DOCS, OTHER_DOCS = 1500, 9000
CLASSES = ["table", "list", "junk"]  # the order of the rule list; anything else is prose
FEATURES = [
    "n_chars", "n_lines", "n_words", "mean_word_len", "letter_ratio", "digit_ratio", "symbol_ratio", "punct_end_share", "common_share",
    "bullet_share", "short_share", "cell_share", "distinct_line_share", "top_line_share", "readable_share", "separators", "words_per_line", "seps_per_word", "cluster_share", "latin_ratio",
]

_BULLET = r"^\s*(?:[-•*–—·▪◦○■□☐☑✓✔>+→]|\[[ xX]?\]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.)]|#\d{1,3}:?)\s+\S"
_CELLS = r"\t|^\s*\||\s\|\s.*|\S {2,}\S|^[+|:\-= ]{5,}$|;\S*;|;[^; ]*$|,\S*,|^[^ ,]+,[^ ,]+$|\",|,\""
_SEPARATED = r" [|/•·;–—-] |[;,|•·] ?(?=\S)"
_READABLE = r"(?<![\p{L}\p{N}_�{}()\[\]<>=:&!`~\\])\p{IsLatin}(?:\p{Ll}{2,}+|\p{Lu}{2,}+|\p{Ll})(?:['’-]\p{IsLatin}+)*+(?=[\s.,;:!?)\"'’|/•·]|\z)"

_UP_TO_6, _UP_TO_9 = r"^\s*(?:\S+\s+){0,5}\S+\s*$", r"^\s*(?:\S+\s+){0,8}\S+\s*$"
#: Consonants that hardly follow one another in any of the languages; r and l may stand for a vowel.
_CLUSTER = r"[bcdfghjkmnpqstvwxz]{5}|(?<= )[bcdfghjkmnpqstvwxzrl]{4,}(?= )|[jqvxwz]{3}|[bdfgjkpqvwxz]{4}"


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with one column per statistic in FEATURES, over the whole text.

    A null or blank text has zero lines, words and shares.  Columns of df with the same names are replaced.
    What several statistics need (lines, lower-case words, lengths) is a column of its own and computed once.
    """
    blank = f"{BLANK}+"
    out = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    t = F.col("_t")
    without = lambda rx: F.length(F.regexp_replace(t, rx, ""))
    out = out.withColumns({
        "n_chars": F.length(t),
        "_lines": F.filter(F.split(t, r"\r?\n"), lambda x: ~x.rlike(f"^{BLANK}*$")),
        "_solid": without(blank),
        "n_words": F.size(F.filter(F.split(t, blank), lambda x: x != "")),
        "_plain": F.concat(F.lit(" "), F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}'’]+", " ")), F.lit(" ")),
        "_letters": F.length(t) - without(r"\p{L}+"),
        "_latin": F.length(t) - without(r"\p{IsLatin}+"),
        "_digits": F.length(t) - without(r"\p{Nd}+"),
        "_marks": F.length(t) - without(r"[.,;:!?'’\"()-]+"),
        "_readable": F.length(t) - without(_READABLE),
        "separators": F.regexp_count(t, F.lit(_SEPARATED)),
    })
    lines = F.col("_lines")
    out = out.withColumn("n_lines", F.size(lines))
    over = lambda x, n: F.when(F.col(n) > 0, x / F.col(n)).otherwise(0.0)
    share = lambda cond: over(F.size(F.filter(lines, cond)), "n_lines")
    # The commonest line is the longest run among the sorted lines.
    state = lambda last, run, top: F.struct(last.alias("last"), run.alias("run"), top.alias("top"))

    def longer(a: Column, x: Column) -> Column:
        run = F.when(x == a["last"], a["run"] + 1).otherwise(F.lit(1))
        return state(x, run, F.greatest(a["top"], run))

    top_line = F.aggregate(F.array_sort(lines), state(F.lit(""), F.lit(0), F.lit(0)), longer, lambda a: a["top"])
    words = list(dict.fromkeys(COMMON_WORDS.split()))
    out = out.withColumns({
        "mean_word_len": over(F.col("_solid"), "n_words"),
        "letter_ratio": over(F.col("_letters"), "_solid"),
        "digit_ratio": over(F.col("_digits"), "_solid"),
        "latin_ratio": over(F.col("_latin"), "_solid"),
        "symbol_ratio": over(F.greatest(F.col("_solid") - F.col("_letters") - F.col("_digits") - F.col("_marks"), F.lit(0)), "_solid"),
        "readable_share": over(F.col("_readable"), "_solid"),
        "common_share": over(F.size(F.filter(F.split("_plain", " "), lambda w: w.isin(words))), "n_words"),
        "cluster_share": over(F.regexp_count("_plain", F.lit(_CLUSTER)), "n_words"),
        "punct_end_share": share(lambda x: x.rlike(r"[.!?:…]['\"”)]?\s*$")),
        "bullet_share": share(lambda x: x.rlike(_BULLET) & x.rlike(_UP_TO_9) & ~x.rlike(r"\S {2,}\S|\t")),
        "short_share": share(lambda x: x.rlike(_UP_TO_6) & ~x.rlike(r"[.!?]\s*$|\t|\S {3,}\S|\s\|\s|^\s*\||;\S+;|,\S+,")),
        "cell_share": share(lambda x: ~x.rlike(r"(?:\p{Ll}+ ){5}|[\p{Ll}\d)]\.\s.*\p{Ll}{3}") & x.rlike(_CELLS)),
        "distinct_line_share": over(F.size(F.array_distinct(lines)), "n_lines"),
        "top_line_share": F.when(F.col("n_lines") >= 3, over(top_line, "n_lines")).otherwise(F.lit(0.0)),
        "words_per_line": over(F.col("n_words"), "n_lines"),
        "seps_per_word": over(F.col("separators"), "n_words"),
    })
    return out.drop("_t", "_lines", "_plain", "_solid", "_letters", "_latin", "_digits", "_marks", "_readable")


# --- labels of the training sample -------------------------------------------------------------------


def _cells(line: str) -> int:
    for sep in ("\t", "|", ";"):
        if sep in line:
            return len(line.split(sep)) if sep != "|" else len([c for c in line.strip("| ").split("|")])
    if re.fullmatch(r"[+\-=: ]{5,}", line.strip()):
        return 2
    parts = re.split(r" {2,}", line.strip())
    if len(parts) > 1:
        return len(parts)
    return len(line.split(",")) if re.search(r",\S", line) and not re.search(r", ", line) else 1


def label(text: str | None, lang: str | None) -> str:
    """The class of a sampled document by its definition; a document without a language is junk."""
    if lang is None or not isinstance(lang, str) or not isinstance(text, str) or not text.strip():
        return "junk"
    lines = [x for x in text.split("\n") if x.strip()]
    n = len(lines)
    prose = [bool(re.search(r"[a-zà-ž)\d][.!?][\"')]?\s*$", x)) and len(x.split()) >= 4 or len(re.findall(r"\b[a-zà-ž]+\b", x)) >= 7 and not re.search(r"\t| {2,}\S|\|", x) for x in lines]
    rows = [not p and _cells(x) >= 2 for x, p in zip(lines, prose)]
    if n >= 3 and sum(rows) >= 2 * n / 3:
        return "table"
    if n == 1:
        parts = re.split(r"\s[|/•·;–—-]\s|[;|•·,]\s?", lines[0])
        return "list" if len(parts) >= 3 and len(lines[0].split()) / len(parts) <= 5 and not lines[0].rstrip().endswith(".") else "prose"
    items = [not p and not r and len(re.sub(_BULLET[:-2], "", x).split()) <= 7 for x, p, r in zip(lines, prose, rows)]
    # Wrapped prose has short lines too, but its sentences end inside or at the end of lines.
    stops = len(re.findall(r"[a-zà-ž)\d][.!?](?:\s|$)", text))
    marked = sum(bool(re.match(_BULLET, x)) for x in lines)
    if sum(items) >= 2 * n / 3 and (marked >= n / 2 or stops <= n / 4):
        return "list"
    return "prose"


# --- incremental reduced-error pruning ----------------------------------------------------------------


def _covers(rule, X):
    m = np.ones(len(X), bool)
    for f, op, v in rule:
        m &= X[:, f] >= v if op == ">=" else X[:, f] < v
    return m


def _grow(X, y, w, max_conditions=5):
    """Add the condition of best FOIL gain until no negative is covered.  w: what a row stands for."""
    rule, m = [], np.ones(len(X), bool)
    while len(rule) < max_conditions:
        p0, n0 = w[m & y].sum(), w[m & ~y].sum()
        if n0 == 0 or p0 == 0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for f in range(X.shape[1]):
            x, t, v = X[m, f], y[m], w[m]
            order = np.argsort(x, kind="stable")
            xs = x[order]
            cut = np.flatnonzero(xs[1:] > xs[:-1]) + 1
            if not len(cut):
                continue
            pos, every = np.concatenate([[0], np.cumsum((t * v)[order])]), np.concatenate([[0], np.cumsum(v[order])])
            for op, p, k in (("<", pos[cut], every[cut]), (">=", p0 - pos[cut], every[-1] - every[cut])):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / k) - base), -1.0)
                j = int(np.argmax(gain))
                if gain[j] > best[0] + 1e-9:
                    best = (float(gain[j]), (f, op, float((xs[cut[j] - 1] + xs[cut[j]]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        m = _covers(rule, X)
    return rule


def _prune(rule, X, y, w):
    """Drop final conditions while (p - n) / (p + n) on the pruning set doesn't fall."""

    def worth(r):
        m = _covers(r, X)
        p, n = w[m & y].sum(), w[m & ~y].sum()
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def induce(X: np.ndarray, labels: np.ndarray, weight: np.ndarray | None = None, seed: int = 0, max_rules: int = 12) -> list[tuple[str, list]]:
    """Ordered rules (class, conditions), classes in the order of CLASSES; weight: how many documents a sampled one stands for."""
    rng, rules = np.random.default_rng(seed), []
    weight = np.ones(len(X)) if weight is None else np.asarray(weight, float)
    left = np.ones(len(X), bool)
    for cls in CLASSES:
        for _ in range(max_rules):
            idx = rng.permutation(np.flatnonzero(left))
            y = labels[idx] == cls
            if y.sum() < 3:
                break
            # Both parts keep the share of the class.
            part = np.zeros(len(idx), bool)
            part[np.flatnonzero(y)[::3]] = True
            part[np.flatnonzero(~y)[::3]] = True
            w = weight[idx]
            rule = _prune(_grow(X[idx][~part], y[~part], w[~part]), X[idx][part], y[part], w[part])
            m = _covers(rule, X[idx][part])
            if not rule or m.sum() == 0 or w[part][m & y[part]].sum() <= 0.8 * w[part][m].sum():
                break
            rules.append((cls, rule))
            left &= ~_covers(rule, X)
    return rules


def to_case(rules: list[tuple[str, list]]) -> str:
    """The rule list as one SQL CASE expression over the statistics."""
    whens = " ".join(f"WHEN {' AND '.join(f'{FEATURES[f]} {op} {v!r}' for f, op, v in rule)} THEN '{cls}'" for cls, rule in rules)
    return f"CASE WHEN n_words = 0 THEN 'junk' {whens} ELSE 'prose' END"


def training_sample(documents: DataFrame) -> pd.DataFrame:
    """At most JUNK_DOCS documents without and OTHER_DOCS with a language, with their statistics and label."""
    part = F.col("lang").isNull()
    rows = lowest_hashes(documents, "doc_id", [(part, JUNK_DOCS), (~part, OTHER_DOCS)]).select("doc_id", "text", "lang").toPandas()
    # The sample goes back as a local table: statistics above a limit would be computed for every document.
    again = documents.sparkSession.createDataFrame(rows.drop_duplicates("doc_id").astype(object).where(lambda x: x.notna(), None), "doc_id long, text string, lang string")
    sample = statistics(again).toPandas().sort_values("doc_id").reset_index(drop=True)
    sample["label"] = [label(t, x) for t, x in zip(sample.text, sample.lang)]
    # Each sampled document stands for its share of all documents with, or all without, a language.
    every = {bool(r[0]): r[1] for r in documents.groupBy(F.col("lang").isNull()).count().collect()}
    none = sample.lang.isna()
    sample["weight"] = np.where(none, every.get(True, 0) / max(1, int(none.sum())), every.get(False, 0) / max(1, int((~none).sum())))
    return sample


def learn(documents: DataFrame) -> list[tuple[str, list]]:
    s = training_sample(documents)
    return induce(s[FEATURES].to_numpy(float), s.label.to_numpy(), s.weight.to_numpy()) if len(s) else []


def _spread(documents: DataFrame) -> DataFrame:
    spark = documents.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return documents.where("doc_id is not null").select("doc_id", "text").repartition(n, "doc_id")


def document_classes(documents: DataFrame) -> DataFrame:
    """doc_id, all statistics and text_class of every document; repeated rows of a document count once."""
    case = to_case(learn(documents))
    return statistics(_spread(documents)).drop("text").withColumn("text_class", F.expr(case)).dropDuplicates(["doc_id"])


MEASURES = ["n_words", "mean_word_len", "symbol_ratio", "punct_end_share", "common_share"]


def measures(documents: DataFrame) -> DataFrame:
    """(doc_id, and the MEASURES, shares rounded to six places) of every document, without a model."""
    rows = statistics(_spread(documents)).dropDuplicates(["doc_id"])
    return rows.select("doc_id", "n_words", *(F.round(m, 6).alias(m) for m in MEASURES[1:]))


def not_prose(documents: DataFrame) -> DataFrame:
    """p10: (doc_id, text_class) of documents that aren't prose."""
    # A plain filter on the class would be pushed below and compute all statistics twice; a generator isn't.
    classed = F.filter(F.array(F.expr(to_case(learn(documents)))), lambda c: c != "prose")
    return statistics(_spread(documents)).select("doc_id", F.explode(classed).alias("text_class")).distinct()
