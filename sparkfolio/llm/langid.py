"""Document and segment languages by interpolated Kneser-Ney character models.

One model per language, trained from labelled documents; the models share sorted arrays of n-gram hashes,
one array per order, with a row of log probabilities (and of log back-off weights) per n-gram.  A text's
language is the one with the lowest length-normalised cross-entropy; its confidence is a softmax of the
entropies whose temperature, and the highest entropy still accepted, are calibrated on held-out documents.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fold
from .lookalikes import LOOKALIKES
from .sampling import lowest_hashes

LANGS = ["cs", "de", "en", "es", "fr", "sk"]
ORDER = 5
DISCOUNT = 0.75
#: Bound of the training sample: labelled documents per language (lowest hash of their id first); every HELD_OUT-th calibrates.
DOCS_PER_LANG, HELD_OUT = 600, 8
_MUL = np.uint64(0x9E3779B97F4A7C15)
# Names of the languages as labels spell them, accents folded.
LABEL_WORDS = {
    "cs": "cs cz ces cze czech cestina cesky tschechisch tcheque checo",
    "de": "de deu ger german deutsch nemcina nemecky allemand aleman",
    "en": "en eng english englisch anglictina anglicky anglais ingles",
    "es": "es spa spanish espanol castellano spanelstina spanisch espagnol",
    "fr": "fr fra fre french francais franzosisch francouzstina frances",
    "sk": "sk slk slo slovak slovencina slovensky slowakisch slovaque eslovaco",
}
_LABEL_OF = {w: k for k, words in LABEL_WORDS.items() for w in words.split()}


def label_set(label: str | None) -> frozenset[str]:
    """The languages a label names; regional tags, case, order and separators don't matter; none for a missing label."""
    if not isinstance(label, str):
        return frozenset()
    folded = "".join(c for c in unicodedata.normalize("NFKD", label) if not unicodedata.combining(c)).lower()
    parts = (re.split(r"[-_]", p)[0] for p in re.split(r"[^a-z_-]+", folded) if p)
    return frozenset(_LABEL_OF[p] for p in parts if p in _LABEL_OF)


_FOLD = str.maketrans({a: b for line in LOOKALIKES for a, b in zip(*line.split("=", 1))})
_JUNK = re.compile(r"[​-‏⁠-⁤﻿­]")
_SPACE = re.compile(r"[^\w']+|[\d_]+")


def clean(text: str) -> str:
    """Text as the models see it: composed, look-alikes folded, lower case, letters only, blanks single."""
    text = unicodedata.normalize("NFKC", _JUNK.sub("", text)).translate(_FOLD).lower()
    return " " + _SPACE.sub(" ", text).strip() + " "


def strip_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each position from n-1 on."""
    h = np.zeros(max(0, len(codes) - n + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = (h ^ (codes[i: len(codes) - n + 1 + i] + np.uint64(i + 1) * np.uint64(0x632BE59BD9B4E019))) * _MUL
            h ^= h >> np.uint64(29)
    return h


class Models:
    """Kneser-Ney models of all languages over shared sorted hash arrays."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        L = len(self.langs)
        grams = []  # per language: {order: (ngram hash, context hash, suffix hash, count)}
        for lang in self.langs:
            codes = _codes("".join(texts[lang]))
            per = {}
            for n in range(ORDER, 0, -1):
                h, first, count = np.unique(_hashes(codes, n), return_index=True, return_counts=True)
                ctx = _hashes(codes, n - 1)[first] if n > 1 else np.zeros(len(h), np.uint64)
                suf = _hashes(codes, n - 1)[first + 1] if n > 1 else np.zeros(len(h), np.uint64)
                per[n] = [h, ctx, suf, count.astype(float)]
            for n in range(ORDER - 1, 0, -1):
                # Lower orders count distinct left extensions.
                s, c = np.unique(per[n + 1][2], return_counts=True)
                at = np.searchsorted(s, per[n][0]).clip(max=len(s) - 1)
                per[n][3] = np.where(s[at] == per[n][0], c[at], 1).astype(float)
            grams.append(per)
        self.keys, self.logp, self.back_keys, self.back = {}, {}, {}, {}
        alphabet = 200.0
        for n in range(1, ORDER + 1):
            self.keys[n] = np.unique(np.concatenate([g[n][0] for g in grams]))
            self.logp[n] = np.zeros((len(self.keys[n]), L), np.float32)
            self.back_keys[n] = np.unique(np.concatenate([g[n][1] for g in grams]))
            self.back[n] = np.zeros((len(self.back_keys[n]), L), np.float32)
        lower_of, ctx_of = {}, {}
        for n in range(1, ORDER + 1):
            for per in grams:
                at = np.searchsorted(self.keys[n], per[n][0])
                lower_of.setdefault(n, np.zeros(len(self.keys[n]), np.uint64))[at] = per[n][2]
                ctx_of.setdefault(n, np.zeros(len(self.keys[n]), np.uint64))[at] = per[n][1]
        for n in range(1, ORDER + 1):
            for k, per in enumerate(grams):
                h, ctx, _, count = per[n]
                groups, inv = np.unique(ctx, return_inverse=True)
                total, kinds = np.bincount(inv, count), np.bincount(inv)
                gamma = np.zeros(len(self.back_keys[n]))
                gamma[np.searchsorted(self.back_keys[n], groups)] = np.log(DISCOUNT * kinds / total)
                self.back[n][:, k] = gamma  # unseen contexts back off at no cost
                own = np.zeros(len(self.keys[n]))
                own[np.searchsorted(self.keys[n], h)] = np.maximum(count - DISCOUNT, 0) / total[inv]
                lower = np.full(len(self.keys[n]), 1 / alphabet) if n == 1 else np.exp(self.logp[n - 1][self._at(n - 1, lower_of[n]), k])
                g = self.back[n][np.searchsorted(self.back_keys[n], ctx_of[n]), k]
                self.logp[n][:, k] = np.log(own + np.exp(g) * lower)
        self.unseen = float(np.log(1 / alphabet))
        self.temperature, self.limit = 1.0, 99.0

    def _at(self, n: int, h: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys[n], h).clip(max=len(self.keys[n]) - 1)

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Nats a character of each cleaned text under each language, all texts in one pass; inf for a text without letters."""
        out = np.full((len(texts), len(self.langs)), np.inf, np.float64)
        lengths = np.array([len(t) if len(t) >= 3 else 0 for t in texts], np.int64)
        some = np.flatnonzero(lengths)
        if not len(some):
            return out
        codes = _codes("".join(texts[i] for i in some))
        starts = np.concatenate([[0], np.cumsum(lengths[some])[:-1]])
        within = np.arange(len(codes)) - np.repeat(starts, lengths[some])
        score = np.zeros((len(codes), len(self.langs)), np.float32)  # what backing off has cost so far, then the result
        todo = np.flatnonzero(within > 0)
        hashes = {0: np.zeros(len(codes) + 1, np.uint64)}
        for n in range(ORDER, 0, -1):
            # An n-gram lies within one text.
            fits = within[todo] >= n - 1
            pos, short = todo[fits], todo[~fits]
            full = hashes.pop(n, None)
            h = (_hashes(codes, n) if full is None else full)[pos - (n - 1)]
            at = self._at(n, h)
            hit = self.keys[n][at] == h
            score[pos[hit]] += self.logp[n][at[hit]]
            miss = pos[~hit]
            if len(miss):
                if n > 1:
                    hashes[n - 1] = _hashes(codes, n - 1)
                    ctx = hashes[n - 1][miss - (n - 1)]
                else:
                    ctx = np.zeros(len(miss), np.uint64)
                b = np.searchsorted(self.back_keys[n], ctx).clip(max=len(self.back_keys[n]) - 1)
                known = self.back_keys[n][b] == ctx
                score[miss[known]] += self.back[n][b[known]]
            todo = np.sort(np.concatenate([short, miss]))
        score[todo] += self.unseen
        score[within == 0] = 0
        out[some] = -np.add.reduceat(score.astype(np.float64), starts, axis=0) / (lengths[some] - 1)[:, None]
        return out

    def entropy(self, text: str) -> np.ndarray | None:
        e = self.entropies([text])[0]
        return e if np.isfinite(e).all() else None

    def classify_all(self, texts: list[str]) -> list[tuple[str | None, float, float]]:
        """(language or None when rejected, confidence, nats a character of the best) of each raw text."""
        out = []
        for part in _chunks([clean(t) for t in texts]):
            e = self.entropies(part)
            best = e.argmin(1)
            low = e[np.arange(len(e)), best]
            with np.errstate(invalid="ignore"):
                conf = 1 / np.exp(-(e - low[:, None]) * self.temperature).sum(1)
            out += [(self.langs[k] if x <= self.limit else None, float(c) if np.isfinite(x) else 0.0, float(x)) for k, x, c in zip(best, low, conf)]
        return out

    def classify(self, text: str) -> tuple[str | None, float, float]:
        return self.classify_all([text])[0]


class NoModels:
    """Stands in where there is nothing to learn from: every text is rejected."""

    langs: list[str] = []

    def classify_all(self, texts: list[str]) -> list[tuple[None, float, float]]:
        return [(None, 0.0, float("inf"))] * len(texts)


#: Characters scored in one pass, which bounds a worker's memory.
PASS_CHARS = 400_000


def _chunks(texts: list[str]):
    part, n = [], 0
    for t in texts:
        if part and n + len(t) > PASS_CHARS:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t)
    if part:
        yield part


def train(sample: pd.DataFrame) -> Models | NoModels:
    """Models from labelled texts (columns lang, text); every HELD_OUT-th text calibrates temperature and rejection."""
    fit: dict[str, list[str]] = {k: [] for k in LANGS}
    held = []
    for i, (lang, text) in enumerate(zip(sample.lang, sample.text)):
        c = clean(text)
        if i % HELD_OUT == 0:
            held.append((lang, text))
        elif lang in fit:
            # Texts without accents occur as well; they train the same language.
            fit[lang] += [c, strip_accents(c)]
    if not any(fit.values()):
        return NoModels()
    models = Models({k: v for k, v in fit.items() if v})
    right, parts, noise, rng = [], [], [], np.random.default_rng(0)
    for lang, text in held:
        for part in text.split("\n"):
            if len(part) > 20 and len(c := clean(part)) >= 3 and lang in models.langs:
                right.append(models.langs.index(lang))
                parts.append(c)
                noise.append("".join(rng.permutation(list(c))))
    if parts:
        e = np.concatenate([models.entropies(x) for x in _chunks(parts)])
        noise = np.concatenate([models.entropies(x) for x in _chunks(noise)]).min(1)
        r = np.array(right)
        best, loss_at = 1.0, float("inf")
        for t in (2, 5, 10, 20, 40, 80):
            z = -e * t
            loss = float(np.mean(np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) - (z[np.arange(len(r)), r] - z.max(1))))
            if loss < loss_at:
                best, loss_at = float(t), loss
        models.temperature = best
        # Two thirds of the way from real held-out lines to the same lines with their letters shuffled.
        models.limit = float(np.quantile(e.min(1), 0.995) + 2 * np.quantile(noise, 0.01)) / 3
    return models


def training_sample(documents: DataFrame) -> pd.DataFrame:
    """At most DOCS_PER_LANG labelled documents a language, whole."""
    rows = lowest_hashes(documents, "doc_id", [(F.col("lang") == k, DOCS_PER_LANG) for k in LANGS])
    rows = rows.where(F.length(F.trim("text")) >= 100).select("lang", "text", F.xxhash64("doc_id").alias("h"))
    return rows.toPandas().sort_values(["lang", "h"]).reset_index(drop=True)


_WORKER: dict = {}


def _load(bc) -> Models:
    if _WORKER.get("id") is not bc:
        _WORKER.update(id=bc, models=bc.value)
    return _WORKER["models"]


def _counted_line(line: str) -> bool:
    """Six or more words, ending in a full stop; a bullet isn't a word, invisible characters don't count."""
    line = (line if line.isascii() else _JUNK.sub("", line)).rstrip()
    if not line.endswith("."):
        return False
    words = line.split()
    return len(words) >= 6 and sum(any(map(str.isalnum, w)) for w in words) >= 6


def blocks_of(text: str) -> list[str]:
    """A text's blocks, as separated by blank lines."""
    return re.split(r"\n[ \t]*\n", text)


def segment_languages(texts: DataFrame, documents: DataFrame, key: str = "cv_id", text: str = "text", counted_only: bool = False) -> DataFrame:
    """(key, block_no, lang, confidence, entropy, counted) for every block of every text, or for every counted one.

    Blocks count from 1 and `counted` says that a block has a line of six or more words ending in a full
    stop.  A null or blank text gives no row; a block without letters or beyond the calibrated entropy has a
    null language.  Repeated keys give repeated rows.
    """
    spark: SparkSession = texts.sparkSession
    bc = spark.sparkContext.broadcast(train(training_sample(documents)))

    def run(batches):
        models = _load(bc)
        for pdf in batches:
            at, todo = [], []
            for k, t in zip(pdf.k, pdf.t):
                for no, block in enumerate(blocks_of(t), 1):
                    counted = [x for x in block.split("\n") if _counted_line(x)]
                    if counted or not counted_only:
                        # Prose lines alone decide a counted block: headers, dates and skills have no language of their own.
                        at.append((k, no, bool(counted)))
                        todo.append("\n".join(counted) if counted else block)
            out = [(k, no, lang, conf, ent if np.isfinite(ent) else None, counted) for (k, no, counted), (lang, conf, ent) in zip(at, models.classify_all(todo))]
            yield pd.DataFrame(out, columns=["k", "block_no", "lang", "confidence", "entropy", "counted"])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = texts.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartition(n, "k")
    return rows.mapInPandas(run, "k long, block_no int, lang string, confidence double, entropy double, counted boolean").withColumnRenamed("k", key)


def named_languages(label: Column) -> Column:
    """label_set as built-in expressions: the sorted languages a label names; empty for null."""
    words = F.create_map(*[x for w, k in _LABEL_OF.items() for x in (F.lit(w), F.lit(k))])
    parts = F.split(F.regexp_replace(fold(label), r"[-_][a-z_-]*", ""), r"[^a-z]+")
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(F.transform(parts, lambda p: F.try_element_at(words, p))))), F.array().cast("array<string>"))


def language_repairs(cvs: DataFrame, fixtures: DataFrame, documents: DataFrame) -> DataFrame:
    """p2: (cv_id, block_no, lang).  Counted blocks of a CV in several languages; (cv_id, 0, lang) where a CV in one language has a missing or wrong label."""
    blocks = segment_languages(cvs, documents, counted_only=True).where("lang is not null")
    per_cv = blocks.groupBy("cv_id").agg(F.collect_set("lang").alias("langs"), F.collect_list(F.struct("block_no", "lang")).alias("bs"))
    # One label a CV: redelivered rows are equal, so the least is the label.
    labels = fixtures.where("cv_id is not null").groupBy("cv_id").agg(F.min("source_language").alias("label"))
    joined = per_cv.join(labels, "cv_id", "left").withColumn("named", named_languages(F.col("label")))
    # One row a case: each counted block of a mixed CV, or one for the CV.  One pass over the scored blocks serves both.
    whole = F.array(F.struct(F.lit(0).alias("block_no"), F.element_at("langs", 1).alias("lang")))
    cases = F.when(F.size("langs") >= 2, F.col("bs")).when(F.col("named") != F.array_sort("langs"), whole)
    return joined.select("cv_id", F.explode(cases).alias("b")).select("cv_id", F.col("b.block_no").cast("int").alias("block_no"), "b.lang").distinct()
