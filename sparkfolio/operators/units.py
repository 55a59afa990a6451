"""Quantities in different units and scales -> one common unit.

A value's unit comes from its text where stated.  For all others the source's history speaks: every source
(a query text) keeps, per day, the count, sum and sum of squares of its log values; an exact penalised
changepoint search over these cuts the history into level segments, and a level shift that matches a known
factor marks a unit change.  Values whose text states all, values filled from the market by what was filled,
and values of unknown unit are cut apart, so that mixed days blur none; the stated ones give the level.  A
segment of unknown unit takes the unit whose shift is nearest.  A segment filled from the market keeps the
market's unit unless it lies off the level by a known factor beyond all doubt (DOUBT standard errors), which a
wrong or changed market unit does; then the change is reversed.  The history is pre-aggregated per day before
any shuffle, so a hot source costs as many rows as it has days.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_rows

# How currencies are written; a list where several currencies share the sign or word.
SHARED_SIGNS = {
    "$": ["USD", "CAD", "AUD"],
    "kr": ["SEK", "NOK", "DKK"], "kr.": ["SEK", "NOK", "DKK"], "kronor": ["SEK", "NOK", "DKK"], "kroner": ["NOK", "DKK"], "crowns": ["CZK", "SEK", "NOK", "DKK"],
}
CURRENCY_SIGNS = {
    "€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR", "eura": "EUR", "eurech": "EUR",
    "kč": "CZK", "kc": "CZK", "czk": "CZK", "korun": "CZK", "koruna": "CZK", "koruny": "CZK", "korun českých": "CZK",
    "zł": "PLN", "zl": "PLN", "pln": "PLN", "zloty": "PLN", "złoty": "PLN", "złotych": "PLN",
    "ft": "HUF", "huf": "HUF", "forint": "HUF", "forints": "HUF",
    "£": "GBP", "gbp": "GBP", "pound": "GBP", "pounds": "GBP", "quid": "GBP", "sterling": "GBP",
    "sfr.": "CHF", "sfr": "CHF", "fr.": "CHF", "chf": "CHF", "franken": "CHF", "francs": "CHF",
    "sek": "SEK", "nok": "NOK", "dkk": "DKK",
    # The bare word is the US dollar: Canadian and Australian markets quote theirs as C$, A$ or $, and the pay levels there bear this out.
    "us$": "USD", "usd": "USD", "dollars": "USD", "dollar": "USD", "c$": "CAD", "ca$": "CAD", "cad": "CAD", "a$": "AUD", "au$": "AUD", "aud": "AUD",
    "₹": "INR", "rs.": "INR", "rs": "INR", "inr": "INR", "rupees": "INR", "rupee": "INR",
}
# How pay periods are written.
PERIOD_WORDS = {
    "hour": "hour hourly hr h hod hod. hodinu hodinově std std. stunde stündlich hora heure horaire hodinová hodinovou hodina stundenlohn stundensatz".split(),
    "day": "day daily den denně tag täglich día dia jour deň manday md denní tagessatz tageslohn tagesrate".split(),
    "week": "week weekly wk týden týdně woche wöchentlich semana semaine týždeň týdenní wochenlohn wochensatz".split(),
    "month": "month monthly mo mo. mth měs měs. měsíc měsíčně mes mes. mesiac mesačne monat monatlich mtl mtl. mes mois mensuel měsíční monatsgehalt monatslohn p.m. p.m p. m. pm".split() + ["p. m."],
    "year": "year yearly annual annually annum yr yr. rok ročně jahr jährlich p.a. p.a pa año an ročne roční jahresgehalt jahreslohn".split() + ["p. a."],
}
SCALES = {
    1e3: "k thousand thousands tis tis. tisíc tisíce tisíce tausend tsd tsd. mil miles mille grand".split(),
    1e6: "m million millions mio mio. mil. milion milionů miliony milión miliónov millionen millones".split(),
    1e5: ["lakh", "lakhs", "lac"],
}
#: Ratios between periods and scales a level shift may match, as log values are compared.
KNOWN_FACTORS = {"thousand": 1e3, "million": 1e6, "month/year": 12.0, "week/year": 52.0, "day/year": 260.0, "hour/year": 2080.0}
FACTOR_TOLERANCE = 0.15
PENALTY = 8.0
#: Standard errors by which a segment filled from the market must be off before its history overrules the market, and the fewest values on either side.
DOUBT, LEAST_VALUES = 6.0, 5

_PERIOD_OF = {w: p for p, words in PERIOD_WORDS.items() for w in words}
_SCALE_OF = {w: f for f, words in SCALES.items() for w in words }


def _alt(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


_B = r"[     ]"
_CUR_WORDS = [w for w in [*CURRENCY_SIGNS, *SHARED_SIGNS] if w[0].isalpha()]
_CUR_SIGNS = [w for w in [*CURRENCY_SIGNS, *SHARED_SIGNS] if not w[0].isalpha()] + ["us$", "c$", "ca$", "a$", "au$"]
_CUR = rf"(?:{_alt(_CUR_SIGNS)}|(?:{_alt(_CUR_WORDS)})(?![^\W\d_]))"
_NUM = rf"\d{{1,3}}(?:(?:{_B}|[.,'’])\d{{3}})+(?:[.,]\d{{1,2}})?(?![\d])|\d+(?:[.,]\d+)?"
_SCALE = rf"(?:{_alt(_SCALE_OF)})(?![^\W\d_])"


def _one(i: int) -> str:
    return rf"(?:(?P<c{i}>{_CUR}){_B}*)?(?P<n{i}>{_NUM})(?:{_B}*(?P<s{i}>{_SCALE}))?(?:{_B}*(?P<d{i}>{_CUR}))?"


_PER_WORD = rf"(?:{_alt(_PERIOD_OF)})(?![^\W\d_])"
_AFTER = rf"(?:{_B}*(?:/|per\b|a\b|an\b|za\b|im\b|pro\b|je\b|die\b|der\b|den\b|am\b|por\b|par\b|al\b|na\b|každý\b|gross\b)?{_B}*(?P<p>{_PER_WORD}))?"
_SEP = rf"{_B}*(?:[-–—~]|to\b|až\b|bis\b|do\b|až do\b|and\b|und\b|a\b|à\b){_B}*"
_PAY = re.compile(r"(?<![\w.,/])" + _one(1) + rf"(?:{_SEP}" + _one(2) + ")?" + _AFTER, re.I)
_BEFORE = re.compile(rf"(?<![^\W\d_])(?P<p>{_PER_WORD}){_B}+(?:rate|pay|salary|wage|sazba|mzda|satz|sazbou|odměna)?{_B}*(?:of|is|:)?{_B}*(?:around|from|about|od|kolem|ca\.?|rund|ab)?{_B}*$", re.I)
# What a number counts when it isn't pay.
_COUNTED = re.compile(
    rf"^{_B}*(?:%|percent\b|procent|prozent|(?:open|free|active|volných|otevřených|offene[rn]?|freie[rn]?)\b|positions?\b|jobs?\b|vacanc|people\b|persons?\b|respondents?\b|lid[ií]\b|osob|answers?\b|responses?\b|reports?\b|odpověd|angaben\b|antworten\b"
    rf"|(?:\+{_B}*)?(?:years?|let|roky?|jahren?)\b(?:{_B}+(?:of|exp|praxe|zkušen|erfahr))|days?{_B}+(?:of|off|leave)|dn[íi]\b|dny\b|dnů\b|urlaubstage\b|tage\b|hours?\b|hodin\b|h\b{_B}+(?:a|per)|stunden\b|minutes?\b|steps?\b|tips?\b|interviews?\b|employees\b|offers?\b|nabíd|pozic|stellen\b|companies\b|firem\b|reviews?\b|ratings?\b)",
    re.I,
)
_COUNTED_BEFORE = re.compile(
    rf"(?:\bin|\brok[eu]?|\br\.|\bjahr|\bsince|\bupdated|\bod roku|\bbased on|\bpodle|\baus|\bbonus|\bbonus up to|\bup to|\bprämie|\bbis|\bplus|\bund|\btop|\(|\b(?:19|20)\d\d[-–/]){_B}*$", re.I
)
_YEAR = re.compile(r"(?:19|20)\d\d$")


def number(text: str, scale: bool) -> float:
    """A written number; a group of three digits after a point or comma is thousands, unless a scale word makes it a fraction of one part."""
    s = re.sub(rf"{_B}|['’]", "", text)
    groups = re.findall(r"[.,]\d+", s)
    if len(groups) > 1:
        whole, last = re.sub(r"[.,]", "", s[: s.rfind(groups[-1])]), groups[-1]
        return float(whole + last[1:]) if len(last) == 4 else float(f"{whole}.{last[1:]}")
    if len(groups) == 1:
        whole, frac = s[: -len(groups[0])], groups[0][1:]
        if len(frac) == 3 and not (scale and whole == "0") and not whole == "0":
            return float(whole + frac)
        return float(f"{whole}.{frac}")
    return float(s)


def currency_of(word: str | None, market: str | None) -> str | None:
    """The currency a sign or word names; a shared one is the market's if that is among them, `$` else USD."""
    if not word:
        return None
    w = word.strip().lower()
    if w in SHARED_SIGNS:
        return market if market in SHARED_SIGNS[w] else SHARED_SIGNS[w][0]
    return CURRENCY_SIGNS.get(w)


def parse_pay(body: str | None, market: str | None) -> tuple[float, float, str | None, str | None] | None:
    """(low, high, stated currency, stated period) of the pay a text states, scales applied; None if it states none."""
    if not body:
        return None
    if "LPA" in body:  # lakhs a year
        body = re.sub(r"(?<=[\d\s])LPA(?=\s*(?:[-–—]|to\b))", "lakh", body)
        body = re.sub(rf"(?<=[\d\s])LPA(?:\s+({_CUR}))?", lambda m: f"lakh {m[1] or ''} p.a.", body, flags=re.I)
    best, best_score = None, 0.0
    for m in _PAY.finditer(body):
        if m["n2"] and not m["p"] and _COUNTED.match(body[m.end():]):
            # '82 000 euro und 20 Urlaubstage': the second number counts something else.
            m = _PAY.match(body[: max(m.end(g) for g in ("n1", "s1", "d1"))], m.start())
        before, after = body[: m.start()], body[m.end():]
        cur1, cur2 = m["c1"] or m["d1"], m["c2"] or m["d2"]
        two = m["n2"] is not None
        last = m["n2"] if two else m["n1"]
        bare = not (cur1 or cur2 or m["s1"] or m["s2"])
        if _COUNTED.match(after) and not m["p"]:
            continue
        if _COUNTED.match(body[m.end("n2" if two else "n1"):]) and not (cur1 or cur2):
            continue
        if bare and not two and not m["p"] and (_YEAR.match(last) or _COUNTED_BEFORE.search(before)):
            continue
        if bare and two and _YEAR.match(m["n1"]) and _YEAR.match(m["n2"]) and not m["p"] and before.rstrip().endswith("("):
            continue
        period = m["p"]
        if not period and (b := _BEFORE.search(before)):
            period = b["p"]
        period = _PERIOD_OF.get(re.sub(_B, " ", period.lower())) if period else None
        scale1 = _SCALE_OF.get(m["s1"].lower()) if m["s1"] else None
        scale2 = _SCALE_OF.get(m["s2"].lower()) if m["s2"] else None
        high_scale = (scale2 if two else scale1) or 1.0
        low = number(m["n1"], bool(scale1 or scale2)) * (scale1 or (scale2 if two else None) or 1.0)
        high = number(last, bool(scale2 if two else scale1)) * high_scale
        if two and scale1 and not scale2:
            # '35k to 45': the only scale stated holds for what follows when the plain reading would fall.
            high = high * scale1 if high < low else high
        score = 4 * bool(cur1 or cur2) + 3 * bool(period) + 2 * bool(scale1 or scale2) + 2 * two + (1 if high >= 1000 else 0) + (0.5 if high >= 20 else 0)
        if score > best_score and high > 0:
            word = (m["c1"] or m["d1"] or m["c2"] or m["d2"]) if (m["c1"] or m["d1"]) else cur2
            best, best_score = (low, high, currency_of(word, market), period), score
    if best is None or best_score < 1:
        return None
    return best


def clean_period(text: str | None) -> str | None:
    return _PERIOD_OF.get(text.strip().lower()) if isinstance(text, str) else None


def clean_currency(text: str | None, country_currency: str | None) -> str | None:
    """A freely spelled currency; a shared sign is the country's own if that is among those it may mean."""
    return currency_of(text, country_currency) if isinstance(text, str) else None


def _parse_batches(per_year: dict, per_eur: dict):
    def run(batches):
        for pdf in batches:
            out = []
            for rid, body, src, at, mc, mp, cc, cp in zip(pdf.record_id, pdf.body, pdf.source, pdf.day, pdf.m_currency, pdf.m_period, pdf.c_currency, pdf.c_period):
                cc = cc if isinstance(cc, str) else None
                market_currency = clean_currency(mc, cc) or cc
                found = parse_pay(body if isinstance(body, str) else None, market_currency)
                if found is None:
                    continue
                low, high, cur, per = found
                currency = cur or market_currency
                period = per or clean_period(mp) or (cp if isinstance(cp, str) else None)
                no_period, no_currency = period not in per_year, currency not in per_eur
                rate = per_year.get(period, 1) / per_eur.get(currency, 1.0)
                # What the text leaves open is named by what the market filled it with; '?' where it has nothing.
                filled = ["" if stated else "?" if nothing else unit for stated, nothing, unit in ((per, no_period, period), (cur, no_currency, currency))]
                out.append((rid, src, at, low, high, rate, *filled))
            yield pd.DataFrame(out, columns=["record_id", "source", "day", "low", "high", "rate", "period_from", "currency_from"])

    return run


def unit_tables(fx: DataFrame, periods: DataFrame) -> tuple[dict[str, float], dict[str, int]]:
    """(units per euro, periods per year) of the two small tables; rows with nulls count for nothing, of repeated units the last one by value."""
    rates = sorted(small_rows(fx.select("currency", "units_per_eur").dropna(), "the table of currencies"))
    lengths = sorted(small_rows(periods.select("pay_period", "per_year").dropna(), "the table of pay periods"))
    return {r[0]: float(r[1]) for r in rates}, {r[0]: int(r[1]) for r in lengths}


def read_pay(results: DataFrame, specs: DataFrame, market_ref: DataFrame, fx: DataFrame, periods: DataFrame) -> DataFrame:
    """Stated pay of each result with the rate to euros a year: one row a result that states pay.

    period_from and currency_from: '' where the text states it, the market's unit where that fills it, '?' where
    neither does (the rate then leaves it out).
    `fx` and `periods` are small fixed tables (13 and 5 rows; they don't grow) and go to the workers as
    dictionaries.  Null or empty bodies give no row; repeated results count once.
    """
    per_eur, per_year = unit_tables(fx, periods)
    ref = market_ref.select(F.upper("country").alias("country"), F.col("currency").alias("c_currency"), F.col("pay_period").alias("c_period"))
    # One spec a CV: the lowest, so that repeated rows change nothing.
    spec = specs.groupBy("cv_id").agg(F.min(F.struct(F.upper("country").alias("country"), "currency", "pay_period")).alias("m"))
    spec = spec.select("cv_id", "m.country", F.col("m.currency").alias("m_currency"), F.col("m.pay_period").alias("m_period")).join(ref, "country", "left")
    rows = results.where("body is not null and body <> ''").select("cv_id", F.col("result_id").alias("record_id"), F.col("query_text").alias("source"), F.to_date("fetched_at").alias("day"), "body")
    rows = rows.join(spec.drop("country"), "cv_id", "left")
    n = max(int(results.sparkSession.conf.get("spark.sql.shuffle.partitions")), results.sparkSession.sparkContext.defaultParallelism)
    # Redelivered results meet on the record; this exchange also spreads the parsing.
    rows = rows.drop("cv_id").repartition(n, "record_id")
    return rows.mapInPandas(
        _parse_batches(per_year, per_eur), "record_id long, source string, day date, low double, high double, rate double, period_from string, currency_from string"
    ).dropDuplicates(["record_id"])


def segment(n: np.ndarray, s: np.ndarray, q: np.ndarray, penalty: float = PENALTY) -> list[tuple[int, int, float]]:
    """Exact penalised segmentation (PELT) of grouped values into constant levels: (from, to, level).

    n, s, q: per group the count, sum and sum of squares.  Cost: residual sum of squares over the pooled
    variance of successive differences of the group means, plus the penalty a segment.
    """
    k = len(n)
    cn, cs, cq = (np.concatenate([[0.0], np.cumsum(x)]) for x in (n, s, q))
    mean = s / n
    within = float(np.sum(q - s * s / n)) / max(1.0, float(np.sum(n) - k))
    steps = np.diff(mean)
    between = float(np.median(np.abs(steps)) / 0.954) ** 2 if k > 1 else 0.0
    var = max(within, between, 1e-6)
    best, last, live = [-penalty] + [0.0] * k, [0] * (k + 1), np.array([0])
    for t in range(1, k + 1):
        m = cn[t] - cn[live]
        d = cs[t] - cs[live]
        cost = np.maximum(0.0, cq[t] - cq[live] - d * d / m) / var
        total = np.array([best[i] for i in live]) + cost
        j = int(np.argmin(total))
        best[t], last[t] = float(total[j]) + penalty, int(live[j])
        live = np.append(live[total <= best[t]], t)
    cuts, t = [], k
    while t > 0:
        cuts.append((last[t], t))
        t = last[t]
    return [(a, b, float((cs[b] - cs[a]) / (cn[b] - cn[a]))) for a, b in reversed(cuts)]


def match_factor(shift: float) -> tuple[str, float] | None:
    """The known factor that a log shift matches, signed, or None."""
    name, f = min(KNOWN_FACTORS.items(), key=lambda x: abs(abs(shift) - math.log(x[1])))
    return (name, math.copysign(math.log(f), shift)) if abs(abs(shift) - math.log(f)) <= FACTOR_TOLERANCE else None


def _levels(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> tuple[list[tuple[int, int, float]], float]:
    """The level segments of daily sums in order of the day, and the level of the largest."""
    found = segment(n, s, q)
    return found, max(found, key=lambda x: (float(n[x[0]: x[1]].sum()), -x[0]))[2]


def _per_source(work, columns: list[str]):
    """mapInPandas over rows sorted by source: `work` gets one source's columns as arrays and gives rows."""

    def run(batches):
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            source = pdf.source.to_numpy()
            starts = [0, *(np.flatnonzero(source[1:] != source[:-1]) + 1).tolist()]
            # The batch may end within a source.
            held = pdf.iloc[starts[-1]:]
            cols = {c: pdf[c].to_numpy() for c in pdf.columns}
            out = [row for a, b in zip(starts, starts[1:]) for row in work({c: v[a:b] for c, v in cols.items()})]
            yield pd.DataFrame(out, columns=columns)
        if held is not None and len(held):
            yield pd.DataFrame(work({c: held[c].to_numpy() for c in held.columns}), columns=columns)

    return run


def _segments(g: dict) -> list[tuple]:
    """One source's daily sums -> its level segments, the largest being the reference level."""
    n = g["n"].astype(float)
    found, base = _levels(n, g["s"], g["q"])
    out = []
    for a, b, level in found:
        hit = match_factor(level - base)
        out.append((g["source"][0], g["day"][a], g["day"][b - 1], int(n[a:b].sum()), level, hit[0] if hit else None, hit[1] if hit else 0.0))
    return out


def unit_shifts(period: str, currency: str, per_year: dict, per_eur: dict) -> list[float]:
    """The log shifts that values may show against their source's level, by what was filled or left out of their unit.

    A missing scale word shows in either case.  A filled period may stand for another; what is unknown is any.
    """
    log = lambda table, unit: math.log(table[unit]) if unit in table else 0.0
    periods = [log(per_year, period) - math.log(p) for p in per_year.values()] if period else [0.0]
    currencies = [math.log(c) for c in per_eur.values()] if currency == "?" else [0.0]
    return [c + p - math.log(f) for f, p, c in itertools.product((1.0, KNOWN_FACTORS["thousand"], KNOWN_FACTORS["million"]), periods, currencies)]


def _open_segments(per_year: dict, per_eur: dict):
    """One source's daily sums of stated, filled and unknown values -> the shift of each level segment of the latter two."""

    def work(g: dict) -> list[tuple]:
        n, s, q, day = g["n"].astype(float), g["s"], g["q"], g["day"]
        kinds = list(zip(g["period_from"], g["currency_from"]))
        parts = {k: np.array([x == k for x in kinds]) for k in dict.fromkeys(kinds)}
        known = parts.pop(("", ""), None)
        out, base, count, spread = [], None, 0.0, 0.0
        if parts and known is not None:
            base = _levels(n[known], s[known], q[known])[1]
            count = float(n[known].sum())
            spread = max(0.0, float(q[known].sum()) - float(s[known].sum()) ** 2 / count) / max(1.0, count - 1)
        for (period, currency), m in parts.items():
            pn, ps, pq, pday = n[m], s[m], q[m], day[m]
            found, own = _levels(pn, ps, pq)
            shifts = unit_shifts(period, currency, per_year, per_eur)
            for a, b, level in found:
                values = float(pn[a:b].sum())
                if base is None:  # only other open values to compare with; the market's unit stands
                    hit = match_factor(level - own) if "?" in (period, currency) else None
                    factor = hit[1] if hit else 0.0
                else:
                    near = min(shifts, key=lambda x: abs(level - base - x))
                    factor = near if abs(level - base - near) <= FACTOR_TOLERANCE else 0.0
                    if factor and "?" not in (period, currency):
                        inside = max(0.0, float(pq[a:b].sum()) - values * level * level) / max(1.0, values - 1)
                        error = math.sqrt(spread / count + inside / values)
                        if min(count, values) < LEAST_VALUES or abs(factor) < DOUBT * error:
                            factor = 0.0
                out.append((g["source"][0], period, currency, pday[a], pday[b - 1], factor))
        return out

    return _per_source(work, ["source", "period_from", "currency_from", "first_day", "last_day", "log_factor"])


def _daily(values: DataFrame, *keys: str) -> DataFrame:
    rows = values.where("source is not null and day is not null and v > 0")
    daily = rows.groupBy("source", "day", *keys).agg(F.count("*").alias("n"), F.sum(F.log("v")).alias("s"), F.sum(F.log("v") * F.log("v")).alias("q"))
    # A source's history is as long as its days, however many rows it has.
    return daily.repartition("source").sortWithinPartitions("source", "day", *keys)


def unit_segments(values: DataFrame) -> DataFrame:
    """Level segments of each source's history of log values, with the unit change a segment shows.

    values: source, day, v (> 0).  Null sources or days and values that aren't positive count for nothing.
    """
    columns = "source string, first_day date, last_day date, n long, level double, unit_change string, log_factor double"
    return _daily(values).mapInPandas(_per_source(_segments, [c.split()[0] for c in columns.split(", ")]), columns)


#: Salts over which the rows of one source are spread when its shifts are joined to them.
SALTS = 16


def settled_pay(results: DataFrame, specs: DataFrame, market_ref: DataFrame, fx: DataFrame, periods: DataFrame) -> DataFrame:
    """(record_id, low, high, rate, unit_from): each result's pay with its final rate to euros a year.

    unit_from: 'text', 'market', 'history' (a segment's unit change was reversed) or 'nothing' (no unit known and
    no level to compare with).  The texts are parsed once; the parsed rows are kept for both uses.
    """
    per_eur, per_year = unit_tables(fx, periods)
    pay = read_pay(results, specs, market_ref, fx, periods).persist(StorageLevel.MEMORY_AND_DISK)
    units = ["period_from", "currency_from"]
    segments = _daily(pay.withColumn("v", F.col("high") * F.col("rate")), *units).mapInPandas(
        _open_segments(per_year, per_eur), "source string, period_from string, currency_from string, first_day date, last_day date, log_factor double"
    )
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("g_salt")
    shift = segments.where("log_factor <> 0").select(*(F.col(c).alias(f"g_{c}") for c in ("source", *units)), "first_day", "last_day", "log_factor", salt)
    stated = (F.col("period_from") == "") & (F.col("currency_from") == "")
    # The rows of a source that holds a third of them fall into as many groups as there are salts.
    loose = pay.where(~stated).withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    same = [F.col(c) == F.col(f"g_{c}") for c in ("source", "salt", *units)]
    fixed = loose.join(shift, [*same, F.col("day").between(F.col("first_day"), F.col("last_day"))], "left")
    rate = F.col("rate") / F.exp(F.coalesce("log_factor", F.lit(0.0)))
    source = F.when(F.col("log_factor").isNotNull(), "history").when((F.col("period_from") == "?") | (F.col("currency_from") == "?"), "nothing").otherwise("market")
    return pay.where(stated).select("record_id", "low", "high", "rate", F.lit("text").alias("unit_from")).unionByName(
        fixed.select("record_id", "low", "high", rate.alias("rate"), source.alias("unit_from"))
    )


def yearly_euros(results: DataFrame, specs: DataFrame, market_ref: DataFrame, fx: DataFrame, periods: DataFrame) -> DataFrame:
    """p4: (result_id, low_eur_year, high_eur_year) of every result that states pay."""
    return settled_pay(results, specs, market_ref, fx, periods).select(
        F.col("record_id").alias("result_id"),
        F.floor(F.least("low", "high") * F.col("rate") + 0.5).cast("long").alias("low_eur_year"),
        F.floor(F.greatest("low", "high") * F.col("rate") + 0.5).cast("long").alias("high_eur_year"),
    )


def unit_decisions(results: DataFrame, specs: DataFrame, market_ref: DataFrame, fx: DataFrame, periods: DataFrame) -> DataFrame:
    """(unit_from, n): how many results have their unit from where."""
    return settled_pay(results, specs, market_ref, fx, periods).groupBy("unit_from").agg(F.count("*").alias("n"))
