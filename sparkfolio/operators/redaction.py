"""Ordered redaction passes over whole documents: URL, email, phone, header address, postcode, year, name.

Every pass first puts sentinels (characters that no text may hold) around what it takes out; the text after it,
what it took and the places in the new text all follow from that, so all passes stay built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import each

# Patterns of the passes.
URL = r"https?://\S+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = (
    r"(?<![\d-])(?:\+420[\s-]?\d{3}[\s-]?\d{3}[\s-]?\d{3}|\+\d{1,3}[\s-]?\d{3}[\s-]?\d{3}[\s-]?\d{3,4}|\d{3}[\s-]\d{3}[\s-]\d{3,4}"
    r"|\(\d{3}\)[\s-]?\d{3}[\s-]?\d{4}|\d{3}\.\d{3}\.\d{4}|[1-9]\d{8})(?!\d)"
)
MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec)"
YEAR = r"(?:19|20)\d{2}"
YEAR_ENVELOPE = rf"{MONTH}\s+{YEAR}|{YEAR}\s+{MONTH}|{YEAR}\s*[-–]\s*(?:Present|present|{YEAR})|(?:Present|present)\s*[-–]\s*{YEAR}"
POSTCODE_ENVELOPE = r",\s*[A-Za-zÀ-ž]{3,}[^,\n]{0,20}?\b\d{3} ?\d{2}\b|\b\d{3} ?\d{2}\b[^,\n]{0,20}?,\s*[A-Za-zÀ-ž]{3,}"
ADDRESS_LINE = r"(?U)^\s*(?!(?:19|20)\d\d\b)\d{1,5} +[A-ZÀ-Ž][a-zA-ZÀ-ž .]{3,40}(?:, *[\wÀ-ž][\wÀ-ž .-]*)*\s*$"
NAME_LABEL = r"(?im)^([ \t]*Name[ \t]*:[ \t]*)([A-ZÀ-Ž][\wÀ-ž'’\-]*(?:[ \t]+[A-ZÀ-Ž][\wÀ-ž'’\-]*){0,3})(?=[ \t]*$)"
MARKER = r"\[(?:EMAIL|PHONE|URL|POSTCODE|YEAR|NAME)\]"
# Headings that look like a name in the head of a CV.
HEADINGS = [
    "summary", "profile", "resume", "cv", "curriculum vitae", "objective", "about me", "about", "contact", "contact information", "personal information", "experience",
    "work experience", "education", "skills", "projects", "pracovní zkušenosti", "vzdělání", "dovednosti", "životopis",
]
_S = r"[\s\x1c-\x1f]"
# A word in title case: one capital, or a capital and more with a small letter among it.
_TITLE = r"\p{Lu}(?:(?=[\p{L}'’-]*\p{Ll})[\p{L}'’-]+)?"
NAME = rf"(?U)^{_TITLE}(?:{_S}+{_TITLE}){{1,3}}$"
#: Sentinels around an envelope and around what is taken out.
_A, _B, _OPEN, _SHUT = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
_TAKEN = f"{_OPEN}([^{_SHUT}]*){_SHUT}"
HEADER_LINES, NAME_LINES = 20, 10


def mark(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, f"({pattern})", f"{_OPEN}$1{_SHUT}")


def hold(text: Column, envelope: str) -> Column:
    """Sentinels around every match of `envelope`, found left to right without overlap."""
    return F.regexp_replace(text, f"({envelope})", f"{_A}$1{_B}")


def mark_held(held: Column, part: str) -> Column:
    """Mark every `part` inside the envelopes; a text without one stays as it is."""
    inside = F.regexp_replace(F.regexp_replace(held, rf"\b({part})\b(?=[^{_A}{_B}]*{_B})", f"{_OPEN}$1{_SHUT}"), f"[{_A}{_B}]", "")
    return F.when(F.contains(held, F.lit(_A)), inside).otherwise(held)


def mark_address(text: Column) -> Column:
    street = lambda x, i: F.when((i < HEADER_LINES) & x.rlike(ADDRESS_LINE), F.regexp_replace(x, r"(?sU)^(\s*)(.*?)(\s*)$", f"$1{_OPEN}$2{_SHUT}$3")).otherwise(x)
    return F.array_join(F.transform(F.split(text, "\n"), street), "\n")


def header_name(text: Column) -> Column:
    """The name in the first ten non-blank lines, or null: two to four words, all in title case, and no heading.

    On a line with markers it is what the markers and separators leave, if that stands together and the line
    has no colon ('Jan Novotny | [PHONE]').
    """
    strip = lambda x: F.regexp_replace(x, rf"(?U)^{_S}+|{_S}+$", "")

    def name(x: Column) -> Column:
        left = strip(F.regexp_replace(F.regexp_replace(x, rf"{MARKER}|[|·•—–]", " "), rf"(?U){_S}+", " "))
        fits = lambda n: n.rlike(NAME) & ~F.lower(n).isin(HEADINGS)
        mixed = F.when(~F.contains(x, F.lit(":")) & fits(left) & F.contains(x, left), left)
        return F.when(x.rlike(MARKER), mixed).when(fits(x) & x.rlike(r"\p{Ll}"), x)

    head = F.slice(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), 1, NAME_LINES)
    return F.try_element_at(F.filter(F.transform(head, name), lambda x: x.isNotNull()), F.lit(1))


# The passes in their order, with the kind each is logged as and its placeholder.
PASSES = [
    ("url", "url", "[URL]"), ("email", "email", "[EMAIL]"), ("phone", "phone", "[PHONE]"), ("address", "address", "[ADDRESS]"), ("postcode", "address", "[POSTCODE]"),
    ("year", "year", "[YEAR]"), ("name", "name", "[NAME]"), ("name_label", "name", "[NAME]"),
]
KINDS = [name for name, _, _ in PASSES]


def _passes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, _t: the redacted text, and per pass the text it saw with its marks, as _pass)."""
    t = F.col("_t")
    named = F.concat(F.lit(r"(?U)(?<!\w)(\Q"), F.col("_header"), F.lit(r"\E)(?!\w)"))
    marks = {
        "url": mark(t, URL), "email": mark(t, EMAIL), "phone": mark(t, PHONE), "address": mark_address(t), "postcode": mark_held(F.col("_held"), r"\d{3} ?\d{2}"),
        "year": mark_held(F.col("_held"), YEAR), "name": F.when(F.col("_header").isNotNull(), F.regexp_replace(t, named, F.lit(f"{_OPEN}$1{_SHUT}"))).otherwise(t),
        "name_label": F.regexp_replace(t, NAME_LABEL, f"$1{_OPEN}$2{_SHUT}"),
    }
    steps = df.select(key, F.col(text).alias("_t"))
    envelopes = {"postcode": POSTCODE_ENVELOPE, "year": YEAR_ENVELOPE}
    for name, _, placeholder in PASSES:
        if name in envelopes:
            steps = steps.withColumn("_held", hold(t, envelopes[name]))
        if name == "name":
            steps = steps.withColumn("_header", header_name(t))
        # Most passes take nothing out of most texts.
        marked = F.col(f"_{name}")
        steps = steps.withColumn(f"_{name}", marks[name]).withColumn("_t", F.when(F.contains(marked, F.lit(_OPEN)), F.regexp_replace(marked, _TAKEN, placeholder)).otherwise(marked))
    return steps.drop("_header", "_held")


def _count(marked: Column) -> Column:
    return F.coalesce(F.length(marked) - F.length(F.replace(marked, F.lit(_OPEN), F.lit(""))), F.lit(0)).cast("int")


def redact(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, redacted, and the number of replacements of each pass): the ordered passes over the whole text.

    A null text stays null with zero counts.  A second run over the result changes nothing.
    """
    return _passes(df, key, text).select(key, F.col("_t").alias("redacted"), *(_count(F.col(f"_{k}")).alias(f"n_{k}") for k in KINDS))


def audit_all(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, step, kind, ord, original, replacement, span_start, span_end) of everything that redact() takes out, as many rows of a step as its count there.

    kind is what it is logged as: a postcode is an address, a name after 'Name:' a name.  Spans are places in the text
    as the step left it, which later steps may shift.
    """

    def entries(name: str, kind: str, placeholder: str) -> Column:
        marked = F.col(f"_{name}")
        taken = F.regexp_extract_all(marked, F.lit(_TAKEN), F.lit(1))
        around = F.transform(F.split(marked, _TAKEN, -1), F.length)
        n = len(placeholder)

        def row(x: Column, i: Column) -> Column:
            start = F.aggregate(F.slice(around, 1, i + 1), F.lit(0), lambda a, v: a + v) + i * n
            return F.struct(F.lit(name).alias("step"), F.lit(kind).alias("kind"), i.alias("ord"), x.alias("original"), F.lit(placeholder).alias("replacement"), start.alias("span_start"), (start + n).alias("span_end"))

        return F.coalesce(F.transform(taken, row), F.array().cast("array<struct<step:string,kind:string,ord:int,original:string,replacement:string,span_start:int,span_end:int>>"))

    found = F.concat(*(entries(*p) for p in PASSES))
    return each(_passes(df, key, text), [key], found, "r").select(key, "r.*")


def kind_counts(audit: DataFrame, cvs: DataFrame, key: str = "cv_id") -> DataFrame:
    """(key, url, email, phone, year, address, name): replacements of each kind, zeros for absent kinds and documents without any."""
    n = audit.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("url", "email", "phone", "year", "address", "name")])
    return cvs.select(key).distinct().join(n, key, "left").na.fill(0)
