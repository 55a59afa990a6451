"""Lines, headers and sections of documents.

A document is one row, so all that happens inside it is array expressions over its lines: nothing is shuffled to
cut a text into sections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import BLANK, each, fold, squeeze, strip, word_count

# Section headers by family; equal families are one section in either language.
SECTION_FAMILIES = [
    "experience|work experience|professional experience|pracovni zkusenosti|zkusenosti|praxe",
    "academic experience|academic practice|research experience|akademicka praxe",
    "education|vzdelani", "skills|dovednosti|nejcastejsi dovednosti", "languages|jazyky", "certifications|certifikace",
    "awards|honors-awards|oceneni", "publications|publikace", "projects|projekty", "summary|shrnuti", "profile|profil",
    "contact|kontakt", "grants|granty", "teaching|vyuka", "conferences|konference", "references|reference",
]
_FAMILY_OF = {name: line.split("|")[0] for line in SECTION_FAMILIES for name in line.split("|")}
# Families whose sections hold employers, headers that are no employer, and how companies end.
WORK_FAMILIES = ["experience", "academic experience"]
NOT_EMPLOYERS = [
    "community", "case studies", "interests", "leadership", "open source", "portfolio", "side projects", "selected case studies",
    "selected projects", "volunteer", "volunteering",
]
COMPANY_ENDS = [" a.s.", " s.r.o.", " corp", " corporation", " gmbh", " group", " inc", " llc", " ltd", " plc"]
MARKED = r"^#{1,6}\s+\S"
ALL_CAPS = r"^\p{Lu}[\p{Lu} &/]{6,}$"
BULLET = r"^(?:[-*•·] +|\d{1,3}[.)] +)"


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line) of every line; null texts give none."""
    return each(df, [key], split_lines(F.col(text)), "line", "pos")


def section_family(name: Column) -> Column:
    """The family of a section name, or the folded name itself when unknown."""
    key = squeeze(fold(name))
    table = F.create_map(*[x for k, v in _FAMILY_OF.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, key), key)


def bare(line: Column) -> Column:
    """A header line without hashes, blanks and its final colon."""
    return strip(F.regexp_replace(strip(F.regexp_replace(strip(line), r"^#{1,6} +", "")), r":$", ""))


def is_header(line: Column) -> Column:
    """A known section name of up to 40 characters, or seven or more capitals; a line that is marked already isn't counted.

    Most lines are too long for a name, which their length without blanks tells before anything is folded.
    """
    name = lambda x: strip(F.regexp_replace(strip(x), r":$", ""))
    capitals = line.rlike(rf"^{BLANK}*\p{{Lu}}[\p{{Lu}} &/]{{5,}}[\p{{Lu}}&/]{BLANK}*:?{BLANK}*$")
    short = F.length(F.translate(line, " \t\u00a0", "")) <= 41
    known = F.when(short, (F.length(name(line)) <= 40) & squeeze(fold(name(line))).isin(list(_FAMILY_OF))).otherwise(F.lit(False))
    return ~line.startswith("##") & (capitals | known)


def headers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line) of the header lines."""
    return lines(df, key, text).where(is_header(F.col("line")))


def split_lines(text: Column) -> Column:
    return F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")


def with_annotated_lines(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the array `out` of a text's lines, a '## ' line before each header line unless one stands there already.

    What a lambda looks at besides its argument is a column of its own: an expression there would be evaluated for
    every element.
    """
    mark = lambda x: F.concat(F.lit("## "), strip(x))
    df = df.withColumn("_raw", split_lines(F.col(text)))
    fresh = lambda x, i: is_header(x) & ~F.coalesce(F.get("_raw", i - 1) == mark(x), F.lit(False))
    return df.withColumn(out, F.flatten(F.transform("_raw", lambda x, i: F.when(fresh(x, i), F.array(mark(x), x)).otherwise(F.array(x))))).drop("_raw")


def annotate(df: DataFrame, key: str, text: str, out: str = "annotated") -> DataFrame:
    """(key, out): each text annotated; null stays null."""
    return with_annotated_lines(df.select(key, text), text, "_ls").select(key, F.array_join("_ls", "\n").alias(out))


# Names in the three spellings that a heading inside a line may have: as listed with a capital, each word with one, all capitals.
INLINE_NAMES = [
    "experience", "work experience", "professional experience", "pracovní zkušenosti", "zkušenosti", "praxe", "academic experience", "academic practice", "research experience",
    "akademická praxe", "education", "vzdělání", "skills", "dovednosti", "nejčastější dovednosti", "languages", "jazyky", "certifications", "certifikace", "awards", "honors-awards",
    "ocenění", "publications", "publikace", "projects", "projekty", "summary", "shrnutí", "profile", "profil", "contact", "kontakt", "grants", "granty", "teaching", "výuka",
    "conferences", "konference", "references", "reference",
]


def _inline_pattern() -> str:
    spellings = {s for n in INLINE_NAMES for s in (n[0].upper() + n[1:], " ".join(w[0].upper() + w[1:] for w in n.split(" ")), n.upper())}
    return r"(?U)(?<![#\w])(" + "|".join(sorted(spellings, key=lambda x: (-len(x), x))) + r")(?=\s|:|$)"


def repair_headers(text: Column) -> Column:
    """Section names written inside a line go on lines of their own, without a colon after them; lines that start with '##' stay."""

    def line(x: Column) -> Column:
        parts = F.split(F.regexp_replace(x, _inline_pattern() + ":?", "\x01$1\x01"), "\x01")
        fixed = F.array_join(F.filter(F.transform(parts, strip), lambda w: w != ""), "\n")
        return F.when(strip(x).startswith("##") | ~x.rlike(_inline_pattern()), x).otherwise(fixed)

    ls = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    return F.array_join(F.transform(ls, line), "\n")


def employer_like(name: Column) -> Column:
    """A header that may name an employer: a company's ending, or at most five words that are capitalised or hold one in capitals."""
    key = F.regexp_replace(squeeze(fold(name)), r":$", "")
    tokens = F.regexp_extract_all(name, F.lit(r"[0-9A-Za-z\x{c0}-\x{17e}][0-9A-Za-z\x{c0}-\x{17e}.&+-]*"), F.lit(0))
    upper = lambda t: (t == F.upper(t)) & (t != F.lower(t))
    loud = F.exists(tokens, lambda t: upper(t) & (F.length(F.regexp_replace(t, r"^[.&+-]+|[.&+-]+$", "")) >= 2))
    all_capital = F.forall(tokens, lambda t: upper(F.substring(t, 1, 1)))
    padded = F.concat(F.lit(" "), key)
    company = F.exists(F.array(*[F.lit(c) for c in COMPANY_ENDS]), lambda c: F.contains(padded, c))
    return ~key.isin(NOT_EMPLOYERS) & (company | ((F.size(tokens) > 0) & (F.size(tokens) <= 5) & (loud | all_capital)))


def section_key(name: Column) -> Column:
    """What a header and a section asked for are compared by: the family of a known name, else the folded name."""
    return section_family(name)


def marked_headers(ls: Column) -> Column:
    """Per '#' line: its place, level, key, whether the name is known, and whether it looks like an employer."""
    name = lambda x: F.regexp_extract(x, r"^#{1,6}\s+(.+)$", 1)
    known = lambda n: squeeze(fold(n)).isin(list(_FAMILY_OF))
    info = lambda x, i: F.when(x.rlike(MARKED), F.struct(i.alias("pos"), F.length(F.regexp_extract(x, "^(#{1,6})", 1)).alias("level"), section_key(name(x)).alias("key"), known(name(x)).alias("known"), employer_like(name(x)).alias("employer")))
    return F.array_compact(F.transform(ls, info))


def with_slices(df: DataFrame, text: str, out: str = "slices") -> DataFrame:
    """df with the array `out` of struct(section, body): one body per section key, that of its first header.

    The text is annotated first.  A known section reaches over its child headers - deeper ones, and inside a work
    section those that look like an employer - to the next known or other header; an unknown one ends at the next
    header.  Null texts give null, texts without headers an empty array.
    """
    df = with_annotated_lines(df, text, "_ls")
    df = df.withColumn("_hs", marked_headers(F.col("_ls"))).withColumn("_keys", F.transform("_hs", lambda h: h["key"]))

    def end(h: Column) -> Column:
        child = lambda n: (n["level"] > h["level"]) | (h["key"].isin(WORK_FAMILIES) & n["employer"])
        stops = F.filter("_hs", lambda n: (n["pos"] > h["pos"]) & (~h["known"] | n["known"] | ~child(n)))
        return F.coalesce(F.try_element_at(stops, F.lit(1))["pos"], F.size("_ls"))

    first = F.filter("_hs", lambda h, i: F.array_position("_keys", h["key"]) == i + 1)
    body = lambda h: F.array_join(F.slice("_ls", h["pos"] + 2, end(h) - h["pos"] - 1), "\n")
    return df.withColumn(out, F.transform(first, lambda h: F.struct(h["key"].alias("section"), body(h).alias("body")))).drop("_ls", "_hs", "_keys")


def section_slices(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, body) of every section; see with_slices."""
    return each(with_slices(df.select(key, text), text), [key], F.col("slices"), "s").select(key, "s.section", "s.body")


def segments(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, section, lines): the runs of lines between headers, header lines left out; section is null before the first."""
    ls = split_lines(F.col(text))
    df = df.where(F.col(text).isNotNull()).select(key, ls.alias("_ls"))
    at = F.transform("_ls", lambda x, i: F.when(is_header(x) | x.rlike(r"^#{1,6} +\S"), i))
    df = df.withColumn("_at", F.concat(F.array(F.lit(-1)), F.array_compact(at), F.array(F.size("_ls"))))
    name = lambda i: F.when(i >= 0, section_family(bare(F.get("_ls", i))))
    runs = F.transform(F.sequence(F.lit(0), F.size("_at") - 2), lambda k: F.struct((F.get("_at", k) + 1).alias("start"), name(F.get("_at", k)).alias("section"), F.slice("_ls", F.get("_at", k) + 2, F.get("_at", k + 1) - F.get("_at", k) - 1).alias("lines")))
    return each(df, [key], runs, "r").select(key, "r.*")


def section_sizes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, n_lines, n_words) of the sections' bodies; header and blank lines don't count."""
    runs = segments(df, key, text).select(key, F.coalesce("section", F.lit("")).alias("section"), F.filter("lines", lambda x: strip(x) != "").alias("ls"))
    runs = runs.where(F.size("ls") > 0).select(key, "section", F.size("ls").alias("n"), word_count(F.array_join("ls", " ")).alias("w"))
    return runs.groupBy(key, "section").agg(F.sum("n").alias("n_lines"), F.sum("w").alias("n_words"))


def anchorable(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, quote, section) of lines with six or more words, bullets and a final full stop removed."""
    ls = each(segments(df, key, text), [key, "section", "start"], F.col("lines"), "line", "at")
    quote = strip(F.regexp_replace(strip(F.regexp_replace(strip(F.col("line")), BULLET, "")), r"\.$", ""))
    return ls.withColumn("quote", quote).where(word_count(F.col("quote")) >= 6).select(key, (F.col("start") + F.col("at")).alias("pos"), "quote", "section")


def token_overlap(source: Column, candidate: Column) -> Column:
    """Share of the source's distinct tokens of three or more characters that the candidate holds; 1 without such tokens."""
    toks = lambda c: F.filter(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[0-9A-Za-z\x{c0}-\x{17e}]+"), F.lit(0))), lambda t: F.length(t) >= 3)
    s = toks(source)
    return F.when(F.size(s) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(s, toks(candidate))) / F.size(s))


# What stands in a side column, and what begins the body of a CV.
SIDEBAR = ["kontakt", "contact", "nejčastější dovednosti", "dovednosti", "skills", "jazyky", "languages", "certifikace", "certifications", "honors-awards"]
BODY = ["pracovní zkušenosti", "professional experience", "work experience", "experience"]


def order_ok(text: Column) -> Column:
    """Whether side-column headings come before the body: contact never after it, and three or more others all before it once one is."""
    t = F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[0-9a-z\x{c0}-\x{17e}]+"), F.lit(0)), " ")
    at = lambda names: F.filter(F.array(*[F.instr(t, n.replace("-", " ")) for n in names]), lambda p: p > 0)
    body, side = F.array_min(at(BODY)), at(SIDEBAR)
    contact = F.array_min(at(["kontakt", "contact"]))
    bad = (contact > body) | ((F.size(side) >= 3) & (F.array_min(side) < body) & (F.array_max(side) > body))
    return ~F.coalesce(bad, F.lit(False))


MIN_CHARS, MIN_SHARE, MIN_OVERLAP = 100, 0.45, 0.70


def rejected(candidate: Column, source: Column | None = None) -> Column:
    """Why a transcript made elsewhere isn't taken, or null: too short, (with a source) too little of its tokens, or columns in the wrong order."""
    n = F.length(strip(candidate))
    short = candidate.isNull() | (n < MIN_CHARS)
    if source is not None:
        short = short | (n < F.floor(F.length(strip(source)) * MIN_SHARE))
        out = F.when(short, "under_min_chars").when(token_overlap(source, candidate) < MIN_OVERLAP, "low_source_overlap")
    else:
        out = F.when(short, "under_min_chars")
    return out.when(~order_ok(strip(candidate)), "column_order_flipped")


def choose_text(extracted: Column, candidate: Column, mode: Column | str, budget_ok: Column | None = None) -> Column:
    """struct(text, notice): the candidate where it is asked for ('llm' or 'vision'), within budget and not rejected, else the extracted text.

    A candidate beyond budget falls back only to an extracted text of at least MIN_CHARS; the notice says why.
    """
    mode = F.lit(mode) if isinstance(mode, str) else mode
    wanted = mode.isin("llm", "vision")
    over = wanted & ~(F.lit(True) if budget_ok is None else budget_ok)
    why = F.when(mode == "llm", rejected(candidate, extracted)).otherwise(rejected(candidate))
    text = F.when(~wanted, extracted).when(over, F.when(F.length(strip(extracted)) >= MIN_CHARS, extracted)).when(why.isNull(), candidate).otherwise(extracted)
    return F.struct(text.alias("text"), F.when(over, "over_budget").when(wanted, why).alias("notice"))


def strip_fences(text: Column) -> Column:
    """Text without wrapping ``` fences (with or without a language) and without its first <think> block."""
    t = strip(F.regexp_replace(text, r"(?s)^(.*?)<think>.*?</think>", "$1"))
    return F.when(t.rlike(r"(?s)^```[a-zA-Z]*\n.*\n?```$"), strip(F.regexp_extract(t, r"(?s)^```[a-zA-Z]*\n(.*?)\n?```$", 1))).otherwise(t)


