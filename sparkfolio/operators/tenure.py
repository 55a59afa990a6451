"""Date ranges in text, their union in months, tenure in years, and the lines around dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import each, fold, strip
from .intervals import merge_intervals
from .sections import split_lines
from .timestamps import TODAY_MONTH

# Month names as the range scan knows them, accents folded, in month order.
MONTHS = [
    "january jan leden ledna", "february feb unor unora", "march mar brezen brezna", "april apr duben dubna", "may kveten kvetna", "june jun cerven cervna",
    "july jul cervenec cervence", "august aug srpen srpna", "september sept sep zari", "october oct rijen rijna", "november nov listopad listopadu", "december dec prosinec prosince",
]
PRESENT = "present current now nyni soucasnost soucasne dosud".split()
MONTH_NUMBER = {w: i + 1 for i, ws in enumerate(MONTHS) for w in ws.split()}
_alt = lambda ws: "|".join(sorted(ws, key=lambda w: (-len(w), w)))
ENDPOINT = rf"(?:(?:{_alt(MONTH_NUMBER)})\s+(?:19|20)\d{{2}}|(?:19|20)\d{{2}}|(?:{_alt(PRESENT)}))"
RANGE = rf"(?U)\b({ENDPOINT})\s*[-–—]\s*({ENDPOINT})\b"
# Headings that begin the work section, and those that end it, accents folded.
WORK_HEADINGS = [
    "work experience", "experience", "professional experience", "employment", "employment history", "career", "career history", "pracovni zkusenosti", "zkusenosti", "praxe",
    "zamestnani",
]
OTHER_HEADINGS = [
    "education", "skills", "projects", "personal projects", "publications", "certifications", "certificates", "languages", "hobbies", "interests", "awards", "volunteer", "volunteering",
    "references", "summary", "profile", "about", "about me", "objective", "contact", "vzdelani", "dovednosti", "projekty", "jazyky", "zajmy", "konicky", "certifikaty", "publikace",
    "ocenenia", "reference",
]
YEAR_SHAPED = r"\[YEAR\]|\b(?:19|20)\d\d\b"


def heading(line: Column) -> Column:
    """What a heading line is compared by: folded, without hashes, colons and blanks around."""
    return strip(F.regexp_replace(strip(F.regexp_replace(strip(fold(line)), "^#+", "")), ":+$", ""))


def with_work_lines(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the array `out` of the lines after the first work heading up to the next heading of another section; null without one."""
    first = lambda names, of: F.nullif(F.array_position(F.transform(names, lambda n: n.isin(of)), True), F.lit(0))
    df = df.withColumn("_wl", split_lines(F.col(text))).withColumn("_wh", F.transform("_wl", heading))
    df = df.withColumn("_ws", first("_wh", WORK_HEADINGS).cast("int"))
    df = df.withColumn("_we", first(F.slice("_wh", F.col("_ws") + 1, F.size("_wh")), OTHER_HEADINGS).cast("int"))
    n = F.coalesce(F.col("_we") - 1, F.size("_wl"))
    return df.withColumn(out, F.slice("_wl", F.col("_ws") + 1, n)).drop("_wl", "_wh", "_ws", "_we")


def endpoint_month(e: Column, today: int) -> Column:
    """Absolute month of a range's end; null when its year is missing."""
    names = F.create_map(*[x for k, v in MONTH_NUMBER.items() for x in (F.lit(k), F.lit(v))])
    year = F.regexp_extract(e, r"((?:19|20)\d{2})", 1).try_cast("int")
    month = F.coalesce(F.try_element_at(names, F.regexp_extract(e, r"^([a-z]+)", 1)), F.lit(1))
    return F.when(e.isin(PRESENT), F.lit(today)).otherwise(year * 12 + month - 1)


def range_months(text: Column, today: int = TODAY_MONTH) -> Column:
    """array<struct<start, end>> of the half-open months of every range; reversed ones are dropped, ends in the future cut to today."""
    f = fold(text)
    pairs = F.arrays_zip(F.regexp_extract_all(f, F.lit(RANGE), F.lit(1)).alias("a"), F.regexp_extract_all(f, F.lit(RANGE), F.lit(2)).alias("b"))
    months = F.transform(pairs, lambda p: F.struct(endpoint_month(p["a"], today).alias("start"), endpoint_month(p["b"], today).alias("end")))
    kept = F.filter(months, lambda m: (m["start"] <= m["end"]) & (m["start"] <= today))
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), (F.least(m["end"], F.lit(today)) + 1).alias("end")))


def ranges(df: DataFrame, key: str, text: str, today: int = TODAY_MONTH) -> DataFrame:
    """(key, start, end) of every range of a text; null texts give none."""
    return each(df, [key], range_months(F.col(text), today), "r").select(key, "r.start", "r.end")


def union_months(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, islands, months): the union of a key's half-open intervals; touching ones merge.

    Partial interval maps shrink a hot key before the shuffle.  Null keys and bounds and reversed intervals count for nothing.
    """
    periods = merge_intervals(df, key, start, end).where("kind = 'period'")
    return periods.groupBy(key).agg(F.count("*").alias("islands"), F.sum(F.col(end) - F.col(start)).alias("months"))


def covered_months(intervals: Column) -> Column:
    """Months that an array of half-open intervals covers; 0 for none."""
    state = F.struct(F.lit(0).alias("until"), F.lit(0).alias("months"))

    def add(a: Column, m: Column) -> Column:
        fresh = F.greatest(m["end"] - F.greatest(m["start"], a["until"]), F.lit(0))
        return F.struct(F.greatest(a["until"], m["end"]).alias("until"), (a["months"] + fresh).alias("months"))

    return F.aggregate(F.array_sort(intervals), state, add, lambda a: a["months"])


def tenure_years(df: DataFrame, key: str, text: str, today: int = TODAY_MONTH) -> DataFrame:
    """(key, years): whole years covered by the ranges of the text's work section, or of all the text where it has none; null without ranges.

    Keys are taken as they come: a repeated key gives repeated rows.
    """
    scoped = with_work_lines(df.select(key, text), text, "_w").withColumn("_scope", F.coalesce(F.array_join("_w", "\n"), F.col(text)))
    months = scoped.select(key, covered_months(range_months(F.col("_scope"), today)).alias("months"))
    return months.select(key, F.when(F.col("months") > 0, F.floor(F.col("months") / 12)).cast("int").alias("years"))


def is_date_line(line: Column) -> Column:
    return (F.length(line) <= 80) & line.rlike(r"[-–—]") & line.rlike("(?U)" + YEAR_SHAPED)


def is_current(rest: Column, this_year: int = TODAY_MONTH // 12) -> Column:
    """Whether what follows a date line's first dash leaves the stint open.

    A present word does.  Else the end is what follows the last dash that stands after the only year so far, or that
    opens a new stint ('2014 - 2016, 2019 - '), unless a mere remark follows it; nothing there means open, a marked
    year closed, and a year must have come.
    """
    years = lambda x: F.size(F.regexp_extract_all(x, F.lit(f"(?U)({YEAR_SHAPED})"), F.lit(1)))
    before, after = lambda p: F.substring(rest, F.lit(1), p - 1), lambda p: F.substring(rest, p + 1, F.length(rest))

    def opens(x: Column) -> Column:
        balanced = F.length(F.replace(x, F.lit("("), F.lit(""))) == F.length(F.replace(x, F.lit(")"), F.lit("")))
        return balanced & x.rlike(r"(?:^|[,;])\s*(?:\[YEAR\]|(?:19|20)\d\d)\s*$")

    def counts(p: Column) -> Column:
        x, y = before(p), after(p)
        return x.rlike(r"(?U)(?:\[YEAR\]|\b(?:19|20)\d\d)\s*$") & ((years(x) == 1) | opens(x)) & ((strip(y) == "") | (years(y) > 0))

    dashes = F.filter(F.sequence(F.lit(1), F.greatest(F.length(rest), F.lit(1))), lambda p: F.substring(rest, p, F.lit(1)).isin("-", "–", "—"))
    end = F.coalesce(F.try_element_at(F.transform(F.filter(dashes, counts), after), F.lit(-1)), rest)
    first = F.regexp_extract(end, f"(?U)({YEAR_SHAPED})", 1)
    present = fold(rest).rlike(r"(?U)\b(?:" + _alt(PRESENT) + r")\b")
    return F.when(rest.isNotNull(), present | (strip(end) == "") | F.coalesce(first.try_cast("int") >= this_year, F.lit(False)))


def timeline(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, header, dates_raw, is_current) of each date line of the work section; none without one.

    pos counts the section's lines.  The header is the up to three lines above, up to a blank, a date line or a
    heading, without bullets, joined by a dash.
    """
    df = with_work_lines(df.select(key, text), text, "_ls").select(key, "_ls")
    stop = lambda x: (strip(x) == "") | is_date_line(x) | heading(x).isin(WORK_HEADINGS + OTHER_HEADINGS)
    df = df.withColumn("_stop", F.transform("_ls", stop)).withColumn("_clean", F.transform("_ls", lambda x: strip(F.regexp_replace(strip(x), r"^(?:[-*•–—]\s*)+", ""))))
    at = lambda name, k: F.get(name, F.col("pos") - k)
    df = each(df, [key, "_ls", "_stop", "_clean"], F.col("_ls"), "line", "pos").where(is_date_line(F.col("line")))
    ok, parts = F.lit(True), []
    for k in (1, 2, 3):
        ok = ok & ~F.coalesce(at("_stop", k), F.lit(True))
        parts.insert(0, F.when(ok & (at("_clean", k) != ""), at("_clean", k)))
    rest = F.regexp_extract("line", r"^[^—–-]*[—–-](.*)$", 1)
    rows = df.select(key, "pos", F.array_join(F.array_compact(F.array(*parts)), " — ").alias("header"), strip(F.col("line")).alias("dates_raw"), rest.alias("_rest"))
    return rows.select(key, "pos", "header", "dates_raw", is_current(F.col("_rest")).alias("is_current"))
