"""Mixed timestamp formats and zones -> one unambiguous form per record.

`interpretations` lists every valid reading of a raw value; `normalise_dates` picks one reading per
record by a Viterbi pass over each source's record order.  A source's records are cut into blocks of
`BLOCK` positions, each block yields a max-plus transfer matrix between the readings of its first and
last record, the matrices of a source are chained, and each block is decoded with its ends fixed.  The
result equals one Viterbi pass over the whole source, yet no task holds more than one block's records.
"""

from __future__ import annotations

import json
import re
import unicodedata
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Month names, accents folded, in natural order, per language and case form.
MONTH_WORDS = [
    "january januar janvier enero leden ledna lednu januara jan janv ene jaenner janner",
    "february februar fevrier febrero unor unora unoru februara feb fevr",
    "march marz maerz mars marzo brezen brezna breznu marec marca mar mrz",
    "april avril abril duben dubna dubnu aprila apr avr abr",
    "may mai mayo kveten kvetna kvetnu maj maja",
    "june juni juin junio cerven cervna cervnu jun juna",
    "july juli juillet julio cervenec cervence cervenci jul jula juil",
    "august aout agosto srpen srpna srpnu augusta aug ago",
    "september septembre septiembre setiembre zari septembra sep sept",
    "october oktober octobre octubre rijen rijna rijnu oktobra oct okt",
    "november novembre noviembre listopad listopadu novembra nov",
    "december dezember decembre diciembre prosinec prosince prosinci decembra dec dez dic",
]
# Words that say a period still runs, accents folded.
PRESENT_WORDS = [
    "present", "the present", "now", "current", "currently", "today", "ongoing", "to date",
    "nyni", "soucasnost", "soucasnosti", "dosud", "dodnes", "dnes", "sucasnost", "sucasnosti", "doteraz", "sucasne", "teraz",
    "heute", "jetzt", "laufend", "aujourd'hui", "aujourdhui", "maintenant", "ce jour", "present",
    "actualidad", "la actualidad", "actual", "hoy", "la fecha", "presente",
]
# Words before a lone start that say it lasts.
DURATION_WORDS = ["since", "from", "od", "seit", "ab", "von", "depuis", "desde", "de", "des", "a partir de"]
RANGE_WORDS = ["to", "until", "till", "through", "bis", "az", "do", "a", "au", "al", "hasta", "hasta la", "jusqu'a", "jusqu'au", "y"]
# Minutes from UTC of zone abbreviations.
ZONE_MINUTES = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "ist": 330, "aest": 600, "aedt": 660,
}

TODAY_MONTH = 24316
DEFAULT_ZONE = "Europe/Prague"
#: Positions in a block, record ids in a page of blocks, and pages whose blocks make a reach (as a power of two).
BLOCK, PAGE, REACH = 256, 20_000, 6
#: Reading a slashed date against its zone's order outweighs any path; of other numbers no rule speaks, and day first is only preferred.
RULE_COST, ORDER_COST, SWITCH_COST, BACKWARD_COST = 12.0, 0.5, 1.0, 2.0

_MONTH_OF = {w: i + 1 for i, line in enumerate(MONTH_WORDS) for w in line.split()}
_MON = r"(?P<mon>" + "|".join(sorted(_MONTH_OF, key=len, reverse=True)) + r")(?![a-z])\.?"
_Y4 = r"(?P<y>(?:19|20)\d\d)(?!\d)"
_ZONES = {z.lower(): z for z in available_timezones() if "/" in z}
_ZONE = (
    r"(?P<zone>[+-]\d\d:?\d\d(?!\d)|\s?(?:z|utc|gmt)(?![a-z/])(?:[+-]\d\d?:?(?:\d\d)?)?"
    r"|\s?\[[a-z_]+(?:/[a-z_-]+){1,2}\]|\s[a-z_]+(?:/[a-z_-]+){1,2}|\s(?:" + "|".join(k for k in ZONE_MINUTES if len(k) > 1) + r")(?![a-z/]))?"
)
_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:[.,]\d+)?)?(?:\s?(?P<ap>[ap])\.?m\b\.?)?" + _ZONE
_TAIL = r"(?:(?:t|,?\s+(?:at |um |v |a las )?)" + _TIME + r")?"
_WEEKDAY = r"(?:[a-z]{2,9}\.?,\s*)?"

# Order matters: the first pattern that matches at a position wins.
_PATTERNS: list[tuple[str, re.Pattern]] = [
    ("compact_time", re.compile(r"(?P<y>(?:19|20)\d\d)(?P<m>\d\d)(?P<d>\d\d)t(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)?(?:[.,]\d+)?" + _ZONE)),
    ("epoch_ms", re.compile(r"(?P<epoch>\d{13})(?!\d)")),
    ("epoch_s", re.compile(r"(?P<epoch>\d{9,10})(?![\d])")),
    ("iso_day", re.compile(r"(?P<y>(?:19|20)\d\d)-(?P<m>\d\d?)-(?P<d>\d\d?)(?!\d)" + _TAIL)),
    ("ymd_slash", re.compile(r"(?P<y>(?:19|20)\d\d)/(?P<m>\d\d?)/(?P<d>\d\d?)(?!\d)" + _TAIL)),
    ("ymd_dot", re.compile(r"(?P<y>(?:19|20)\d\d)\.(?P<m>\d\d?)\.(?P<d>\d\d?)(?!\d)\.?" + _TAIL)),
    ("compact_day", re.compile(r"(?P<y>(?:19|20)\d\d)(?P<m>\d\d)(?P<d>\d\d)(?!\d)")),
    ("dmy_word", re.compile(_WEEKDAY + r"(?P<d>\d{1,2})(?:st|nd|rd|th|er|ro|\.)?\s*(?:de\s+|of\s+)?" + _MON + r",?\s*(?:de\s+|del\s+)?(?:" + _Y4 + r"|'?(?P<yy>\d\d)(?![\d:.]))" + _TAIL)),
    ("mdy_word", re.compile(_WEEKDAY + _MON + r"\s*(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+" + _Y4 + _TAIL)),
    ("ymd_word", re.compile(_Y4 + r"[\s-]+" + _MON + r"[\s-]+(?P<d>\d{1,2})(?!\d)" + _TAIL)),
    ("slash", re.compile(r"(?P<a>\d{1,2})/(?P<b>\d{1,2})/(?:" + _Y4 + r"|(?P<yy>\d\d)(?![\d/]))" + _TAIL)),
    ("dmy_dot", re.compile(r"(?P<d>\d{1,2})\.\s?(?P<m>\d{1,2})\.\s?(?:" + _Y4 + r"|(?P<yy>\d\d)(?![\d.]))" + _TAIL)),
    ("dmy_dash", re.compile(r"(?P<d>\d{1,2})-(?P<m>\d{1,2})-(?:" + _Y4 + r")" + _TAIL)),
    ("my_word", re.compile(_MON + r"[\s,/-]*(?:de\s+|del\s+)?(?:" + _Y4 + r"|'\s?(?P<yy>\d\d)(?!\d)|(?P<yz>\d\d)(?![\d:./]))")),
    ("ym_word", re.compile(_Y4 + r"[\s,/-]*" + _MON)),
    ("ym_dash", re.compile(r"(?P<y>(?:19|20)\d\d)-(?P<m>\d\d?)(?!\d)")),
    ("ym_slash", re.compile(r"(?P<y>(?:19|20)\d\d)/(?P<m>\d\d?)(?!\d)")),
    ("ym_dot", re.compile(r"(?P<y>(?:19|20)\d\d)\.(?P<m>\d\d?)(?!\d)")),
    ("my_slash", re.compile(r"(?P<m>\d{1,2})/(?:" + _Y4 + r"|'?(?P<yy>\d\d)(?![\d/]))")),
    ("my_dot", re.compile(r"(?P<m>\d{1,2})\.\s?" + _Y4)),
    ("my_dash", re.compile(r"(?P<m>\d{1,2})-" + _Y4)),
    ("year", re.compile(_Y4)),
    ("present", re.compile("(?:" + "|".join(sorted(map(re.escape, PRESENT_WORDS), key=len, reverse=True)) + r")(?![a-z])")),
]
_YEAR_SHORT = re.compile(r"(?P<y>(?:19|20)\d\d)\s*[–—-]\s*(?P<z>\d\d)(?![\w/.:-])")
_RANGE_GAP = re.compile(
    r"\s*(?:[)\]]?\s*[-–—~→]+\s*|/|\s/\s|,?\s(?:" + "|".join(sorted(RANGE_WORDS, key=len, reverse=True)) + r")\s+)\s*(?:(?:" + "|".join(sorted(RANGE_WORDS, key=len, reverse=True)) + r")\s+)?[(\[]?\s*"
)
_OPEN_GAP = re.compile(r"\s*[-–—~→]+\s*(?:$|[(,;·|\[])")
_DURATION_BEFORE = re.compile(r"(?:^|[^a-z])(?:" + "|".join(sorted(DURATION_WORDS, key=len, reverse=True)) + r")\s*[:(]?\s*$")
_BRACKETS = re.compile(r"\((?!\s*\)).*?\)")


def fold(s: str) -> str:
    """Lower case without accents; every blank becomes a plain one and the like of apostrophes too."""
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    return re.sub(r"\s", " ", s.replace("’", "'").replace("‘", "'").replace("−", "-").replace("‐", "-").replace("‑", "-").replace("‒", "–")).strip()


def _year2(v: str) -> int | None:
    n = int(v)
    return 1900 + n if n >= 90 else 2000 + n if n <= 30 else None


@lru_cache(maxsize=512)
def _zone(name: str) -> ZoneInfo | None:
    proper = _ZONES.get(name.lower())
    return ZoneInfo(proper) if proper else None


def _instant(y: int, mo: int, d: int, h: int, mi: int, s: int, zone: str | None, tz: str | None) -> str | None:
    try:
        local = datetime(y, mo, d, h, mi, s)
        z = (zone or "").strip(" []")
        if m := re.fullmatch(r"(?:utc|gmt)?([+-])(\d\d?):?(\d\d)?", z):
            delta = timedelta(minutes=(1 if m[1] == "+" else -1) * (60 * int(m[2]) + int(m[3] or 0)))
            return (local - delta).strftime("%Y-%m-%dT%H:%M:%SZ")
        if z in ZONE_MINUTES:
            minutes = 60 if z == "ist" and tz == "Europe/Dublin" else ZONE_MINUTES[z]
            return (local - timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%SZ")
        info = _zone(z) if z else None
        info = info or _zone(tz or DEFAULT_ZONE) or _zone(DEFAULT_ZONE)
        # fold=0: the earlier of two instants; in a spring jump the offset before it.
        return local.replace(tzinfo=info, fold=0).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except (ValueError, OverflowError):
        return None


def _readings(name: str, m: re.Match, tz: str | None) -> list[tuple[str, str, float]]:
    """Valid readings of one endpoint: (norm, format, cost against the fixed rules)."""
    g = m.groupdict()
    if name == "present":
        return [("present", "present", 0.0)]
    if "epoch" in g:
        t = int(g["epoch"]) / (1000 if name == "epoch_ms" else 1)
        if not 315532800 <= t < 4102444800:
            return []
        return [(datetime.fromtimestamp(int(t), timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), name, 0.0)]
    y = int(g["y"]) if g.get("y") else _year2(g.get("yy") or g.get("yz") or "99x"[:2])
    if y is None or not 1900 <= y <= 2099:
        return []
    if g.get("mon"):
        month_day = [(_MONTH_OF[g["mon"]], g.get("d"), name, 0.0)]
    elif "a" in g:
        a, b, us = int(g["a"]), int(g["b"]), (tz or "").startswith("America/")
        month_day = [(a, b, "slash_mdy", 0.0 if us else RULE_COST), (b, a, "slash_dmy", RULE_COST if us else 0.0)]
    else:
        month_day = [(int(g["m"]) if g.get("m") else None, g.get("d"), name, 0.0)]
        if name == "dmy_dash":
            month_day.append((int(g["d"]), g["m"], "mdy_dash", ORDER_COST))
    out = []
    for mo, d, fmt, cost in month_day:
        if mo is None:
            out.append((f"{y:04d}", fmt, cost))
            continue
        if not 1 <= mo <= 12:
            continue
        if d is None:
            out.append((f"{y:04d}-{mo:02d}", fmt, cost))
            continue
        try:
            datetime(y, mo, int(d))
        except ValueError:
            continue
        if g.get("h") is None:
            out.append((f"{y:04d}-{mo:02d}-{int(d):02d}", fmt, cost))
            continue
        h, mi, s = int(g["h"]), int(g["mi"]), int(g.get("s") or 0)
        if g.get("ap"):
            if not 1 <= h <= 12:
                continue
            h = h % 12 + (12 if g["ap"] == "p" else 0)
        if h == 24 and mi == 0 or s == 60:
            h, s = (0 if h == 24 else h), min(s, 59)
        if norm := _instant(y, mo, int(d), h, mi, s, g.get("zone"), tz):
            out.append((norm, fmt + "_t", cost))
    return out


def _tokens(text: str, tz: str | None):
    """Endpoints in text order: (start, end, readings)."""
    out, i = [], 0
    while i < len(text):
        c, before = text[i], text[i - 1] if i else " "
        if (c.isdigit() and not before.isdigit()) or (c.isalpha() and not before.isalnum()):
            if before.isalpha() and c.isdigit():
                i += 1
                continue
            for name, pattern in _PATTERNS:
                if (m := pattern.match(text, i)) and (found := _readings(name, m, tz)):
                    out.append((i, m.end(), found, name))
                    i = m.end() - 1
                    break
            else:
                if c.isdigit():
                    while i + 1 < len(text) and text[i + 1].isdigit():
                        i += 1
                else:
                    while i + 1 < len(text) and text[i + 1].isalpha():
                        i += 1
        i += 1
    return out


def _key(norm: str) -> str:
    return "9999" if norm == "present" else norm


def interpretations(raw: str | None, tz: str | None, is_current: bool | None) -> list[tuple[str, str, str, float]]:
    """Every valid reading of a raw range as (start_norm, end_norm, format, cost), cheapest first."""
    if raw is None:
        return []
    text = fold(raw)
    if text.startswith("(") and text.endswith(")"):
        text = text[1:-1].strip()
    text = _BRACKETS.sub(lambda m: " " * len(m[0]), text).rstrip()
    if m := _YEAR_SHORT.search(text):
        # A hyphenated 'YYYY-MM' is a month when the tail can be one; with a longer dash, or no such month, it is a range of years.
        year, tail = int(m["y"]), int(m["z"])
        end = year // 100 * 100 + tail
        end = end if end >= year else end + 100
        long_dash, month = re.search(r"[–—]|\s-|-\s", m[0]) is not None, 1 <= tail <= 12
        alone = re.fullmatch(r"[^\d]*", text[: m.start()]) and not _tokens("".join((text[: m.start()], text[m.start("y"): m.end("y")])), tz)[0][3].startswith(("my", "dmy"))
        if (long_dash or not month) and 1990 <= end <= 2030 and alone:
            return [(f"{year}", f"{end}", "year_short", 0.0)]
    tokens = _tokens(text, tz)
    while tokens and tokens[0][3] == "present":
        tokens = tokens[1:]
    if not tokens:
        return []
    (s0, e0, first, _), rest = tokens[0], text[tokens[0][1]:]
    second = None
    if len(tokens) > 1 and _RANGE_GAP.fullmatch(text[e0: tokens[1][0]]):
        second = tokens[1][2]
    if second is None:
        if _OPEN_GAP.match(rest) or re.fullmatch(r"\s*[-–—~→]+\s*", rest):
            second = [("present", "open", 0.0)]
        elif _DURATION_BEFORE.search(text[:s0]):
            second = [("present", "open", 0.0)]
        elif is_current:
            second = [("present", "lone", 0.0)]
    out = []
    for a, fa, ca in first:
        for b, fb, cb in second or [(a, fa, 0.0)]:
            cost = ca + cb
            if second and b != "present":
                cost += SWITCH_COST * (fa != fb) + BACKWARD_COST * (b < a[: len(b)])
            out.append((a, b, fa, cost))
    return sorted(set(out), key=lambda r: (r[3], r))


def step_cost(before: tuple, after: tuple) -> float:
    """Cost of reading two successive records so: a format switch and a jump back in time."""
    n = min(len(before[0]), len(after[0]))
    return SWITCH_COST * (before[2] != after[2]) + BACKWARD_COST * (after[0][:n] < before[0][:n])


def transfer(cands: list[list[tuple]]) -> list[list[float]]:
    """Least cost between each reading of the first record and each of the last."""
    table = [[c[3] if i == j else float("inf") for j, c in enumerate(cands[0])] for i in range(len(cands[0]))]
    for prev, cur in zip(cands, cands[1:]):
        table = [[min(row[k] + step_cost(p, c) for k, p in enumerate(prev)) + c[3] for c in cur] for row in table]
    return table


def decode(cands: list[list[tuple]], first: int | None = None, last: int | None = None) -> list[int]:
    """Viterbi path over the records' readings, with fixed ends where given; ties go to the earlier reading."""
    cost = [c[3] if first is None or i == first else float("inf") for i, c in enumerate(cands[0])]
    back = []
    for prev, cur in zip(cands, cands[1:]):
        step = [min((cost[k] + step_cost(p, c), k) for k, p in enumerate(prev)) for c in cur]
        cost = [s[0] + c[3] for s, c in zip(step, cur)]
        back.append([s[1] for s in step])
    at = last if last is not None else min(range(len(cost)), key=lambda i: (cost[i], i))
    path = [at]
    for b in reversed(back):
        path.append(at := b[at])
    return path[::-1]


_BLOCK_SCHEMA = "source string, block long, first_cost array<double>, ids array<long>, cands string, first_cands string, last_cands string"


_BLOCK_COLUMNS = ["source", "block", "first_cost", "ids", "cands", "first_cands", "last_cands"]


def _read_blocks(batches):
    """Rows sorted by (source, block, order) -> one packed row a block."""
    key, rows = None, []

    def packed():
        if not rows:
            return []
        seen, ids, cands = set(), [], []
        for rid, c in rows:
            if rid not in seen:
                seen.add(rid)
                ids.append(rid)
                cands.append(c)
        return [(key[0], key[1], [x for r in transfer(cands) for x in r], ids, json.dumps(cands), json.dumps(cands[0]), json.dumps(cands[-1]))]

    for pdf in batches:
        out = []
        for source, block, rid, raw, tz, cur in zip(pdf.source, pdf.block, pdf.record_id, pdf.raw, pdf.tz, pdf.is_current):
            cur = None if pd.isna(cur) else bool(cur)
            found = interpretations(raw if isinstance(raw, str) else None, tz if isinstance(tz, str) else None, cur)
            if not found:
                continue
            if (source, block) != key:
                out += packed()
                key, rows = (source, block), []
            rows.append((int(rid), found))
        if out:
            yield pd.DataFrame(out, columns=_BLOCK_COLUMNS)
    if out := packed():
        yield pd.DataFrame(out, columns=_BLOCK_COLUMNS)


def _as_tuples(c: str) -> list[tuple]:
    return [tuple(x) for x in json.loads(c)]


def _summaries(pdf: pd.DataFrame) -> list[tuple[list, list, list]]:
    """(readings of the first record, of the last, cost matrix between them) of each block, in order."""
    out = []
    for t, a, b in zip(pdf.first_cost, pdf.first_cands, pdf.last_cands):
        a, b = _as_tuples(a), _as_tuples(b)
        out.append((a, b, [list(t[i * len(b): (i + 1) * len(b)]) for i in range(len(a))]))
    return out


def _multiply(pdf: pd.DataFrame) -> pd.DataFrame:
    """The blocks of a reach -> one summary of it all."""
    pdf = pdf.sort_values("block")
    blocks = _summaries(pdf)
    first, last, cost = blocks[0]
    for a, b, t in blocks[1:]:
        enter = [[min(row[j] + step_cost(p, c) for j, p in enumerate(last)) for c in a] for row in cost]
        cost = [[min(row[i] + t[i][j] for i in range(len(a))) for j in range(len(b))] for row in enter]
        last = b
    row = (pdf.source.iloc[0], pdf.reach.iloc[0], [x for r in cost for x in r], json.dumps(first), json.dumps(last))
    return pd.DataFrame([row], columns=["source", "block", "first_cost", "first_cands", "last_cands"])


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Summaries of one source or reach -> the readings each must begin and end with; the reach's own ends are fixed where given."""
    pdf = pdf.sort_values("block")
    blocks = _summaries(pdf)
    ends = [None if pd.isna(x) else int(x) for x in (pdf.begin.iloc[0], pdf.finish.iloc[0])]
    cost, back = None, []
    for k, (a, b, t) in enumerate(blocks):
        if cost is None:
            enter = [(0.0 if ends[0] in (None, i) else float("inf"), 0) for i in range(len(a))]
        else:
            enter = [min((cost[j] + step_cost(p, c), j) for j, p in enumerate(blocks[k - 1][1])) for c in a]
        best = [min((enter[i][0] + t[i][j], i) for i in range(len(a))) for j in range(len(b))]
        cost = [x[0] for x in best]
        back.append([(x[1], enter[x[1]][1]) for x in best])
    at, picks = min(range(len(cost)), key=lambda j: (cost[j], j)) if ends[1] is None else ends[1], []
    for b in reversed(back):
        first, before = b[at]
        picks.append((first, at))
        at = before
    picks = picks[::-1]
    return pd.DataFrame({"source": pdf.source.values, "block": pdf.block.values, "first_pick": [p[0] for p in picks], "last_pick": [p[1] for p in picks]})


def _decode_blocks(batches):
    for pdf in batches:
        out = []
        for ids, cands, a, b in zip(pdf.ids, pdf.cands, pdf.first_pick, pdf.last_pick):
            c = json.loads(cands)
            path = decode(c, None if pd.isna(a) else int(a), None if pd.isna(b) else int(b))
            out += [(int(i), x[p][0], x[p][1], x[p][2], len(x), p > 0) for i, x, p in zip(ids, c, path)]
        yield pd.DataFrame(out, columns=["record_id", "start_norm", "end_norm", "format", "readings", "by_path"])


def normalise_dates(df: DataFrame, record_id="entry_id", source="cv_id", order="pos", raw="dates_raw", tz="tz", is_current="is_current") -> DataFrame:
    """(record_id, start_norm, end_norm, format, readings, by_path) of each record with a readable date.

    readings: how many the value has; by_path: the source's order chose another than the one cheapest alone.

    Null or unreadable values give no row; a null zone means DEFAULT_ZONE; a null `is_current` counts as
    false; repeated rows of a record count once; a null source is a group of its own, a null order comes last.  Other
    columns are ignored.  Records count from the highest order down, as lists begin with the latest.
    """
    # Blocks follow one another in the order of the record ids' thousands, then of the positions: a source's
    # records mostly share their thousands, and a source that holds a third of all rows falls into many blocks.
    pages = F.floor(F.col(record_id).cast("long") / PAGE)
    places = F.coalesce(F.floor(F.col(order).cast("long") / BLOCK), F.lit(-1))
    rows = df.select(
        F.col(source).cast("string").alias("source"),
        pages.alias("page"),
        places.alias("place"),
        F.col(order).cast("long").alias("ord"),
        F.col(record_id).cast("long").alias("record_id"),
        F.col(raw).cast("string").alias("raw"),
        F.col(tz).cast("string").alias("tz"),
        F.col(is_current).cast("boolean").alias("is_current"),
    ).where("record_id is not null and raw is not null")
    # Record order: the highest page and position first, so they become the lowest block numbers.
    rows = rows.withColumn("block", -(F.col("page") * (1 << 20) + F.col("place"))).drop("page", "place")
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)

    def packed(part: DataFrame) -> DataFrame:
        part = part.repartition(n, "source", "block").sortWithinPartitions("source", "block", F.col("ord").desc_nulls_last(), F.col("record_id").desc())
        return part.mapInPandas(_read_blocks, _BLOCK_SCHEMA)

    # Most sources fit one block and need no chaining; only those with more blocks are grouped.
    span = df.where(F.col(record_id).isNotNull()).select(F.col(source).cast("string").alias("long_source"), (pages * (1 << 20) + places).alias("b"))
    long_sources = span.groupBy("long_source").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo < hi").select("long_source")
    long_rows = rows.join(long_sources, F.col("source") == F.col("long_source"), "left_semi")
    # Blocks of consecutive pages make a reach; first the reaches of a source are chained, then the blocks of each between its ends.
    reach = F.shiftright(F.col("block"), 20 + REACH)
    summary = packed(long_rows).select("source", "block", reach.alias("reach"), "first_cost", "first_cands", "last_cands")
    free = [F.lit(None).cast("int").alias(c) for c in ("begin", "finish")]
    pick = "source string, block long, first_pick int, last_pick int"
    reaches = summary.groupBy("source", "reach").applyInPandas(_multiply, "source string, block long, first_cost array<double>, first_cands string, last_cands string")
    ends = reaches.select("*", *free).groupBy("source").applyInPandas(_chain, pick)
    ends = ends.select(F.col("source"), F.col("block").alias("reach"), F.col("first_pick").alias("begin"), F.col("last_pick").alias("finish"))
    picks = summary.join(ends, ["source", "reach"]).groupBy("source", "reach").applyInPandas(_chain, pick)
    return packed(rows).select("source", "block", "ids", "cands").join(picks, ["source", "block"], "left").mapInPandas(
        _decode_blocks, "record_id long, start_norm string, end_norm string, format string, readings int, by_path boolean"
    )


def local_month(norm: str | None, tz: str | None) -> int | None:
    """Absolute month of a normalised date; None for 'present' and null."""
    if not isinstance(norm, str) or not norm[:4].isdigit():
        return None
    if len(norm) > 10:
        zone = _zone(tz if isinstance(tz, str) else DEFAULT_ZONE) or _zone(DEFAULT_ZONE)
        t = datetime.strptime(norm, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).astimezone(zone)
        return t.year * 12 + t.month - 1
    return int(norm[:4]) * 12 + (int(norm[5:7]) - 1 if len(norm) >= 7 else 0)


def entry_dates(entries: DataFrame) -> DataFrame:
    """The employer entries' dates: (entry_id, start_norm, end_norm)."""
    return normalise_dates(entries).select(F.col("record_id").alias("entry_id"), "start_norm", "end_norm")


def reading_decisions(entries: DataFrame) -> DataFrame:
    """(decided_by, n): how many dates had one reading, the cheapest of several alone, or another that their source's order chose."""
    by = F.when(F.col("readings") == 1, "one reading").when(F.col("by_path"), "order of the source").otherwise("cheapest alone")
    return normalise_dates(entries).groupBy(by.alias("decided_by")).agg(F.count("*").alias("n"))
