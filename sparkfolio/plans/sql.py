"""Pieces of DuckDB SQL for text and sections; they take nothing from the operators."""

from __future__ import annotations

from .rules import ALL_CAPS, COMPANY_ENDS, NOT_EMPLOYERS, SECTION_NAMES, WORK_FAMILIES

#: A blank of any kind.
BLANK = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_FAMILY_OF = {name: line.split("|")[0] for line in SECTION_NAMES for name in line.split("|")}


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def squeeze_sql(c: str) -> str:
    return strip_sql(f"regexp_replace({c}, '{BLANK}+', ' ', 'g')")


def fold_sql(c: str) -> str:
    return f"lower(strip_accents({c}))"


def compose_sql(c: str) -> str:
    return f"nfc_normalize({c})"


def words_sql(c: str) -> str:
    """Number of words."""
    return f"len(list_filter(regexp_split_to_array({c}, '{BLANK}+'), lambda w: w <> ''))"


def tokens_sql(c: str) -> str:
    return f"regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}]+')"


def lines_sql(tab: str, key: str, text: str) -> str:
    return f"SELECT {key}, CAST(unnest(range(0, len(x))) AS INT) AS pos, unnest(x) AS line FROM (SELECT {key}, string_split(replace({text}, chr(13) || chr(10), chr(10)), chr(10)) AS x FROM {tab} WHERE {text} IS NOT NULL)"


_NAMES = ",".join(f"'{n}'" for n in _FAMILY_OF)
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in _FAMILY_OF.items()) + "}"


def FAMILIES(key: str) -> str:  # noqa: N802
    return f"coalesce({_MAP}[{key}], {key})"


def header_sql(c: str) -> str:
    name = strip_sql(f"regexp_replace({strip_sql(c)}, ':$', '')")
    return f"(NOT starts_with({c}, '##') AND (regexp_matches({name}, '{ALL_CAPS}') OR (length({name}) <= 40 AND {squeeze_sql(fold_sql(name))} IN ({_NAMES}))))"


def family_sql(c: str) -> str:
    """Family of a header line."""
    bare = strip_sql(f"regexp_replace({strip_sql(f"regexp_replace({strip_sql(c)}, '^#{{1,6}} +', '')")}, ':$', '')")
    return FAMILIES(squeeze_sql(fold_sql(bare)))


def quoted(values) -> str:
    return ",".join("'" + v.replace("'", "''") + "'" for v in values)


def employer_sql(raw: str, name: str) -> str:
    """Whether a header may name an employer."""
    key = f"regexp_replace({name}, ':$', '')"
    tokens = f"regexp_extract_all({raw}, '[0-9A-Za-zÀ-ž][0-9A-Za-zÀ-ž.&+-]*')"
    loud = f"len(list_filter({tokens}, lambda t: t = upper(t) AND t <> lower(t) AND length(trim(t, '.&+-')) >= 2)) > 0"
    capital = f"len(list_filter({tokens}, lambda t: t[1] = lower(t[1]) OR t[1] <> upper(t[1]))) = 0"
    company = " OR ".join(f"contains(' ' || {key}, '{c}')" for c in COMPANY_ENDS)
    return f"({key} NOT IN ({quoted(NOT_EMPLOYERS)}) AND (({company}) OR (len({tokens}) BETWEEN 1 AND 5 AND ({loud} OR {capital}))))"


def annotated_sql(tab: str, key: str, text: str) -> str:
    return f"""SELECT {key}, string_agg(CASE WHEN header AND (above IS NULL OR above <> mark) THEN mark || chr(10) || line ELSE line END, chr(10) ORDER BY pos) AS annotated
FROM (SELECT *, {header_sql('line')} AS header, '## ' || {strip_sql('line')} AS mark, lag(line) OVER (PARTITION BY {key} ORDER BY pos) AS above FROM ({lines_sql(tab, key, text)})) GROUP BY {key}"""


def slices_sql(tab: str, key: str, text: str) -> str:
    """CTEs up to sl(key, section, body): the first section of each key, over its child headers."""
    known = f"name IN ({_NAMES})"
    work = quoted(WORK_FAMILIES)
    return f"""ann AS ({annotated_sql(tab, key, text)}), al AS ({lines_sql('ann', key, 'annotated')}),
h0 AS (SELECT {key}, pos, length(regexp_extract(line, '^(#{{1,6}})', 1)) AS level, regexp_extract(line, '^#{{1,6}}\\s+(.+)$', 1) AS raw FROM al WHERE regexp_matches(line, '^#{{1,6}}\\s+\\S')),
h1 AS (SELECT *, {squeeze_sql(fold_sql('raw'))} AS name FROM h0), h2 AS (SELECT *, {FAMILIES('name')} AS section, {known} AS known, {employer_sql('raw', 'name')} AS employer FROM h1),
h3 AS (SELECT a.{key}, a.pos, a.section, min(b.pos) AS stop FROM h2 a LEFT JOIN h2 b ON a.{key} = b.{key} AND b.pos > a.pos AND (NOT a.known OR b.known OR NOT (b.level > a.level OR (a.section IN ({work}) AND b.employer))) GROUP BY ALL),
h4 AS (SELECT * FROM h3 QUALIFY row_number() OVER (PARTITION BY {key}, section ORDER BY pos) = 1),
sl AS (SELECT h4.{key}, h4.section, coalesce(string_agg(al.line, chr(10) ORDER BY al.pos), '') AS body FROM h4 LEFT JOIN al ON al.{key} = h4.{key} AND al.pos > h4.pos AND (h4.stop IS NULL OR al.pos < h4.stop) GROUP BY ALL)"""


def heading_sql(c: str) -> str:
    h = lambda x: strip_sql(x)
    return h(f"regexp_replace({h(f"regexp_replace({h(fold_sql(c))}, '^#+', '')")}, ':+$', '')")


def work_sql(tab: str, key: str, text: str, work: str, other: str) -> str:
    """CTEs up to wk(key, pos, line): the lines of the work section, counted from 0."""
    return f"""wl AS (SELECT *, {heading_sql('line')} AS h FROM ({lines_sql(tab, key, text)})), ws AS (SELECT {key}, min(pos) AS s FROM wl WHERE h IN ({work}) GROUP BY {key}),
we AS (SELECT ws.{key}, s, min(pos) AS e FROM ws LEFT JOIN wl ON wl.{key} = ws.{key} AND pos > s AND h IN ({other}) GROUP BY ALL),
wk AS (SELECT wl.{key}, CAST(pos - s - 1 AS INT) AS pos, line, h FROM wl JOIN we USING ({key}) WHERE pos > s AND (e IS NULL OR pos < e))"""
