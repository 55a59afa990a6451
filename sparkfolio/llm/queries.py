"""Queries of the training-data operators, p1 to p10 as far as they belong here, and their oracle SQL."""

from __future__ import annotations

from ..session import table
from . import canonical, langid, lookalikes, mixing, packing, pii, quality


def _p1_found(spark, d):
    return pii.found_mentions(table(spark, d, "redacted_cv"), table(spark, d, "redaction"))


def _p1_redacted(spark, d):
    return pii.redact_texts(table(spark, d, "redacted_cv"), table(spark, d, "redaction"))


def _p2_found(spark, d):
    return langid.language_repairs(table(spark, d, "redacted_cv"), table(spark, d, "vision_fixtures"), table(spark, d, "documents"))


def _p2_segments(spark, d):
    return langid.segment_languages(table(spark, d, "redacted_cv"), table(spark, d, "documents"))


def _p6_found(spark, d):
    return lookalikes.matches_by_look(table(spark, d, "candidates"), table(spark, d, "redacted_cv"))


def _p7_found(spark, d):
    return canonical.found_roles(table(spark, d, "detected"), table(spark, d, "role_list"))


def _p7_matches(spark, d):
    return canonical.all_matches(table(spark, d, "detected"), table(spark, d, "role_list"))


def _p8_containers(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def _p8_report(spark, d):
    return packing.packing_report(_p8_containers(spark, d))


def _p9_selection(spark, d):
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def _p9_report(spark, d):
    return mixing.mix_report(_p9_selection(spark, d), table(spark, d, "mix_targets"))


def _p10_found(spark, d):
    return quality.not_prose(table(spark, d, "documents"))


def _p10_statistics(spark, d):
    return quality.document_classes(table(spark, d, "documents"))


def _p10_measures(spark, d):
    return quality.measures(table(spark, d, "documents"))


def queries():
    return {
        "p1_found": _p1_found, "p1_redacted": _p1_redacted, "p2_found": _p2_found, "p2_segments": _p2_segments, "p6_found": _p6_found, "p7_found": _p7_found, "p7_matches": _p7_matches,
        "p8_containers": _p8_containers, "p8_report": _p8_report, "p9_selection": _p9_selection, "p9_report": _p9_report, "p10_found": _p10_found, "p10_statistics": _p10_statistics, "p10_measures": _p10_measures,
    }


# What looks the same, as far as the test tables go, in DuckDB's own functions: invisible characters off, blanks,
# full-width forms, look-alike letters and dashes mapped, ligatures spelled out, the rest composed.
_FULL = ("".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94)))
_ALIKE = ("аеорсухіјѕԁһАВЕКМНОРСТХІЈЅУνοραϲΑΒΕΖΗΙΚΜΝΟΡΤΥΧ‐‑⁃−‒ʼ‛", "aeopcyxijsdhABEKMHOPCTXIJSYvopαcABEZHIKMNOPTYX-----''''")
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def _look_sql(c: str) -> str:
    out = f"regexp_replace({c}, '[\\x{{ad}}\\x{{34f}}\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{2064}}\\x{{fe00}}-\\x{{fe0f}}\\x{{feff}}]', '', 'g')"
    out = f"regexp_replace({out}, '[\\s\\x0b\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', ' ', 'g')"
    for k, v in _LIGATURES.items():
        out = f"replace({out}, '{k}', '{v}')"
    quote = lambda s: s.replace("'", "''")
    return f"nfc_normalize(translate({out}, '{quote(_FULL[0] + _ALIKE[0])}', '{quote(_FULL[1] + _ALIKE[1])}'))"


_ODD = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WORDS = f"list_filter(regexp_split_to_array(t, '{_ODD}+'), lambda x: x <> '')"
_COMMON = ",".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(quality.COMMON_WORDS.split()))
_TAKEN = lambda rx: f"(length(t) - length(regexp_replace(t, '{rx}', '', 'g')))"


_MARKS = "[.,;:!?''’\"()-]+"
_ENDS = "[.!?:…][''\"”)]?\\s*$"
_NO_WORD = "[^\\p{L}\\p{N}''’]+"


def oracle_sql():
    return {
        "p6_found": f"""WITH q AS (SELECT DISTINCT candidate_id, cv_id, anchor_quote FROM candidates WHERE candidate_id IS NOT NULL AND cv_id IS NOT NULL AND anchor_quote <> ''), j AS (SELECT candidate_id, anchor_quote, text, {_look_sql('anchor_quote')} AS qn, {_look_sql('text')} AS tn FROM q JOIN redacted_cv USING (cv_id))
SELECT DISTINCT candidate_id FROM j WHERE NOT contains(text, anchor_quote) AND contains(tn, qn) AND trim(qn, ' ') <> ''""",
        "p10_measures": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, t, len({_WORDS}) AS n, length(regexp_replace(t, '{_ODD}+', '', 'g')) AS solid, list_filter(string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(x, '{_ODD}+', '', 'g') <> '') AS lines,
{_TAKEN('[\\p{L}]+')} + {_TAKEN('[\\p{Nd}]+')} + {_TAKEN(_MARKS)} AS plain, len(list_filter(string_split(lower(regexp_replace(t, '{_NO_WORD}', ' ', 'g')), ' '), lambda w: w IN ({_COMMON}))) AS common FROM d)
SELECT doc_id, CAST(n AS INT) AS n_words, CASE WHEN n > 0 THEN round(solid / n, 6) ELSE 0.0 END AS mean_word_len, CASE WHEN solid > 0 THEN round(greatest(solid - plain, 0) / solid, 6) ELSE 0.0 END AS symbol_ratio,
CASE WHEN len(lines) > 0 THEN round(len(list_filter(lines, lambda x: regexp_matches(x, '{_ENDS}'))) / len(lines), 6) ELSE 0.0 END AS punct_end_share, CASE WHEN n > 0 THEN round(common / n, 6) ELSE 0.0 END AS common_share FROM m""",
    }
