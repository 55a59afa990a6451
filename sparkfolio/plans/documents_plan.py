"""Queries over CVs, documents and claims: redaction, sections, verification, profile; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import compose, content_tokens, fold, jaccard, normalised
from ..operators import actions, evidence, profile, redaction, sections, tenure, verify
from ..session import spread, table
from . import rules
from .sql import BLANK, FAMILIES, annotated_sql, compose_sql, family_sql, fold_sql, header_sql, lines_sql, quoted, slices_sql, squeeze_sql, strip_sql, tokens_sql, words_sql, work_sql

EMAIL_SQL, URL_SQL = rules.EMAIL, rules.URL
BASELINE = [
    "I prefer short feedback loops and I write things down before I build them",
    "Took an evening course in Docker and passed the final exam with distinction",
    "Colleagues would describe me as calm, curious and rather stubborn about data quality",
    "Nejraději převádím nejasné zadání na řešení, které vydrží déle než jeden rok",
]


def _cvs(spark, d):
    return spread(table(spark, d, "redacted_cv").select("cv_id", "text"))


def _redact_email(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_replace("text", redaction.EMAIL, "[EMAIL]").alias("redacted"))


def _redact_url(spark, d):
    return table(spark, d, "redacted_cv").select("cv_id", F.regexp_replace("text", redaction.URL, "[URL]").alias("redacted"))


def _redaction_counts(spark, d):
    t = F.col("text")
    n = lambda p: F.coalesce(F.size(F.regexp_extract_all(t, F.lit(f"({p})"), F.lit(1))), F.lit(0))
    return table(spark, d, "redacted_cv").select("cv_id", n(redaction.URL).alias("n_url"), n(redaction.EMAIL).alias("n_email"), n(r"\[[A-Z]+\]").alias("n_markers"))


def _redact_all(spark, d):
    return redaction.redact(_cvs(spark, d), "cv_id", "text")


def _redaction_audit(spark, d):
    return redaction.audit_all(_cvs(spark, d), "cv_id", "text")


def _header_lines(spark, d):
    return sections.headers(_cvs(spark, d), "cv_id", "text")


def _annotated(spark, d):
    return sections.annotate(_cvs(spark, d), "cv_id", "text")


def _section_sizes(spark, d):
    return sections.section_sizes(_cvs(spark, d), "cv_id", "text")


def _section_slices(spark, d):
    return sections.section_slices(_cvs(spark, d), "cv_id", "text")


def _anchorable(spark, d):
    return sections.anchorable(_cvs(spark, d), "cv_id", "text")


def _order_ok(spark, d):
    return table(spark, d, "redacted_cv").select("cv_id", sections.order_ok(F.col("text")).alias("order_ok"))


def _token_overlap(spark, d):
    c = table(spark, d, "candidates").select("candidate_id", "cv_id", "anchor_quote").distinct()
    t = table(spark, d, "redacted_cv").select("cv_id", "text")
    return c.where("anchor_quote is not null").join(t, "cv_id").select("candidate_id", F.round(sections.token_overlap(F.col("anchor_quote"), F.col("text")), 6).alias("overlap"))


def _tenure(spark, d):
    return tenure.tenure_years(_cvs(spark, d), "cv_id", "text")


def _date_ranges(spark, d):
    return tenure.ranges(table(spark, d, "employer_entries").select("entry_id", "dates_raw").distinct(), "entry_id", "dates_raw")


def _timeline(spark, d):
    return tenure.timeline(_cvs(spark, d), "cv_id", "text")


def _verified(spark, d, by_section=False):
    return verify.gate(verify.verify_quotes(table(spark, d, "candidates"), table(spark, d, "redacted_cv"), by_section))


def _verify_quotes(spark, d):
    return _verified(spark, d).select("candidate_id", "quote_found")


def _verify_in_section(spark, d):
    return _verified(spark, d, True).select("candidate_id", "quote_found", "section_missed")


def _claim_overlap(spark, d):
    c = table(spark, d, "candidates").select("candidate_id", "text", "anchor_quote").distinct()
    return c.select("candidate_id", F.round(jaccard(content_tokens(F.col("text")), content_tokens(F.col("anchor_quote"))), 6).alias("overlap"))


def _gate_counts(spark, d):
    return verify.gate_counts(_verified(spark, d))


def _verdicts(spark, d):
    """Stand-ins for a judge's verdicts: three a CV with suspects to come, one of them missing where a CV has no country."""
    v = table(spark, d, "detected").select("cv_id", "detected_country", "detected_years").distinct()
    each = v.select("cv_id", F.explode(F.array(*[F.struct(F.lit(i).alias("o"), (F.pmod(F.coalesce("detected_years", F.lit(0)) + i, F.lit(2)) == 0).alias("verdict"), F.col("detected_country").alias("c")) for i in range(3)])).alias("x"))
    return each.where("x.o < 2 or x.c is not null").select("cv_id", F.col("x.o").alias("suspect_ord"), "x.verdict")


def _adjudicated(spark, d):
    return verify.drop_counts(verify.adjudicate(_verified(spark, d), _verdicts(spark, d)))


def _component_counts(spark, d):
    return verify.component_counts(_verified(spark, d, True))


def _score_gates(spark, d):
    v = _verified(spark, d, True)
    return evidence.score_gates(verify.component_counts(v), v.where("quote_found").select("cv_id", F.col("field").alias("name")))


def _quote_places(spark, d):
    c = table(spark, d, "candidates").select("candidate_id", "cv_id", "anchor_quote").distinct().where("anchor_quote is not null")
    j = c.join(table(spark, d, "redacted_cv").select("cv_id", "text"), "cv_id")
    span = verify.quote_span(F.col("anchor_quote"), F.col("text"))
    return j.select("candidate_id", span["start"].alias("span_start"), span["end"].alias("span_end"), verify.source_index(F.col("anchor_quote"), F.col("text")).alias("at"))


def _header_repair(spark, d):
    return _cvs(spark, d).select("cv_id", sections.repair_headers(F.translate("text", "\n", " ")).alias("repaired"))


def _candidate_validation(spark, d):
    """Each CV's text with its lines in reverse as the candidate for the text itself, and the reasons against it."""
    t = _cvs(spark, d).select("cv_id", "text", F.array_join(F.reverse(F.split("text", "\n")), "\n").alias("turned"))
    return t.select("cv_id", sections.rejected(F.col("turned"), F.col("text")).alias("docx_reason"), sections.rejected(F.col("text")).alias("pdf_reason"))


def _transcript_choice(spark, d):
    f = table(spark, d, "vision_fixtures").select("fixture_id", "cv_id", "layout", "n_pages").distinct().join(table(spark, d, "redacted_cv").select("cv_id", "text"), "cv_id")
    mode = F.when(F.col("layout") == "two columns", "vision").when(F.col("layout") == "single column", "llm").otherwise("text")
    choice = sections.choose_text(F.col("text"), sections.strip_fences(F.concat(F.lit("<think>x</think>```text\n"), F.substring("text", 1, 400), F.lit("\n```"))), mode, F.col("n_pages") <= 2)
    return f.select("fixture_id", choice["notice"].alias("notice"), F.length(choice["text"]).alias("n"))


def _evidence_gate(spark, d):
    g = _verified(spark, d).where("verdict = 'kept'")
    return profile.evidence_gate(profile.evidence_score(g), table(spark, d, "redacted_cv"))


def _override_years(spark, d):
    j = table(spark, d, "detected").select("cv_id", "detected_years").distinct().join(table(spark, d, "redacted_cv").select("cv_id", "years_experience_deterministic"), "cv_id")
    o = profile.override_years(F.col("detected_years"), F.col("years_experience_deterministic"))
    return j.select("cv_id", o["years"].alias("years"), o["changed"].alias("changed"))


def _title_order(spark, d):
    t = profile.titles_in_order(table(spark, d, "candidates"), table(spark, d, "redacted_cv"))
    return t.select("cv_id", F.posexplode("titles").alias("pos", "title"))


def normalised_profiles(spark, d, verdicts=None):
    """The role of every detected profile, over its experience titles in text order and its years."""
    rows = table(spark, d, "detected").select("cv_id", "detected_role", "detected_years").distinct().join(table(spark, d, "redacted_cv").select("cv_id", "years_experience_deterministic"), "cv_id", "left")
    titles = profile.titles_in_order(table(spark, d, "candidates"), table(spark, d, "redacted_cv"))
    years = profile.override_years(F.col("detected_years"), F.col("years_experience_deterministic"))["years"]
    return profile.normalise_roles(rows.join(titles, "cv_id", "left").select("cv_id", "detected_role", years.alias("years"), "titles"), verdicts)


def _role_normalise(spark, d):
    return normalised_profiles(spark, d)


def _role_verdicts(spark, d):
    """With stand-ins for verdicts on roles that the rules don't know: the listed title's own band, sure where the CV has a place."""
    v = table(spark, d, "detected").select("cv_id", F.concat(F.lit(" Listed "), F.coalesce("detected_country", F.lit("?"))).alias("canonical_role"), F.lit("junior").alias("band"), F.lit(False).alias("management"), F.when(F.col("detected_location").isNotNull(), 0.6).otherwise(0.5).alias("confidence")).distinct()
    return normalised_profiles(spark, d, v)


def _title_prefixes(spark, d):
    t = table(spark, d, "candidates").where("text is not null").select("text").distinct()
    return t.select("text", F.array_join(profile.title_prefixes(F.col("text")), "|").alias("prefixes"), profile.has_management_word(F.col("text")).alias("manages"))


def _employer_hints(spark, d):
    t = table(spark, d, "redacted_cv").select("cv_id", "text")
    x = table(spark, d, "candidates").where("field = 'experience' and anchor_quote is not null").select("cv_id", "candidate_id", F.col("text").alias("claim"), "anchor_quote").distinct().drop("candidate_id")
    h = actions.employer_hints(tenure.timeline(t, "cv_id", "text"), x, t)
    return h.select("cv_id", F.array_join("current", "|").alias("current"), F.array_join("closed", "|").alias("closed"), "source")


def _filtered_actions(spark, d):
    """Claims as actions: their field gives the setting, the employer entry at their place the target."""
    v = _verified(spark, d, True)
    e = table(spark, d, "employer_entries").select("cv_id", "pos", "employer_header", "is_current").distinct()
    target = e.groupBy("cv_id", "pos").agg(F.max("employer_header").alias("target_employer")).withColumnRenamed("pos", "ord")
    setting = F.when(F.col("field") == "experience", "current_employer").when(F.col("field") == "education", "future_role").otherwise("capability_artifact")
    a = v.join(target, ["cv_id", "ord"], "left").select("candidate_id", "cv_id", F.col("claim").alias("what"), F.col("anchor_section").alias("mechanism"), setting.alias("setting"), "target_employer", "quote_found", "anchor_quote")
    put = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("employer_header"))))
    hints = e.groupBy("cv_id").agg(put(F.col("is_current")).alias("current"), put(~F.col("is_current")).alias("closed"))
    return actions.filter_actions(a, hints)


def _action_filter(spark, d):
    return _filtered_actions(spark, d).select("candidate_id", "target_employer", "reason", "detail")


def _redaction_kinds(spark, d):
    t = _cvs(spark, d)
    return redaction.kind_counts(redaction.audit_all(t, "cv_id", "text"), t)


def _first_verified(spark, d):
    return verify.first_verified(_verified(spark, d)).select("cv_id", "field", "candidate_id")


def _skill_labels(spark, d):
    low = _cvs(spark, d).select("cv_id", F.lower(compose(F.col("text"))).alias("t"))
    join = lambda groups: F.array_join(profile.labels(F.col("t"), groups), ",")
    return low.select("cv_id", join(profile.SKILLS).alias("skills"), join(profile.SOFT_SIGNALS).alias("soft_signals"))


def _salvage(spark, d):
    """For CVs whose kept claims lack skills or soft signals."""
    return profile.salvage(_cvs(spark, d), "cv_id", "text", _verified(spark, d).where("verdict = 'kept'").select("cv_id", "field", "anchor_quote"))


def _evidence_score(spark, d):
    return profile.evidence_score(table(spark, d, "candidates"))


def _title_shapes(spark, d):
    t = table(spark, d, "candidates").where("text is not null").select("text").distinct()
    return t.select("text", profile.title_shaped(F.col("text")).alias("shaped"), profile.classify(F.col("text"))["band"].alias("band"))


def _action_reasons(spark, d):
    c = table(spark, d, "documents").where("text is not null")
    return c.select("doc_id", actions.drop_reason(F.col("text"), F.col("uploader")).alias("reason"))


def _action_pool(spark, d):
    return actions.pool(table(spark, d, "candidates").select("cv_id", "attempt", "ord", "candidate_id", "text").distinct(), "cv_id", "text", ["attempt", "ord", "candidate_id"], attempt="attempt")


def _boilerplate(spark, d):
    c = spread(table(spark, d, "candidates").where("anchor_quote is not null").select("candidate_id", "anchor_quote")).distinct()
    return actions.boilerplate(c, "candidate_id", "anchor_quote", BASELINE)


def _normalised_quotes(spark, d):
    c = table(spark, d, "candidates").where("anchor_quote is not null").select("candidate_id", "anchor_quote").distinct()
    return c.select("candidate_id", normalised(F.col("anchor_quote")).alias("form"), fold(F.col("anchor_quote")).alias("folded"))


def _education_level(spark, d):
    return evidence.education_level(sections.section_slices(_cvs(spark, d), "cv_id", "text"), "cv_id")


QUERIES = {
    "redact_email": _redact_email, "redact_url": _redact_url, "redaction_counts": _redaction_counts, "redact_all": _redact_all, "redaction_audit": _redaction_audit, "redaction_kinds": _redaction_kinds,
    "header_lines": _header_lines, "annotated_text": _annotated, "section_sizes": _section_sizes, "section_slices": _section_slices, "anchorable_lines": _anchorable,
    "header_repair": _header_repair, "candidate_validation": _candidate_validation, "transcript_choice": _transcript_choice,
    "section_order": _order_ok, "token_overlap": _token_overlap, "date_ranges": _date_ranges, "tenure_years": _tenure, "employer_timeline": _timeline,
    "normalised_quotes": _normalised_quotes, "verify_quotes": _verify_quotes, "verify_in_section": _verify_in_section, "claim_overlap": _claim_overlap, "gate_counts": _gate_counts,
    "adjudicated_counts": _adjudicated, "component_counts": _component_counts, "score_gates": _score_gates, "quote_places": _quote_places, "first_verified": _first_verified,
    "skill_labels": _skill_labels, "salvage_quotes": _salvage, "evidence_score": _evidence_score, "evidence_gate": _evidence_gate, "override_years": _override_years, "title_order": _title_order,
    "role_normalise": _role_normalise, "role_verdicts": _role_verdicts, "title_shapes": _title_shapes, "title_prefixes": _title_prefixes, "employer_hints": _employer_hints,
    "action_reasons": _action_reasons, "action_filter": _action_filter, "action_pool": _action_pool, "boilerplate_quotes": _boilerplate, "education_level": _education_level,
}

_STOP = "[" + ",".join(f"'{w}'" for w in rules.STOPWORDS) + "]"
_LINES = lines_sql("redacted_cv", "cv_id", "text")
_SECTIONED = f"""
l AS ({_LINES}), h AS (SELECT *, ({header_sql('line')} OR regexp_matches(line, '^#{{1,6}} +[^\\s]')) AS header FROM l),
s AS (SELECT *, last_value(CASE WHEN header THEN {family_sql('line')} END IGNORE NULLS) OVER (PARTITION BY cv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM h)"""
_SLICES = slices_sql("redacted_cv", "cv_id", "text")
_BARE = strip_sql("regexp_replace(" + strip_sql("regexp_replace(" + strip_sql("line") + f", '{rules.BULLET}', '')") + r", '\.$', '')")
_ANCHORABLE = f"{_SECTIONED}, qa AS (SELECT cv_id, pos, section, {_BARE} AS quote FROM s WHERE NOT header), an AS (SELECT * FROM qa WHERE {words_sql('quote')} >= 6)"
_NORM = lambda c: squeeze_sql(f"lower({compose_sql(c)})")
_FOUND = lambda q, t: f"""coalesce(CASE WHEN {words_sql(q)} >= 8 THEN (length({t}) - length(replace({t}, {q}, ''))) // length({q}) >= 1 WHEN {words_sql(q)} >= 6 THEN (length({t}) - length(replace({t}, {q}, ''))) // length({q}) = 1 ELSE false END, false)"""
_CLAIMS = "SELECT DISTINCT candidate_id, cv_id, attempt, field, ord, text, anchor_quote, anchor_section FROM candidates"
_JACCARD = lambda a, b: f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"
_CONTENT = lambda c: f"list_filter(list_distinct({tokens_sql(fold_sql(c))}), lambda x: NOT list_contains({_STOP}, x))"
_GATED = f"""c AS ({_CLAIMS}), q AS (SELECT c.*, {_NORM('c.anchor_quote')} AS qn, {_NORM('r.text')} AS tn, {_CONTENT('c.text')} AS a, {_CONTENT('c.anchor_quote')} AS b FROM c LEFT JOIN redacted_cv r USING (cv_id)),
v AS (SELECT *, {_FOUND('qn', 'tn')} AS quote_found, {_JACCARD('a', 'b')} AS overlap FROM q),
g AS (SELECT *, CASE WHEN NOT quote_found THEN 'missing_quote' WHEN overlap IS NULL OR overlap >= 0.1 THEN 'kept' ELSE 'suspect' END AS verdict FROM v)"""
_WORDB = lambda w: f"(^|[^a-z0-9_]){w}([^a-z0-9_]|$)"


def _case(pairs, col):
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{_WORDB(w)}') THEN {v}" for w, v in pairs)


_TOKENS = sorted(rules.SENIORITY, key=lambda x: -len(x[0]))
_NOUN = "(" + "|".join(rules.ROLE_NOUNS) + ")"
_BAND = lambda c: _case([(w, f"'{b}'") for w, b, _ in _TOKENS] + [(_NOUN, "'mid'")], c) + " END"
_MGMT = lambda c: _case([(w, str(m).lower()) for w, _, m in _TOKENS] + [(_NOUN, "false")], c) + " END"
_DENIED = ",".join(f"'{x}'" for x in rules.DENIED)
_SQ = squeeze_sql
_SHAPED = lambda c: f"({_SQ(c)} <> '' AND length({_SQ(c)}) <= 90 AND {fold_sql(_SQ(c))} NOT IN ({_DENIED}) AND NOT regexp_matches({c}, '[.,;:!?]') AND len(regexp_extract_all({_SQ(c)}, '[0-9A-Za-zÀ-ž&]+')) <= 8 AND {_BAND(fold_sql(c))} IS NOT NULL)"
_RANK = lambda b: f"coalesce(list_position(['junior','mid','senior','staff','head','director'], {b}), 0)"


def _needle(words):
    return "(?:^|[^\\p{L}\\p{N}_])(?:" + "|".join(w.replace("*", "[\\p{L}\\p{N}_]*") for w in words.split("|")) + ")(?:[^\\p{L}\\p{N}_]|$)"


def _labels(groups):
    return f"array_to_string({_label_list(groups)}, ',')"


def _label_list(groups):
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{_needle(w)}') THEN '{k}' END" for k, w in groups) + "], lambda x: x IS NOT NULL)"


_PUNCT = "[!-/:-@\\[-`{-~]"
_BANNED = lambda c: "CASE " + " ".join(f"WHEN {f'regexp_matches({c}, {chr(39)}(^|[^\\p{{L}}\\p{{N}}_])phd{chr(39)})' if p == 'phd' else f'contains({c}, {chr(39)}{p}{chr(39)})'} THEN '{p}'" for p in rules.BANNED) + " END"
_MONTH_NUMBER = {w: i for i, ws in enumerate(rules.MONTHS, 1) for w in ws.split()}
_LONGEST = lambda ws: "|".join(sorted(ws, key=lambda w: (-len(w), w)))
_EP = rf"(?:(?:{_LONGEST(_MONTH_NUMBER)}){BLANK}+(?:19|20)[0-9][0-9]|(?:19|20)[0-9][0-9]|(?:{_LONGEST(rules.PRESENT)}))"
_RANGE = rf"\b({_EP}){BLANK}*[-–—]{BLANK}*({_EP})\b"
_MONTHMAP = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in _MONTH_NUMBER.items()) + "}"
_NOW = quoted(rules.PRESENT)
_MONTH = lambda e: f"CASE WHEN {e} IN ({_NOW}) THEN 24316 ELSE try_cast(regexp_extract({e}, '((?:19|20)[0-9]{{2}})', 1) AS INT) * 12 + coalesce(try_cast({_MONTHMAP}[regexp_extract({e}, '^([a-z]+)', 1)] AS INT), 1) - 1 END"
_RANGES = lambda tab, key, col: f"""f AS (SELECT {key}, {fold_sql(col)} AS t FROM {tab} WHERE {col} IS NOT NULL),
p AS (SELECT {key}, unnest(regexp_extract_all(t, '{_RANGE}', 1)) AS a, unnest(regexp_extract_all(t, '{_RANGE}', 2)) AS b FROM f),
m AS (SELECT {key}, {_MONTH('a')} AS s, {_MONTH('b')} AS e FROM p),
r AS (SELECT {key}, CAST(s AS INT) AS "start", CAST(least(e, 24316) + 1 AS INT) AS "end" FROM m WHERE s <= e AND s <= least(e, 24316))"""  # noqa: E731
_WORK = work_sql("redacted_cv", "cv_id", "text", quoted(rules.WORK_HEADINGS), quoted(rules.OTHER_HEADINGS))
_YEARISH = r"\[YEAR\]|\b(?:19|20)[0-9][0-9]\b"
_DATED = f"(length(line) <= 80 AND regexp_matches(line, '[-–—]') AND regexp_matches(line, '{_YEARISH}'))"
_N_YEARS = lambda x: f"len(regexp_extract_all({x}, '{_YEARISH}'))"
_X, _Y = "rest[:p - 1]", "rest[p + 1:]"
_OPENS = f"(length(replace({_X}, '(', '')) = length(replace({_X}, ')', '')) AND regexp_matches({_X}, '(^|[,;])\\s*(?:\\[YEAR\\]|(?:19|20)[0-9][0-9])\\s*$'))"
_DASHES = f"list_filter(range(1, length(rest) + 1), lambda p: rest[p] IN ('-', '–', '—') AND regexp_matches({_X}, '(?:\\[YEAR\\]|\\b(?:19|20)[0-9][0-9])\\s*$') AND ({_N_YEARS(_X)} = 1 OR {_OPENS}) AND ({strip_sql(_Y)} = '' OR {_N_YEARS(_Y)} > 0))"
_TIMELINE = f"""{_WORK}, td AS (SELECT *, {_DATED} AS dated, ({strip_sql('line')} = '' OR {_DATED} OR h IN ({quoted(rules.WORK_HEADINGS + rules.OTHER_HEADINGS)})) AS stop, {strip_sql(f"regexp_replace({strip_sql('line')}, '^(?:[-*•–—]{BLANK}*)+', '')")} AS clean FROM wk),
tg AS (SELECT *, lag(stop, 1) OVER w AS s1, lag(stop, 2) OVER w AS s2, lag(stop, 3) OVER w AS s3, lag(clean, 1) OVER w AS c1, lag(clean, 2) OVER w AS c2, lag(clean, 3) OVER w AS c3 FROM td WINDOW w AS (PARTITION BY cv_id ORDER BY pos)),
tr AS (SELECT cv_id, pos, line, array_to_string(list_filter([CASE WHEN NOT s1 AND NOT s2 AND NOT s3 THEN c3 END, CASE WHEN NOT s1 AND NOT s2 THEN c2 END, CASE WHEN NOT s1 THEN c1 END], lambda x: x <> ''), ' — ') AS header, regexp_extract(line, '^[^—–-]*[—–-](.*)$', 1) AS rest FROM tg WHERE dated),
te AS (SELECT *, coalesce(rest[list_last({_DASHES}) + 1:], rest) AS ending FROM tr),
tl AS (SELECT cv_id, pos, header, {strip_sql('line')} AS dates_raw, (regexp_matches({fold_sql('rest')}, '\\b(?:{"|".join(rules.PRESENT)})\\b') OR {strip_sql('ending')} = '' OR coalesce(try_cast(regexp_extract(ending, '({_YEARISH})', 1) AS INT) >= 2026, false)) AS is_current FROM te)"""
_SHINGLES = lambda w: f"CASE WHEN len({w}) >= 4 THEN list_distinct(list_transform(range(1, len({w}) - 2), lambda i: array_to_string({w}[i:i+3], ' '))) ELSE [] END"
_PLAIN = lambda c: f"list_filter(regexp_split_to_array(regexp_replace(lower({compose_sql(c)}), '{_PUNCT}', '', 'g'), '{BLANK}+'), lambda x: x <> '')"
_ED = lambda p: p.replace("'", "''")


def _education():
    return f"""WITH {_SLICES} SELECT cv_id, CAST(max(CASE WHEN regexp_matches(body, '{_ED(rules.DOCTORATE)}') THEN 86 WHEN regexp_matches(body, '{_ED(rules.MASTERS)}') THEN 66 END) AS INT) AS floor FROM sl WHERE section = 'education' GROUP BY cv_id"""


_IN_SECTION = f"""{_SLICES}, c AS ({_CLAIMS}), j AS (SELECT c.*, {_NORM('c.anchor_quote')} AS qn, sl.body AS body, {_NORM('coalesce(sl.body, r.text)')} AS tn
FROM c LEFT JOIN redacted_cv r USING (cv_id) LEFT JOIN sl ON sl.cv_id = c.cv_id AND sl.section = {FAMILIES(squeeze_sql(fold_sql('c.anchor_section')))}),
vs AS (SELECT *, {_FOUND('qn', 'tn')} AS quote_found, (anchor_section IS NOT NULL AND body IS NULL) AS section_missed FROM j)"""
_COMPONENTS = f"""{_IN_SECTION}, cd AS (SELECT *, coalesce(max(CAST(quote_found AS INT)) OVER (PARTITION BY cv_id, attempt, field ORDER BY ord, candidate_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS done FROM vs),
cc AS (SELECT cv_id, attempt, count(*) AS returned, count(*) FILTER (NOT done AND quote_found) AS verified, count(*) - count(*) FILTER (NOT done AND quote_found) AS dropped, count(*) FILTER (NOT done AND section_missed) AS section_misses FROM cd GROUP BY ALL)"""
_JUDGED = f"""{_GATED}, sp AS (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY field, ord, candidate_id) - 1 AS o FROM g WHERE verdict = 'suspect'),
ve AS (SELECT cv_id, i AS o, (coalesce(detected_years, 0) + i) % 2 = 0 AS verdict FROM (SELECT DISTINCT cv_id, detected_country, detected_years FROM detected), (SELECT unnest(range(3)) AS i) WHERE i < 2 OR detected_country IS NOT NULL),
wn AS (SELECT cv_id, count(*) AS n FROM sp GROUP BY cv_id), wh AS (SELECT wn.cv_id FROM wn JOIN ve USING (cv_id) GROUP BY wn.cv_id, n HAVING count(*) = n AND count(DISTINCT o) = n AND min(o) = 0 AND max(o) = n - 1),
dr AS (SELECT sp.candidate_id FROM sp JOIN ve USING (cv_id, o) JOIN wh USING (cv_id) WHERE NOT ve.verdict)"""
_TRIMMED = lambda x: squeeze_sql(f"regexp_replace(regexp_replace({x}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])[0-9]+\\s+(?:years?|months?|tenure|let|měsíc|měsíce|měsíců|mesic|mesice|mesicu)([^\\p{{L}}\\p{{N}}_].*)?$', '\\1'), '^[ –—,-]+|[ –—,-]+$', '', 'g')")
_CUT = lambda x: f"regexp_split_to_array({x}, '(?i)\\s+at\\s+')[1]"
_PREFIXES = lambda x: f"[{_TRIMMED(_CUT(x))}, {_TRIMMED(x)}, {_TRIMMED(_CUT(f'split_part({x}, chr(44), 1)'))}, {_TRIMMED(f'split_part({x}, chr(44), 1)')}]"
_MANAGES = lambda x: f"regexp_matches({fold_sql(x)}, '(^|[^a-z0-9_])(" + "|".join(sorted((w for w, _, m in rules.SENIORITY if m), key=lambda w: (-len(w), w))) + ")([^a-z0-9_]|$)')"
_PLACED = f"""pl AS (SELECT DISTINCT c.cv_id, c.attempt, c.ord, c.candidate_id, c.text AS title, coalesce(nullif(instr(lower({compose_sql('r.text')}), lower({compose_sql("coalesce(c.anchor_quote, '')")})), 0) - 1, length({compose_sql('r.text')})) AS place
FROM candidates c JOIN redacted_cv r USING (cv_id) WHERE c.field = 'experience'), to1 AS (SELECT *, CAST(row_number() OVER (PARTITION BY cv_id ORDER BY place, attempt, ord, candidate_id) - 1 AS INT) AS pos FROM pl)"""
_BANDRANK = "['junior', 'mid', 'senior', 'staff', 'head', 'director']"


def _roles(verdicts: str) -> str:
    """verdicts: a SELECT of cv_id, canonical_role, band, management, confidence."""
    rk = lambda b: f"coalesce(list_position({_BANDRANK}, {b}), 0)"
    return f"""WITH {_PLACED}, sq AS (SELECT cv_id, pos, {squeeze_sql('title')} AS t FROM to1 WHERE title IS NOT NULL),
px AS (SELECT cv_id, pos, unnest(range(4)) AS k, unnest({_PREFIXES('t')}) AS cand FROM sq), pc AS (SELECT cv_id, pos, k, cand, {_BAND(fold_sql('cand'))} AS b, {_MGMT(fold_sql('cand'))} AS m FROM px WHERE cand <> '' AND {_SHAPED('cand')}),
cu AS (SELECT cv_id, cand, b, m FROM pc QUALIFY row_number() OVER (PARTITION BY cv_id ORDER BY pos, k) = 1), pk AS (SELECT cv_id, cand, b, m FROM pc QUALIFY row_number() OVER (PARTITION BY cv_id ORDER BY {rk('b')} DESC, pos, k) = 1),
ld AS (SELECT cv_id, bool_or({_MANAGES('cand')}) AS led FROM pc GROUP BY cv_id),
dd AS (SELECT DISTINCT cv_id, detected_role, detected_years FROM detected), d AS (SELECT dd.cv_id, {strip_sql("coalesce(detected_role, '')")} AS role, coalesce(years_experience_deterministic, detected_years, 0) AS years FROM dd LEFT JOIN redacted_cv USING (cv_id)),
x AS (SELECT d.*, {_BAND(fold_sql('role'))} AS db, {_MGMT(fold_sql('role'))} AS dm, {fold_sql('role')} IN ({_DENIED}) AS denied, regexp_matches(role, '[|@&]') AS tag, cu.cand AS ct, cu.b AS cb, cu.m AS cm, pk.cand AS pt, pk.b AS pb, pk.m AS pm, coalesce(led, false) AS led FROM d LEFT JOIN cu USING (cv_id) LEFT JOIN pk USING (cv_id) LEFT JOIN ld USING (cv_id)),
y AS (SELECT *, CASE WHEN db IS NOT NULL AND NOT denied AND NOT tag THEN CASE WHEN {rk('db')} <= 2 AND {rk('cb')} > {rk('db')} THEN 'experience_recovery' ELSE 'market_token' END WHEN (denied OR tag) AND pt IS NOT NULL THEN CASE WHEN denied THEN 'named_headline' ELSE 'tagline_shape' END ELSE 'unrecognized' END AS source FROM x),
v AS ({verdicts}), z AS (SELECT y.*, v.canonical_role AS vt, v.band AS vb, v.management AS vm, (source = 'unrecognized' AND v.cv_id IS NOT NULL) AS judged FROM y LEFT JOIN v ON v.cv_id = y.cv_id AND v.confidence >= 0.6),
q AS (SELECT cv_id, years, led, CASE WHEN judged THEN lower({strip_sql('vt')}) WHEN source = 'experience_recovery' THEN lower(ct) WHEN source IN ('named_headline', 'tagline_shape') THEN lower(pt) WHEN role = '' THEN 'unknown' ELSE lower(role) END AS canonical_role,
CASE WHEN judged THEN vb WHEN source = 'experience_recovery' THEN cb WHEN source = 'market_token' THEN db WHEN source = 'unrecognized' THEN 'mid' ELSE pb END AS b, CASE WHEN judged THEN vm WHEN source = 'experience_recovery' THEN cm WHEN source = 'market_token' THEN dm WHEN source = 'unrecognized' THEN false ELSE pm END AS management, CASE WHEN judged THEN 'llm_fallback' ELSE source END AS source FROM z)
SELECT cv_id, canonical_role, {_BANDRANK}[greatest({rk('b')}, CASE WHEN years >= 8 THEN 3 WHEN years >= 4 THEN 2 ELSE 1 END, CASE WHEN NOT management AND years >= 8 AND led THEN 4 ELSE 1 END)] AS band, management, source FROM q"""


ROLES_SQL = _roles("SELECT NULL::BIGINT AS cv_id, NULL::VARCHAR AS canonical_role, NULL::VARCHAR AS band, NULL::BOOLEAN AS management, NULL::DOUBLE AS confidence")
_MATCHED = lambda x: f"trim(regexp_replace({fold_sql(x)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
_SEGMENTS = lambda x: f"list_filter(list_transform(flatten(list_transform({x}, lambda h: list_append(regexp_split_to_array(h, '\\s+-\\s+|[—–]'), h))), lambda h: {_MATCHED('h')}), lambda h: h <> '')"
_EITHER = lambda seg: f"len(list_filter({seg}, lambda h: contains(' ' || h || ' ', ' ' || t || ' ') OR contains(' ' || t || ' ', ' ' || h || ' '))) > 0"
_FILTERED = f"""WITH {_IN_SECTION}, ee AS (SELECT DISTINCT cv_id, pos, employer_header, is_current FROM employer_entries), tg AS (SELECT cv_id, pos AS ord, max(employer_header) AS target FROM ee GROUP BY ALL),
hn AS (SELECT cv_id, coalesce(list(DISTINCT employer_header) FILTER (is_current), []) AS cur, coalesce(list(DISTINCT employer_header) FILTER (NOT is_current), []) AS past FROM ee WHERE employer_header IS NOT NULL GROUP BY cv_id),
a AS (SELECT candidate_id, vs.text AS what, coalesce(vs.text, '') AS w0, concat_ws(' ', vs.text, anchor_section) AS both_texts, field, CASE WHEN field = 'experience' THEN target END AS target, quote_found, anchor_quote, coalesce(cur, []) AS cur, coalesce(past, []) AS past FROM vs LEFT JOIN tg ON tg.cv_id = vs.cv_id AND tg.ord = vs.ord LEFT JOIN hn ON hn.cv_id = vs.cv_id),
b AS (SELECT *, {_MATCHED("coalesce(target, '')")} AS t, {_SEGMENTS('cur')} AS now_, {_SEGMENTS('past')} AS then_, list_transform(past, lambda h: {_MATCHED('h')}) AS whole, {squeeze_sql(f"regexp_replace(lower(both_texts), '{_PUNCT}', '', 'g')")} AS flat FROM a),
c2 AS (SELECT *, {_BANNED('flat')} AS ban, nullif(regexp_extract(lower(w0), '(?:^|[^\\p{{L}}\\p{{N}}_])(consider|explore|look into)(?:[^\\p{{L}}\\p{{N}}_]|$)', 1), '') AS soft, CASE WHEN field <> 'experience' THEN NULL WHEN coalesce(target, '') = '' THEN CASE WHEN len(cur) > 0 THEN 'missing_target' END
WHEN length(replace(t, ' ', '')) >= 2 AND NOT list_contains(now_, t) AND list_contains(whole, t) THEN 'closed_employer_target' WHEN length(replace(t, ' ', '')) >= 2 AND {_EITHER('now_')} THEN NULL WHEN length(replace(t, ' ', '')) >= 2 AND {_EITHER('then_')} THEN 'closed_employer_target' WHEN len(cur) > 0 THEN 'unverified_target_employer' END AS off FROM b)
SELECT candidate_id, target AS target_employer, CASE WHEN ban IS NOT NULL THEN 'ban_phrase' WHEN soft IS NOT NULL THEN 'softener_phrase' WHEN NOT quote_found THEN 'unverified_anchor' WHEN off = 'missing_target' THEN 'unverified_target_employer' ELSE off END AS reason,
coalesce(ban, soft, CASE WHEN NOT quote_found THEN anchor_quote[:120] WHEN off = 'missing_target' THEN off WHEN off IS NOT NULL THEN target[:40] END) AS detail FROM c2"""
SOFTENERS = r"(?:^|[^\p{L}\p{N}_])(?:consider|explore|look into)(?:[^\p{L}\p{N}_]|$)"
_PLACES = lambda names: "list_filter([" + ",".join(f"instr(t, '{x.replace('-', ' ')}')" for x in names) + "], lambda x: x > 0)"
_ORDER = f"p0 AS (SELECT cv_id, {_PLACES(rules.BODY)} AS b, {_PLACES(rules.SIDEBAR)} AS s, {_PLACES(['kontakt', 'contact'])} AS c FROM t), oo AS (SELECT cv_id, NOT coalesce((list_min(c) > list_min(b)) OR (len(s) >= 3 AND list_min(s) < list_min(b) AND list_max(s) > list_min(b)), false) AS order_ok FROM p0)"


SQL = {
    "redact_email": f"SELECT doc_id, regexp_replace(text, '{EMAIL_SQL}', '[EMAIL]', 'g') AS redacted FROM documents",
    "redact_url": f"SELECT cv_id, regexp_replace(text, '{URL_SQL}', '[URL]', 'g') AS redacted FROM redacted_cv",
    "redaction_counts": f"SELECT cv_id, CAST(len(regexp_extract_all(text, '{URL_SQL}')) AS INT) AS n_url, CAST(len(regexp_extract_all(text, '{EMAIL_SQL}')) AS INT) AS n_email, CAST(len(regexp_extract_all(text, '\\[[A-Z]+\\]')) AS INT) AS n_markers FROM redacted_cv",
    "header_lines": f"WITH l AS ({_LINES}) SELECT cv_id, pos, line FROM l WHERE {header_sql('line')}",
    "annotated_text": annotated_sql("redacted_cv", "cv_id", "text"),
    "section_sizes": f"WITH {_SECTIONED} SELECT cv_id, coalesce(section, '') AS section, count(*) AS n_lines, CAST(sum({words_sql('line')}) AS BIGINT) AS n_words FROM s WHERE NOT header AND {strip_sql('line')} <> '' GROUP BY ALL",
    "section_slices": f"WITH {_SLICES} SELECT cv_id, section, body FROM sl",
    "anchorable_lines": f"WITH {_ANCHORABLE} SELECT cv_id, pos, quote, section FROM an",
    "salvage_quotes": f"""WITH {_ANCHORABLE}, {_GATED}, hd AS (SELECT cv_id, bool_or(field = 'skills') AS sk0, bool_or(field = 'soft_signals') AS so0 FROM g WHERE verdict = 'kept' GROUP BY cv_id), us AS (SELECT DISTINCT cv_id, qn AS n FROM g WHERE verdict = 'kept'),
t AS (SELECT an.cv_id, pos, quote, {_NORM('quote')} AS n, {_NORM('r.text')} AS tn, lower({compose_sql('quote')}) AS t FROM an JOIN redacted_cv r USING (cv_id)),
lb AS (SELECT cv_id, pos, quote, n, {_label_list(rules.SKILLS)} AS sk, {_label_list(rules.SOFT_SIGNALS)} AS so FROM t WHERE {_FOUND('n', 'tn')}), ok AS (SELECT lb.*, coalesce(sk0, false) AS sk0, coalesce(so0, false) AS so0 FROM lb LEFT JOIN hd USING (cv_id) WHERE NOT EXISTS (SELECT 1 FROM us WHERE us.cv_id = lb.cv_id AND us.n = lb.n)),
a AS (SELECT cv_id, 'skills' AS kind, pos, quote, n, array_to_string(sk[1:4], ', ') AS found FROM ok WHERE len(sk) > 0 AND NOT sk0 QUALIFY row_number() OVER (PARTITION BY cv_id ORDER BY pos) = 1),
b AS (SELECT ok.cv_id, 'soft_signals' AS kind, ok.pos, ok.quote, array_to_string(so[1:4], ', ') AS found FROM ok LEFT JOIN a USING (cv_id) WHERE len(so) > 0 AND NOT so0 AND (a.n IS NULL OR a.n <> ok.n) QUALIFY row_number() OVER (PARTITION BY ok.cv_id ORDER BY ok.pos) = 1)
SELECT cv_id, kind, pos, quote, found FROM a UNION ALL SELECT * FROM b""",
    "section_order": f"""WITH t AS (SELECT cv_id, array_to_string(regexp_extract_all(lower(text), '[0-9a-zà-ž]+'), ' ') AS t FROM redacted_cv), {_ORDER} SELECT cv_id, order_ok FROM oo""",
    "token_overlap": r"""WITH c AS (SELECT DISTINCT candidate_id, cv_id, anchor_quote FROM candidates WHERE anchor_quote IS NOT NULL),
j AS (SELECT candidate_id, list_filter(list_distinct(regexp_extract_all(lower(anchor_quote), '[0-9A-Za-z\x{c0}-\x{17e}]+')), lambda x: length(x) >= 3) AS a, list_filter(list_distinct(regexp_extract_all(lower(text), '[0-9A-Za-z\x{c0}-\x{17e}]+')), lambda x: length(x) >= 3) AS b FROM c JOIN redacted_cv USING (cv_id))
SELECT candidate_id, round(CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b)) / len(a) END, 6) AS overlap FROM j""",
    "date_ranges": f"""WITH u AS (SELECT DISTINCT entry_id, dates_raw FROM employer_entries), {_RANGES('u', 'entry_id', 'dates_raw')} SELECT entry_id, "start", "end" FROM r""",
    "tenure_years": f"""WITH {_WORK}, wt AS (SELECT cv_id, string_agg(line, chr(10) ORDER BY pos) AS w FROM wk GROUP BY cv_id), sc AS (SELECT cv_id, CASE WHEN ws.cv_id IS NOT NULL THEN coalesce(w, '') ELSE text END AS text FROM redacted_cv LEFT JOIN ws USING (cv_id) LEFT JOIN wt USING (cv_id)),
{_RANGES('sc', 'cv_id', 'text')}, n AS (SELECT cv_id, count(DISTINCT mo) AS months FROM (SELECT cv_id, unnest(range("start", "end")) AS mo FROM r) GROUP BY cv_id)
SELECT cv_id, CAST(months // 12 AS INT) AS years FROM redacted_cv LEFT JOIN n USING (cv_id)""",
    "employer_timeline": f"WITH {_TIMELINE} SELECT * FROM tl",
    "normalised_quotes": f"SELECT DISTINCT candidate_id, {_NORM('anchor_quote')} AS form, {fold_sql('anchor_quote')} AS folded FROM candidates WHERE anchor_quote IS NOT NULL",
    "verify_quotes": f"WITH {_GATED} SELECT candidate_id, quote_found FROM g",
    "verify_in_section": f"WITH {_IN_SECTION} SELECT candidate_id, quote_found, section_missed FROM vs",
    "component_counts": f"WITH {_COMPONENTS} SELECT * FROM cc",
    "score_gates": f"""WITH {_COMPONENTS}, bl AS (SELECT cv_id, max(section_misses) > 2 AS blind FROM cc GROUP BY cv_id), hv AS (SELECT cv_id, list(DISTINCT field) AS have FROM vs WHERE quote_found GROUP BY cv_id),
ms AS (SELECT cv_id, blind, list_filter(['education', 'experience', 'skills', 'soft_signals'], lambda n: NOT list_contains(coalesce(have, []), n)) AS missing FROM bl LEFT JOIN hv USING (cv_id))
SELECT cv_id, CASE WHEN blind THEN 'section_blind' WHEN list_contains(missing, 'experience') THEN 'missing_experience' END AS failure, array_to_string(missing, ',') AS missing FROM ms""",
    "quote_places": f"""WITH c AS (SELECT DISTINCT candidate_id, cv_id, anchor_quote FROM candidates WHERE anchor_quote IS NOT NULL), j AS (SELECT candidate_id, {_NORM('anchor_quote')} AS n, {_NORM('text')} AS h, lower({compose_sql('anchor_quote')}) AS n2, lower({compose_sql('text')}) AS h2 FROM c JOIN redacted_cv USING (cv_id))
SELECT candidate_id, CASE WHEN n <> '' AND instr(h, n) > 0 THEN instr(h, n) - 1 END AS span_start, CASE WHEN n <> '' AND instr(h, n) > 0 THEN instr(h, n) - 1 + length(n) END AS span_end, CASE WHEN instr(h2, n2) > 0 THEN instr(h2, n2) - 1 ELSE length(h2) END AS at FROM j""",
    "candidate_validation": f"""WITH c AS (SELECT cv_id, text, {strip_sql("array_to_string(list_reverse(string_split(text, chr(10))), chr(10))")} AS turned, {strip_sql('text')} AS whole FROM redacted_cv), tk AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(text), '[0-9A-Za-zà-ž]+')), lambda x: length(x) >= 3) AS a, list_filter(list_distinct(regexp_extract_all(lower(turned), '[0-9A-Za-zà-ž]+')), lambda x: length(x) >= 3) AS b FROM c),
{_ORDER.replace('FROM t', "FROM (SELECT cv_id, array_to_string(regexp_extract_all(lower(turned), '[0-9a-zà-ž]+'), ' ') AS t FROM c)")}, {_ORDER.replace('p0', 'p1').replace('oo AS', 'ow AS').replace('FROM t', "FROM (SELECT cv_id, array_to_string(regexp_extract_all(lower(whole), '[0-9a-zà-ž]+'), ' ') AS t FROM c)")}
SELECT cv_id, CASE WHEN length(turned) < 100 OR length(turned) < floor(length(whole) * 0.45) THEN 'under_min_chars' WHEN len(a) > 0 AND len(list_intersect(a, b)) / len(a) < 0.7 THEN 'low_source_overlap' WHEN NOT oo.order_ok THEN 'column_order_flipped' END AS docx_reason, CASE WHEN length(whole) < 100 THEN 'under_min_chars' WHEN NOT ow.order_ok THEN 'column_order_flipped' END AS pdf_reason FROM tk JOIN oo USING (cv_id) JOIN ow USING (cv_id)""",
    "evidence_gate": f"""WITH {_GATED}, k AS (SELECT cv_id, replace(lower({squeeze_sql(compose_sql('anchor_quote'))}), 'ß', 'ss') AS k, max(CASE field WHEN 'experience' THEN 3 WHEN 'education' THEN 2 WHEN 'skills' THEN 1 WHEN 'soft_signals' THEN 1 ELSE 0 END) AS w FROM g WHERE verdict = 'kept' GROUP BY ALL), sc AS (SELECT cv_id, sum(w) AS score FROM k GROUP BY cv_id)
SELECT cv_id, CAST(coalesce(score, 0) AS INT) AS score, coalesce(score, 0) >= 3 AS enough FROM (SELECT DISTINCT cv_id FROM redacted_cv) LEFT JOIN sc USING (cv_id)""",
    "override_years": "SELECT DISTINCT cv_id, coalesce(years_experience_deterministic, detected_years) AS years, coalesce(abs(years_experience_deterministic - detected_years) >= 1, false) AS changed FROM detected JOIN redacted_cv USING (cv_id)",
    "title_order": f"WITH {_PLACED} SELECT cv_id, pos, title FROM to1",
    "role_normalise": ROLES_SQL,
    "role_verdicts": _roles("SELECT DISTINCT cv_id, ' Listed ' || coalesce(detected_country, '?') AS canonical_role, 'junior' AS band, false AS management, CASE WHEN detected_location IS NOT NULL THEN 0.6 ELSE 0.5 END AS confidence FROM detected"),
    "title_prefixes": f"""WITH t AS (SELECT DISTINCT text FROM candidates WHERE text IS NOT NULL), q AS (SELECT text, {squeeze_sql('text')} AS t FROM t), p AS (SELECT text, unnest(range(4)) AS k, unnest({_PREFIXES('t')}) AS c FROM q), f AS (SELECT text, c, min(k) AS k FROM p WHERE c <> '' GROUP BY ALL), g AS (SELECT text, string_agg(c, '|' ORDER BY k) AS prefixes FROM f GROUP BY text)
SELECT t.text, coalesce(prefixes, '') AS prefixes, {_MANAGES('t.text')} AS manages FROM t LEFT JOIN g USING (text)""",
    "action_filter": _FILTERED,
    "claim_overlap": f"WITH c AS (SELECT DISTINCT candidate_id, text, anchor_quote FROM candidates), t AS (SELECT candidate_id, {_CONTENT('text')} AS a, {_CONTENT('anchor_quote')} AS b FROM c) SELECT candidate_id, round({_JACCARD('a', 'b')}, 6) AS overlap FROM t",
    "gate_counts": f"WITH {_GATED} SELECT cv_id, count(*) FILTER (verdict = 'kept') AS kept, count(*) FILTER (verdict = 'missing_quote') AS missing_quotes, count(*) FILTER (verdict = 'suspect') AS suspects FROM g GROUP BY cv_id",
    "adjudicated_counts": f"WITH {_JUDGED} SELECT cv_id, count(*) FILTER (verdict <> 'missing_quote' AND dr.candidate_id IS NULL) AS kept, count(*) FILTER (verdict = 'missing_quote') AS existence_dropped, count(dr.candidate_id) AS compat_dropped FROM g LEFT JOIN dr USING (candidate_id) GROUP BY cv_id",
    "first_verified": f"WITH {_GATED} SELECT cv_id, field, candidate_id FROM g WHERE verdict = 'kept' QUALIFY row_number() OVER (PARTITION BY cv_id, field ORDER BY attempt, ord, candidate_id) = 1",
    "skill_labels": f"WITH t AS (SELECT cv_id, lower({compose_sql('text')}) AS t FROM redacted_cv) SELECT cv_id, {_labels(rules.SKILLS)} AS skills, {_labels(rules.SOFT_SIGNALS)} AS soft_signals FROM t",
    "evidence_score": f"""WITH k AS (SELECT cv_id, replace(lower({squeeze_sql(compose_sql('anchor_quote'))}), 'ß', 'ss') AS k, max(CASE field WHEN 'experience' THEN 3 WHEN 'education' THEN 2 WHEN 'skills' THEN 1 WHEN 'soft_signals' THEN 1 ELSE 0 END) AS w FROM candidates WHERE anchor_quote IS NOT NULL GROUP BY ALL)
SELECT cv_id, CAST(sum(w) AS INT) AS score FROM k GROUP BY cv_id""",
    "title_shapes": f"SELECT DISTINCT text, {_SHAPED('text')} AS shaped, {_BAND(fold_sql('text'))} AS band FROM candidates WHERE text IS NOT NULL",
    "action_reasons": f"""WITH t AS (SELECT doc_id, lower(text) AS w, {squeeze_sql(f"regexp_replace(lower(concat_ws(' ', text, uploader)), '{_PUNCT}', '', 'g')")} AS t FROM documents WHERE text IS NOT NULL), b AS (SELECT *, {_BANNED('t')} AS banned FROM t)
SELECT doc_id, CASE WHEN banned IS NOT NULL THEN 'banned:' || banned WHEN regexp_matches(w, '{SOFTENERS}') THEN 'softener' END AS reason FROM b""",
    "action_pool": f"""WITH a AS (SELECT DISTINCT cv_id, attempt, ord, candidate_id, text FROM candidates WHERE text IS NOT NULL),
o AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY cv_id, lower({squeeze_sql(compose_sql('text'))}) ORDER BY attempt, ord, candidate_id) = 1), n AS (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY attempt, ord, candidate_id) AS rn FROM o)
SELECT n.cv_id, CAST(n.rn AS INT) AS rn, n.text FROM n LEFT JOIN (SELECT cv_id, attempt AS last FROM n WHERE rn = 3) f USING (cv_id) WHERE n.rn <= 5 AND (last IS NULL OR n.attempt <= last)""",
    "boilerplate_quotes": f"""WITH c AS (SELECT DISTINCT candidate_id, anchor_quote FROM candidates WHERE anchor_quote IS NOT NULL), g AS (SELECT candidate_id, {_PLAIN('anchor_quote')} AS w FROM c), h AS (SELECT candidate_id, {_SHINGLES('w')} AS g FROM g),
bw AS (SELECT {_PLAIN('b')} AS w FROM (SELECT unnest([{','.join("'" + x.replace("'", "''") + "'" for x in BASELINE)}]) AS b)), b AS (SELECT {_SHINGLES('w')} AS g FROM bw),
s AS (SELECT candidate_id, max(CASE WHEN len(h.g) > 0 THEN len(list_intersect(h.g, b.g)) / len(list_distinct(list_concat(h.g, b.g))) ELSE 0 END) AS x FROM h, b GROUP BY candidate_id)
SELECT candidate_id, round(x, 6) AS likeness, x > 0.6 AS flagged FROM s""",
    "education_level": _education(),
}
