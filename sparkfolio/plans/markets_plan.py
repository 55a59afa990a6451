"""Queries over markets, search results, evidence and events; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import estimates, evidence, market, runs, tenure
from ..session import table
from . import rules
from .documents_plan import ROLES_SQL, normalised_profiles


def _resolve_market(spark, d):
    return market.resolve_markets(table(spark, d, "detected"))


def _url_domain(spark, d):
    return table(spark, d, "search_results").select("result_id", market.domain(F.col("href")).alias("domain")).distinct()


def _tld_histogram(spark, d):
    return market.tld_histogram(table(spark, d, "search_results"))


def _top(spark, d):
    return market.top_sources(table(spark, d, "search_results"), table(spark, d, "market_specs"))


def _source_top8(spark, d):
    return _top(spark, d)


def _source_outcome(spark, d):
    """Results without a link stand in for failed queries, those of the first rank for refused ones."""
    r = table(spark, d, "search_results").where("cv_id is not null and href is null").select("cv_id", "result_id", F.when(F.col("rank_no") <= 1, "RatelimitException").otherwise("TimeoutException").alias("exc_type")).distinct()
    return market.source_outcome(_top(spark, d), table(spark, d, "redacted_cv"), r)


def _build_queries(spark, d):
    roles = normalised_profiles(spark, d).select("cv_id", "canonical_role", "management")
    p = table(spark, d, "detected").select("cv_id", "detected_role", "detected_location", F.col("detected_years").alias("years")).distinct()
    m = market.resolve_markets(table(spark, d, "detected")).select("cv_id", "country", "country_name", "currency")
    return market.build_queries(p.join(roles, "cv_id").join(m, "cv_id"))


def _gather_results(spark, d):
    r = table(spark, d, "search_results").where("cv_id is not null")
    return market.gather_results(r.where("query_text is not null"), r)


def _cassette_keys(spark, d):
    q = table(spark, d, "search_results").where("query_text is not null").select("query_text").distinct()
    return q.select("query_text", market.cassette_key(F.col("query_text")).alias("cassette"))


def _cache_with_ttl(spark, d):
    return market.latest_per_query(table(spark, d, "search_results"), ttl_days=365, now=F.to_timestamp(F.lit("2026-05-01 00:00:00")))


def _estimates(spark, d):
    """Each search result as an estimate: the first and the last of its long numbers, its market's currency and period as spelled, its own link."""
    r = table(spark, d, "search_results").where("cv_id is not null").select("result_id", "cv_id", "href", "body").distinct()
    n = F.regexp_extract_all("body", F.lit("([0-9]{4,7})"), F.lit(1))
    number = lambda i: F.try_element_at(n, F.lit(i)).try_cast("long")
    m = table(spark, d, "market_specs").select("cv_id", "currency", "pay_period").distinct()
    return r.join(m, "cv_id").select(F.col("result_id").alias("estimate_id"), "cv_id", number(1).alias("low"), number(-1).alias("high"), "currency", F.col("pay_period").alias("period"), F.array("href").alias("urls"))


def _estimate_gates(spark, d):
    return estimates.estimate_gates(_estimates(spark, d), _top(spark, d).select("cv_id", F.col("href").alias("url")))


def _confidence_tiers(spark, d):
    """Tiers of each CV: the model's stands in for by its years, its sources' comes from their links, its quality from the profile."""
    n = _top(spark, d).groupBy("cv_id").agg(F.countDistinct("domain").alias("n"))
    p = table(spark, d, "detected").select("cv_id", "detected_role", "detected_location", "detected_years").distinct()
    m = market.resolve_markets(table(spark, d, "detected")).select("cv_id", "provenance")
    c = p.join(m, "cv_id").join(n, "cv_id", "left")
    model = F.when(F.col("detected_years") >= 8, "High").when(F.col("detected_years") >= 3, "Medium").otherwise("Low")
    rubric = F.when(F.col("n") >= 3, "High").when(F.col("n") == 2, "Medium").when(F.col("n") == 1, "Low")
    floor = estimates.cv_floor(F.when(F.col("detected_years").isNull(), 2).when(F.col("detected_years") == 0, 1).otherwise(0), F.col("detected_role").isNotNull(), F.col("detected_location").isNotNull(), F.col("provenance"))
    c = c.select("cv_id", estimates.capped_tier(model, rubric).alias("salary_tier"), floor.alias("cv_floor"))
    return c.withColumn("final_tier", estimates.final_tier(F.col("salary_tier"), F.col("cv_floor")))


def _latest_per_query(spark, d):
    return market.latest_per_query(table(spark, d, "search_results"))


def _salary_numbers(spark, d):
    return table(spark, d, "search_results").where("body is not null").select("result_id", F.array_join(F.transform(evidence.snippet_numbers(F.col("body")), lambda x: F.round(x, 2).cast("string")), " ").alias("numbers"), evidence.period_hint(F.col("body")).alias("period")).distinct()


def _source_rubric(spark, d):
    return evidence.rubric(evidence.result_values(table(spark, d, "search_results")), "cv_id", "domain", "value", "period")


def _evidence_tier(spark, d):
    o = table(spark, d, "orders")
    v = o.select("o_custkey", "o_orderpriority", "o_totalprice", F.when(F.col("o_orderstatus") == "P", "month").when(F.col("o_orderstatus") == "F", "year").alias("period"))
    return evidence.rubric(v, "o_custkey", "o_orderpriority", "o_totalprice", "period")


def _score_total(spark, d):
    """Every line of an order is a component: the first four by number the four named ones, others by their place again."""
    l = table(spark, d, "lineitem")  # noqa: E741
    name = F.element_at(F.array(*[F.lit(n) for n, _ in evidence.WEIGHTS]), F.pmod(F.col("l_linenumber") - 1, F.lit(4)) + 1)
    return evidence.weighted_total(l.select("l_orderkey", name.alias("name"), F.pmod("l_partkey", F.lit(101)).cast("int").alias("score")), "l_orderkey", "name", "score")


def _retry_merge(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", F.pmod("l_partkey", F.lit(101)).cast("int").alias("score"))  # noqa: E741
    return evidence.retry_merge(l, "l_orderkey", "l_returnflag", "l_linenumber", "score", "R")


def _interval_union(spark, d):
    o = table(spark, d, "orders").select("o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("start"), F.pmod("o_orderkey", F.lit(9)).alias("n"))
    return tenure.union_months(o.select("o_custkey", "start", (F.col("start") + F.col("n")).alias("end")), "o_custkey", "start", "end")


def _cost_rollup(spark, d):
    return runs.cost_rollup(table(spark, d, "events"), "user_id", "event_type", "click", "value", "props", "$.k")


def _outcome_rates(spark, d):
    return runs.outcome_rates(table(spark, d, "events"), "user_id", "event_type", "error")


def _pair_delta(spark, d):
    e = table(spark, d, "events")
    n = lambda t: e.where(F.col("event_type") == t).groupBy("user_id").agg(F.count("*").alias("n"))
    return runs.pair_delta(n("click"), n("view"), "user_id", "n")


def _escape_markdown(spark, d):
    return table(spark, d, "documents").select("doc_id", runs.escape_markdown(F.col("text")).alias("escaped"))


def _escape_html(spark, d):
    return table(spark, d, "search_results").select("result_id", runs.escape_html(F.col("body")).alias("escaped")).distinct()


def _money(spark, d):
    return table(spark, d, "orders").select("o_orderkey", runs.money(F.col("o_totalprice").cast("long")).alias("price"))


def _run_snapshots(spark, d):
    """The events table replayed as a stream; the last snapshot of each run."""
    from ..streaming import replay, run_snapshots

    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    snapshots = replay(run_snapshots(stream))
    return snapshots.groupBy("run").agg(F.max_by(F.struct("events", "purchases", "last_ts", "last_type"), "events").alias("s")).select("run", "s.*")


def _page_budgets(spark, d):
    """The scans of vision_fixtures with made-up sizes: more pages are more bytes, later pages are larger."""
    from ..sources import page_budgets

    f = table(spark, d, "vision_fixtures").select("fixture_id", F.col("n_pages")).distinct().where("n_pages is not null")
    p = f.select("fixture_id", "n_pages", F.explode(F.sequence(F.lit(1), F.greatest("n_pages", F.lit(1)))).alias("page"))
    size = {"pdf_bytes": F.col("fixture_id") % 7 * 1_800_000, "pixels": F.col("page") * 1_000_000 + F.col("fixture_id") % 5 * 1_200_000, "image_bytes": F.col("fixture_id") % 11 * 3_000_000}
    return page_budgets(p.withColumns(size), "fixture_id")


def _corpus_summary(spark, d):
    return runs.corpus_summary(table(spark, d, "events"), "user_id", "event_type", "value", "props")


QUERIES = {
    "resolve_market": _resolve_market, "url_domain": _url_domain, "tld_histogram": _tld_histogram, "source_top8": _source_top8, "source_outcome": _source_outcome, "build_queries": _build_queries, "gather_results": _gather_results, "cassette_keys": _cassette_keys, "cache_with_ttl": _cache_with_ttl, "estimate_gates": _estimate_gates, "confidence_tiers": _confidence_tiers,
    "latest_per_query": _latest_per_query, "salary_numbers": _salary_numbers,
    "source_rubric": _source_rubric, "evidence_tier": _evidence_tier, "score_total": _score_total, "retry_merge": _retry_merge, "interval_union": _interval_union,
    "cost_rollup": _cost_rollup, "outcome_rates": _outcome_rates, "pair_delta": _pair_delta, "escape_markdown": _escape_markdown, "escape_html": _escape_html, "money": _money, "run_snapshots": _run_snapshots, "corpus_summary": _corpus_summary, "page_budgets": _page_budgets,
}

_VALUES = ", ".join("('{}','{}','{}')".format(*r) for r in rules.MARKETS)
_CZ = r"(?:^|[^\p{L}\p{N}_])(?:czech|cz|praha|prague|brno|ostrava)(?:[^\p{L}\p{N}_]|$)"
_DOMAIN = lambda c: f"regexp_replace(lower(trim(nullif(regexp_extract({c}, '{rules.HOST}', 1), ''), ' ')), '^www\\.', '')"
_PREFER = "CASE " + " ".join(f"WHEN contains(domain, '{x}') THEN {i}" for i, x in enumerate(rules.DOMAIN_PRIORITY)) + f" ELSE {len(rules.DOMAIN_PRIORITY)} END"
_PART = lambda n: f"max(CASE WHEN (l_linenumber - 1) % 4 = {n - 1} THEN l_partkey % 101 END)"

_MARKET = f"""dim(country, currency, country_name) AS (VALUES {_VALUES}),
mr AS (SELECT DISTINCT cv_id, CASE WHEN upper(trim(detected_country, ' ')) = 'UK' THEN 'GB' ELSE upper(trim(detected_country, ' ')) END AS stated, regexp_matches(lower(detected_location), '{_CZ}') AS czech FROM detected),
mn AS (SELECT mr.*, dim.country IS NOT NULL AS known FROM mr LEFT JOIN dim ON dim.country = mr.stated),
mc AS (SELECT cv_id, CASE WHEN known THEN stated WHEN czech THEN 'CZ' ELSE 'XX' END AS country, CASE WHEN known THEN 'cv_explicit' WHEN czech THEN 'inferred' ELSE 'default' END AS provenance FROM mn),
mk AS (SELECT cv_id, country, country_name, coalesce(currency, 'USD') AS currency, CASE WHEN currency IN ('CZK', 'PLN', 'HUF', 'RON', 'BGN') THEN 'month' ELSE 'year' END AS period, provenance FROM mc LEFT JOIN dim USING (country))"""
_TOP8 = f"""tr AS (SELECT DISTINCT cv_id, query_ord, rank_no, result_id, href, {_DOMAIN('href')} AS domain FROM search_results WHERE cv_id IS NOT NULL), tz AS (SELECT DISTINCT cv_id, true AS czech FROM market_specs WHERE country = 'CZ'),
tf AS (SELECT * FROM tr WHERE domain IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cv_id, href ORDER BY query_ord, rank_no, result_id) = 1),
tn AS (SELECT tf.*, row_number() OVER (PARTITION BY cv_id ORDER BY CASE WHEN czech THEN {_PREFER} ELSE 0 END, query_ord, rank_no, result_id) AS rn FROM tf LEFT JOIN tz USING (cv_id)), t8 AS (SELECT cv_id, CAST(rn AS INT) AS rn, result_id, href, domain FROM tn WHERE rn <= 8)"""

SQL = {
    "resolve_market": f"WITH {_MARKET} SELECT * FROM mk",
    "url_domain": f"SELECT DISTINCT result_id, {_DOMAIN('href')} AS domain FROM search_results",
    "tld_histogram": f"""WITH d AS (SELECT DISTINCT result_id, {_DOMAIN('href')} AS domain FROM search_results), t AS (SELECT DISTINCT result_id, CASE WHEN domain IS NULL OR trim(domain, ' ') = '' THEN '(empty)' WHEN contains(domain, '.') THEN '.' || split_part(domain, '.', -1) ELSE domain END AS tld FROM d) SELECT tld, count(*) AS n FROM t GROUP BY tld""",
    "source_top8": f"WITH {_TOP8} SELECT * FROM t8",
    "source_outcome": f"""WITH {_TOP8}, n AS (SELECT cv_id, count(*) AS sources FROM t8 GROUP BY cv_id), f0 AS (SELECT DISTINCT cv_id, result_id, rank_no <= 1 AS refused FROM search_results WHERE cv_id IS NOT NULL AND href IS NULL), f AS (SELECT cv_id, bool_and(coalesce(refused, false)) AS all_refused FROM f0 GROUP BY cv_id)
SELECT cv_id, coalesce(sources, 0) AS sources, CASE WHEN sources >= 2 THEN 'ok' WHEN all_refused IS NULL THEN 'insufficient' WHEN all_refused THEN 'rate_limit' ELSE 'query_failures' END AS outcome FROM (SELECT DISTINCT cv_id FROM redacted_cv) LEFT JOIN n USING (cv_id) LEFT JOIN f USING (cv_id)""",
    "build_queries": f"""WITH ro AS ({ROLES_SQL}), {_MARKET}, p AS (SELECT DISTINCT cv_id, detected_role, detected_location, detected_years FROM detected),
j AS (SELECT p.cv_id, ro.canonical_role AS role, ro.management AS mgr, coalesce(detected_years, 0) AS y, trim(coalesce(detected_location, ''), ' ') AS loc, coalesce(detected_location, '') = '' AS no_loc, mk.country, coalesce(mk.country_name, '') AS cn, mk.currency AS cur FROM p JOIN ro USING (cv_id) JOIN mk USING (cv_id)),
k AS (SELECT *, CASE WHEN no_loc THEN 'Praha' ELSE loc END AS city, CASE WHEN loc <> '' THEN loc ELSE cn END AS place FROM j),
l AS (SELECT cv_id, list_filter([CASE WHEN mgr THEN CASE country WHEN 'CZ' THEN concat_ws(' ', role, 'manager salary', nullif(city, ''), 'CZK 2026') WHEN 'XX' THEN role || ' manager salary USD 2026' ELSE concat_ws(' ', role, 'manager salary', nullif(place, ''), cur, '2026') END END,
CASE country WHEN 'CZ' THEN role || ' salary ' || city || ' site:platy.cz' WHEN 'XX' THEN role || ' salary USD 2026' ELSE concat_ws(' ', role, 'salary', nullif(place, ''), cur, '2026') END, CASE country WHEN 'CZ' THEN role || ' salary ' || city || ' site:profesia.cz' WHEN 'XX' THEN role || ' compensation USD 2026' ELSE role || ' ' || cn || ' compensation 2026' END,
CASE WHEN country = 'CZ' THEN role || ' mzda CZK 2026' END, CASE WHEN country = 'CZ' AND NOT (mgr AND y >= 10) THEN role || ' salary czech republic site:glassdoor.com' END, CASE WHEN y >= 10 THEN CASE WHEN country = 'CZ' THEN 'senior ' || role || ' salary EUR Europe 2026' ELSE concat_ws(' ', 'senior', role, 'salary', nullif(cn, ''), cur, '2026') END END], lambda q: q IS NOT NULL)[1:5] AS q FROM k)
SELECT cv_id, CAST(unnest(range(0, len(q))) AS INT) AS query_ord, unnest(q) AS query FROM l""",
    "gather_results": """WITH q AS (SELECT DISTINCT cv_id, query_ord FROM search_results WHERE cv_id IS NOT NULL AND query_text IS NOT NULL), r AS (SELECT DISTINCT cv_id, query_ord, rank_no, result_id FROM search_results WHERE cv_id IS NOT NULL)
SELECT cv_id, CAST(row_number() OVER (PARTITION BY cv_id ORDER BY query_ord, rank_no, result_id) AS INT) AS result_ord, query_ord, rank_no, result_id FROM r JOIN q USING (cv_id, query_ord)""",
    "cassette_keys": "SELECT DISTINCT query_text, CASE WHEN regexp_matches(lower(query_text), 'manager|head of|vedouc') THEN 'senior_manager_prague' WHEN regexp_matches(lower(query_text), 'junior|data analyst') THEN 'junior_data_analyst_prague' WHEN contains(lower(query_text), 'machine learning engineer') THEN 'staff_mle_prague' WHEN contains(lower(query_text), 'data scientist') THEN 'data_scientist_prague' ELSE 'generic_cz_data' END AS cassette FROM search_results WHERE query_text IS NOT NULL",
    "cache_with_ttl": "SELECT trim(query_text, ' ') AS q, rank_no, result_id FROM search_results WHERE fetched_at > TIMESTAMPTZ '2026-05-01 00:00:00+00' - INTERVAL 365 DAYS QUALIFY row_number() OVER (PARTITION BY trim(query_text, ' '), rank_no ORDER BY fetched_at DESC, result_id DESC) = 1",
    "estimate_gates": f"""WITH {_TOP8}, m AS (SELECT DISTINCT cv_id, currency, pay_period FROM market_specs), r AS (SELECT DISTINCT result_id, cv_id, href, regexp_extract_all(body, '[0-9]{{4,7}}') AS n FROM search_results WHERE cv_id IS NOT NULL),
e AS (SELECT r.result_id, r.cv_id, r.href, CAST(n[1] AS BIGINT) AS lo, CAST(n[-1] AS BIGINT) AS hi, upper(trim(coalesce(currency, ''), ' ')) AS cur, pay_period FROM r JOIN m USING (cv_id)), k AS (SELECT e.*, CAST(EXISTS (SELECT 1 FROM t8 WHERE t8.cv_id = e.cv_id AND t8.href = e.href) AS INT) AS kept FROM e),
f AS (SELECT *, CASE WHEN kept = 0 THEN 'no_verifiable_sources' WHEN NOT regexp_full_match(cur, '[A-Z][A-Z][A-Z]') THEN 'invalid_currency_shape' WHEN coalesce(lo >= hi, true) THEN 'invalid_range' END AS failure FROM k)
SELECT result_id AS estimate_id, failure, cur AS currency, coalesce(pay_period <> CASE WHEN cur IN ('CZK', 'PLN', 'HUF', 'RON', 'BGN') THEN 'month' ELSE 'year' END, true) AS period_mismatch, CASE WHEN failure IS NULL THEN (lo + hi) // 2 END AS midpoint, kept, 1 - kept AS dropped FROM f""",
    "confidence_tiers": f"""WITH {_TOP8}, {_MARKET}, n AS (SELECT cv_id, count(DISTINCT domain) AS n FROM t8 GROUP BY cv_id), p AS (SELECT DISTINCT cv_id, detected_role, detected_location, detected_years AS y FROM detected),
r AS (SELECT p.cv_id, CASE WHEN y >= 8 THEN 2 WHEN y >= 3 THEN 1 ELSE 0 END AS model, CASE WHEN n >= 3 THEN 2 WHEN n = 2 THEN 1 WHEN n = 1 THEN 0 END AS rubric, CASE WHEN y IS NULL THEN 0 WHEN y = 0 OR detected_role IS NULL OR detected_location IS NULL OR provenance = 'default' THEN 1 ELSE 2 END AS fl FROM p JOIN mk USING (cv_id) LEFT JOIN n USING (cv_id)), s AS (SELECT *, least(model, coalesce(rubric, 2)) AS sal FROM r)
SELECT cv_id, ['Low', 'Medium', 'High'][sal + 1] AS salary_tier, ['Low', 'Medium', 'High'][fl + 1] AS cv_floor, ['Low', 'Medium', 'High'][least(sal, fl) + 1] AS final_tier FROM s""",
    "page_budgets": """WITH f AS (SELECT DISTINCT fixture_id AS i, n_pages AS n FROM vision_fixtures WHERE n_pages IS NOT NULL), p AS (SELECT i, n, unnest(range(1, greatest(n, 1) + 1)) AS page FROM f),
q AS (SELECT *, CASE WHEN page * 1000000 + i % 5 * 1200000 > 6000000 THEN 'page_pixels' WHEN i % 11 * 3000000 * page > 48000000 THEN 'total_image_bytes' END AS own FROM p), b AS (SELECT i, min(page) AS page FROM q WHERE own IS NOT NULL GROUP BY i)
SELECT f.i AS fixture_id, CASE WHEN f.i % 7 * 1800000 > 10000000 THEN 'pdf_bytes' WHEN f.n > 8 THEN 'too_many_pages' ELSE q.own END AS reason FROM f LEFT JOIN b USING (i) LEFT JOIN q ON q.i = b.i AND q.page = b.page""",
    "corpus_summary": r"""WITH r AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS a, count(*) FILTER (event_type = 'click') AS d, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'signup') AS u, coalesce(sum(CASE WHEN regexp_matches(json_extract_string(props, '$.k'), '^-?[0-9]+$') THEN try_cast(json_extract_string(props, '$.k') AS BIGINT) END), 0) AS l, round(sum(value), 2) AS c FROM events GROUP BY user_id),
s AS (SELECT *, CASE WHEN a >= 3 THEN 'ok' WHEN a > 0 THEN 'degraded' WHEN e > 0 AND u > 0 THEN 'skipped' ELSE 'failed' END AS st FROM r)
SELECT count(*) AS reports, count(*) FILTER (st = 'ok') AS ok, count(*) FILTER (st = 'degraded') AS degraded, count(*) FILTER (st = 'skipped') AS skipped, count(*) FILTER (st = 'failed') AS failed, CAST(sum(d) AS BIGINT) AS drops, CAST(sum(v) AS BIGINT) AS retries, round(sum(c), 2) AS cost, round(avg(l), 4) AS avg_latency, CAST(max(l) AS BIGINT) AS max_latency,
coalesce(count(*) FILTER (st = 'failed') / nullif(count(*) FILTER (st <> 'skipped'), 0) > 0.25, false) AS too_many_failed FROM s HAVING count(*) > 0""",
    "run_snapshots": "SELECT user_id AS run, count(*) AS events, count(*) FILTER (event_type = 'purchase') AS purchases, max(ts) AS last_ts, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS last_type FROM events WHERE user_id IS NOT NULL GROUP BY user_id",
    "latest_per_query": "SELECT trim(query_text, ' ') AS q, rank_no, result_id FROM search_results QUALIFY row_number() OVER (PARTITION BY trim(query_text, ' '), rank_no ORDER BY fetched_at DESC, result_id DESC) = 1",
    "evidence_tier": """WITH v AS (SELECT o_custkey, o_orderpriority AS s, o_totalprice AS v, CASE o_orderstatus WHEN 'P' THEN 'month' WHEN 'F' THEN 'year' END AS p FROM orders),
d AS (SELECT o_custkey, s, median(v) AS med, count(DISTINCT p) AS np, list(DISTINCT p) FILTER (p IS NOT NULL) AS ps FROM v GROUP BY ALL),
m AS (SELECT o_custkey, count(*) AS sources, count(med) AS comparable, median(med) AS mm, max(med) AS hi, min(med) AS lo, bool_or(np > 1) AS amb, len(list_distinct(flatten(list(coalesce(ps, []))))) AS periods FROM d GROUP BY o_custkey),
x AS (SELECT *, CASE WHEN mm > 0 THEN greatest(hi - mm, mm - lo) / mm END AS spread FROM m)
SELECT o_custkey, CASE WHEN sources < 2 THEN 'Low' WHEN amb THEN NULL WHEN periods > 1 THEN NULL WHEN mm <= 0 THEN NULL WHEN spread > 0.5 THEN 'Low' WHEN sources = 2 THEN 'Medium' WHEN spread >= 0.25 THEN 'Medium' ELSE 'High' END AS tier,
CASE WHEN sources < 2 THEN 'fewer_than_two_domains' WHEN amb THEN 'ambiguous_period' WHEN periods > 1 THEN 'mixed_period' WHEN mm <= 0 THEN 'invalid_median' WHEN spread > 0.5 THEN 'source_disagreement' WHEN sources = 2 THEN 'two_domains' WHEN spread >= 0.25 THEN 'moderate_spread' ELSE 'three_plus_domains_agree' END AS reason,
sources, comparable, round(spread, 6) AS spread FROM x""",
    "score_total": f"SELECT l_orderkey, CAST(floor(0.0::DOUBLE + coalesce({_PART(1)}, 0)::DOUBLE * 0.35::DOUBLE + coalesce({_PART(2)}, 0)::DOUBLE * 0.3::DOUBLE + coalesce({_PART(3)}, 0)::DOUBLE * 0.2::DOUBLE + coalesce({_PART(4)}, 0)::DOUBLE * 0.15::DOUBLE + 0.5::DOUBLE) AS INT) AS total FROM lineitem GROUP BY l_orderkey",
    "retry_merge": """WITH a AS (SELECT l_orderkey, l_returnflag, CAST(l_partkey % 101 AS INT) AS score, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey % 101 DESC) AS rn, max(CAST(l_partkey % 101 AS INT)) OVER (PARTITION BY l_orderkey, l_returnflag) AS top FROM lineitem)
SELECT l_orderkey, l_returnflag, CASE WHEN l_returnflag = 'R' THEN top ELSE score END AS score FROM a WHERE rn = 1""",
    "interval_union": """WITH o AS (SELECT DISTINCT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS s, year(o_orderdate) * 12 + month(o_orderdate) - 1 + o_orderkey % 9 AS e FROM orders), d AS (SELECT * FROM o WHERE s < e),
w AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM d),
i AS (SELECT *, sum(CASE WHEN seen IS NULL OR s > seen THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM w),
k AS (SELECT o_custkey, island, max(e) - min(s) AS m FROM i GROUP BY ALL) SELECT o_custkey, count(*) AS islands, CAST(sum(m) AS BIGINT) AS months FROM k GROUP BY o_custkey""",
    "cost_rollup": r"""SELECT user_id, count(*) AS calls, round(sum(value), 2) AS cost, CAST(coalesce(sum(CASE WHEN regexp_matches(json_extract_string(props, '$.k'), '^-?[0-9]+$') THEN try_cast(json_extract_string(props, '$.k') AS BIGINT) END), 0) AS BIGINT) AS duration FROM events WHERE event_type = 'click' GROUP BY user_id""",
    "outcome_rates": "SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS bad, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS rate, count(*) FILTER (event_type = 'error') / count(*) > 0.25 AS failed FROM events GROUP BY user_id",
    "pair_delta": "WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) SELECT user_id, abs(a.n - b.n) AS delta FROM a FULL JOIN b USING (user_id)",
    "escape_markdown": r"""SELECT doc_id, regexp_replace(text, '([\\`*_{}\[\]<>()#+\-.!|])', '\\\1', 'g') AS escaped FROM documents""",
    "escape_html": "SELECT DISTINCT result_id, replace(replace(replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM search_results",
    "money": "SELECT o_orderkey, format('{:,}', CAST(trunc(o_totalprice) AS BIGINT)) AS price FROM orders",
}
