"""Markets, and the search results found for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import each, first_match

# Markets as country, currency and display name.
MARKETS = [
    ("CZ", "CZK", "Czech Republic"),
    ("SK", "EUR", "Slovakia"),
    ("PL", "PLN", "Poland"),
    ("HU", "HUF", "Hungary"),
    ("RO", "RON", "Romania"),
    ("BG", "BGN", "Bulgaria"),
    ("DE", "EUR", "Germany"),
    ("AT", "EUR", "Austria"),
    ("FR", "EUR", "France"),
    ("BE", "EUR", "Belgium"),
    ("NL", "EUR", "Netherlands"),
    ("LU", "EUR", "Luxembourg"),
    ("ES", "EUR", "Spain"),
    ("PT", "EUR", "Portugal"),
    ("IT", "EUR", "Italy"),
    ("IE", "EUR", "Ireland"),
    ("FI", "EUR", "Finland"),
    ("EE", "EUR", "Estonia"),
    ("LV", "EUR", "Latvia"),
    ("LT", "EUR", "Lithuania"),
    ("GR", "EUR", "Greece"),
    ("MT", "EUR", "Malta"),
    ("CY", "EUR", "Cyprus"),
    ("SI", "EUR", "Slovenia"),
    ("HR", "EUR", "Croatia"),
    ("CH", "CHF", "Switzerland"),
    ("GB", "GBP", "United Kingdom"),
    ("DK", "DKK", "Denmark"),
    ("NO", "NOK", "Norway"),
    ("SE", "SEK", "Sweden"),
    ("IS", "ISK", "Iceland"),
    ("US", "USD", "United States"),
    ("CA", "CAD", "Canada"),
    ("MX", "MXN", "Mexico"),
    ("BR", "BRL", "Brazil"),
    ("AR", "ARS", "Argentina"),
    ("AU", "AUD", "Australia"),
    ("NZ", "NZD", "New Zealand"),
    ("JP", "JPY", "Japan"),
    ("KR", "KRW", "South Korea"),
    ("CN", "CNY", "China"),
    ("HK", "HKD", "Hong Kong"),
    ("SG", "SGD", "Singapore"),
    ("IN", "INR", "India"),
    ("ID", "IDR", "Indonesia"),
    ("MY", "MYR", "Malaysia"),
    ("PH", "PHP", "Philippines"),
    ("TH", "THB", "Thailand"),
    ("VN", "VND", "Vietnam"),
    ("TR", "TRY", "Türkiye"),
    ("IL", "ILS", "Israel"),
    ("AE", "AED", "United Arab Emirates"),
    ("SA", "SAR", "Saudi Arabia"),
    ("ZA", "ZAR", "South Africa"),
    ("EG", "EGP", "Egypt"),
    ("UA", "UAH", "Ukraine"),
]
MONTHLY = ["CZK", "PLN", "HUF", "RON", "BGN"]
ALIASES = {"UK": "GB"}
DOMAIN_PRIORITY = ["platy.cz", "profesia.cz", "glassdoor", "levels.fyi"]
CZ_PLACE = r"(?:^|[^\p{L}\p{N}_])(?:czech|cz|praha|prague|brno|ostrava)(?:[^\p{L}\p{N}_]|$)"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)"
TOP = 8


def resolve_markets(detected: DataFrame) -> DataFrame:
    """(cv_id, country, country_name, currency, period, provenance): the stated country, else CZ by place, else XX in USD a year.

    The market list is fixed (56 rows).  Redelivered rows count once; null countries and places are allowed.
    """
    spark: SparkSession = detected.sparkSession
    dim = F.broadcast(spark.createDataFrame(MARKETS, "country string, currency string, country_name string"))
    code = F.upper(F.trim("detected_country"))
    for a, b in ALIASES.items():
        code = F.when(code == a, F.lit(b)).otherwise(code)
    rows = detected.select("cv_id", code.alias("stated"), F.lower(F.col("detected_location")).rlike(CZ_PLACE).alias("czech")).distinct()
    known = dim.select(F.col("country").alias("stated"), F.lit(True).alias("known"))
    rows = rows.join(known, "stated", "left").withColumn("country", F.when(F.col("known"), F.col("stated")).when(F.col("czech"), "CZ").otherwise("XX"))
    rows = rows.withColumn("provenance", F.when(F.col("known"), "cv_explicit").when(F.col("czech"), "inferred").otherwise("default"))
    rows = rows.join(dim, "country", "left").withColumn("currency", F.coalesce("currency", F.lit("USD")))
    return rows.select("cv_id", "country", "country_name", "currency", F.when(F.col("currency").isin(MONTHLY), "month").otherwise("year").alias("period"), "provenance")


def host(url: Column) -> Column:
    """The network part of a URL, port and user included; null when there is none."""
    return F.nullif(F.regexp_extract(url, HOST, 1), F.lit(""))


def domain(url: Column) -> Column:
    """The host in lower case without a leading www."""
    return F.regexp_replace(F.lower(F.trim(host(url))), r"^www\.", "")


def tld(d: Column) -> Column:
    """'.' and the last label; a domain without a dot is its own label; '(empty)' for blank."""
    return F.when(d.isNull() | (F.trim(d) == ""), "(empty)").when(F.instr(d, ".") > 0, F.concat(F.lit("."), F.substring_index(d, ".", -1))).otherwise(d)


def top_sources(results: DataFrame, markets: DataFrame, k: int = TOP) -> DataFrame:
    """(cv_id, rn, result_id, href, domain): per CV the first k results, one a URL; in the Czech market preferred domains come first.

    Results stand in the order of their query and rank.  Of several with a URL the first stands; results without a
    host are left out.  markets: cv_id, country; a CV without one keeps the search's order.  k is the feature: the
    report keeps k sources.
    """
    r = results.where("cv_id is not null").select("cv_id", "query_ord", "rank_no", "result_id", "href").distinct().withColumn("domain", domain(F.col("href"))).where("domain is not null")
    first = F.min(F.struct("query_ord", "rank_no", "result_id"))
    once = r.groupBy("cv_id", "href", "domain").agg(first.alias("m")).select("cv_id", "href", "domain", "m.*")
    czech = markets.where("country = 'CZ'").select("cv_id", F.lit(True).alias("czech")).distinct()
    prefer = F.lit(len(DOMAIN_PRIORITY))
    for i, d in reversed(list(enumerate(DOMAIN_PRIORITY))):
        prefer = F.when(F.instr(F.col("domain"), d) > 0, F.lit(i)).otherwise(prefer)
    once = once.join(czech, "cv_id", "left").withColumn("prefer", F.when(F.col("czech"), prefer).otherwise(F.lit(0)))
    w = Window.partitionBy("cv_id").orderBy("prefer", "query_ord", "rank_no", "result_id")
    return once.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("cv_id", "rn", "result_id", "href", "domain")


def source_outcome(top: DataFrame, cvs: DataFrame, failures: DataFrame) -> DataFrame:
    """(cv_id, sources, outcome): 'ok' from two sources on; with fewer 'rate_limit' if all query failures are of that type, 'query_failures' if others are among them, else 'insufficient'.

    failures: cv_id, exc_type.
    """
    n = top.groupBy("cv_id").agg(F.count("*").alias("sources"))
    f = failures.groupBy("cv_id").agg(F.count("*").alias("_f"), F.count_if(F.col("exc_type") == "RatelimitException").alias("_r"))
    out = cvs.select("cv_id").distinct().join(n, "cv_id", "left").join(f, "cv_id", "left").withColumn("sources", F.coalesce("sources", F.lit(0)))
    outcome = F.when(F.col("sources") >= 2, "ok").when(F.col("_f").isNull(), "insufficient").when(F.col("_f") == F.col("_r"), "rate_limit").otherwise("query_failures")
    return out.select("cv_id", "sources", outcome.alias("outcome"))


MOST_QUERIES = 5


def build_queries(profiles: DataFrame, year: int = 2026) -> DataFrame:
    """(cv_id, query_ord, query): up to five search queries of each profile, in order.

    profiles: cv_id, canonical_role, detected_role, detected_location, years, management, country, country_name,
    currency.  Null texts count as blank, null years as 0.  Repeated profiles give repeated rows.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    y, years = F.lit(str(year)), F.coalesce("years", F.lit(0))
    canonical, location = blank("canonical_role"), blank("detected_location")
    role = F.when(canonical != "", canonical).when(blank("detected_role") != "", blank("detected_role")).otherwise(F.lit("data scientist"))
    named = blank("country_name")
    words = lambda *parts: F.array_join(F.filter(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts]), lambda p: p != ""), " ")
    leads = F.coalesce(F.col("management"), F.lit(False)) & (canonical != "")
    # A location that is only blanks leaves its place empty; a missing one takes the market's default.
    city = F.when(F.coalesce(F.col("detected_location"), F.lit("")) == "", F.lit("Praha")).otherwise(location)
    place = F.when(location != "", location).otherwise(named)
    cz, xx = F.col("country") == "CZ", F.col("country") == "XX"
    by_market = lambda a, b, c: F.when(cz, a).when(xx, b).otherwise(c)
    manager = F.when(leads, by_market(words(canonical, "manager salary", city, "CZK", y), words(canonical, "manager salary USD", y), words(canonical, "manager salary", place, F.col("currency"), y)))
    senior = F.when(years >= 10, F.when(cz, words("senior", role, "salary EUR Europe", y)).otherwise(words("senior", role, "salary", named, F.col("currency"), y)))
    local = [
        by_market(F.concat(role, F.lit(" salary "), city, F.lit(" site:platy.cz")), words(role, "salary USD", y), words(role, "salary", place, F.col("currency"), y)),
        by_market(F.concat(role, F.lit(" salary "), city, F.lit(" site:profesia.cz")), words(role, "compensation USD", y), F.when(named != "", words(role, named, "compensation", y)).otherwise(words(role, "salary", F.col("currency"), y))),
        F.when(cz, words(role, "mzda CZK", y)),
        F.when(cz & ~(leads & (years >= 10)), words(role, "salary czech republic site:glassdoor.com")),
    ]
    rows = profiles.select("cv_id", F.slice(F.array_compact(F.array(manager, *local, senior)), 1, MOST_QUERIES).alias("q"))
    return each(rows, ["cv_id"], F.col("q"), "query", "query_ord")


def gather_results(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(cv_id, result_ord, query_ord, rank_no, result_id): a CV's results in the order of its queries and then of their ranks; queries without results give none.

    queries: cv_id, query_ord; results: cv_id, query_ord, rank_no, result_id.  Redelivered results count once.
    """
    r = results.select("cv_id", "query_ord", "rank_no", "result_id").distinct().join(queries.select("cv_id", "query_ord").distinct(), ["cv_id", "query_ord"])
    w = Window.partitionBy("cv_id").orderBy("query_ord", "rank_no", "result_id")
    return r.select("cv_id", F.row_number().over(w).alias("result_ord"), "query_ord", "rank_no", "result_id")


# Words of a query and the cassette that answers it, in order; the last answers all others.
CASSETTES = [
    ("manager|head of|vedouc", "senior_manager_prague"), ("junior|data analyst", "junior_data_analyst_prague"), ("machine learning engineer", "staff_mle_prague"),
    ("data scientist", "data_scientist_prague"), ("", "generic_cz_data"),
]


def cassette_key(query: Column) -> Column:
    return first_match(F.lower(query), CASSETTES)


def tld_histogram(results: DataFrame) -> DataFrame:
    return results.select("result_id", tld(domain(F.col("href"))).alias("tld")).distinct().groupBy("tld").agg(F.count("*").alias("n"))


def latest_per_query(results: DataFrame, ttl_days: int | None = None, now: Column | None = None) -> DataFrame:
    """Search cache as a table: per stripped query and rank the row fetched last (ties: the highest id).

    With `ttl_days` and `now`, rows that old have expired.
    """
    if ttl_days is not None:
        results = results.where(F.col("fetched_at") > now - F.expr(f"interval {int(ttl_days)} days"))
    # A maximum instead of a window: partial results shrink a hot query before the shuffle.
    last = F.max(F.struct("fetched_at", "result_id"))
    return results.groupBy(F.trim("query_text").alias("q"), "rank_no").agg(last.alias("m")).select("q", "rank_no", "m.result_id")
