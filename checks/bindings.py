"""The store tables of the library, derived from the given tables.

Each table is one deterministic projection. Its column expressions are written once, in the SQL subset
that Spark and DuckDB share; only the source of the rows is stated for each engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXCLUDED = ("spam-farm.example.org", "cheap-pills.example.com")
PROVIDERS = (
    ("bing_rss", True, 10),
    ("bing_html", True, 20),
    ("yahoo_japan_html", True, 30),
    ("mojeek", False, 60),
)
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SYNONYMS = {
    "AUTOMOBILE": ("AUTOMOBILE", "the", "auto"),
    "the": ("AUTOMOBILE", "the", "auto"),
    "BUILDING": ("BUILDING", "er", "house"),
    "FURNITURE": ("FURNITURE", "zzz"),
}
SYNONYM_SQL = {  # first and second alternative of an industry
    "first": "CASE industry WHEN 'AUTOMOBILE' THEN 'the' WHEN 'BUILDING' THEN 'er' "
    "WHEN 'FURNITURE' THEN 'zzz' ELSE industry END",
    "second": "CASE industry WHEN 'AUTOMOBILE' THEN 'auto' WHEN 'BUILDING' THEN 'house' "
    "WHEN 'FURNITURE' THEN 'zzz' ELSE industry END",
}

_SEGMENT_NO = "CASE c_mktsegment " + " ".join(
    f"WHEN '{name}' THEN {number}" for number, name in enumerate(SEGMENTS)
) + " END"
_SEGMENT = "CASE {0} " + " ".join(
    f"WHEN {number} THEN '{name}'" for number, name in enumerate(SEGMENTS)
) + " END"
_CITY = "n_name || CASE n_nationkey % 3 WHEN 0 THEN '市' WHEN 1 THEN '区' ELSE '' END"
_DAY = "lpad(CAST(1 + page_id % 28 AS STRING), 2, '0') || ' 00:00:00'"


def _div(value: str, by: int) -> str:
    return f"CAST(floor({value} / {by}.0) AS BIGINT)"


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1))"
_EVENT_STATUS = (
    "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'completed' "
    "WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'pending' END"
)
_TS = "CAST(date_trunc('second', ts) AS TIMESTAMP)"

Columns = dict[str, str]
SOURCES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str, Columns]] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _binding(name: str, sql_source: str, columns: Columns):
    def register(source: Callable[[SparkSession, str], DataFrame]):
        SOURCES[name] = (source, sql_source, columns)
        return source

    return register


#: Number of pages as a column of ``source``; page ids run from 0.
_COUNTED = "(SELECT *, (SELECT count(*) FROM pages) AS n_pages FROM {0}) AS counted"


def _counted(spark: SparkSession, sf: str, source: str) -> DataFrame:
    return table(spark, sf, source).withColumn("n_pages", F.lit(table(spark, sf, "pages").count()))


def bound(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Store table as a Spark frame."""
    source, _, columns = SOURCES[name]
    return source(spark, sf).selectExpr(*[f"{text} AS {alias}" for alias, text in columns.items()])


def bound_sql(name: str) -> str:
    """Store table as the body of a DuckDB common table expression."""
    _, source, columns = SOURCES[name]
    listed = ", ".join(f"{text} AS {alias}" for alias, text in columns.items())
    return f"SELECT {listed} FROM {source}"


def with_tables(names: str, sql: str) -> str:
    """Put the named store tables, in dependency order, in front of a query."""
    parts = [f"{name} AS ({bound_sql(name)})" for name in names.split()]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[5:]}"
    return f"WITH {', '.join(parts)} {body}"


@_binding(
    "b_conditions",
    "(SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) c "
    "JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
    {
        "id": f"CAST(n_nationkey * 10 + {_SEGMENT_NO} AS BIGINT)",
        "prefecture": "r_name",
        "municipality": _CITY,
        "industry": "c_mktsegment",
        "max_results": "CAST(1 + n_nationkey % 5 AS BIGINT)",
        "enabled": "n_nationkey % 4 <> 0",
        "status": "CASE n_nationkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' "
        "ELSE 'completed' END",
    },
)
def _conditions(spark, sf):
    nations = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.expr("r_regionkey = n_regionkey")
    )
    wanted = table(spark, sf, "customer").select("c_nationkey", "c_mktsegment").distinct()
    return wanted.join(nations, F.expr("n_nationkey = c_nationkey"))


@_binding(
    "b_found",
    "(SELECT p.*, n.*, unnest([1, 2, 3]) AS k FROM pages p JOIN nation n "
    "ON n.n_nationkey = p.page_id % 25)",
    {
        "condition_id": f"CAST(n_nationkey * 10 + {_div('page_id % 50', 10)} AS BIGINT)",
        "query_id": f"CAST(n_nationkey * 10 + {_div('page_id % 50', 10)} AS BIGINT)",
        "query": f"{_CITY} || ' ' || " + _SEGMENT.format(_div("page_id % 50", 10)),
        "industry": _SEGMENT.format(_div("page_id % 50", 10)),
        "provider": "CASE k WHEN 1 THEN 'bing_rss' WHEN 2 THEN 'bing_html' "
        "ELSE 'yahoo_japan_html' END",
        "provider_no": "k",
        "rank": "CAST(1 + (page_id + 7 * k) % 20 AS BIGINT)",
        "pos": "page_id",
        "page_id": "page_id",
        "title": "regexp_extract(html, '<title>([^<]*)</title>', 1)",
        "snippet": _HOST,
        "url": "CASE k WHEN 1 THEN url "
        "WHEN 2 THEN upper(regexp_extract(url, '^[a-z]+://[^/?#]+', 0)) || "
        "substr(url, 1 + length(regexp_extract(url, '^[a-z]+://[^/?#]+', 0))) "
        "WHEN 3 THEN CASE WHEN instr(url, '?') > 0 OR instr(url, '#') > 0 THEN url "
        "ELSE url || '/' END END",
    },
)
def _found(spark, sf):
    pages = table(spark, sf, "pages").join(
        table(spark, sf, "nation"), F.expr("n_nationkey = page_id % 25")
    )
    return pages.select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))


@_binding(
    "b_queries",
    "(SELECT DISTINCT query_id, condition_id, query FROM b_found)",
    {"id": "query_id", "condition_id": "condition_id", "query": "query"},
)
def _queries(spark, sf):
    return bound(spark, sf, "b_found").select("query_id", "condition_id", "query").distinct()


@_binding(
    "b_results",
    "b_found",
    {
        "id": "page_id * 10 + provider_no",
        "query_id": "query_id",
        "url": "url",
        "provider": "provider",
        "rank": "rank",
        "title": "title",
        "relevance_score": "CAST(rank AS DOUBLE) / 4",
        "normalized_url": "CASE WHEN page_id % 2 = 0 THEN '' ELSE lower(url) END",
    },
)
def _results(spark, sf):
    return bound(spark, sf, "b_found")


@_binding(
    "b_pages",
    "pages",
    {
        "id": "page_id",
        "url": "url",
        "final_url": "split_part(url, '?', 1)",
        "http_status": "CASE page_id % 12 WHEN 6 THEN 403 WHEN 7 THEN 404 WHEN 8 THEN 429 "
        "WHEN 9 THEN 503 WHEN 10 THEN NULL WHEN 11 THEN NULL ELSE 200 END",
        "fetch_error": "CASE page_id % 12 WHEN 5 THEN 'prefetch_news' WHEN 10 THEN 'timeout' "
        "WHEN 11 THEN 'robots_denied' END",
        "processing_status": "CASE page_id % 12 WHEN 4 THEN 'excluded' WHEN 5 THEN 'excluded' "
        "WHEN 6 THEN 'http_403' WHEN 7 THEN 'http_404' WHEN 8 THEN 'http_429' "
        "WHEN 9 THEN 'http_503' WHEN 10 THEN 'timeout' WHEN 11 THEN 'robots_denied' "
        "ELSE 'success' END",
        "fetched_at": f"'2024-01-' || {_DAY}",
        "updated_at": f"'2024-02-' || {_DAY}",
    },
)
def _pages(spark, sf):
    return table(spark, sf, "pages")


@_binding(
    "b_companies",
    f"pages JOIN customer ON c_custkey = {_div('page_id', 2)} WHERE page_id % 12 <= 4",
    {
        "id": "page_id + 1000",
        "page_id": "page_id",
        "company_name": "c_name",
        "store_name": "CASE WHEN page_id % 3 = 0 THEN 'Store  ' || c_name END",
        "display_name": "CASE WHEN page_id % 5 = 0 THEN c_name END",
        "industry": "c_mktsegment",
        "custkey": "c_custkey",
        "nationkey": "c_nationkey",
    },
)
def _companies(spark, sf):
    pages = table(spark, sf, "pages").select("page_id").filter("page_id % 12 <= 4")
    return pages.join(table(spark, sf, "customer"), F.expr(f"c_custkey = {_div('page_id', 2)}"))


@_binding(
    "b_addresses",
    "(SELECT c.*, n.*, r.*, unnest([1, 2]) AS k FROM b_companies c "
    "JOIN nation n ON n_nationkey = nationkey JOIN region r ON r_regionkey = n_regionkey) "
    "WHERE k <= page_id % 3",
    {
        "id": "id * 10 + 9 - k",
        "company_id": "id",
        "address": "n_name || ' ' || CAST(custkey AS STRING) || '-' || CAST(k AS STRING)",
        "postal_code": "lpad(CAST(custkey % 1000 AS STRING), 3, '0') || '-0001'",
        "prefecture": "r_name",
        "municipality": "n_name",
    },
)
def _addresses(spark, sf):
    nations = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.expr("r_regionkey = n_regionkey")
    )
    companies = bound(spark, sf, "b_companies").join(nations, F.expr("n_nationkey = nationkey"))
    both = companies.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    return both.filter("k <= page_id % 3")


_MOBILE = "o_orderkey % 3 = 0"


@_binding(
    "b_phones",
    "orders",
    {
        "id": "o_orderkey",
        "company_id": "o_custkey * 2 + 1000",
        "number": f"CASE WHEN {_MOBILE} THEN '090' ELSE '03' END || '-' || "
        "lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') || '-' || "
        "lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')",
        "kind": f"CASE WHEN {_MOBILE} THEN 'mobile' ELSE 'fixed' END",
        "usage": "CASE o_orderpriority WHEN '1-URGENT' THEN 'emergency' WHEN '2-HIGH' THEN "
        "'reservation' WHEN '3-MEDIUM' THEN 'main' ELSE 'unknown' END",
        "pos": "o_orderkey",
    },
)
def _phones(spark, sf):
    return table(spark, sf, "orders")


@_binding(
    "b_scoring",
    "pages WHERE page_id % 12 <= 4",
    {
        "page_id": "page_id",
        "official_raw": "CAST(page_id * 37 % 2401 AS DOUBLE) / 20 - 10",
        "business_raw": "CAST(page_id * 53 % 241 AS DOUBLE) / 2 - 10",
        "official_score": "page_id * 37 % 101",
        "business_score": "page_id * 53 % 101",
        "is_official": "page_id * 37 % 101 >= 60",
        "is_business_target": "page_id * 37 % 101 >= 60 AND page_id * 53 % 101 >= 55",
        "review_required": "abs(page_id * 37 % 101 - 60) <= 8 OR abs(page_id * 53 % 101 - 55) <= 8",
        "reasons_text": "'r' || CAST(page_id % 3 AS STRING) || '|common'",
        "positive_text": "'phone|p' || CAST(page_id % 2 AS STRING)",
        "negative_text": "CASE WHEN page_id % 4 = 0 THEN 'article' ELSE '' END",
        "reasons_json": "'[\"r' || CAST(page_id % 3 AS STRING) || '\", \"common\"]'",
        "negative_signals_json": "CASE WHEN page_id % 24 = 4 THEN '[\"article\"]' END",
    },
)
def _scoring(spark, sf):
    return table(spark, sf, "pages").filter("page_id % 12 <= 4")


@_binding(
    "b_progress",
    "events",
    {
        "id": "event_id",
        "task_key": "'task-' || CAST(event_id AS STRING)",
        "status": _EVENT_STATUS,
        "available_at": f"CASE WHEN event_id % 3 = 0 THEN {_TS} END",
        "url": "'https://host' || CAST(user_id AS STRING) || '.example/' || event_type",
        "payload": "CASE WHEN event_id % 11 = 0 THEN '{\"candidate\": 1' ELSE "
        "'{\"candidate\": {\"url\": \"https://host' || CAST(user_id AS STRING) || "
        "'.example/' || event_type || '\", \"query\": \"q' || CAST(event_id % 7 AS STRING) || "
        "'\", \"provider\": \"bing_rss\", \"rank\": ' || CAST(1 + event_id % 20 AS STRING) || "
        "', \"title\": \"t\", \"snippet\": \"s\"}, \"condition\": {\"prefecture\": \"p\", "
        "\"municipality\": \"m\", \"industry\": \"' || CASE WHEN event_id % 13 = 0 THEN '' "
        "ELSE 'i' END || '\", \"max_results\": ' || CAST(event_id % 5 AS STRING) || "
        "', \"enabled\": true}, \"condition_id\": ' || CAST(user_id AS STRING) || "
        "', \"search_result_id\": ' || CAST(event_id AS STRING) || '}' END",
        "attempts": "CAST(event_id % 4 AS INT)",
        "last_error": "CASE WHEN event_type = 'error' THEN 'boom' END",
    },
)
def _progress(spark, sf):
    return table(spark, sf, "events")


@_binding(
    "b_errors",
    f"{_COUNTED.format('events')} WHERE event_type = 'error'",
    {
        "id": "event_id",
        "page_id": "CASE WHEN event_id % 2 = 0 THEN event_id % n_pages END",
        "progress_id": "event_id - 1",
        "error_type": "'kind' || CAST(event_id % 3 AS STRING)",
        "message": "'props ' || props",
        "created_at": "'2024-01-' || lpad(CAST(1 + event_id % 28 AS STRING), 2, '0')",
    },
)
def _errors(spark, sf):
    return _counted(spark, sf, "events").filter("event_type = 'error'")


@_binding(
    "b_requests",
    "events",
    {
        "run_id": "'run-' || CAST(user_id % 5 AS STRING)",
        "seq": "event_id",
        "domain": "'host' || CAST(user_id % 23 AS STRING)",
        "url": "'https://host' || CAST(user_id % 23 AS STRING) || '.example/'",
        "elapsed_seconds": "CAST(event_id AS DOUBLE) / 4",
        "error": "CASE WHEN event_id % 97 = 3 THEN 'robots_denied' END",
        "http_status": "CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 403 "
        "WHEN event_id % 83 = 5 THEN 429 ELSE 200 END",
        "redirect_repeat": "event_id % 89 = 7",
        "size_exceeded": "event_id % 79 = 11",
        "content_length": "CAST(value * 100 AS BIGINT)",
        "content_type": "CASE WHEN event_type = 'purchase' THEN 'application/pdf' "
        "ELSE 'Text/HTML; charset=utf-8' END",
        "captcha": "event_id % 101 = 13",
        "block": "event_id % 103 = 17",
    },
)
def _requests(spark, sf):
    return table(spark, sf, "events")


@_binding(
    "b_reviews",
    f"{_COUNTED.format('labels')} JOIN pages ON page_id = doc_id % n_pages",
    {
        "id": "doc_id",
        "url": "CASE WHEN doc_id % 3 = 0 THEN split_part(url, '?', 1) "
        "WHEN doc_id % 7 = 1 THEN 'https://unknown.example/' || CAST(doc_id % 9 AS STRING) "
        "ELSE url END",
        "company_name_judgment": "CASE WHEN quality = 1 THEN 'OK' ELSE 'NG' END",
        "store_name_judgment": "CASE WHEN toxic = 1 THEN 'NG' WHEN doc_id % 4 = 0 THEN '未確認' "
        "ELSE 'OK' END",
        "phone_judgment": "CASE WHEN doc_id % 5 = 0 THEN '要確認' WHEN doc_id % 5 = 1 THEN 'NG' "
        "ELSE 'OK' END",
        "address_judgment": "'未確認'",
        "industry_judgment": "CASE WHEN doc_id % 2 = 0 THEN 'OK' ELSE 'NG' END",
        "official_site_judgment": "CASE WHEN quality = 1 THEN 'OK' WHEN toxic = 1 THEN '要確認' "
        "ELSE 'NG' END",
        "business_target_judgment": "CASE WHEN doc_id % 3 = 1 THEN 'OK' ELSE 'NG' END",
        "overall_judgment": "'OK'",
        "note": "''",
    },
)
def _reviews(spark, sf):
    return _counted(spark, sf, "labels").join(
        table(spark, sf, "pages").select("page_id", "url"), F.expr("page_id = doc_id % n_pages")
    )


@_binding(
    "b_provider_audit",
    "events",
    {
        "id": "event_id",
        "run_id": "'run-' || CAST(user_id % 5 AS STRING)",
        "provider": "CASE user_id % 3 WHEN 0 THEN 'bing_rss' WHEN 1 THEN 'bing_html' "
        "ELSE 'yahoo_japan_html' END",
        "failure_type": "CASE event_type WHEN 'signup' THEN 'empty_results' WHEN 'error' THEN "
        "'timeout' END",
        "result_count": "CAST(floor(value) AS BIGINT) % 10",
        "accepted_count": "CAST(floor(value) AS BIGINT) % 10 % 4",
    },
)
def _provider_audit(spark, sf):
    return table(spark, sf, "events")


@_binding(
    "b_http_audit",
    "events",
    {
        "id": "event_id",
        "run_id": "'run-' || CAST(user_id % 5 AS STRING)",
        "requested_url": "'https://host' || CAST(user_id AS STRING) || '.example/'",
        "result_category": "CASE WHEN event_type = 'error' THEN 'timeout' ELSE 'html' END",
    },
)
def _http_audit(spark, sf):
    return table(spark, sf, "events")


def scoring_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Scoring table with native arrays."""
    rows = bound(spark, sf, "b_scoring")
    return rows.withColumns(
        {
            "reasons": F.split("reasons_text", r"\|"),
            "positive_signals": F.split("positive_text", r"\|"),
            "negative_signals": F.filter(F.split("negative_text", r"\|"), lambda s: s != ""),
        }
    )
