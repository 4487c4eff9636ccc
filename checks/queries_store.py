"""Export, status, reviews and reports over the store tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.bindings import bound, scoring_frame, table, with_tables
from checks.registry import check
from checks.sql_text import ENTITY
from firmlens.operators import export, report, review, status
from firmlens.plans.export import Store, export_snapshot, live_sheets
from firmlens.session import checkpoint_dir, cut_lineage
from firmlens.sinks import exports

_TABLES = "b_conditions b_found b_queries b_results b_pages b_companies b_addresses b_phones b_scoring b_errors b_progress"
_FLAGS = ("is_official", "is_business_target", "review_required")

_BASE = f"""
fa AS (SELECT company_id, arg_min(address, id) AS address, arg_min(postal_code, id) AS postal_code,
    arg_min(prefecture, id) AS prefecture, arg_min(municipality, id) AS municipality
  FROM b_addresses GROUP BY company_id),
ph AS (SELECT company_id, arg_min(number, id) AS primary_phone,
    coalesce(string_agg(number, ' | ' ORDER BY id) FILTER (kind = 'mobile'), '') AS mobile_phones,
    coalesce(string_agg(number, ' | ' ORDER BY id) FILTER (kind = 'fixed'), '') AS fixed_phones,
    string_agg(number, ' | ' ORDER BY id) AS all_phone_numbers,
    string_agg(number || ':' || usage, ' | ' ORDER BY id) AS phone_usages
  FROM b_phones GROUP BY company_id),
er AS (SELECT page_id, string_agg(error_type || ': ' || message, ' | ' ORDER BY id) AS error_message
  FROM b_errors WHERE page_id IS NOT NULL GROUP BY page_id),
base AS (SELECT r.id, coalesce(company_name, '') AS company_name, coalesce(store_name, '') AS store_name,
    coalesce(display_name, '') AS display_name, c.industry AS search_industry,
    coalesce(co.industry, '') AS estimated_industry, coalesce(primary_phone, '') AS primary_phone,
    coalesce(mobile_phones, '') AS mobile_phones, coalesce(fixed_phones, '') AS fixed_phones,
    coalesce(all_phone_numbers, '') AS all_phone_numbers, coalesce(phone_usages, '') AS phone_usages,
    coalesce(fa.postal_code, '') AS postal_code, coalesce(fa.prefecture, '') AS prefecture,
    coalesce(fa.municipality, '') AS municipality, coalesce(fa.address, '') AS address,
    r.url AS official_url, coalesce(p.final_url, r.url) AS source_url,
    c.prefecture AS search_prefecture, c.municipality AS search_municipality,
    c.industry AS search_word, q.query AS search_query, r.provider AS search_provider,
    r.rank AS search_rank, s.official_score, s.business_score,
    coalesce(s.is_official, FALSE) AS is_official,
    coalesce(s.is_business_target, FALSE) AS is_business_target,
    coalesce(s.review_required, FALSE) AS review_required,
    coalesce(p.fetch_error, CASE WHEN coalesce(s.is_business_target, FALSE) OR s.page_id IS NULL THEN ''
      ELSE replace(reasons_text, '|', ' | ') || CASE WHEN negative_text = '' THEN ''
        ELSE ' | ' || negative_text END END) AS exclusion_reasons,
    coalesce(replace(positive_text, '|', ' | '), '') AS positive_signals,
    coalesce(negative_text, '') AS negative_signals, p.http_status,
    coalesce(p.processing_status, '') AS processing_status,
    coalesce(er.error_message, '') AS error_message, coalesce(p.fetched_at, '') AS fetched_at,
    coalesce(p.updated_at, '') AS last_checked_at
  FROM b_results r JOIN b_queries q ON q.id = r.query_id JOIN b_conditions c ON c.id = q.condition_id
  LEFT JOIN b_pages p ON p.url = r.url LEFT JOIN b_companies co ON co.page_id = p.id
  LEFT JOIN fa ON fa.company_id = co.id LEFT JOIN ph ON ph.company_id = co.id
  LEFT JOIN b_scoring s ON s.page_id = p.id LEFT JOIN er ON er.page_id = p.id)"""

_DEDUP = f"""{_BASE},
k AS (SELECT *, {ENTITY.format('official_url')} AS url_key, search_prefecture || '/'
    || search_municipality || '/' || search_word || ' [' || search_query || ']' AS history FROM base),
hd AS (SELECT url_key, history, min(id) AS f FROM k GROUP BY ALL),
hs AS (SELECT url_key, string_agg(history, ' | ' ORDER BY f) AS histories FROM hd GROUP BY url_key),
g AS (SELECT url_key, count(*) AS n, min(id) AS first_id FROM k GROUP BY url_key),
a AS (SELECT k.*, n, first_id, histories, lower(replace(company_name, ' ', '')) AS nk,
    lower(replace(address, ' ', '')) AS ak FROM k JOIN g USING (url_key) JOIN hs USING (url_key)),
reps AS (SELECT * FROM a WHERE id = first_id),
place AS (SELECT nk, ak, min(id) AS keeper FROM reps WHERE nk <> '' AND ak <> '' GROUP BY nk, ak
  HAVING count(*) > 1),
pm AS (SELECT r.id, keeper, histories FROM reps r JOIN place p ON p.nk = r.nk AND p.ak = r.ak),
cd AS (SELECT keeper, histories, min(id) AS f FROM pm GROUP BY keeper, histories),
cs AS (SELECT keeper, string_agg(histories, ' | ' ORDER BY f) AS combined FROM cd GROUP BY keeper),
sp AS (SELECT nk, primary_phone FROM reps WHERE nk <> '' AND primary_phone <> ''
  GROUP BY nk, primary_phone HAVING count(*) > 1),
sm AS (SELECT r.id FROM reps r JOIN sp ON sp.nk = r.nk AND sp.primary_phone = r.primary_phone),
annotated AS (SELECT a.* EXCLUDE (url_key, history, n, first_id, histories, nk, ak),
    n > 1 OR pm.keeper IS NOT NULL OR sm.id IS NOT NULL AS duplicate_candidate,
    coalesce(cs.combined, a.histories) AS all_search_conditions,
    a.id = first_id AND (pm.keeper IS NULL OR pm.keeper = a.id) AS is_sales_row
  FROM a LEFT JOIN pm ON pm.id = a.id LEFT JOIN cs ON cs.keeper = a.id LEFT JOIN sm ON sm.id = a.id)"""


def store(spark: SparkSession, sf: str) -> Store:
    companies = bound(spark, sf, "b_companies")
    return Store(
        conditions=bound(spark, sf, "b_conditions"),
        queries=bound(spark, sf, "b_queries"),
        results=bound(spark, sf, "b_results"),
        pages=bound(spark, sf, "b_pages"),
        companies=companies,
        addresses=bound(spark, sf, "b_addresses"),
        phones=bound(spark, sf, "b_phones"),
        scoring=scoring_frame(spark, sf),
        errors=bound(spark, sf, "b_errors"),
        progress=bound(spark, sf, "b_progress"),
    )


def _base(tables: Store) -> DataFrame:
    return export.export_base(
        tables.results, tables.queries, tables.conditions, tables.pages, tables.companies,
        tables.addresses, tables.phones, tables.scoring, tables.errors,
    )


@check("export_base", with_tables(_TABLES, f"WITH {_BASE} SELECT * FROM base"))
def _export_base(spark, sf):
    return _base(store(spark, sf))


@check("export_rows", with_tables(_TABLES, f"WITH {_DEDUP} SELECT * FROM annotated"))
def _export_rows(spark, sf):
    return export_snapshot(store(spark, sf))[0]


_ORPHANS = """SELECT -e.id AS id, coalesce(p.url, '') AS official_url,
  coalesce(CASE WHEN p.id IS NULL THEN '' ELSE 'q' || CAST(p.id % 7 AS STRING) END, '') AS search_query,
  coalesce(CASE WHEN p.id IS NULL THEN '' ELSE 'bing_rss' END, '') AS search_provider,
  CASE WHEN p.id IS NOT NULL THEN 1 + p.id % 20 END AS search_rank,
  e.error_type AS processing_status, e.error_type || ': ' || message AS error_message,
  message AS exclusion_reasons, created_at AS fetched_at
FROM b_errors e LEFT JOIN (SELECT * FROM b_progress WHERE id % 11 <> 0) p ON p.id = e.progress_id
WHERE e.page_id IS NULL"""


@check("orphan_errors", with_tables("b_errors b_progress", _ORPHANS))
def _orphans(spark, sf):
    rows = export.orphan_errors(bound(spark, sf, "b_errors"), bound(spark, sf, "b_progress"))
    return rows.select(
        "id", "official_url", "search_query", "search_provider", "search_rank", "processing_status",
        "error_message", "exclusion_reasons", "fetched_at",
    )


_PARTS = {
    "all_results": "TRUE",
    "business_targets": "is_sales_row AND is_business_target",
    "mobile_only": "is_sales_row AND mobile_phones <> ''",
    "no_phone": "is_sales_row AND all_phone_numbers = ''",
    "review_required": "is_sales_row AND review_required",
    "excluded": "is_sales_row AND NOT is_business_target",
    "sales": "is_sales_row",
    "errors": "error_message <> ''",
}


@check(
    "export_categories",
    with_tables(
        _TABLES,
        f"WITH {_DEDUP} "
        + " UNION ALL ".join(
            f"SELECT '{name}' AS category, id FROM annotated WHERE {test}"
            for name, test in _PARTS.items()
        )
        + " UNION ALL SELECT 'errors', -id FROM b_errors WHERE page_id IS NULL",
    ),
)
def _categories(spark, sf):
    annotated, orphans = export_snapshot(store(spark, sf))
    return export.categorized(annotated, orphans).select("category", "id")


@check(
    "csv_cells",
    with_tables(
        _TABLES,
        f"""WITH {_DEDUP} SELECT CAST(id AS VARCHAR) AS "ID", company_name AS "法人名",
  coalesce(CAST(official_score AS VARCHAR), '') AS "公式サイトスコア",
  CASE WHEN is_official THEN 'はい' ELSE 'いいえ' END AS "公式サイト判定",
  CASE WHEN duplicate_candidate THEN 'はい' ELSE 'いいえ' END AS "重複候補",
  all_search_conditions AS "全検索条件" FROM annotated""",
    ),
)
def _cells(spark, sf):
    annotated, _ = export_snapshot(store(spark, sf))
    cells = export.csv_rows(annotated.drop("is_sales_row"))
    return cells.select(
        "ID", "法人名", "公式サイトスコア", "公式サイト判定", "重複候補", "全検索条件"
    )


_TODAY = "2024-01-10"


@check(
    "status_snapshot",
    with_tables(
        "b_conditions b_scoring b_phones b_companies b_progress b_errors b_pages",
        f"""SELECT metric, CAST(value AS VARCHAR) AS value FROM (
SELECT 'total_conditions' AS metric, CAST(count(*) AS VARCHAR) AS value FROM b_conditions
UNION ALL SELECT status || '_conditions', CAST(count(*) AS VARCHAR) FROM b_conditions GROUP BY status
UNION ALL SELECT 'business_targets', CAST(count(*) FILTER (is_business_target) AS VARCHAR) FROM b_scoring
UNION ALL SELECT 'official_sites', CAST(count(*) FILTER (is_official) AS VARCHAR) FROM b_scoring
UNION ALL SELECT 'review_required', CAST(count(*) FILTER (review_required) AS VARCHAR) FROM b_scoring
UNION ALL SELECT 'excluded', CAST(count(*) FILTER (NOT is_business_target) AS VARCHAR) FROM b_scoring
UNION ALL SELECT 'mobile_phones', CAST(count(*) AS VARCHAR) FROM b_phones WHERE kind = 'mobile'
UNION ALL SELECT 'no_phone_companies', CAST(count(*) AS VARCHAR) FROM b_companies c
  WHERE NOT EXISTS (SELECT 1 FROM b_phones p WHERE p.company_id = c.id)
UNION ALL SELECT 'retry_waiting', CAST(count(*) AS VARCHAR) FROM b_progress
  WHERE status = 'pending' AND available_at IS NOT NULL
UNION ALL SELECT 'next_retry_at', strftime(min(available_at), '%Y-%m-%d %H:%M:%S') FROM b_progress
  WHERE status = 'pending' AND available_at IS NOT NULL
UNION ALL SELECT 'running_urls', CAST(count(*) AS VARCHAR) FROM b_progress
  WHERE status = 'running' AND id % 11 <> 0
UNION ALL SELECT 'errors', CAST(count(*) AS VARCHAR) FROM b_errors
UNION ALL SELECT 'pages_today', CAST(count(*) FILTER (left(fetched_at, 10) = '{_TODAY}') AS VARCHAR)
  FROM b_pages
UNION ALL SELECT 'pages_total', CAST(count(*) AS VARCHAR) FROM b_pages)""",
    ),
)
def _status(spark, sf):
    tables = store(spark, sf)
    return status.status_snapshot(
        tables.conditions, tables.scoring, tables.phones, tables.companies, tables.progress,
        tables.errors, tables.pages, F.lit(_TODAY).cast("date"),
    )


@check(
    "running_urls",
    with_tables(
        "b_progress", "SELECT id, url FROM b_progress WHERE status = 'running' AND id % 11 <> 0"
    ),
)
def _running(spark, sf):
    return status.running_urls(bound(spark, sf, "b_progress"))


_LATEST = """latest AS (SELECT * FROM b_reviews QUALIFY row_number() OVER (
  PARTITION BY url ORDER BY id DESC) = 1)"""
_REVIEWED = f"""{_LATEST}, j AS (SELECT l.*, is_official, is_business_target, review_required
  FROM latest l LEFT JOIN b_pages p ON p.url = l.url OR p.final_url = l.url
  LEFT JOIN b_scoring s ON s.page_id = p.id)"""


@check(
    "latest_reviews",
    with_tables("b_reviews", f"WITH {_LATEST} SELECT id, url, phone_judgment FROM latest"),
)
def _latest(spark, sf):
    return review.latest_reviews(bound(spark, sf, "b_reviews")).select("id", "url", "phone_judgment")


def _sql_rate(field: str, on: str = "TRUE") -> str:
    return (
        f"count(*) FILTER ({field} = 'OK' AND {on}) / "
        f"nullif(count(*) FILTER ({field} IN ('OK', 'NG') AND {on}), 0)"
    )


_ACCURACY = f"""{_REVIEWED}, acc AS (SELECT count(*) AS review_count,
  {_sql_rate('company_name_judgment')} AS company_name_accuracy,
  {_sql_rate('store_name_judgment')} AS store_name_accuracy,
  {_sql_rate('phone_judgment')} AS phone_accuracy,
  {_sql_rate('address_judgment')} AS address_accuracy,
  {_sql_rate('industry_judgment')} AS industry_accuracy,
  {_sql_rate('official_site_judgment', 'is_official')} AS official_precision,
  {_sql_rate('business_target_judgment', 'is_business_target')} AS business_precision,
  count(*) FILTER (is_business_target AND business_target_judgment = 'NG') AS false_positive_count,
  count(*) FILTER (NOT is_business_target AND business_target_judgment = 'OK')
    AS false_negative_count,
  count(*) FILTER (review_required) / count(*) AS review_required_rate,
  count(*) >= 30 AS statistically_sufficient FROM j)"""


def _accuracy(spark: SparkSession, sf: str) -> DataFrame:
    joined = review.reviewed_scores(
        bound(spark, sf, "b_reviews"), bound(spark, sf, "b_pages"), scoring_frame(spark, sf)
    )
    return review.review_accuracy(joined)


@check(
    "reviewed_scores",
    with_tables(
        "b_reviews b_pages b_scoring",
        f"WITH {_REVIEWED} SELECT id, url, is_official, is_business_target, review_required FROM j",
    ),
)
def _reviewed(spark, sf):
    joined = review.reviewed_scores(
        bound(spark, sf, "b_reviews"), bound(spark, sf, "b_pages"), scoring_frame(spark, sf)
    )
    return joined.select("id", "url", *_FLAGS)


@check(
    "review_accuracy",
    with_tables(
        "b_reviews b_pages b_scoring",
        f"""WITH {_ACCURACY} SELECT *, coalesce(phone_accuracy >= 0.95 AND official_precision >= 0.9
  AND business_precision >= 0.9 AND statistically_sufficient, FALSE) AS accepted FROM acc""",
    ),
)
def _review_accuracy(spark, sf):
    return review.acceptance(_accuracy(spark, sf))


_PROVIDER_SUMMARY = """ps AS (SELECT provider, count(*) AS executions,
  count(*) FILTER (failure_type IS NULL OR failure_type = 'empty_results') AS successes,
  count(*) FILTER (failure_type IS NOT NULL AND failure_type <> 'empty_results') AS failures,
  CAST(sum(result_count) AS BIGINT) AS results, CAST(sum(accepted_count) AS BIGINT) AS accepted,
  min(id) AS first_id FROM b_provider_audit GROUP BY provider)"""


@check(
    "provider_summary",
    with_tables("b_provider_audit", f"WITH {_PROVIDER_SUMMARY} SELECT * FROM ps"),
)
def _provider_summary(spark, sf):
    return report.provider_summary(bound(spark, sf, "b_provider_audit"))


_TOTALS = """tot AS (SELECT count(*) AS total_results, count(DISTINCT CASE WHEN normalized_url = ''
  THEN lower(rtrim(url, '/')) ELSE lower(rtrim(normalized_url, '/')) END) AS unique_urls FROM b_results)"""


@check(
    "search_totals",
    with_tables(
        "b_found b_results",
        f"WITH {_TOTALS} SELECT *, total_results - unique_urls AS cross_provider_duplicates FROM tot",
    ),
)
def _totals(spark, sf):
    return report.search_totals(bound(spark, sf, "b_results"))


_FETCHED = """fc AS (SELECT provider, count(DISTINCT r.url) AS fetch_count FROM b_results r
  JOIN b_pages p ON p.url = r.url WHERE p.processing_status <> 'excluded' GROUP BY provider)"""


@check(
    "provider_fetch_counts",
    with_tables("b_found b_results b_pages", f"WITH {_FETCHED} SELECT * FROM fc"),
)
def _fetch_counts(spark, sf):
    return report.provider_fetch_counts(bound(spark, sf, "b_results"), bound(spark, sf, "b_pages"))


@check(
    "exclusion_listing",
    with_tables(
        "b_found b_queries b_results b_pages b_scoring",
        """SELECT r.url AS "URL", q.query AS "検索クエリ", provider AS "Provider", rank AS "検索順位",
  title AS "タイトル", coalesce(fetch_error, negative_signals_json, reasons_json, 'excluded')
    AS "除外理由", relevance_score AS "関連性スコア"
FROM b_results r JOIN b_queries q ON q.id = r.query_id JOIN b_pages p ON p.url = r.url
LEFT JOIN b_scoring s ON s.page_id = p.id WHERE processing_status = 'excluded'""",
    ),
)
def _exclusions(spark, sf):
    return report.exclusion_rows(
        bound(spark, sf, "b_results"), bound(spark, sf, "b_queries"), bound(spark, sf, "b_pages"),
        bound(spark, sf, "b_scoring"),
    )


@check(
    "search_listing",
    with_tables(
        "b_found b_queries b_results",
        """SELECT r.url AS "URL", q.query AS "検索クエリ", provider AS "Provider", rank AS "順位",
  title AS "タイトル" FROM b_results r JOIN b_queries q ON q.id = r.query_id""",
    ),
)
def _listing(spark, sf):
    return report.search_rows(bound(spark, sf, "b_results"), bound(spark, sf, "b_queries"))


@check(
    "candidate_listing",
    with_tables(
        _TABLES,
        f"""WITH {_DEDUP} SELECT company_name AS "法人名", store_name AS "店舗名",
  all_phone_numbers AS "電話番号", address AS "住所", estimated_industry AS "推定業種",
  official_score AS "公式スコア", business_score AS "営業対象スコア", source_url AS "抽出元",
  positive_signals || CASE WHEN negative_signals <> '' THEN '; ' || negative_signals ELSE '' END
    AS "判定理由", source_url AS "元ページURL", search_rank AS "検索順位", '未確認' AS "手動確認欄",
  '' AS "誤抽出メモ欄" FROM annotated WHERE is_sales_row AND is_business_target""",
    ),
)
def _candidates(spark, sf):
    annotated, orphans = export_snapshot(store(spark, sf))
    return report.candidate_rows(export.category_rows(annotated, orphans, "business_targets"))


@check(
    "review_template",
    with_tables(
        _TABLES,
        f"""WITH {_BASE} SELECT source_url AS "URL", '未確認' AS "法人名判定", '未確認' AS "店舗名判定",
  '未確認' AS "電話番号判定", '未確認' AS "住所判定", '未確認' AS "業種判定",
  '未確認' AS "公式サイト判定", '未確認' AS "営業対象判定", '未確認' AS "総合判定", '' AS "メモ"
FROM base""",
    ),
)
def _template(spark, sf):
    return report.review_template(_base(store(spark, sf)))


@check(
    "audit_scan",
    with_tables("b_http_audit", "SELECT * FROM b_http_audit WHERE run_id = 'run-2'"),
)
def _scan(spark, sf):
    return report.audit_scan(bound(spark, sf, "b_http_audit"), "run-2")


_LIVE_SUMMARY = with_tables(
        f"{_TABLES} b_provider_audit b_http_audit b_reviews",
        f"""WITH {_DEDUP}, {_TOTALS}, {_PROVIDER_SUMMARY}, {_FETCHED}, {_ACCURACY},
p AS (SELECT ps.*, coalesce(fetch_count, 0) AS fetch_count FROM ps LEFT JOIN fc USING (provider)),
lc AS (SELECT arg_max(prefecture || ' ' || municipality || ' ' || industry, id) AS v FROM b_conditions),
lq AS (SELECT arg_max(query, id) AS v FROM b_queries),
runs AS (SELECT strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS s, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS f,
  date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) AS d FROM events),
n AS (SELECT count(*) FILTER (processing_status = 'robots_denied') AS denied,
  count(*) FILTER (is_official) AS official, count(*) FILTER (is_business_target) AS targets,
  count(*) FILTER (mobile_phones <> '') AS mobile, count(*) FILTER (fixed_phones <> '') AS fixed,
  count(*) FILTER (all_phone_numbers = '') AS none, count(*) FILTER (review_required) AS review,
  count(*) FILTER (NOT is_business_target) AS excluded,
  count(*) FILTER (error_message <> '') AS errors FROM annotated)
SELECT '検索条件' AS metric, v AS value FROM lc
UNION ALL SELECT '検索クエリ', v FROM lq
UNION ALL SELECT unnest(['検索結果延べ件数', '発見URL数', 'ユニークURL件数', 'Provider横断重複数']),
  CAST(unnest([total_results, total_results, unique_urls, total_results - unique_urls]) AS VARCHAR)
  FROM tot
UNION ALL SELECT 'HTTP取得数', CAST(count(*) AS VARCHAR) FROM b_http_audit WHERE run_id = 'run-1'
UNION ALL SELECT unnest(['robots拒否数', '公式候補数', '営業対象数', '携帯番号取得数', '固定電話取得数',
  '電話番号なし数', '要確認数', '除外数', 'エラー数']),
  CAST(unnest([denied, official, targets, mobile, fixed, none, review, excluded, errors]) AS VARCHAR)
  FROM n
UNION ALL SELECT unnest(['開始時刻', '終了時刻', '総実行時間', '生成時刻']), unnest([s, f,
  CASE WHEN d >= 172800 THEN CAST(d // 86400 AS VARCHAR) || ' days, ' WHEN d >= 86400 THEN '1 day, '
    ELSE '' END || CAST(d % 86400 // 3600 AS VARCHAR) || ':'
  || lpad(CAST(d % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(d % 60 AS VARCHAR), 2, '0'),
  'now']) FROM runs
UNION ALL SELECT unnest(['レビュー件数', 'false positive件数', 'false negative件数']),
  CAST(unnest([review_count, false_positive_count, false_negative_count]) AS VARCHAR) FROM acc
UNION ALL SELECT '統計的に十分', CAST(statistically_sufficient AS VARCHAR) FROM acc
UNION ALL SELECT 'Provider ' || provider || ' ' || unnest(['実行回数', '成功回数', '失敗回数',
  '検索結果件数', '重複除外後件数', 'HTTP取得対象件数']),
  CAST(unnest([executions, successes, failures, results, accepted, fetch_count]) AS VARCHAR) FROM p""",
    )


@check("live_summary", _LIVE_SUMMARY)
def _live_summary(spark, sf):
    tables = store(spark, sf)
    annotated = cut_lineage(export_snapshot(tables)[0])
    moment = "yyyy-MM-dd'T'HH:mm:ss"
    runs = table(spark, sf, "events").agg(
        F.lit("live-check").alias("command"),
        F.date_format(F.min("ts"), moment).alias("started_at"),
        F.date_format(F.max("ts"), moment).alias("finished_at"),
    )
    summary = report.live_summary(
        annotated, tables.results, tables.queries, tables.conditions, tables.pages,
        bound(spark, sf, "b_http_audit"), bound(spark, sf, "b_provider_audit"), runs,
        _accuracy(spark, sf), F.lit("now"), run_id="run-1",
    )
    # Rates are compared as numbers in review_accuracy; their text form differs between engines.
    rates = ("電話番号正解率", "公式サイトprecision", "営業対象precision")
    return summary.filter(~F.col("metric").isin(*rates))


@check("published_report", _LIVE_SUMMARY)
def _published_report(spark, sf):
    tables = store(spark, sf)
    annotated, orphans = export_snapshot(tables)
    moment = "yyyy-MM-dd'T'HH:mm:ss"
    runs = table(spark, sf, "events").agg(
        F.lit("live-check").alias("command"),
        F.date_format(F.min("ts"), moment).alias("started_at"),
        F.date_format(F.max("ts"), moment).alias("finished_at"),
    )
    sheets = live_sheets(
        tables, annotated, orphans, bound(spark, sf, "b_http_audit"), bound(spark, sf, "b_provider_audit"),
        bound(spark, sf, "b_reviews"), runs, F.lit("now"), run_id="run-1",
    )
    folder = f"{checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    exports.publish_sheets(sheets, folder)
    rates = ("電話番号正解率", "公式サイトprecision", "営業対象precision")
    return exports.read_published(spark, folder, "検証概要").filter(~F.col("metric").isin(*rates))


@check(
    "audit_appends",
    with_tables("b_http_audit", "SELECT run_id, count(*) AS entries, sum(id) AS ids FROM b_http_audit GROUP BY run_id"),
)
def _audit_appends(spark, sf):
    audit = bound(spark, sf, "b_http_audit")
    path = f"{checkpoint_dir(spark)}/audit-{uuid.uuid4().hex}"
    for part in (0, 1, 0):
        exports.append_audit(audit.filter(F.col("id") % 2 == part), path, f"part {part}")
    return spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("entries"), F.sum("id").alias("ids"))

