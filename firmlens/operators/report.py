"""Live report: candidate and exclusion listings, audit scans, provider and search totals, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions.text import iso_duration
from firmlens.functions.urls import legacy_normalized_url
from firmlens.operators.review import OPEN

# Report headers and sheet names, in display order.
CANDIDATE_HEADERS = (
    "法人名", "店舗名", "電話番号", "住所", "推定業種", "公式スコア", "営業対象スコア",
    "抽出元", "判定理由", "元ページURL", "検索順位", "手動確認欄", "誤抽出メモ欄",
)
EXCLUSION_HEADERS = (
    "URL", "検索クエリ", "Provider", "検索順位", "タイトル", "除外理由", "関連性スコア"
)
SEARCH_HEADERS = ("URL", "検索クエリ", "Provider", "順位", "タイトル")
REVIEW_HEADERS = (
    "URL", "法人名判定", "店舗名判定", "電話番号判定", "住所判定", "業種判定",
    "公式サイト判定", "営業対象判定", "総合判定", "メモ",
)
LIVE_SHEETS = (
    "採用候補", "要確認", "除外", "HTTP監査", "Provider監査", "検索結果", "エラー", "検証概要"
)


def candidate_rows(rows: DataFrame) -> DataFrame:
    """Thirteen review columns of export rows."""
    signals = F.concat_ws(
        "; ", F.nullif("positive_signals", F.lit("")), F.nullif("negative_signals", F.lit(""))
    )
    values = (
        F.col("company_name"), F.col("store_name"), F.col("all_phone_numbers"), F.col("address"),
        F.col("estimated_industry"), F.col("official_score"), F.col("business_score"),
        F.col("source_url"), signals, F.col("source_url"), F.col("search_rank"), F.lit(OPEN),
        F.lit(""),
    )
    return rows.select(*[value.alias(name) for value, name in zip(values, CANDIDATE_HEADERS)])


def review_template(rows: DataFrame) -> DataFrame:
    """One open review line per export row."""
    first, *judgments, note = REVIEW_HEADERS
    return rows.select(
        F.col("source_url").alias(first), *[F.lit(OPEN).alias(name) for name in judgments],
        F.lit("").alias(note),
    )


def audit_scan(audit: DataFrame, run_id: str = "") -> DataFrame:
    """Audit rows of one run, or of all runs, in id order."""
    kept = audit.filter(F.col("run_id") == run_id) if run_id else audit
    return kept.orderBy("id")


def _searched(results: DataFrame, queries: DataFrame) -> DataFrame:
    return results.join(queries.select(F.col("id").alias("query_id"), "query"), "query_id")


def search_rows(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Search listing in result order."""
    listed = _searched(results, queries).orderBy("id")
    fields = ("url", "query", "provider", "rank", "title")
    return listed.select(*[F.col(name).alias(head) for name, head in zip(fields, SEARCH_HEADERS)])


def exclusion_rows(
    results: DataFrame, queries: DataFrame, pages: DataFrame, scoring: DataFrame
) -> DataFrame:
    """Search results whose page was excluded, with the reason on record.

    Only excluded pages reach the join; page and score rows are unique per key.
    """
    excluded = pages.filter(F.col("processing_status") == "excluded").select(
        F.col("id").alias("page_id"), "url", "fetch_error"
    )
    texts = scoring.select("page_id", "negative_signals_json", "reasons_json")
    described = excluded.join(texts, "page_id", "left")
    reason = F.coalesce(
        "fetch_error", "negative_signals_json", "reasons_json", F.lit("excluded")
    )
    joined = _searched(results.join(described, "url"), queries).withColumn("_reason", reason)
    fields = ("url", "query", "provider", "rank", "title", "_reason", "relevance_score")
    return joined.orderBy("id").select(
        *[F.col(name).alias(head) for name, head in zip(fields, EXCLUSION_HEADERS)]
    )


def provider_summary(audit: DataFrame) -> DataFrame:
    """Executions, successes, failures and counts of each provider, first seen first."""
    fine = F.col("failure_type").isNull() | (F.col("failure_type") == "empty_results")
    return audit.groupBy("provider").agg(
        F.count("*").alias("executions"),
        F.count_if(fine).alias("successes"),
        F.count_if(~fine).alias("failures"),
        F.sum("result_count").alias("results"),
        F.sum("accepted_count").alias("accepted"),
        F.min("id").alias("first_id"),
    )


def merge_key() -> Column:
    stored = F.col("normalized_url")
    return F.when(stored == "", legacy_normalized_url(F.col("url"))).otherwise(
        legacy_normalized_url(stored)
    )


def search_totals(results: DataFrame) -> DataFrame:
    """All results, distinct merge keys, and the duplicates between providers."""
    per_url = results.groupBy(merge_key().alias("_key")).agg(F.count("*").alias("_n"))
    total, unique = F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")
    return per_url.agg(
        total.alias("total_results"), unique.alias("unique_urls"),
        (total - unique).alias("cross_provider_duplicates"),
    )


def provider_fetch_counts(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct result urls with a page that was not excluded, for all providers in one pass."""
    fetched = pages.filter(F.col("processing_status") != "excluded").select("url")
    pairs = results.select("provider", "url").distinct()
    return (
        pairs.join(fetched, "url", "left_semi")
        .groupBy("provider")
        .agg(F.count("*").alias("fetch_count"))
    )


def live_summary(
    rows: DataFrame,
    results: DataFrame,
    queries: DataFrame,
    conditions: DataFrame,
    pages: DataFrame,
    http_audit: DataFrame,
    provider_audit: DataFrame,
    runs: DataFrame,
    accuracy: DataFrame,
    generated_at: Column,
    run_id: str = "",
    provider_run_id: str = "",
) -> DataFrame:
    """Metric and value rows of the report; every input is reduced to a few rows before the union."""

    def pairs(df: DataFrame, named: dict[str, Column]) -> DataFrame:
        items = [
            F.struct(F.lit(label).alias("metric"), value.cast("string").alias("value"))
            for label, value in named.items()
        ]
        return df.select(F.inline(F.array(*items)))

    http = http_audit.filter(F.col("run_id") == run_id) if run_id else http_audit
    audit = (
        provider_audit.filter(F.col("run_id") == provider_run_id)
        if provider_run_id
        else provider_audit
    )
    condition_text = F.concat_ws(" ", "prefecture", "municipality", "industry")
    condition = conditions.agg(F.max_by(condition_text, "id").alias("v"))
    query = queries.agg(F.max_by("query", "id").alias("v"))
    last_run = runs.filter(F.col("command") == "live-check").agg(
        F.max("started_at").alias("s"), F.max_by("finished_at", "started_at").alias("f")
    )
    filled = F.coalesce
    counted = rows.agg(
        F.count_if(F.col("processing_status") == "robots_denied").alias("denied"),
        F.count_if("is_official").alias("official"),
        F.count_if("is_business_target").alias("targets"),
        F.count_if(F.col("mobile_phones") != "").alias("mobile"),
        F.count_if(F.col("fixed_phones") != "").alias("fixed"),
        F.count_if(F.col("all_phone_numbers") == "").alias("no_phone"),
        F.count_if("review_required").alias("review"),
        F.count_if(~F.col("is_business_target")).alias("excluded"),
        F.count_if(F.col("error_message") != "").alias("errors"),
    )
    blank = F.lit("")
    per_provider = provider_summary(audit).join(
        provider_fetch_counts(results, pages), "provider", "left"
    )
    provider_items = [
        F.struct(
            F.concat(F.lit("Provider "), F.col("provider"), F.lit(f" {label}")).alias("metric"),
            filled(F.col(name), F.lit(0)).cast("string").alias("value"),
        )
        for label, name in (
            ("実行回数", "executions"), ("成功回数", "successes"), ("失敗回数", "failures"),
            ("検索結果件数", "results"), ("重複除外後件数", "accepted"),
            ("HTTP取得対象件数", "fetch_count"),
        )
    ]
    parts = [
        pairs(condition, {"検索条件": filled("v", blank)}),
        pairs(query, {"検索クエリ": filled("v", blank)}),
        pairs(
            search_totals(results),
            {
                "検索結果延べ件数": F.col("total_results"),
                "発見URL数": F.col("total_results"),
                "ユニークURL件数": F.col("unique_urls"),
                "Provider横断重複数": F.col("cross_provider_duplicates"),
            },
        ),
        pairs(http.agg(F.count("*").alias("n")), {"HTTP取得数": F.col("n")}),
        pairs(
            counted,
            {
                "robots拒否数": F.col("denied"),
                "公式候補数": F.col("official"),
                "営業対象数": F.col("targets"),
                "携帯番号取得数": F.col("mobile"),
                "固定電話取得数": F.col("fixed"),
                "電話番号なし数": F.col("no_phone"),
                "要確認数": F.col("review"),
                "除外数": F.col("excluded"),
                "エラー数": F.col("errors"),
            },
        ),
        pairs(
            last_run,
            {
                "開始時刻": filled("s", blank),
                "終了時刻": filled("f", blank),
                "総実行時間": iso_duration(F.col("s"), F.col("f")),
                "生成時刻": generated_at,
            },
        ),
        pairs(
            accuracy,
            {
                "レビュー件数": F.col("review_count"),
                "電話番号正解率": F.col("phone_accuracy"),
                "公式サイトprecision": F.col("official_precision"),
                "営業対象precision": F.col("business_precision"),
                "false positive件数": F.col("false_positive_count"),
                "false negative件数": F.col("false_negative_count"),
                "統計的に十分": F.col("statistically_sufficient"),
            },
        ),
        per_provider.select(F.inline(F.array(*provider_items))),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked
