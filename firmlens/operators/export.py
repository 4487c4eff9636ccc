"""Export rows: joined base, entity de-duplication, category partitions, display cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions.text import csv_cell, entity_text_key, search_history
from firmlens.functions.urls import export_url_key
from firmlens.operators.ordered import join_text
from firmlens.session import cut_lineage

# Columns of an export row with their display headers, in display order.
HEADERS = {
    "id": "ID",
    "company_name": "法人名",
    "store_name": "店舗名",
    "display_name": "表示名",
    "search_industry": "検索業種",
    "estimated_industry": "推定業種",
    "primary_phone": "電話番号",
    "mobile_phones": "携帯電話番号",
    "fixed_phones": "固定電話番号",
    "all_phone_numbers": "全電話番号",
    "phone_usages": "電話番号用途",
    "postal_code": "郵便番号",
    "prefecture": "都道府県",
    "municipality": "市区町村",
    "address": "住所",
    "official_url": "公式HP",
    "source_url": "情報取得ページ",
    "search_prefecture": "検索都道府県",
    "search_municipality": "検索市区町村",
    "search_word": "検索ワード",
    "search_query": "検索クエリ",
    "search_provider": "検索Provider",
    "search_rank": "検索順位",
    "official_score": "公式サイトスコア",
    "business_score": "営業対象スコア",
    "is_official": "公式サイト判定",
    "is_business_target": "営業対象判定",
    "review_required": "要確認",
    "exclusion_reasons": "除外理由",
    "positive_signals": "加点理由",
    "negative_signals": "減点理由",
    "http_status": "HTTPステータス",
    "processing_status": "処理状態",
    "error_message": "エラーメッセージ",
    "duplicate_candidate": "重複候補",
    "all_search_conditions": "全検索条件",
    "fetched_at": "取得日時",
    "last_checked_at": "最終確認日時",
}
# CSV files and workbook partitions by category.
CSV_FILES = {
    "collected_companies": "business_targets",
    "all_results": "all_results",
    "mobile_only": "mobile_only",
    "no_phone": "no_phone",
    "review_required": "review_required",
    "excluded": "excluded",
    "errors": "errors",
}
SHEETS = {
    "営業対象": "business_targets",
    "携帯あり": "mobile_only",
    "要確認": "review_required",
    "電話なし": "no_phone",
    "除外": "excluded",
    "エラー": "errors",
    "全件": "sales",
    "検索履歴": "all_results",
}
SEPARATOR = " | "


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def first_addresses(addresses: DataFrame) -> DataFrame:
    """Earliest address of each company."""
    fields = F.struct("address", "postal_code", "prefecture", "municipality")
    first = addresses.groupBy("company_id").agg(F.min_by(fields, "id").alias("_a"))
    return first.select("company_id", "_a.*")


def phone_lists(phones: DataFrame) -> DataFrame:
    """Phone texts of each company in id order: primary, mobile, fixed, all, usages."""
    listed = phones.groupBy("company_id").agg(
        F.array_sort(F.collect_list(F.struct("id", "number", "kind", "usage"))).alias("_p")
    )

    def numbers(kind: str | None = None) -> Column:
        kept = F.col("_p") if kind is None else F.filter("_p", lambda p: p["kind"] == kind)
        return F.array_join(F.transform(kept, lambda p: p["number"]), SEPARATOR)

    usages = F.transform("_p", lambda p: F.concat(p["number"], F.lit(":"), p["usage"]))
    return listed.select(
        "company_id",
        F.col("_p")[0]["number"].alias("primary_phone"),
        numbers("mobile").alias("mobile_phones"),
        numbers("fixed").alias("fixed_phones"),
        numbers().alias("all_phone_numbers"),
        F.array_join(usages, SEPARATOR).alias("phone_usages"),
    )


def page_errors(errors: DataFrame) -> DataFrame:
    """All error messages of a page in id order."""
    message = F.concat(F.col("error_type"), F.lit(": "), F.col("message"))
    listed = (
        errors.filter(F.col("page_id").isNotNull())
        .groupBy("page_id")
        .agg(F.array_sort(F.collect_list(F.struct("id", message.alias("text")))).alias("_e"))
    )
    texts = F.transform("_e", lambda item: item["text"])
    return listed.select("page_id", F.array_join(texts, SEPARATOR).alias("error_message"))


def export_base(
    results: DataFrame,
    queries: DataFrame,
    conditions: DataFrame,
    pages: DataFrame,
    companies: DataFrame,
    addresses: DataFrame,
    phones: DataFrame,
    scoring: DataFrame,
    errors: DataFrame,
) -> DataFrame:
    """Display-ready row per search result, before de-duplication.

    Every right-hand side has one row per join key, so the result keeps exactly the search results. A
    url or company shared by many results is a skewed left side only, which adaptive execution splits.
    """
    searched = queries.select(
        F.col("id").alias("query_id"), "condition_id", F.col("query").alias("search_query")
    ).join(
        conditions.select(
            F.col("id").alias("condition_id"),
            F.col("prefecture").alias("search_prefecture"),
            F.col("municipality").alias("search_municipality"),
            F.col("industry").alias("search_industry"),
        ),
        "condition_id",
    )
    page_side = pages.select(
        F.col("id").alias("page_id"), "url", "final_url", "http_status", "processing_status",
        "fetch_error", "fetched_at", "updated_at",
    )
    listed_companies = companies.select(
        F.col("id").alias("company_id"), "page_id", "company_name", "store_name", "display_name",
        F.col("industry").alias("estimated_industry"),
    )
    score_side = scoring.select(
        "page_id", "official_score", "business_score", "is_official", "is_business_target",
        "review_required", "reasons", F.col("positive_signals").alias("_positive"),
        F.col("negative_signals").alias("_negative"),
    )
    # First everything keyed by company, then everything keyed by page, then the urls: each side is
    # shuffled once per key.
    company_side = listed_companies.join(first_addresses(addresses), "company_id", "left").join(
        phone_lists(phones), "company_id", "left"
    )
    details = (
        page_side.join(company_side, "page_id", "left")
        .join(score_side, "page_id", "left")
        .join(page_errors(errors), "page_id", "left")
    )
    joined = (
        results.select("id", "query_id", "url", "provider", "rank")
        .join(searched, "query_id")
        .join(details, "url", "left")
    )
    none = F.array().cast("array<string>")
    negative = F.coalesce("_negative", none)
    target = F.coalesce("is_business_target", F.lit(False))
    reasons = F.array_join(F.concat(F.coalesce("reasons", none), negative), SEPARATOR)
    exclusion = F.coalesce(
        F.nullif("fetch_error", F.lit("")), F.when(~target, reasons).otherwise("")
    )
    texts = (
        "company_name", "store_name", "display_name", "search_industry", "estimated_industry",
        "primary_phone", "mobile_phones", "fixed_phones", "all_phone_numbers", "phone_usages",
        "postal_code", "prefecture", "municipality", "address",
    )
    return joined.select(
        "id", *[_text(name).alias(name) for name in texts],
        _text("url").alias("official_url"),
        F.coalesce(F.nullif("final_url", F.lit("")), F.col("url")).alias("source_url"),
        _text("search_prefecture").alias("search_prefecture"),
        _text("search_municipality").alias("search_municipality"),
        _text("search_industry").alias("search_word"),
        _text("search_query").alias("search_query"),
        _text("provider").alias("search_provider"),
        F.col("rank").cast("int").alias("search_rank"),
        "official_score", "business_score",
        F.coalesce("is_official", F.lit(False)).alias("is_official"),
        target.alias("is_business_target"),
        F.coalesce("review_required", F.lit(False)).alias("review_required"),
        exclusion.alias("exclusion_reasons"),
        F.array_join(F.coalesce("_positive", none), SEPARATOR).alias("positive_signals"),
        F.array_join(negative, SEPARATOR).alias("negative_signals"),
        F.col("http_status").cast("int").alias("http_status"),
        _text("processing_status").alias("processing_status"),
        _text("error_message").alias("error_message"),
        _text("fetched_at").alias("fetched_at"),
        _text("updated_at").alias("last_checked_at"),
    )


def orphan_errors(errors: DataFrame, progress: DataFrame) -> DataFrame:
    """Errors without a page as export rows, described by the payload of their task."""
    tasks = progress.select(F.col("id").alias("progress_id"), "payload")
    joined = errors.filter(F.col("page_id").isNull()).join(tasks, "progress_id", "left")

    def of_candidate(field: str) -> Column:
        return F.get_json_object("payload", f"$.candidate.{field}")

    blank = F.lit("")
    missing = F.expr("CAST(NULL AS INT)")
    values = {name: blank for name in HEADERS}
    url = F.coalesce(of_candidate("url"), blank)
    values |= {
        "id": -F.col("id"),
        "official_url": url,
        "source_url": url,
        "search_query": F.coalesce(of_candidate("query"), blank),
        "search_provider": F.coalesce(of_candidate("provider"), blank),
        "search_rank": of_candidate("rank").try_cast("int"),
        "official_score": missing,
        "business_score": missing,
        "http_status": missing,
        "is_official": F.lit(False),
        "is_business_target": F.lit(False),
        "review_required": F.lit(False),
        "duplicate_candidate": F.lit(False),
        "exclusion_reasons": _text("message"),
        "processing_status": _text("error_type"),
        "error_message": F.concat(F.col("error_type"), F.lit(": "), F.col("message")),
        "fetched_at": _text("created_at"),
        "last_checked_at": _text("created_at"),
    }
    return joined.select(*[values[name].alias(name) for name in HEADERS])


def _entities(rows: DataFrame) -> DataFrame:
    """One row per URL key: size, first id, joined distinct histories, keys of its representative.

    Repeated histories of a key collapse on the map side, so a key with most of the rows is spread over
    all tasks until only its distinct histories are left.
    """
    traits = F.struct(
        entity_text_key(F.col("company_name")).alias("name"),
        entity_text_key(F.col("address")).alias("address"),
        F.col("primary_phone").alias("phone"),
    )
    per_history = rows.groupBy("_url_key", "_history").agg(
        F.count("*").alias("_n"), F.min("id").alias("_id"), F.min_by(traits, "id").alias("_t")
    )
    listed = F.array_sort(F.collect_list(F.struct("_id", "_history")))
    joined = F.array_join(F.transform(listed, lambda item: item["_history"]), SEPARATOR)
    entities = per_history.groupBy("_url_key").agg(
        F.sum("_n").alias("_n"), F.min("_id").alias("_first_id"),
        F.min_by("_t", "_id").alias("_t"), joined.alias("_histories"),
    )
    return entities.select("_url_key", "_n", "_first_id", "_histories", "_t.*")


def deduplicate(base: DataFrame) -> DataFrame:
    """Annotate export rows with duplicate_candidate, all_search_conditions and is_sales_row.

    Rows of one URL key form an entity represented by the smallest id. Representatives with the same
    name and address merge into the first one; the same name and phone is only flagged. The rows and the entity table
    are written to the checkpoint folder once because several steps read them; all groups are judged by plain
    aggregates joined back, never by a window over a group.
    """
    keyed = base.withColumns(
        {
            "_url_key": export_url_key(F.col("official_url")),
            "_history": search_history(
                F.col("search_prefecture"), F.col("search_municipality"), F.col("search_word"),
                F.col("search_query"),
            ),
        }
    )
    rows = cut_lineage(keyed)
    entities = cut_lineage(_entities(rows))
    place, contact = ["name", "address"], ["name", "phone"]
    located = entities.filter((F.col("name") != "") & (F.col("address") != ""))
    shared = (
        located.groupBy(*place)
        .agg(F.count("*").alias("_members"), F.min("_first_id").alias("_keeper"))
        .filter(F.col("_members") > 1)
    )
    members = located.join(shared, place).select("_url_key", "_first_id", "_keeper", "_histories")
    combined = join_text(members, ["_keeper"], "_first_id", "_histories", "_combined")
    merged = members.select("_url_key", "_first_id", "_keeper").join(
        combined.select(F.col("_keeper").alias("_first_id"), "_combined"), "_first_id", "left"
    )
    reachable = entities.filter((F.col("name") != "") & (F.col("phone") != ""))
    same = reachable.groupBy(*contact).agg(F.count("*").alias("_sharing")).filter("_sharing > 1")
    by_phone = reachable.join(same, contact, "left_semi").select(
        "_url_key", F.lit(True).alias("_same_phone")
    )
    facts = (
        entities.select("_url_key", "_n", "_first_id", "_histories")
        .join(merged.drop("_first_id"), "_url_key", "left")
        .join(by_phone, "_url_key", "left")
    )
    marked = rows.drop("_history").join(facts, "_url_key")
    first = F.col("id") == F.col("_first_id")
    grouped = F.col("_keeper").isNotNull() | F.col("_same_phone").isNotNull()
    removed = F.col("_keeper").isNotNull() & (F.col("_keeper") != F.col("id"))
    return marked.withColumns(
        {
            "duplicate_candidate": (F.col("_n") > 1) | (first & grouped),
            "all_search_conditions": F.coalesce(
                F.when(first, F.col("_combined")), F.col("_histories")
            ),
            "is_sales_row": first & ~removed,
        }
    ).select(*HEADERS, "is_sales_row")


def error_rows(annotated: DataFrame, orphans: DataFrame) -> DataFrame:
    """Rows with an error message, then the errors without a page."""
    own = annotated.filter(F.col("error_message") != "").select(*HEADERS)
    return own.unionByName(orphans)


def category_tests() -> dict[str, Column]:
    """Membership test of every category over annotated rows."""
    sales, target = F.col("is_sales_row"), F.col("is_business_target")
    return {
        "all_results": F.lit(True),
        "sales": sales,
        "business_targets": sales & target,
        "mobile_only": sales & (F.col("mobile_phones") != ""),
        "no_phone": sales & (F.col("all_phone_numbers") == ""),
        "review_required": sales & F.col("review_required"),
        "excluded": sales & ~target,
        "errors": F.col("error_message") != "",
    }


def categorized(annotated: DataFrame, orphans: DataFrame) -> DataFrame:
    """Every export row once per category it belongs to, in one pass over the snapshot."""
    names = F.array_compact(
        F.array(*[F.when(test, F.lit(name)) for name, test in category_tests().items()])
    )
    own = annotated.withColumn("category", F.explode(names)).select("category", *HEADERS)
    return own.unionByName(orphans.select(F.lit("errors").alias("category"), *HEADERS))


def category_rows(annotated: DataFrame, orphans: DataFrame, category: str) -> DataFrame:
    """Rows of one export category."""
    if category == "errors":
        return error_rows(annotated, orphans)
    return annotated.filter(category_tests()[category]).select(*HEADERS)


def csv_rows(rows: DataFrame) -> DataFrame:
    """Display cells under the display headers."""
    kinds = dict(rows.dtypes)
    return rows.select(
        *[csv_cell(F.col(name), kinds[name]).alias(header) for name, header in HEADERS.items()]
    )


def sheet_rows(rows: DataFrame) -> DataFrame:
    """Display cells of a named dataset: the same whole cells as in a CSV file."""
    return csv_rows(rows)
