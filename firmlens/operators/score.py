"""Explainable additive scores: official site, business target, decision."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.dims import INDUSTRY_KEYWORDS, ScoringRules
from firmlens.functions.text import bounded_score, contains_any, mentions, ordered_distinct
from firmlens.functions.urls import hostname
from firmlens.operators.domains import domain_exclusion
from firmlens.operators.extract import footer_and_small_text
from firmlens.operators.page_type import with_page_type
from firmlens.operators.pages import BUSINESS_TYPES, external_hosts, page_text

# Evidence patterns, and penalties by page type as (signal, reason).
COMPANY_PAGE = ("会社概要", "法人概要", "運営会社", "販売業者")
CONTACT_PAGE = ("お問い合わせ", "問合せ", "contact")
ACCESS_PAGE = ("アクセス", "交通案内", "access")
RANKING_WORDS = ("ランキング", "まとめ")
RANKING = r"(?U)おすすめ\s*\d+選"
COMPANY_MENTION = r"(?U)株式会社[\w一-龯ぁ-んァ-ヶー]{1,30}"
PAGE_PENALTIES = {
    "job": ("job", "求人ページの特徴"),
    "article": ("article", "記事ページの特徴"),
    "portal": ("portal", "ポータルページの特徴"),
    "directory": ("portal", "電話帳・一覧ページの特徴"),
}
BUSINESS_PAGES = ("official_home", "store", "company")

_SIGNAL = "array<struct<signal:string,weight:double,reason:string>>"


def _signal(condition: Column, signal: str, weight: float, reason: str) -> Column:
    return F.when(
        F.coalesce(condition, F.lit(False)),
        F.struct(
            F.lit(signal).alias("signal"), F.lit(weight).alias("weight"),
            F.lit(reason).alias("reason"),
        ),
    )


def _total(signals: Column) -> Column:
    return F.aggregate(signals, F.lit(0.0), lambda total, item: total + item["weight"])


def _names(signals: Column, field: str = "signal") -> Column:
    return F.transform(signals, lambda item: item[field])


def distinct_companies(text: Column) -> Column:
    """Number of different company names mentioned in a text."""
    found = F.regexp_extract_all(text, F.lit(COMPANY_MENTION), F.lit(0))
    return F.size(F.array_distinct(found))


def official_signals(rules: ScoringRules) -> Column:
    """Evidence list in fixed order; needs extraction, context, page_type and domain columns."""
    weights = rules.official
    text, lowered = F.col("_text"), F.col("_lowered")

    def add(condition: Column, signal: str, reason: str) -> Column:
        return _signal(condition, signal, weights[signal], reason)

    types = F.flatten(F.transform("jsonld", lambda item: item["types"]))
    business = F.array(*[F.lit(name) for name in BUSINESS_TYPES])
    terms = F.concat(F.array("search_industry"), F.col("_industry_keywords"))
    industry_match = F.exists(terms, lambda term: (term != "") & F.contains(text, term))
    industry_match = F.coalesce(industry_match, F.lit(False))
    region_match = F.coalesce(
        (F.col("search_prefecture") != "") & F.contains(text, F.col("search_prefecture"))
        & (F.col("search_municipality") != "") & F.contains(text, F.col("search_municipality")),
        F.lit(False),
    )
    other_industry = F.col("industry.value").isNotNull() & ~F.col("industry.value").eqNullSafe(
        F.col("search_industry")
    )
    other_region = F.col("address").isNotNull() & ~F.col("address.prefecture").eqNullSafe(
        F.col("search_prefecture")
    )
    company = F.col("company_name.value")
    penalties = [
        _signal(F.col("page_type") == kind, signal, weights[signal], reason)
        for kind, (signal, reason) in PAGE_PENALTIES.items()
    ]
    external = F.size(external_hosts(hostname(F.col("url"))))
    signals = F.array(
        add(F.size("phones") > 0, "phone", "電話番号を確認"),
        add(F.col("address").isNotNull(), "address", "住所を確認"),
        add(F.col("_has_identity"), "identity", "法人名または店舗名を確認"),
        add(
            F.arrays_overlap(types, business), "structured_business",
            "事業者の構造化データを確認",
        ),
        add(contains_any(text, COMPANY_PAGE), "company_page", "会社概要情報を確認"),
        add(contains_any(lowered, CONTACT_PAGE), "contact_page", "お問い合わせ導線を確認"),
        add(contains_any(lowered, ACCESS_PAGE), "access_page", "アクセス情報を確認"),
        add(industry_match, "industry_match", "検索業種とページ内容が一致"),
        add(
            ~industry_match & other_industry, "industry_mismatch",
            "検索業種と抽出業種が不一致",
        ),
        add(region_match, "region_match", "検索地域とページ内容が一致"),
        add(
            ~region_match & other_region, "region_mismatch",
            "検索地域と抽出住所が不一致",
        ),
        add(
            ~F.col("domain_excluded") & (F.col("host") != ""), "own_domain",
            "除外対象でないサイトドメイン",
        ),
        add(
            (company != "") & F.contains(F.col("_small_print"), company),
            "copyright_match", "copyrightと法人名が一致",
        ),
        *penalties,
        add(mentions(text, RANKING_WORDS, RANKING), "ranking", "ランキング・まとめ表現を確認"),
        add(
            distinct_companies(text) >= rules.multiple_companies, "multiple_companies",
            "複数企業の一覧掲載を確認",
        ),
        add(
            external >= rules.many_external_links, "many_external_links",
            "外部サイトへのリンクが大量",
        ),
    )
    return F.array_compact(signals).cast(_SIGNAL)


# Signals that lower the score.
NEGATIVE_SIGNALS = (
    "industry_mismatch",
    "region_mismatch",
    "job",
    "article",
    "portal",
    "ranking",
    "multiple_companies",
    "many_external_links",
)


def business_signals(rules: ScoringRules) -> Column:
    weights = rules.business

    def add(condition: Column, signal: str, weight: str, reason: str) -> Column:
        return _signal(condition, signal, weights[weight], reason)

    mobile = F.exists("phones", lambda phone: phone["kind"] == "mobile")
    signals = F.array(
        add(F.size("phones") > 0, "business_phone", "phone", "営業連絡可能な電話番号"),
        add(mobile, "business_mobile", "mobile_phone", "携帯電話を確認"),
        add(F.col("address").isNotNull(), "business_address", "address", "所在地を確認"),
        add(F.col("_has_identity"), "business_identity", "identity", "営業先名称を確認"),
        add(
            F.col("page_type").isin(*BUSINESS_PAGES), "business_page", "official_or_store_page",
            "公式・店舗・会社ページ",
        ),
    )
    return F.array_compact(signals).cast(_SIGNAL)


def _optional(condition: Column, text: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.when(F.coalesce(condition, F.lit(False)), F.array(text)).otherwise(empty)


def decide(scored: DataFrame, rules: ScoringRules) -> DataFrame:
    """Add is_official, is_business_target, review_required and the full reason list."""
    official, business = F.col("official_score"), F.col("business_score")
    own = ~F.col("domain_excluded")
    near = (F.abs(official - rules.official_threshold) <= rules.review_margin) | (
        F.abs(business - rules.business_threshold) <= rules.review_margin
    )
    decided = scored.withColumn("is_official", own & (official >= rules.official_threshold))
    decided = decided.withColumns(
        {
            "is_business_target": F.col("is_official") & (business >= rules.business_threshold),
            "review_required": own & near,
        }
    )
    below_official = F.concat(
        F.lit("公式判定閾値未満: "), official.cast("string"), F.lit(f"/{rules.official_threshold}")
    )
    below_business = F.concat(
        F.lit("営業対象判定閾値未満: "), business.cast("string"),
        F.lit(f"/{rules.business_threshold}"),
    )
    reasons = F.concat(
        F.array_distinct("_reasons"),
        _optional(F.col("exclusion_reason").isNotNull(), F.col("exclusion_reason")),
        _optional(~F.col("is_official") & own, below_official),
        _optional(F.col("is_official") & ~F.col("is_business_target"), below_business),
        _optional(
            F.col("is_business_target"), F.lit("公式サイトかつ営業対象の判定基準を満たす")
        ),
    )
    return decided.withColumn("reasons", reasons)


def score_pages(
    extracted: DataFrame,
    domains: Sequence[str] | DataFrame | None,
    rules: ScoringRules | None = None,
    keywords: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Score extracted pages that carry url, search_prefecture, search_municipality, search_industry.

    Everything is a projection over the page row: no shuffle, no Python. Pass None as ``domains`` for pages that went
    through ``domain_exclusion`` before they were parsed; with a DataFrame of domains that order parses each body once.
    """
    rules = rules or ScoringRules()
    table = INDUSTRY_KEYWORDS if keywords is None else keywords
    none = F.array().cast("array<string>")
    words = none
    for name, terms in table.items():
        listed = F.array(*[F.lit(term) for term in terms])
        words = F.when(F.col("search_industry") == name, listed).otherwise(words)
    if "industry_keywords" in extracted.columns:
        given = F.coalesce("industry_keywords", none)
        words = F.when(F.size(given) > 0, given).otherwise(words)
    identity = (
        F.col("company_name").isNotNull() | F.col("store_name").isNotNull()
        | F.col("display_name").isNotNull()
    )
    excluded = extracted if domains is None else domain_exclusion(extracted, domains)
    prepared = with_page_type(excluded).withColumns(
        {
            "_text": page_text(),
            "_lowered": F.lower(page_text()),
            "_small_print": footer_and_small_text(),
            "_industry_keywords": words,
            "_has_identity": identity,
        }
    )
    evidence = prepared.withColumns(
        {"_official": official_signals(rules), "_business": business_signals(rules)}
    )
    hard = F.col("domain_excluded") | F.col("page_type").isin(*rules.hard_excluded)
    hard_signal = F.when(F.col("domain_excluded"), "excluded_domain").otherwise(
        F.concat(F.lit("excluded_page_type:"), F.col("page_type"))
    )
    evidence = evidence.withColumns(
        {"official_score": bounded_score(_total(F.col("_official"))), "_hard": hard}
    )
    raised = F.col("official_score") * rules.business["official_factor"] + _total(
        F.col("_business")
    )
    negative = F.filter("_official", lambda item: item["signal"].isin(*NEGATIVE_SIGNALS))
    positive = F.filter("_official", lambda item: ~item["signal"].isin(*NEGATIVE_SIGNALS))
    extra = F.when(F.col("_hard"), none).otherwise(_names(F.col("_business")))
    extra_reasons = F.when(
        F.col("_hard"), F.array(F.lit("ポータル・求人・記事・電話帳等の除外対象"))
    ).otherwise(_names(F.col("_business"), "reason"))
    scored = evidence.withColumns(
        {
            "business_score": F.when(F.col("_hard"), 0).otherwise(bounded_score(raised)),
            "positive_signals": ordered_distinct(_names(positive), extra),
            "negative_signals": ordered_distinct(
                _names(negative), _optional(F.col("_hard"), hard_signal)
            ),
            "_reasons": F.concat(_names(F.col("_official"), "reason"), extra_reasons),
        }
    )
    return decide(scored, rules).drop(
        "_text", "_lowered", "_small_print", "_industry_keywords", "_has_identity", "_official", "_business", "_hard", "_reasons"
    )


def scoring_rows(scored: DataFrame, key: str = "page_id") -> DataFrame:
    """Scoring table: one row per page with native signal arrays."""
    return scored.select(
        key, "official_score", "business_score", "is_official", "is_business_target",
        "review_required", "reasons", "positive_signals", "negative_signals",
    )


def counts_as_target(count_no_phone: Column | bool = False) -> Column:
    """A business target counts when it has a phone, or when targets without one count too."""
    flag = F.lit(count_no_phone) if isinstance(count_no_phone, bool) else count_no_phone
    return F.coalesce(F.col("is_business_target") & (F.col("has_phone") | flag), F.lit(False))
