"""Small rule tables as typed constants; every operator takes its own copy as an argument."""

from __future__ import annotations

from dataclasses import dataclass, field

# Scoring weights, thresholds and limits.
OFFICIAL_WEIGHTS = {
    "phone": 10.0,
    "address": 10.0,
    "identity": 12.0,
    "structured_business": 10.0,
    "company_page": 8.0,
    "contact_page": 6.0,
    "access_page": 6.0,
    "industry_match": 10.0,
    "region_match": 10.0,
    "own_domain": 8.0,
    "copyright_match": 5.0,
    "job": -35.0,
    "article": -25.0,
    "ranking": -30.0,
    "portal": -50.0,
    "multiple_companies": -25.0,
    "many_external_links": -15.0,
    "region_mismatch": -20.0,
    "industry_mismatch": -20.0,
}
BUSINESS_WEIGHTS = {
    "official_factor": 0.5,
    "phone": 15.0,
    "mobile_phone": 5.0,
    "address": 10.0,
    "identity": 10.0,
    "official_or_store_page": 10.0,
}


@dataclass(frozen=True)
class ScoringRules:
    """Weights, thresholds and limits of the additive score."""

    official: dict[str, float] = field(default_factory=lambda: dict(OFFICIAL_WEIGHTS))
    business: dict[str, float] = field(default_factory=lambda: dict(BUSINESS_WEIGHTS))
    official_threshold: int = 60
    business_threshold: int = 55
    review_margin: int = 8
    many_external_links: int = 8
    multiple_companies: int = 3
    hard_excluded: tuple[str, ...] = ("portal", "job", "article", "directory")


# Default excluded domains, in list order.
EXCLUDED_DOMAINS = (
    "wikipedia.org",
    "facebook.com",
    "instagram.com",
    "x.com",
    "youtube.com",
    "indeed.com",
    "townwork.net",
    "itp.ne.jp",
    "hotpepper.jp",
    "tabelog.com",
    "mapion.co.jp",
    "navitime.co.jp",
    "rakuten.co.jp",
    "amazon.co.jp",
    "prtimes.jp",
    "ameblo.jp",
    "note.com",
    "mynavi.jp",
    "en-gage.net",
    "wantedly.com",
)

# Industry display names and their search keywords.
INDUSTRY_KEYWORDS = {
    "飲食店": ("レストラン", "飲食店", "居酒屋"),
    "建設業": ("建設会社", "工務店", "リフォーム"),
    "美容業": (
        "美容室",
        "美容院",
        "理容室",
        "理美容",
        "ヘアサロン",
        "hair salon",
        "salon",
        "美容",
        "エステ",
    ),
}

# Search providers with their switch and priority, in priority order.
PROVIDERS = (
    ("bing_rss", True, 10),
    ("bing_html", True, 20),
    ("yahoo_japan_html", True, 30),
    ("duckduckgo_html", False, 40),
    ("brave_search", False, 50),
    ("mojeek", False, 60),
    ("searxng", False, 70),
)
UNKNOWN_PRIORITY = 999


@dataclass(frozen=True)
class CollectionLimits:
    """Per-condition ceilings of a collection run."""

    max_queries: int = 5
    results_per_query: int = 10
    max_candidates: int = 2000
    max_targets: int = 500
    count_no_phone_as_target: bool = False


@dataclass(frozen=True)
class SafetyLimits:
    """Ceilings and switches of a supervised live run."""

    max_requests: int = 50
    max_requests_per_domain: int = 10
    max_runtime_seconds: int = 900
    max_response_bytes: int = 5_242_880
    forbidden_limit: int = 2
    stop_on_robots: bool = True
    stop_on_rate_limit: bool = True
    stop_on_captcha: bool = True
    stop_on_block: bool = True


def industry_synonyms(
    keywords: dict[str, tuple[str, ...]] | None = None,
) -> dict[str, tuple[str, ...]]:
    """Every display name and keyword points at the whole term list of its group; later groups win."""
    aliases: dict[str, tuple[str, ...]] = {}
    for display, words in (INDUSTRY_KEYWORDS if keywords is None else keywords).items():
        terms = tuple(dict.fromkeys(word.strip() for word in (display, *words) if word.strip()))
        aliases.update(dict.fromkeys(terms, terms))
    return aliases
