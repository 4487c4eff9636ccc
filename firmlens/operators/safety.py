"""Safety stops of a supervised run, recomputed over its ordered request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.dims import SafetyLimits
from firmlens.functions.text import contains_any
from firmlens.operators.ordered import top_per_key

# Words of captcha and block pages, and HTML content types.
CAPTCHA_SIGNALS = (
    "私はロボットではありません",
    "画像認証",
    "captchaを入力",
    "verify you are human",
    "security check",
    "cloudflare challenge",
)
BLOCK_SIGNALS = ("access denied", "アクセスが拒否", "forbidden", "temporarily blocked")
HTML_TYPES = ("text/html", "application/xhtml+xml")

_DOMAIN = ["run_id", "domain"]


def is_html(content_type: Column) -> Column:
    main = F.btrim(F.substring_index(F.lower(F.coalesce(content_type, F.lit(""))), ";", 1))
    return main.isin(*HTML_TYPES)


def captcha_signal(visible_text: Column) -> Column:
    return contains_any(visible_text, CAPTCHA_SIGNALS)


def block_signal(visible_text: Column) -> Column:
    return contains_any(visible_text, BLOCK_SIGNALS)


def response_error(limits: SafetyLimits, repeated_403: Column) -> Column:
    """Error of an answered request; a later check overrides an earlier one.

    Needs error, http_status, redirect_repeat, content_length, size_exceeded, content_type, captcha
    and block columns.
    """
    never = F.lit(False)
    captcha = F.col("captcha") if limits.stop_on_captcha else never
    block = F.col("block") if limits.stop_on_block else never
    limited = (F.col("http_status") == 429) if limits.stop_on_rate_limit else never
    too_large = F.col("size_exceeded") | (F.col("content_length") > limits.max_response_bytes)
    not_html = (F.col("content_length") > 0) & ~is_html(F.col("content_type"))
    return (
        F.when(block, "block_page_signal")
        .when(captcha, "captcha_signal")
        .when(too_large, "response_too_large")
        .when(not_html, "non_html_content")
        .when(F.col("redirect_repeat"), "redirect_loop")
        .when(repeated_403, "repeated_403")
        .when(limited, "rate_limited_domain")
        .otherwise(F.nullif(F.col("error"), F.lit("")))
    )


def _stops_at_once(limits: SafetyLimits) -> Column:
    """Answers that stop their domain whatever came before."""
    stop = F.col("redirect_repeat")
    if limits.stop_on_robots:
        stop = stop | (F.col("error") == "robots_denied")
    if limits.stop_on_rate_limit:
        stop = stop | (F.col("http_status") == 429)
    if limits.stop_on_captcha:
        stop = stop | F.col("captcha")
    if limits.stop_on_block:
        stop = stop | F.col("block")
    return F.coalesce(stop, F.lit(False))


def safety_verdicts(requests: DataFrame, limits: SafetyLimits | None = None) -> DataFrame:
    """Add verdict, allowed and error_type to every request of a log.

    ``requests`` has run_id, seq (unique whole number, request order), domain, elapsed_seconds since
    the start of the run (non-decreasing in seq) and the answer columns of ``response_error``.

    Only few rows of a run can ever be allowed: at most ``max_requests_per_domain`` per domain and
    ``max_requests`` per run. They are found by two top-k steps that Spark limits on the map side. All
    state the remaining rows need - where a domain stopped, filled up, or the run filled up - is one
    small row per domain or run, joined back. No window ever spans a whole run or domain.
    """
    limits = limits or SafetyLimits()
    early = requests.filter(F.col("elapsed_seconds") < limits.max_runtime_seconds)
    flagged = early.select(
        "run_id", "domain", "seq", _stops_at_once(limits).alias("_stop"),
        F.coalesce(F.col("http_status") == 403, F.lit(False)).alias("_403"),
    )
    # Within the first requests of a domain nothing is blocked until the domain stops.
    heads = top_per_key(
        flagged, _DOMAIN, [F.asc("seq")], limits.max_requests_per_domain, rank="_nth"
    )
    at_once = F.min(F.when(F.col("_stop"), F.col("seq")))
    forbidden = F.array_sort(F.collect_list(F.when(F.col("_403"), F.col("seq"))))
    repeated = F.get(forbidden, F.lit(limits.forbidden_limit - 1))
    stops = heads.groupBy(*_DOMAIN).agg(
        F.least(at_once, repeated).alias("_stop_seq"), repeated.alias("_repeat_seq")
    )
    open_heads = heads.join(stops, _DOMAIN).filter(
        F.col("_stop_seq").isNull() | (F.col("seq") <= F.col("_stop_seq"))
    )
    admitted = top_per_key(
        open_heads.select("run_id", "domain", "seq", "_stop_seq", "_repeat_seq"),
        ["run_id"], [F.asc("seq")], limits.max_requests, rank="_run_nth",
    )
    full_runs = (
        admitted.groupBy("run_id")
        .agg(F.count("*").alias("_n"), F.max("seq").alias("_run_full_seq"))
        .filter(F.col("_n") >= limits.max_requests)
        .drop("_n")
    )
    # A domain's own facts, counting only requests that were really sent.
    domains = admitted.groupBy(*_DOMAIN).agg(
        F.count("*").alias("_sent"),
        F.max("seq").alias("_last_sent"),
        F.max(F.when(F.col("seq") == F.col("_stop_seq"), F.col("seq"))).alias("_stopped_at"),
        F.max("_repeat_seq").alias("_repeat_seq"),
    )
    full = F.col("_sent") >= limits.max_requests_per_domain
    domains = domains.withColumn("_domain_full_seq", F.when(full, F.col("_last_sent")))

    joined = (
        requests.join(domains.drop("_sent", "_last_sent"), _DOMAIN, "left")
        .join(full_runs, "run_id", "left")
    )
    run_full = F.coalesce(F.col("seq") > F.col("_run_full_seq"), F.lit(False))
    domain_full = F.coalesce(F.col("seq") > F.col("_domain_full_seq"), F.lit(False))
    stopped = F.coalesce(F.col("seq") > F.col("_stopped_at"), F.lit(False))
    late = F.col("elapsed_seconds") >= limits.max_runtime_seconds
    # The first request beyond a full domain stops it; later ones find it stopped.
    over = domain_full & ~stopped & ~run_full
    first_over = (
        joined.filter(over).groupBy(*_DOMAIN).agg(F.min("seq").alias("_over_seq"))
    )
    marked = joined.join(first_over, _DOMAIN, "left")
    stopped_by_limit = F.coalesce(F.col("seq") > F.col("_over_seq"), F.lit(False))
    blocked = (
        F.when(stopped | stopped_by_limit, "domain_stopped")
        .when(run_full, "run_http_limit")
        .when(domain_full, "domain_http_limit")
        .when(late, "run_time_limit")
    )
    reached = F.coalesce(F.col("seq") >= F.col("_repeat_seq"), F.lit(False))
    again_403 = reached & F.coalesce(F.col("http_status") == 403, F.lit(False))
    error = F.when(F.col("_blocked").isNotNull(), F.col("_blocked")).otherwise(
        response_error(limits, again_403)
    )
    return (
        marked.withColumn("_blocked", blocked)
        .withColumn("error_type", error)
        .withColumn("allowed", F.col("_blocked").isNull())
        .withColumn("verdict", F.coalesce("error_type", F.lit("html")))
        .select(*requests.columns, "verdict", "allowed", "error_type")
    )
