"""Candidate flow: discovery caps, gates before a page is used, outcome of each candidate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.dims import ScoringRules
from firmlens.functions.urls import pause_origin, task_key
from firmlens.operators.domains import domain_exclusion
from firmlens.operators.extract import extract_companies
from firmlens.operators.ordered import running_totals, top_per_key
from firmlens.operators.pages import page_features
from firmlens.operators.score import counts_as_target, score_pages
from firmlens.session import cut_lineage

# Processing states and the groups they are counted in.
RETRY_STATUSES = ("http_429", "http_503", "timeout", "transport_error")
FAILED_STATUSES = ("http_403", "http_404", "extraction_failed", "scoring_failed", "failed")
FINAL_CODES = {403: "http_403", 404: "http_404"}
RETRY_CODES = {429: "http_429", 503: "http_503"}
RETRY_DELAY_SECONDS = 300
_HTTP_DATE = ("d MMM yyyy HH:mm:ss zzz", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss XX")


def discover_candidates(results: DataFrame, cap: Column | int) -> DataFrame:
    """Distinct candidates of each condition in discovery order, up to the cap.

    ``results`` has condition_id, discovery_seq (unique whole number giving the order across the
    queries of a condition), url and accepted. The cap is tested after an accepted candidate only, so
    rejected ones found at the cap are still listed: rows stay up to the first accepted row whose
    running number reaches the cap. Adds task_key and discovery_index.
    """
    keyed = results.withColumn("task_key", task_key(F.col("url"))).filter(
        F.col("task_key").isNotNull()
    )
    first = top_per_key(keyed, ["condition_id", "task_key"], [F.asc("discovery_seq")])
    numbered = running_totals(
        first, ["condition_id"], "discovery_seq", sums={"_before": F.lit(1)}
    ).withColumn("discovery_index", (F.col("_before") + 1).cast("int"))
    cap = F.lit(cap) if isinstance(cap, int) else cap
    reached = F.col("accepted") & (F.col("discovery_index") >= cap)
    last = (
        numbered.filter(reached)
        .groupBy("condition_id")
        .agg(F.min("discovery_index").alias("_last"))
    )
    kept = numbered.join(last, "condition_id", "left").filter(
        F.col("_last").isNull() | (F.col("discovery_index") <= F.col("_last"))
    )
    return kept.select(*results.columns, "task_key", "discovery_index")


def select_within_limits(
    outcomes: DataFrame,
    excluded_before: DataFrame,
    max_candidates: int,
    max_targets: int,
) -> DataFrame:
    """Keep the outcomes that are processed before a condition's ceilings are reached.

    ``outcomes`` has condition_id, progress_id, max_results and counts_as_target; ``excluded_before``
    has condition_id and excluded (candidates already rejected before the loop, which count as
    processed). A row is processed while fewer than ``max_candidates`` were processed and fewer than
    min(max_results, max_targets) targets were found before it.
    """
    numbered = running_totals(
        outcomes,
        ["condition_id"],
        "progress_id",
        sums={"_done": F.lit(1), "_targets": F.col("counts_as_target").cast("int")},
    )
    joined = numbered.join(excluded_before, "condition_id", "left")
    done = F.col("_done") + F.coalesce(F.col("excluded"), F.lit(0))
    limit = F.least(F.col("max_results"), F.lit(max_targets))
    return joined.filter((done < max_candidates) & (F.col("_targets") < limit)).select(
        *outcomes.columns
    )


def drop_terminal(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Remove candidates whose page already has a final state."""
    final = pages.filter(~F.col("processing_status").isin(*RETRY_STATUSES)).select("url")
    return candidates.join(final, "url", "left_anti")


def gate_pauses(candidates: DataFrame, pauses: DataFrame, now: Column) -> DataFrame:
    """Add paused_until for candidates whose origin is paused beyond ``now``."""
    active = pauses.filter(F.col("paused_until") > now).select(
        F.col("origin").alias("_origin"), "paused_until"
    )
    keyed = candidates.withColumn("_origin", pause_origin(F.col("url")))
    return keyed.join(active, "_origin", "left").select(*candidates.columns, "paused_until")


def transport_state(http_status: Column, fetch_error: Column) -> Column:
    """State of a fetch that did not deliver a page, with its retry switch; NULL for a good page."""

    def state(name: str, retry: bool) -> Column:
        return F.struct(F.lit(name).alias("status"), F.lit(retry).alias("retryable"))

    result = F.when(fetch_error == "robots_denied", state("robots_denied", False))
    result = result.when(fetch_error == "timeout", state("timeout", True))
    result = result.when(F.coalesce(fetch_error, F.lit("")) != "", state("transport_error", True))
    for code, name in FINAL_CODES.items():
        result = result.when(http_status == code, state(name, False))
    for code, name in RETRY_CODES.items():
        result = result.when(http_status == code, state(name, True))
    bad = http_status.isNull() | ~http_status.between(200, 299)
    return result.when(bad, state("failed", False))


def retry_available_at(
    now: Column, status: Column, retry_after: Column, delay: int = RETRY_DELAY_SECONDS
) -> Column:
    """Earliest time of the next try; a 429 answer may ask for more by seconds or by date."""
    now = now.cast("timestamp")
    text = F.btrim(retry_after)
    seconds = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    date_text = F.regexp_replace(text, r"^[A-Za-z]+,\s*", "")
    moment = F.coalesce(*[F.try_to_timestamp(date_text, F.lit(form)) for form in _HTTP_DATE])
    until = F.bround((F.unix_micros(moment) - F.unix_micros(now)) / F.lit(1e6), 0).cast("bigint")
    asked = F.coalesce(seconds, until, F.lit(delay))
    wait = F.when(status == "http_429", F.greatest(F.lit(delay), asked)).otherwise(F.lit(delay))
    return F.timestamp_micros(F.unix_micros(now) + wait * F.lit(1_000_000))


def process_candidates(
    candidates: DataFrame,
    fetches: DataFrame,
    pauses: DataFrame,
    known_pages: DataFrame,
    now: Column,
    domains: Sequence[str] | DataFrame,
    rules: ScoringRules | None = None,
    keywords: Mapping[str, Sequence[str]] | None = None,
    count_no_phone: bool = False,
) -> DataFrame:
    """Outcome of every candidate: paused, duplicate, transport problem, or extracted and scored.

    ``candidates``: progress_id, condition_id, url and the search_* context columns. ``fetches``: url,
    final_url, http_status, fetch_error, retry_after, html, one row per url.

    The gates read everything but the bodies; their narrow result is written, so its size is known when the bodies of the
    candidates that passed are joined: a small set is broadcast and the body table is not moved. A page that cannot be
    parsed is ``extraction_failed`` with its reason. Rows that are not parsed have NULL in the extracted columns.
    """
    gated = gate_pauses(candidates, pauses, now)
    final = known_pages.filter(~F.col("processing_status").isin(*RETRY_STATUSES)).select(
        F.col("url").alias("_known_url")
    )
    fetched = fetches.select(
        F.col("url").alias("_fetch_url"), "final_url", "http_status", "fetch_error", "retry_after"
    )
    joined = gated.join(final, F.col("url") == F.col("_known_url"), "left").join(
        fetched, F.col("url") == F.col("_fetch_url"), "left"
    )
    state = transport_state(F.col("http_status"), F.col("fetch_error"))
    gate = (
        F.when(F.col("paused_until").isNotNull(), "paused")
        .when(F.col("_known_url").isNotNull(), "duplicate")
        .when(state.isNotNull(), "transport")
        .when(F.coalesce(F.btrim("final_url"), F.lit("")) == "", "extraction_failed")
        .otherwise("page")
    )
    staged = joined.withColumns({"_gate": gate, "_state": state}).drop("_known_url", "_fetch_url")
    staged = staged.withColumnsRenamed({"url": "requested_url"}).withColumn(
        "url", F.coalesce("final_url", "requested_url")
    )
    # Domains are looked up on these narrow rows as well, before a body is read.
    gates = cut_lineage(domain_exclusion(staged, domains))
    usable = gates.filter(F.col("_gate") == "page")
    bodies = fetches.select(F.col("url").alias("requested_url"), "html").join(usable, "requested_url")
    pages = score_pages(extract_companies(page_features(bodies)), None, rules, keywords)
    others = gates.filter(F.col("_gate") != "page")
    scored = pages.unionByName(others, allowMissingColumns=True)
    broken = F.col("parse_error").isNotNull()
    parsed = (F.col("_gate") == "page") & ~broken
    no_host = parsed & (F.col("host") == "")
    status = (
        F.when(F.col("_gate") == "paused", "http_429")
        .when(F.col("_gate") == "duplicate", "duplicate")
        .when(F.col("_gate") == "transport", F.col("_state.status"))
        .when((F.col("_gate") == "extraction_failed") | broken, "extraction_failed")
        .when(no_host, "scoring_failed")
        .when(F.col("is_business_target"), "success")
        .otherwise("excluded")
    )
    transport_error = F.when(
        F.col("_state.status") != "robots_denied", F.col("_state.status")
    )
    error_type = (
        F.when(F.col("_gate") == "paused", "domain_paused")
        .when(F.col("_gate") == "transport", transport_error)
        .when((F.col("_gate") == "extraction_failed") | broken, "extraction_error")
        .when(no_host, "scoring_error")
    )
    pause_text = F.date_format("paused_until", "yyyy-MM-dd HH:mm:ss")
    message = (
        F.when(
            F.col("_gate") == "paused", F.concat(F.lit("domain paused until "), pause_text)
        )
        .when(F.col("_gate") == "transport", F.col("fetch_error"))
        .when(F.col("_gate") == "extraction_failed", "source_url must not be empty")
        .when(broken, F.col("parse_error"))
        .when(no_host, "url must contain a hostname")
    )
    retry = F.when(
        (F.col("_gate") == "transport") & F.col("_state.retryable"),
        retry_available_at(now, F.col("_state.status"), F.col("retry_after")),
    ).when(F.col("_gate") == "paused", F.col("paused_until"))
    has_phone = parsed & F.coalesce(F.size("phones") > 0, F.lit(False))
    scoring_ok = parsed & ~no_host
    decided = scored.withColumns(
        {
            "status": status,
            "error_type": error_type,
            "error_message": message,
            "available_at": retry,
            "extracted": parsed,
            "has_phone": has_phone,
            **{
                name: F.when(scoring_ok, F.col(name))
                for name in (
                    "official_score", "business_score", "is_official", "is_business_target",
                    "review_required",
                )
            },
        }
    ).withColumn("counts_as_target", counts_as_target(count_no_phone))
    return decided.drop("_gate", "_state", "url", "parse_error").withColumnRenamed("requested_url", "url")


def outcome_pages(outcomes: DataFrame, now: Column) -> DataFrame:
    """Page rows to save: every candidate that was fetched; paused and known ones keep their page."""
    skipped = (F.col("status") == "duplicate") | F.col("error_type").eqNullSafe("domain_paused")
    return outcomes.filter(~skipped).select(
        F.col("progress_id").alias("page_id"), "url", "final_url", "http_status", "fetch_error",
        F.col("status").alias("processing_status"), now.alias("fetched_at"), now.alias("updated_at"),
    )


def outcome_errors(outcomes: DataFrame, now: Column) -> DataFrame:
    """Error rows of failed candidates; a pause or a robots refusal is not an error."""
    failed = F.col("error_type").isNotNull() & (F.col("error_type") != "domain_paused")
    return outcomes.filter(failed).select(
        F.col("progress_id").alias("page_id"), "progress_id", "error_type",
        F.coalesce("error_message", F.lit("")).alias("message"), now.alias("created_at"),
    )


def outcome_transitions(outcomes: DataFrame) -> DataFrame:
    """Queue transitions of processed candidates, as ``apply_outcomes`` takes them."""
    retry = F.col("available_at").isNotNull()
    failed = F.col("status").isin("extraction_failed", "scoring_failed")
    action = F.when(retry, "retry").when(failed, "fail").otherwise("complete")
    paused = F.col("error_type").eqNullSafe("domain_paused")
    reason = F.when(paused, "domain_paused").when(retry, F.col("status")).otherwise(
        F.col("error_message")
    )
    return outcomes.select(
        F.col("progress_id").alias("id"), action.alias("action"), reason.alias("error"),
        "available_at", F.expr("CAST(NULL AS STRING)").alias("cursor"),
    )


def outcome_pauses(outcomes: DataFrame) -> DataFrame:
    """Origins to pause: every retryable answer pauses its origin until the next try."""
    retried = F.col("available_at").isNotNull() & ~F.col("error_type").eqNullSafe("domain_paused")
    return outcomes.filter(retried).select(
        "url", "status", "available_at", F.col("progress_id").alias("seq")
    )


def count_outcomes(outcomes: DataFrame, keys: Sequence[str] = ("condition_id",)) -> DataFrame:
    """Collection summary per condition with the count of every status."""
    status = F.col("status")
    per_status = outcomes.groupBy(*keys, "status").agg(
        F.count("*").alias("_n"),
        F.count_if(F.coalesce("counts_as_target", F.lit(False))).alias("_targets"),
        F.count_if(F.coalesce("is_official", F.lit(False))).alias("_official"),
        F.count_if(F.coalesce(F.col("extracted") & ~F.col("has_phone"), F.lit(False))).alias(
            "_no_phone"
        ),
    )

    def number(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0))

    # Counting per status first leaves a dozen rows per condition for the status map.
    entries = F.array_sort(F.collect_list(F.struct("status", "_n")))
    return per_status.groupBy(*keys).agg(
        F.sum("_n").alias("processed_count"),
        F.sum("_targets").alias("business_target_count"),
        F.sum("_official").alias("official_count"),
        number(status == "excluded").alias("excluded_count"),
        F.sum("_no_phone").alias("no_phone_count"),
        number(status.isin(*RETRY_STATUSES)).alias("retry_count"),
        number(status.isin(*FAILED_STATUSES)).alias("failed_count"),
        number(status == "robots_denied").alias("robots_denied_count"),
        F.map_from_entries(entries).alias("status_counts"),
    )


def condition_summary(outcomes: DataFrame, discovered: DataFrame) -> DataFrame:
    """Summary of every condition that discovered anything, with its final state."""
    candidates = discovered.groupBy("condition_id").agg(F.count("*").alias("candidate_count"))
    summary = candidates.join(count_outcomes(outcomes), "condition_id", "left")
    counts = [
        name for name in summary.columns if name.endswith("_count") and name != "candidate_count"
    ]
    filled = summary.fillna(0, counts)
    return filled.withColumn("condition_status", condition_status(F.col("retry_count")))


def condition_status(retry_count: Column) -> Column:
    return F.when(retry_count > 0, "pending").otherwise("completed")


def run_totals(summaries: DataFrame) -> DataFrame:
    """Totals of a run over its condition summaries; needs run_id and status_ok."""
    return summaries.groupBy("run_id").agg(
        F.count_if("status_ok").alias("conditions_completed"),
        F.sum(F.when(F.col("status_ok"), F.col("business_target_count")).otherwise(0)).alias(
            "business_targets"
        ),
        F.sum(F.when(F.col("status_ok"), F.col("processed_count")).otherwise(0)).alias(
            "processed_candidates"
        ),
        F.count_if(~F.col("status_ok")).alias("error_count"),
    )


def summary_json(summaries: DataFrame) -> Column:
    """Condition summary as the JSON text kept in the run history."""
    fields = [
        "candidate_count", "processed_count", "business_target_count", "official_count",
        "excluded_count", "no_phone_count", "retry_count", "failed_count", "robots_denied_count",
        "status_counts",
    ]
    return F.to_json(F.struct(*[name for name in fields if name in summaries.columns]))


def effective_limits(conditions: DataFrame, max_candidates: int, count_no_phone: bool) -> DataFrame:
    """Per-row ceilings win over the configured ones; zero or missing falls back."""
    own = F.when(F.col("max_candidates") != 0, F.col("max_candidates"))
    return conditions.withColumns(
        {
            "max_candidates": F.coalesce(own, F.lit(max_candidates)),
            "count_no_phone_as_target": F.coalesce(
                "count_no_phone_as_target", F.lit(count_no_phone)
            ),
        }
    )


def has_required_results(outcomes: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """True per run when there is an official site, a fetched page and a phone or an address."""
    contact = F.col("has_phone") | F.col("has_address")
    return outcomes.groupBy(*keys).agg(
        (
            F.bool_or(F.coalesce("is_official", F.lit(False)))
            & F.bool_or(F.coalesce("fetched", F.lit(False)))
            & F.bool_or(F.coalesce(contact, F.lit(False)))
        ).alias("has_required_results")
    )
