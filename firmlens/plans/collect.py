"""Collection run over stored search results and stored pages, for all conditions at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.dims import (
    EXCLUDED_DOMAINS,
    PROVIDERS,
    CollectionLimits,
    ScoringRules,
    industry_synonyms,
)
from firmlens.operators.candidates import (
    condition_summary,
    discover_candidates,
    process_candidates,
    select_within_limits,
)
from firmlens.operators.ordered import top_per_key
from firmlens.operators.relevance import prefetch_relevance
from firmlens.operators.pages import PARSED_ONLY
from firmlens.operators.search import (
    expand_queries,
    merge_results,
    official_site_query,
    score_results,
)
from firmlens.session import cut_lineage


@dataclass(frozen=True)
class Collection:
    """Frames of one run."""

    queries: DataFrame
    results: DataFrame
    discovered: DataFrame
    outcomes: DataFrame
    summary: DataFrame


def search_conditions(
    conditions: DataFrame,
    results: DataFrame,
    limits: CollectionLimits,
    providers: Sequence[tuple[str, bool, int]] = PROVIDERS,
    synonyms: Mapping[str, Sequence[str]] | DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Queries of the enabled conditions and their merged results.

    ``results`` holds stored provider results by query text; each text is merged once even when several
    conditions ask for it.
    """
    synonyms = industry_synonyms() if synonyms is None else synonyms
    queries = expand_queries(conditions.filter("enabled"), synonyms, limits.max_queries)
    asked = results.join(queries.select("query").distinct(), "query", "left_semi")
    per_query = min(limits.results_per_query, limits.max_candidates)
    merged = merge_results(score_results(asked, providers), ["query"], per_query)
    found = queries.select(
        "condition_id", "query_pos", "query", "prefecture", "municipality", "industry",
        "max_results",
    ).join(merged, "query")
    order = F.col("query_pos") * F.lit(per_query + 1) + F.col("merged_rank")
    return queries, found.withColumn("discovery_seq", order.cast("bigint"))


def discover(
    found: DataFrame,
    limits: CollectionLimits,
    synonyms: Mapping[str, Sequence[str]] | DataFrame | None = None,
    excluded_domains: Sequence[str] = EXCLUDED_DOMAINS,
) -> DataFrame:
    """Candidates of each condition with the decision taken before any page is read."""
    synonyms = industry_synonyms() if synonyms is None else synonyms
    judged = cut_lineage(prefetch_relevance(found, synonyms, excluded_domains))
    return discover_candidates(judged, limits.max_candidates)


def queue_ids(discovered: DataFrame, limits: CollectionLimits) -> DataFrame:
    """Accepted candidates with a progress id; a page wanted by several conditions is queued once."""
    span = limits.max_queries * (limits.results_per_query + 1) + 1
    numbered = discovered.filter("accepted").withColumn(
        "progress_id", F.col("condition_id") * F.lit(span) + F.col("discovery_index")
    )
    return top_per_key(numbered, ["task_key"], [F.asc("progress_id")])


def collect_conditions(
    conditions: DataFrame,
    results: DataFrame,
    fetches: DataFrame,
    pauses: DataFrame,
    known_pages: DataFrame,
    now: Column,
    limits: CollectionLimits | None = None,
    providers: Sequence[tuple[str, bool, int]] = PROVIDERS,
    synonyms: Mapping[str, Sequence[str]] | DataFrame | None = None,
    excluded_domains: Sequence[str] = EXCLUDED_DOMAINS,
    rules: ScoringRules | None = None,
    keywords: Mapping[str, Sequence[str]] | None = None,
) -> Collection:
    """Search, decide, process and summarise every condition, all conditions at once.

    Three intermediate tables are written to the checkpoint folder because several later steps read
    them: the judged results, the discovered candidates, and the processed candidates. So search results
    are merged once and each page body is parsed once.
    """
    limits = limits or CollectionLimits()
    queries, found = search_conditions(conditions, results, limits, providers, synonyms)
    discovered = cut_lineage(discover(found, limits, synonyms, excluded_domains))
    tasks = queue_ids(discovered, limits).select(
        "progress_id", "condition_id", "task_key", "url", "max_results",
        F.col("prefecture").alias("search_prefecture"),
        F.col("municipality").alias("search_municipality"),
        F.col("industry").alias("search_industry"),
    )
    processed = process_candidates(
        tasks, fetches, pauses, known_pages, now, excluded_domains, rules, keywords,
        limits.count_no_phone_as_target,
    )
    processed = cut_lineage(processed.drop(*PARSED_ONLY))
    rejected = discovered.filter(~F.col("accepted"))
    before = rejected.groupBy("condition_id").agg(F.count("*").alias("excluded"))
    outcomes = select_within_limits(processed, before, limits.max_candidates, limits.max_targets)
    counted = outcomes.select(
        "condition_id", "status", "counts_as_target", "is_official", "extracted", "has_phone"
    )
    no = F.lit(False)
    early = rejected.select(
        "condition_id", F.lit("excluded").alias("status"), no.alias("counts_as_target"),
        no.alias("is_official"), no.alias("extracted"), no.alias("has_phone"),
    )
    summary = condition_summary(counted.unionByName(early), discovered)
    return Collection(queries, found, discovered, outcomes, summary)


def planned_queries(conditions: DataFrame) -> DataFrame:
    """Dry run: the one conservative query of every enabled condition."""
    return conditions.filter("enabled").select(
        "condition_id",
        official_site_query(F.col("prefecture"), F.col("municipality"), F.col("industry")).alias(
            "query"
        ),
    )
