"""Upkeep of the result tables: newest row per key, children replaced with their parent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions.urls import normalize_search_url, pause_origin
from firmlens.operators.ordered import top_per_key


def insert_queries(existing: DataFrame, new: DataFrame, id_offset: int = 0) -> DataFrame:
    """New (condition_id, query) pairs; the earliest ``seq`` supplies the id."""
    first = new.groupBy("condition_id", "query").agg(F.min("seq").alias("seq"))
    fresh = first.join(existing.select("condition_id", "query"), ["condition_id", "query"], "left_anti")
    return fresh.select((F.col("seq") + id_offset).cast("bigint").alias("id"), "condition_id", "query")


def insert_results(existing: DataFrame, new: DataFrame, id_offset: int = 0) -> DataFrame:
    """New (query_id, url) pairs with their merge key; the earliest ``seq`` wins and supplies the id."""
    keys = ["query_id", "url"]
    first = top_per_key(new, keys, [F.asc("seq")])
    fresh = first.join(existing.select(*keys), keys, "left_anti")
    return fresh.select(
        (F.col("seq") + id_offset).cast("bigint").alias("id"), *keys, "provider", "rank", "title",
        "snippet", F.col("match_score").alias("relevance_score"),
        normalize_search_url(F.col("url")).alias("normalized_url"),
    )


def upsert_latest(
    existing: DataFrame, new: DataFrame, keys: Sequence[str], version: str
) -> DataFrame:
    """Newest row per key over both tables; a new row beats an equal version."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return top_per_key(both, keys, [F.desc(version), F.desc("_new")]).drop("_new")


def upsert_pages(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Saved pages replace known ones; page_id and fetched_at stay those of the first save.

    Both frames have page_id, url, fetched_at, updated_at and the page columns. The stored bodies pass
    one anti join against the new urls only: no shuffle when those are few enough for Spark to broadcast
    or the table is bucketed by url. Identity comes from a lean projection of the old table.
    """
    newest = top_per_key(new, ["url"], [F.desc("updated_at")])
    first = new.groupBy("url").agg(
        F.min("fetched_at").alias("_new_fetched"), F.min_by("page_id", "fetched_at").alias("_new_id")
    )
    known = existing.select(
        "url", F.col("page_id").alias("_old_id"), F.col("fetched_at").alias("_old_fetched")
    )
    identity = first.join(known, "url", "left").select(
        "url", F.coalesce("_old_id", "_new_id").alias("_id"),
        F.coalesce("_old_fetched", "_new_fetched").alias("_fetched"),
    )
    replaced = newest.join(identity, "url").withColumns(
        {"page_id": F.col("_id"), "fetched_at": F.col("_fetched")}
    )
    kept = existing.join(new.select("url").distinct(), "url", "left_anti")
    return kept.select(*existing.columns).unionByName(replaced.select(*existing.columns))


def replace_children(existing: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children of re-extracted parents are replaced as a whole, even by nothing."""
    kept = existing.join(parents.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new)


def save_prefetch_exclusions(existing: DataFrame, rejected: DataFrame, now: Column) -> DataFrame:
    """Mark pages excluded: new rows for unseen urls, status and reason replaced for known ones."""
    reasons = rejected.groupBy("url").agg(F.max_by("reject_reason", "seq").alias("_reason"))
    known = existing.join(reasons, "url", "left")
    hit = F.col("_reason").isNotNull()
    changed = {
        "processing_status": F.when(hit, "excluded").otherwise(F.col("processing_status")),
        "fetch_error": F.when(hit, F.col("_reason")).otherwise(F.col("fetch_error")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        "fetched_at": F.coalesce("fetched_at", now),
    }
    unseen = reasons.join(existing.select("url"), "url", "left_anti").select(
        "url", F.lit("excluded").alias("processing_status"), F.col("_reason").alias("fetch_error"),
        now.alias("updated_at"), now.alias("fetched_at"),
    )
    kept = known.withColumns(changed).select(*existing.columns)
    return kept.unionByName(unseen, allowMissingColumns=True)


def pause_domains(existing: DataFrame, retries: DataFrame) -> DataFrame:
    """Newest pause per origin; ``retries`` has url, status, available_at and seq."""
    keyed = retries.withColumn("origin", pause_origin(F.col("url"))).filter(
        F.col("origin").isNotNull()
    )
    latest = keyed.groupBy("origin").agg(
        F.max_by(
            F.struct(F.col("available_at").alias("paused_until"), F.col("status").alias("reason")),
            "seq",
        ).alias("pause")
    )
    fresh = latest.select("origin", "pause.paused_until", "pause.reason")
    kept = existing.join(fresh.select("origin"), "origin", "left_anti")
    return kept.select("origin", "paused_until", "reason").unionByName(fresh)


def update_condition_status(conditions: DataFrame, summaries: DataFrame, now: Column) -> DataFrame:
    """Final state of the conditions of a run; completed ones get their time."""
    states = summaries.select(F.col("condition_id").alias("id"), "condition_status")
    joined = conditions.join(states, "id", "left")
    hit = F.col("condition_status").isNotNull()
    done = F.when(F.col("condition_status") == "completed", now)
    return joined.withColumns(
        {
            "status": F.coalesce("condition_status", "status"),
            "completed_at": F.when(hit, done).otherwise(F.col("completed_at")),
        }
    ).select(*conditions.columns)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Row with the highest ``order`` of each key."""
    return top_per_key(df, keys, [F.desc(order)])


def run_condition_rows(summaries: DataFrame, payload: Column, now: Column) -> DataFrame:
    """History row of every finished condition: state, JSON summary, error and finish time."""
    ok = F.col("status_ok")
    return summaries.select(
        "run_id", "condition_index",
        F.when(ok, "completed").otherwise("failed").alias("status"),
        F.when(ok, payload).otherwise("{}").alias("summary_json"),
        F.when(~ok, F.col("error_message")).alias("error_message"),
        now.alias("finished_at"),
    )


def finish_runs(runs: DataFrame, totals: DataFrame, now: Column) -> DataFrame:
    """Close running runs with their totals; any failed condition makes the run partial."""
    joined = runs.drop(
        "conditions_completed", "business_targets", "processed_candidates", "error_count"
    ).join(totals, "run_id", "left")
    hit = F.col("error_count").isNotNull()
    state = F.when(F.col("error_count") > 0, "partial").otherwise("completed")
    closed = joined.withColumns(
        {
            "status": F.when(hit, state).otherwise(F.col("status")),
            "finished_at": F.when(hit, now).otherwise(F.col("finished_at")),
        }
    )
    numbers = ["conditions_completed", "business_targets", "processed_candidates", "error_count"]
    return closed.fillna(0, numbers).select(*runs.columns)
