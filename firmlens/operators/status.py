"""Status snapshot of all tables as one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNNING_URL = "$.candidate.url"


def companies_without_phone(companies: DataFrame, phones: DataFrame) -> DataFrame:
    owners = phones.select(F.col("company_id").alias("id"))
    return companies.join(owners, "id", "left_anti")


def running_urls(progress: DataFrame) -> DataFrame:
    """URLs of the tasks that are running, as a table: their number has no bound."""
    url = F.get_json_object("payload", RUNNING_URL)
    return (
        progress.filter(F.col("status") == "running")
        .select("id", url.alias("url"))
        .filter(F.coalesce("url", F.lit("")) != "")
    )


def status_snapshot(
    conditions: DataFrame,
    scoring: DataFrame,
    phones: DataFrame,
    companies: DataFrame,
    progress: DataFrame,
    errors: DataFrame,
    pages: DataFrame,
    today: Column,
) -> DataFrame:
    """Counters of the whole store as (metric, value) rows, one partial aggregate per table."""
    status = F.col("status")
    waiting = (status == "pending") & F.col("available_at").isNotNull()
    flag = "is_business_target"
    parts = [
        conditions.agg(
            F.count("*").alias("total_conditions"),
            F.count_if(status == "completed").alias("completed_conditions"),
            F.count_if(status == "pending").alias("pending_conditions"),
            F.count_if(status == "processing").alias("processing_conditions"),
        ),
        scoring.agg(
            F.count_if(flag).alias("business_targets"),
            F.count_if("is_official").alias("official_sites"),
            F.count_if("review_required").alias("review_required"),
            F.count_if(~F.col(flag)).alias("excluded"),
        ),
        phones.agg(F.count_if(F.col("kind") == "mobile").alias("mobile_phones")),
        companies_without_phone(companies, phones).agg(F.count("*").alias("no_phone_companies")),
        progress.agg(
            F.count_if(waiting).alias("retry_waiting"),
            F.date_format(F.min(F.when(waiting, F.col("available_at"))), "yyyy-MM-dd HH:mm:ss").alias(
                "next_retry_at"
            ),
        ),
        running_urls(progress).agg(F.count("*").alias("running_urls")),
        errors.agg(F.count("*").alias("errors")),
        pages.agg(
            F.count_if(F.to_date("fetched_at") == today).alias("pages_today"),
            F.count("*").alias("pages_total"),
        ),
    ]
    stacked = None
    for part in parts:
        pairs = [
            F.struct(F.lit(name).alias("metric"), F.col(name).cast("string").alias("value"))
            for name in part.columns
        ]
        rows = part.select(F.inline(F.array(*pairs)))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return stacked
