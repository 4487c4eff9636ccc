"""Work-queue table as data: every operator takes a snapshot and returns the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


PROGRESS = (
    "id bigint, task_key string, payload string, status string, cursor string, attempts int, "
    "last_error string, available_at timestamp, updated_at timestamp"
)


def enqueue(progress: DataFrame, tasks: DataFrame, now: Column, id_offset: int = 0) -> DataFrame:
    """New pending rows for unseen task keys; the earliest ``seq`` of a key wins.

    ``tasks`` has task_key, payload and seq, a whole number unique over all tasks. The new id is
    ``id_offset + seq``, so no global numbering pass is needed.
    """
    first = tasks.groupBy("task_key").agg(F.min_by("payload", "seq").alias("payload"), F.min("seq").alias("seq"))
    fresh = first.join(progress.select("task_key"), "task_key", "left_anti")
    none = F.expr("CAST(NULL AS STRING)")
    return fresh.select(
        (F.col("seq") + F.lit(id_offset)).cast("bigint").alias("id"), "task_key", "payload",
        F.lit("pending").alias("status"), none.alias("cursor"), F.lit(0).alias("attempts"),
        none.alias("last_error"), F.expr("CAST(NULL AS TIMESTAMP)").alias("available_at"),
        now.alias("updated_at"),
    )


def claimable(progress: DataFrame, now: Column, limit: int) -> DataFrame:
    """Oldest pending tasks that may run now."""
    due = F.col("available_at").isNull() | (F.col("available_at") <= now)
    return progress.filter((F.col("status") == "pending") & due).orderBy("id").limit(limit)


def mark_running(progress: DataFrame, claimed: DataFrame, now: Column) -> DataFrame:
    """Snapshot after claiming: status running, one more attempt."""
    marks = claimed.select("id", F.lit(True).alias("_claimed"))
    joined = progress.join(marks, "id", "left")
    taken = F.col("_claimed").isNotNull() & (F.col("status") == "pending")
    return joined.withColumns(
        {
            "attempts": F.when(taken, F.col("attempts") + 1).otherwise(F.col("attempts")),
            "updated_at": F.when(taken, now).otherwise(F.col("updated_at")),
            "status": F.when(taken, "running").otherwise(F.col("status")),
        }
    ).select(*progress.columns)


def apply_outcomes(progress: DataFrame, outcomes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Finish running tasks; return the next snapshot and the illegal transitions.

    ``outcomes`` has id, action (complete, fail, retry or cursor), error, available_at and cursor.
    Only a running task may change; any other target is reported instead of applied. Outcomes carry error texts whose length no
    estimate knows, so both sides are shuffled instead of broadcasting one.
    """
    changes = outcomes.select(
        "id", "action", F.col("error").alias("_error"), F.col("available_at").alias("_available"),
        F.col("cursor").alias("_cursor"),
    )
    joined = progress.join(changes.hint("merge"), "id", "left")
    legal = F.col("action").isNotNull() & (F.col("status") == "running")
    action = F.when(legal, F.col("action")).otherwise("")
    status = (
        F.when(action == "complete", "completed")
        .when(action == "fail", "failed")
        .when(action == "retry", "pending")
        .otherwise(F.col("status"))
    )
    error = F.when(action == "complete", F.expr("CAST(NULL AS STRING)")).when(
        action.isin("fail", "retry"), F.col("_error")
    )
    updated = joined.select(
        "id", "task_key", "payload",
        status.alias("status"),
        F.when(action == "cursor", F.col("_cursor")).otherwise(F.col("cursor")).alias("cursor"),
        "attempts",
        error.otherwise(F.col("last_error")).alias("last_error"),
        F.when(action == "retry", F.col("_available"))
        .otherwise(F.col("available_at"))
        .alias("available_at"),
        F.when(legal, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    running = progress.filter(F.col("status") == "running").select("id")
    illegal = outcomes.join(running, "id", "left_anti").select(
        "id", "action", F.format_string("Task %d is not running", F.col("id")).alias("message")
    )
    return updated, illegal


def resume_interrupted(progress: DataFrame, now: Column) -> DataFrame:
    """Running tasks go back to pending."""
    running = F.col("status") == "running"
    return progress.withColumns(
        {
            "updated_at": F.when(running, now).otherwise(F.col("updated_at")),
            "status": F.when(running, "pending").otherwise(F.col("status")),
        }
    )


def reset_retries(progress: DataFrame, pauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delayed tasks become claimable at once and all domain pauses end."""
    waiting = (F.col("status") == "pending") & F.col("available_at").isNotNull()
    cleared = F.when(waiting, F.expr("CAST(NULL AS TIMESTAMP)")).otherwise(F.col("available_at"))
    return progress.withColumn("available_at", cleared), pauses.filter(F.lit(False))
