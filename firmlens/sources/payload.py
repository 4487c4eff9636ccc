"""Task payloads: JSON text back to typed columns, unreadable ones split off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDIDATE = (
    "url STRING, query STRING, provider STRING, rank INT, title STRING, snippet STRING, "
    "relevance_score DOUBLE"
)
CONDITION = (
    "prefecture STRING, municipality STRING, industry STRING, max_results INT, enabled BOOLEAN"
)
PAYLOAD = (
    f"candidate STRUCT<{CANDIDATE}>, condition STRUCT<{CONDITION}>, condition_id BIGINT, "
    "search_result_id BIGINT"
)
_REQUIRED = (
    "condition.prefecture", "condition.municipality", "condition.industry", "condition.max_results",
    "condition.enabled", "candidate.url", "candidate.query", "candidate.provider",
    "candidate.rank", "candidate.title", "candidate.snippet", "condition_id", "search_result_id",
)


def _usable(payload: Column) -> Column:
    def field(path: str) -> Column:
        value = payload
        for name in path.split("."):
            value = value[name]
        return value

    verdict = field("condition.max_results") >= 1
    for path in _REQUIRED:
        verdict = verdict & field(path).isNotNull()
    for name in ("prefecture", "municipality", "industry"):
        verdict = verdict & (F.btrim(field(f"condition.{name}")) != "")
    return F.coalesce(verdict, F.lit(False))


def parse_payloads(progress: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks with typed candidate and condition, and the tasks whose payload is unusable.

    A payload is one element of an array that a filter keeps or empties, so each side parses it once and no filter can be
    pushed below the parse.
    """
    payloads = F.array(F.from_json("payload", PAYLOAD))
    usable = progress.select("id", "task_key", F.explode(F.filter(payloads, _usable)).alias("_p"))
    score = F.coalesce("_p.candidate.relevance_score", F.lit(0.0))
    good = usable.select(
        "id", "task_key", "_p.candidate.url", "_p.candidate.query", "_p.candidate.provider",
        "_p.candidate.rank", "_p.candidate.title", "_p.candidate.snippet",
        score.alias("relevance_score"), "_p.condition.prefecture", "_p.condition.municipality",
        "_p.condition.industry", "_p.condition.max_results", "_p.condition.enabled",
        "_p.condition_id", "_p.search_result_id",
    )
    message = F.format_string("Invalid pipeline task payload: %d", F.col("id"))
    bad = progress.filter(~F.exists(payloads, _usable)).select(
        "id", "task_key", F.lit("pipeline_error").alias("error_type"), message.alias("message")
    )
    return good, bad


def task_payload(columns: dict[str, Column]) -> Column:
    """Key-sorted JSON payload of a candidate; ``columns`` maps field names to expressions."""

    def struct(names: tuple[str, ...]) -> Column:
        return F.struct(*[columns[name].alias(name) for name in names])

    candidate = struct(
        ("provider", "query", "rank", "relevance_score", "snippet", "title", "url")
    )
    condition = struct(("enabled", "industry", "max_results", "municipality", "prefecture"))
    return F.to_json(
        F.struct(
            candidate.alias("candidate"), condition.alias("condition"),
            columns["condition_id"].alias("condition_id"),
            columns["search_result_id"].alias("search_result_id"),
        )
    )
