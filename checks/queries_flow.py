"""Ordered logic, work queue, table upkeep, schedules, robots rules, safety stops."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.bindings import EXCLUDED, PROVIDERS, SYNONYMS, bound, table, with_tables
from checks.queries_search import _EXPANDED, _MERGED
from checks.registry import check
from checks.sql_text import HOST
from firmlens.dims import CollectionLimits, SafetyLimits
from firmlens.operators import candidates, queue, robots, safety, schedule, stores
from firmlens.operators.relevance import TEXT_SIGNALS
from firmlens.plans.collect import collect_conditions
from firmlens.session import checkpoint_dir
from firmlens.sinks.bucket_table import BucketTable
from firmlens.sources.payload import parse_payloads, task_payload

_NOW = "2024-01-15 12:00:00"


def _now():
    return F.lit(_NOW).cast("timestamp")


# Outcomes of queued candidates, one per event.
_OUTCOME = {
    "condition_id": "user_id % 9",
    "progress_id": "event_id",
    "max_results": "CAST(3 + user_id % 4 AS BIGINT)",
    "status": "CASE event_type WHEN 'signup' THEN 'success' WHEN 'view' THEN 'excluded' "
    "WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'http_403' WHEN 1 THEN 'timeout' "
    "WHEN 2 THEN 'robots_denied' ELSE 'http_429' END ELSE 'excluded' END",
    "counts_as_target": "event_type = 'signup' AND event_id % 3 = 0",
    "is_official": "event_type IN ('signup', 'click') AND event_id % 2 = 0",
    "extracted": "event_type <> 'error'",
    "has_phone": "event_id % 3 = 0",
}
_OUTCOME_SQL = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in _OUTCOME.items()) + " FROM events"


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*[f"{v} AS {k}" for k, v in _OUTCOME.items()])


@check(
    "selected_within_limits",
    f"""WITH o AS ({_OUTCOME_SQL}), x AS (SELECT DISTINCT condition_id, condition_id % 4 AS excluded FROM o),
n AS (SELECT o.*, excluded, count(*) OVER w AS done, coalesce(sum(CAST(counts_as_target AS INT))
    OVER w, 0) AS targets FROM o JOIN x USING (condition_id)
  WINDOW w AS (PARTITION BY condition_id ORDER BY progress_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT condition_id, progress_id, status FROM n WHERE done + excluded < 60
  AND targets < least(max_results, 5)""",
)
def _selected(spark, sf):
    outcomes = _outcomes(spark, sf)
    before = outcomes.select("condition_id").distinct().withColumn(
        "excluded", F.col("condition_id") % 4
    )
    kept = candidates.select_within_limits(outcomes, before, 60, 5)
    return kept.select("condition_id", "progress_id", "status")


_SUMMARY = f"""WITH o AS ({_OUTCOME_SQL}), s AS (SELECT condition_id, count(*) AS processed_count,
  count(*) FILTER (counts_as_target) AS business_target_count,
  count(*) FILTER (is_official) AS official_count,
  count(*) FILTER (status = 'excluded') AS excluded_count,
  count(*) FILTER (extracted AND NOT has_phone) AS no_phone_count,
  count(*) FILTER (status IN ('http_429', 'http_503', 'timeout', 'transport_error')) AS retry_count,
  count(*) FILTER (status IN ('http_403', 'http_404', 'failed')) AS failed_count,
  count(*) FILTER (status = 'robots_denied') AS robots_denied_count FROM o GROUP BY condition_id),
c AS (SELECT condition_id, string_agg(status || '=' || n, ',' ORDER BY status) AS statuses FROM
  (SELECT condition_id, status, count(*) AS n FROM o GROUP BY ALL) GROUP BY condition_id)"""


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = _outcomes(spark, sf)
    return candidates.condition_summary(outcomes, outcomes)


@check(
    "condition_summary",
    f"""{_SUMMARY} SELECT s.*, processed_count AS candidate_count, statuses,
  CASE WHEN retry_count > 0 THEN 'pending' ELSE 'completed' END AS condition_status
FROM s JOIN c USING (condition_id)""",
)
def _summary(spark, sf):
    entries = F.array_sort(F.map_entries("status_counts"))
    text = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return _summaries(spark, sf).withColumn("statuses", F.array_join(text, ",")).drop("status_counts")


@check(
    "run_totals",
    f"""{_SUMMARY} SELECT 'run-' || CAST(condition_id % 2 AS VARCHAR) AS run_id,
  count(*) FILTER (condition_id <> 4) AS conditions_completed,
  CAST(sum(CASE WHEN condition_id <> 4 THEN business_target_count ELSE 0 END) AS BIGINT)
    AS business_targets,
  CAST(sum(CASE WHEN condition_id <> 4 THEN processed_count ELSE 0 END) AS BIGINT)
    AS processed_candidates,
  count(*) FILTER (condition_id = 4) AS error_count FROM s GROUP BY 1""",
)
def _totals(spark, sf):
    marked = _summaries(spark, sf).withColumns(
        {
            "run_id": F.concat(F.lit("run-"), (F.col("condition_id") % 2).cast("string")),
            "status_ok": F.col("condition_id") != 4,
        }
    )
    return candidates.run_totals(marked)


@check(
    "run_history_rows",
    f"""{_SUMMARY} SELECT 'run-1' AS run_id, condition_id AS condition_index,
  CASE WHEN condition_id = 4 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN condition_id = 4 THEN NULL ELSE processed_count END AS processed,
  CASE WHEN condition_id = 4 THEN 'boom' END AS error_message FROM s""",
)
def _history(spark, sf):
    marked = _summaries(spark, sf).withColumns(
        {
            "run_id": F.lit("run-1"),
            "condition_index": F.col("condition_id"),
            "status_ok": F.col("condition_id") != 4,
            "error_message": F.lit("boom"),
        }
    )
    rows = stores.run_condition_rows(marked, candidates.summary_json(marked), _now())
    return rows.select(
        "run_id", "condition_index", "status",
        F.get_json_object("summary_json", "$.processed_count").cast("bigint").alias("processed"),
        "error_message",
    )


@check(
    "required_results",
    """SELECT 'run-' || CAST(user_id % 40 AS VARCHAR) AS run_id, bool_or(event_type = 'signup')
  AND bool_or(event_type <> 'error') AND bool_or(event_id % 2 = 0 OR event_id % 7 = 0)
  AS has_required_results FROM events GROUP BY 1""",
)
def _required(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "'run-' || CAST(user_id % 40 AS STRING) AS run_id", "event_type = 'signup' AS is_official",
        "event_type <> 'error' AS fetched", "event_id % 2 = 0 AS has_phone",
        "event_id % 7 = 0 AS has_address",
    )
    return candidates.has_required_results(rows)


@check(
    "effective_limits",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 2000 WHEN c_custkey % 5 = 0 THEN 2000
    ELSE c_custkey % 5 END AS max_candidates,
  CASE WHEN c_custkey % 2 = 0 THEN TRUE ELSE FALSE END AS count_no_phone_as_target FROM customer""",
)
def _limits(spark, sf):
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 5 END AS max_candidates",
        "CASE WHEN c_custkey % 2 = 0 THEN TRUE END AS count_no_phone_as_target",
    )
    return candidates.effective_limits(rows, 2000, False)


@check(
    "transport_states",
    """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'robots_denied' WHEN event_id % 10 = 1 THEN
  'timeout' WHEN event_id % 10 = 2 THEN 'transport_error' WHEN user_id % 6 = 0 THEN 'http_403'
  WHEN user_id % 6 = 1 THEN 'http_404' WHEN user_id % 6 = 2 THEN 'http_429' WHEN user_id % 6 = 3 THEN
  'http_503' WHEN user_id % 6 = 4 THEN 'failed' END AS status,
  CASE WHEN event_id % 10 = 0 THEN FALSE WHEN event_id % 10 IN (1, 2) THEN TRUE
    WHEN user_id % 6 IN (2, 3) THEN TRUE WHEN user_id % 6 <> 5 THEN FALSE END AS retryable
FROM events""",
)
def _transport(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id", "CASE event_id % 10 WHEN 0 THEN 'robots_denied' WHEN 1 THEN 'timeout' "
        "WHEN 2 THEN 'refused' WHEN 3 THEN '' END AS fetch_error",
        "CASE user_id % 6 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 503 "
        "WHEN 4 THEN 500 ELSE 204 END AS http_status",
    )
    state = candidates.transport_state(F.col("http_status"), F.col("fetch_error"))
    return rows.withColumn("s", state).select("event_id", "s.status", "s.retryable")


@check(
    "retry_times",
    """WITH e AS (SELECT event_id, date_trunc('second', ts) AS now, event_id % 5 AS k,
  CASE WHEN event_id % 2 = 0 THEN 'http_429' ELSE 'http_503' END AS status FROM events)
SELECT event_id, CAST(epoch(now) AS BIGINT) + CASE WHEN status <> 'http_429' THEN 300 WHEN k = 0 THEN 300
  WHEN k = 1 THEN 900 WHEN k = 2 THEN 300 WHEN k = 3 THEN greatest(300, 3600) ELSE 300 END AS retry_at
FROM e""",
)
def _retry(spark, sf):
    moment = "date_trunc('second', ts)"
    rows = table(spark, sf, "events").selectExpr(
        "event_id", f"{moment} AS now",
        "CASE WHEN event_id % 2 = 0 THEN 'http_429' ELSE 'http_503' END AS status",
        "CASE event_id % 5 WHEN 0 THEN '120' WHEN 1 THEN ' 900 ' WHEN 2 THEN 'soon' WHEN 3 THEN "
        f"date_format({moment} + INTERVAL 1 HOUR, \"E, d MMM yyyy HH:mm:ss 'GMT'\") END AS retry_after",
    )
    at = candidates.retry_available_at(F.col("now"), F.col("status"), F.col("retry_after"))
    return rows.select("event_id", F.unix_seconds(at).alias("retry_at"))




@check(
    "paused_candidates",
    """SELECT event_id, CASE WHEN s_suppkey % 2 = 0 THEN '2024-01-15 13:00:00' END AS paused_until
FROM events LEFT JOIN supplier ON s_suppkey = user_id""",
)
def _paused(spark, sf):
    pauses = table(spark, sf, "supplier").selectExpr(
        "'https://host' || CAST(s_suppkey AS STRING) || '.example' AS origin",
        "CASE WHEN s_suppkey % 2 = 0 THEN TIMESTAMP '2024-01-15 13:00:00' "
        "ELSE TIMESTAMP '2024-01-15 11:00:00' END AS paused_until",
    )
    rows = table(spark, sf, "events").selectExpr(
        "event_id", "'HTTPS://Host' || CAST(user_id AS STRING) || '.example:8443/x' AS url"
    )
    gated = candidates.gate_pauses(rows, pauses, _now())
    return gated.select(
        "event_id", F.date_format("paused_until", "yyyy-MM-dd HH:mm:ss").alias("paused_until")
    )


@check(
    "unfinished_candidates",
    with_tables(
        "b_found b_pages",
        """SELECT query_id, provider, pos FROM b_found f WHERE NOT EXISTS (SELECT 1 FROM b_pages p
  WHERE p.url = f.url AND processing_status NOT IN ('http_429', 'http_503', 'timeout',
    'transport_error'))""",
    ),
)
def _unfinished(spark, sf):
    kept = candidates.drop_terminal(bound(spark, sf, "b_found"), bound(spark, sf, "b_pages"))
    return kept.select("query_id", "provider", "pos")


def _progress(spark: SparkSession, sf: str) -> DataFrame:
    return bound(spark, sf, "b_progress").selectExpr(
        "id", "task_key", "payload", "status", "CAST(NULL AS STRING) AS cursor", "attempts",
        "last_error", "available_at", "CAST(NULL AS TIMESTAMP) AS updated_at",
    )


@check(
    "claimable_tasks",
    with_tables(
        "b_progress",
        f"""SELECT id, task_key FROM b_progress WHERE status = 'pending' AND (available_at IS NULL
  OR available_at <= TIMESTAMP '{_NOW}') ORDER BY id LIMIT 500""",
    ),
)
def _claimable(spark, sf):
    return queue.claimable(_progress(spark, sf), _now(), 500).select("id", "task_key")


@check(
    "claimed_snapshot",
    with_tables(
        "b_progress",
        f"""WITH c AS (SELECT id FROM b_progress WHERE status = 'pending' AND (available_at IS NULL
  OR available_at <= TIMESTAMP '{_NOW}') ORDER BY id LIMIT 500)
SELECT p.id, CASE WHEN c.id IS NULL THEN status ELSE 'running' END AS status,
  CASE WHEN c.id IS NULL THEN attempts ELSE attempts + 1 END AS attempts
FROM b_progress p LEFT JOIN c ON c.id = p.id""",
    ),
)
def _claimed(spark, sf):
    progress = _progress(spark, sf)
    snapshot = queue.mark_running(progress, queue.claimable(progress, _now(), 500), _now())
    return snapshot.select("id", "status", "attempts")


_ACTION = "CASE id % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'fail' WHEN 2 THEN 'retry' ELSE 'cursor' END"


def _applied(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    progress = _progress(spark, sf)
    outcomes = progress.filter("id % 5 < 3").selectExpr(
        "id", f"{_ACTION} AS action", "repeat('e', 2005) AS error",
        f"TIMESTAMP '{_NOW}' AS available_at", "'rank:1' AS cursor",
    )
    return queue.apply_outcomes(progress, outcomes, _now())


@check(
    "applied_outcomes",
    with_tables(
        "b_progress",
        f"""WITH a AS (SELECT *, CASE WHEN id % 5 < 3 AND status = 'running' THEN {_ACTION} ELSE '' END
  AS act FROM b_progress)
SELECT id, CASE act WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' WHEN 'retry' THEN
    'pending' ELSE status END AS status,
  CASE WHEN act IN ('fail', 'retry') THEN 2005 WHEN act = 'complete' THEN NULL
    ELSE length(last_error) END AS error_chars,
  CASE act WHEN 'cursor' THEN 'rank:1' END AS cursor,
  CASE WHEN act = 'retry' THEN '{_NOW}' ELSE strftime(available_at, '%Y-%m-%d %H:%M:%S') END
    AS available_at FROM a""",
    ),
)
def _apply(spark, sf):
    return _applied(spark, sf)[0].select(
        "id", "status", F.length("last_error").alias("error_chars"), "cursor",
        F.date_format("available_at", "yyyy-MM-dd HH:mm:ss").alias("available_at"),
    )


@check(
    "illegal_outcomes",
    with_tables(
        "b_progress",
        f"""SELECT id, {_ACTION} AS action, 'Task ' || id || ' is not running' AS message FROM b_progress
WHERE id % 5 < 3 AND status <> 'running'""",
    ),
)
def _illegal(spark, sf):
    return _applied(spark, sf)[1]


@check(
    "resumed_tasks",
    with_tables(
        "b_progress",
        """SELECT id, CASE status WHEN 'running' THEN 'pending' ELSE status END AS status
FROM b_progress""",
    ),
)
def _resumed(spark, sf):
    return queue.resume_interrupted(_progress(spark, sf), _now()).select("id", "status")


@check(
    "reset_retries",
    with_tables(
        "b_progress",
        """SELECT id, CASE WHEN status <> 'pending' THEN strftime(available_at, '%Y-%m-%d %H:%M:%S') END
  AS available_at FROM b_progress""",
    ),
)
def _reset(spark, sf):
    pauses = table(spark, sf, "supplier").select(F.col("s_name").alias("origin"))
    progress, emptied = queue.reset_retries(_progress(spark, sf), pauses)
    none = emptied.select(F.lit(-1).cast("bigint").alias("id"), F.col("origin").alias("available_at"))
    return progress.select(
        "id", F.date_format("available_at", "yyyy-MM-dd HH:mm:ss").alias("available_at")
    ).unionByName(none)


@check(
    "enqueued_tasks",
    with_tables(
        "b_progress b_found",
        """WITH t AS (SELECT lower(url) AS task_key, page_id * 10 + provider_no AS seq, query FROM b_found
  UNION ALL SELECT 'task-' || CAST(event_id * 2 AS VARCHAR), 1000000 + event_id, 'q' FROM events)
SELECT min(seq) + 5 AS id, task_key, arg_min(query, seq) AS payload, 'pending' AS status, 0 AS attempts
FROM t WHERE task_key NOT IN (SELECT task_key FROM b_progress) GROUP BY task_key""",
    ),
)
def _enqueued(spark, sf):
    found = bound(spark, sf, "b_found").selectExpr(
        "lower(url) AS task_key", "page_id * 10 + provider_no AS seq", "query AS payload"
    )
    more = table(spark, sf, "events").selectExpr(
        "'task-' || CAST(event_id * 2 AS STRING) AS task_key", "1000000 + event_id AS seq",
        "'q' AS payload",
    )
    fresh = queue.enqueue(_progress(spark, sf), found.unionByName(more), _now(), 5)
    return fresh.select("id", "task_key", "payload", "status", "attempts")


_GOOD = "id % 11 <> 0 AND id % 13 <> 0 AND id % 5 >= 1"


@check(
    "parsed_payloads",
    with_tables(
        "b_progress",
        f"""SELECT id, url, 'q' || CAST(id % 7 AS VARCHAR) AS query, 1 + id % 20 AS rank,
  id % 5 AS max_results, CAST(0 AS DOUBLE) AS relevance_score FROM b_progress WHERE {_GOOD}""",
    ),
)
def _payloads(spark, sf):
    good, _ = parse_payloads(_progress(spark, sf))
    return good.select("id", "url", "query", "rank", "max_results", "relevance_score")


@check(
    "unusable_payloads",
    with_tables(
        "b_progress",
        f"""SELECT id, 'pipeline_error' AS error_type, 'Invalid pipeline task payload: ' || id AS message
FROM b_progress WHERE NOT ({_GOOD})""",
    ),
)
def _unusable(spark, sf):
    _, bad = parse_payloads(_progress(spark, sf))
    return bad.select("id", "error_type", "message")


@check(
    "written_payloads",
    with_tables(
        "b_found",
        """SELECT pos, provider, '{"candidate":{"provider":"' || provider || '","query":"q","rank":' || rank
  || ',"relevance_score":0.5,"snippet":"s","title":"t","url":"u"},"condition":{"enabled":true,'
  || '"industry":"i","max_results":' || (rank % 5) || ',"municipality":"m","prefecture":"p"},'
  || '"condition_id":' || condition_id || ',"search_result_id":' || pos || '}' AS payload
FROM b_found""",
    ),
)
def _written(spark, sf):
    fixed = {"query": "q", "snippet": "s", "title": "t", "url": "u", "industry": "i",
             "municipality": "m", "prefecture": "p"}
    columns = {name: F.lit(value) for name, value in fixed.items()}
    columns |= {
        "provider": F.col("provider"), "rank": F.col("rank"), "relevance_score": F.lit(0.5),
        "enabled": F.lit(True), "max_results": F.col("rank") % 5,
        "condition_id": F.col("condition_id"), "search_result_id": F.col("pos"),
    }
    return bound(spark, sf, "b_found").select("pos", "provider", task_payload(columns).alias("payload"))


@check(
    "inserted_queries",
    with_tables(
        "b_found",
        """SELECT min(pos * 10 + provider_no) + 100 AS id, condition_id, query FROM b_found
WHERE condition_id % 3 <> 0 GROUP BY condition_id, query""",
    ),
)
def _new_queries(spark, sf):
    found = bound(spark, sf, "b_found")
    existing = found.filter("condition_id % 3 = 0").select("condition_id", "query").distinct()
    new = found.selectExpr("condition_id", "query", "pos * 10 + provider_no AS seq")
    return stores.insert_queries(existing, new, 100)


@check(
    "inserted_results",
    with_tables(
        "b_found",
        """WITH f AS (SELECT *, pos * 10 + provider_no AS seq FROM b_found),
n AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY seq) = 1)
SELECT seq AS id, query_id, url, provider, rank, CAST(0.25 AS DOUBLE) AS relevance_score FROM n
WHERE (query_id, url) NOT IN (SELECT (query_id, url) FROM b_found WHERE page_id % 7 = 0)""",
    ),
)
def _new_results(spark, sf):
    found = bound(spark, sf, "b_found")
    existing = found.filter("page_id % 7 = 0").select("query_id", "url")
    new = found.selectExpr("*", "pos * 10 + provider_no AS seq", "0.25D AS match_score")
    return stores.insert_results(existing, new).select(
        "id", "query_id", "url", "provider", "rank", "relevance_score"
    )


_SAVED_AGAIN = "(id % 4 = 0 OR id % 3 = 0)"
_UPSERTED = f"""SELECT id AS page_id, url, CASE WHEN {_SAVED_AGAIN} THEN 'again' ELSE processing_status END AS
  processing_status, CASE WHEN id % 3 = 0 THEN '2024-03-01' ELSE fetched_at END AS fetched_at,
  CASE WHEN {_SAVED_AGAIN} THEN '2024-03-01' ELSE updated_at END AS updated_at FROM b_pages"""


def _saved_pages(spark, sf):
    """Pages on record (those whose id three does not divide) and pages saved after that."""
    rows = bound(spark, sf, "b_pages")
    existing = rows.filter("id % 3 <> 0").selectExpr(
        "id AS page_id", "url", "processing_status", "fetched_at", "updated_at"
    )
    new = rows.filter(_SAVED_AGAIN).selectExpr(
        "CASE WHEN id % 3 <> 0 THEN id + 100000 ELSE id END AS page_id", "url",
        "'again' AS processing_status", "'2024-03-01' AS fetched_at", "'2024-03-01' AS updated_at",
    )
    return existing, new


@check("upserted_pages", with_tables("b_pages", _UPSERTED))
def _upserted(spark, sf):
    return stores.upsert_pages(*_saved_pages(spark, sf))


@check("bucket_upserts", with_tables("b_pages", _UPSERTED))
def _bucket_upserts(spark, sf):
    existing, new = _saved_pages(spark, sf)
    folder = f"{checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}"
    kept = BucketTable(spark, folder, existing.schema, "url", 16)
    for changes in (existing, new.filter("page_id % 2 = 0"), new.filter("page_id % 2 <> 0")):
        kept.upsert(changes, stores.upsert_pages)
    return kept.read()


@check(
    "replaced_phones",
    with_tables(
        "b_phones",
        """SELECT company_id, number FROM b_phones WHERE company_id % 4 <> 2
UNION ALL SELECT company_id, 'new-' || number FROM b_phones WHERE company_id % 4 = 2 AND id % 2 = 0""",
    ),
)
def _replaced(spark, sf):
    phones = bound(spark, sf, "b_phones").select("company_id", "number", "id")
    redone = phones.filter("company_id % 4 = 2")
    new = redone.filter("id % 2 = 0").selectExpr("company_id", "'new-' || number AS number", "id")
    return stores.replace_children(phones, new, redone, "company_id").select("company_id", "number")


@check(
    "latest_scores",
    """SELECT user_id AS page_id, arg_max(value, event_id) AS official_score FROM events GROUP BY user_id""",
)
def _latest(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "user_id AS page_id", "value AS official_score", "event_id AS version"
    )
    old, new = rows.filter("version % 3 = 0"), rows.filter("version % 3 <> 0")
    return stores.upsert_latest(old, new, ["page_id"], "version").drop("version")


@check(
    "prefetch_exclusions_saved",
    with_tables(
        "b_pages",
        """SELECT url, CASE WHEN id % 5 = 0 THEN 'excluded' ELSE processing_status END AS processing_status,
  CASE WHEN id % 5 = 0 THEN 'late' ELSE fetch_error END AS fetch_error FROM b_pages
UNION ALL SELECT DISTINCT url || '#new', 'excluded', 'late' FROM b_pages WHERE id % 5 = 1""",
    ),
)
def _saved(spark, sf):
    pages = bound(spark, sf, "b_pages").select(
        "url", "processing_status", "fetch_error", F.col("fetched_at").cast("timestamp"),
        F.col("updated_at").cast("timestamp"),
    )
    known = bound(spark, sf, "b_pages")
    rejected = known.filter("id % 5 = 0").selectExpr(
        "url", "'early' AS reject_reason", "id AS seq"
    ).unionByName(
        known.filter("id % 5 = 0").selectExpr("url", "'late' AS reject_reason", "id + 1 AS seq")
    ).unionByName(
        known.filter("id % 5 = 1").selectExpr(
            "url || '#new' AS url", "'late' AS reject_reason", "id AS seq"
        )
    )
    saved = stores.save_prefetch_exclusions(pages, rejected, _now())
    return saved.select("url", "processing_status", "fetch_error")


@check(
    "domain_pauses",
    """WITH n AS (SELECT 'https://host' || CAST(user_id AS VARCHAR) || '.example' AS origin, event_type,
  event_id FROM events),
l AS (SELECT origin, arg_max(event_type, event_id) AS reason FROM n GROUP BY origin)
SELECT origin, reason FROM l UNION ALL
SELECT 'https://host' || CAST(s_suppkey * 2 AS VARCHAR) || '.example', 'old' FROM supplier
WHERE 'https://host' || CAST(s_suppkey * 2 AS VARCHAR) || '.example' NOT IN (SELECT origin FROM l)""",
)
def _pauses(spark, sf):
    old = table(spark, sf, "supplier").selectExpr(
        "'https://host' || CAST(s_suppkey * 2 AS STRING) || '.example' AS origin",
        f"TIMESTAMP '{_NOW}' AS paused_until", "'old' AS reason",
    )
    retries = table(spark, sf, "events").selectExpr(
        "'https://host' || CAST(user_id AS STRING) || '.example:8080/a' AS url",
        "event_type AS status", "ts AS available_at", "event_id AS seq",
    )
    return stores.pause_domains(old, retries).select("origin", "reason")


@check(
    "condition_states",
    with_tables(
        "b_conditions",
        f"""SELECT id, CASE WHEN id % 3 = 0 THEN 'completed' WHEN id % 3 = 1 THEN 'pending' ELSE status END
  AS status, CASE WHEN id % 3 = 0 THEN '{_NOW}' END AS completed_at FROM b_conditions""",
    ),
)
def _states(spark, sf):
    conditions = bound(spark, sf, "b_conditions").withColumn(
        "completed_at", F.expr("CAST(NULL AS TIMESTAMP)")
    )
    summaries = conditions.filter("id % 3 < 2").select(
        F.col("id").alias("condition_id"),
        candidates.condition_status(F.col("id") % 3).alias("condition_status"),
    )
    done = stores.update_condition_status(conditions, summaries, _now())
    return done.select(
        "id", "status", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at")
    )


_DELAY = "CASE event_id % 4 WHEN 0 THEN 1.5 WHEN 1 THEN 30.25 WHEN 2 THEN 600.0 END"


@check(
    "fetch_schedule",
    with_tables(
        "b_requests",
        f"""WITH r AS (SELECT event_id AS seq, 'https://host' || CAST(user_id % 23 AS VARCHAR) || '.example'
    AS origin, epoch_us(ts) AS t, CAST(coalesce({_DELAY}, 2.0) * 1000000 AS BIGINT) AS d FROM events),
s AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY origin ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM r),
m AS (SELECT *, b + max(t - b) OVER (PARTITION BY origin ORDER BY seq) AS e FROM s)
SELECT seq, origin, CAST(e AS BIGINT) AS eligible_us, CAST(e - t AS BIGINT) AS wait_micros FROM m""",
    ),
)
def _schedule(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id AS seq", "'https://host' || CAST(user_id % 23 AS STRING) || '.example/p' AS url",
        "ts AS requested_at", f"CAST({_DELAY} AS DOUBLE) AS delay_seconds",
    )
    # Small blocks make every origin span many of them.
    planned = schedule.fetch_schedule(rows, block_rows=500)
    return planned.select(
        "seq", "origin", F.unix_micros("eligible_at").alias("eligible_us"), "wait_micros"
    )


_ROBOTS = (
    "'# rules\\nUser-agent: otherbot\\nDisallow: /\\n\\nUser-agent: *\\nDisallow: /en/\\n"
    "Allow: /en/4\\nDisallow: /*.html$\\nDisallow:\\nCrawl-delay: x\\nCrawl-delay: 7\\n"
    "User-agent: scout\\nUser-agent: scoutbot\\nDisallow: /fr/ # all\\nCrawl-delay: 3'"
)


def _robots_files(spark: SparkSession, sf: str) -> DataFrame:
    origins = table(spark, sf, "pages").selectExpr(
        "lower(regexp_extract(url, '^[a-z]+://[^/?#]+', 0)) AS origin"
    ).distinct()
    known = origins.filter("origin NOT LIKE '%://m.%'")
    return known.withColumn("content", F.expr(_ROBOTS))


_ROBOT_PAGES = """r AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://[^/?#]+', 0)) AS origin,
  CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/'
    ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END || regexp_extract(url, '[?][^#]*', 0)
  AS path FROM pages)"""


@check(
    "robots_any_agent",
    f"""WITH {_ROBOT_PAGES} SELECT page_id, CASE WHEN origin LIKE '%://m.%' THEN FALSE
  WHEN path LIKE '%.html' THEN FALSE WHEN path LIKE '/en/4%' THEN TRUE
  WHEN path LIKE '/en/%' THEN FALSE ELSE TRUE END AS robots_allowed,
  CASE WHEN origin NOT LIKE '%://m.%' THEN CAST(7 AS DOUBLE) END AS crawl_delay FROM r""",
)
def _robots_any(spark, sf):
    policies = robots.robots_policies(_robots_files(spark, sf), "Crawler/1.0")
    urls = table(spark, sf, "pages").select("page_id", "url")
    return robots.robots_decisions(urls, policies).drop("url")


@check(
    "robots_named_agent",
    f"""WITH {_ROBOT_PAGES} SELECT page_id, origin NOT LIKE '%://m.%' AND NOT path LIKE '/fr/%'
  AS robots_allowed, CASE WHEN origin NOT LIKE '%://m.%' THEN CAST(3 AS DOUBLE) END AS crawl_delay FROM r""",
)
def _robots_named(spark, sf):
    policies = robots.robots_policies(_robots_files(spark, sf), "ScoutBot/2.1")
    urls = table(spark, sf, "pages").select("page_id", "url")
    return robots.robots_decisions(urls, policies).drop("url")


_MAX_RUN, _MAX_DOMAIN, _MAX_SECONDS = 40, 6, 1900


@check(
    "safety_verdicts",
    with_tables(
        "b_requests",
        f"""WITH a AS (SELECT *, redirect_repeat OR coalesce(error = 'robots_denied', FALSE)
    OR http_status = 429 OR captcha OR block AS hard, http_status = 403 AS f,
    elapsed_seconds >= {_MAX_SECONDS} AS late FROM b_requests),
b AS (SELECT *, row_number() OVER d AS nth, sum(CAST(f AS INT)) OVER d AS fsum FROM a
  WINDOW d AS (PARTITION BY run_id, domain ORDER BY seq)),
c AS (SELECT *, hard OR (f AND fsum >= 2) AS stop FROM b),
e AS (SELECT *, coalesce(bool_or(stop) OVER p, FALSE) AS after_stop FROM c
  WINDOW p AS (PARTITION BY run_id, domain ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, NOT after_stop AND nth <= {_MAX_DOMAIN} AND NOT late AS could FROM e),
h AS (SELECT *, coalesce(sum(CAST(could AS INT)) OVER (PARTITION BY run_id ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= {_MAX_RUN} AS run_full FROM g),
i AS (SELECT *, could AND NOT run_full AS sent FROM h),
j AS (SELECT *, coalesce(bool_or(sent AND stop) OVER p, FALSE) AS stopped,
    coalesce(sum(CAST(sent AS INT)) OVER p, 0) >= {_MAX_DOMAIN} AS domain_full FROM i
  WINDOW p AS (PARTITION BY run_id, domain ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, domain_full AND NOT stopped AND NOT run_full AS over FROM j),
l AS (SELECT *, coalesce(bool_or(over) OVER (PARTITION BY run_id, domain ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS was_over FROM k)
SELECT run_id, seq, sent AS allowed, CASE WHEN stopped OR was_over THEN 'domain_stopped'
  WHEN run_full THEN 'run_http_limit' WHEN domain_full THEN 'domain_http_limit'
  WHEN late THEN 'run_time_limit' WHEN block THEN 'block_page_signal' WHEN captcha THEN 'captcha_signal'
  WHEN size_exceeded OR content_length > 40000 THEN 'response_too_large'
  WHEN content_length > 0 AND content_type = 'application/pdf' THEN 'non_html_content'
  WHEN redirect_repeat THEN 'redirect_loop' WHEN f AND fsum >= 2 THEN 'repeated_403'
  WHEN http_status = 429 THEN 'rate_limited_domain' WHEN error IS NOT NULL THEN error ELSE 'html' END
  AS verdict FROM l""",
    ),
)
def _safety(spark, sf):
    limits = SafetyLimits(
        max_requests=_MAX_RUN, max_requests_per_domain=_MAX_DOMAIN,
        max_runtime_seconds=_MAX_SECONDS, max_response_bytes=40000,
    )
    judged = safety.safety_verdicts(bound(spark, sf, "b_requests"), limits)
    return judged.select("run_id", "seq", "allowed", "verdict")


_SIGNALS = "\n".join(
    "WHEN " + " OR ".join(f"contains(txt, '{word.lower()}')" for word in words)
    + f" THEN 'prefetch_{category}'"
    for category, words in TEXT_SIGNALS.items()
)
_TERMS = """CASE industry WHEN 'AUTOMOBILE' THEN ['automobile', 'the', 'auto']
  WHEN 'BUILDING' THEN ['building', 'er', 'house'] WHEN 'FURNITURE' THEN ['furniture', 'zzz']
  ELSE [lower(industry)] END"""
_CAPS = CollectionLimits(max_queries=3, results_per_query=6, max_candidates=4)


@check(
    "collected_conditions",
    with_tables(
        "b_conditions b_found b_pages",
        f"""WITH {_EXPANDED}, {_MERGED},
asked AS (SELECT e.condition_id, query_pos, query FROM expanded e JOIN b_conditions c
    ON c.id = e.condition_id WHERE enabled AND query_pos <= 3),
found AS (SELECT a.condition_id, c.industry, m.url, m.title, m.snippet,
    query_pos * 5 + merged_rank AS seq FROM merged m JOIN asked a ON a.query = m.query
    JOIN b_conditions c ON c.id = a.condition_id WHERE merged_rank <= 4),
h AS (SELECT *, {HOST.format('url')} AS host, lower(title || ' ' || snippet || ' ' || url) AS txt
  FROM found),
judged AS (SELECT *, CASE WHEN host = 'spam-farm.example.org' OR host LIKE '%.spam-farm.example.org'
    OR host = 'cheap-pills.example.com' OR host LIKE '%.cheap-pills.example.com' THEN 'domain'
  WHEN contains(host, 'wikipedia.org') OR contains(host, '.go.jp') THEN 'public'
  {_SIGNALS} WHEN len(list_filter({_TERMS}, lambda x: contains(txt, x))) = 0 THEN 'low' END AS reason
  FROM h),
keyed AS (SELECT *, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0)) || CASE WHEN
    regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/'
    ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END
    || regexp_extract(url, '[?][^#]*', 0) AS task_key FROM judged),
sighted AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY condition_id, task_key
  ORDER BY seq) = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY condition_id ORDER BY seq) AS n FROM sighted),
cut AS (SELECT *, min(CASE WHEN reason IS NULL AND n >= 4 THEN n END)
  OVER (PARTITION BY condition_id) AS last_n FROM numbered),
discovered AS (SELECT * FROM cut WHERE last_n IS NULL OR n <= last_n),
tasks AS (SELECT * FROM discovered WHERE reason IS NULL
  QUALIFY row_number() OVER (PARTITION BY task_key ORDER BY condition_id, n) = 1),
processed AS (SELECT t.condition_id, t.n, CASE WHEN fetch_error = 'robots_denied' THEN 'robots_denied'
    WHEN fetch_error = 'timeout' THEN 'timeout' WHEN fetch_error IS NOT NULL THEN 'transport_error'
    WHEN http_status IN (403, 404, 429, 503) THEN 'http_' || http_status
    WHEN http_status IS NULL THEN 'failed' ELSE 'excluded' END AS status
  FROM tasks t LEFT JOIN b_pages p ON p.url = t.url),
rejected AS (SELECT condition_id, count(*) AS x FROM discovered WHERE reason IS NOT NULL GROUP BY 1),
kept AS (SELECT p.* FROM (SELECT *, row_number() OVER (PARTITION BY condition_id ORDER BY n) - 1 AS done
  FROM processed) p LEFT JOIN rejected r USING (condition_id) WHERE done + coalesce(x, 0) < 4),
outcomes AS (SELECT condition_id, status FROM kept UNION ALL SELECT condition_id, 'excluded'
  FROM discovered WHERE reason IS NOT NULL)
SELECT d.condition_id, candidate_count, coalesce(processed_count, 0) AS processed_count,
  coalesce(excluded_count, 0) AS excluded_count, coalesce(retry_count, 0) AS retry_count,
  coalesce(failed_count, 0) AS failed_count, coalesce(robots_denied_count, 0) AS robots_denied_count,
  CASE WHEN coalesce(retry_count, 0) > 0 THEN 'pending' ELSE 'completed' END AS condition_status
FROM (SELECT condition_id, count(*) AS candidate_count FROM discovered GROUP BY 1) d
LEFT JOIN (SELECT condition_id, count(*) AS processed_count,
  count(*) FILTER (status = 'excluded') AS excluded_count,
  count(*) FILTER (status IN ('http_429', 'http_503', 'timeout', 'transport_error')) AS retry_count,
  count(*) FILTER (status IN ('http_403', 'http_404', 'failed')) AS failed_count,
  count(*) FILTER (status = 'robots_denied') AS robots_denied_count FROM outcomes GROUP BY 1) o
USING (condition_id)""",
    ),
)
def _collected(spark, sf):
    pages = bound(spark, sf, "b_pages")
    html = table(spark, sf, "pages").select(F.col("page_id").alias("id"), "html")
    fetches = pages.join(html, "id").select(
        "url", "final_url", "http_status", "fetch_error", F.lit(None).cast("string").alias("retry_after"),
        "html",
    )
    conditions = bound(spark, sf, "b_conditions").withColumnRenamed("id", "condition_id")
    results = bound(spark, sf, "b_found").select(
        "query", "provider", "rank", "pos", "title", "url", "snippet"
    )
    none = table(spark, sf, "supplier").filter(F.lit(False))
    run = collect_conditions(
        conditions, results, fetches,
        none.selectExpr("s_name AS origin", f"TIMESTAMP '{_NOW}' AS paused_until"),
        none.selectExpr("s_name AS url", "s_name AS processing_status"),
        _now(), _CAPS, PROVIDERS, SYNONYMS, EXCLUDED,
    )
    return run.summary.select(
        "condition_id", "candidate_count", "processed_count", "excluded_count", "retry_count",
        "failed_count", "robots_denied_count", "condition_status",
    )


@check(
    "latest_states",
    """SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id
FROM events GROUP BY user_id""",
)
def _latest_states(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return stores.latest_per_key(rows, ["user_id"], "event_id")


@check(
    "finished_runs",
    f"""{_SUMMARY}, t AS (SELECT 'run-' || CAST(condition_id % 2 AS VARCHAR) AS run_id,
  count(*) FILTER (condition_id <> 4) AS done, count(*) FILTER (condition_id = 4) AS bad FROM s GROUP BY 1),
r AS (SELECT DISTINCT 'run-' || CAST(user_id % 5 AS VARCHAR) AS run_id FROM events)
SELECT run_id, CASE WHEN done IS NULL THEN 'running' WHEN bad > 0 THEN 'partial' ELSE 'completed' END
  AS status, coalesce(done, 0) AS conditions_completed, coalesce(bad, 0) AS error_count,
  done IS NOT NULL AS finished FROM r LEFT JOIN t USING (run_id)""",
)
def _finished(spark, sf):
    zero = ", ".join(
        f"CAST(0 AS BIGINT) AS {name}"
        for name in ("conditions_completed", "business_targets", "processed_candidates", "error_count")
    )
    runs = table(spark, sf, "events").selectExpr(
        "'run-' || CAST(user_id % 5 AS STRING) AS run_id"
    ).distinct().selectExpr(
        "run_id", "'running' AS status", "CAST(NULL AS TIMESTAMP) AS finished_at",
        *zero.split(", "),
    )
    marked = _summaries(spark, sf).withColumns(
        {
            "run_id": F.concat(F.lit("run-"), (F.col("condition_id") % 2).cast("string")),
            "status_ok": F.col("condition_id") != 4,
        }
    )
    finished = stores.finish_runs(runs, candidates.run_totals(marked), _now())
    return finished.select(
        "run_id", "status", "conditions_completed", "error_count",
        F.col("finished_at").isNotNull().alias("finished"),
    )
