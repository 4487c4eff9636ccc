"""Streams over the append-only tables, with the same operators as the batch jobs.

Every sink writes one folder per micro-batch and replaces that folder when a batch is retried, so a lost
executor or a restart never duplicates rows. Current state is the newest row per key over the folders.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from firmlens.dims import SafetyLimits, ScoringRules
from firmlens.operators.extract import address_rows, company_rows, extract_companies, phone_rows
from firmlens.operators.ordered import top_per_key
from firmlens.operators.pages import page_features
from firmlens.operators.safety import safety_verdicts
from firmlens.operators.score import score_pages, scoring_rows
from firmlens.streaming.sightings import first_sightings

BATCH = "batch_id"


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch folder; a retry replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def read_batches(
    spark: SparkSession, path: str, schema: str, before: int | None = None
) -> DataFrame:
    """All rows written so far, with their batch number; an absent table is empty.

    A batch that is being written again must not see its own earlier attempt: ``before`` leaves it out.
    """
    try:
        rows = spark.read.schema(f"{schema}, {BATCH} BIGINT").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, {BATCH} BIGINT")
    return rows if before is None else rows.filter(F.col(BATCH) < before)


def latest_rows(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest row per key over all batches."""
    return top_per_key(table, keys, [F.desc(BATCH)])


def latest_children(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children of the newest version of each parent; older versions are gone as a whole."""
    newest = parents.groupBy(key).agg(F.max(BATCH).alias(BATCH))
    return children.join(newest, [key, BATCH], "left_semi")


def _run(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def score_page_stream(
    pages: DataFrame,
    folder: str,
    checkpoint: str,
    domains: Sequence[str],
    rules: ScoringRules | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Extract and score arriving pages into companies, phones, addresses and scoring tables.

    ``pages`` streams page_id, url, html and the search_* context columns. A page that arrives twice in
    one batch counts once; the parsed batch is written before its four projections read it.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        fresh = top_per_key(batch, ["page_id"], [F.desc("fetched_at")])
        scored = score_pages(extract_companies(page_features(fresh)), domains, rules)
        staged = f"{folder}/scored/{BATCH}={batch_id}"
        scored.select(
            "page_id", "url", "company_name", "store_name", "display_name", "industry", "address",
            "phones", "page_type", "official_score", "business_score", "is_official",
            "is_business_target", "review_required", "reasons", "positive_signals",
            "negative_signals",
        ).write.mode("overwrite").parquet(staged)
        done = batch.sparkSession.read.parquet(staged)
        write_batch(company_rows(done), f"{folder}/companies", batch_id)
        write_batch(phone_rows(done), f"{folder}/phones", batch_id)
        write_batch(address_rows(done), f"{folder}/addresses", batch_id)
        write_batch(scoring_rows(done), f"{folder}/scoring", batch_id)

    return _run(pages, sink, checkpoint, once)


def once_within_horizon(urls: DataFrame, event_time: str, horizon: str) -> DataFrame:
    """First sighting of each url inside a time horizon, with bounded state."""
    return urls.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(["url"])


def once_ever_stream(
    urls: DataFrame, folder: str, checkpoint: str, order: Column, once: bool = False, forget_after: int | None = None
) -> StreamingQuery:
    """Exact first sightings: rows whose url is not in the keyed state yet, lowest ``order`` first, one folder per batch.

    A stream that forgets runs on, because its timers always announce another batch: it cannot stop at what is there.
    """
    if once and forget_after:
        raise ValueError("a stream that forgets urls has no last batch: start it without once")

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, folder, batch_id)

    return _run(first_sightings(urls, order, forget_after), sink, checkpoint, once)


def safety_stream(
    requests: DataFrame,
    folder: str,
    checkpoint: str,
    limits: SafetyLimits | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Verdict for every request as it arrives, requests of a run arriving in seq order.

    Blocked requests never change the state of a run, so the state is the rows that were allowed plus the
    one that overran each domain: at most the request ceiling and one row per domain and run. Each batch
    is judged together with those rows.
    """
    fields = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in requests.schema)
    verdicts = f"{fields}, verdict STRING, allowed BOOLEAN, error_type STRING"

    def sink(batch: DataFrame, batch_id: int) -> None:
        earlier = read_batches(batch.sparkSession, folder, verdicts, before=batch_id)
        state = earlier.filter(F.col("allowed") | (F.col("verdict") == "domain_http_limit"))
        runs = batch.select("run_id").distinct()
        kept = state.join(runs, "run_id", "left_semi").select(*batch.columns)
        marked = kept.withColumn("_old", F.lit(True)).unionByName(
            batch.withColumn("_old", F.lit(False))
        )
        judged = safety_verdicts(marked, limits).filter(~F.col("_old")).drop("_old")
        write_batch(judged, folder, batch_id)

    return _run(requests, sink, checkpoint, once)
