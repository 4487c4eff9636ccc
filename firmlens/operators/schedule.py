"""Polite fetch schedule: when each request of an origin may start."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions.urls import fetch_origin
from firmlens.operators.ordered import BLOCK_ROWS

DEFAULT_DELAY_SECONDS = 2.0


def fetch_schedule(
    requests: DataFrame,
    default_delay: float = DEFAULT_DELAY_SECONDS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add origin, eligible_at and wait_micros to requests.

    ``requests`` has seq (unique whole number in arrival order), url, requested_at and delay_seconds
    (NULL means the default). Each request starts at its arrival or one delay after the previous start
    of its origin, whichever is later. With D the sum of the earlier delays this recurrence is
    ``D + max(arrival - D)`` over the requests so far. Both parts are computed inside blocks of
    consecutive seq numbers and shifted by what the earlier blocks add up to, so a busy origin is
    spread over many tasks. Times stay whole microseconds.
    """
    micros = F.bround(
        F.coalesce("delay_seconds", F.lit(default_delay)) * F.lit(1e6), 0
    ).cast("bigint")
    prepared = requests.withColumns(
        {
            "origin": fetch_origin(F.col("url")),
            "_arrival": F.unix_micros(F.col("requested_at").cast("timestamp")),
            "_delay": micros,
            "_block": F.floor(F.col("seq") / F.lit(block_rows)),
        }
    ).filter(F.col("origin").isNotNull())
    keys = ["origin", "_block"]
    in_block = Window.partitionBy(*keys).orderBy("seq")
    earlier = in_block.rowsBetween(Window.unboundedPreceding, -1)
    local = prepared.withColumn("_d", F.coalesce(F.sum("_delay").over(earlier), F.lit(0)))
    local = local.withColumn("_slack", F.col("_arrival") - F.col("_d"))
    blocks = local.groupBy(*keys).agg(
        F.sum("_delay").alias("_delays"), F.max("_slack").alias("_block_slack")
    )
    before = Window.partitionBy("origin").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shift = F.coalesce(F.sum("_delays").over(before), F.lit(0))
    blocks = blocks.withColumn("_shift", shift)
    best = F.max(F.col("_block_slack") - F.col("_shift")).over(before)
    shifts = blocks.select(*keys, "_shift", best.alias("_best_before"))
    scanned = local.join(shifts, keys).withColumn("_best", F.max("_slack").over(in_block))
    start = F.col("_shift") + F.col("_d") + F.greatest(
        "_best_before", F.col("_best") - F.col("_shift")
    )
    return scanned.select(
        *requests.columns, "origin", F.timestamp_micros(start).alias("eligible_at"),
        (start - F.col("_arrival")).alias("wait_micros"),
    )
