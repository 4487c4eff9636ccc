"""Exact first sightings as keyed state: one remembered row per url in Spark's own state store.

A batch is read once and never joined with earlier output. Its rows are reduced per task to the first row of every url before
the shuffle, so a url that fills a third of a batch costs its tasks, not one of them; then a stateful step per url
asks the store, which lives next to the executor on local disk and is checkpointed by changes. What a restart sees
is the state of the last committed batch, and a batch that runs again replaces its own folder, so every url is written once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructField, StructType

KEY = "url"
_ORDER, _KEY = "_order", "_key"
#: Rows of a task that are reduced together.
_HELD = 1 << 16
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _firsts(rows: pa.Table) -> pa.Table:
    """First row of every url by ``_order``; nulls come last, ties keep the earlier row."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[(_ORDER, "ascending")]))
    codes = rows.column(_KEY).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return rows.take(pa.array(np.sort(np.unique(codes, return_index=True)[1])))


def _first_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= _HELD:
            reduced = _firsts(pa.Table.from_batches(held))
            if reduced.num_rows * 2 > _HELD:
                yield from reduced.to_batches()
                reduced = reduced.slice(0, 0)
            held, count = reduced.to_batches(), reduced.num_rows
    if count:
        yield from _firsts(pa.Table.from_batches(held)).to_batches()


class _FirstSighting(StatefulProcessor):
    """Emits the first row of a url that the store does not know."""

    def __init__(self, columns: list[str], forget_ms: int | None):
        self._columns, self._forget = columns, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "known boolean", self._forget)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self._seen.exists():
            for _ in rows:
                pass
            return
        first = min(rows, key=lambda row: (row[_ORDER] is None, row[_ORDER] if row[_ORDER] is not None else 0))
        self._seen.update((True,))
        yield Row(**{name: first[name] for name in self._columns})

    def close(self) -> None:
        pass


def first_sightings(urls: DataFrame, order: Column, forget_after: int | None = None) -> DataFrame:
    """Stream of the rows of ``urls`` whose ``url`` was not seen before, the lowest ``order`` of a batch first.

    ``forget_after`` is the life of a remembered url in seconds of processing time, after which Spark's timers drop
    its state and the next sighting counts as a first one; without it a url is remembered for ever. Rows without a url
    are no sightings.
    """
    spark = urls.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    ordered = urls.where(urls[KEY].isNotNull()).withColumn(_ORDER, order).withColumn(_KEY, urls[KEY])
    reduced = ordered.mapInArrow(_first_in_task, ordered.schema)
    processor = _FirstSighting(urls.columns, forget_after and forget_after * 1000)
    shape = StructType([StructField(field.name, field.dataType) for field in urls.schema])
    mode = "ProcessingTime" if forget_after else "None"
    return reduced.groupBy(_KEY).transformWithState(processor, shape, "Append", mode)


def state_size(query: StreamingQuery) -> tuple[int, int]:
    """Remembered urls and bytes of the state store after the last batch of a query."""
    operators = (query.lastProgress or {}).get("stateOperators") or [{}]
    return int(operators[0].get("numRowsTotal", 0)), int(operators[0].get("memoryUsedBytes", 0))


def remembered(spark: SparkSession, checkpoint: str) -> int:
    """Urls in the committed state of a checkpoint, read by Spark's state source."""
    state = spark.read.format("statestore").option("stateVarName", "seen").load(checkpoint)
    return state.count()
