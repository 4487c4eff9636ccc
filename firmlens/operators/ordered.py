"""Order-dependent building blocks that hold up when one key owns a large share of the rows.

``top_per_key`` is limited on the map side by Spark's window group limit, so a hot key sends at most
``k`` rows per task through the shuffle. ``running_totals`` cuts the rows into ranges of equal size by key and
sequence number: a hot key fills many ranges, only one summary row per key and range is scanned in
order, and no task ever holds a whole hot key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.session import cut_lineage

BLOCK_ROWS = 1_000_000


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None
) -> DataFrame:
    """First ``k`` rows of every key in the given order; optionally keep the rank column."""
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def _placed(rows: DataFrame, keys: Sequence[str], seq: str, parts: int | None) -> DataFrame:
    """Written rows in ranges of about equal size by key and sequence number, with their range number ``_part``."""
    order = [*keys, seq]
    ranged = rows.repartitionByRange(*order) if parts is None else rows.repartitionByRange(parts, *order)
    return cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Add, per row, the sums and maxima over the *earlier* rows of its key; keys must not be NULL.

    ``seq`` is unique within a key and gives the order; it may be any number, however sparse. Sums start at 0 and
    maxima at NULL. Ranges are cut by the rows themselves, so a key of any share of the rows is spread over as many ranges
    as its rows fill. Totals per key and range (one row each) are summed up in order, and rows are numbered inside their
    range only. ``parts`` is the number of ranges; Spark chooses it otherwise. The ranged rows are written once.
    """
    sums = dict(sums or {})
    maxima = dict(maxima or {})
    inputs = {f"_in_{name}": column for name, column in {**sums, **maxima}.items()}
    part_keys = [*keys, "_part"]
    rows = _placed(df.withColumns(inputs), keys, seq, parts)

    totals = [F.sum(f"_in_{name}").alias(f"_tot_{name}") for name in sums]
    totals += [F.max(f"_in_{name}").alias(f"_tot_{name}") for name in maxima]
    ranges = rows.groupBy(*part_keys).agg(*totals)
    before = (
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = {f"_off_{name}": F.sum(f"_tot_{name}").over(before) for name in sums}
    offsets |= {f"_off_{name}": F.max(f"_tot_{name}").over(before) for name in maxima}
    ranges = ranges.withColumns(offsets).select(*part_keys, *offsets)

    # The join puts the rows on (key, range), which is what the window inside a range needs as well.
    joined = rows.join(ranges, part_keys)
    inside = (
        Window.partitionBy(*part_keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    )
    result = {}
    for name in sums:
        local = F.coalesce(F.sum(f"_in_{name}").over(inside), F.lit(0))
        result[name] = local + F.coalesce(F.col(f"_off_{name}"), F.lit(0))
    for name in maxima:
        # greatest() skips NULL, so an empty side does not hide the other one.
        result[name] = F.greatest(F.max(f"_in_{name}").over(inside), F.col(f"_off_{name}"))
    return joined.withColumns(result).select(*df.columns, *sums, *maxima)


def join_text(
    df: DataFrame, keys: Sequence[str], order: str, text: str, name: str, separator: str = " | "
) -> DataFrame:
    """Join the distinct texts of a key in first-seen order.

    Repeats collapse before the shuffle that brings a key together, so the collected list grows with
    the distinct texts of the key and not with its rows.
    """
    distinct = df.groupBy(*keys, text).agg(F.min(order).alias("_first"))
    items = F.array_sort(F.collect_list(F.struct("_first", text)))
    joined = F.array_join(F.transform(items, lambda item: item[text]), separator)
    return distinct.groupBy(*keys).agg(joined.alias(name))
