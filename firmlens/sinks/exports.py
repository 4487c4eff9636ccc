"""Export datasets and reports published as versions, and appends that happen once."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.operators.export import CSV_FILES, SHEETS, category_rows, csv_rows, sheet_rows
from firmlens.sinks import manifest

#: Partition column that names the append a row came with.
BATCH_KEY = "append_key"


def _write_csv(rows: DataFrame, path: str) -> None:
    # One Spark CSV dataset per category; a byte order mark has no place in a multi-file dataset.
    rows.write.mode("errorifexists").option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).option("lineSep", "\r\n").csv(path)


def read_published(spark: SparkSession, folder: str, name: str, version: int | None = None) -> DataFrame:
    """A dataset of the newest published version of a folder, or of the given one."""
    path = f"{folder}/{manifest.current(spark, folder, version).folders[name]}"
    return spark.read.option("header", True).option("escape", '"').csv(path) if name.endswith(".csv") else spark.read.parquet(path)


def export_all(annotated: DataFrame, orphans: DataFrame, folder: str, sheets: bool = True) -> manifest.Version:
    """Write the CSV datasets and sheet partitions of one snapshot and publish them as one version.

    The annotated rows are written once; every partition reads that table, so all partitions show the same
    snapshot and the joins run once. A writer that stops half way publishes nothing.
    """
    spark = annotated.sparkSession
    base, data = manifest.current(spark, folder), manifest.new_folder()
    annotated.write.parquet(f"{folder}/{data}/_snapshot")
    orphans.write.parquet(f"{folder}/{data}/_orphans")
    rows = spark.read.parquet(f"{folder}/{data}/_snapshot")
    lost = spark.read.parquet(f"{folder}/{data}/_orphans")
    written: dict[str, str] = {}
    for name, category in CSV_FILES.items():
        written[f"{name}.csv"] = f"{data}/{name}.csv"
        _write_csv(csv_rows(category_rows(rows, lost, category)), f"{folder}/{data}/{name}.csv")
    for sheet, category in SHEETS.items() if sheets else ():
        written[sheet] = f"{data}/{sheet}"
        sheet_rows(category_rows(rows, lost, category)).write.parquet(f"{folder}/{data}/{sheet}")
    return manifest.switch(spark, folder, base, written)


def publish_sheets(sheets: Mapping[str, DataFrame], folder: str) -> manifest.Version:
    """Write named report sheets and publish all of them as one version."""
    spark = next(iter(sheets.values())).sparkSession
    base, data = manifest.current(spark, folder), manifest.new_folder()
    for name, rows in sheets.items():
        rows.write.parquet(f"{folder}/{data}/{name}")
    return manifest.switch(spark, folder, base, {name: f"{data}/{name}" for name in sheets})


def _append(rows: DataFrame, path: str, batch_key: str | None, within: Sequence[str] = ()) -> None:
    keyed = rows.withColumn(BATCH_KEY, F.lit(batch_key or uuid.uuid4().hex))
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*within, BATCH_KEY).parquet(path)


def append_audit(rows: DataFrame, path: str, batch_key: str | None = None) -> None:
    """Append audit metadata, laid out by run for pruned scans.

    Rows of a ``batch_key`` are there once: the same call again replaces what it wrote, run by run, in one commit. Without a key
    every call adds its rows.
    """
    _append(rows, path, batch_key, ["run_id"])


def write_review_template(template: DataFrame, path: str) -> None:
    """Write the review template unless one is already there."""
    template.write.mode("ignore").option("header", True).csv(path)


def save_bucketed(rows: DataFrame, table: str, key: str, buckets: int) -> None:
    """Save a table bucketed and sorted by its join key.

    Pages bucketed by url join candidates and new pages without moving the stored bodies.
    """
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def append_reviews(reviews: DataFrame, path: str, reviewed_at: Column, batch_key: str | None = None) -> None:
    """Append reviews with their time; a repeated ``batch_key`` replaces what it wrote."""
    _append(reviews.withColumn("reviewed_at", reviewed_at), path, batch_key)
