"""Manual review files: validated as a whole, appended or refused as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.functions.urls import is_web_url
from firmlens.operators.report import REVIEW_HEADERS
from firmlens.operators.review import JUDGMENTS
from firmlens.sources.conditions import FileIssues
from firmlens.sources.csv_files import CsvFiles, read_csv_files

JUDGMENT_COLUMNS = (
    "company_name_judgment", "store_name_judgment", "phone_judgment", "address_judgment",
    "industry_judgment", "official_site_judgment", "business_target_judgment",
    "overall_judgment",
)
URL_HEADER, NOTE_HEADER = REVIEW_HEADERS[0], REVIEW_HEADERS[-1]


class ReviewFileError(FileIssues):
    """A review file cannot be imported."""


def _cell(name: str) -> Column:
    return F.coalesce(F.try_element_at("cells", F.lit(name)), F.lit(""))


def check_reviews(files: CsvFiles) -> tuple[DataFrame, DataFrame]:
    """Review rows and the messages about missing columns, bad urls and unknown judgments."""
    key = "path"
    headers = F.array(*[F.lit(name) for name in REVIEW_HEADERS])
    missing = F.array_except(headers, F.when(F.col("encoding").isNotNull(), F.col("columns")).otherwise(F.array().cast("array<string>")))
    checked = files.headers.withColumn("_missing", missing)
    broken = checked.filter(F.size("_missing") > 0).select(
        key, F.lit(1).alias("row_number"),
        F.concat(F.lit("Missing review columns: "), F.array_join("_missing", ", ")).alias("message"),
    )
    values = F.array(*[_cell(name) for name in REVIEW_HEADERS[1:9]])
    rows = (
        files.rows(checked.filter(F.size("_missing") == 0))
        .withColumns({"url": _cell(URL_HEADER), "note": _cell(NOTE_HEADER), "_values": values})
    )
    unknown = F.filter("_values", lambda value: ~value.isin(*JUDGMENTS))
    label = F.concat(F.lit("row "), F.col("row_number").cast("string"))
    message = F.when(~is_web_url(F.col("url")), F.concat(label, F.lit(": invalid URL"))).when(
        F.size(unknown) > 0, F.concat(label, F.lit(": unknown judgment: "), F.get(unknown, F.lit(0)))
    )
    judged = rows.withColumn("message", message)
    good = judged.filter(F.col("message").isNull()).select(
        key, "row_number", "url",
        *[F.col("_values")[index].alias(name) for index, name in enumerate(JUDGMENT_COLUMNS)],
        "note",
    )
    wrong = judged.filter(F.col("message").isNotNull()).select(key, "row_number", "message")
    return good, broken.unionByName(wrong)


def read_reviews(spark: SparkSession, path: str, reviewer: str | None = None) -> DataFrame:
    """Reviews of a CSV file; any bad row refuses the file."""
    good, issues = check_reviews(read_csv_files(spark, path))
    if not issues.isEmpty():
        raise ReviewFileError(issues, "%.0s%s")
    return good.withColumn("reviewer", F.lit(reviewer))
