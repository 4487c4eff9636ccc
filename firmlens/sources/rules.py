"""Rule files as DataFrames: excluded domains and industry keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.functions.text import py_strip


def clean_domains(lines: DataFrame) -> DataFrame:
    """Excluded domains of a table of ``position`` and ``line``: comments and blanks dropped."""
    line = py_strip(F.col("line"))
    return lines.filter((line != "") & ~line.startswith("#")).select(
        F.rtrim(F.lower(line), F.lit(".")).alias("domain"), "position"
    )


def read_excluded_domains(spark: SparkSession, path: str) -> DataFrame:
    """Domains of a text file with one per line, in file order."""
    text = spark.read.text(path, wholetext=True)
    return clean_domains(
        text.select(F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("position", "line"))
    )


def synonym_rows(industries: DataFrame) -> DataFrame:
    """Alias table of industries with ``position``, ``display_name`` and ``keywords``.

    Every display name and keyword is an alias of its group's whole term list; a later group wins. ``place`` is where an
    alias was first named, which is the order of the table.
    """
    terms = F.array_distinct(
        F.filter(
            F.transform(F.concat(F.array("display_name"), F.col("keywords")), py_strip),
            lambda term: term != "",
        )
    )
    exploded = industries.select("position", terms.alias("terms")).select(
        "position", "terms", F.posexplode("terms").alias("at", "alias")
    )
    return exploded.groupBy("alias").agg(
        F.max_by("terms", "position").alias("terms"), F.min(F.struct("position", "at")).alias("place")
    )
