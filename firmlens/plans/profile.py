"""Page profile: how many pages of each type every host has, and which hosts are excluded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.functions.urls import export_url_key
from firmlens.operators.domains import domain_exclusion
from firmlens.operators.page_type import PAGE_TYPE_FEATURES, with_page_type
from firmlens.operators.pages import page_features


def page_profile(pages: DataFrame, domains: Sequence[str] | DataFrame) -> DataFrame:
    """Pages and distinct entities per host, exclusion category and page type.

    Hosts are looked up before the bodies are parsed, so no body is parsed twice. Counting per entity key first keeps a host
    with a large share of the pages spread over all tasks until its counts are small.
    """
    known = domain_exclusion(pages.select("url", "html"), domains)
    typed = with_page_type(page_features(known, wanted=PAGE_TYPE_FEATURES))
    groups = [
        "host", F.coalesce("exclusion_category", F.lit("")).alias("exclusion_category"), "page_type"
    ]
    entities = typed.select(*groups, export_url_key(F.col("url")).alias("entity"))
    names = ["host", "exclusion_category", "page_type"]
    per_entity = entities.groupBy(*names, "entity").agg(F.count("*").alias("_n"))
    return per_entity.groupBy(*names).agg(
        F.sum("_n").alias("page_count"), F.count("*").alias("entity_count")
    )
