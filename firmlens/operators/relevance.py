"""Accept or reject a search result before any page is looked at."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions.text import contains_any
from firmlens.functions.urls import hostname
from firmlens.operators.domains import with_first_listed

# Host fragments and text signals of non-business results, in the order they are tested.
PUBLIC_HOST_FRAGMENTS = ("wikipedia.org", ".go.jp")
TEXT_SIGNALS = {
    "government": ("県公式", "市役所", "自治体", "pref.okinawa", "city."),
    "news": ("ニュース", "新聞", "沖縄タイムス", "news"),
    "tourism": ("観光", "旅行", "トラベル", "tour", "travel"),
    "article": ("ランキング", "まとめ", "おすすめ記事", "特集"),
}


def industry_terms(industry: Column, synonyms: Mapping[str, Sequence[str]]) -> Column:
    """Lower-case terms that show a result is about the industry.

    An exact alias wins; otherwise the first alias, in table order, that contains the industry, is
    contained in it, or has a term containing it. The industry itself always counts.
    """
    own = F.lower(industry)
    none = F.array().cast("array<string>")
    exact, related = none, none
    for alias, values in reversed(list(synonyms.items())):
        lowered = list(dict.fromkeys(value.lower() for value in values if value.strip()))
        terms = F.array(*[F.lit(value) for value in lowered])
        exact = F.when(industry == alias, terms).otherwise(exact)
        near = F.contains(F.lit(alias), industry) | F.contains(industry, F.lit(alias))
        for value in lowered:
            near = near | F.contains(F.lit(value), industry)
        related = F.when(near, terms).otherwise(related)
    found = F.when(F.size(exact) > 0, exact).otherwise(related)
    return F.array_distinct(F.concat(F.array(own), found))


def _substrings(text: Column) -> Column:
    """All distinct substrings of a short text, the empty one included."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(
        starts,
        lambda at: F.transform(
            F.sequence(F.lit(1), F.length(text) - at + 1), lambda size: F.substring(text, at, size)
        ),
    )
    return F.array_distinct(F.array_append(F.flatten(parts), F.lit("")))


def industry_term_rows(industries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """The terms of ``industry_terms`` for every distinct ``industry``, from a synonym table of any length.

    ``synonyms`` has alias, terms and ``place``, the order of the aliases. "Contains", in either direction, is an equi-join on
    substrings: those of the industries meet the aliases, and those of aliases and terms meet the industries. Both are names of a
    few words; a text of n characters gives at most n (n + 1) / 2 keys.
    """
    distinct = industries.select("industry").where("industry is not null").distinct()
    lowered = F.array_distinct(F.transform(F.filter("terms", lambda term: F.trim(term) != ""), F.lower))
    lists = synonyms.select("alias", "place", lowered.alias("terms"))
    exact = (
        distinct.join(lists.where(F.size("terms") > 0), F.col("industry") == F.col("alias"))
        .select("industry", F.col("terms").alias("exact"))
    )
    inside = (
        distinct.select("industry", F.explode(_substrings(F.col("industry"))).alias("alias"))
        .join(lists, "alias").select("industry", "place", "terms")
    )
    names = F.array_append("terms", F.col("alias"))
    around = (
        lists.select("place", "terms", F.explode(F.array_distinct(F.flatten(F.transform(names, _substrings)))).alias("industry"))
        .join(distinct, "industry").select("industry", "place", "terms")
    )
    near = inside.unionByName(around).groupBy("industry").agg(F.min_by("terms", "place").alias("near"))
    found = F.coalesce("exact", "near", F.array().cast("array<string>"))
    return (
        distinct.join(exact, "industry", "left").join(near, "industry", "left")
        .select("industry", F.array_distinct(F.concat(F.array(F.lower("industry")), found)).alias("terms"))
    )


def prefetch_relevance(
    results: DataFrame, synonyms: Mapping[str, Sequence[str]] | DataFrame, excluded_domains: Sequence[str] | DataFrame
) -> DataFrame:
    """Add ``accepted`` and the ``reject_reason`` of a result; needs url, title, snippet, industry.

    Excluded domains are a list or a DataFrame of ``domain`` and ``position``, either of any length. Synonyms are a short
    mapping, which becomes one expression, or the DataFrame of ``synonym_rows``, which is joined on the distinct industries.
    """
    blank = F.lit("")
    text = F.lower(
        F.concat(
            F.coalesce("title", blank), F.lit(" "), F.coalesce("snippet", blank), F.lit(" "),
            F.coalesce("url", blank),
        )
    )
    if isinstance(synonyms, DataFrame):
        terms = industry_term_rows(results, synonyms).withColumnRenamed("terms", "_terms")
        prepared = results.join(terms, "industry", "left")
    else:
        prepared = results.withColumn("_terms", industry_terms(F.col("industry"), synonyms))
    prepared = prepared.withColumns({"_host": F.rtrim(hostname(F.col("url")), F.lit(".")), "_text": text})
    if isinstance(excluded_domains, DataFrame):
        bare = F.ltrim(F.lower("domain"), F.lit("."))
        listed = excluded_domains.select(bare.alias("domain"), "position")
    else:
        listed = [domain.lower().lstrip(".") for domain in excluded_domains]
    prepared = with_first_listed(prepared, "_host", listed, "_excluded")
    reason = F.when(F.col("_excluded").isNotNull(), "prefetch_excluded_domain").when(
        contains_any(F.col("_host"), PUBLIC_HOST_FRAGMENTS), "prefetch_public_or_wikipedia"
    )
    for category, signals in TEXT_SIGNALS.items():
        reason = reason.when(contains_any(F.col("_text"), signals), f"prefetch_{category}")
    relevant = F.exists("_terms", lambda term: F.contains(F.col("_text"), term))
    reason = reason.when(~relevant, "prefetch_low_industry_relevance")
    return (
        prepared.withColumn("reject_reason", reason)
        .withColumn("accepted", F.col("reject_reason").isNull())
        .select(*results.columns, "accepted", "reject_reason")
    )
