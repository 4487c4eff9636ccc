"""Excluded domains: exact host or subdomain, with category and reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions.text import contains_any
from firmlens.functions.urls import hostname

# Category hints, tested in this order, and public suffixes excluded by rule.
CATEGORY_HINTS = {
    "job": ("job", "jobs", "recruit", "求人"),
    "news": ("news",),
    "blog": ("blog",),
    "map": ("map", "maps"),
    "social": ("facebook", "instagram", "youtube", "x.com"),
    "directory": ("itp", "townpage", "directory"),
    "portal": ("portal", "ranking", "matome"),
    "marketplace": ("rakuten", "amazon", "yahoo"),
    "reservation": ("reserve", "booking", "hotpepper"),
    "government": ("go.jp", "lg.jp"),
    "association": ("association", "or.jp"),
}
SUFFIX_CATEGORIES = {"go.jp": "government", "lg.jp": "government", "or.jp": "association"}
OTHER_CATEGORY = "excluded"


def _under(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith(f".{domain}")


def host_suffixes(host: Column) -> Column:
    """The host and the domains above it, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda start: F.array_join(F.slice(labels, start, F.size(labels)), "."),
    )


def first_listed(host: Column, domains: Sequence[str]) -> Column:
    """First domain of the list, of any length, that is the host or above it; NULL for none."""
    names = F.lit(list(domains)) if domains else F.array().cast("array<string>")
    return F.get(F.array_intersect(names, host_suffixes(host)), F.lit(0))


def domain_category(domain: Column) -> Column:
    """Category of an excluded domain: the first hint that occurs in it."""
    category = None
    for name, hints in CATEGORY_HINTS.items():
        found = contains_any(domain, hints)
        category = F.when(found, name) if category is None else category.when(found, name)
    return category.otherwise(OTHER_CATEGORY)


def with_first_listed(df: DataFrame, host: str, domains: Sequence[str] | DataFrame, name: str) -> DataFrame:
    """Add the first listed domain that is the host or above it; a DataFrame has ``domain`` and ``position``."""
    if not isinstance(domains, DataFrame):
        return df.withColumn(name, first_listed(F.col(host), domains))
    hosts = df.select(host).filter(F.col(host) != "").distinct()
    listed = (
        hosts.select(host, F.explode(host_suffixes(F.col(host))).alias("domain"))
        .join(domains.select("domain", "position"), "domain")
        .groupBy(host)
        .agg(F.min_by("domain", "position").alias(name))
    )
    return df.join(listed, host, "left").select(*df.columns, name)


def _describe(df: DataFrame, configured: Column) -> DataFrame:
    """Turn the configured match (NULL when none) of ``host`` into the decision columns."""
    suffix = F.expr("CAST(NULL AS STRING)")
    suffix_category = F.expr("CAST(NULL AS STRING)")
    for name, category in reversed(list(SUFFIX_CATEGORIES.items())):
        suffix = F.when(_under(F.col("host"), name), name).otherwise(suffix)
        suffix_category = F.when(_under(F.col("host"), name), category).otherwise(suffix_category)
    decided = df.withColumn("_listed", configured).withColumns(
        {
            "matched_domain": F.coalesce(F.col("_listed"), suffix),
            "exclusion_category": F.when(
                F.col("_listed").isNotNull(), domain_category(F.col("_listed"))
            ).otherwise(suffix_category),
        }
    )
    label = F.when(F.col("_listed").isNotNull(), "除外ドメインに一致: ").otherwise(
        "除外ドメイン種別に一致: "
    )
    tail = F.concat(
        F.col("matched_domain"), F.lit(" ("), F.col("exclusion_category"), F.lit(")")
    )
    return decided.withColumns(
        {
            "domain_excluded": F.col("matched_domain").isNotNull(),
            "exclusion_reason": F.concat(label, tail),
        }
    ).drop("_listed")


def domain_exclusion(df: DataFrame, domains: Sequence[str] | DataFrame, url: str = "url") -> DataFrame:
    """Add host, domain_excluded, exclusion_category, matched_domain and exclusion_reason.

    A list of any length becomes one projection without any shuffle. A DataFrame of ``domain`` and ``position``
    is joined on the dot-suffixes of the distinct hosts, so a host with many pages is looked up once;
    Spark decides by measured size whether either side is broadcast. Call this before bodies are parsed: the frame is
    read twice then.
    """
    hosted = df.withColumn("host", F.rtrim(hostname(F.col(url)), F.lit(".")))
    joined = with_first_listed(hosted, "host", domains, "_configured")
    return _describe(joined, F.col("_configured")).drop("_configured")
