"""Query expansion, and merging of search results across providers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.dims import UNKNOWN_PRIORITY
from firmlens.functions.text import lookup, py_strip
from firmlens.functions.urls import normalize_search_url
from firmlens.operators.ordered import top_per_key

# Words of the query templates and of the term filter.
OFFICIAL_SITE = "公式サイト"
OFFICIAL = "公式"
SITE_PREFIX = "site:"
JP_SITE = "site:.jp"
CITY, WARD = "市", "区"

# Failures after which a provider is not asked again in the same run.
STOPPING_FAILURES = ("http_403", "http_429", "captcha", "block")

_TERM = r'(?U)[^\s\x1c-\x1f"]+'


def _quoted(term: Column) -> Column:
    return F.concat(F.lit('"'), py_strip(F.replace(term, F.lit('"'), F.lit(" "))), F.lit('"'))


def official_site_query(prefecture: Column, municipality: Column, industry: Column) -> Column:
    """One conservative query with each user term as a phrase."""
    return F.concat_ws(
        " ", _quoted(prefecture), _quoted(municipality), _quoted(industry), F.lit(OFFICIAL_SITE)
    )


def _remove_suffix(text: Column, suffix: str) -> Column:
    cut = F.left(text, F.length(text) - F.lit(len(suffix)))
    return F.when(text.endswith(suffix), cut).otherwise(text)


def query_variants(
    municipality: Column, industry: Column, synonyms: Mapping[str, Sequence[str]]
) -> Column:
    """Ordered, distinct query texts of one condition; synonyms come from a short mapping."""
    first = second = industry
    for alias, terms in synonyms.items():
        others = [term for term in dict.fromkeys(t.strip() for t in terms if t.strip()) if term != alias]
        if not others:
            continue
        first = F.when(industry == alias, others[0]).otherwise(first)
        second = F.when(industry == alias, others[min(1, len(others) - 1)]).otherwise(second)
    return _variants(municipality, industry, first, second)


def _variants(municipality: Column, industry: Column, first: Column, second: Column) -> Column:
    short = _remove_suffix(_remove_suffix(municipality, CITY), WARD)
    variants = F.array(
        F.concat_ws(" ", municipality, industry),
        F.concat_ws(" ", municipality, first),
        F.concat_ws(" ", short, second),
        F.concat_ws(" ", municipality, industry, F.lit(OFFICIAL)),
        F.concat_ws(" ", F.lit(JP_SITE), municipality, industry),
    )
    return F.array_distinct(F.transform(variants, py_strip))


def _other_terms(synonyms: DataFrame) -> DataFrame:
    """First and second term of every alias that is not the alias itself; aliases without one are left out."""
    stripped = F.filter(F.transform("terms", py_strip), lambda term: (term != "") & (term != F.col("alias")))
    others = synonyms.select(F.col("alias").alias("_alias"), F.array_distinct(stripped).alias("_others")).where(F.size("_others") > 0)
    return others.select("_alias", F.get("_others", F.lit(0)).alias("_first"), F.get("_others", F.least(F.lit(1), F.size("_others") - 1)).alias("_second"))


def expand_queries(
    conditions: DataFrame, synonyms: Mapping[str, Sequence[str]] | DataFrame, max_queries: int = 5
) -> DataFrame:
    """One row per condition and query, numbered from 1 in template order.

    Synonyms are a short mapping or the DataFrame of ``synonym_rows``, which is joined on its aliases.
    """
    municipality, industry = py_strip(F.col("municipality")), py_strip(F.col("industry"))
    if isinstance(synonyms, DataFrame):
        joined = conditions.join(_other_terms(synonyms), industry == F.col("_alias"), "left")
        first, second = (F.coalesce(name, industry) for name in ("_first", "_second"))
        variants = _variants(municipality, industry, first, second)
    else:
        joined, variants = conditions, query_variants(municipality, industry, synonyms)
    return joined.select(
        *conditions.columns, F.posexplode(F.slice(variants, 1, max_queries)).alias("_pos", "query")
    ).select(*conditions.columns, (F.col("_pos") + 1).alias("query_pos"), "query")


def query_terms(query: Column) -> Column:
    """Distinct lower-case search terms without site filters and the official-site marker."""
    found = F.regexp_extract_all(query, F.lit(_TERM), 0)
    kept = F.filter(found, lambda term: ~term.startswith(SITE_PREFIX) & (term != OFFICIAL))
    return F.array_distinct(F.transform(kept, F.lower))


def query_match_rate(query: Column, title: Column, snippet: Column, url: Column) -> Column:
    """Share of the query terms that occur in title, snippet or URL."""
    blank = F.lit("")
    evidence = F.lower(
        F.concat(
            F.coalesce(title, blank), F.lit(" "), F.coalesce(snippet, blank), F.lit(" "),
            F.coalesce(url, blank),
        )
    )
    terms = query_terms(query)
    hits = F.size(F.filter(terms, lambda term: F.contains(evidence, term)))
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(hits / F.size(terms))


def chain_score(match: Column, priority: Column, rank: Column) -> Column:
    """Match evidence, provider priority and rank as one additive score."""
    zero = F.lit(0.0)
    known = F.coalesce(priority, F.lit(UNKNOWN_PRIORITY)).cast("double")
    provider_points = F.greatest(zero, F.lit(100.0) - known)
    rank_points = F.greatest(zero, F.lit(21.0) - rank.cast("double"))
    return match * F.lit(100.0) + provider_points * F.lit(0.3) + rank_points


def score_results(results: DataFrame, providers: Sequence[tuple[str, bool, int]]) -> DataFrame:
    """Add provider priority, merge key, match score and chain score to raw provider results."""
    priorities = {name: priority for name, _, priority in providers}
    enabled = [name for name, on, _ in providers if on]
    positions = {name: index for index, name in enumerate(enabled, 1)}
    # The match rate gets its own projection so the terms are matched once per row.
    matched = results.withColumns(
        {
            "priority": lookup(F.col("provider"), priorities),
            "provider_pos": lookup(F.col("provider"), positions),
            "normalized_url": normalize_search_url(F.col("url")),
            "_match": query_match_rate(
                F.col("query"), F.col("title"), F.col("snippet"), F.col("url")
            ),
        }
    )
    score = chain_score(F.col("_match"), F.col("priority"), F.col("rank"))
    return matched.withColumns(
        {"match_score": F.bround("_match", 4), "chain_score": F.bround(score, 4)}
    ).drop("_match")


def best_per_url(scored: DataFrame, query_keys: Sequence[str]) -> DataFrame:
    """Strongest result of each merged URL; the earlier provider and position win ties."""
    usable = scored.filter(F.col("normalized_url") != "")
    order = [F.desc("chain_score"), F.asc("provider_pos"), F.asc("pos")]
    return top_per_key(usable, [*query_keys, "normalized_url"], order)


def merge_results(scored: DataFrame, query_keys: Sequence[str], limit: int) -> DataFrame:
    """Merged result list of each query, best first, cut to ``limit``."""
    order = [F.desc("chain_score"), F.asc("provider"), F.asc("rank"), F.asc("url")]
    return top_per_key(
        best_per_url(scored, query_keys), query_keys, order, limit, rank="merged_rank"
    )


def first_sightings(scored: DataFrame, query_keys: Sequence[str]) -> DataFrame:
    """The row that first showed each merged URL of a query, in provider call order."""
    usable = scored.filter(F.col("normalized_url") != "")
    order = [F.asc("provider_pos"), F.asc("pos")]
    return top_per_key(usable, [*query_keys, "normalized_url"], order)


def provider_counts(scored: DataFrame, query_keys: Sequence[str]) -> DataFrame:
    """Result, accepted and duplicate counts of each query and provider."""
    keys = [*query_keys, "provider"]
    usable = F.col("normalized_url") != ""
    totals = scored.groupBy(*keys).agg(
        F.count("*").alias("result_count"), F.count_if(usable).alias("_usable")
    )
    accepted = (
        first_sightings(scored, query_keys).groupBy(*keys).agg(F.count("*").alias("_accepted"))
    )
    number = F.coalesce(F.col("_accepted"), F.lit(0))
    return totals.join(accepted, keys, "left").select(
        *keys, "result_count", number.alias("accepted_count"),
        (F.col("_usable") - number).alias("duplicate_count"),
    )


def stop_failed_providers(calls: DataFrame, run_keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Relabel every call made after a provider's first blocking failure in the run.

    ``calls`` carries the run keys, ``provider``, ``seq`` (order of the queries in the run) and
    ``failure_type``. Only the first blocking call of each run and provider is needed, which is a plain
    aggregate, so a provider with most of the calls is no problem.
    """
    keys = [*run_keys, "provider"]
    stops = (
        calls.filter(F.col("failure_type").isin(*STOPPING_FAILURES))
        .groupBy(*keys)
        .agg(F.min("seq").alias("_stop_seq"))
    )
    stopped = F.col("_stop_seq").isNotNull() & (F.col("seq") > F.col("_stop_seq"))
    return (
        calls.join(stops, keys, "left")
        .withColumn(
            "failure_type", F.when(stopped, "provider_stopped").otherwise(F.col("failure_type"))
        )
        .withColumn("provider_stopped", F.coalesce(stopped, F.lit(False)))
        .drop("_stop_seq")
    )


def provider_audit(
    calls: DataFrame, scored: DataFrame, query_keys: Sequence[str], disabled: Sequence[str] = ()
) -> DataFrame:
    """Audit row per query and provider: counts, empty results, failures, stops and switched-off ones.

    ``calls`` has one row per query and enabled provider: query keys, ``run_id``, ``provider``, ``seq``,
    ``failure_type`` and ``http_status``. A stopped or failed call contributes no results.
    """
    keys = [*query_keys, "provider"]
    executed = stop_failed_providers(calls)
    answered = executed.filter(F.col("failure_type").isNull()).select(*keys)
    counts = provider_counts(scored.join(answered, keys, "left_semi"), query_keys)
    number = {
        name: F.when(F.col("failure_type").isNull(), F.coalesce(F.col(name), F.lit(0))).otherwise(0)
        for name in ("result_count", "accepted_count", "duplicate_count")
    }
    empty = F.col("failure_type").isNull() & (F.col("result_count") == 0)
    called = (
        executed.join(counts, keys, "left")
        .withColumns(number)
        .select(
            *keys, "run_id", F.lit(True).alias("enabled"), *number,
            F.when(empty, "empty_results").otherwise(F.col("failure_type")).alias("failure_type"),
            F.when(~F.col("provider_stopped"), F.col("http_status")).alias("http_status"),
        )
    )
    if not disabled:
        return called
    zero = F.lit(0).cast("bigint")
    names = F.array(*[F.lit(name) for name in disabled])
    switched_off = calls.select(*query_keys, "run_id").distinct().select(
        *query_keys, F.explode(names).alias("provider"), "run_id", F.lit(False).alias("enabled"),
        *[zero.alias(name) for name in number],
        F.lit("disabled").alias("failure_type"), F.expr("CAST(NULL AS INT)").alias("http_status"),
    )
    return called.unionByName(switched_off)
