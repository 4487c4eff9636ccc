"""URL keys, query expansion, result merging, provider audit, relevance and excluded domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.bindings import (
    EXCLUDED,
    PROVIDERS,
    SYNONYM_SQL,
    SYNONYMS,
    bound,
    table,
    with_tables,
)
from checks.registry import check
from checks.sql_text import ENTITY, HOST, url_parts
from firmlens.functions import text, urls
from firmlens.operators import search
from firmlens.operators.candidates import discover_candidates
from firmlens.operators.domains import domain_exclusion
from firmlens.operators.relevance import TEXT_SIGNALS, prefetch_relevance
from firmlens.plans.collect import planned_queries

_ORIGIN = "regexp_extract(url, '^[a-z]+://[^/?#]+', 0)"
_REST = f"substr(url, 1 + length({_ORIGIN}))"
_NAME = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
# Spellings of a page's address: blanks, user info, ports, other schemes, doubled slashes.
_SPELLING = f"""CASE page_id % 8 WHEN 0 THEN '  ' || url || ' '
WHEN 1 THEN 'http://user:pw@' || upper({_NAME}) || ':8080' || {_REST}
WHEN 2 THEN 'HTTP://' || upper({_NAME}) || ':80' || {_REST}
WHEN 3 THEN 'https://' || {_NAME} || ':443' || {_REST} || '/'
WHEN 4 THEN 'ftp://' || {_NAME} || {_REST}
WHEN 5 THEN 'https://' || {_NAME} || ':80' || {_REST}
WHEN 6 THEN 'https://' || {_NAME} || ':99999' || {_REST}
ELSE url || '//' END"""


@check(
    "url_keys",
    f"""WITH s AS (SELECT page_id, {_SPELLING} AS url FROM pages), {url_parts('s')}
SELECT page_id, url,
  CASE WHEN web AND port_ok THEN scheme || '://' || host
    || CASE WHEN port = '' OR default_port THEN '' ELSE ':' || port END
    || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END
    || CASE WHEN q = '' THEN '' ELSE '?' || q END ELSE '' END AS search_key,
  CASE WHEN web AND port_ok THEN scheme || '://' || host
    || CASE WHEN port = '' THEN '' ELSE ':' || port END
    || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS work_key,
  host || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END AS entity_key,
  CASE WHEN web THEN scheme || '://' || host END AS pause_key,
  CASE WHEN web AND port_ok THEN scheme || '://' || host
    || CASE WHEN port = '' OR default_port THEN '' ELSE ':' || port END END AS origin_key,
  lower(rtrim(url, '/')) AS legacy_key
FROM u""",
)
def _url_keys(spark, sf):
    rows = table(spark, sf, "pages").selectExpr("page_id", f"{_SPELLING} AS url")
    url = F.col("url")
    return rows.select(
        "page_id", "url",
        urls.normalize_search_url(url).alias("search_key"),
        urls.task_key(url).alias("work_key"),
        urls.export_url_key(url).alias("entity_key"),
        urls.pause_origin(url).alias("pause_key"),
        urls.fetch_origin(url).alias("origin_key"),
        urls.legacy_normalized_url(url).alias("legacy_key"),
    )


@check(
    "planned_queries",
    with_tables(
        "b_conditions",
        """SELECT id AS condition_id, '"' || prefecture || '" "' || municipality || '" "'
  || industry || '" 公式サイト' AS query FROM b_conditions WHERE enabled""",
    ),
)
def _planned(spark, sf):
    return planned_queries(bound(spark, sf, "b_conditions").withColumnRenamed("id", "condition_id"))


_EXPANDED = f"""variants AS (
  SELECT id, municipality, industry, {SYNONYM_SQL['first']} AS s1, {SYNONYM_SQL['second']} AS s2,
    regexp_replace(regexp_replace(municipality, '市$', ''), '区$', '') AS short FROM b_conditions),
listed AS (SELECT id, unnest([1, 2, 3, 4, 5]) AS n, unnest([municipality || ' ' || industry,
    municipality || ' ' || s1, short || ' ' || s2, municipality || ' ' || industry || ' 公式',
    'site:.jp ' || municipality || ' ' || industry]) AS query FROM variants),
firsts AS (SELECT id, query, min(n) AS n FROM listed GROUP BY id, query),
expanded AS (SELECT id AS condition_id, query,
  row_number() OVER (PARTITION BY id ORDER BY n) AS query_pos FROM firsts)"""


@check(
    "expanded_queries",
    with_tables(
        "b_conditions",
        f"WITH {_EXPANDED} SELECT condition_id, query_pos, query FROM expanded WHERE query_pos <= 4",
    ),
)
def _expanded(spark, sf):
    expanded = search.expand_queries(bound(spark, sf, "b_conditions"), SYNONYMS, max_queries=4)
    return expanded.select(F.col("id").alias("condition_id"), "query_pos", "query")


def _synonym_table(spark: SparkSession) -> DataFrame:
    rows = [(alias, list(terms), place) for place, (alias, terms) in enumerate(SYNONYMS.items())]
    return spark.createDataFrame(rows, "alias string, terms array<string>, place int")


@check(
    "expanded_queries_by_table",
    with_tables(
        "b_conditions",
        f"WITH {_EXPANDED} SELECT condition_id, query_pos, query FROM expanded WHERE query_pos <= 4",
    ),
)
def _expanded_by_table(spark, sf):
    expanded = search.expand_queries(bound(spark, sf, "b_conditions"), _synonym_table(spark), max_queries=4)
    return expanded.select(F.col("id").alias("condition_id"), "query_pos", "query")


_PRIORITY = "CASE provider WHEN 'bing_rss' THEN 10 WHEN 'bing_html' THEN 20 ELSE 30 END"
_SCORED = f"""f1 AS (SELECT *, lower(title || ' ' || snippet || ' ' || url) AS evidence,
    list_distinct(list_transform(list_filter(regexp_extract_all(query, '[^\\s"]+'),
      lambda x: NOT starts_with(x, 'site:') AND x <> '公式'), lambda x: lower(x))) AS terms
  FROM b_found),
f2 AS (SELECT *, len(list_filter(terms, lambda x: contains(evidence, x))) / len(terms) AS m FROM f1),
scored AS (SELECT * EXCLUDE (evidence, terms, m), round_even(m, 4) AS match_score,
    round_even(m * 100.0::DOUBLE + greatest(0, 100 - {_PRIORITY})::DOUBLE * 0.3::DOUBLE
      + greatest(0, 21 - rank)::DOUBLE, 4) AS chain_score,
    rtrim(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0)) ||
      CASE WHEN rtrim(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/') = '' THEN '/'
      ELSE rtrim(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/') END ||
      regexp_extract(url, '[?][^#]*', 0), '#') AS normalized_url FROM f2)"""


def _scored(spark, sf):
    return search.score_results(bound(spark, sf, "b_found"), PROVIDERS)


@check(
    "search_scores",
    with_tables(
        "b_found",
        f"""WITH {_SCORED} SELECT query_id, provider, pos, normalized_url, match_score, chain_score
FROM scored""",
    ),
)
def _scores(spark, sf):
    return _scored(spark, sf).select(
        "query_id", "provider", "pos", "normalized_url", "match_score", "chain_score"
    )


_MERGED = f"""{_SCORED},
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, normalized_url
  ORDER BY chain_score DESC, provider_no, pos) = 1),
merged AS (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY chain_score DESC, provider, rank, url) AS merged_rank FROM best)"""


@check(
    "merged_results",
    with_tables(
        "b_found",
        f"""WITH {_MERGED} SELECT query_id, merged_rank, provider, url, chain_score FROM merged
WHERE merged_rank <= 10""",
    ),
)
def _merged(spark, sf):
    merged = search.merge_results(_scored(spark, sf), ["query_id"], 10)
    return merged.select("query_id", "merged_rank", "provider", "url", "chain_score")


@check(
    "accepted_and_duplicate_counts",
    with_tables(
        "b_found",
        f"""WITH {_SCORED}, seen AS (SELECT *, row_number() OVER (
    PARTITION BY query_id, normalized_url ORDER BY provider_no, pos) AS n FROM scored)
SELECT query_id, provider, count(*) AS result_count, count(*) FILTER (n = 1) AS accepted_count,
  count(*) FILTER (n > 1) AS duplicate_count FROM seen GROUP BY query_id, provider""",
    ),
)
def _counts(spark, sf):
    return search.provider_counts(_scored(spark, sf), ["query_id"])


# One call per query and provider; some fail, a blocking failure stops the provider for its run.
_FAILURE = (
    "CASE WHEN query_id % 17 = 4 AND provider_no = 2 THEN 'http_429' "
    "WHEN query_id % 13 = 3 THEN 'timeout' END"
)
_CALLS = f"""calls AS (SELECT DISTINCT query_id, provider, provider_no,
    'run-' || CAST(query_id % 3 AS VARCHAR) AS run_id, query_id AS seq, {_FAILURE} AS failed
  FROM b_found),
stops AS (SELECT run_id, provider, min(seq) AS stop_seq FROM calls WHERE failed = 'http_429'
  GROUP BY run_id, provider),
executed AS (SELECT c.*, s.stop_seq IS NOT NULL AND c.seq > s.stop_seq AS stopped,
    CASE WHEN s.stop_seq IS NOT NULL AND c.seq > s.stop_seq THEN 'provider_stopped' ELSE failed END
      AS failure_type
  FROM calls c LEFT JOIN stops s ON s.run_id = c.run_id AND s.provider = c.provider)"""


def _calls(spark, sf):
    found = bound(spark, sf, "b_found")
    return found.selectExpr(
        "query_id", "provider", "concat('run-', CAST(query_id % 3 AS STRING)) AS run_id",
        "query_id AS seq", f"{_FAILURE} AS failure_type",
        f"CASE WHEN {_FAILURE} = 'http_429' THEN 429 WHEN {_FAILURE} IS NULL THEN 200 END AS http_status",
    ).distinct()


@check(
    "stopped_providers",
    with_tables(
        "b_found",
        f"WITH {_CALLS} SELECT query_id, provider, run_id, failure_type, stopped FROM executed",
    ),
)
def _stopped(spark, sf):
    stopped = search.stop_failed_providers(_calls(spark, sf))
    return stopped.select(
        "query_id", "provider", "run_id", "failure_type",
        F.col("provider_stopped").alias("stopped"),
    )


@check(
    "provider_call_audit",
    with_tables(
        "b_found",
        f"""WITH {_SCORED}, {_CALLS}, kept AS (SELECT s.* FROM scored s JOIN executed e
    ON e.query_id = s.query_id AND e.provider = s.provider AND e.failure_type IS NULL),
seen AS (SELECT *, row_number() OVER (PARTITION BY query_id, normalized_url
    ORDER BY provider_no, pos) AS n FROM kept),
numbers AS (SELECT query_id, provider, count(*) AS r, count(*) FILTER (n = 1) AS a,
    count(*) FILTER (n > 1) AS d FROM seen GROUP BY query_id, provider)
SELECT e.query_id, e.provider, e.run_id, TRUE AS enabled, coalesce(r, 0) AS result_count,
  coalesce(a, 0) AS accepted_count, coalesce(d, 0) AS duplicate_count, failure_type,
  CASE WHEN stopped THEN NULL WHEN failed = 'http_429' THEN 429 WHEN failed IS NULL THEN 200 END
    AS http_status
FROM executed e LEFT JOIN numbers n ON n.query_id = e.query_id AND n.provider = e.provider
UNION ALL SELECT DISTINCT query_id, 'mojeek', run_id, FALSE, 0, 0, 0, 'disabled', NULL FROM calls""",
    ),
)
def _audit(spark, sf):
    return search.provider_audit(
        _calls(spark, sf), _scored(spark, sf), ["query_id"],
        [name for name, enabled, _ in PROVIDERS if not enabled],
    )


_TERMS = """CASE industry WHEN 'AUTOMOBILE' THEN ['automobile', 'the', 'auto']
  WHEN 'BUILDING' THEN ['building', 'er', 'house'] WHEN 'FURNITURE' THEN ['furniture', 'zzz']
  ELSE [lower(industry)] END"""


def _signal_case() -> str:
    cases = []
    for category, words in TEXT_SIGNALS.items():
        tests = " OR ".join(f"contains(txt, '{word.lower()}')" for word in words)
        cases.append(f"WHEN {tests} THEN 'prefetch_{category}'")
    return "\n".join(cases)


_RELEVANCE = f"""h AS (SELECT *, {HOST.format('url')} AS host,
    lower(title || ' ' || snippet || ' ' || url) AS txt FROM b_found),
judged AS (SELECT *, CASE
  WHEN host = 'spam-farm.example.org' OR host LIKE '%.spam-farm.example.org'
    OR host = 'cheap-pills.example.com' OR host LIKE '%.cheap-pills.example.com'
    THEN 'prefetch_excluded_domain'
  WHEN contains(host, 'wikipedia.org') OR contains(host, '.go.jp') THEN 'prefetch_public_or_wikipedia'
  {_signal_case()}
  WHEN len(list_filter({_TERMS}, lambda x: contains(txt, x))) = 0
    THEN 'prefetch_low_industry_relevance' END AS reject_reason FROM h)"""


@check(
    "result_relevance",
    with_tables(
        "b_found",
        f"""WITH {_RELEVANCE} SELECT query_id, provider, pos, reject_reason IS NULL AS accepted,
  reject_reason FROM judged""",
    ),
)
def _relevance(spark, sf):
    judged = prefetch_relevance(bound(spark, sf, "b_found"), SYNONYMS, EXCLUDED)
    return judged.select("query_id", "provider", "pos", "accepted", "reject_reason")


@check(
    "result_relevance_by_table",
    with_tables(
        "b_found",
        f"""WITH {_RELEVANCE} SELECT query_id, provider, pos, reject_reason IS NULL AS accepted,
  reject_reason FROM judged""",
    ),
)
def _relevance_by_table(spark, sf):
    judged = prefetch_relevance(bound(spark, sf, "b_found"), _synonym_table(spark), EXCLUDED)
    return judged.select("query_id", "provider", "pos", "accepted", "reject_reason")


_CAP = 6


@check(
    "discovered_candidates",
    with_tables(
        "b_found",
        f"""WITH {_RELEVANCE}, k AS (SELECT *, page_id * 10 + provider_no AS seq,
    lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0)) || CASE WHEN
      regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/'
      ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END
      || regexp_extract(url, '[?][^#]*', 0) AS task_key FROM judged),
firsts AS (SELECT * FROM k QUALIFY row_number() OVER (
    PARTITION BY condition_id, task_key ORDER BY seq) = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY condition_id ORDER BY seq) AS n FROM firsts),
cut AS (SELECT *, min(CASE WHEN reject_reason IS NULL AND n >= {_CAP} THEN n END)
    OVER (PARTITION BY condition_id) AS last_n FROM numbered)
SELECT condition_id, task_key, n AS discovery_index, reject_reason IS NULL AS accepted FROM cut
WHERE last_n IS NULL OR n <= last_n""",
    ),
)
def _discovered(spark, sf):
    judged = prefetch_relevance(bound(spark, sf, "b_found"), SYNONYMS, EXCLUDED)
    sequenced = judged.withColumn("discovery_seq", F.col("page_id") * 10 + F.col("provider_no"))
    found = discover_candidates(sequenced, _CAP)
    return found.select("condition_id", "task_key", "discovery_index", "accepted")


_EXCLUSION_SQL = f"""WITH h AS (SELECT page_id, url, {HOST.format('url')} AS host FROM pages),
m AS (SELECT *, CASE WHEN host = 'spam-farm.example.org' OR host LIKE '%.spam-farm.example.org'
  THEN 'spam-farm.example.org' WHEN host = 'cheap-pills.example.com'
  OR host LIKE '%.cheap-pills.example.com' THEN 'cheap-pills.example.com' END AS matched FROM h)
SELECT page_id, host, matched IS NOT NULL AS domain_excluded, matched AS matched_domain,
  CASE WHEN matched IS NOT NULL THEN 'excluded' END AS exclusion_category,
  '除外ドメインに一致: ' || matched || ' (excluded)' AS exclusion_reason FROM m"""
_EXCLUSION = (
    "page_id", "host", "domain_excluded", "matched_domain", "exclusion_category",
    "exclusion_reason",
)


@check("excluded_domains_inline", _EXCLUSION_SQL)
def _excluded_inline(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return domain_exclusion(pages, EXCLUDED).select(*_EXCLUSION)


@check("excluded_domains_joined", _EXCLUSION_SQL)
def _excluded_joined(spark, sf):
    listed = spark.createDataFrame(list(enumerate(EXCLUDED)), "position int, domain string")
    pages = table(spark, sf, "pages").select("page_id", "url")
    return domain_exclusion(pages, listed).select(*_EXCLUSION)


@check(
    "entity_keys",
    f"""SELECT {ENTITY.format('url')} AS entity_key, count(*) AS pages FROM pages GROUP BY 1""",
)
def _entities(spark, sf):
    keyed = table(spark, sf, "pages").select(urls.export_url_key(F.col("url")).alias("entity_key"))
    return keyed.groupBy("entity_key").agg(F.count("*").alias("pages"))


@check(
    "text_functions",
    """SELECT c_custkey, regexp_replace(lower('  ' || c_name || ' X  '), '\\s', '', 'g') AS text_key,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey END AS number,
  CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS flag,
  'a|' || c_mktsegment || '|z' AS keywords,
  c_mktsegment || '/' || c_name || '/w [q]' AS history,
  CASE WHEN c_custkey % 2 = 0 THEN '''=' || c_name ELSE c_name END AS cell,
  least(100, greatest(0, CAST(round_even(c_acctbal / 100, 0) AS INT))) AS score,
  len(c_name) - len(replace(c_name, '00', '0')) AS zeros
FROM customer""",
)
def _text(spark, sf):
    customers = table(spark, sf, "customer")
    wide = F.translate(F.col("c_custkey").cast("string"), "0123456789", "０１２３４５６７８９")
    spelled = F.when(F.col("c_custkey") % 4 == 0, F.lit("x")).otherwise(wide)
    flag = F.element_at(
        F.array(F.lit("ＴＲＵＥ "), F.lit("いいえ"), F.lit("?")),
        (F.col("c_custkey") % 3 + 1).cast("int"),
    )
    name = F.col("c_name")
    marked = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("="), name)).otherwise(name)
    number = F.when(F.col("c_custkey") == 0, F.lit(None)).otherwise(text.positive_int(spelled))
    return customers.select(
        "c_custkey",
        text.entity_text_key(F.concat(F.lit(" 　"), name, F.lit(" X\t "))).alias("text_key"),
        number.alias("number"),
        text.jp_boolean(flag).alias("flag"),
        F.array_join(
            text.keyword_list(F.concat(F.lit("a、 ,"), F.col("c_mktsegment"), F.lit(" 、z"))), "|"
        ).alias("keywords"),
        text.search_history(F.col("c_mktsegment"), name, F.lit("w"), F.lit("q")).alias("history"),
        text.csv_cell(marked, "string").alias("cell"),
        text.bounded_score(F.col("c_acctbal") / 100).alias("score"),
        text.count_literal(name, "00").alias("zeros"),
    )


@check(
    "excluded_domains_by_thousands",
    """WITH u AS (SELECT c_custkey, 'www.d' || c_custkey || '.example' AS host FROM customer)
SELECT c_custkey, p_partkey IS NOT NULL AS domain_excluded, 'd' || p_partkey || '.example' AS matched_domain
FROM u LEFT JOIN part ON p_partkey = c_custkey""",
)
def _long_list(spark, sf):
    urls = table(spark, sf, "customer").selectExpr("c_custkey", "'https://www.d' || c_custkey || '.example/' AS url")
    listed = table(spark, sf, "part").selectExpr("'d' || p_partkey || '.example' AS domain", "p_partkey AS position")
    return domain_exclusion(urls, listed).select("c_custkey", "domain_excluded", "matched_domain")
