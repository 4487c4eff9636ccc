"""Condition and review files, stored search responses, body decoding, rule files, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.bindings import EXCLUDED, SOURCES, table
from checks.queries_flow import _MAX_DOMAIN, _MAX_RUN, _MAX_SECONDS
from checks.queries_pages import _HTML, _URL
from checks.registry import SQL, check
from firmlens.dims import SafetyLimits
from firmlens.operators import safety
from firmlens.operators.pages import page_features, visible_text
from firmlens.session import checkpoint_dir
from firmlens.sources import conditions, encoding, reviews, rules, serp
from firmlens.sources.csv_files import CsvFiles, read_csv_files
from firmlens.streaming import ingest

# Condition files written from customer rows, one file per hundred customers. Some rows are wrong,
# some repeat an earlier one, some numbers are full-width.
_FILE_NO = "CAST(floor(c_custkey / 100.0) AS BIGINT)"
_HEADER = "都道府県, 市区町村 ,検索業種,最大取得件数,有効,最大候補処理件数,除外キーワード,備考"
_WIDE = "translate(CAST(1 + c_custkey % 9 AS STRING), '123456789', '１２３４５６７８９')"
_MAXIMUM = f"CASE c_custkey % 10 WHEN 3 THEN 'x' WHEN 4 THEN '0' ELSE {_WIDE} END"
_ENABLED = "CASE c_custkey % 7 WHEN 0 THEN '無効' WHEN 1 THEN 'maybe' ELSE 'はい' END"
_CITY = "'C' || CAST(c_custkey % 40 AS STRING)"
_ROW = (
    f"'P, ' || {_CITY} || ' ,\"' || c_mktsegment || '\",' || {_MAXIMUM} || ',' || {_ENABLED} || "
    "',' || CASE WHEN c_custkey % 5 = 0 THEN '12' ELSE '' END || ',\"a、b,c\", note '"
)


def _written(lines: DataFrame) -> str:
    """Folder of text files, one per ``file_no``, with the given lines in ``n`` order.

    Opening the files is the work, not their bytes, so the number of tasks is given and not left to the size of the rows.
    """
    folder = f"{checkpoint_dir(lines.sparkSession)}/files-{uuid.uuid4().hex}"
    ordered = lines.repartition(4 * lines.sparkSession.sparkContext.defaultParallelism, "file_no").sortWithinPartitions("file_no", "n").select("file_no", "line")
    ordered.write.partitionBy("file_no").text(folder)
    return folder


def _with_heads(rows: DataFrame, heads: list[str]) -> DataFrame:
    """Every file begins with the given lines; every second one with a byte order mark."""
    first = rows.select("file_no").distinct()
    mark = F.when(F.col("file_no") % 2 == 0, F.lit("\ufeff")).otherwise(F.lit(""))
    for at, head in enumerate(heads):
        text = F.concat(mark, F.lit(head)) if at == 0 else F.lit(head)
        rows = rows.unionByName(first.select("file_no", F.lit(at - len(heads)).cast("bigint").alias("n"), text.alias("line")))
    return rows


def _file_no() -> Column:
    return F.regexp_extract("path", "file_no=([0-9]+)", 1).cast("bigint")


def _files(spark: SparkSession, sf: str) -> CsvFiles:
    lines = table(spark, sf, "customer").select(F.expr(_FILE_NO).alias("file_no"), F.col("c_custkey").alias("n"), F.expr(_ROW).alias("line"))
    return read_csv_files(spark, _written(_with_heads(lines, [_HEADER, ",,,,,,,"])))


_CHECKED = f"""WITH c AS (SELECT *, {_FILE_NO} AS file_no, c_custkey % 100 + 3 AS row_number,
    {_CITY} AS city, CASE WHEN c_custkey % 10 IN (3, 4) THEN '最大取得件数は正の整数で指定してください'
      WHEN c_custkey % 7 = 1 THEN '有効の真偽値が不正です: maybe' END AS message FROM customer),
v AS (SELECT *, CASE WHEN message IS NULL THEN min(CASE WHEN message IS NULL THEN row_number END)
    OVER (PARTITION BY file_no, city, c_mktsegment) END AS first_row FROM c)"""


@check(
    "read_conditions",
    f"""{_CHECKED} SELECT file_no AS path, row_number, 'P' AS prefecture, city AS municipality,
  c_mktsegment AS industry, 1 + c_custkey % 9 AS max_results, c_custkey % 7 <> 0 AS enabled,
  CASE WHEN c_custkey % 5 = 0 THEN 12 END AS max_candidates, 'a|b|c' AS excluded_keywords,
  'note' AS note, CASE WHEN file_no % 2 = 0 THEN 'utf-8-sig' ELSE 'utf-8' END AS encoding
FROM v WHERE message IS NULL AND row_number = first_row""",
)
def _conditions(spark, sf):
    valid, _ = conditions.split_conditions(_files(spark, sf))
    return valid.select(
        _file_no().alias("path"), "row_number", "prefecture", "municipality", "industry", "max_results", "enabled",
        "max_candidates", F.array_join("excluded_keywords", "|").alias("excluded_keywords"), "note",
        "encoding",
    )


@check(
    "condition_issues",
    f"""{_CHECKED} SELECT file_no AS path, row_number, coalesce(message, '重複した検索条件です') AS message
FROM v WHERE message IS NOT NULL OR row_number > first_row""",
)
def _issues(spark, sf):
    _, issues = conditions.split_conditions(_files(spark, sf))
    return issues.withColumn("path", _file_no())


_REVIEW_ROW = (
    "CASE WHEN c_custkey % 9 = 0 THEN 'ftp://x' ELSE 'https://k' || CAST(c_custkey AS STRING) || "
    "'.example/' END || ',OK,NG,要確認,未確認,OK,' || CASE WHEN c_custkey % 8 = 0 THEN 'YES' "
    "ELSE 'NG' END || ',OK,OK,m' || CAST(c_custkey AS STRING)"
)


def _review_files(spark: SparkSession, sf: str) -> CsvFiles:
    lines = table(spark, sf, "customer").select(F.expr(_FILE_NO).alias("file_no"), F.col("c_custkey").alias("n"), F.expr(_REVIEW_ROW).alias("line"))
    return read_csv_files(spark, _written(_with_heads(lines, [",".join(reviews.REVIEW_HEADERS)])))


@check(
    "read_reviews",
    f"""SELECT {_FILE_NO} AS path, 'https://k' || c_custkey || '.example/' AS url, 'OK' AS company_name_judgment,
  'NG' AS official_site_judgment, 'm' || c_custkey AS note FROM customer
WHERE c_custkey % 9 <> 0 AND c_custkey % 8 <> 0""",
)
def _reviews(spark, sf):
    good, _ = reviews.check_reviews(_review_files(spark, sf))
    return good.select(_file_no().alias("path"), "url", "company_name_judgment", "official_site_judgment", "note")


@check(
    "review_issues",
    f"""SELECT {_FILE_NO} AS path, c_custkey % 100 + 2 AS row_number, 'row ' || (c_custkey % 100 + 2)
  || CASE WHEN c_custkey % 9 = 0 THEN ': invalid URL' ELSE ': unknown judgment: YES' END AS message
FROM customer WHERE c_custkey % 9 = 0 OR c_custkey % 8 = 0""",
)
def _review_issues(spark, sf):
    _, issues = reviews.check_reviews(_review_files(spark, sf))
    return issues.withColumn("path", _file_no())


_DECLARED = "CASE page_id % 6 WHEN 0 THEN 'text/html; charset=\"UTF-8\"' WHEN 1 THEN 'text/html' ELSE '' END"


@check(
    "decoded_bodies",
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8' WHEN 2 THEN 'utf-8-sig'
  WHEN 5 THEN 'utf-16' ELSE 'utf-8' END AS encoding, md5(CASE page_id % 6 WHEN 2 THEN
  replace(html, '<meta charset="utf-8">', '') WHEN 3 THEN
  translate(replace(html, '<meta charset="utf-8">', ''), 'æçã', 'aca') ELSE html END) AS text_md5 FROM pages""",
)
def _decoded(spark, sf):
    bare = F.replace("html", F.lit('<meta charset="utf-8">'), F.lit(""))
    kind = F.col("page_id") % 6
    body = (
        F.when(kind == 2, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(bare, "UTF-8")))
        # Letters that count as signs of a wrong decoding would leave the undeclared case to a guess.
        .when(kind == 3, F.encode(F.translate(bare, "æçã", "aca"), "UTF-8"))
        .when(kind == 5, F.concat(F.unhex(F.lit("FEFF")), F.encode("html", "UTF-16BE")))
        .otherwise(F.encode("html", "UTF-8"))
    )
    rows = table(spark, sf, "pages").select(
        "page_id", body.alias("content"), F.expr(_DECLARED).alias("content_type"),
        F.when(kind == 3, "ISO-8859-1").alias("apparent"),
    )
    text = encoding.decode_pages(F.col("content"), F.col("content_type"), F.col("apparent"))
    return rows.withColumn("d", text).select(
        "page_id", "d.encoding", F.md5("d.text").alias("text_md5")
    )


@check(
    "stored_page_texts",
    """SELECT page_id, md5(html) AS text_md5 FROM pages""",
)
def _stored(spark, sf):
    wide = F.col("page_id") % 3 == 0
    rows = table(spark, sf, "pages").select(
        "page_id",
        F.when(wide, F.encode("html", "UTF-16LE")).otherwise(F.encode("html", "UTF-8")).alias("body"),
        F.when(wide, "utf-16-le").when(F.col("page_id") % 3 == 1, "unheard-of").alias("name"),
    )
    text = encoding.stored_text(F.col("body"), F.col("name"))
    return rows.select("page_id", F.md5(text).alias("text_md5"))


# Result pages of every layout, written from the given pages: five results per response.
_PROVIDERS = ("bing_html", "yahoo_japan_html", "duckduckgo_html", "brave_search", "mojeek")
_ITEMS = {
    "bing_html": "'<li class=\"b_algo x\"><h2><a href=\"' || url || '\">T' || n || '</a></h2>"
    "<div class=\"b_caption\"><p>S' || n || '</p></div></li>'",
    "yahoo_japan_html": "'<div class=\"sw-CardBase\"><h3><a href=\"' || url || '\">T' || n || "
    "'</a></h3><p class=\"sw-Card__summary\">S' || n || '</p></div>'",
    "duckduckgo_html": "'<div class=\"body\"><a href=\"//r.example/l/?uddg=' || enc || '\"><h2>T' || n || "
    "'</h2><span>S' || n || '</span></a></div>'",
    "brave_search": "'<div class=\"snippet\"><a href=\"' || url || '\"><div class=\"title\">T' || n || "
    "'</div></a><div class=\"description\">S' || n || '</div></div>'",
    "mojeek": "'<ul class=\"results\"><li><h2><a href=\"' || url || '\">T' || n || '</a></h2>"
    "<p class=\"s\">S' || n || '</p></li></ul>'",
}
_RSS_ITEM = (
    "'<item><title> T' || n || ' </title><link>' || replace(url, '&', '&amp;') || '</link>"
    "<description>S' || n || '</description></item><item><title>none</title></item>'"
)
_JSON_ITEM = "'{\"title\":\"T' || n || '\",\"url\":\"' || url || '\",\"content\":\"S' || n || '\"}'"


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").selectExpr(
        "CAST(floor(page_id / 5.0) AS BIGINT) AS response", "page_id", "url",
        "CAST(page_id AS STRING) AS n", "url_encode(url) AS enc",
    )
    texts = {**_ITEMS, "bing_rss": _RSS_ITEM, "searxng": _JSON_ITEM}
    items = rows.select(
        "response", "page_id",
        F.explode(
            F.create_map(*[part for name, text in texts.items() for part in (F.lit(name), F.expr(text))])
        ).alias("provider", "item"),
    )
    # Five items per response by construction.
    pages = items.groupBy("response", "provider").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("page_id", "item"))), lambda row: row["item"]
        ).alias("items")
    )
    plain = F.array_join("items", "")
    body = (
        F.when(
            F.col("provider") == "bing_rss",
            F.concat(F.lit("<rss><channel>"), plain, F.lit("</channel></rss>")),
        )
        .when(
            F.col("provider") == "searxng",
            F.concat(F.lit('{"results":['), F.array_join("items", ","), F.lit("]}")),
        )
        .otherwise(F.concat(F.lit("<html><body>"), plain, F.lit("</body></html>")))
    )
    return pages.select("response", "provider", body.alias("body"))


_ALL_PROVIDERS = "', '".join((*_PROVIDERS, "bing_rss", "searxng"))


@check(
    "parsed_responses",
    f"""WITH p AS (SELECT page_id // 5 AS response, page_id % 5 + 1 AS rank, page_id, url,
  unnest(['{_ALL_PROVIDERS}']) AS provider FROM pages)
SELECT response, provider, rank, 'T' || page_id AS title, url, 'S' || page_id AS snippet FROM p
WHERE rank <= 4""",
)
def _parsed(spark, sf):
    return serp.result_rows(serp.parse_serps(_responses(spark, sf)), 4)


@check(
    "response_failures",
    """SELECT event_id, CASE event_id % 12 WHEN 0 THEN 'timeout' WHEN 1 THEN 'http_403' WHEN 2 THEN
  'http_429' WHEN 3 THEN 'http_error' WHEN 4 THEN 'captcha' WHEN 5 THEN 'block' WHEN 6 THEN
  'parser_mismatch' WHEN 8 THEN 'redirect' WHEN 10 THEN 'parser_mismatch' END AS failure FROM events""",
)
def _failures(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id", "CASE event_id % 12 WHEN 0 THEN 'timeout' WHEN 8 THEN 'redirect' END AS problem",
        "CASE event_id % 12 WHEN 1 THEN 403 WHEN 2 THEN 429 WHEN 3 THEN 500 ELSE 200 END AS code",
        "CASE event_id % 12 WHEN 4 THEN '<p>Verify you are HUMAN' WHEN 5 THEN 'Access Denied' "
        "WHEN 7 THEN 'No results found' ELSE 'x' END AS body",
        "CASE WHEN event_id % 12 IN (6, 7, 9) THEN 0 WHEN event_id % 12 = 10 THEN NULL ELSE 3 END AS n",
        "event_id % 12 <> 9 AS html",
    )
    return rows.select(
        "event_id",
        serp.failure_type(
            F.col("problem"), F.col("code"), F.col("body"), F.col("n"), F.col("html")
        ).alias("failure"),
    )


@check(
    "clean_domain_lines",
    """SELECT lower(s_name) AS domain, s_suppkey AS position FROM supplier WHERE s_suppkey % 3 = 0""",
)
def _domains(spark, sf):
    lines = table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS position",
        "CASE s_suppkey % 3 WHEN 0 THEN '  ' || upper(s_name) || '. ' WHEN 1 THEN ' # x' "
        "ELSE '  ' END AS line",
    ).withColumn("line", F.regexp_replace("line", "# x", "# comment"))
    trimmed = lines.withColumn("line", F.rtrim("line"))
    return rules.clean_domains(trimmed)


@check(
    "synonym_rows",
    """WITH t AS (SELECT n_nationkey, [r_name, n_name, 'x' || n_nationkey] AS terms FROM nation
  JOIN region ON r_regionkey = n_regionkey), e AS (SELECT n_nationkey, terms, unnest(terms) AS alias FROM t)
SELECT alias, array_to_string(arg_max(terms, n_nationkey), ',') AS terms FROM e GROUP BY alias""",
)
def _synonyms(spark, sf):
    joined = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.expr("r_regionkey = n_regionkey")
    )
    industries = joined.selectExpr(
        "n_nationkey AS position", "' ' || r_name AS display_name",
        "array(n_name || ' ', '', r_name, 'x' || CAST(n_nationkey AS STRING)) AS keywords",
    )
    return rules.synonym_rows(industries).select("alias", F.array_join("terms", ",").alias("terms"))


@check(
    "safety_signals",
    """SELECT page_id, page_id % 3 = 0 AS captcha, page_id % 3 = 2 AS blocked FROM pages""",
)
def _signals(spark, sf):
    extra = (
        "CASE page_id % 3 WHEN 0 THEN '<p>Security <!-- x -->Check</p><p>SECURITY CHECK</p>' "
        "WHEN 1 THEN '<noscript>access denied</noscript><script>verify you are human</script>' "
        "ELSE '<b>Access Denied</b>' END"
    )
    rows = table(spark, sf, "pages").select("page_id", F.expr(f"{extra} || html").alias("html"))
    shown = page_features(rows, wanted=("tokens", "noscript")).select("page_id", visible_text().alias("shown"))
    return shown.select(
        "page_id", safety.captcha_signal(F.col("shown")).alias("captcha"),
        safety.block_signal(F.col("shown")).alias("blocked"),
    )


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/streams-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@check("safety_stream", SQL["safety_verdicts"])
def _safety_stream(spark, sf):
    limits = SafetyLimits(
        max_requests=_MAX_RUN, max_requests_per_domain=_MAX_DOMAIN,
        max_runtime_seconds=_MAX_SECONDS, max_response_bytes=40000,
    )
    columns = SOURCES["b_requests"][2]
    requests = _stream(spark, sf, "events").selectExpr(
        *[f"{text} AS {alias}" for alias, text in columns.items()]
    )
    folder = _folder(spark)
    ingest.safety_stream(
        requests, f"{folder}/verdicts", f"{folder}/state", limits, once=True
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/verdicts").select("run_id", "seq", "allowed", "verdict")


@check(
    "first_sightings_stream",
    """SELECT 'https://u' || user_id || '.example/' AS url, min(event_id) AS event_id FROM events
GROUP BY user_id""",
)
def _first_stream(spark, sf):
    urls = _stream(spark, sf, "events").selectExpr(
        "'https://u' || CAST(user_id AS STRING) || '.example/' AS url", "event_id"
    )
    folder = _folder(spark)
    ingest.once_ever_stream(
        urls, f"{folder}/seen", f"{folder}/state", F.col("event_id"), once=True
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/seen").select("url", "event_id")


@check(
    "scored_page_stream",
    SQL["scored_pages"],
)
def _page_stream(spark, sf):
    arriving = _stream(spark, sf, "customer").selectExpr(
        "c_custkey AS page_id", f"{_URL} AS url", f"{_HTML} AS html", "'東京都' AS search_prefecture",
        "'港区' AS search_municipality", "'建設業' AS search_industry", "c_custkey AS fetched_at",
    )
    folder = _folder(spark)
    ingest.score_page_stream(
        arriving, folder, f"{folder}/state", EXCLUDED, once=True
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/scored").select(
        "page_id", "page_type", "official_score", "business_score", "is_official",
        "is_business_target", "review_required",
    )
