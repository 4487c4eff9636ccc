"""Page parsing, page types, extraction and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.bindings import EXCLUDED, table
from checks.registry import check
from checks.sql_text import ENTITY, HOST, PAGE_TEXT, PATH
from firmlens.functions.urls import hostname
from firmlens.operators import extract, pages, score
from firmlens.operators.page_type import PAGE_TYPE_FEATURES, with_page_type
from firmlens.plans.profile import page_profile

_PAGE_TYPE = f"""CASE
  WHEN regexp_matches(evidence, 'ポータル|ランキング|まとめ|おすすめ.*一覧|比較サイト') THEN 'portal'
  WHEN regexp_matches(evidence, '求人|採用情報|recruit|/jobs?') THEN 'job'
  WHEN regexp_matches(evidence, '電話帳|企業一覧|店舗一覧|directory') THEN 'directory'
  WHEN regexp_matches(evidence, '/articles?|/blog|ニュース|コラム|記事') THEN 'article'
  WHEN regexp_matches(path, '/contact(?:/|$)') THEN 'contact'
  WHEN regexp_matches(path, '/access(?:/|$)') THEN 'access'
  WHEN regexp_matches(path, '/(?:company|about)(?:/|$)') THEN 'company'
  WHEN regexp_matches(path, '/(?:stores?|shop)(?:/|$)') THEN 'store'
  WHEN path IN ('', '/', '/index.html', '/index.htm') THEN 'official_home'
  ELSE 'unknown' END"""
_TYPED = f"""{PAGE_TEXT}, t_evidence AS (SELECT page_id, url, lower({PATH.format('url')}) AS path,
  lower(concat_ws(' ', {PATH.format('url')}, title, '', h1,
    array_to_string(tokens, ' '))) AS evidence FROM t_page),
t_typed AS (SELECT page_id, url, {_PAGE_TYPE} AS page_type FROM t_evidence)"""


@check(
    "page_profile",
    f"""WITH {_TYPED}, h AS (SELECT *, {HOST.format('url')} AS host,
    {ENTITY.format('url')} AS entity FROM t_typed)
SELECT host, CASE WHEN host = 'spam-farm.example.org' OR host LIKE '%.spam-farm.example.org'
    OR host = 'cheap-pills.example.com' OR host LIKE '%.cheap-pills.example.com'
    THEN 'excluded' ELSE '' END AS exclusion_category, page_type, count(*) AS page_count,
  count(DISTINCT entity) AS entity_count FROM h GROUP BY ALL""",
)
def _profile(spark, sf):
    return page_profile(table(spark, sf, "pages"), EXCLUDED)


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_features(table(spark, sf, "pages"))


@check(
    "page_texts",
    f"""WITH {PAGE_TEXT} SELECT page_id, title, h1, len(tokens) AS pieces,
  md5(array_to_string(tokens, ' ')) AS text_md5 FROM t_page""",
)
def _texts(spark, sf):
    return _features(spark, sf).select(
        "page_id", "title", "h1", F.size("tokens").alias("pieces"),
        F.md5(pages.page_text()).alias("text_md5"),
    )


@check(
    "page_links",
    """SELECT page_id, len(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS links,
  md5(array_to_string(regexp_extract_all(html, '<a href="([^"]+)"', 1), ' ')) AS links_md5
FROM pages""",
)
def _links(spark, sf):
    return _features(spark, sf).select(
        "page_id", F.size("links").alias("links"), F.md5(F.array_join("links", " ")).alias("links_md5")
    )


# Links of the page itself, then two hosts of other sites and three links without a foreign host in front of it.
_LINKED = """'<a href="https://www.' || page_id % 50 || '.example/a">x</a><a href="//CDN' || page_id % 7 || '.example/y">y</a>'
  || '<a href="//cdn' || page_id % 7 || '.example/z">z</a><a href="' || url || '">own</a><a href="mailto:a@b.example">m</a>' || html"""


@check(
    "external_link_hosts",
    f"""WITH p AS (SELECT page_id, url, {_LINKED} AS html FROM pages),
l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS link FROM p),
h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS own,
    lower(regexp_extract(link, '^(?:[A-Za-z]+:)?//([^/?#]+)', 1)) AS host FROM l)
SELECT page_id, count(DISTINCT CASE WHEN host <> '' AND host <> own THEN host END) AS external_hosts
FROM h GROUP BY page_id""",
)
def _external(spark, sf):
    source = table(spark, sf, "pages").selectExpr("page_id", "url", f"{_LINKED} AS html")
    return pages.page_features(source, wanted=("links",)).select(
        "page_id", F.size(pages.external_hosts(hostname(F.col("url")))).alias("external_hosts")
    )


# A quarter of the pages each begins with half a surrogate pair, with 2,000 nested items, with a declaration that the
# parser refuses, and without a fault.
_FAULTY = """CASE page_id % 4
WHEN 0 THEN '<script type="application/ld+json">{"@type":"Organization","name":"N' || page_id || '~ud83d"}</script>'
WHEN 1 THEN '<div itemscope itemtype="https://schema.org/Restaurant"><b itemprop="name">R' || page_id || '</b>'
  || repeat('<div itemscope itemprop="x">', 2000) WHEN 2 THEN '<a href="/before">x</a><![bad[ x ]]>' ELSE '' END"""


@check(
    "faulty_pages",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'N' || page_id || chr(65533) END AS linked_name,
  CASE page_id % 4 WHEN 1 THEN 'R' || page_id END AS item_name,
  CASE page_id % 4 WHEN 2 THEN 1 ELSE len(regexp_extract_all(html, '<a href="([^"]+)"', 1)) END AS links,
  page_id % 4 = 2 AS refused FROM pages""",
)
def _faulty(spark, sf):
    faulty = F.concat(F.translate(F.expr(_FAULTY), "~", "\\"), F.col("html"))
    source = table(spark, sf, "pages").select("page_id", faulty.alias("html"))
    return pages.page_features(source).select(
        "page_id",
        F.get(F.col("jsonld")["name"], F.lit(0)).alias("linked_name"),
        F.get(F.transform("microdata", lambda item: item["props"]["name"]), F.lit(0)).alias("item_name"),
        F.size("links").alias("links"),
        F.col("parse_error").isNotNull().alias("refused"),
    )


# Company pages written from customer rows: six layouts, one per source of the extraction rules.
_N = "CAST(c_custkey AS STRING)"
_P4 = "lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')"
_LAYOUT = "c_custkey % 6"
_HTML = f"""CASE {_LAYOUT}
WHEN 0 THEN '<html><head><title>K' || {_N} || '</title><script type="application/ld+json">{{"@graph":[{{"@type":"WebSite","name":"x"}},{{"@type":"Organization","legalName":"株式会社K' || {_N} || '","telephone":"03-1234-' || {_P4} || '","address":{{"postalCode":"1000001","addressRegion":"東京都","addressLocality":"千代田区","streetAddress":"千代田' || {_N} || '"}}}}]}}</script></head><body><h1>工務店</h1><nav>会社概要 お問い合わせ アクセス</nav><footer>© 株式会社K' || {_N} || '</footer></body></html>'
WHEN 1 THEN '<html><body><div class="main company-info"><h2>会社概要</h2><p>株式会社K' || {_N} || '</p><p>〒105-0014 東京都港区芝' || {_N} || '-1</p></div><p>代表 TEL 03-2222-' || {_P4} || ' / FAX: 03-9999-0000</p><p>リフォーム 工務店</p></body></html>'
WHEN 2 THEN '<html><body><p>ご予約 090-3333-' || {_P4} || '</p><p>採用 ０８０－４４４４－' || {_P4} || '</p><p>電話 090-3333-' || {_P4} || '</p><footer>〒530-0001 大阪府大阪市北区梅田' || {_N} || ' Copyright 2024 合同会社K' || {_N} || '</footer></body></html>'
WHEN 3 THEN '<html><head><meta property="og:site_name" content=" OG' || {_N} || ' "></head><body><p>沖縄県那覇市に属する島です。</p><h1>観光スポット</h1><p>飲食店やレストラン</p></body></html>'
WHEN 4 THEN '<html><head><title>店K' || {_N} || ' ｜ 公式</title></head><body><p>レストラン 居酒屋 美容室</p><section><h3>アクセス</h3><p>北海道札幌市中央区北' || {_N} || '</p></section></body></html>'
ELSE '<html><body><div itemscope itemtype="https://schema.org/HairSalon"><meta itemprop="legalName" content="有限会社K' || {_N} || '"><span itemprop="name">サロンK' || {_N} || '</span><div itemprop="address" itemscope itemtype="https://schema.org/PostalAddress"><span itemprop="name">内側</span></div><a itemprop="telephone" href="tel:0120-55' || {_P4} || '">電話</a></div><p>愛知県名古屋市中区栄</p></body></html>' END"""
_URL = f"'https://k' || {_N} || '.example.jp/' || CASE WHEN c_custkey % 5 = 0 THEN 'company' WHEN c_custkey % 5 = 1 THEN 'blog/x' ELSE '' END"


def _company_pages(spark: SparkSession, sf: str) -> DataFrame:
    # The narrow keys are spread, so that the bodies written from them are parsed on all cores.
    customers = table(spark, sf, "customer").select("c_custkey").repartition(spark.sparkContext.defaultParallelism)
    return customers.selectExpr(
        "c_custkey AS page_id", f"{_URL} AS url", f"{_HTML} AS html",
        "'東京都' AS search_prefecture", "'港区' AS search_municipality",
        "'建設業' AS search_industry",
    )


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract_companies(pages.page_features(_company_pages(spark, sf)))


def _by_layout(*values: str) -> str:
    cases = " ".join(f"WHEN {number} THEN {value}" for number, value in enumerate(values))
    return f"CASE {_LAYOUT} {cases} END"


@check(
    "extracted_companies",
    f"""SELECT c_custkey AS page_id,
  {_by_layout(f"'株式会社K' || {_N}", f"'株式会社K' || {_N}", f"'合同会社K' || {_N}", f"'OG' || {_N}", f"'店K' || {_N}", f"'有限会社K' || {_N}")} AS company_name,
  {_by_layout("'jsonld_legal_name'", "'company'", "'copyright'", "'ogp'", "'title'", "'schema'")} AS company_source,
  CASE WHEN {_LAYOUT} = 5 THEN 'サロンK' || {_N} END AS store_name,
  CASE WHEN {_LAYOUT} = 5 THEN 'サロンK' || {_N} END AS display_name,
  {_by_layout("NULL", "NULL", "NULL", "NULL", "'飲食店'", "'美容業'")} AS industry,
  {_by_layout("NULL", "NULL", "NULL", "NULL", "'body'", "'schema'")} AS industry_source
FROM customer""",
)
def _companies(spark, sf):
    return _extracted(spark, sf).select(
        "page_id",
        F.col("company_name.value").alias("company_name"),
        F.col("company_name.source").alias("company_source"),
        F.col("store_name.value").alias("store_name"),
        F.col("display_name.value").alias("display_name"),
        F.col("industry.value").alias("industry"),
        F.col("industry.source").alias("industry_source"),
    )


@check(
    "extracted_addresses",
    f"""SELECT c_custkey AS page_id,
  {_by_layout(f"'東京都千代田区千代田' || {_N}", f"'東京都港区芝' || {_N} || '-1'", f"'大阪府大阪市北区梅田' || {_N}", "''", f"'北海道札幌市中央区北' || {_N}", "''")} AS address,
  {_by_layout("'100-0001'", "'105-0014'", "'530-0001'", "''", "NULL", "''")} AS postal_code,
  {_by_layout("'東京都'", "'東京都'", "'大阪府'", "''", "'北海道'", "''")} AS prefecture,
  {_by_layout("'千代田区'", "'港区'", "'大阪市'", "''", "'札幌市'", "''")} AS municipality,
  {_by_layout("'jsonld'", "'company'", "'footer'", "''", "'access'", "''")} AS source
FROM customer WHERE {_LAYOUT} NOT IN (3, 5)""",
)
def _addresses(spark, sf):
    return extract.address_rows(_extracted(spark, sf))


@check(
    "extracted_phones",
    f"""SELECT c_custkey AS page_id, 0 AS pos, '03-1234-' || {_P4} AS number, 'fixed' AS kind,
  'main' AS usage, 'jsonld' AS source FROM customer WHERE {_LAYOUT} = 0
UNION ALL SELECT c_custkey, 0, '03-2222-' || {_P4}, 'fixed', 'main', 'body' FROM customer
  WHERE {_LAYOUT} = 1
UNION ALL SELECT c_custkey, 0, '090-3333-' || {_P4}, 'mobile', 'reservation', 'body' FROM customer
  WHERE {_LAYOUT} = 2
UNION ALL SELECT c_custkey, 1, '080-4444-' || {_P4}, 'mobile', 'recruiting', 'body' FROM customer
  WHERE {_LAYOUT} = 2
UNION ALL SELECT c_custkey, 0, '0120-55-' || {_P4},
  'fixed', 'main', 'schema' FROM customer WHERE {_LAYOUT} = 5""",
)
def _phones(spark, sf):
    return extract.phone_rows(_extracted(spark, sf))


# Evidence points by layout, before the page type of the path is added.
_OFFICIAL = _by_layout(
    # phone, address, identity, structured, company, contact, access, industry, own, copyright; the
    # address lies in the searched prefecture, so the region neither matches nor mismatches
    "10 + 10 + 12 + 10 + 8 + 6 + 6 + 10 + 8 + 5",
    # phone, address, identity, company, industry, region, own
    "10 + 10 + 12 + 8 + 10 + 10 + 8",
    # phone, address, identity, region mismatch, own, copyright
    "10 + 10 + 12 - 20 + 8 + 5",
    # identity, own
    "12 + 8",
    # address, identity, access, industry mismatch, region mismatch, own
    "10 + 12 + 6 - 20 - 20 + 8",
    # phone, identity, industry mismatch, own
    "10 + 12 - 20 + 8",
)
_BLOG = "c_custkey % 5 = 1"
_CONTACTS = _by_layout("15 + 10 + 10", "15 + 10 + 10", "15 + 5 + 10 + 10", "10", "10 + 10", "15 + 10")
_SCORED = f"""o AS (SELECT *, least(100, greatest(0, {_OFFICIAL}
    - CASE WHEN {_BLOG} THEN 25 ELSE 0 END)) AS official FROM customer),
b AS (SELECT *, CASE WHEN {_BLOG} THEN 0 ELSE least(100, CAST(round_even(official * 0.5 + {_CONTACTS}
    + CASE WHEN c_custkey % 5 <> 1 THEN 10 ELSE 0 END, 0) AS INT)) END AS business FROM o)"""


@check(
    "scored_pages",
    f"""WITH {_SCORED} SELECT c_custkey AS page_id,
  CASE WHEN {_BLOG} THEN 'article' WHEN c_custkey % 5 = 0 THEN 'company' ELSE 'official_home' END
    AS page_type,
  official AS official_score, business AS business_score, official >= 60 AS is_official,
  official >= 60 AND business >= 55 AS is_business_target,
  abs(official - 60) <= 8 OR abs(business - 55) <= 8 AS review_required
FROM b""",
)
def _scored(spark, sf):
    return score.score_pages(_extracted(spark, sf), EXCLUDED).select(
        "page_id", "page_type", "official_score", "business_score", "is_official",
        "is_business_target", "review_required",
    )


_POSITIVE = _by_layout(
    "'phone;address;identity;structured_business;company_page;contact_page;access_page;"
    "industry_match;own_domain;copyright_match'",
    "'phone;address;identity;company_page;industry_match;region_match;own_domain'",
    "'phone;address;identity;own_domain;copyright_match'",
    "'identity;own_domain'",
    "'address;identity;access_page;own_domain'",
    "'phone;identity;own_domain'",
)
_BUSINESS = _by_layout(
    "';business_phone;business_address;business_identity'",
    "';business_phone;business_address;business_identity'",
    "';business_phone;business_mobile;business_address;business_identity'",
    "';business_identity'",
    "';business_address;business_identity'",
    "';business_phone;business_identity'",
)
_NEGATIVE = _by_layout(
    "''", "''", "'region_mismatch;'", "''",
    "'industry_mismatch;region_mismatch;'", "'industry_mismatch;'",
)


@check(
    "score_signals",
    f"""WITH {_SCORED} SELECT c_custkey AS page_id,
  {_POSITIVE} || CASE WHEN {_BLOG} THEN '' ELSE {_BUSINESS} || ';business_page' END AS positive,
  rtrim({_NEGATIVE} || CASE WHEN {_BLOG} THEN 'article;excluded_page_type:article' ELSE '' END, ';')
    AS negative,
  CASE WHEN official < 60 THEN '公式判定閾値未満: ' || official || '/60'
    WHEN business < 55 THEN '営業対象判定閾値未満: ' || business || '/55'
    ELSE '公式サイトかつ営業対象の判定基準を満たす' END AS last_reason
FROM b""",
)
def _signals(spark, sf):
    return score.score_pages(_extracted(spark, sf), EXCLUDED).select(
        "page_id", F.array_join("positive_signals", ";").alias("positive"),
        F.array_join("negative_signals", ";").alias("negative"),
        F.element_at("reasons", -1).alias("last_reason"),
    )


@check(
    "jsonld_entities",
    f"""SELECT c_custkey AS page_id, 0 AS pos, 'Organization' AS types, '株式会社K' || {_N} AS legal_name,
  '1000001' AS postal_code FROM customer WHERE {_LAYOUT} = 0""",
)
def _jsonld(spark, sf):
    features = pages.page_features(_company_pages(spark, sf))
    return pages.jsonld_entities(features, "page_id").select(
        "page_id", "pos", F.array_join("types", ",").alias("types"), "legal_name", "postal_code"
    )


@check(
    "microdata_entities",
    f"""SELECT c_custkey AS page_id, 0 AS pos, 'HairSalon' AS types, 'サロンK' || {_N} AS item_name,
  '内側' AS nested_name, '0120-55' || {_P4} AS telephone FROM customer WHERE {_LAYOUT} = 5""",
)
def _microdata(spark, sf):
    features = pages.page_features(_company_pages(spark, sf))
    return pages.microdata_entities(features, "page_id").select(
        "page_id", "pos", F.array_join("types", ",").alias("types"),
        F.col("props")["name"].alias("item_name"),
        F.col("nested")["address"]["name"].alias("nested_name"),
        F.col("props")["telephone"].alias("telephone"),
    )


@check(
    "page_types",
    f"WITH {_TYPED} SELECT page_id, page_type FROM t_typed",
)
def _types(spark, sf):
    parsed = pages.page_features(table(spark, sf, "pages"), wanted=PAGE_TYPE_FEATURES)
    return with_page_type(parsed).select("page_id", "page_type")


# Phone numbers in order lines: three numbers per line, the second one a FAX.
_LINE = (
    "'代表 03-1234-' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') || ' FAX: 03-5555-' || "
    "lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') || CASE WHEN o_orderkey % 2 = 0 THEN "
    "' 予約専用 ' ELSE ' x ' END || '090 8888 ' || lpad(CAST(o_orderkey % 9973 AS STRING), 4, '0')"
)


@check(
    "line_phone_matches",
    """SELECT o_orderkey, '03-1234-' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') AS number,
  'fixed' AS kind, 'main' AS usage FROM orders
UNION ALL SELECT o_orderkey, '090-8888-' || lpad(CAST(o_orderkey % 9973 AS STRING), 4, '0'), 'mobile',
  CASE WHEN o_orderkey % 2 = 0 THEN 'reservation' ELSE 'unknown' END FROM orders""",
)
def _line_phones(spark, sf):
    lines = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_LINE} AS line")
    found = lines.select("o_orderkey", F.explode(extract.line_phones(F.col("line"))).alias("p"))
    return found.select("o_orderkey", "p.number", "p.kind", "p.usage")


@check(
    "addresses_in_text",
    """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '東京都港区芝' || CAST(s_suppkey AS STRING)
    WHEN 1 THEN '大阪府大阪市北区' END AS address,
  CASE s_suppkey % 4 WHEN 0 THEN '105-' || lpad(CAST(s_suppkey % 10000 AS STRING), 4, '0')
    WHEN 1 THEN '530-0001' END AS postal_code
FROM supplier""",
)
def _text_addresses(spark, sf):
    body = (
        "CASE s_suppkey % 4 WHEN 0 THEN '住所 〒105-' || lpad(CAST(s_suppkey % 10000 AS STRING), 4, '0') "
        "|| ' 東京都港区芝' || CAST(s_suppkey AS STRING) || ' ビル' "
        "WHEN 1 THEN '〒 530 0001 大阪府大阪市北区' "
        "WHEN 2 THEN '京都府京都市に属する町' ELSE '愛知県名古屋市中区栄' END"
    )
    rows = table(spark, sf, "supplier").selectExpr("s_suppkey", f"{body} AS body")
    found = rows.select(
        "s_suppkey", extract.address_in_text(F.col("body"), F.lit("body")).alias("a")
    )
    return found.select("s_suppkey", "a.address", "a.postal_code")


@check(
    "keyword_industries",
    """WITH k AS (SELECT doc_id, (len(text) - len(replace(text, 'en', ''))) // 2
    + (len(text) - len(replace(text, 'der', ''))) // 3 AS de,
  (len(text) - len(replace(text, 'the', ''))) // 3 + (len(text) - len(replace(text, 'ing', ''))) // 3
    AS en,
  (len(text) - len(replace(text, 'eau', ''))) // 3 + (len(text) - len(replace(text, 'oi', ''))) // 2
    AS fr FROM documents)
SELECT doc_id, CASE WHEN greatest(de, en, fr) < 2 THEN NULL WHEN de >= en AND de >= fr THEN 'german'
  WHEN en >= fr THEN 'english' ELSE 'french' END AS industry FROM k""",
)
def _keywords(spark, sf):
    words = {"german": ("en", "der"), "english": ("the", "ing"), "french": ("eau", "oi")}
    documents = table(spark, sf, "documents")
    return documents.select(
        "doc_id", extract.keyword_industry(F.col("text"), 2, words).alias("industry")
    )
