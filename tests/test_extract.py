import pytest
from pyspark.sql import functions as F

from firmlens.dims import EXCLUDED_DOMAINS
from firmlens.operators import extract, pages, score
from firmlens.operators.page_type import with_page_type


def extracted(spark, html, url="https://a.example/"):
    rows = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return extract.extract_companies(pages.page_features(rows)).first()


def phones(row):
    return [(p.number, p.kind, p.usage, p.source) for p in row.phones]


GRAPH = """<html><head><title>アクセス | みなと</title>
<script type="application/ld+json">{"@graph":[{"@type":"WebSite","name":"対象外"},
[{"@type":["https://schema.org/Organization"],"legalName":" 株式会社みなと ","name":"みなとグループ"}],
{"@type":"Restaurant","name":"みなと食堂 本店","alternateName":"みなと",
 "telephone":["０９０－７７７７－８８８８","not a number", 5],
 "contactPoint":{"telephone":"０８０－１１１１－２２２２","contactType":"予約専用"},
 "address":{"addressRegion":"神奈川県","addressLocality":"横浜市","streetAddress":"港1","postalCode":"220 0001"}}]}</script>
<script type="application/ld+json">{ broken</script></head>
<body><p>採用 090-7777-8888</p><p>TEL 045-111-2222 / FAX 045-111-3333</p></body></html>"""


def test_structured_data_comes_first(spark):
    row = extracted(spark, GRAPH)
    assert tuple(row.company_name) == ("株式会社みなと", "jsonld_legal_name")
    assert tuple(row.store_name) == ("みなと食堂 本店", "jsonld")
    assert tuple(row.display_name) == ("みなと", "jsonld")
    assert tuple(row.address) == ("神奈川県横浜市港1", "220-0001", "神奈川県", "横浜市", "jsonld")
    assert tuple(row.industry) == ("飲食店", "jsonld")
    # The first sighting was a plain number, the later one names its purpose; the FAX is gone.
    assert phones(row) == [
        ("080-1111-2222", "mobile", "reservation", "jsonld"),
        ("090-7777-8888", "mobile", "recruiting", "body"),
        ("045-111-2222", "fixed", "main", "body"),
    ]
    assert len(row.jsonld) == 2


@pytest.mark.parametrize(
    ("html", "name", "source"),
    [
        ("<h2>会社概要</h2><p>有限会社A</p>", "有限会社A", "company"),
        ("<div><h3>会社概要</h3><dl><dt>会社名</dt><dd>Aカンパニー</dd></dl></div>", "Aカンパニー", "company"),
        ("<p>Copyright 2024 合同会社B all</p>", "合同会社B", "copyright"),
        ("<footer>株式会社C © x</footer>", "株式会社C", "footer"),
        ('<meta property="og:site_name" content=" D ">', "D", "ogp"),
        ("<title>E社 ｜ 公式</title><h1>F</h1>", "E社", "title"),
        ("<title>ホーム</title><h1>F</h1>", "F", "h1"),
    ],
)
def test_company_name_sources(spark, html, name, source):
    assert tuple(extracted(spark, f"<html><body>{html}</body></html>").company_name) == (name, source)


def test_address_priority_and_rejections(spark):
    three = (
        '<section class="x company-profile"><p>〒530-0001 大阪府大阪市北区梅田1</p></section>'
        '<section id="ACCESS"><p>京都府京都市下京区2</p></section><footer>愛知県名古屋市中区3-1</footer>'
    )
    assert extracted(spark, three).address.source == "company"
    assert extracted(spark, three.replace("大阪府", "x")).address.source == "access"
    assert extracted(spark, three.replace("大阪府", "x").replace("京都府", "x")).address.source == "footer"
    assert extracted(spark, "<p>沖縄県豊見城市に属する島です</p>").address is None
    assert extracted(spark, "<p>愛知県名古屋市中区栄</p>").address is None
    assert extracted(spark, "<p>愛知県名古屋市中区栄三丁目</p>").address.source == "body"
    heading = "<article><h3>アクセス</h3><p>北海道札幌市中央区北</p></article>"
    assert extracted(spark, heading).address.source == "access"


def test_industry_evidence(spark):
    assert tuple(extracted(spark, "<title>駅前クリニック</title>").industry) == ("医療", "title")
    assert tuple(extracted(spark, "<p>居酒屋と食堂</p>").industry) == ("飲食店", "body")
    assert extracted(spark, "<p>居酒屋</p>").industry is None
    assert extracted(spark, "<h1>観光記事</h1><p>居酒屋と食堂</p>").industry is None
    tie = extracted(spark, "<title>病院 食堂</title>")
    assert tuple(tie.industry) == ("飲食店", "title")


def test_phone_lines(spark):
    line = "電話 03-1234-5678、緊急 0120-000-111" + "x" * 30 + " 090 1111 2222 09011112222333"
    rows = spark.createDataFrame([(line,)], "line string")
    got = rows.select(extract.line_phones(F.col("line")).alias("p")).first().p
    assert [(p.number, p.usage) for p in got] == [("03-1234-5678", "emergency"), ("090-1111-2222", "unknown")]


def test_hidden_text_and_stray_tags(spark):
    html = (
        "<title>t</title><style>会社概要</style><script>求人</script><template><p>x</p></template>"
        "</div><p>a<p>b<br/>c</p><noscript>n</noscript><!-- 記事 -->&amp; d"
    )
    rows = spark.createDataFrame([(1, "https://a.example/p", html)], "page_id long, url string, html string")
    row = pages.page_features(rows).select("tokens", pages.visible_text().alias("v")).first()
    assert row.tokens == ["t", "a", "b", "c", "n", "& d"]
    assert row.v == "t a b c & d"


PAGE_TYPES = [
    ("https://a.jp/", "<title>店の紹介</title>", "official_home"),
    ("https://a.jp/index.html", "", "official_home"),
    ("https://a.jp/x", "<h1>会社概要</h1>", "company"),
    ("https://a.jp/about/", "", "company"),
    ("https://a.jp/shop", "", "store"),
    ("https://a.jp/x", "<title>駅前本店</title>", "store"),
    ("https://a.jp/contact/form", "", "contact"),
    ("https://a.jp/x", "<h1>交通案内</h1>", "access"),
    ("https://a.jp/Blog/1", "", "article"),
    ("https://a.jp/x", "<p>求人</p>", "job"),
    ("https://a.jp/x", "<p>おすすめの店 一覧</p>", "portal"),
    ("https://a.jp/x", '<meta name="Description" content="電話帳">', "directory"),
    ("https://a.jp/x", "<p>" + "あ" * 3100 + "求人</p>", "job"),
    ("https://a.jp/x", "<p>text</p>", "unknown"),
]


def test_page_types(spark):
    rows = spark.createDataFrame(
        [(i, url, html) for i, (url, html, _) in enumerate(PAGE_TYPES)], "page_id long, url string, html string"
    )
    got = with_page_type(pages.page_features(rows)).select("page_id", "page_type").collect()
    assert {row.page_id: row.page_type for row in got} == {i: case[2] for i, case in enumerate(PAGE_TYPES)}
    narrowed = with_page_type(pages.page_features(rows.where("page_id = 12")), body_chars=3000)
    assert narrowed.first().page_type == "unknown"


def test_no_page_ends_the_job(spark):
    scopes = '<div itemscope itemprop="x">' * 3000
    bodies = [
        '<script type="application/ld+json">{"@type":"Organization","name":"A\\ud83d"}</script>',
        f'<div itemscope itemtype="https://schema.org/Restaurant/"><b itemprop="name">R</b>{scopes}',
        "<p>a</p><![bad[ x ]]><p>b</p>",
        None,
        "<p>ok</p>",
    ]
    rows = spark.createDataFrame(list(enumerate(bodies)), "page_id int, html string")
    got = {row.page_id: row for row in pages.page_features(rows).collect()}
    assert got[0].jsonld[0].name == "A\ufffd"
    assert (got[1].microdata[0].types, got[1].microdata[0].props) == (["Restaurant"], {"name": "R"})
    assert got[2].tokens == ["a"] and got[2].parse_error.startswith("AssertionError")
    assert got[3].tokens == [] and got[4].tokens == ["ok"] and got[4].parse_error is None


def test_unparsable_page_says_why(monkeypatch):
    def broken(html, with_lines=True):
        if html == "bad":
            raise ValueError("no page")
        return whole(html, with_lines)

    whole = pages.page_record
    monkeypatch.setattr(pages, "page_record", broken)
    assert pages._guarded_record("bad", True)["parse_error"] == "ValueError: no page"
    assert pages._guarded_record("<p>x</p>", True)["tokens"] == ["x"]


def test_full_width_phone_in_microdata(spark):
    html = ('<div itemscope itemtype="https://schema.org/Restaurant">'
            '<meta itemprop="telephone" content="０３－１２３４－５６７８"></div>')
    assert phones(extracted(spark, html)) == [("03-1234-5678", "fixed", "main", "schema")]


def test_nested_items_and_repeated_properties():
    html = ('<div itemscope itemtype="x/Organization"><a itemprop="url" href="TEL:1">t</a><b itemprop="name">A</b>'
            '<div itemprop="name" itemscope><i itemprop="name">in</i><i itemprop="name">last</i></div>'
            '<img itemprop="logo" src="l.png"><meta itemprop="empty"><a itemprop="tel"> 2 </a></div>')
    item = pages.page_record(html)["microdata"][0]
    assert item["props"] == {"url": "1", "logo": "l.png", "empty": "", "tel": "2"}
    assert item["nested"] == {"name": {"name": "last"}}


OFFICIAL = """<html><head><title>株式会社あおば建設 公式</title><script type="application/ld+json">
{"@type":"Organization","legalName":"株式会社あおば建設","telephone":"03-1234-5678",
"address":{"addressRegion":"東京都","addressLocality":"千代田区","streetAddress":"丸の内1"}}</script></head>
<body><h1>株式会社あおば建設</h1><nav>会社概要 お問い合わせ アクセス</nav><p>工務店</p>
<footer>© 株式会社あおば建設</footer></body></html>"""


def scored(spark, url, html, context=("東京都", "千代田区", "建設業")):
    rows = spark.createDataFrame(
        [(1, url, html, *context)],
        "page_id long, url string, html string, search_prefecture string, "
        "search_municipality string, search_industry string",
    )
    parsed = extract.extract_companies(pages.page_features(rows))
    return score.score_pages(parsed, EXCLUDED_DOMAINS).first()


def test_official_site_is_a_target(spark):
    row = scored(spark, "https://aoba.example/", OFFICIAL)
    assert (row.official_score, row.business_score) == (85, 88)
    assert (row.is_official, row.is_business_target, row.review_required) == (True, True, False)
    assert row.reasons[-1] == "公式サイトかつ営業対象の判定基準を満たす"


def test_excluded_domain_never_is(spark):
    row = scored(spark, "https://shop.itp.ne.jp/", OFFICIAL)
    assert (row.business_score, row.is_official, row.review_required) == (0, False, False)
    assert row.negative_signals[-1] == "excluded_domain"
    assert "除外ドメインに一致: itp.ne.jp (directory)" in row.reasons
    assert scored(spark, "https://city.example.lg.jp/", OFFICIAL).exclusion_category == "government"


def test_mismatches_and_penalties(spark):
    html = (
        "<p>株式会社A 株式会社B 株式会社C おすすめ 20選 レストラン 居酒屋 〒530-0001 大阪府大阪市北区1</p>"
        + "".join(f'<a href="https://h{n}.example/">x</a>' for n in range(8))
    )
    row = scored(spark, "https://x.example/p", html)
    for signal in ("industry_mismatch", "region_mismatch", "ranking", "multiple_companies", "many_external_links"):
        assert signal in row.negative_signals
    assert row.official_score == 0


def test_unfinished_markup_is_text_and_read_once():
    import time

    from firmlens.functions.html_tree import parse_html

    for body in ("<a " * 350_000, "<!-- " * 200_000, '<p><a b="' * 110_000, "<a " * 350_000 + ">"):
        started = time.perf_counter()
        parse_html(body)
        assert time.perf_counter() - started < 2
    root = parse_html("<p>x</p>y &amp; <a b <!-- c")
    assert root.children[-1] == "y & <a b <!-- c" and "parse_error" not in root.attrs
    assert parse_html("<script>if (a > b) c").children[0].children == []
