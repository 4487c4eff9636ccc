import pytest
from pyspark.sql import functions as F

from firmlens.sources import conditions, encoding, reviews, serp

HEADER = "都道府県,市区町村,検索業種,最大取得件数,有効,備考\n"


def write(folder, name, text, charset="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(charset))
    return str(path)


def test_full_width_and_bom(spark, tmp_path):
    path = write(tmp_path, "a.csv", HEADER + " 東京都 , 港区 , 建設業 ,５,はい, x \n,,,,,\n", "utf-8-sig")
    valid, _ = conditions.read_conditions(spark, path)
    row = valid.first()
    assert (row.prefecture, row.max_results, row.enabled, row.note, row.encoding) == ("東京都", 5, True, "x", "utf-8-sig")
    assert valid.count() == 1


def test_cp932_file(spark, tmp_path):
    path = write(tmp_path, "a.csv", HEADER + "大阪府,大阪市,美容業,3,無効,\n", "cp932")
    valid, _ = conditions.read_conditions(spark, path)
    row = valid.first()
    assert (row.encoding, row.enabled) == ("cp932", False)
    assert conditions.enabled_conditions(valid).count() == 0


def test_strict_refuses_and_lenient_reports(spark, tmp_path):
    text = HEADER + "東京都,港区,建設業,2,はい,\n東京都,北区,建設業,不正,はい,\n東京都,港区,建設業,9,はい,\n,北区,建設業,1,はい,\n"
    path = write(tmp_path, "a.csv", text)
    with pytest.raises(conditions.ConditionFileError, match="row 3"):
        conditions.read_conditions(spark, path)
    valid, issues = conditions.read_conditions(spark, path, strict=False)
    assert valid.count() == 1
    assert {r.row_number: r.message for r in issues.collect()} == {
        3: "最大取得件数は正の整数で指定してください", 4: "重複した検索条件です", 5: "prefecture must not be empty",
    }


def test_missing_columns_and_bad_bytes(spark, tmp_path):
    first = write(tmp_path, "a.csv", "都道府県,市区町村\nx,y\n")
    (tmp_path / "b.csv").write_bytes(b"\xff\xfe\xfd\x81")
    _, issues = conditions.read_conditions(spark, str(tmp_path), strict=False)
    got = {(r.path.rsplit("/", 1)[-1], r.row_number): r.message for r in issues.collect()}
    assert got[("a.csv", 1)] == "必須列がありません: 検索業種, 最大取得件数, 有効"
    assert got[("b.csv", 0)] == "UTF-8またはCP932として読めません"
    assert first


def test_body_charsets(spark):
    japanese = "<p>東京都の美容室</p>"
    rows = [
        (1, japanese.encode("cp932"), "text/html", "ISO-8859-1"),
        (2, f'<meta charset="Shift_JIS">{japanese}'.encode("cp932"), "", None),
        (3, japanese.encode("utf-8"), "text/html; Charset='UTF-8'", None),
        (4, japanese.encode("utf-8"), "text/html; charset=no-such", None),
        (5, ("<meta http-equiv=Content-Type content='text/html; charset=euc-jp'>" + japanese).encode("euc-jp"), "", None),
        (6, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, body binary, kind string, apparent string")
    decoded = df.select("id", encoding.decode_pages(F.col("body"), F.col("kind"), F.col("apparent")).alias("d"))
    got = {r.id: (r.d.encoding, japanese in r.d.text) for r in decoded.collect()}
    assert got == {
        1: ("cp932", True), 2: ("shift_jis", True), 3: ("utf-8", True), 4: ("no-such", True),
        5: ("euc-jp", True), 6: ("utf-8", False),
    }


def test_review_file_is_taken_or_refused(spark, tmp_path):
    header = ",".join(reviews.REVIEW_HEADERS) + "\r\n"
    good = write(tmp_path, "a.csv", header + "https://a.jp/,OK,NG,要確認,未確認,OK,OK,OK,OK,m\r\n", "utf-8-sig")
    row = reviews.read_reviews(spark, good, "rv").first()
    assert (row.url, row.store_name_judgment, row.note, row.reviewer) == ("https://a.jp/", "NG", "m", "rv")
    bad = write(tmp_path, "b.csv", header + "https://a.jp/,OK,OK,OK,OK,OK,OK,OK,MAYBE,\r\n")
    with pytest.raises(reviews.ReviewFileError, match="row 2: unknown judgment: MAYBE"):
        reviews.read_reviews(spark, bad)


def test_feed_and_layout_oddities(spark):
    rows = [
        ("bing_rss", "<rss><channel><item><title>a</title><link>https://a.jp/</link></item>"
         "<item><title>b</title></item><item><title>c</title><link>https://c.jp/?x=1&amp;y=2</link>"
         "<description> d </description></item></channel></rss>"),
        ("searxng", '{"results":[{"url":"https://a.jp","title":""},{"url":"https://b.jp","title":"B"}]}'),
        ("bing_html", '<li class="b_algo"><h2><a href="/x">n</a></h2></li><li class="b_algo"><h2>'
         '<a href="https://a.jp/">A <b>B</b></a></h2><p>s</p></li>'),
        ("duckduckgo_html", '<div class="result"><a class="result__a" href="x:y"> T more</a></div>'),
        ("mojeek", '<ul class="results-standard"><li><a class="ob" href="https://a.jp">u</a><p>s</p></li></ul>'),
    ]
    parsed = serp.parse_serps(spark.createDataFrame(rows, "provider string, body string"))
    got = {}
    for r in serp.result_rows(parsed, 10).collect():
        got.setdefault(r.provider, []).append((r.rank, r.title, r.url, r.snippet))
    assert got == {
        "bing_rss": [(1, "a", "https://a.jp/", ""), (2, "c", "https://c.jp/?x=1&y=2", "d")],
        "searxng": [(1, "B", "https://b.jp", "")],
        "bing_html": [(1, "A B", "https://a.jp/", "s")],
        "duckduckgo_html": [(1, "T more", "x:y", "")],
        "mojeek": [(1, "u", "https://a.jp", "s")],
    }


def test_every_response_keeps_a_row(spark):
    rows = [("other", "x"), (None, "x"), ("searxng", "{"), ("mojeek", "<p>none</p>"), ("searxng", '{"results":[]}')]
    parsed = serp.parse_serps(spark.createDataFrame(rows, "provider string, body string"))
    got = sorted((r.provider or "", r.parse_outcome, r.results) for r in parsed.collect())
    assert got == sorted([
        ("", "unknown_provider", None), ("mojeek", "parsed", []), ("other", "unknown_provider", None),
        ("searxng", "parsed", []), ("searxng", "unreadable", None),
    ], key=lambda row: row[:2])


def test_redirect_links(spark):
    links = {
        "//d.example/l/?uddg=https%3A%2F%2Fa.jp%2F%3Fq%3D1%26r%3D2&rut=x": "https://a.jp/?q=1&r=2",
        "https://d.example/l/?x=1&uddg=https%253A%252F%252Fa.jp%2Ba": "https://a.jp+a",
        "https://d.example/l/?uddg=a%zz": "a%zz",
        "//d.example/p": "https://d.example/p",
        "https://a.jp/#?uddg=b": "https://a.jp/#?uddg=b",
        "x:y": "x:y",
    }
    rows = spark.createDataFrame([(link,) for link in links], "link string")
    got = rows.select("link", serp.link_target(F.col("link")).alias("target")).collect()
    assert {row.link: row.target for row in got} == links


def test_charset_is_found_anywhere():
    page = b"<html><head><script>" + b"x" * 20000 + b"</script><meta charset=Shift_JIS></head>"
    assert encoding.page_charset(page, "", "") == "shift_jis"


def test_unsafe_and_broken_feeds_are_unparsed(spark):
    rows = [("<!DOCTYPE x><rss><channel></channel></rss>",), ("<rss><channel>",), ("not xml",),
            ("<rss><channel></channel></rss>",)]
    df = spark.createDataFrame(rows, "body string")
    got = [r.r for r in df.select(serp.rss_results(F.col("body")).alias("r")).collect()]
    assert got == [None, None, None, []]


def test_undeclared_charset_takes_the_cleanest_strict_decoding():
    french = "ça ça été".encode()
    # UTF-8 shows two signs of a wrong decoding; CP932 decodes strictly and shows fewer.
    assert encoding.page_charset(french, "", "") == "cp932"
    assert encoding.page_charset("déjà".encode(), "", "") == "utf-8"
    # Declared charsets are never second-guessed.
    assert encoding.page_charset(french, "text/html; charset=utf-8", "") == "utf-8"
    assert encoding.page_charset(b"\x81", "", "latin1") == "utf-8"
