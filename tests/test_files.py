import pytest
from pyspark.sql import functions as F

from checks.bindings import bound
from checks.queries_store import store
from firmlens.operators.domains import domain_exclusion
from firmlens.operators.report import LIVE_SHEETS, review_template
from firmlens.plans.export import export_snapshot, live_sheets, publish_live_report
from firmlens.sinks import exports, manifest
from firmlens.sources import encoding, rules


def test_live_report_has_its_sheets(spark, sf, tmp_path):
    tables = store(spark, sf)
    annotated, orphans = export_snapshot(tables)
    runs = spark.createDataFrame(
        [("live-check", "2024-01-01T00:00:00", None)], "command string, started_at string, finished_at string"
    )
    scoring = tables.scoring
    sheets = live_sheets(
        tables, annotated, orphans, bound(spark, sf, "b_http_audit"), bound(spark, sf, "b_provider_audit"),
        bound(spark, sf, "b_reviews"), runs, F.lit("now"), run_id="run-1", provider_run_id="run-2",
    )
    assert tuple(sheets) == LIVE_SHEETS
    assert sheets["要確認"].count() == annotated.filter("review_required").count()
    assert sheets["HTTP監査"].select("run_id").distinct().count() == 1
    values = {row.metric: row.value for row in sheets["検証概要"].collect()}
    assert values["終了時刻"] == "" and values["総実行時間"] == ""
    assert scoring.count() > 0

    folder, template = str(tmp_path / "report"), str(tmp_path / "template")
    assert publish_live_report(sheets, review_template(annotated), folder, template).number == 1
    assert set(manifest.current(spark, folder).folders) == set(LIVE_SHEETS)
    for name in LIVE_SHEETS:
        assert exports.read_published(spark, folder, name).columns == sheets[name].columns
    shown = exports.read_published(spark, folder, "検索結果").count()
    assert shown == sheets["検索結果"].count() and spark.read.option("header", True).csv(template).count() == annotated.count()

    broken = dict(sheets, **{"検証概要": sheets["検証概要"].withColumn("value", F.raise_error(F.lit("killed")))})
    with pytest.raises(Exception, match="killed"):
        publish_live_report(broken, review_template(annotated), folder, template)
    assert manifest.current(spark, folder).number == 1 and exports.read_published(spark, folder, "検索結果").count() == shown


def test_domain_file(spark, tmp_path):
    path = tmp_path / "domains.txt"
    path.write_text("# list\n\n Example.COM. \nnews.example.jp\n", encoding="utf-8")
    listed = rules.read_excluded_domains(spark, str(path))
    assert [r.domain for r in listed.orderBy("position").collect()] == ["example.com", "news.example.jp"]
    urls = [("https://a.b.example.com/",), ("https://myexample.com/",), ("https://news.example.jp:1/",), ("https://x.go.jp/",)]
    found = domain_exclusion(spark.createDataFrame(urls, "url string"), listed)
    got = {r.url: (r.domain_excluded, r.exclusion_category) for r in found.collect()}
    assert got == {
        "https://a.b.example.com/": (True, "excluded"), "https://myexample.com/": (False, None),
        "https://news.example.jp:1/": (True, "news"), "https://x.go.jp/": (True, "government"),
    }


def test_long_domain_list(spark):
    names = [f"d{number}.example" for number in range(1000)]
    urls = [("https://www.d999.example/",), ("https://d0.example/",), ("https://xd0.example/",)]
    df = spark.createDataFrame(urls, "url string")
    rows = spark.createDataFrame(list(enumerate(names)), "position int, domain string")
    for domains in (names, rows):
        got = {r.url: r.matched_domain for r in domain_exclusion(df, domains).collect()}
        assert got == dict(zip([u for u, in urls], ["d999.example", "d0.example", None]))


def test_stored_pages_are_read_as_text(spark, tmp_path):
    rows = [("a", "店".encode("cp932"), "cp932"), ("b", "店".encode(), "no-such"), ("c", None, None)]
    spark.createDataFrame(rows, "url string, content binary, encoding string").write.parquet(str(tmp_path / "p"))
    pages = encoding.read_pages(spark, str(tmp_path / "p"))
    assert "content" not in pages.columns
    assert {r.url: r.html for r in pages.collect()} == {"a": "店", "b": "店", "c": None}


def test_reviews_are_appended(spark, tmp_path):
    path = str(tmp_path / "reviews")
    for url in ("a", "b"):
        exports.append_reviews(spark.createDataFrame([(url,)], "url string"), path, F.lit("2024-01-01"))
    assert spark.read.parquet(path).count() == 2


def test_a_repeated_append_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "audit")
    first = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "run_id string, n int")
    for key, rows in (("k1", first), ("k2", first.where("run_id = 'a'")), ("k1", first), ("k2", first.where("run_id = 'a'"))):
        exports.append_audit(rows, path, key)
    assert sorted((r.run_id, r.n, r.append_key) for r in spark.read.parquet(path).collect()) == [
        ("a", 1, "k1"), ("a", 1, "k2"), ("b", 2, "k1"), ("b", 3, "k1")
    ]
    reviews = str(tmp_path / "again")
    for _ in range(2):
        exports.append_reviews(spark.createDataFrame([("u",)], "url string"), reviews, F.lit("2024-01-01"), "import 1")
    assert spark.read.parquet(reviews).count() == 1
