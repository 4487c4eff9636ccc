"""Candidate flow: outcomes of good and broken pages, and a plan that leaves the body table where it is."""

from pyspark.sql import functions as F

from firmlens.operators.candidates import outcome_errors, process_candidates

CANDIDATE = (
    "progress_id long, condition_id long, url string, search_prefecture string, search_municipality string, "
    "search_industry string"
)
FETCH = "url string, final_url string, http_status int, fetch_error string, retry_after string, html string"
GOOD = """<title>株式会社みどり</title><script type="application/ld+json">{"@type":"Organization",
"legalName":"株式会社みどり","telephone":"03-1234-5678","address":{"postalCode":"1000001","addressRegion":"東京都",
"addressLocality":"千代田区","streetAddress":"千代田1"}}</script><nav>会社概要 お問い合わせ アクセス</nav><p>工務店 リフォーム</p>"""


def processed(spark, tmp_path):
    paths = {"good": GOOD, "broken": "<p>x</p><![bad[ x ]]>", "gone": None, "hostless": "<p>x</p>", "unnamed": "<p>x</p>"}
    urls = {name: f"https://{name}.jp/" for name in paths}
    fetches = [
        (urls[name], {"hostless": "file:///x", "unnamed": " "}.get(name, urls[name]), 404 if name == "gone" else 200, None, None, html)
        for name, html in paths.items()
    ] + [(f"https://other{n}.jp/", f"https://other{n}.jp/", 200, None, None, "<p>o</p>") for n in range(100)]
    folder = str(tmp_path / "fetches")
    spark.createDataFrame(fetches, FETCH).write.parquet(folder)
    rows = [(n, 1, url, "東京都", "千代田区", "建設業") for n, url in enumerate([*urls.values(), "https://never.jp/"])]
    pauses = spark.createDataFrame([], "origin string, paused_until timestamp")
    known = spark.createDataFrame([("https://known.jp/", "success")], "url string, processing_status string")
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    found = process_candidates(
        spark.createDataFrame(rows, CANDIDATE), spark.read.parquet(folder), pauses, known, now, ("example.com",)
    )
    return found, now


def test_every_candidate_has_an_outcome(spark, tmp_path):
    found, now = processed(spark, tmp_path)
    got = {row.url.split("//")[1].split(".")[0]: row for row in found.collect()}
    assert {name: row.status for name, row in got.items()} == {
        "good": "success", "broken": "extraction_failed", "gone": "http_404", "hostless": "scoring_failed",
        "unnamed": "extraction_failed", "never": "failed",
    }
    assert got["good"].has_phone and got["good"].counts_as_target and not got["broken"].extracted
    assert got["never"].counts_as_target is False and got["never"].has_phone is False
    errors = {row.page_id: (row.error_type, row.message) for row in outcome_errors(found, now).collect()}
    kind, message = errors[got["broken"].progress_id]
    assert kind == "extraction_error" and message.startswith("AssertionError")


def test_bodies_are_not_shuffled_for_few_candidates(spark, tmp_path):
    found, _ = processed(spark, tmp_path)
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    scans = [at for at, line in enumerate(lines) if "FileScan" in line and "html" in line.split("Batched")[0]]
    assert len(scans) == 1
    above, level = [], depth[scans[0]]
    for at in range(scans[0], -1, -1):
        if depth[at] < level:
            above.append(lines[at])
            level = depth[at]
    assert any("BroadcastHashJoin" in line for line in above)
    assert not any("Exchange hashpartitioning" in line for line in above)
    assert sum("MapInArrow" in line for line in lines) == 1
