import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks.queries_store import store
from firmlens.dims import SafetyLimits
from firmlens.operators import candidates, export, ordered, queue, robots, safety, stores
from firmlens.plans.export import export_snapshot
from firmlens.sinks import exports, manifest
from firmlens.streaming import ingest
from tests.test_ordered import REQUEST, random_requests, simulate

NOW = datetime(2024, 1, 15, 12)


def test_deduplication_flags_and_merges(spark):
    names = [name for name in export.HEADERS if name not in ("duplicate_candidate", "all_search_conditions")]

    def row(number, url, company="", address="", phone="", query="q"):
        values = dict.fromkeys(names, "")
        values |= dict(id=number, official_url=url, company_name=company, address=address, primary_phone=phone,
                       search_prefecture="p", search_municipality="m", search_word="w", search_query=query,
                       search_rank=1, official_score=1, business_score=1, http_status=200, is_official=True,
                       is_business_target=True, review_required=False)
        return values

    rows = [
        row(1, "https://a.jp/", "社 A", "東京1", query="q1"), row(2, "http://a.jp", "社 A", "東京1", query="q2"),
        row(3, "https://b.jp/x", "社A", "東京 1", query="q3"), row(4, "https://c.jp/", "B", "", "03"),
        row(5, "https://d.jp/", "b", "", "03"), row(6, "https://e.jp/", "C"),
    ]
    schema = ", ".join(
        f"{n} {'long' if n == 'id' else 'boolean' if n.startswith('is_') or n == 'review_required' else 'int' if n in ('search_rank', 'official_score', 'business_score', 'http_status') else 'string'}"
        for n in names
    )
    base = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    got = {r.id: (r.duplicate_candidate, r.is_sales_row, r.all_search_conditions) for r in export.deduplicate(base).collect()}
    both = "p/m/w [q1] | p/m/w [q2]"
    assert got == {
        1: (True, True, f"{both} | p/m/w [q3]"), 2: (True, False, both), 3: (True, False, "p/m/w [q3]"),
        4: (True, True, "p/m/w [q]"), 5: (True, True, "p/m/w [q]"), 6: (False, True, "p/m/w [q]"),
    }


def test_export_writes_all_or_nothing(spark, sf, tmp_path, monkeypatch):
    annotated, orphans = export_snapshot(store(spark, sf))
    folder = str(tmp_path / "out")
    assert exports.export_all(annotated, orphans, folder).number == 1
    written = manifest.current(spark, folder).folders
    assert len(written) == 15 and all((tmp_path / "out" / path).is_dir() for path in written.values())
    rows = exports.read_published(spark, folder, "all_results.csv")
    assert rows.columns == list(export.HEADERS.values())
    assert rows.count() == annotated.count()
    sales = exports.read_published(spark, folder, "全件").count()
    assert sales == annotated.filter("is_sales_row").count()

    real = exports._write_csv

    def fail(frame, path):
        if path.endswith("errors.csv"):
            raise OSError("disk full")
        real(frame, path)

    monkeypatch.setattr(exports, "_write_csv", fail)
    with pytest.raises(OSError, match="disk full"):
        exports.export_all(annotated, orphans, folder)
    assert manifest.current(spark, folder) == manifest.Version(1, written)
    assert exports.read_published(spark, folder, "全件").count() == sales
    manifest.forget(spark, folder)
    assert len(list((tmp_path / "out" / "_data").iterdir())) == 1 and exports.read_published(spark, folder, "全件").count() == sales


def test_robots_rules(spark):
    content = (
        "User-agent: scout\nDisallow: /private/\nAllow: /private/public.html\nCrawl-delay: 3\n\n"
        "User-agent: *\nDisallow: /blocked/\nCrawl-delay: 9\n"
    )
    files = spark.createDataFrame([("https://a.jp", content), ("https://b.jp", "")], "origin string, content string")
    urls = spark.createDataFrame(
        [("https://a.jp/private/x",), ("https://a.jp/private/public.html",), ("https://a.jp/blocked/",),
         ("https://b.jp/x",), ("https://c.jp/",)], "url string",
    )
    def allowed(agent):
        decided = robots.robots_decisions(urls, robots.robots_policies(files, agent))
        return {r.url: (r.robots_allowed, r.crawl_delay) for r in decided.collect()}

    assert allowed("Scout/4") == {
        "https://a.jp/private/x": (False, 3.0), "https://a.jp/private/public.html": (True, 3.0),
        "https://a.jp/blocked/": (True, 3.0), "https://b.jp/x": (True, None), "https://c.jp/": (False, None),
    }
    assert allowed("other/1")["https://a.jp/blocked/"] == (False, 9.0)


def matches(pattern, path):
    """Whether a robots pattern matches a path, one character at a time."""
    whole = pattern.endswith("$")
    parts = (pattern[:-1] if whole else pattern).split("*")
    if not path.startswith(parts[0]):
        return False
    at = len(parts[0])
    for part in parts[1:]:
        at = path.find(part, at)
        if at < 0:
            return False
        at += len(part)
    if whole and len(parts) > 1:
        return path.endswith(parts[-1])
    return not whole or at == len(path)


def test_robots_index_matches_every_rule(spark):
    rnd = random.Random(6)
    pieces = ["/", "a", "b", "/x", ".html", "日", "%20", "?q=1", "$"]
    rules = []
    for _ in range(60):
        pattern = "/" + "".join(rnd.choices([*pieces, "*"], k=rnd.randint(0, 4)))
        rules.append((rnd.random() < 0.4, pattern.rstrip("$") + ("$" if rnd.random() < 0.3 else "")))
    content = "User-agent: *\n" + "\n".join(f"{'Allow' if allow else 'Disallow'}: {pattern}" for allow, pattern in rules)
    paths = sorted({"/" + "".join(rnd.choices([p for p in pieces if p not in ("?q=1", "%20")], k=rnd.randint(0, 6))) for _ in range(300)})
    files = spark.createDataFrame([("https://a.jp", content)], "origin string, content string")
    urls = spark.createDataFrame([(f"https://a.jp{path}",) for path in paths], "url string")
    got = {r.url[12:]: r.robots_allowed for r in robots.robots_decisions(urls, robots.robots_policies(files, "x")).collect()}
    for path in paths:
        hits = [(len(p.replace("*", "")) - p.endswith("$"), allow) for allow, p in rules if matches(p, path)]
        assert got[path] == (max(hits)[1] if hits else True), path


def test_an_origin_with_many_rules(spark):
    content = "User-agent: *\n" + "\n".join(f"Disallow: /dir{k}/" for k in range(100_000)) + "\nAllow: /dir7/open$\n"
    files = spark.createDataFrame([("https://a.jp", content)], "origin string, content string")
    urls = spark.range(3000).selectExpr("'https://a.jp/dir' || (id * 40) || if(id % 2 = 0, '/x', '') AS url")
    urls = urls.unionByName(spark.createDataFrame([("https://a.jp/dir7/open",), ("https://a.jp/dir7/opened",)], "url string"))
    decided = robots.robots_decisions(urls, robots.robots_policies(files, "x"))
    got = {r.url: r.robots_allowed for r in decided.collect()}
    assert got["https://a.jp/dir7/open"] and not got["https://a.jp/dir7/opened"]
    assert sum(not allowed for allowed in got.values()) == 1 + sum(1 for k in range(0, 3000, 2) if k * 40 < 100_000)


def test_candidate_outcomes(spark):
    now = F.lit(NOW)
    tasks = spark.createDataFrame(
        [(i, 1, f"https://h{i}.jp/") for i in range(1, 10)], "progress_id long, condition_id long, url string"
    ).withColumns({"search_prefecture": F.lit("東京都"), "search_municipality": F.lit("港区"), "search_industry": F.lit("建設業")})
    fetches = spark.createDataFrame(
        [(f"https://h{i}.jp/", f"https://h{i}.jp/", status, error, after, "<title>x</title>")
         for i, status, error, after in [
             (1, 200, None, None), (2, 200, None, None), (3, None, "robots_denied", None), (4, None, "timeout", None),
             (5, 429, None, "900"), (6, 503, None, "900"), (7, 404, None, None), (8, 500, None, None)]]
        + [("https://h9.jp/", "", 200, None, None, "")],
        "url string, final_url string, http_status int, fetch_error string, retry_after string, html string",
    )
    pauses = spark.createDataFrame([("https://h1.jp", datetime(2024, 1, 15, 13))], "origin string, paused_until timestamp")
    known = spark.createDataFrame([("https://h2.jp/", "success"), ("https://h4.jp/", "timeout")], "url string, processing_status string")
    got = candidates.process_candidates(tasks, fetches, pauses, known, now, ("x.com",)).collect()
    assert {r.progress_id: (r.status, r.error_type) for r in got} == {
        1: ("http_429", "domain_paused"), 2: ("duplicate", None), 3: ("robots_denied", None), 4: ("timeout", "timeout"),
        5: ("http_429", "http_429"), 6: ("http_503", "http_503"), 7: ("http_404", "http_404"), 8: ("failed", "failed"),
        9: ("extraction_failed", "extraction_error"),
    }
    processed = candidates.process_candidates(tasks, fetches, pauses, known, now, ("x.com",)).persist()
    saved = candidates.outcome_pages(processed, now).collect()
    assert {r.page_id for r in saved} == {3, 4, 5, 6, 7, 8, 9}
    assert {r.progress_id for r in candidates.outcome_errors(processed, now).collect()} == {4, 5, 6, 7, 8, 9}
    moves = {r.id: (r.action, r.error) for r in candidates.outcome_transitions(processed).collect()}
    assert moves[1] == ("retry", "domain_paused") and moves[2][0] == "complete" and moves[3][0] == "complete"
    assert moves[5] == ("retry", "http_429") and moves[9] == ("fail", "source_url must not be empty")
    assert {r.seq for r in candidates.outcome_pauses(processed).collect()} == {4, 5, 6}
    wait = {r.progress_id: r.available_at and (r.available_at - NOW).total_seconds() for r in got}
    assert (wait[1], wait[4], wait[5], wait[6], wait[7]) == (3600, 300, 900, 300, None)


def test_queue_round(spark):
    progress = spark.createDataFrame([], queue.PROGRESS)
    tasks = spark.createDataFrame([("a", "{}", 1), ("a", "{1}", 2), ("b", "{}", 3)], "task_key string, payload string, seq long")
    now = F.lit(NOW)
    progress = queue.enqueue(progress, tasks, now)
    assert [(r.id, r.payload) for r in progress.orderBy("id").collect()] == [(1, "{}"), (3, "{}")]
    running = queue.mark_running(progress, queue.claimable(progress, now, 1), now)
    outcomes = spark.createDataFrame(
        [(1, "retry", "e" * 3000, datetime(2024, 1, 16), None), (3, "complete", None, None, None)],
        "id long, action string, error string, available_at timestamp, cursor string",
    )
    updated, illegal = queue.apply_outcomes(running, outcomes, now)
    first = updated.filter("id = 1").first()
    assert (first.status, first.attempts, len(first.last_error)) == ("pending", 1, 3000)
    assert [r.message for r in illegal.collect()] == ["Task 3 is not running"]
    assert [r.id for r in queue.claimable(updated, now, 9).collect()] == [3]


def test_outcomes_with_long_errors_are_not_broadcast(spark, tmp_path):
    rows = spark.range(50).selectExpr(
        "id", "'t' AS task_key", "'{}' AS payload", "'running' AS status", "CAST(NULL AS STRING) AS cursor", "1 AS attempts",
        "CAST(NULL AS STRING) AS last_error", "CAST(NULL AS TIMESTAMP) AS available_at", "CAST(NULL AS TIMESTAMP) AS updated_at",
    )
    rows.write.parquet(str(tmp_path / "progress"))
    progress = spark.read.parquet(str(tmp_path / "progress"))
    outcomes = progress.selectExpr("id", "'fail' AS action", "repeat('e', 2005) AS error", "available_at", "cursor")
    updated, _ = queue.apply_outcomes(progress, outcomes, F.lit(NOW))
    assert "BroadcastExchange" not in updated._jdf.queryExecution().executedPlan().toString()
    assert {(r.status, len(r.last_error)) for r in updated.collect()} == {("failed", 2005)} and updated.count() == 50


def test_sales_target_needs_a_phone(spark):
    rows = spark.createDataFrame([(True, False), (True, True), (None, True)], "is_business_target boolean, has_phone boolean")
    from firmlens.operators.score import counts_as_target

    assert [r[0] for r in rows.select(counts_as_target()).collect()] == [False, True, False]
    assert [r[0] for r in rows.select(counts_as_target(True)).collect()] == [True, True, False]


def test_streams_over_several_batches(spark, tmp_path):
    import random

    rows = random_requests(random.Random(9), 160, runs="r", domains="abc")
    source = tmp_path / "in"
    limits = SafetyLimits(max_requests=40, max_requests_per_domain=9, max_response_bytes=100)
    folder, state = str(tmp_path / "out"), str(tmp_path / "state")
    seen, seen_state = str(tmp_path / "seen"), str(tmp_path / "seen-state")
    for start in range(0, 160, 40):
        part = spark.createDataFrame([tuple(r.values()) for r in rows[start : start + 40]], REQUEST)
        part.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(REQUEST).parquet(str(source))
        ingest.safety_stream(stream, folder, state, limits, once=True).awaitTermination()
        urls = stream.select(F.col("domain").alias("url"), "seq")
        ingest.once_ever_stream(urls, seen, seen_state, F.col("seq"), once=True).awaitTermination()
    got = {r.seq: (r.verdict, r.allowed) for r in spark.read.parquet(folder).collect()}
    assert got == simulate(rows, limits)
    first = {}
    for r in rows:
        first.setdefault(r["domain"], r["seq"])
    assert {r.url: r.seq for r in spark.read.parquet(seen).collect()} == first


def test_latest_children_follow_their_parent(spark):
    parents = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "page_id long, batch_id long")
    children = spark.createDataFrame([(1, "old", 0), (2, "kept", 0)], "page_id long, number string, batch_id long")
    kept = ingest.latest_children(children, parents, "page_id").collect()
    assert [(r.page_id, r.number) for r in kept] == [(2, "kept")]


def test_bounded_horizon_stream(spark, tmp_path):
    rows = [("u", datetime(2024, 1, 1, 0, 0)), ("u", datetime(2024, 1, 1, 0, 1)), ("v", datetime(2024, 1, 1, 0, 2))]
    spark.createDataFrame(rows, "url string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, at timestamp").parquet(str(tmp_path / "in"))
    unique = ingest.once_within_horizon(stream, "at", "10 minutes")
    query = (
        unique.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["u", "v"]


def test_review_template_is_never_overwritten(spark, tmp_path):
    path = str(tmp_path / "template")
    exports.write_review_template(spark.range(3), path)
    exports.write_review_template(spark.range(9), path)
    assert spark.read.option("header", True).csv(path).count() == 3


def test_join_text_keeps_first_seen_order(spark):
    rows = spark.createDataFrame([("k", 3, "a"), ("k", 1, "b"), ("k", 2, "a")], "k string, id long, t string")
    assert ordered.join_text(rows, ["k"], "id", "t", "joined").first().joined == "b | a"


def test_upserted_page_keeps_its_identity(spark):
    schema = "page_id long, url string, processing_status string, fetched_at string, updated_at string"
    old = spark.createDataFrame([(1, "u", "timeout", "d1", "d1")], schema)
    new = spark.createDataFrame([(9, "u", "success", "d2", "d2"), (5, "v", "success", "d2", "d2")], schema)
    got = sorted(tuple(r) for r in stores.upsert_pages(old, new).collect())
    assert got == [(1, "u", "success", "d1", "d2"), (5, "v", "success", "d2", "d2")]


def test_html_types(spark):
    rows = spark.createDataFrame([("Text/HTML; x",), ("application/xhtml+xml",), ("text/plain",), (None,)], "t string")
    assert [r[0] for r in rows.select(safety.is_html(F.col("t"))).collect()] == [True, True, False, False]


def test_audit_is_appended_by_run(spark, tmp_path):
    path = str(tmp_path / "audit")
    for run in ("a", "b", "a"):
        exports.append_audit(spark.createDataFrame([(run, 1)], "run_id string, n int"), path)
    assert spark.read.parquet(path).filter("run_id = 'a'").count() == 2


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("bucketed_pages", "bucketed_tasks"):
            exports.save_bucketed(spark.range(50).selectExpr("CAST(id AS STRING) AS url", "id"), name, "url", 4)
        joined = spark.table("bucketed_pages").join(spark.table("bucketed_tasks").select("url"), "url")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        for name in ("bucketed_pages", "bucketed_tasks"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
