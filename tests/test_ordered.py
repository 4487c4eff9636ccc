"""Block-wise and top-k formulations against plain sequential loops."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from firmlens.dims import SafetyLimits
from firmlens.operators import candidates, ordered, safety, schedule, search


def test_running_totals_over_many_blocks(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), seq, rng.randint(-5, 5)) for seq in rng.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    got = ordered.running_totals(df, ["k"], "seq", {"s": F.col("v")}, {"m": F.col("v")}, parts=7)
    expected = {}
    for key, seq, _ in rows:
        earlier = [v for k, s, v in rows if k == key and s < seq]
        expected[(key, seq)] = (sum(earlier), max(earlier, default=None))
    assert {(r.k, r.seq): (r.s, r.m) for r in got.collect()} == expected


def test_a_hot_key_with_sparse_numbers_stays_spread(spark):
    df = spark.range(20_000).selectExpr("if(id % 10 = 0, 'cold' || id, 'hot') AS k", "xxhash64(id) AS seq", "id AS v")
    sizes = [r["count"] for r in ordered._placed(df, ["k"], "seq", 8).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
    got = ordered.running_totals(df, ["k"], "seq", {"n": F.lit(1)}, parts=8).where("k = 'hot'").select("seq", "n").collect()
    order = sorted(r.seq for r in got)
    assert len(order) == 18_000 and all(order[r.n] == r.seq for r in got)


def test_schedule_follows_the_recurrence(spark):
    rng = random.Random(2)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    clock, rows, ready, expected = 0.0, [], {}, {}
    for seq in range(300):
        clock += rng.choice([0, 0.5, 1, 4])
        host, delay = rng.choice("aaab"), rng.choice([None, 0.0, 1.5, 6.0])
        begin = max(clock, ready.get(host, clock))
        ready[host] = begin + (2.0 if delay is None else delay)
        rows.append((seq, f"https://{host}.jp/{seq}", start + timedelta(seconds=clock), delay))
        expected[seq] = round((begin - clock) * 1e6)
    df = spark.createDataFrame(rows, "seq long, url string, requested_at timestamp, delay_seconds double")
    for block_rows in (9, 1000):
        got = schedule.fetch_schedule(df, 2.0, block_rows).collect()
        assert {r.seq: r.wait_micros for r in got} == expected


def simulate(requests, limits):
    """One run after the other, request by request."""
    total, sent, forbidden, stopped = Counter(), Counter(), Counter(), set()
    verdicts = {}
    for r in sorted(requests, key=lambda r: r["seq"]):
        key = (r["run_id"], r["domain"])
        if key in stopped:
            verdict, allowed = "domain_stopped", False
        elif total[r["run_id"]] >= limits.max_requests:
            verdict, allowed = "run_http_limit", False
        elif sent[key] >= limits.max_requests_per_domain:
            stopped.add(key)
            verdict, allowed = "domain_http_limit", False
        elif r["elapsed_seconds"] >= limits.max_runtime_seconds:
            verdict, allowed = "run_time_limit", False
        else:
            allowed, verdict = True, r["error"]
            total[r["run_id"]] += 1
            sent[key] += 1
            if r["error"] == "robots_denied":
                stopped.add(key)
            if r["http_status"] == 429:
                stopped.add(key)
                verdict = "rate_limited_domain"
            if r["http_status"] == 403:
                forbidden[key] += 1
                if forbidden[key] >= limits.forbidden_limit:
                    stopped.add(key)
                    verdict = "repeated_403"
            if r["redirect_repeat"]:
                stopped.add(key)
                verdict = "redirect_loop"
            if r["size_exceeded"] or r["content_length"] > limits.max_response_bytes:
                verdict = "response_too_large"
            elif r["content_length"] and r["content_type"] != "text/html":
                verdict = "non_html_content"
            if r["captcha"]:
                stopped.add(key)
                verdict = "captcha_signal"
            if r["block"]:
                stopped.add(key)
                verdict = "block_page_signal"
        verdicts[r["seq"]] = (verdict or "html", allowed)
    return verdicts


REQUEST = (
    "run_id string, seq long, domain string, elapsed_seconds double, error string, http_status int, "
    "redirect_repeat boolean, size_exceeded boolean, content_length long, content_type string, "
    "captcha boolean, block boolean"
)


def random_requests(rng, count, runs="rs", domains="abcdef"):
    rows, clock = [], {run: 0.0 for run in runs}
    for seq in range(count):
        run = rng.choice(runs)
        clock[run] += rng.random() * 4
        rows.append(
            dict(
                run_id=run, seq=seq, domain=rng.choice(domains), elapsed_seconds=clock[run],
                error=rng.choice([None] * 9 + ["robots_denied", "timeout"]),
                http_status=rng.choice([200] * 8 + [403, 403, 429, None]),
                redirect_repeat=rng.random() < 0.05, size_exceeded=rng.random() < 0.05,
                content_length=rng.choice([0, 5, 500]),
                content_type=rng.choice(["text/html", "text/html", "application/pdf"]),
                captcha=rng.random() < 0.03, block=rng.random() < 0.03,
            )
        )
    return rows


def test_safety_stops_follow_the_loop(spark):
    rng = random.Random(3)
    for trial in range(3):
        limits = SafetyLimits(
            max_requests=rng.choice([8, 30, 200]), max_requests_per_domain=rng.choice([3, 6]),
            max_runtime_seconds=rng.choice([60, 10_000]), max_response_bytes=100,
        )
        rows = random_requests(rng, 150, domains="abcdefghijkl" if trial else "ab")
        df = spark.createDataFrame([tuple(r.values()) for r in rows], REQUEST)
        got = {r.seq: (r.verdict, r.allowed) for r in safety.safety_verdicts(df, limits).collect()}
        assert got == simulate(rows, limits)


def test_selection_stops_at_the_ceilings(spark):
    rng = random.Random(4)
    rows = [(rng.randint(1, 3), i, 4, rng.random() < 0.3) for i in range(120)]
    df = spark.createDataFrame(rows, "condition_id long, progress_id long, max_results long, counts_as_target boolean")
    before = spark.createDataFrame([(1, 5), (2, 0)], "condition_id long, excluded long")
    got = {r.progress_id for r in candidates.select_within_limits(df, before, 20, 3).collect()}
    expected, done, targets = set(), Counter({1: 5}), Counter()
    for condition, progress, most, target in rows:
        if done[condition] < 20 and targets[condition] < min(most, 3):
            expected.add(progress)
            done[condition] += 1
            targets[condition] += target
    assert got == expected


def test_discovery_keeps_rejects_found_at_the_cap(spark):
    rng = random.Random(5)
    rows = [(c, s, f"https://h{rng.randint(0, 25)}.jp/", rng.random() < 0.5) for c in (1, 2) for s in range(40)]
    df = spark.createDataFrame(rows, "condition_id long, discovery_seq long, url string, accepted boolean")
    got = [(r.condition_id, r.discovery_seq) for r in candidates.discover_candidates(df, 6).collect()]
    expected = []
    for condition in (1, 2):
        seen = set()
        for c, s, url, accepted in rows:
            if c != condition or url in seen:
                continue
            seen.add(url)
            expected.append((c, s))
            if accepted and len(seen) >= 6:
                break
    assert sorted(got) == expected


def test_first_provider_wins_ties_and_stops_last(spark):
    results = spark.createDataFrame(
        [
            ("q", "bing_rss", 1, 1, "x", "https://EXAMPLE.jp/", ""),
            ("q", "bing_html", 1, 1, "q", "https://example.jp", ""),
            ("q", "bing_html", 2, 2, "x", "ftp://example.jp", ""),
            ("q", "bing_html", 3, 3, "x", "https://b.jp/", ""),
        ],
        "query string, provider string, rank int, pos int, title string, url string, snippet string",
    )
    providers = (("bing_rss", True, 10), ("bing_html", True, 20))
    scored = search.score_results(results, providers)
    merged = search.merge_results(scored, ["query"], 10).orderBy("merged_rank").collect()
    assert [(r.url, r.provider, r.chain_score) for r in merged] == [
        ("https://example.jp", "bing_html", 144.0), ("https://b.jp/", "bing_html", 42.0)
    ]
    counts = {r.provider: (r.result_count, r.accepted_count, r.duplicate_count)
              for r in search.provider_counts(scored, ["query"]).collect()}
    assert counts == {"bing_rss": (1, 1, 0), "bing_html": (3, 1, 1)}
