from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from firmlens.functions import urls

CASES = [
    "https://Example.JP/", "https://example.jp", "HTTP://example.jp:80/a/", "https://example.jp:443/a?b=1#c",
    "https://user:pw@example.jp:8443/x//", "https://example.jp:0443/", "https://example.jp:99999/",
    "https://example.jp:port/", "ftp://example.jp/", "/relative", "", "   https://example.jp/a b  ",
    "https://[2001:DB8::1]:8080/x", "//cdn.example/x", "https://日本.example/店?q=値", "https://a@b@c.jp/p",
    "mailto:x@y.jp", "https:///nohost", "https://example.jp?x=1", "https://example.jp#top",
    "https://example.jp:/p", "http://example.jp:443/",
]


def expected_search_key(url):
    try:
        parts = urlsplit(url.strip())
        port = parts.port
    except ValueError:
        return ""
    if parts.scheme not in ("http", "https") or not parts.hostname:
        return ""
    standard = {"http": 80, "https": 443}[parts.scheme]
    netloc = parts.hostname if port in (None, standard) else f"{parts.hostname}:{port}"
    query = f"?{parts.query}" if parts.query else ""
    return f"{parts.scheme}://{netloc}{parts.path.rstrip('/') or '/'}{query}"


def expected_work_key(url):
    try:
        parts = urlsplit(url.strip())
        port = parts.port
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not parts.hostname:
        return None
    netloc = parts.hostname if port is None else f"{parts.hostname}:{port}"
    query = f"?{parts.query}" if parts.query else ""
    return f"{parts.scheme}://{netloc}{parts.path or '/'}{query}"


def expected_entity_key(url):
    parts = urlsplit(url.strip())
    return (parts.hostname or "") + (parts.path.rstrip("/") or "/")


@pytest.mark.parametrize(
    ("function", "expected"),
    [
        (urls.normalize_search_url, expected_search_key),
        (urls.task_key, expected_work_key),
        (urls.export_url_key, expected_entity_key),
    ],
)
def test_keys_agree_with_the_standard_splitter(spark, function, expected):
    rows = spark.createDataFrame([(case,) for case in CASES], "url string")
    got = {row.url: row.key for row in rows.select("url", function(F.col("url")).alias("key")).collect()}
    assert got == {case: expected(case) for case in CASES}


def test_origins_differ_in_the_port(spark):
    rows = spark.createDataFrame([("https://A.jp:8443/x",), ("https://a.jp:443/x",), ("x",)], "url string")
    got = rows.select(urls.pause_origin(F.col("url")), urls.fetch_origin(F.col("url"))).collect()
    assert [tuple(row) for row in got] == [
        ("https://a.jp", "https://a.jp:8443"), ("https://a.jp", "https://a.jp"), (None, None)
    ]
