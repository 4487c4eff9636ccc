"""Versions of a folder, and upserts that rewrite the changed buckets only."""

import pytest
from pyspark.sql import functions as F

from firmlens.operators import stores
from firmlens.sinks import manifest
from firmlens.sinks.bucket_table import BucketTable

PAGES = "page_id long, url string, processing_status string, fetched_at string, updated_at string"


def pages(spark, ids, status, day):
    return spark.createDataFrame([(i, f"https://h{i}.jp/", status, day, day) for i in ids], PAGES)


def files(folder):
    return {str(path.relative_to(folder)) for path in folder.rglob("*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    schema = pages(spark, [1], "x", "d").schema
    return BucketTable(spark, str(tmp_path / "pages"), schema, "url", 32)


def test_an_upsert_rewrites_its_buckets_only(spark, table, tmp_path):
    assert table.read().collect() == []
    assert table.upsert(pages(spark, range(300), "success", "d1"), stores.upsert_pages).number == 1
    before, first = files(tmp_path / "pages"), table.folders()
    assert table.upsert(pages(spark, [7, 8, 900], "again", "d2"), stores.upsert_pages).number == 2
    touched = {b for b, path in table.folders().items() if first.get(b) != path}
    assert 1 <= len(touched) <= 3
    new = files(tmp_path / "pages") - before
    assert {int(name.split("_bucket=")[1].split("/")[0]) for name in new} == touched
    assert before <= files(tmp_path / "pages")  # the old version is whole until it is forgotten
    rows = {r.page_id: tuple(r)[2:] for r in table.read().collect()}
    assert len(rows) == 301 and rows[7] == ("again", "d1", "d2") and rows[900] == ("again", "d2", "d2") and rows[6] == ("success", "d1", "d1")
    assert table.read(1).count() == 300 and table.read(1).where("processing_status = 'again'").count() == 0
    manifest.forget(spark, str(tmp_path / "pages"), keep=1)
    assert table.read().count() == 301 and len(files(tmp_path / "pages")) < len(before | new)


def test_other_merges_and_empty_changes(spark, table):
    table.upsert(pages(spark, range(20), "success", "d1"), stores.upsert_pages)
    rejected = spark.createDataFrame([("https://h3.jp/", "portal", 1), ("https://new.jp/", "news", 2)], "url string, reject_reason string, seq long")
    excluded = rejected.select("url", "reject_reason", "seq")
    table.upsert(excluded, lambda known, new: stores.save_prefetch_exclusions(known.withColumn("fetch_error", F.lit(None).cast("string")), new, F.lit("d9")))
    assert {r.url for r in table.read().where("processing_status = 'excluded'").collect()} == {"https://h3.jp/", "https://new.jp/"}
    number = manifest.current(spark, table._folder).number
    assert table.upsert(pages(spark, [], "x", "d"), stores.upsert_pages).number == number
    gone = table.upsert(pages(spark, [5], "x", "d"), lambda known, new: known.join(new.select("url"), "url", "left_anti"))
    assert gone.number == number + 1 and table.read().where("page_id = 5").count() == 0 and table.read().count() == 20


def test_the_later_of_two_writers_fails(spark, table):
    table.upsert(pages(spark, range(5), "success", "d1"), stores.upsert_pages)

    def slow(known, new):
        table.upsert(pages(spark, [1], "first", "d2"), stores.upsert_pages)
        return stores.upsert_pages(known, new)

    with pytest.raises(manifest.VersionConflict):
        table.upsert(pages(spark, [1], "second", "d3"), slow)
    assert [r.processing_status for r in table.read().where("page_id = 1").collect()] == ["first"]


def test_a_writer_that_dies_changes_nothing(spark, table):
    table.upsert(pages(spark, range(5), "success", "d1"), stores.upsert_pages)

    def killed(known, new):
        return stores.upsert_pages(known, new).withColumn("updated_at", F.raise_error(F.lit("killed")))

    with pytest.raises(Exception, match="killed"):
        table.upsert(pages(spark, [1], "second", "d3"), killed)
    assert table.read().count() == 5 and table.read().where("processing_status = 'second'").count() == 0
