"""First sightings over restarts, retried batches and forgotten urls."""

import random
import shutil
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from firmlens.streaming import ingest, sightings

ROWS = "url string, seq long, note string"


class Stream:
    """A source folder, and the sightings written from it by one run after another."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        self.out, self.state = str(folder / "out"), str(folder / "state")

    def arrive(self, rows):
        self.spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))

    def start(self, **options):
        urls = self.spark.readStream.schema(ROWS).parquet(str(self.folder / "in"))
        return ingest.once_ever_stream(urls, self.out, self.state, F.col("seq"), **options)

    def run(self):
        query = self.start(once=True)
        query.awaitTermination()
        return query

    def rows(self):
        return sorted((r.url, r.seq, r.note) for r in self.spark.read.parquet(self.out).collect())


@pytest.fixture
def stream(spark, tmp_path):
    return Stream(spark, tmp_path)


def test_restarts_remember_without_reading_earlier_batches(stream):
    rnd = random.Random(1)
    rows = [(f"u{rnd.randrange(60)}", seq, "hot") for seq in range(400)] + [(None, 1, "none")]
    first = {}
    for url, seq, note in rows:
        if url is not None:
            first.setdefault(url, (url, seq, note))
    found = []
    for start in range(0, len(rows), 100):
        part = rows[start : start + 100]
        rnd.shuffle(part)
        stream.arrive(part)
        query = stream.run()
        found += stream.rows()
        shutil.rmtree(stream.out)  # what was written is not what is remembered
        stream.spark.createDataFrame([], ROWS).write.parquet(stream.out)
    assert sorted(found) == sorted(first.values())
    assert sightings.state_size(query)[0] in (0, len(first))
    assert sightings.remembered(stream.spark, stream.state) == len(first)


def test_a_batch_that_runs_again_writes_the_same_rows(stream, tmp_path):
    stream.arrive([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")])
    stream.run()
    stream.arrive([("a", 9, "x"), ("c", 4, "z"), ("c", 4, "z")])
    stream.run()
    before = stream.rows()
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    crc = commits[-1].with_name(f".{commits[-1].name}.crc")
    if crc.exists():
        crc.unlink()
    stream.run()
    assert before == [("a", 1, "y"), ("b", 3, "z"), ("c", 4, "z")] == stream.rows()


def test_forgotten_urls_are_seen_again(stream):
    def wait(seqs):
        until = time.time() + 40
        while time.time() < until:
            try:
                if [seq for _, seq, _ in stream.rows()] == seqs:
                    return True
            except Exception:  # a folder that is being written
                pass
            time.sleep(0.5)
        return False

    stream.arrive([("a", 1, "x")])
    with pytest.raises(ValueError):
        stream.start(forget_after=1, once=True)
    query = stream.start(forget_after=1)
    try:
        assert wait([1])
        time.sleep(3)
        stream.arrive([("a", 2, "x")])
        assert wait([1, 2])
    finally:
        query.stop()


def test_tasks_send_one_row_per_url():
    def batch(rows):
        return pa.RecordBatch.from_pylist([{"url": u, "_order": o, "_key": u} for u, o in rows])

    rows = [("hot", k) for k in range(200_000, 0, -1)] + [(f"u{k}", 0) for k in range(1000)]
    batches = [batch(rows[start : start + 10_000]) for start in range(0, len(rows), 10_000)]
    sent = [r for out in sightings._first_in_task(iter(batches)) for r in out.to_pylist()]
    assert len(sent) == 1001 and min(r["_order"] for r in sent if r["url"] == "hot") == 1
    assert list(sightings._first_in_task(iter([]))) == []
