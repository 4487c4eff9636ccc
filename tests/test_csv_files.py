"""CSV files over many splits against a reader of the whole text."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from firmlens.sources.csv_files import read_csv_files


def plain(content):
    """Header, and non-blank records with their numbers, of a whole text."""
    for charset in ("utf-8-sig",) if content.startswith(b"\xef\xbb\xbf") else ("utf-8", "cp932"):
        try:
            text = content.decode(charset)
            break
        except UnicodeDecodeError:
            continue
    else:
        return None, [], []
    rows = list(csv.reader(io.StringIO(text + ("" if text.endswith("\n") or not text else "\n"), newline="")))
    head = [name.strip() for name in rows[0]] if rows else []
    return charset, head, [(at + 2, row) for at, row in enumerate(row for row in rows[1:] if row)]


def read(spark, folder):
    files = read_csv_files(spark, str(folder))
    heads = {r.path.rsplit("/", 1)[-1]: (r.encoding, r.columns) for r in files.headers.collect()}
    rows = {name: [] for name in heads}
    for r in files.records.where("row_number > 1").orderBy("row_number").collect():
        rows[r.path.rsplit("/", 1)[-1]].append((r.row_number, r.fields))
    return heads, rows


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    for key, value in zip(keys, ("301", "0", "16")):
        spark.conf.set(key, value)
    yield
    for key in keys:
        spark.conf.unset(key)


def made(seed):
    rnd = random.Random(seed)
    cells = ["", "a", " b ", 'x "y" z', '"q"', '"two\nlines"', '"cr\r\nlf, and ""quotes"""', "東京都", '"' + "長い\n" * 60 + '"', "ends\r"]
    if seed % 3 == 0:
        cells = [cell.replace("\r", "") for cell in cells]
    lines = [",".join(rnd.choices(cells, k=rnd.randint(0, 4))) for _ in range(60)]
    end = rnd.choice(["\n", "\r\n"])
    return "名前, b ," + end + end.join(lines) + rnd.choice(["", end, end + '"open to\nthe end'])


def test_records_match_a_reader_of_whole_texts(spark, tmp_path, small_splits):
    contents = {f"f{seed}.csv": made(seed).encode("cp932" if seed % 4 == 1 else "utf-8-sig" if seed % 4 == 2 else "utf-8") for seed in range(6)}
    contents |= {"blank.csv": b"\na,b\n1,2\n", "bad.csv": b"a\n\xff\xfe\x81" * 60, "marked.csv": b"\xef\xbb\xbf\"a\",b\n\n1,2\n\n3,4"}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    heads, rows = read(spark, tmp_path)
    splits = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    assert splits > 15
    for name, content in contents.items():
        charset, head, records = plain(content)
        if charset is None:
            assert heads[name] == (None, []) and rows[name] == []
        else:
            trimmed = [(at, [cell.strip() for cell in row]) for at, row in records]
            assert heads[name] == (charset, head), name
            assert [(at, [cell.strip() for cell in row]) for at, row in rows[name]] == trimmed, name


def test_cells_are_computed_once_a_record(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes(b"a, b ,b\n 1 ,2, 3\n,,\n4\n")
    files = read_csv_files(spark, str(tmp_path))
    rows = files.rows(files.headers).withColumns({name: F.try_element_at("cells", F.lit(name)) for name in "ab"})
    kept = rows.where("a <> 'x' and b <> 'x'").select("row_number", "a", "b")
    assert [tuple(r) for r in kept.orderBy("row_number").collect()] == [(2, "1", "3"), (4, "4", "")]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("array_position(") == 1
