"""CSV files of any size as numbered records: splits are read side by side and quoted line ends may cross them.

Spark's text source reads the lines of every split as they are; the quote, comma and line-end bytes mean the same in UTF-8 and
CP932, so the structure is found before the charset is known. A first pass sums up each split twice, once as if it began
between records and once as if it began inside a quoted field: how many records begin in it, and whether it ends
inside quotes. Folding these sums over a file in order (one entry per split) gives where each split really begins and the number of
its first record; the same pass tells which charset decodes the whole file. The second pass cuts the records. One that
crosses splits leaves a fragment in each, and fragments of equal numbers are joined and cut again. Both passes write their
result, so headers and records do not read the files again.

Driver and tasks get the exceptions only: splits that begin inside quotes, and files that are not UTF-8.
"""

from __future__ import annotations

import codecs
import csv
import io
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.functions.text import py_strip
from firmlens.session import cut_lineage

_SUMS = "path string, start long, size long, held long, utf8 boolean, cp932 boolean, begun0 long, open0 boolean, begun1 long, open1 boolean"
_RECORDS = "path string, start long, at long, fields array<string>, fragment string"
#: Records sent together.
_ROWS = 4096


class _Records:
    """Records of consecutive lines; a record that is not closed at the end of the lines is marked."""

    def __init__(self, inside: bool):
        self._inside = inside
        self._held: list[str] = []
        self._ended = False

    def _lines(self, lines: Iterator[str]) -> Iterator[str]:
        first = self._inside
        for line in lines:
            for piece in io.StringIO(line, newline="") if "\r" in line else (line,):
                self._held.append(piece)
                yield '"' + piece if first else piece
                first = False
        self._ended = True

    def __call__(self, lines: Iterator[str]) -> Iterator[tuple[list[str], str, bool]]:
        """(fields, raw text, still open) of every record, blank ones included."""
        csv.field_size_limit(sys.maxsize)
        for fields in csv.reader(self._lines(lines)):
            raw = "".join(self._held)
            self._held.clear()
            yield fields, raw, self._ended


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, list[bytes]]]:
    """Path, start, file size and lines of every split of a task; splits come one after the other."""
    rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
    for (path, start, size), own in groupby(rows, key=lambda row: row[:3]):
        yield path, start, size, [row[3] for row in own]


def _unmarked(lines: list[bytes], start: int) -> list[bytes]:
    """The lines without a byte order mark at the beginning of the file."""
    marked = start == 0 and lines and lines[0].startswith(codecs.BOM_UTF8)
    return [lines[0][len(codecs.BOM_UTF8) :], *lines[1:]] if marked else lines


def _readable(lines: list[bytes], charset: str) -> bool:
    try:
        b"\n".join(lines).decode(charset)
    except UnicodeDecodeError:
        return False
    return True


def _begun(lines: list[bytes], start: int, inside: bool) -> tuple[int, bool]:
    """Records that begin in a split, and whether its end is inside quotes. A file's first record counts though it is blank."""
    begun, still = (-1 if inside else 0), inside
    for at, (fields, _, still) in enumerate(_Records(inside)(line.decode("latin-1") + "\n" for line in lines)):
        begun += bool(fields) or (at == 0 and start == 0)
    return begun, still


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(_SUMS)
    for path, start, size, given in _splits(batches):
        lines = _unmarked(given, start)
        utf8 = _readable(lines, "utf-8")
        outside = _begun(lines, start, False)
        inside = _begun(lines, start, True) if start else outside
        held = sum(map(len, lines)) + len(lines)
        row = (path, start, size, held, utf8, utf8 or _readable(lines, "cp932"), *outside, *inside)
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row))], schema=schema)


def _placed(sums: DataFrame) -> DataFrame:
    """The splits of every file in order: whether each begins inside quotes, the number of its first record, the charset."""
    splits = sums.groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("start", "begun0", "open0", "begun1", "open1"))).alias("_splits"),
        # The text source drops a byte order mark: the lines and their ends, the last one counted or not, are three bytes short.
        (F.sum("held") <= F.first("size") - 2).alias("_marked"), F.min("utf8").alias("_utf8"), F.min("cp932").alias("_cp932"),
    )
    begin = F.expr("named_struct('inside', false, 'first', 0L, 'placed', CAST(array() AS array<struct<start: bigint, inside: boolean, first: bigint>>))")

    def after(before: Column, split: Column) -> Column:
        inside = before["inside"]
        return F.struct(
            F.when(inside, split["open1"]).otherwise(split["open0"]).alias("inside"),
            (before["first"] + F.when(inside, split["begun1"]).otherwise(split["begun0"])).alias("first"),
            F.concat(before["placed"], F.array(F.struct(split["start"].alias("start"), inside.alias("inside"), before["first"].alias("first")))).alias("placed"),
        )

    utf8 = F.when(F.col("_marked"), "utf-8-sig").otherwise("utf-8")
    charset = F.when(F.col("_utf8"), utf8).when(~F.col("_marked") & F.col("_cp932"), "cp932")
    placed = F.aggregate("_splits", begin, after, lambda done: done["placed"])
    return splits.select("path", F.explode(placed).alias("s"), charset.alias("encoding")).select("path", "s.start", "s.inside", "s.first", "encoding")


class _Cut:
    """Second pass: records of every split by their place in it; -1 is the end of a record of an earlier split."""

    def __init__(self, inside: set[tuple[str, int]], charsets: dict[str, str | None]):
        self._inside, self._charsets = inside, charsets

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(_RECORDS)
        for path, start, _, given in _splits(batches):
            charset = self._charsets.get(path, "utf-8")
            if charset is None:
                continue
            inside = (path, start) in self._inside
            lines = _unmarked(given, start)
            at, out = (-1 if inside else 0), []
            for fields, raw, still in _Records(inside)(line.decode(charset) + "\n" for line in lines):
                if fields or (at == 0 and start == 0):
                    part = still or at < 0
                    out.append({"path": path, "start": start, "at": at, "fields": None if part else fields, "fragment": raw if part else None})
                    at += 1
                if len(out) >= _ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)


@dataclass(frozen=True)
class CsvFiles:
    """``headers`` has path, encoding (null: in no known charset) and the trimmed ``columns`` of every file; ``records`` has path,
    ``row_number`` (the header is 1, blank lines are not counted) and ``fields``."""

    headers: DataFrame
    records: DataFrame

    def rows(self, headers: DataFrame) -> DataFrame:
        """Records below the header of the given files as ``cells`` by column name.

        Cells are trimmed, missing ones empty; the last column of a name wins; records without any text are left out.
        """
        keys = headers.select("path", "encoding", F.col("columns").alias("_names")).withColumn("_keys", F.array_distinct("_names"))
        slots = F.transform("_keys", lambda name: (F.size("_names") - F.array_position(F.reverse("_names"), name)).cast("int"))
        named = keys.select("path", "encoding", "_keys", slots.alias("_slots"))
        cells = F.transform("_slots", lambda at: py_strip(F.coalesce(F.get(F.col("fields"), at), F.lit(""))))
        # A generated column is computed once a record; a projected one is put into every condition on a cell anew.
        filled = (
            self.records.where("row_number > 1").join(named, "path")
            .select("path", "encoding", "row_number", "_keys", F.explode(F.array(cells)).alias("_cells")).where(F.exists("_cells", lambda cell: cell != ""))
        )
        maps = F.explode(F.array(F.map_from_arrays("_keys", "_cells")))
        return filled.select("path", "encoding", "row_number", maps.alias("cells"))


def _recut() -> Column:
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([next((fields for fields, _, _ in _Records(False)(iter([text]))), []) for text in texts])

    return cut(F.col("_text"))


def read_csv_files(spark: SparkSession, path: str) -> CsvFiles:
    """Headers and numbered records of the CSV files under a path, as a reader of whole texts would number them.

    A file is UTF-8 with or without a byte order mark, else CP932, decided over all of it. Quotes count at the start of a field and
    may hold line ends; an open quote runs to the end of the file. A task holds one split
    (``spark.sql.files.maxPartitionBytes``) and whole records; a file whose lines end in bare carriage returns is one
    split. Files of no bytes have no row,
    since Spark's sources do not list them.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line")
    )
    sums = lines.mapInArrow(_summed, _SUMS)
    places = cut_lineage(_placed(sums))
    inside = {(row.path, row.start) for row in places.where("inside").select("path", "start").collect()}
    others = places.where("encoding is null or encoding = 'cp932'").select("path", "encoding").distinct().collect()
    cut = cut_lineage(lines.mapInArrow(_Cut(inside, {row.path: row.encoding for row in others}), _RECORDS))
    numbered = cut.join(places.select("path", "start", "first"), ["path", "start"]).withColumn("row_number", F.expr("first + at + 1"))
    whole = numbered.where("fragment is null").select("path", "row_number", "fields")
    parts = numbered.where("fragment is not null").groupBy("path", "row_number").agg(
        F.array_sort(F.collect_list(F.struct("start", "fragment"))).alias("_parts")
    )
    joined = parts.withColumn("_text", F.array_join("_parts.fragment", "")).select("path", "row_number", _recut().alias("fields"))
    records = whole.unionByName(joined)
    found = records.where("row_number = 1").select("path", F.transform("fields", py_strip).alias("_columns"))
    headers = (
        places.select("path", "encoding").distinct().join(found, "path", "left")
        .select("path", "encoding", F.coalesce("_columns", F.array().cast("array<string>")).alias("columns"))
    )
    return CsvFiles(headers, records)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split(" ") for part in ddl.split(", "))])
