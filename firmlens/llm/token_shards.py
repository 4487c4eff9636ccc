"""Token shards in training order: every sequence gets a global slot from a keyed permutation.

Documents become ids and an end id, cut into sequences of at most ``length`` ids. All sequences are numbered
0..N-1 in reading order; a keyed Feistel network over the next even power of two, walked along its cycle until
the value is below N, maps every number to its slot: a permutation that needs no sort and no table. A slot
belongs to shard ``slot // per_shard``; each shard is one partition, sorted by slot, written as records of one
fixed stride, so any step of a training run is found by arithmetic and a run can go on anywhere.

Record: ``length`` ids as little-endian unsigned 16 or 32 bits, padded with zeros, after an unsigned 32-bit count of
real ids.

How it scales: numbers follow from the count of sequences per input partition (two reads, as in a
distributed zip with index; the second read is checked against the first). Texts are encoded a few megabytes at a time, each
distinct piece of them once; the first read takes only the numbers of ids. Ids are shuffled once, straight to
their shard. A shard is written under a name of the attempt and then moved to its own name, so a lost or repeated
task leaves whole files only.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import model_file, written
from firmlens.llm.segments import in_chunks, ranks_memory
from firmlens.session import checkpoint_dir

#: Documents whose records are yielded together.
ROWS = 500

_RECORDS = "slot long, shard int, doc_id long, piece int, n_ids int, crc32 long, ids binary"
_INDEX = "slot long, shard int, record int, doc_id long, piece int, n_ids int, crc32 long"


def _mixed(values: np.ndarray, key: np.uint64) -> np.ndarray:
    values = (values ^ key) * np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def slots(numbers: np.ndarray, total: int, key: int, rounds: int = 6) -> np.ndarray:
    """Keyed permutation of 0..total-1, applied to ``numbers``."""
    half = max(1, ((max(total, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mixed(np.arange(1, rounds + 1, dtype=np.uint64), np.uint64(key & ((1 << 64) - 1)))

    def once(values: np.ndarray) -> np.ndarray:
        left, right = values >> shift, values & mask
        for own in keys:
            left, right = right, left ^ (_mixed(right, own) & mask)
        return (left << shift) | right

    out = once(np.asarray(numbers).astype(np.uint64))
    outside = np.flatnonzero(out >= np.uint64(total))
    while len(outside):  # cycle walking: fewer than four steps on average
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= np.uint64(total)]
    return out.astype(np.int64)


class _Sequences:
    """Ids of the documents of a task as sequences, with a fingerprint of what was read."""

    def __init__(self, model, pattern: str, end_id: int, length: int):
        self._model, self._pattern, self._end, self._length = model, pattern, end_id, length

    def _chunks(self, batches: Iterator[pa.RecordBatch]):
        memory = None
        for chunk in in_chunks(batches, 1):
            memory = memory or ranks_memory(self._model.value, self._pattern)
            yield chunk.column(0), chunk.column(1), memory

    def _pieces(self, sizes: np.ndarray) -> np.ndarray:
        return (sizes + self._length) // self._length

    @staticmethod
    def _print(docs: pa.Array, pieces: np.ndarray, before: int) -> int:
        known = docs.is_valid().to_numpy(zero_copy_only=False)
        numbers = docs.fill_null(0).to_numpy(zero_copy_only=False)
        return zlib.crc32(np.stack([numbers, known, pieces], axis=1).astype("<i8").tobytes(), before)

    def counts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, print_ = 0, 0
        for docs, texts, memory in self._chunks(batches):
            pieces = self._pieces(memory.sizes(texts))
            number += int(pieces.sum())
            print_ = self._print(docs, pieces, print_)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([{"part": part, "number": number, "print": print_}], schema=pa.schema([("part", pa.int32()), ("number", pa.int64()), ("print", pa.int64())]))

    def records(self, first: Broadcast, total: int, key: int, per_shard: int, kind: str):
        names = [part.split(" ")[0] for part in _RECORDS.split(", ")]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, expected, expected_print = first.value.get(TaskContext.get().partitionId(), (0, 0, 0))
            number, print_ = 0, 0
            for docs, texts, memory in self._chunks(batches):
                ids = memory(texts)
                print_ = self._print(docs, self._pieces(np.diff(ids.offsets)), print_)
                for low in range(0, len(docs), ROWS):
                    rows, bounds = [], ids.offsets[low : low + ROWS + 1].tolist()
                    for doc, start_at, stop in zip(docs[low : low + ROWS].to_pylist(), bounds[:-1], bounds[1:]):
                        own = np.append(ids.flat[start_at:stop], self._end).astype(kind)
                        for piece, at in enumerate(range(0, len(own), self._length)):
                            raw = own[at : at + self._length].tobytes()
                            rows.append((doc, piece, min(self._length, len(own) - at), zlib.crc32(raw), raw))
                    places = slots(np.arange(start + number, start + number + len(rows)), total, key)
                    number += len(rows)
                    columns = [places, (places // per_shard).astype(np.int32), *(zip(*rows) if rows else [[]] * 5)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
            if (number, print_) != (expected, expected_print):
                raise RuntimeError("the documents changed between the two reads")

        return make


class _Writer:
    """Writes one shard per partition; rows come sorted by slot."""

    def __init__(self, folder: str, length: int, width: int):
        self._folder, self._stride, self._width = folder, 4 + length * width, width

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self._folder if "://" in self._folder or self._folder.startswith("file:") else f"file://{self._folder}")
        stream, shard, at, temporary = None, None, 0, ""

        def close() -> None:
            if stream is not None:
                stream.close()
                system.move(temporary, f"{root}/{self._name(shard)}")

        for batch in batches:
            record_of = []
            for own, count, raw in zip(batch.column("shard").to_pylist(), batch.column("n_ids").to_pylist(), batch.column("ids").to_pylist()):
                if own != shard:
                    close()
                    shard, at = own, 0
                    system.create_dir(root, recursive=True)
                    temporary = f"{root}/_{self._name(own)}.{uuid.uuid4().hex}"
                    stream = system.open_output_stream(temporary)
                stream.write((np.array([count], "<u4").tobytes() + raw).ljust(self._stride, b"\0"))
                record_of.append(at)
                at += 1
            columns = {name: batch.column(name) for name in ("slot", "shard", "doc_id", "piece", "n_ids", "crc32")}
            columns["record"] = pa.array(record_of, pa.int32())
            names = [part.split(" ")[0] for part in _INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([columns[name] for name in names], names=names)
        close()

    @staticmethod
    def _name(shard: int) -> str:
        return f"shard-{shard:08d}.bin"


def write_shards(
    docs: DataFrame, ranks_path: str, pattern: str, end_id: int, folder: str | None = None, length: int = 512, per_shard: int = 32768,
    key: int = 20260101, width: int = 2, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Write the shards below ``folder`` (default: the shared folder) and return their index, one row per sequence:
    (slot, shard, record, doc_id, piece, n_ids, crc32 of the ids without padding).

    A null or empty text is the end id alone; null ids and repeated rows are sequences like any other;
    further columns are left out; an empty table writes nothing. ``docs`` must read the same rows in the same order
    twice, as files do; otherwise the job fails instead of losing a row. ``width`` is the bytes of an id.
    """
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    maker = _Sequences(model_file(spark, ranks_path), pattern, end_id, length)
    first, total = {}, 0
    counted = source.mapInArrow(maker.counts, "part int, number long, print long").collect()  # one row per input partition
    for row in sorted(counted, key=lambda row: row["part"]):
        first[row["part"]] = (total, row["number"], row["print"])
        total += row["number"]
    kind = "<u2" if width == 2 else "<u4"
    records = source.mapInArrow(maker.records(spark.sparkContext.broadcast(first), total, key, per_shard, kind), _RECORDS)
    shards = max(1, -(-total // per_shard))
    dealt = records.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    return written(dealt.mapInArrow(_Writer(folder, length, width), _INDEX))


def read_sequence(folder: str, slot: int, length: int = 512, per_shard: int = 32768, width: int = 2) -> np.ndarray:
    """The ids of one slot, straight from its place in its shard."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    stride = 4 + length * width
    with system.open_input_file(f"{root}/{_Writer._name(slot // per_shard)}") as stream:
        raw = stream.read_at(stride, slot % per_shard * stride)
    count = int(np.frombuffer(raw, "<u4", 1)[0])
    return np.frombuffer(raw, "<u2" if width == 2 else "<u4", count, 4)
