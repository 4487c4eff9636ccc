"""Packing documents into sequences by non-negative least squares over their lengths.

Every document is cut into full windows and one rest. Full windows are sequences of their own. For the rests,
shallow combinations (two to six lengths that fill a window) are enumerated, and repeat counts x >= 0 are
solved so that the lengths they use come as near to the histogram of rests as can be; rounded down to what is
there, they are exact fills without any cut. Rests left over are packed greedily: longest first, each where the one
before ends, and one that crosses the end of its sequence is cut there. So a rest is cut once at most, a sequence begins
and ends inside at most two rests, and only the last sequence has padding.

How it scales: the plan sees the histogram only (at most ``window`` - 1 lengths). A document's place follows
from its number among the rests of its length: a number counted inside its task plus the count of earlier tasks, which is
joined by task and length, so nothing is sorted and a length or text that a third of all documents have is no hot key.
Texts are read once; the ids of rests are kept in the written table, two bytes each, for the checksums of cut ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmlens.llm.common import drop, model_file, written
from firmlens.llm.segments import PieceTable, in_chunks, library_memory

#: Lengths in a combination at most, and pairs of lengths kept per sum as its building stones.
DEPTH = 6
PAIRS = 6
#: Rounds of the solver, and enumerations over what is left.
ROUNDS = 120
ENUMERATIONS = 4

#: Documents whose lengths are yielded together.
ROWS = 500

_LENGTHS = "doc_id long, tokens long, full array<long>, rest int, rest_crc long, ids binary, part int, near long, full_near long"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _memory(model: bytes) -> PieceTable:
    return library_memory(model, fold=True)


class _Lengths:
    """Every document's number of ids, checksums of its full windows, its rest, and its numbers inside the task."""

    def __init__(self, model, end_id: int, window: int, memory: Callable[[bytes], PieceTable]):
        self._model, self._end, self._window, self._memory = model, end_id, window, memory

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split(" ")[0] for part in _LENGTHS.split(", ")][1:]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64())
        memory, task = None, TaskContext.get().partitionId()
        rests, fulls = np.zeros(self._window, dtype=np.int64), 0
        for chunk in in_chunks(batches, 1):
            memory = memory or self._memory(self._model.value)
            ids = memory(chunk.column(1))
            flat = ids.flat.astype(np.uint32)
            for low in range(0, chunk.num_rows, ROWS):
                rows, bounds = [], ids.offsets[low : low + ROWS + 1].tolist()
                for start, stop in zip(bounds[:-1], bounds[1:]):
                    row = self._row(flat[start:stop])
                    rows.append((*row, task, int(rests[row[2]]), fulls))
                    rests[row[2]] += 1
                    fulls += len(row[1])
                columns = (pa.array(column, kind) for column, kind in zip(zip(*rows), kinds))
                yield pa.RecordBatch.from_arrays([chunk.column(0).slice(low, ROWS), *columns], names=["doc_id", *names])

    def _row(self, own: np.ndarray) -> tuple:
        ids = np.append(own, np.uint32(self._end)).astype("<u4")
        cut = len(ids) // self._window * self._window
        full = [zlib.crc32(ids[a : a + self._window]) for a in range(0, cut, self._window)]
        rest = ids[cut:]
        short = not len(rest) or rest.max() < 1 << 16
        return len(ids), full, len(rest), zlib.crc32(rest), (rest.astype("<u2") if short else rest).tobytes()


def _unsigned(raw: bytes, count: int) -> np.ndarray:
    """The ``count`` ids in ``raw``, which have two or four bytes each."""
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * count else "<u4").astype("<u4")


def _best_pairs(have: np.ndarray, window: int) -> dict[int, np.ndarray]:
    """For every sum up to the window, the pairs (a >= b) of present lengths that the most rests could use."""
    best = {}
    for total in range(2, window + 1):
        small = np.arange(max(1, total - len(have) + 1), total // 2 + 1)
        weight = np.minimum(have[small], have[total - small])
        weight = np.where(small * 2 == total, have[small] // 2, weight)
        top = np.argsort(-weight, kind="stable")[:PAIRS]
        top = top[weight[top] > 0]
        if len(top):
            best[total] = np.stack([total - small[top], small[top]], axis=1)
    return best


def combinations(have: np.ndarray, window: int) -> np.ndarray:
    """Combinations of two to six present lengths that fill the window, one row each, padded with 0."""
    pairs = _best_pairs(have, window)
    nothing = np.zeros((0, 2), dtype=np.int64)
    present = np.flatnonzero(have > 0)
    rows: list[np.ndarray] = []

    def take(*parts: np.ndarray) -> None:
        rows.append(np.concatenate([*parts, np.zeros(DEPTH - sum(map(len, parts)), dtype=np.int64)]))

    for pair in pairs.get(window, nothing):
        take(pair)
    for first in present[present < window]:
        for pair in pairs.get(window - int(first), nothing):
            take([first], pair)
        for share in (0.35, 0.5):
            total = int((window - int(first)) * share)
            for one in pairs.get(total, nothing)[:2]:
                for two in pairs.get(window - int(first) - total, nothing)[:2]:
                    take([first], one, two)
    for total in range(2, window // 2 + 1):
        for one in pairs.get(total, nothing)[:3]:
            for two in pairs.get(window - total, nothing)[:3]:
                take(one, two)
    for total in range(2, window // 3 + 1):
        middle = (window - total) // 2
        for one in pairs.get(total, nothing)[:2]:
            for two in pairs.get(middle, nothing)[:2]:
                for three in pairs.get(window - total - middle, nothing)[:2]:
                    take(one, two, three)
    if not rows:
        return np.zeros((0, DEPTH), dtype=np.int64)
    return np.unique(-np.sort(-np.array(rows, dtype=np.int64), axis=1), axis=0)


def repeat_counts(found: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares: x >= 0 that brings the used lengths nearest to ``counts`` (accelerated
    projected gradient steps)."""
    if len(found) == 0:
        return np.zeros(0)
    target = counts.astype(float)
    target[0] = 0.0
    slots, width = found.ravel(), found.shape[1]

    def used(x: np.ndarray) -> np.ndarray:
        sums = np.bincount(slots, weights=np.repeat(x, width), minlength=len(counts))
        sums[0] = 0.0
        return sums

    def gathered(residual: np.ndarray) -> np.ndarray:
        return residual[slots].reshape(-1, width).sum(axis=1)

    vector = np.ones(len(found))
    for _ in range(20):  # largest eigenvalue of the normal matrix
        vector = gathered(used(vector))
        vector /= np.linalg.norm(vector)
    step = 1.0 / max(float(vector @ gathered(used(vector))) * 1.05, 1e-9)
    x = ahead = np.zeros(len(found))
    pace = 1.0
    for _ in range(rounds):
        moved = np.maximum(0.0, ahead - step * gathered(used(ahead) - target))
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = moved + (pace - 1) / faster * (moved - x)
        x, pace = moved, faster
    return x


def filled(counts: np.ndarray, window: int) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """Combinations with their whole repeat counts, and the rests that none of them uses.

    The solution is rounded down, then what still fits is added; combinations are enumerated anew over what
    is left while that covers more.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    chosen: list[tuple[np.ndarray, int]] = []
    for _ in range(ENUMERATIONS):
        before = left.sum()
        found = combinations(left, window)
        wished = repeat_counts(found, left)
        order = np.argsort(-wished, kind="stable")
        for share in (np.floor(wished + 1e-6), np.full(len(found), left.max(initial=0))):
            for row in order[share[order] > 0]:
                lengths = found[row][found[row] > 0]
                own = left[lengths]
                if own.min() == 0:
                    continue
                distinct, needed = np.unique(lengths, return_counts=True)
                times = int(min((left[distinct] // needed).min(), share[row]))
                if times > 0:
                    left[distinct] -= times * needed
                    chosen.append((lengths, times))
        if left.sum() > 0.99 * before:
            break
    return chosen, left


class Plan:
    """What becomes of the rests of each length: slots of exact fills first, then pieces of the residual line."""

    def __init__(self, counts: np.ndarray, window: int):
        chosen, left = filled(counts, window)
        slots: list[list[tuple[int, int, int]]] = [[] for _ in range(len(counts))]
        taken = np.zeros(len(counts), dtype=np.int64)
        sequence = 0
        for lengths, times in chosen:
            offset = 0
            for length in lengths.tolist():
                slots[length].append((int(taken[length]), sequence, offset))
                taken[length] += times
                offset += length
            sequence += times
        self.exact_sequences = sequence
        self._covered = taken
        self._slots = [np.array(rows, dtype=np.int64).reshape(-1, 3) for rows in slots]
        ahead = np.cumsum((left * np.arange(len(counts)))[::-1])[::-1]  # ids of rests of this length or longer
        self._line = np.append(ahead[1:], 0)
        self._window = window
        self.line_sequences = -(-int(ahead[0]) // window)

    def pieces(self, length: int, number: int) -> list[tuple[int, int, int, int]]:
        """(start in the rest, length, sequence, offset) of the rest with this number among those of its length."""
        if number < self._covered[length]:
            rows = self._slots[length]
            first, sequence, offset = rows[np.searchsorted(rows[:, 0], number, side="right") - 1]
            return [(0, length, int(sequence + number - first), int(offset))]
        place = int(self._line[length]) + (number - int(self._covered[length])) * length
        sequence, offset = self.exact_sequences + place // self._window, place % self._window
        head = min(length, self._window - offset)
        first = (0, head, sequence, offset)
        return [first] if head == length else [first, (head, length - head, sequence + 1, 0)]


class _Place:
    def __init__(self, plan: Plan, window: int):
        self._plan, self._window = plan, window

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = self._plan.exact_sequences + self._plan.line_sequences
        names = [part.split(" ")[0] for part in _PIECES.split(", ")]
        for batch in batches:
            rows = []
            for doc in batch.to_pylist():
                for at, crc in enumerate(doc["full"]):
                    rows.append((doc["doc_id"], at * self._window, self._window, crc, doc["tokens"], base + doc["full_before"] + at, 0))
                if doc["rest"] == 0:
                    continue
                start = len(doc["full"]) * self._window
                pieces = self._plan.pieces(doc["rest"], doc["number"])
                ids = _unsigned(doc["ids"], doc["rest"]) if len(pieces) > 1 else None
                for at, length, sequence, offset in pieces:
                    crc = doc["rest_crc"] if ids is None else zlib.crc32(ids[at : at + length])
                    rows.append((doc["doc_id"], start + at, length, crc, doc["tokens"], sequence, offset))
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in columns], names=names)


def _numbered(lengths: DataFrame) -> DataFrame:
    """Adds ``number`` (among rests of that length) and ``full_before`` (full windows of earlier documents)."""
    counted = written(lengths.groupBy("part", "rest").agg(F.count("*").alias("many"), F.sum(F.size("full")).alias("fulls")))
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rests = counted.select("part", "rest", F.coalesce(F.sum("many").over(earlier), F.lit(0)).alias("rests_before"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    fulls = counted.groupBy("part").agg(F.sum("fulls").alias("fulls")).select(
        "part", F.coalesce(F.sum("fulls").over(before), F.lit(0)).alias("fulls_before")
    )
    return lengths.join(rests.join(fulls, "part"), ["part", "rest"]).select(
        "doc_id", "tokens", "full", "rest", "rest_crc", "ids",
        (F.col("near") + F.col("rests_before")).alias("number"), (F.col("full_near") + F.col("fulls_before")).alias("full_before"),
    )


def pack(docs: DataFrame, model_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its ids (no special tokens added) and ``end_id``. The tokenizer must drop white space and letter case. A null or empty text is ``end_id`` alone.
    Repeated rows are packed once each, a null id like any other; further columns are left out. An empty
    table gives no rows. All sequences are full but for one; their numbers are dense from 0.
    """
    if window < 2:
        raise ValueError("the window must hold two ids or more")
    model = model_file(docs.sparkSession, model_path)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lengths = written(source.mapInArrow(_Lengths(model, end_id, window, _memory), _LENGTHS))
    counts = np.zeros(window, dtype=np.int64)
    for row in lengths.groupBy("rest").count().collect():  # at most ``window`` rows
        counts[row["rest"]] = row["count"]
    out = written(_numbered(lengths).mapInArrow(_Place(Plan(counts, window), window), _PIECES))
    drop(lengths)
    return out
