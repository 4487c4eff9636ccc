"""Hard negatives from rotated one-bit codes: interval bounds from bit counts, then integer scores.

Method: a vector's components become integers; the score of two vectors is their integer inner product. All vectors are turned
by one fixed rotation and kept as the signs of their components (one bit each), with the alignment between vector
and code (their inner product) and the length of the rest, which is perpendicular to the code. An anchor is
quantised to ``PLANES`` bit planes; counting common bits of planes and code estimates the inner product of anchor and
code. With Cauchy-Schwarz on the anchor's quantisation error and on both perpendicular rests this gives an interval that
always holds the score (rounding is covered by a slack). Only vectors whose interval can still reach the first places, or
the window of allowed negative scores, are scored, in integers; so the result is exact whatever the intervals let through.

How it scales: anchors are a stated query set and meet all rows in blocks. Rows are cut into blocks of at most
``ROWS`` and anchors into blocks of at most ``ANCHORS`` by hashes of their row numbers, so a hot label, equal vectors or equal
ids change nothing; a task holds one block of each and a bounded part of their matrix. Every cell sends at most the first
few per anchor, and Spark merges them with windows limited before the exchange. Work is anchors times rows, as an exact answer
to any window of scores needs; the codes make a pair cost a few bit counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.llm.common import drop, written

#: Bit planes of an anchor.
PLANES = 4
#: Largest blocks of rows and of anchors, and rows per block below which a small table is not cut further.
ROWS = 1 << 16
ANCHORS = 1 << 14
_FEW = 1024
#: Entries of the matrix of intervals held at once.
_CELL = 1 << 18
#: Pairs scored at once.
_PAIRS = 1 << 13
#: Share of the product of lengths by which every interval is widened, for rounding.
_SLACK = 1e-9
_CODED = "row long, id long, label long, anchor boolean, ints binary, code binary, length double, aligned double, rest double"


def rotation(width: int) -> np.ndarray:
    """A fixed random rotation of that many dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(width).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


class _Codes:
    """Rows (row, id, label, anchor, ints array) with code, length, alignment and length of the rest."""

    def __init__(self, width: int):
        self._width = width

    def __call__(self, batches):
        turned_by = rotation(self._width)
        for batch in batches:
            if not batch.num_rows:
                continue
            ints = np.zeros((batch.num_rows, self._width), dtype=np.int64)
            for at, values in enumerate(batch.column("ints").to_pylist()):
                ints[at, : len(values)] = values
            turned = ints.astype(np.float64) @ turned_by
            aligned = np.abs(turned).sum(axis=1) / np.sqrt(self._width)
            length = np.linalg.norm(turned, axis=1)
            rest = np.sqrt(np.maximum(0.0, length**2 - aligned**2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in ("row", "id", "label", "anchor")]
                + [pa.array([v.tobytes() for v in ints], pa.binary()), pa.array([v.tobytes() for v in _packed(turned > 0)], pa.binary())]
                + [pa.array(v) for v in (length, aligned, rest)],
                names=[part.split(" ")[0] for part in _CODED.split(", ")],
            )


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits of every row in 64-bit words."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), dtype=bool)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1).view(np.uint64)


class _Block:
    """Columns of a block as arrays."""

    def __init__(self, table: pa.Table):
        self.row, self.id, self.label = (table.column(name).to_numpy() for name in ("row", "id", "label"))
        self.length, self.aligned, self.rest = (table.column(name).to_numpy() for name in ("length", "aligned", "rest"))
        count = max(1, table.num_rows)
        self.ints = np.frombuffer(b"".join(table.column("ints").to_pylist()), np.int64).reshape(count, -1)
        self.code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint64).reshape(count, -1)


def intervals(anchors: np.ndarray, block: _Block) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (low, high) of the scores of integer anchors with the rows of a block, from the rows' codes alone."""
    width = anchors.shape[1]
    turned = anchors.astype(np.float64) @ rotation(width)
    floor = turned.min(axis=1, keepdims=True)
    step = (turned.max(axis=1, keepdims=True) - floor) / ((1 << PLANES) - 1)
    step[step == 0] = 1.0
    units = np.rint((turned - floor) / step).astype(np.int64)
    error = np.linalg.norm(turned - (floor + step * units), axis=1, keepdims=True)
    common = np.zeros((len(anchors), len(block.row)), dtype=np.int32)
    for plane in range(PLANES):
        bits = _packed((units >> plane) & 1 == 1)
        for word in range(bits.shape[1]):
            common += np.bitwise_count(bits[:, word, None] & block.code[None, :, word]).astype(np.int32) << plane
    ones = np.bitwise_count(block.code).sum(axis=1, dtype=np.int64)[None, :]
    on_code = (2 * floor * ones + 2 * step * common - floor * width - step * units.sum(axis=1, keepdims=True)) / np.sqrt(width)
    length = np.linalg.norm(turned, axis=1, keepdims=True)
    beside = np.sqrt(np.maximum(0.0, length**2 - np.maximum(0.0, np.abs(on_code) - error) ** 2))
    spread = block.aligned * error + block.rest * beside + _SLACK * (1.0 + length) * (1.0 + block.length)
    middle = block.aligned * on_code
    return middle - spread, middle + spread


def integer_scores(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of ``left[a[i]]`` and ``right[b[i]]``; beyond 64 bits they stop at its ends."""
    out = np.empty(len(a), dtype=np.int64)
    if not len(a):
        return out
    x, y = left.astype(np.float64), right.astype(np.float64)
    if float(np.abs(x).max()) * float(np.abs(y).max()) * left.shape[1] < 2.0**53:
        for low in range(0, len(a), _PAIRS):
            part = slice(low, low + _PAIRS)
            out[part] = np.einsum("ij,ij->i", x[a[part]], y[b[part]])
        return out
    ends = np.iinfo(np.int64)
    for at, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        out[at] = min(max(sum(map(int.__mul__, left[i].tolist(), right[j].tolist())), ends.min), ends.max)
    return out


def _reach(low: np.ndarray, sure: np.ndarray, count: int) -> np.ndarray:
    """Per anchor a score that ``count`` of the sure rows surely have; minus infinity where there are fewer."""
    if low.shape[1] < count:
        return np.full((len(low), 1), -np.inf)
    held = np.where(sure, low, -np.inf)
    return -np.partition(-held, count - 1, axis=1)[:, count - 1 : count]


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count`` of every group: highest score, then smallest id, then smallest row."""
    order = np.lexsort((rows, ids, ~score, group))  # ~score falls as score rises, at the ends of 64 bits too
    ordered = group[order]
    begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else np.zeros(0, dtype=np.int64)
    turn = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return order[turn < count]


def _parts(anchors: int, rows: int) -> list[slice]:
    size = max(1, _CELL // max(1, rows))
    return [slice(low, low + size) for low in range(0, anchors, size)]


class _Positives:
    """A cell: the first rows of the anchor's label, for every anchor."""

    SCHEMA = "anchor_row long, row long, id long, score long"

    def __init__(self, count: int):
        self._count = count

    def __call__(self, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        names = [part.split(" ")[0] for part in self.SCHEMA.split(", ")]
        found = [np.zeros((4, 0), dtype=np.int64)]
        if rows.num_rows and anchors.num_rows:
            block, asked = _Block(rows), _Block(anchors)
            for part in _parts(len(asked.row), len(block.row)):
                low, high = intervals(asked.ints[part], block)
                fit = (asked.label[part, None] == block.label) & (asked.row[part, None] != block.row)
                a, r = np.nonzero(fit & (high >= _reach(low, fit, self._count)))
                score = integer_scores(asked.ints[part], block.ints, a, r)
                best = _first(a, score, block.id[r], block.row[r], self._count)
                a, r = a[best], r[best]
                found.append(np.stack([asked.row[part][a], block.row[r], block.id[r], score[best]]))
        return pa.Table.from_arrays([pa.array(values) for values in np.concatenate(found, axis=1)], names=names)


class _Negatives:
    """A cell: the first rows of other labels within the window of every positive of every anchor."""

    SCHEMA = "anchor_row long, positive int, row long, id long, score long"

    def __init__(self, count: int):
        self._count = count

    def __call__(self, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        names = [part.split(" ")[0] for part in self.SCHEMA.split(", ")]
        found = [np.zeros((5, 0), dtype=np.int64)]
        if rows.num_rows and anchors.num_rows:
            block, asked = _Block(rows), _Block(anchors)
            windows = anchors.column("windows").to_pylist()
            most = max(len(own) for own in windows)
            least_score = np.array([[own[k]["low"] if k < len(own) else 1 for k in range(most)] for own in windows], dtype=np.int64)
            most_score = np.array([[own[k]["high"] if k < len(own) else 0 for k in range(most)] for own in windows], dtype=np.int64)
            number = np.array([[own[k]["positive"] if k < len(own) else -1 for k in range(most)] for own in windows], dtype=np.int64)
            for part in _parts(len(asked.row), len(block.row)):
                low, high = intervals(asked.ints[part], block)
                other = asked.label[part, None] != block.label
                wanted = np.zeros_like(other)
                for k in range(most):
                    bottom, top = (side[part, k, None].astype(np.float64) for side in (least_score, most_score))
                    sure = other & (low >= bottom) & (high <= top)
                    can = other & (high >= np.maximum(bottom * (1 - _SLACK), _reach(low, sure, self._count))) & (low <= top * (1 + _SLACK))
                    wanted |= can & (bottom <= top)
                a, r = np.nonzero(wanted)
                score = integer_scores(asked.ints[part], block.ints, a, r)
                for k in range(most):
                    inside = np.flatnonzero((score >= least_score[part, k][a]) & (score <= most_score[part, k][a]))
                    best = inside[_first(a[inside], score[inside], block.id[r[inside]], block.row[r[inside]], self._count)]
                    x, y = a[best], r[best]
                    found.append(np.stack([asked.row[part][x], number[part, k][x], block.row[y], block.id[y], score[best]]))
        columns = np.concatenate(found, axis=1)
        return pa.Table.from_arrays([pa.array(v.astype(np.int32) if name == "positive" else v) for name, v in zip(names, columns)], names=names)


def _meet(rows: DataFrame, anchors: DataFrame, counts: tuple[int, int], cell: _Positives | _Negatives) -> DataFrame:
    """Every block of anchors against every block of rows."""
    n_rows, n_anchors = counts
    rows_each = min(ROWS, max(_FEW, n_rows // 32))
    row_blocks, anchor_blocks = -(-n_rows // rows_each), -(-n_anchors // ANCHORS)

    def dealt(df: DataFrame, own: str, own_blocks: int, met: str, met_blocks: int) -> DataFrame:
        blocked = df.withColumn(own, F.expr(f"cast(pmod(xxhash64(row), {own_blocks}) as int)"))
        return blocked.withColumn(met, F.explode(F.sequence(F.lit(0), F.lit(met_blocks - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return cell(left, right)

    left = dealt(rows, "row_block", row_blocks, "anchor_block", anchor_blocks)
    right = dealt(anchors, "anchor_block", anchor_blocks, "row_block", row_blocks)
    key = ("row_block", "anchor_block")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, cell.SCHEMA)


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Per anchor and positive the first negatives: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become ``floor(scale * x)``; scores are integer inner products, higher ones first, ties by smaller id (then by
    place in the table). Positives are the first ``positives`` other rows of the anchor's label; negatives are rows of other
    labels whose score is at least ``least`` and at most ``most`` per cent of the positive's. Pairs without such a row give none.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; shorter vectors
    are filled up with zeros and an empty one is all zeros. Rows with equal ids are rows of their own. Components beyond 64 bits
    and scores beyond it stop at its ends. Other columns are ignored; an empty table, or no anchor, gives no rows.
    """
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    taken = (
        vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(True)))
        .select(
            F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
            F.coalesce(anchors, F.lit(False)).alias("anchor"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v)).alias("ints"),
        )
        .withColumn("row", F.monotonically_increasing_id())
    )
    taken = written(taken)
    n_rows, n_anchors, width = taken.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("ints"))).first()
    coded = written(taken.select("row", "id", "label", "anchor", "ints").mapInArrow(_Codes(max(1, width or 0)), _CODED))
    drop(taken)
    counts = (max(1, n_rows), max(1, n_anchors))
    asked = written(coded.where("anchor"))  # a table of its own: a cogroup cannot tell two sides of one table apart

    best = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "id", "row")
    own = written(
        _meet(coded, asked, counts, _Positives(positives))
        .withColumn("positive", F.row_number().over(best)).where(F.col("positive") <= positives)
        .select("anchor_row", "positive", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    )
    score = F.col("positive_score").cast("decimal(38,0)")
    window = F.struct(
        "positive", F.ceil(score * least / 100).cast("long").alias("low"), F.floor(score * most / 100).cast("long").alias("high")
    )
    windows = (
        own.select(F.col("anchor_row").alias("row"), window.alias("window")).where("window.low <= window.high")
        .groupBy("row").agg(F.sort_array(F.collect_list("window")).alias("windows"))
    )
    first = Window.partitionBy("anchor_row", "positive").orderBy(F.desc("score"), "id", "row")
    found = (
        _meet(coded, asked.join(windows, "row"), counts, _Negatives(negatives))
        .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    )
    out = written(
        found.select("anchor_row", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(own, ["anchor_row", "positive"])
        .join(asked.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
    drop(coded, asked, own)
    return out
