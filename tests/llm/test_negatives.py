"""Hard negatives against brute force, the interval bounds, and edge cases."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from firmlens.llm import hard_negatives
from firmlens.llm.hard_negatives import _Block, _Codes, integer_scores, intervals, mine

ROWS = "vec_id long, embedding array<float>, label int, id long, row long, score int, windows string"


def brute(rows, positives=5, negatives=3):
    taken = [
        (vec, label, [math.floor(256 * float(x)) for x in values], place) for place, (vec, values, label) in enumerate(rows)
        if vec is not None and label is not None and values is not None and all(x is not None and math.isfinite(x) for x in values)
    ]
    width = max((len(v) for _, _, v, _ in taken), default=0)
    taken = [(vec, label, values + [0] * (width - len(values)), place) for vec, label, values, place in taken]
    out = []
    for vec, label, values, place in taken:
        if vec % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(values, v)), i, p, other) for i, other, v, p in taken if p != place]
        for score, positive, _, _ in sorted(s for s in scored if s[3] == label)[:positives]:
            fit = sorted(s for s in scored if s[3] != label and 50 * -score <= 100 * -s[0] <= 95 * -score)
            out += [(vec, positive, rank + 1, s[1], -score, -s[0]) for rank, s in enumerate(fit[:negatives])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*row, 1, 2, 3, "w") for row in rows], ROWS)


def rows_of(out):
    return sorted(tuple(r) for r in out.collect())


def made(seed, count, width):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, width))
    rows = []
    for vec in range(count):
        label = int(rng.integers(0, 6))
        values = (centres[label] + 0.7 * rng.standard_normal(width)).astype(np.float32)
        rows.append((vec, values.tolist(), int(rng.integers(0, 6)) if rng.random() < 0.3 else label))
    return rows


@pytest.mark.parametrize("width", [3, 64, 70])
def test_negatives_match_brute_force(spark, width):
    rows = made(width, 900, width)
    rows += [rows[3], rows[50], rows[100]]  # equal rows with equal ids
    out = rows_of(mine(frame(spark, rows).repartition(3), F.expr("vec_id % 50 = 0")))
    assert [r[:3] + r[4:] for r in out] == [r[:3] + r[4:] for r in brute(rows)]
    assert out == brute(rows)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "_FEW", 50)
    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    rows = made(2, 700, 16)
    assert rows_of(mine(frame(spark, rows), F.expr("vec_id % 50 = 0"))) == brute(rows)


def test_edge_cases(spark):
    rnd = random.Random(4)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    rows += [(6, [], 1), (7, [1.0], 2), (50, [0.0, 0.0], 1), (100, [-1.0, -2.0], 1), (150, [2.0, 2.0], 9)]
    rows += [(200 + k, [round(rnd.random(), 1), round(rnd.random(), 1)], rnd.choice([1, 2])) for k in range(300)]
    rows += [(0, [1.0, 2.0], 1), (601, [2.0, 1.0], 1), (602, [2.0, 1.0], 2), (602, [2.0, 1.0], 2)]
    assert rows_of(mine(frame(spark, rows).coalesce(1), F.expr("vec_id % 50 = 0"))) == brute(rows)
    assert mine(frame(spark, rows).where("false"), F.expr("vec_id % 50 = 0")).collect() == []
    assert mine(frame(spark, rows), F.lit(False)).collect() == []
    assert mine(frame(spark, rows), F.lit(None).cast("boolean")).collect() == []


def test_intervals_hold_the_scores():
    rng = np.random.default_rng(8)
    for width, scale in ((1, 5), (64, 256), (100, 100_000)):
        ints = (rng.standard_normal((300, width)) * scale).astype(np.int64)
        ints[0] = 0
        ints[1] = ints[2]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(range(300)), pa.array(range(300)), pa.array([0] * 300), pa.array([False] * 300), pa.array(ints.tolist(), pa.list_(pa.int64()))],
            names=["row", "id", "label", "anchor", "ints"],
        )
        block = _Block(pa.Table.from_batches(list(_Codes(width)([batch]))))
        low, high = intervals(ints[:40], block)
        exact = ints[:40] @ ints.T
        assert (low <= exact).all() and (exact <= high).all()
        if width == 64:  # the intervals are narrow enough to be of use
            assert np.mean((high - low) / 2) < 0.75 * np.mean(np.linalg.norm(ints, axis=1)) ** 2


def test_scores_beyond_doubles_are_exact():
    left = np.array([[2**40, 3], [2**62, 2**62], [-(2**62), 2**62]], dtype=np.int64)
    right = np.array([[2**20, 5], [2**62, 1], [2**62, -1]], dtype=np.int64)
    assert integer_scores(left, right, np.arange(3), np.arange(3)).tolist() == [2**60 + 15, 2**63 - 1, -(2**63)]
