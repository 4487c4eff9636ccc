"""Circulant MinHash against brute force, and its edge cases."""

import random

import numpy as np
import pytest

from firmlens.llm.circulant_minhash import AGREE, BANDS, COORDINATES, band_keys, near_duplicates, signatures
from tests.llm.test_pairs import brute, corpus, frame


@pytest.mark.parametrize("size,num", [(2, 80), (5, 80), (4, 85)])
def test_groups_match_brute_force(spark, size, num):
    rows = corpus(size + num)
    expected, _ = brute(rows, size, num, 100)
    out = {r[0]: (r[1], r[2], r[3]) for r in near_duplicates(frame(spark, rows), size, num, 100).collect()}
    assert out == {doc: (n, least, doc == least) for doc, (n, least) in expected.items()}


def test_chains_behind_members_that_are_not_alike(spark):
    """Neighbours in a chain are alike, its ends are not: most members do not link with a bucket's leader."""
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    base = rnd.sample(words, 120)
    rows = []
    for step in range(60):
        rows.append(" ".join(base))
        for _ in range(3):
            base[rnd.randrange(120)] = rnd.choice(words)
    order = list(range(60))
    rnd.shuffle(order)
    rows = [(doc, rows[place]) for doc, place in enumerate(order)]
    expected, _ = brute(rows, 2, 80, 100)
    assert {r[0]: r[2] for r in near_duplicates(frame(spark, rows), 2).collect()} == {d: least for d, (_, least) in expected.items()}


def test_edge_cases(spark):
    rows = [
        (5, "Same words here"), (3, "same  words\there"), (3, "same words here"), (3, "others"), (7, None), (8, ""), (9, " \n "),
        (None, "same words here"), (None, "lonely line"), (None, "lonely line"), (10, "x" * 70_000), (11, "x" * 70_000), (12, "a b"),
    ]
    out = [tuple(r) for r in near_duplicates(frame(spark, rows), 5).collect()]
    assert sorted(out, key=str) == sorted([
        (5, 1, 3, False), (3, 1, 3, True), (3, 1, 3, True), (3, 1, 3, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True),
        (None, 1, 3, False), (None, 1, None, True), (None, 1, None, True), (10, 1, 10, True), (11, 1, 10, False), (12, 1, 12, True),
    ], key=str)
    assert near_duplicates(frame(spark, rows).where("false"), 5).collect() == []
    with pytest.raises(ValueError):
        near_duplicates(frame(spark, rows), 5, 70, 100)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 1 << 62, 4000, dtype=np.uint64))
    one, other = values[:2200], values[200:2400]  # 2000 of 2400 shared
    signed = signatures(np.concatenate([one, other]), np.array([0, len(one), len(one) + len(other)]))
    assert signed.shape == (2, COORDINATES)
    assert abs((signed[0] == signed[1]).mean() - 2000 / 2400) < 0.13
    assert (signed[0] == signed[1]).sum() >= AGREE
    keys = band_keys(signed)
    assert keys.shape == (2, BANDS) and len(np.unique(keys[0])) == BANDS and (keys[0] == keys[1]).any()
    places = signatures(one, np.array([0, len(one)]))
    assert (places == signatures(rng.permutation(one), np.array([0, len(one)]))).all()
