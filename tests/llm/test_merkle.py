"""Merkle manifest and proofs against a plain tree, and their edge cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from firmlens.llm.merkle_manifest import FAN, folded, manifest, proof_digest

ROWS = "doc_id long, text string, lang string, source string, n_chars long, tree string, name string, pos int, path string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    doc, text, lang, source, chars = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, chars, text)))


def climb(nodes, proofs):
    """One tree: its top node, and the proof of every (index, digest) extended on the way."""
    level = [(node, [at]) for at, node in enumerate(nodes)]
    while len(level) > 1:
        above = []
        for start in range(0, len(level), FAN):
            run = level[start : start + FAN]
            for at, (_, held) in enumerate(run):
                for owner in held:
                    proofs[owner].append(("".join(n for n, _ in run[:at]), "".join(n for n, _ in run[at + 1 :])))
            above.append((sha("".join(n for n, _ in run)), [owner for _, held in run for owner in held]))
        level = above
    return level[0][0]


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    langs = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    subroots, proofs = [], []
    for lang in langs:
        own = sorted(groups[lang], key=lambda row: (row[0] is not None, row[0] or 0, leaf(row)))
        steps = [[] for _ in own]
        subroots.append((climb([leaf(row) for row in own], steps), own, steps))
    upper = [[] for _ in langs]
    root = climb([top for top, _, _ in subroots], upper)
    for (top, own, steps), rest in zip(subroots, upper):
        proofs += [(row[0], leaf(row), top, root, tuple(step + rest)) for row, step in zip(own, steps)]
    return proofs


def frame(spark, rows):
    return spark.createDataFrame([(*row, "t", "n", 1, "p") for row in rows], ROWS).repartition(3)


def found(out):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(tuple(s) for s in r["path"])) for r in out.collect()), key=repr)


def made(seed, count, langs):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(count), rnd.choice(["", "Ab", "Größe 日本", None]) , rnd.choice(langs), rnd.choice(["s", None]), rnd.choice([1, None])) for _ in range(count)]
    return rows + rows[: count // 5] + [(None, None, None, None, None)] * 3


@pytest.mark.parametrize("count,langs", [(700, ["en", "de", None, ""]), (90, [f"l{k}" for k in range(30)]), (1, ["en"]), (9, ["en"])])
def test_proofs_match_a_plain_tree(spark, count, langs):
    rows = made(count, count, langs)
    assert found(manifest(frame(spark, rows))) == sorted(brute(rows), key=repr)


def test_one_row_one_group_and_no_rows(spark):
    one = [(7, "text", "en", "s", 4)]
    assert found(manifest(frame(spark, one))) == [(7, leaf(one[0]), leaf(one[0]), leaf(one[0]), ())]
    many = [(k, "text", "en", "s", 4) for k in range(65)]
    assert found(manifest(frame(spark, many))) == sorted(brute(many), key=repr)
    assert manifest(frame(spark, one).where("false")).collect() == []


def test_folding_finds_the_claims_that_are_false(spark):
    rows = [(k, "Abc" if k % 2 else "abc", "en" if k % 5 else None, "s", 3) for k in range(200)] + [(900, "x" * 2_000_000 + "Y", "en", "s", 1)]
    out = manifest(frame(spark, rows), claims={"text": F.lower("text")})
    verdicts = {r[0]: (r[1], r[2]) for r in out.select("doc_id", folded(F.col("claimed"), F.col("path")) == F.col("root"), proof_digest(F.col("path"))).collect()}
    assert {doc for doc, (good, _) in verdicts.items() if not good} == {k for k in range(200) if k % 2} | {900}
    expected = {doc: sha("".join(a + b for a, b in path)) for doc, _, _, _, path in brute(rows)}
    assert {doc: proof for doc, (_, proof) in verdicts.items()} == expected
