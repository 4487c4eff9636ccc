"""N-gram join and passages against brute force, and their edge cases."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from firmlens.llm import line_quality, passages
from firmlens.llm.common import components
from firmlens.llm.ngram_join import jaccard_components, jaccard_pairs
from firmlens.llm.passages import aligned, alike, chains, common_words, repeated_passages, without_passages
from firmlens.llm.shingles import WordHasher

DOCS = "doc_id long, text string, id string, n int, token string, doc long, key int"


def frame(spark, rows):
    return spark.createDataFrame([(doc, text, "x", 1, "t", 7, 3) for doc, text in rows], DOCS)


def corpus(seed, groups=25):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(groups):
        base = rnd.choices(words, k=rnd.randint(1, 160))
        for _ in range(rnd.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            rows.append(" ".join(own))
    return list(enumerate(rows))


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, num, den):
    sets = {doc: shingles(text, size) for doc, text in rows}
    root = {doc: doc for doc in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {doc: (len(sets[doc]), find(doc)) for doc in sets}, sets


@pytest.mark.parametrize("size,num", [(4, 85), (5, 80)])
def test_components_match_brute_force(spark, size, num):
    rows = corpus(size)
    expected, sets = brute(rows, size, num, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, rows), size, num, 100).collect()}
    assert got == expected
    first = defaultdict(list)
    for doc in sorted(sets):
        first[frozenset(sets[doc])].append(doc)
    reps = [own[0] for key, own in first.items() if key]
    pairs = {
        (a, b) for a in reps for b in reps
        if a < b and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    }
    assert {(r.a, r.b) for r in jaccard_pairs(frame(spark, rows), size, num, 100).collect()} == pairs


def test_component_edge_cases(spark):
    long_text = " ".join(f"z{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (5, "one TWO"), (None, "one two"), (8, long_text), (9, long_text)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, rows), 4, 85, 100).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (8, 29_997, 8), (9, 29_997, 8)]
    assert jaccard_components(frame(spark, []), 4, 85, 100).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_exact_passages_are_found(spark):
    rnd = random.Random(3)
    words = [f"v{k}" for k in range(3000)]
    passage = rnd.choices(words, k=60)
    rows = []
    for doc in range(12):
        own = rnd.choices(words, k=rnd.randint(80, 200))
        if doc % 3 == 0:
            own[20:20] = passage
        rows.append((doc, " ".join(own)))
    fuzzy = list(passage)
    fuzzy[10], fuzzy[30], fuzzy[31] = "new", "gone", "other"
    rows += [(50, "start here " + " ".join(fuzzy) + " the end"), (51, "alone"), (52, None), (53, ""), (None, rows[0][1])]
    docs = frame(spark, rows)
    found = repeated_passages(docs)
    spans = {(r.doc_id, r.source_id): (r.start, r.length) for r in found.collect()}
    assert {doc for doc, _ in spans} == {3, 6, 9, 50}
    assert all(spans[doc, 0] == (20, 60) for doc in (3, 6, 9))
    assert spans[50, 0] == (2, 60)
    cut = {r.doc_id: r.text for r in without_passages(docs, found).collect()}
    assert cut[50] == "start here  the end" and cut[0] == rows[0][1] and cut[52] is None and cut[53] == ""
    assert without_passages(docs, found).columns == docs.columns
    assert repeated_passages(frame(spark, [])).count() == 0


def test_chaining_keeps_order_and_alignment_counts():
    import numpy as np

    blocks = np.array([[0, 0, 6], [10, 11, 6], [20, 5, 6], [30, 31, 6]])
    best = chains(blocks)
    assert best[0] == [(0, 0, 6), (10, 11, 6), (30, 31, 6)] and best[1:] == [[(20, 5, 6)]]
    assert common_words(np.array([1, 2, 3, 4]), np.array([1, 3, 9, 4, 5])) == 3
    a = np.arange(100)
    b = np.concatenate([[500], a[10:40], [777], a[41:60], [501]])
    assert aligned(a, b, [(12, 3, 10)]) == [(10, 60, 1, 51, 49)]


def test_copies_are_found_behind_holders_of_fragments(spark):
    rnd = random.Random(8)
    words = [f"u{k}" for k in range(4000)]
    halves = [rnd.choices(words, k=30), rnd.choices(words, k=30)]
    rows = [(doc, " ".join([*rnd.choices(words, k=20), *halves[doc % 2], *rnd.choices(words, k=20)])) for doc in range(100)]
    rows += [(doc, " ".join([*rnd.choices(words, k=doc % 7 + 5), *halves[0], *halves[1], *rnd.choices(words, k=9)])) for doc in range(100, 105)]
    exact = rnd.choices(words, k=50)  # the shortest passage, between holders of its first and its last 45 words
    rows += [(200 + k, " ".join([*rnd.choices(words, k=12), *exact[5 * (k % 2) : 45 + 5 * (k % 2)], *rnd.choices(words, k=12)])) for k in range(30)]
    rows += [(300 + k, " ".join([*rnd.choices(words, k=k), *exact, *rnd.choices(words, k=12)])) for k in range(3)]
    spans = {(r.doc_id, r.source_id): (r.start, r.length, r.matches) for r in repeated_passages(frame(spark, rows)).collect()}
    assert set(spans) == {(doc, 100) for doc in range(101, 105)} | {(301, 300), (302, 300)}
    assert all(spans[doc, 100] == (doc % 7 + 5, 60, 60) for doc in range(101, 105))
    assert spans[301, 300] == (1, 50, 50) and spans[302, 300] == (2, 50, 50)


@pytest.mark.parametrize("others", [6, 90])
def test_near_copies_behind_holders_of_their_phrases(spark, others):
    """Two near copies whose seeds many documents hold, before and between them: few holders a seed, and more than are paired."""
    rnd = random.Random(11)
    words = [f"u{k}" for k in range(4000)]
    parts = [rnd.choices(words, k=16) for _ in range(4)]
    rows = []
    for doc in range(others):
        own = rnd.choices(words, k=20)
        for part in rnd.sample(parts, 4):
            own += [*part, *rnd.choices(words, k=70)]
        rows.append((doc if doc % 2 else 10000 + doc, " ".join(own)))
    for doc in (500, 501):
        own = rnd.choices(words, k=15)
        for part in parts:  # one word more in the second
            own += [*part, *rnd.choices(words, k=1 + doc % 2)]
        rows.append((doc, " ".join([*own, *rnd.choices(words, k=15)])))
    spans = {(r.doc_id, r.source_id): (r.start, r.length, r.matches) for r in repeated_passages(frame(spark, rows)).collect()}
    assert set(spans) == {(501, 500)} and spans[501, 500][1] >= 50 and spans[501, 500][2] >= 40


def test_comparison_of_common_seeds_finds_what_all_pairs_find():
    """Blocks of holders against a plain count of the words that agree, words moved by a few places included."""
    rnd, size, kmer = random.Random(4), 50, 6
    side = size - kmer + passages.SHIFT
    seed = [rnd.randrange(1, 256) for _ in range(kmer)]
    bases = [[rnd.randrange(1, 256) for _ in range(2 * side)] for _ in range(3)]
    rows = []
    for doc in range(40):
        own = [rnd.randrange(1, 256) if rnd.random() < doc % 5 / 12 else word for word in bases[doc % 3]]
        if doc % 4 == 1:
            own.insert(side + 10, rnd.randrange(1, 256))
        rows.append((7, doc, 1000, 40, None, bytes([*own[:side], *seed, *own[side : 2 * side]]), None, doc % 2, 0, 1))
    names = ["seed", "doc", "pos", "apart", "before", "around", "label", "block", "one", "two"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)

    found = set()
    compare = passages._Compare(kmer, size, 0.8)
    for one, two in ((0, 0), (0, 1), (1, 1)):
        group = [(*row[:8], one, two) for row in rows if row[7] in (one, two)]
        for out in compare(iter([batch(group[:7]), batch(group[7:])])):
            found |= set(zip(*(out.column(name).to_pylist() for name in ("later", "earlier"))))
    wanted = set()
    for later in rows:
        for earlier in rows[: later[1]]:
            a, b = later[5], earlier[5]
            agree = [any(a[k] == b[k + s] for s in range(-passages.SHIFT, passages.SHIFT + 1)) for k in range(passages.SHIFT, len(a) - passages.SHIFT)]
            equal = [a[k] == b[k] for k in range(passages.SHIFT, len(a) - passages.SHIFT)]
            spans = range(len(agree) - size + 1)
            if max(sum(agree[k : k + size]) for k in spans) >= 40 and not any(all(equal[k : k + size]) for k in spans):
                wanted.add((later[1], earlier[1]))
    # The words that agree are counted on the side of the row that comes first, which is the later one or not.
    assert found and len(found ^ wanted) <= len(wanted) // 10


@pytest.mark.parametrize("blocks", [1, 2])
def test_a_group_of_near_copies_costs_its_size(blocks):
    """Two groups of near copies and unlike places: matches in proportion, every copy with an earlier one, classes as of all pairs."""
    import numpy as np

    rnd, size, kmer, many = np.random.default_rng(6), 50, 6, 240
    width = 2 * (size - kmer + passages.SHIFT) + kmer
    bases = rnd.integers(1, 255, (2, width), dtype=np.uint8)
    rows = []
    for doc in range(many):
        changed = rnd.random(width) < (0.03 if doc % 3 else 1)
        changed[[45, 46, 72, 73]] = True  # on both sides of the seed: no equal window
        own = np.where(changed, rnd.integers(1, 255, width), bases[doc % 2])
        own[56:62] = 9
        rows.append((7, doc, 1000, many, None, own.astype(np.uint8).tobytes(), None, doc // 2 % blocks, 0, 0))
    names = ["seed", "doc", "pos", "apart", "before", "around", "label", "block", "one", "two"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    links, made = set(), 0
    for one in range(blocks):
        for two in range(one, blocks):
            group = [(*row[:8], one, two) for row in rows if row[7] in (one, two)]
            group = [group[at] for at in rnd.permutation(len(group))]
            columns = [pa.array(column, kind) for column, kind in zip(zip(*group), kinds)]
            for out in passages._Compare(kmer, size, 0.8, forest=True)(iter([pa.RecordBatch.from_arrays(columns, names=names)])):
                links |= set(zip(out.column("later").to_pylist(), out.column("earlier").to_pylist()))
                made += out.num_rows
    copies = {doc for doc in range(many) if doc % 3}
    assert all(a % 2 == b % 2 and {a, b} <= copies for a, b in links)
    assert {a for a, _ in links} == copies - {1, 2}  # all but the first of each group
    assert made < 40 * many  # all pairs: 6,400 with ten matches each


def test_an_equal_run_beside_unlike_words_is_a_passage(spark):
    import numpy as np

    rnd = random.Random(9)
    words = [f"u{k}" for k in range(4000)]
    run, tail = rnd.choices(words, k=55), rnd.choices(words, k=20)
    rows = [(doc, " ".join([*run, *rnd.choices(words, k=40), *tail])) for doc in range(2)]
    assert [(r.start, r.length, r.matches) for r in repeated_passages(frame(spark, rows)).collect()] != []
    same = np.array([True] * 55 + [False] * 40 + [True] * 20)
    assert alike(same, 50, 0.8) == [(0, 55)] and alike(same, 50, 1.0) == [(0, 55)] and alike(~same, 50, 0.8) == []


def unlike_words(doublings=10):
    """A Thue-Morse word and its complement: equal under every polynomial hash modulo a power of two."""
    word = "a"
    for _ in range(doublings):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("doublings", [10, 11, 12])
def test_words_that_collide_under_polynomials_stay_apart(spark, doublings):
    one, other = unlike_words(doublings)
    out = {r[0]: r[2] for r in jaccard_components(frame(spark, [(1, one), (2, other), (3, one.upper())]), size=4, num=85).collect()}
    assert out == {1: 1, 2: 2, 3: 1}
    counts = [line_quality.measured(pa.array([f"{one}\n{other}"]), WordHasher(False)).dup_lines[0]]
    assert counts == [0]


def test_long_words_hash_alike_wherever_they_stand():
    word = bytes(random.Random(1).choices(range(97, 123), k=700_001))
    data = np.frombuffer(b"ab " + word + b" x " + word.upper() + b" " + word[:-1], dtype=np.uint8)
    hashes = WordHasher().words(data, np.array([0, len(data)]))[2]
    assert hashes[1] == hashes[3] and len(set(hashes.tolist())) == 4


def test_steps_of_passages_do_not_pile_up_shuffles(spark, monkeypatch):
    shuffles, kept = [], passages.written

    def counted(df):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return kept(df)

    monkeypatch.setattr(passages, "written", counted)
    text = " ".join(f"word{k}" for k in range(80))
    docs = spark.createDataFrame([(k, f"{text} end{k}") for k in range(4)], "doc_id long, text string")
    found = passages.repeated_passages(docs, min_words=50).collect()
    assert {(r.doc_id, r.source_id, r.length) for r in found} >= {(k, 0, 80) for k in (1, 2, 3)}
    assert sum(shuffles) > 8 and max(shuffles) <= 8, shuffles  # the files of a step's shuffles stay until it ends


def test_copies_of_a_text_are_one_row_each(spark):
    """Only the first holder of a text is compared with others; short texts, equal rows and two texts under one id."""
    rnd = random.Random(12)
    words = [f"u{k}" for k in range(4000)]
    part, text, short = rnd.choices(words, k=60), rnd.choices(words, k=40), " ".join(rnd.choices(words, k=49))
    whole = " ".join([*text, *part])
    rows = [(9, whole), (3, whole), (7, whole), (7, whole), (5, " ".join([*part, *rnd.choices(words, k=30)])), (1, short), (2, short)]
    rows += [(20, whole), (20, " ".join(rnd.choices(words, k=70))), (None, whole)]
    found = [tuple(r) for r in repeated_passages(frame(spark, rows)).collect()]
    copies = [(doc, 3, 0, 100, 0, 100, 100) for doc in (7, 9, 20)]
    assert sorted(found) == sorted([*copies, (5, 3, 0, 60, 40, 60, 60)])
    cut = {(r.doc_id, r.text) for r in without_passages(frame(spark, rows[:5]), repeated_passages(frame(spark, rows[:5]))).collect()}
    assert (9, "") in cut and (7, "") in cut and (3, whole) in cut


def test_places_with_few_alike_ones_are_compared_together(monkeypatch):
    """Many pairs of near copies at a common seed: a step over the words for many places, not for each."""
    rnd, size, kmer, many, calls = np.random.default_rng(3), 50, 6, 400, []
    width = 2 * (size - kmer + passages.SHIFT) + kmer
    rows = []
    for doc in range(many):
        if doc % 2 == 0:
            own = rnd.integers(1, 255, width)
        own = own.copy()
        own[[45, 46, 72, 73]] = rnd.integers(1, 255, 4)  # on both sides of the seed: no equal window
        own[56:62] = 9
        rows.append((7, doc, 1000, None, None, own.astype(np.uint8).tobytes(), 0, 0, 0))
    names = ["seed", "doc", "pos", "label", "before", "around", "block", "one", "two"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
    ordered = passages._Compare._ordered
    monkeypatch.setattr(passages._Compare, "_ordered", lambda self, *given: calls.append(1) or ordered(self, *given))
    batch = pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)
    links = set()
    for out in passages._Compare(kmer, size, 0.8, forest=True)(iter([batch])):
        links |= set(zip(out.column("later").to_pylist(), out.column("earlier").to_pylist()))
    assert links == {(doc, doc - 1) for doc in range(1, many, 2)}
    assert len(calls) <= 4, len(calls)  # one for each of 200 places before


@pytest.mark.parametrize("kind", ["evenly", "at random"])
def test_copies_at_the_declared_identity_are_all_found(spark, kind):
    """50 words of which 40 are equal, in runs of four words at worst: seeds of more words miss such copies."""
    rnd, rows = random.Random(5), []
    words = [f"u{k}" for k in range(4000)]
    for pair in range(30):
        run = rnd.choices(words, k=50)
        copy = list(run)
        for at in range(2, 50, 5) if kind == "evenly" else rnd.sample(range(1, 49), 10):
            copy[at] = f"n{pair}x{at}"
        for doc, own in ((2 * pair, run), (2 * pair + 1, copy)):
            rows.append((doc, " ".join([*rnd.choices(words, k=rnd.randint(5, 80)), *own, *rnd.choices(words, k=rnd.randint(5, 80))])))
    found = {(r.doc_id, r.source_id): r for r in repeated_passages(frame(spark, rows)).collect()}
    assert set(found) == {(2 * pair + 1, 2 * pair) for pair in range(30)}
    assert all(r.matches >= 0.8 * max(r.length, r.source_length) and min(r.length, r.source_length) >= 50 for r in found.values())


def test_words_said_over_and_over_are_covered_to_their_end(spark):
    rnd = random.Random(7)
    words = [f"u{k}" for k in range(4000)]
    rows = [(doc, " ".join([*rnd.choices(words, k=20), *["la"] * size, *rnd.choices(words, k=20)])) for doc, size in ((1, 90), (2, 330), (3, 60))]
    found = [r for r in repeated_passages(frame(spark, rows)).collect()]
    covered = {doc: set() for doc in (1, 2, 3)}
    for r in found:
        assert r.source_id < r.doc_id
        covered[r.doc_id] |= set(range(r.start, r.start + r.length))
    assert covered[2] >= set(range(20, 350)) and covered[3] >= set(range(20, 80)) and not covered[1]


def test_a_long_chain_further_off_does_not_hide_a_near_block():
    far, near, last = [0, 0, 900], [1000, 1000, 20], [1030, 1025, 10]
    assert chains(np.array([far, near, last])) == [[tuple(far)], [tuple(near), tuple(last)]]


def test_alike_stretches_follow_the_chain_over_gaps():
    a = np.arange(200)
    b = np.concatenate([a[:40], [900], a[40:80], np.arange(300, 420)])
    blocks = [(0, 0, 40), (40, 41, 40), (190, 190, 4)]
    assert (0, 80, 0, 81, 80) in passages.stretches(a, b, blocks, 60, 0.9)
