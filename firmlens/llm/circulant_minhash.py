"""Circulant MinHash: near-duplicate documents by banded signatures of one shifted permutation.

Method: a first permutation scatters the shingles of a set over a circle of 2^32 places, a second one orders
the places. Coordinate k of the signature is the smallest rank of the set after the circle was turned by k
places, so two permutations give all coordinates. Rows of ``BAND_ROWS`` coordinates are band keys; sets that share
one are candidates, and a candidate is a link only after its whole sets were compared exactly.

What the bands can miss: a pair of similarity 0.8 shares none of ``BANDS`` bands with a chance of
(1 - 0.8^5)^30 = 7e-6, less above. Before whole sets are read, signatures must agree in ``AGREE`` of 150
coordinates; 0.8 falls below that with a chance under 1e-9. The bounds hold for ``num/den`` of 0.8 and more, and a
smaller threshold is refused.

How it scales: features are one pass over the texts and are written next to them; equal sets are one class, and the
later joins carry class numbers, sizes and 150-byte signatures. In every band bucket all members are compared with
one leader, the member that shares most with others, so a group of near copies falls into one component after work in
proportion to its size. Buckets that then still span several components form groups by their largest component, and an
exact way finds every link that is left in them: the shingles of a group are ordered by their frequency in it, rarest
first, and only members of different components that share a shingle of their prefixes, early enough for the overlap they
need, are compared. No candidate pair is dropped and none inside a component is made. Buckets meet one leader
row and group shingles one frequency row each, so adaptive execution can split a hot one on its other side. Joins whose
one side grows with the corpus are sort-merge joins at every size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmlens.llm.common import components, drop, written
from firmlens.llm.shingles import WordHasher, mixed, text_buffer, windows

BAND_ROWS = 5
BANDS = 30
COORDINATES = BAND_ROWS * BANDS
#: Coordinates (their lowest bytes) in which two signatures must agree before whole sets are compared.
AGREE = 90
#: The least similarity for which the bounds above hold.
LEAST = 0.8
#: Shingles signed at once, so that all steps of a coordinate stay in the processor's cache.
_STRETCH = 1 << 15
#: Shingles gathered before a batch of features leaves the task.
_BATCH = 1 << 20
_SCATTER = np.uint64(0x5851F42D4C957F2D)
_FEATURES = "doc_id long, n int, digest binary, bands array<long>, signature binary, text string"


def _ranked(places: np.ndarray) -> np.ndarray:
    """The second permutation of the 2^32 places, in place."""
    places ^= places >> np.uint32(16)
    places *= np.uint32(0x7FEB352D)
    places ^= places >> np.uint32(15)
    places *= np.uint32(0x846CA68B)
    places ^= places >> np.uint32(16)
    return places


def signatures(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Signatures (n x COORDINATES, uint32) of the sets ``flat[bounds[i]:bounds[i + 1]]``; none of them is empty."""
    places = (mixed(flat ^ _SCATTER) >> np.uint64(32)).astype(np.uint32)
    out = np.full((COORDINATES, len(bounds) - 1), np.uint32(0xFFFFFFFF))
    for low in range(0, len(places), _STRETCH):
        part = places[low : low + _STRETCH]
        first = np.searchsorted(bounds, low, "right") - 1
        last = np.searchsorted(bounds, low + len(part), "left")
        begins = np.maximum(bounds[first:last] - low, 0)
        for k in range(COORDINATES):
            least = np.minimum.reduceat(_ranked(part - np.uint32(k)), begins)
            np.minimum(out[k, first:last], least, out=out[k, first:last])
    return np.ascontiguousarray(out.T)


def band_keys(signed: np.ndarray) -> np.ndarray:
    """Keys (n x BANDS, int64) of the bands of signatures; the number of the band is part of its key."""
    total = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(signed), BANDS)).copy()
    for row in range(BAND_ROWS):
        total = mixed(total ^ signed[:, row::BAND_ROWS].astype(np.uint64))
    return total.view(np.int64)


def shingle_sets(column: pa.Array, size: int, hasher: WordHasher) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a column."""
    data, offsets = text_buffer(column)
    starts, _, words = hasher.words(data, offsets)
    cuts = np.searchsorted(starts, offsets)
    return [np.unique(windows(words[low:high], size)) for low, high in zip(cuts[:-1], cuts[1:])]


class _Features:
    """Per document: size and digest of its set, band keys, lowest bytes of its signature, and its text."""

    def __init__(self, size: int):
        self._size = size

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                yield self._rows(part.column(0), part.column(1), shingle_sets(part.column(1), self._size, hasher))

    def _rows(self, ids: pa.Array, texts: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(values) for values in sets], dtype=np.int64)
        full = np.flatnonzero(sizes)
        bands, marks = [None] * len(ids), [None] * len(ids)
        if len(full):
            signed = signatures(np.concatenate([sets[row] for row in full]), np.append(0, np.cumsum(sizes[full])))
            keys, low = band_keys(signed), signed.astype(np.uint8)
            for at, row in enumerate(full):
                bands[row], marks[row] = keys[at], low[at].tobytes()
        digests = [hashlib.blake2b(values.tobytes(), digest_size=16).digest() for values in sets]
        return pa.RecordBatch.from_arrays(
            [
                ids, pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary()), texts,
            ],
            names=[part.split(" ")[0] for part in _FEATURES.split(", ")],
        )


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose signatures (a_signature, b_signature) agree in ``AGREE`` coordinates or more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (
            np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint8).reshape(-1, COORDINATES)
            for name in ("a_signature", "b_signature")
        )
        alike = pa.array((left == right).sum(axis=1) >= AGREE)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(alike), batch.column("b").filter(alike)], names=["a", "b"])


class _Linked:
    """Pairs (a, b, a_text, b_text); keeps those whose whole sets have the wanted similarity."""

    def __init__(self, size: int, num: int, den: int):
        self._size, self._num, self._den = size, num, den

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                kept = []
                sides = (shingle_sets(part.column(name), self._size, hasher) for name in ("a_text", "b_text"))
                for one, other in zip(*sides):
                    common = len(np.intersect1d(one, other, assume_unique=True))
                    kept.append(self._den * common >= self._num * (len(one) + len(other) - common))
                alike = pa.array(kept, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(name).filter(alike) for name in "ab"], names=["a", "b"])


class _Shingles:
    """Classes of groups (main, rep, text) as (main, rep, shingles)."""

    def __init__(self, size: int):
        self._size = size

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                sets = [values.view(np.int64) for values in shingle_sets(part.column("text"), self._size, hasher)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("main"), part.column("rep"), pa.array(sets, pa.list_(pa.int64()))], names=["main", "rep", "shingles"]
                )


class _Corpus:
    """The written rows of the corpus and what is asked of them; ``rep`` names the first row of a class."""

    def __init__(self, rows: DataFrame, size: int, num: int, den: int):
        self._rows, self._size, self._num, self._den = rows.withColumnRenamed("row", "rep"), size, num, den

    def _sides(self, pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        left, right = (table.select(F.col("rep").alias(s), F.col(column).alias(f"{s}_{column}")).hint("merge") for s in "ab")
        return pairs.join(left, "a").join(right, "b")

    def texts(self, reps: DataFrame) -> DataFrame:
        return self._rows.select("rep", "text").join(reps.select("rep").distinct().hint("merge"), "rep", "left_semi")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Written table of the pairs (a, b) whose whole sets are similar enough."""
        alike = written(self._sides(pairs, self._rows, "signature").mapInArrow(_agreeing, "a long, b long"))
        ends = alike.select(F.col("a").alias("rep")).unionByName(alike.select(F.col("b").alias("rep")))
        texts = written(self.texts(ends))
        verify = _Linked(self._size, self._num, self._den)
        links = written(self._sides(alike, texts, "text").mapInArrow(verify, "a long, b long"))
        drop(alike, texts)
        return links

    def needed(self, left: str, right: str) -> str:
        """Smallest overlap of two sets of the wanted similarity, as SQL over their sizes."""
        return f"((({left} + {right}) * {self._num} + {self._num + self._den - 1}) div {self._num + self._den})"

    def near_sizes(self, left: str, right: str) -> str:
        return f"least({left}, {right}) * {self._den} >= greatest({left}, {right}) * {self._num}"

    def prefix_pairs(self, members: DataFrame) -> DataFrame:
        """Pairs (a, b) of a group's members (main, rep, n, component) that can still be similar.

        ``at`` is the place of a shingle in its set, rarest first; shingles that no other member holds come before
        all others, so ``shared`` is the most that can be common with any member.
        """
        texts = members.select("main", "rep").join(self.texts(members), "rep").select("main", "rep", "text")
        held = written(texts.mapInArrow(_Shingles(self._size), "main long, rep long, shingles array<long>"))
        spread = held.select("main", "rep", F.explode("shingles").alias("shingle"))
        often = spread.groupBy("main", "shingle").agg(F.count("*").alias("often")).where("often > 1").hint("merge")
        own = Window.partitionBy("main", "rep")
        placed = (
            spread.join(often, ["main", "shingle"])
            .withColumn("turn", F.row_number().over(own.orderBy("often", "shingle")))
            .withColumn("shared", F.count("*").over(own))
            .join(members, ["main", "rep"])
            .withColumn("at", F.expr("n - shared + turn - 1"))
            .where(f"at <= n - ((n * {self._num} + {self._den - 1}) div {self._den})")
            .select("main", "shingle", "rep", "n", "component", "shared", F.expr("n - at").alias("ahead"))
        )
        placed = written(placed)
        need = self.needed("a.n", "b.n")
        pairs = placed.where("component <> main").alias("a").join(placed.alias("b"), F.expr(
            "a.main = b.main and a.shingle = b.shingle and a.component <> b.component "
            f"and (b.component = b.main or a.rep < b.rep) and {self.near_sizes('a.n', 'b.n')} "
            f"and least(a.shared, b.shared) >= {need} and least(a.ahead, b.ahead) >= {need}"
        ))
        out = written(_ordered(pairs.select(F.col("a.rep").alias("x"), F.col("b.rep").alias("y"))))
        drop(held, placed)
        return out


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row (id_col, n_shingles, component_id, kept): the smallest id of the near copies that links lead to.

    Sets are distinct runs of ``size`` words (outside space and tab to carriage return, A-Z in lower case); a
    text with fewer words is one shingle. Two rows link when their sets have a similarity of ``num/den`` (0.8 or
    more) or are equal. A null, empty or blank text has no shingles, is linked with nothing and kept. Rows without
    an id take part; a group without any id has a null component_id and all its rows are kept. Rows with
    equal ids stay rows of their own, whether their texts are equal or not. Other columns are ignored; an empty
    table gives no rows.
    """
    if num < LEAST * den:
        raise ValueError(f"the bands are laid out for similarities of {LEAST} and more")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(source.mapInArrow(_Features(size), _FEATURES).withColumn("row", F.monotonically_increasing_id()))
    corpus = _Corpus(rows, size, num, den)
    reps = rows.where("n > 0").groupBy("digest").agg(F.min("row").alias("rep"))
    members = written(
        rows.select("row", "doc_id", "n", "digest").join(reps.hint("merge"), "digest", "left")
        .select("row", "doc_id", "n", F.coalesce("rep", "row").alias("rep"))
    )
    posted = written(
        rows.select("row", "n", F.explode("bands").alias("key"))
        .join(members.where("row = rep").select("row").hint("merge"), "row", "left_semi").withColumnRenamed("row", "rep")
    )

    # Every member of a bucket against the one that meets most classes in its buckets.
    sizes = posted.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").hint("merge")
    shared = written(posted.join(sizes, "key"))
    met = shared.groupBy("rep").agg(F.sum("many").alias("met"))
    leaders = shared.join(met, "rep").groupBy("key").agg(F.max(F.struct("met", F.expr("-rep").alias("back"), "n")).alias("lead"))
    first_pairs = (
        shared.join(leaders, "key").select("rep", "n", F.expr("-lead.back").alias("l_rep"), F.col("lead.n").alias("l_n"))
        .where(corpus.near_sizes("n", "l_n")).select(F.col("rep").alias("x"), F.col("l_rep").alias("y"))
    )
    tried = written(_ordered(first_pairs))
    found = corpus.links(tried)
    labels = components(found)

    # Buckets that still span several components: exact prefix join inside the groups of their largest components.
    lists = written(
        shared.select("key", "rep", "n").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    mains = (
        lists.groupBy("key", "component").agg(F.count("*").alias("many"))
        .groupBy("key").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("many", "component")).alias("main"))
        .where("parts > 1").select("key", "main")
    )
    groups = written(lists.join(mains, "key").select("main", "rep", "n", "component").distinct())
    left = written(corpus.prefix_pairs(groups).join(tried, ["a", "b"], "left_anti"))
    more = corpus.links(left)
    named = labels.select(F.col("node").alias("end"), F.col("component").alias("named"))
    joined = components(
        more.join(named, F.col("a") == F.col("end"), "left").select(F.coalesce("named", "a").alias("a"), "b")
        .join(named, F.col("b") == F.col("end"), "left").select("a", F.coalesce("named", "b").alias("b"))
    )

    grouped = written(
        members.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .withColumn("one", F.coalesce("component", "rep"))
        .join(joined.select(F.col("node").alias("one"), F.col("component").alias("two")), "one", "left")
        .select("doc_id", "n", F.coalesce("two", "one").alias("component"))
    )
    several = grouped.groupBy("component").agg(F.count("*").alias("many"), F.min("doc_id").alias("first")).where("many > 1")
    out = written(
        grouped.join(several.drop("many"), "component", "left")
        .select(
            F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
            F.coalesce("first", "doc_id").alias("component_id"),
        )
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )
    drop(rows, members, posted, shared, tried, found, labels, lists, groups, left, more, joined, grouped)
    return out
