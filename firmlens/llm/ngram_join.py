"""N-gram Jaccard join: documents whose sets of word shingles are similar.

Method: rare-first prefix filtering. Every document's distinct shingles are ordered by their document
frequency in the whole corpus, rarest first, ties by hash. Two sets of Jaccard similarity t or more share a
shingle among the first ``n - ceil(t n) + 1`` of each, so only those prefixes are joined, under the length
filter, the positional filter (what can still be shared from this position on) and the suffix filter (a
lower bound of the Hamming distance from counts per hash range). Pairs are verified once, on whole sets.

How it scales: frequencies need every shingle once. Each task takes a chunk of documents (a bounded number of
shingles), sorts its hashes and sends one compact slice per hash bucket; the number of buckets follows the
corpus, so a bucket stays small, and a shingle that many documents of a chunk hold is sent once with a count.
The bucket answers with the frequency of the shingles that occur twice or more. A shingle that occurs once
can match nothing, so a document whose prefix holds only such ones leaves the job there; the sets of the others
are written, without shingles that occur once, and all later steps are narrow joins.

Components: equal sets are one class. A first round links the members of every prefix list to one
member with few shingles of its own; only pairs whose ends are still in different components are then
joined and verified. Pairs inside a component cannot change it, so a large group of near copies costs its size, not
its square.

Shingles are compared by hashes of 40 bits and more within their bucket of a 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import components, drop, release, written
from firmlens.llm.shingles import WordHasher, text_buffer, windows

#: Bits of a shingle hash kept inside a bucket.
LOW_BITS = 40
#: A chunk is closed at this many shingles (8 MB of hashes) or documents.
CHUNK_SHINGLES = 1 << 20
CHUNK_DOCS = 50_000
#: A shingle held by more documents of a chunk is sent once with its count; the chunk keeps the list.
LOCAL_HOT = 64
#: Characters of text per hash bucket of the frequency exchange.
BUCKET_CHARS = 8 << 20
#: Hash ranges of the suffix filter, eight bits each.
RANGES = 32

_SLICES = "kind int, key long, chunk long, deltas binary, wide boolean, owners binary, hot binary, counts binary, meta binary"
_REPLIES = "chunk long, kind int, key long, deltas binary, wide boolean, owners binary, classes binary, hot binary, meta binary"
_SETS = "id long, n int, digest binary, r int, prefix array<long>, tokens binary, h0 long, h1 long, h2 long, h3 long"


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {
        "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(),
        "array<long>": pa.list_(pa.int64()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split(" ") for part in ddl.split(", "))])


def _encoded(values: np.ndarray) -> tuple[bytes, bool]:
    """Ascending values as differences of four bytes, or of eight where one does not fit."""
    deltas = np.diff(values, prepend=np.uint64(0))
    wide = bool(len(deltas)) and int(deltas.max()) >> 32 != 0
    return deltas.astype(np.uint64 if wide else np.uint32).tobytes(), wide


def _decoded(data: bytes, wide: bool) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype=np.uint64 if wide else np.uint32), dtype=np.uint64)


class _Chunks:
    """Documents of a task in chunks of bounded size; each chunk becomes slices by bucket and one meta row."""

    def __init__(self, size: int, bits: int, lower: bool):
        self._size, self._bits = size, bits
        self._hasher = WordHasher(lower)
        self._schema = _arrow_schema(_SLICES)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sets: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                data, offsets = text_buffer(part.column(1))
                starts, _, words = self._hasher.words(data, offsets)
                cuts = np.searchsorted(starts, offsets)
                for row, doc in enumerate(part.column(0).to_pylist()):
                    ids.append(doc)
                    sets.append(np.unique(windows(words[cuts[row] : cuts[row + 1]], self._size)))
                    held += len(sets[-1])
                    if held >= CHUNK_SHINGLES or len(ids) >= CHUNK_DOCS:
                        yield self._chunk(ids, sets)
                        ids, sets, held = [], [], 0
        if ids:
            yield self._chunk(ids, sets)

    def _chunk(self, ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        digests = [hashlib.blake2b(values.tobytes(), digest_size=16).digest() for values in sets]
        first: dict[bytes, int] = {}
        for row in sorted(range(len(ids)), key=ids.__getitem__):
            first.setdefault(digests[row], row)
        sent = [row for row in sorted(first.values()) if len(sets[row])]
        tokens = np.concatenate([sets[row] for row in sent]) if sent else np.zeros(0, np.uint64)
        owners = np.repeat(np.array(sent, dtype=np.uint16), [len(sets[row]) for row in sent])
        tokens >>= np.uint64(64 - LOW_BITS - self._bits)
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], owners[order]
        begins = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] + np.uint64(1))) if len(tokens) else np.zeros(0, int)
        counts = np.diff(begins, append=len(tokens))
        hot = counts > LOCAL_HOT
        is_hot = np.repeat(hot, counts)
        hot_tokens, hot_counts, hot_owners = tokens[begins[hot]], counts[hot], owners[is_hot]
        tokens, owners = tokens[~is_hot], owners[~is_hot]
        edges = np.arange((1 << self._bits) + 1, dtype=np.uint64) << np.uint64(LOW_BITS)
        cuts, hot_cuts = np.searchsorted(tokens, edges), np.searchsorted(hot_tokens, edges)
        low = np.uint64((1 << LOW_BITS) - 1)
        name = hashlib.blake2b(np.array(ids, dtype=np.int64).tobytes() + b"".join(digests), digest_size=8).digest()
        chunk = int.from_bytes(name, "little", signed=True)
        rows = []
        for bucket in range(1 << self._bits):
            a, b, c, d = cuts[bucket], cuts[bucket + 1], hot_cuts[bucket], hot_cuts[bucket + 1]
            if a == b and c == d:
                continue
            deltas, wide = _encoded(tokens[a:b] & low)
            rows.append((
                0, bucket, chunk, deltas, wide, owners[a:b].tobytes(),
                (hot_tokens[c:d] & low).tobytes(), hot_counts[c:d].astype(np.uint32).tobytes(), None,
            ))
        own = np.zeros(len(ids), dtype=np.uint8)
        own[sent] = 1
        meta = [
            np.array([len(rows), len(ids), len(hot_tokens)], dtype=np.int64), np.array(ids, dtype=np.int64),
            np.array([len(values) for values in sets], dtype=np.int32), own, np.frombuffer(b"".join(digests), np.uint8),
            hot_tokens, hot_counts.astype(np.int64), hot_owners,
        ]
        rows.append((1, ~(chunk & 0x7FFFFFFFFFFFFFFF), chunk, None, None, None, None, None, b"".join(x.tobytes() for x in meta)))
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*rows), self._schema.types)], schema=self._schema
        )


def _frequencies(table: pa.Table) -> pa.Table:
    """One bucket: how many documents hold each shingle, answered to every slice for those held twice or more."""
    schema = _arrow_schema(_REPLIES)
    rows = table.to_pylist()
    out = [(r["chunk"], 1, r["key"], None, None, None, None, None, r["meta"]) for r in rows if r["kind"] == 1]
    rows = [r for r in rows if r["kind"] == 0]
    if rows:
        plain = [_decoded(r["deltas"], r["wide"]) for r in rows]
        hot = [np.frombuffer(r["hot"], dtype=np.uint64) for r in rows]
        sizes, hot_sizes = [len(x) for x in plain], [len(x) for x in hot]
        tokens = np.concatenate(plain + hot)
        weights = np.concatenate(
            [np.ones(sum(sizes), dtype=np.uint32)] + [np.frombuffer(r["counts"], dtype=np.uint32) for r in rows]
        )
        order = np.argsort(tokens, kind="stable")
        ordered = tokens[order]
        begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        held = np.add.reduceat(weights[order].astype(np.int64), begins)
        classes = np.empty(len(tokens), dtype=np.uint8)
        classes[order] = np.repeat(
            np.minimum(255, np.floor(6 * np.log2(held))).astype(np.uint8), np.diff(begins, append=len(ordered))
        )
        at, hot_at = 0, sum(sizes)
        for row, values, size, hot_size in zip(rows, plain, sizes, hot_sizes):
            kind = classes[at : at + size]
            again = kind > 0
            deltas, wide = _encoded(values[again])
            owners = np.frombuffer(row["owners"], dtype=np.uint16)[again]
            hot_kind = classes[hot_at : hot_at + hot_size]
            out.append((row["chunk"], 0, row["key"], deltas, wide, owners.tobytes(), kind[again].tobytes(), hot_kind.tobytes(), None))
            at, hot_at = at + size, hot_at + hot_size
    return pa.Table.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out), schema.types)], schema=schema)


class _Sets:
    """One chunk with the answers of all buckets: every document with its repeated shingles, rarest first."""

    def __init__(self, num: int, den: int):
        self._num, self._den = num, den

    def __call__(self, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        heads = [r for r in rows if r["kind"] == 1]
        rows = sorted((r for r in rows if r["kind"] == 0), key=lambda r: r["key"])
        meta = heads[0]["meta"] if heads else b""
        sent, docs, hot = np.frombuffer(meta, np.int64, 3) if heads else (-1, 0, 0)
        if not heads or sent * len(heads) != len(rows):
            raise RuntimeError("the documents changed while they were read: a chunk and its slices differ")
        if len(heads) > 1:  # equal rows in equal order in another chunk: the same sets and answers again
            rows = rows[:: len(heads)]
        at = 24
        parts = []
        for kind, count in ((np.int64, docs), (np.int32, docs), (np.uint8, docs), (np.uint8, 16 * docs), (np.uint64, hot), (np.int64, hot)):
            parts.append(np.frombuffer(meta, kind, count, at))
            at += parts[-1].nbytes
        ids, sizes, own, digests, hot_tokens, hot_counts = parts
        hot_owners = np.frombuffer(meta, np.uint16, -1, at) if at < len(meta) else np.zeros(0, np.uint16)
        high = [np.uint64(r["key"] << LOW_BITS) for r in rows]
        empty = [np.zeros(0, np.uint64)]
        tokens = np.concatenate([_decoded(r["deltas"], r["wide"]) | top for r, top in zip(rows, high)] + empty + [np.repeat(hot_tokens, hot_counts)])
        owners = np.concatenate([np.frombuffer(r["owners"], np.uint16) for r in rows] + [hot_owners]).astype(np.int64)
        hot_classes = np.frombuffer(b"".join(r["hot"] for r in rows), np.uint8)
        classes = np.concatenate([np.frombuffer(r["classes"], np.uint8) for r in rows] + [np.repeat(hot_classes, hot_counts)])
        order = np.lexsort((tokens, classes, owners))
        tokens, owners = tokens[order].astype(np.int64), owners[order]
        cuts = np.searchsorted(owners, np.arange(docs + 1))
        repeated = np.diff(cuts)
        least = -(-self._num * sizes.astype(np.int64) // self._den)
        shown = np.where((own == 1) & (sizes > 0), repeated - least + 1, 0)  # prefix, without shingles that occur once
        counts = np.zeros((docs, RANGES), dtype=np.int64)
        np.add.at(counts, (owners, tokens & (RANGES - 1)), 1)
        packed = np.minimum(counts, 255).astype(np.uint8).view(np.int64) if docs else np.zeros((0, 4), np.int64)
        out = []
        for _ in heads:
            for row in range(docs):
                mine = tokens[cuts[row] : cuts[row + 1]]
                given = shown[row] > 0
                out.append((
                    int(ids[row]), int(sizes[row]), digests[16 * row : 16 * row + 16].tobytes(), int(repeated[row]),
                    mine[: shown[row]] if given else None, mine.tobytes() if given else None, *map(int, packed[row]),
                ))
        schema = _arrow_schema(_SETS)
        return pa.Table.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out), schema.types)], schema=schema)


def shingle_sets(docs: DataFrame, size: int, num: int, den: int, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table of documents with the shingles they share with others; rows without an id are left out."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    chars = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(2, min(24, (int(chars) // BUCKET_CHARS).bit_length()))
    slices = source.mapInArrow(_Chunks(size, bits, lower), _SLICES)
    replies = slices.groupBy("key").applyInArrow(_frequencies, _REPLIES)
    finish = _Sets(num, den)

    def finished(table: pa.Table) -> pa.Table:
        return finish(table)

    table = written(replies.groupBy("chunk").applyInArrow(finished, _SETS))
    release(docs.sparkSession)
    return table


def _needed(num: int, den: int, left: str, right: str) -> str:
    """Smallest overlap of two sets of that similarity, as SQL over their sizes."""
    return f"((({left} + {right}) * {num} + {num + den - 1}) div {num + den})"


def _filters(num: int, den: int, a: str, b: str) -> str:
    """Length, positional and suffix filter between two postings, as SQL."""
    need = _needed(num, den, f"{a}.n", f"{b}.n")
    apart = " + ".join(
        f"abs((shiftrightunsigned({a}.h{k}, {8 * j}) & 255) - (shiftrightunsigned({b}.h{k}, {8 * j}) & 255))"
        for k in range(4) for j in range(8)
    )
    return (
        f"least({a}.n, {b}.n) * {den} >= greatest({a}.n, {b}.n) * {num} and least({a}.ahead, {b}.ahead) >= {need} "
        f"and {a}.r + {b}.r - ({apart}) >= 2 * {need}"
    )


_POSTING = ("token", "id", "n", "r", "ahead", "h0", "h1", "h2", "h3")


def _postings(canonical: DataFrame) -> DataFrame:
    """One row per prefix shingle: ``ahead`` counts the shingles from this one on that others hold too."""
    rows = canonical.select("id", "n", "r", "h0", "h1", "h2", "h3", F.posexplode("prefix").alias("at", "token"))
    return rows.withColumn("ahead", F.col("r") - F.col("at")).select(*_POSTING)


class _Verify:
    """Pairs with both sets; keeps those that are similar enough."""

    def __init__(self, num: int, den: int):
        self._num, self._den = num, den

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            kept = []
            for a, b, n, m, x, y in zip(*(table[k] for k in ("a", "b", "a_n", "b_n", "a_tokens", "b_tokens"))):
                left, right = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                common = len(np.intersect1d(left, right, assume_unique=True))
                if self._den * common >= self._num * (n + m - common):
                    kept.append((a, b, common, n + m - common))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[k] for row in kept], pa.int64()) for k in range(4)], names=["a", "b", "common", "joined"]
            )


def _verified(pairs: DataFrame, canonical: DataFrame, num: int, den: int) -> DataFrame:
    left, right = (
        canonical.select(F.col("id").alias(s), F.col("n").alias(f"{s}_n"), F.col("tokens").alias(f"{s}_tokens")) for s in "ab"
    )
    return pairs.join(left, "a").join(right, "b").mapInArrow(_Verify(num, den), "a long, b long, common long, joined long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()


def _classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every document with its class (``rep``, the smallest id of equal sets), and one row per class with a prefix."""
    reps = sets.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"))
    narrow = sets.select("id", "n", "digest").join(reps, "digest", "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    canonical = sets.where("prefix is not null").join(reps, "digest").where("id = rep").dropDuplicates(["id", "digest"])
    return narrow, canonical.drop("digest", "rep")


def jaccard_pairs(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All similar pairs between classes of equal sets: (a, b, common, joined), a < b the smallest ids of their classes.

    ``joined`` is the size of the union. Null and empty texts, and rows without an id, are in no pair.
    """
    sets = shingle_sets(docs, size, num, den, lower, id_col, text_col)
    canonical = written(_classes(sets)[1])
    postings = _postings(canonical)
    pairs = (
        postings.alias("a").join(postings.alias("b"), F.expr(f"a.token = b.token and a.id < b.id and {_filters(num, den, 'a', 'b')}"))
        .select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    )
    return _verified(_ordered(pairs), canonical, num, den)


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document (id_col, n_shingles, component_id): the smallest id that a chain of similar pairs reaches.

    ``num``/``den`` is the least similarity. Words are runs outside space and tab to carriage return, A-Z in
    lower case if ``lower``; a text with fewer than ``size`` words is one shingle. A null, empty or blank text has
    no shingles and is linked with nothing. Rows without an id are left out; equal rows give equal rows; other
    columns are ignored. An empty table gives no rows.
    """
    sets = shingle_sets(docs, size, num, den, lower, id_col, text_col)
    narrow, canonical = _classes(sets)
    canonical = written(canonical)
    postings = _postings(canonical)
    hubs = (
        postings.groupBy("token")
        .agg(F.count("*").alias("many"), F.min_by(F.struct(*_POSTING[1:]), F.struct(F.expr("(n - r) / n"), "id")).alias("hub"))
        .where("many > 1").select("token", "hub")
    )
    near = (
        postings.alias("p").join(hubs, "token").where(F.expr(f"id <> hub.id and {_filters(num, den, 'p', 'hub')}"))
        .select(F.col("hub.id").alias("x"), F.col("id").alias("y"))
    )
    tried = written(_ordered(near))
    found = written(_verified(tried, canonical, num, den).select("a", "b"))
    first = components(found)
    lists = written(
        postings.join(hubs.select("token"), "token")
        .join(first.select(F.col("node").alias("id"), "component"), "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    parts = lists.groupBy("token", "component").agg(F.count("*").alias("many"))
    mains = (
        parts.groupBy("token").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("many", "component")).alias("main"))
        .where("parts > 1").select("token", "main")
    )
    split = lists.join(mains, "token")
    cross = (
        split.where("component <> main").alias("a").join(split.alias("b"), F.expr(
            "a.token = b.token and a.component <> b.component and (b.component = b.main or a.id < b.id) "
            f"and {_filters(num, den, 'a', 'b')}"
        )).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    )
    rest = written(_ordered(cross).join(tried, ["a", "b"], "left_anti"))
    more = written(_verified(rest, canonical, num, den).select("a", "b"))
    second = components(
        more.join(first.select(F.col("node").alias("a"), F.col("component").alias("a_in")), "a", "left")
        .join(first.select(F.col("node").alias("b"), F.col("component").alias("b_in")), "b", "left")
        .select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
    )
    out = written(
        narrow.join(first.select(F.col("node").alias("rep"), F.col("component").alias("one")), "rep", "left")
        .withColumn("one", F.coalesce("one", "rep"))
        .join(second.select(F.col("node").alias("one"), F.col("component").alias("two")), "one", "left")
        .select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("two", "one").alias("component_id"))
    )
    drop(sets, canonical, tried, found, lists, rest, more, first, second)
    return out
