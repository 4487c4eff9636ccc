"""Approximate nearest neighbours with balanced posting lists.

Centroids are fitted on a bounded sample; a small graph over them, held in memory by every task, finds the
centroids near a vector. A vector goes to the list of its nearest centroid, and near a border also to those almost
as near that lie in another direction. A query reads the lists whose centroids are within a ratio of its
nearest one (distance-ratio pruning), computes exact distances there, and its best are merged. The ratio is measured on
the sample, so clustered vectors read few lists and vectors without structure many.

How it scales: every vector is indexed. A list is cut into blocks by vector id, so a list that very many equal vectors
share is many groups of bounded size, and queries that meet in one list are cut into blocks as well; a block returns at
most k rows per query. The centroids that tasks hold are bounded by ``CENTROIDS_MOST``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmlens.llm.common import drop, written

#: Vectors that the centroids are fitted on, at most: those with the smallest hashes of their id.
SAMPLE = 20_000
#: Vectors per list that the number of centroids aims at, and centroids at most.
LIST_SIZE = 256
CENTROIDS_MOST = 8192
#: Rows of a block of a list, and queries that meet it at once.
BLOCK = 4096
QUERY_BLOCK = 512
#: Neighbours per centroid in the graph, and centroids kept during the walk of a vector and of a query; a query that needs
#: more is measured against all centroids.
EDGES = 16
BEAM, QUERY_BEAM = 64, 1024
#: A vector is copied to centroids within this ratio of its nearest, at most so many.
BORDER, COPIES = 1.10, 4
#: A query reads lists within a ratio of its nearest one, at least so many. The ratio is measured: it reaches this
#: share of the true neighbours of PROBES vectors of the sample.
LEAST, REACHED, PROBES = 8, 0.99, 512

_FOUND = "query_id long, vec_id long, score double"


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0.0)


def centroids(sample: np.ndarray, count: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means over the distinct vectors of a sample; empty centroids move to the vectors farthest from theirs."""
    sample = np.unique(sample, axis=0)
    count = max(1, min(count, len(sample)))
    centres = sample[np.random.default_rng(seed).choice(len(sample), count, replace=False)].copy()
    for _ in range(rounds):
        nearest, far = np.empty(len(sample), dtype=np.int64), np.empty(len(sample))
        for low in range(0, len(sample), 2048):
            apart = _squares(sample[low : low + 2048], centres)
            nearest[low : low + 2048], far[low : low + 2048] = apart.argmin(1), apart.min(1)
        sizes = np.bincount(nearest, minlength=count)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        full = sizes > 0
        centres[full] = sums[full] / sizes[full, None]
        lonely = np.argsort(-far, kind="stable")[: int((~full).sum())]
        centres[~full] = sample[lonely]
    return centres


@dataclass
class Graph:
    """Centroids with edges to near ones, and entry points spread over them."""

    points: np.ndarray
    edges: np.ndarray
    entries: np.ndarray

    @classmethod
    def over(cls, points: np.ndarray) -> Graph:
        width = min(EDGES, max(1, len(points) - 1))
        edges = np.zeros((len(points), width), dtype=np.int64)
        for low in range(0, len(points), 1024):
            apart = _squares(points[low : low + 1024], points)
            apart[np.arange(len(apart)), np.arange(low, low + len(apart))] = -1.0
            order = np.argpartition(apart, min(width, len(points) - 1), axis=1)[:, : width + 1]
            rank = np.argsort(np.take_along_axis(apart, order, 1), axis=1, kind="stable")
            edges[low : low + 1024] = np.take_along_axis(order, rank, 1)[:, 1 : width + 1] if len(points) > 1 else 0
        edges = cls._both_ways(edges)
        # far entry points: each next one is the farthest from those taken
        entries, apart = [0], _squares(points, points[:1])[:, 0]
        while len(entries) < min(24, len(points)):
            entries.append(int(apart.argmax()))
            apart = np.minimum(apart, _squares(points, points[entries[-1:]])[:, 0])
        reached = np.zeros(len(points), dtype=bool)  # centroids that no walk would come to are entry points too
        front = np.unique(entries)
        while True:
            reached[front] = True
            front = np.unique(edges[front])
            front = front[~reached[front]]
            if not len(front):
                lost = np.flatnonzero(~reached)
                if not len(lost):
                    break
                front = lost[:1]
                entries.append(int(lost[0]))
        return cls(points, edges, np.array(entries))

    @staticmethod
    def _both_ways(edges: np.ndarray) -> np.ndarray:
        """Edges in both directions, up to twice as many per centroid; nearer ends first, free places point to itself."""
        count, width = edges.shape
        ends = [dict.fromkeys(row) for row in edges.tolist()]
        for slot in range(width):
            for start, end in enumerate(edges[:, slot].tolist()):
                if len(ends[end]) < 2 * width and start != end:
                    ends[end].setdefault(start)
        out = np.repeat(np.arange(count)[:, None], 2 * width, axis=1)
        for start, own in enumerate(ends):
            out[start, : len(own)] = list(own)
        return out

    def near(self, vectors: np.ndarray, count: int, ratio: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Centroids near each vector, nearest first, and their distances: best-first walks of a whole batch at once.
        Centroids beyond ``ratio`` times the nearest distance are not walked on from."""
        size, beam = len(vectors), min(max(BEAM, count), len(self.points))
        start = np.argsort(_squares(vectors, self.points[self.entries]), axis=1, kind="stable")
        kept = np.full((size, beam), -1, dtype=np.int64)
        apart = np.full((size, beam), np.inf)
        done = np.zeros((size, beam), dtype=bool)
        seen = np.zeros((size, len(self.points)), dtype=bool)
        rows = np.arange(size)
        first = self.entries[start[:, : min(8, beam)]]
        kept[:, : first.shape[1]] = first
        apart[:, : first.shape[1]] = self._distances(vectors, first)
        seen[rows[:, None], first] = True
        while len(rows):
            limit = np.maximum(apart[rows, :1] * ratio * ratio, apart[rows, min(BEAM, beam) - 1][:, None])
            open_ = np.where(done[rows] | (kept[rows] < 0) | (apart[rows] > limit), np.inf, apart[rows])
            step = open_.argmin(1)
            live = np.isfinite(open_[np.arange(len(rows)), step])
            rows, step = rows[live], step[live]
            if not len(rows):
                break
            done[rows, step] = True
            next_ = self.edges[kept[rows, step]]
            fresh = ~seen[rows[:, None], next_]
            fresh &= next_ != kept[rows, step][:, None]
            seen[rows[:, None], next_] = True
            far = np.where(fresh, self._distances(vectors[rows], next_), np.inf)
            all_kept = np.concatenate([kept[rows], np.where(fresh, next_, -1)], axis=1)
            all_apart = np.concatenate([apart[rows], far], axis=1)
            all_done = np.concatenate([done[rows], ~fresh], axis=1)
            order = np.argsort(all_apart, axis=1, kind="stable")[:, :beam]
            kept[rows] = np.take_along_axis(all_kept, order, 1)
            apart[rows] = np.take_along_axis(all_apart, order, 1)
            done[rows] = np.take_along_axis(all_done, order, 1)
        order = np.argsort(apart, axis=1, kind="stable")[:, :count]
        return np.take_along_axis(kept, order, 1), np.sqrt(np.take_along_axis(apart, order, 1))

    def _distances(self, vectors: np.ndarray, places: np.ndarray) -> np.ndarray:
        return ((self.points[places] - vectors[:, None, :]) ** 2).sum(2)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


class _Post:
    """(list, id, vector) for every list a vector is kept in or, as a query, reads."""

    def __init__(self, graph: Graph, ratio: float | None = None):
        self._graph, self._ratio = graph, ratio

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = self._graph.points
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                vectors = _matrix(part.column(1), points.shape[1])
                if self._ratio is None:
                    near, _, chosen = copies(self._graph, vectors)
                    rows, slots = np.nonzero(chosen)
                    lists = near[rows, slots]
                else:
                    rows, lists = lists_to_read(self._graph, vectors, self._ratio)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists), part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows))],
                    names=["list", "id", "vector"],
                )


def lists_to_read(graph: Graph, vectors: np.ndarray, ratio: float, beam: int = QUERY_BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place of a query, list) of all lists within the ratio. A query whose walk keeps ``beam`` centroids and
    is still within the ratio at the last one is measured against every centroid instead, so none is cut off."""
    near, apart = graph.near(vectors, beam, ratio)
    chosen = (near >= 0) & ((apart <= ratio * apart[:, :1]) | (np.arange(near.shape[1])[None] < LEAST))
    wide = np.flatnonzero(chosen[:, -1]) if near.shape[1] < len(graph.points) else np.empty(0, dtype=np.int64)
    chosen[wide] = False
    rows, slots = np.nonzero(chosen)
    far = _squares(vectors[wide], graph.points)
    more, lists = np.nonzero(far <= ratio * ratio * far.min(1, keepdims=True)) if len(wide) else (wide, wide)
    return np.append(rows, wide[more]), np.append(near[rows, slots], lists)


def copies(graph: Graph, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Near centroids, their distances, and which of them keep a copy: the nearest, and others within the border that
    are nearer to the vector than to any chosen one."""
    near, apart = graph.near(vectors, 2 * COPIES)
    real, chosen = near >= 0, np.zeros(near.shape, dtype=bool)
    chosen[:, 0] = real[:, 0]
    for slot in range(1, near.shape[1]):
        fits = real[:, slot] & (apart[:, slot] <= BORDER * apart[:, 0]) & (chosen.sum(1) < COPIES)
        for other in range(slot):
            between = np.sqrt(((graph.points[near[:, slot]] - graph.points[near[:, other]]) ** 2).sum(1))
            fits &= ~(chosen[:, other] & (between < apart[:, slot]))
        chosen[:, slot] = fits
    return near, apart, chosen


def read_ratio(graph: Graph, sample: np.ndarray, k: int) -> float:
    """Ratio of distances that reaches REACHED of the k nearest of PROBES vectors within the sample."""
    sample = np.unique(sample, axis=0)
    if len(sample) < 2:
        return 1.0
    kept = [copies(graph, sample[low : low + 256]) for low in range(0, len(sample), 256)]
    near, chosen = np.concatenate([part[0] for part in kept]), np.concatenate([part[2] for part in kept])
    probes = np.linspace(0, len(sample) - 1, min(PROBES, len(sample))).astype(np.int64)
    ratios = []
    for probe in probes:
        apart = _squares(sample[probe : probe + 1], sample)[0]
        apart[probe] = np.inf
        best = np.argpartition(apart, min(k, len(apart) - 1) - 1)[:k]
        to_lists = np.sqrt(_squares(sample[probe : probe + 1], graph.points)[0])
        reach = np.where(chosen[best], to_lists[np.maximum(near[best], 0)], np.inf).min(1)
        ratios.extend(reach / max(to_lists.min(), 1e-12))
    return float(max(1.0, np.quantile(ratios, REACHED)))


def _nearest(width: int, k: int):
    """Exact distances of the queries of a group to the vectors of its block; the k best of each."""

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, held = left.column("id").to_numpy(), right.column("id").to_numpy()
        out = []
        if len(asked) and len(held):
            queries, vectors = _matrix(left.column("vector").combine_chunks(), width), _matrix(right.column("vector").combine_chunks(), width)
            for at in range(len(asked)):
                apart = np.sqrt(((vectors - queries[at]) ** 2).sum(1))
                apart[held == asked[at]] = np.inf
                if len(apart) > 4 * k:
                    edge = np.partition(apart, k)[k]
                    places = np.flatnonzero(apart <= edge)
                else:
                    places = np.arange(len(apart))
                best = places[np.lexsort((held[places], apart[places]))][:k]
                out.extend((int(asked[at]), int(held[p]), float(apart[p])) for p in best if np.isfinite(apart[p]))
        columns = list(zip(*out)) or [[], [], []]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "vec_id", "score"])

    return nearest


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the vectors that take part: of the most common length, all components finite, not all zero."""
    ok = F.expr(
        "id is not null and vector is not null and size(vector) > 0 and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity')) "
        "and exists(vector, x -> x <> 0)"
    )
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(ok)


def nearest_neighbours(
    vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every vector that ``is_query`` (a condition on ``id``) holds for, the k nearest
    others found, nearest first, ties to the smaller id; ``score`` is the Euclidean distance in double precision.

    Vectors that are null, zero, of another length than most, or hold a null or a number that is not finite, and
    rows without an id take no part. Of rows with equal ids the distinct vectors count, the nearest one gives the score.
    With k others or fewer all are found. Further columns are left out; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, total = sizes[0]["width"], sizes[0]["count"]
    rows = rows.where(F.size("vector") == width)
    sample = rows.select("vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()  # at most SAMPLE rows
    points = _matrix(sample.column(0).combine_chunks(), width)
    graph = Graph.over(centroids(points, min(CENTROIDS_MOST, len(points) // 4 + 1, -(-total // LIST_SIZE))))
    posted = written(rows.mapInArrow(_Post(graph), "list long, id long, vector array<double>"))
    asked = written(rows.where(is_query).mapInArrow(_Post(graph, read_ratio(graph, points, k)), "list long, id long, vector array<double>"))
    blocks = posted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    query_blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("query_blocks"))
    shape = blocks.join(query_blocks, "list")
    # a block of a list meets every block of the queries that read it
    held = posted.join(shape, "list").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn(
        "query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1))
    )
    sent = asked.join(shape, "list").withColumn("query_block", F.pmod(F.xxhash64("id", F.lit(1)), "query_blocks")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    keys = ["list", "block", "query_block"]
    met = sent.select(*keys, "id", "vector").groupBy(*keys).cogroup(held.select(*keys, "id", "vector").groupBy(*keys))
    found = met.applyInArrow(_nearest(width, k), _FOUND).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    drop(posted, asked)
    return out
