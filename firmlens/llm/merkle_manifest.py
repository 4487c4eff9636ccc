"""Merkle manifest of a table: digests of rows, groups and the whole, and a proof for every row.

Method: leaves are digests of rows, in ascending order per group; every ``FAN`` consecutive nodes are hashed to
their parent until one node is left, the subroot of the group; subroots in order of their groups form a tree of their
own, up to the root. Proofs come from pointer jumping: each inner node starts with a pointer to its parent and the segment of
its siblings on that level. A round joins the table of pointers with itself, so every node reaches the ancestor of its
ancestor and appends that one's segment; distances double until all first-level nodes point to the root. A leaf's proof is
its own siblings followed by the segments of its run, so only an eighth of the rows is ever joined, and of the inner
nodes only those that a later round can reach are carried.

How it scales: texts are read once for the digests; all else works on 64-byte digests. Positions in a group come from a
range sort and counts per partition, so a group of any share of the rows, equal rows among them, is spread evenly. The
driver sees the largest group's size and the root. Pointers of a large group end in one node of the upper tree; that side
of the join is one row per node, so Spark broadcasts it by its size or splits the other side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.llm.common import drop, written

#: Children of a node.
FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Tree of the subroots; group keys begin with "=" or are "-".
_UPPER = "^"
_STEP = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value as it enters a row's digest: its length in UTF-8 bytes, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated texts."""
    return F.sha2(F.concat(*parts), 256)


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a proof, level by level and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def _up(place: str) -> Column:
    return F.expr(f"{place} div {FAN}")


def _above(count: str) -> Column:
    return F.expr(f"({count} + {FAN - 1}) div {FAN}")


def _name(level: Column, place: Column, tree: Column) -> Column:
    return F.concat_ws(":", level.cast("string"), place.cast("string"), tree)


def _positions(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, the place in their ``tree`` by ``order``, and ``total``, the size of the tree."""
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    at = F.monotonically_increasing_id()
    placed = written(ranged.withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)))
    parts = placed.groupBy("tree", "_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_many"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "tree", "_part", "_low", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_before"),
        F.sum("_many").over(tree).alias("total"),
    )
    joined = placed.join(parts, ["tree", "_part"]).withColumn("pos", F.expr("_at - _low + _before"))
    return joined.drop("_at", "_part", "_low", "_before")


def _siblings(digests: str, at: str) -> Column:
    return F.expr(
        f"named_struct('left', array_join(slice({digests}, 1, {at}), ''), "
        f"'right', array_join(slice({digests}, {at} + 2, {FAN}), ''))"
    )


def _levels(nodes: DataFrame, level: int, most: int) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """Build trees from their lowest nodes (tree, name, pos, cnt, digest) upwards; ``most`` is the largest cnt.

    Returns the pointers to parents of every level (name, level, upper, up, path), the top node of every
    tree (tree, name, digest) and the written tables in use.
    """
    pointers, tops, tables = [], [], []
    while True:
        tops.append(nodes.where("cnt = 1").select("tree", "name", "digest"))
        if most <= 1:
            break
        runs = written(
            nodes.where("cnt > 1").groupBy("tree", _up("pos").alias("up"))
            .agg(F.first("cnt").alias("cnt"), F.sort_array(F.collect_list(F.struct("pos", "name", "digest"))).alias("kids"))
        )
        tables.append(runs)
        parent = _name(F.lit(level + 1), F.col("up"), F.col("tree"))
        pointers.append(
            runs.select("kids", "tree", parent.alias("up"), F.posexplode("kids").alias("at", "kid"))
            .select(
                "kid.name", F.lit(level).alias("level"), (F.col("tree") == _UPPER).alias("upper"), "up",
                F.array(_siblings("kids.digest", "at")).cast(_STEP).alias("path"),
            )
        )
        nodes = runs.select(
            "tree", parent.alias("name"), F.col("up").alias("pos"), _above("cnt").alias("cnt"),
            digest(F.array_join("kids.digest", "")).alias("digest"),
        )
        level, most = level + 1, -(-most // FAN)
    return pointers, reduce(DataFrame.unionByName, tops), tables


def _jumped(pointers: DataFrame, root: str, depth: int) -> DataFrame:
    """Written table of first-level nodes (name, path) with their whole proofs, by doubling the distance."""
    jumps, reach = written(pointers), 1
    while reach < depth:
        target = jumps.select(F.col("name").alias("up"), F.col("up").alias("further"), F.col("path").alias("more"))
        reach *= 2
        needed = F.col("upper") | ((F.col("level") - 1) % reach == 0)
        carried = jumps.where(needed)
        done = carried.where(F.col("up") == root)
        moved = (
            carried.where(F.col("up") != root).join(target, "up")
            .select("name", "level", "upper", F.col("further").alias("up"), F.concat("path", "more").alias("path"))
        )
        longer = written(done.unionByName(moved))
        drop(jumps)
        jumps = longer
    return jumps


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group_col: str = "lang", order_col: str = "doc_id", claims: Mapping[str, Column] | None = None) -> DataFrame:
    """Per row (order_col, leaf, claimed, subroot, root, path): its digest and the proof that it is in the table.

    ``leaf`` is the digest of the row's ``fields``; ``claimed`` is the digest of the same row with the values of ``claims`` in
    place of its own, which is what ``folded`` and ``path`` test against ``root``. ``path`` holds, level by level,
    the concatenated digests of the siblings to the left and to the right.

    Nulls are values: a null group is a group of its own and comes first, null ids come first in their group. Rows with equal
    ids are ordered by their digests, and equal rows are leaves of their own. Texts may be empty or of any length. Other columns are
    ignored. A group of one row has that leaf as its subroot, and one group's subroot is the root. An empty table gives no rows.
    """
    claimed = {name: (claims or {}).get(name, F.col(name)) for name in fields}
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-")).alias("tree"), F.col(order_col).alias("id"),
        digest(*(field(F.col(name)) for name in fields)).alias("leaf"),
        digest(*(field(claimed[name]) for name in fields)).alias("claimed"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = written(rows.withColumn("claimed", F.when(F.col("claimed") != F.col("leaf"), F.col("claimed"))))
    runs = written(
        _positions(leaves, ["id", "leaf", "row"])
        .groupBy("tree", _up("pos").alias("pos"))
        .agg(F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("pos", "id", "leaf", "claimed"))).alias("kids"))
    )
    most = runs.agg(F.max(_above("total"))).first()[0] or 0
    lowest = runs.select(
        "tree", _name(F.lit(1), F.col("pos"), F.col("tree")).alias("name"), "pos", _above("total").alias("cnt"),
        F.when(F.col("total") == 1, F.col("kids")[0]["leaf"]).otherwise(digest(F.array_join("kids.leaf", ""))).alias("digest"),
    )
    pointers, subroots, tables = _levels(lowest, 1, most)
    subroots = written(subroots.withColumnRenamed("tree", "group").withColumn("tree", F.lit(_UPPER)))
    ordered = _positions(subroots, ["group"]).select("tree", "name", "pos", F.col("total").alias("cnt"), "digest")
    groups = subroots.count()
    more, root, upper = _levels(ordered, 0, groups)
    top = root.first()
    name, root_digest = (top["name"], top["digest"]) if top else ("", "")
    pointers += more
    own = runs.withColumn("name", _name(F.lit(1), F.col("pos"), F.col("tree")))
    nothing = F.array().cast(_STEP)
    if pointers:
        paths = _jumped(reduce(DataFrame.unionByName, pointers), name, len(pointers))
        own = own.join(paths.select("name", "path"), "name", "left").withColumn("path", F.coalesce("path", nothing))
    else:
        own = own.withColumn("path", nothing)
    first = F.when(F.col("total") == 1, nothing).otherwise(F.array(_siblings("kids.leaf", "at")).cast(_STEP))
    return (
        own.join(subroots.select(F.col("group").alias("tree"), F.col("digest").alias("subroot")), "tree")
        .select("kids", "total", "path", "subroot", F.posexplode("kids").alias("at", "kid"))
        .select(
            F.col("kid.id").alias(order_col), F.col("kid.leaf").alias("leaf"), F.coalesce("kid.claimed", "kid.leaf").alias("claimed"),
            "subroot", F.lit(root_digest).alias("root"), F.concat(first, "path").alias("path"),
        )
    )
