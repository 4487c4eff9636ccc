"""Helpers shared by the operators of this package: written tables, model files, links."""

from __future__ import annotations

import gc
from collections.abc import Iterable
from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.session import cut_lineage

#: Model files larger than this are refused instead of being broadcast.
MODEL_BYTES = 64 << 20


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe from lost executors."""
    return cut_lineage(df)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished jobs; call it after a table was written.

    The session holds on to its last execution, so a tiny one takes that place first.
    """
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Delete the folders of tables made by ``written`` that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            if not folder.rsplit("/", 1)[-1].startswith("tables-"):
                continue
            path = hadoop(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def model_file(spark: SparkSession, path: str) -> Broadcast:
    """Bytes of a tokenizer file for the executors, which do not see the driver's folders."""
    size = Path(path).stat().st_size
    if size > MODEL_BYTES:
        raise ValueError(f"{path} has {size} bytes; at most {MODEL_BYTES} are broadcast")
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def no_rows(df: DataFrame) -> bool:
    return df.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """Connected components: (node, component) for every end of a link (a, b); component is the smallest node.

    Every round hooks each node to its smallest neighbour, follows that pointer once more, and contracts
    the links, so their number falls at least by half; each round is written as a table. The smallest node
    of a component is never hooked to another one, so the last label is the smallest. Nulls link nothing.
    """
    ends = links.select("a", "b").where("a <> b")
    edges = written(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    while not no_rows(edges):
        hooked = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        target = hooked.select(F.col("a").alias("p"), F.col("p").alias("q"))
        parents = written(hooked.join(target, "p").select("a", F.least("p", "q").alias("to")))
        left, right = (parents.select(F.col("a").alias(side), F.col("to").alias(f"{side}_to")) for side in "ab")
        contracted = (
            edges.join(left, "a").join(right, "b").where("a_to <> b_to")
            .select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct()
        )
        step = parents.select(F.col("a").alias("component"), "to")
        fresh = written(
            labels.join(step, "component", "left")
            .select("node", F.coalesce("to", "component").alias("component"))
        )
        shorter = written(contracted)
        drop(edges, parents, *([labels] if len(labels.inputFiles()) and labels is not edges else []))
        edges, labels = shorter, fresh
    return labels


def columns_only(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The named columns, so that further columns with clashing names never meet those of an operator."""
    return df.select(*names)
