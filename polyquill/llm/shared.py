"""How the operators find shared storage and send models to executors, and connected components on shared storage."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir.  Where that is unset, a local session (tests) gets a temporary one; a cluster raises."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="polyquill-"))
    return context.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this run's own intermediates, on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def shipped(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcasts a value of bounded size with its classes, so executors need no copy of this package; the result fetches it there."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, each with underscores added until no column has it in any case of letters."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """The same rows, stored in the shared folder: lineage ends there, and any executor can read them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key with at least this share of all rows is hot.  There are at most so many of them, so they may be broadcast; any other key has less than that share.
HOT_PARTS = 20_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node in edges (a, b: long): root is the least node of its connected component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), which need O(log^2 n) rounds.  All
    grouping is by minimum, so a node with very many edges is combined before it is shuffled; no adjacency
    list is ever built.  A node with many edges, such as the hub of a star, gets its minimum by broadcast (at most
    ``HOT_PARTS`` such nodes), so its edges stay where they are.  Each round is cut with a checkpoint.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sums = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40)).alias("s")]
    size = e.agg(*sums).first()
    for _ in range(rounds):
        ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")
        least = e.select(ends).select("x.*").groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k")).select("a", F.least("a", "m").alias("m"), (F.col("k") * HOT_PARTS >= 2 * size.n).alias("hot"))
        # large star: every larger neighbour of a node points at the node's least neighbour
        larger = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        hot = F.broadcast(least.where("hot").select("a", "m"))
        cold = larger.join(hot.select("a"), "a", "left_anti").join(least.where("not hot").select("a", "m"), "a")
        large = larger.join(hot, "a").unionByName(cold).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every smaller neighbour, and in place of the least one the node, points at the least one; dealt out once for both sides of the join
        large = large.where("a <> b").distinct().repartition("a")
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        new = cut(small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct())
        before, size = size, new.agg(*sums).first()
        e = new
        if before == size:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
