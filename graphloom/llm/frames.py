"""Shared helpers: reading tables, connected components; frozen() cuts lineage in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import drop_temporary, frozen, shared_dir

__all__ = ["components", "drop_temporary", "frozen", "partitions", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def _joined_with_least(frame: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """frame with m of its a; least: a, m and n, the number of frame's rows of a, of all a.

    Nodes of more than most rows are told to every task; since their rows are in frame, there are at most
    rows / most of them.  The others are joined by a shuffle in which no key has more rows than that.
    """
    hot = F.broadcast(least.where(F.col("n") > most).select("a", F.col("m").alias("hot")))
    marked = frame.join(hot, "a", "left")
    cold = marked.where("hot IS NULL").drop("hot").join(least.where(F.col("n") <= most).select("a", "m"), "a")
    return marked.where("hot IS NOT NULL").select("a", "b", F.col("hot").alias("m")).union(cold.select("a", "b", "m"))


def components(edges: DataFrame, most_rounds: int = 60, hub: int = 100_000) -> DataFrame:
    """Connected components of undirected edges (a, b): node and root, the smallest node reachable.

    Large-star and small-star steps in turn until the edges stay as they are.  Every step takes
    minima with partial aggregation before the shuffle and joins them back.  A node with over hub edges, and over a
    thousandth of all, is joined by a broadcast of at most 2000 such nodes, so no task gets all edges of a node.
    The state between steps is a table in the shared folder.
    Nodes without edges aren't in the result; self-loops and nulls are ignored, repeats allowed.
    """
    edges = frozen(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    total = edges.count()
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        most = max(hub, total // 1000)
        # Only a few tables have such a node; the plan for it is made if this one has.
        hubs = total > most and least.agg(F.max("n")).first()[0] > most
        star = _joined_with_least(both, least, most) if hubs else both.join(least.select("a", "m"), "a")
        large = star.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # What large-star leaves of a node with many smaller neighbours is their minima, mostly one.
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _joined_with_least(large, least, most) if hubs else large.join(least.select("a", "m"), "a")
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))
        edges = frozen(small.select(F.explode(pairs).alias("e")).select("e.a", "e.b").where("a <> b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        total = state[0]
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components didn't converge")
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
