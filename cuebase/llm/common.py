"""Shared pieces of the training-data operators: tables, cut lineage, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuebase.sources.shared import materialise, release, shared_folder

__all__ = ["bounded_batches", "broadcast_if", "connected_components", "hash_sample", "materialise", "release", "sample_bound", "shared_folder", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most rows that Spark hands to Python at once.
BATCH_ROWS = 250


def bounded_batches(df: DataFrame) -> DataFrame:
    """Lower the session's Arrow batches to BATCH_ROWS rows of text, which bounds the memory of both sides of a Python step."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def sample_bound(most: int, n: int) -> int:
    """Of hashes below 2 ** 62, those below this bound are about `most` of n; it is above 0 at every n."""
    return max(1, (1 << 62) * most // max(n, most, 1))


def hash_sample(rows: DataFrame, pick: str, n: int, most: int) -> DataFrame:
    """About `most` of the n rows, chosen by the hash in column pick; all of them, if they are fewer."""
    return rows.where(F.pmod(pick, F.lit(1 << 62)) < F.lit(sample_bound(most, n))) if n > most else rows


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Hint a broadcast only if the counted rows stay within the stated bound; else Spark shuffles."""
    return F.broadcast(df) if rows <= most else df


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node id of each component of the undirected edges (a, b).

    Alternating large and small stars: each round points the larger
    neighbours of a node, then the smaller ones, at the least of them.  Every
    step is one aggregation and one join on a node with one row per node on
    one side, so a hub of any degree is split by Spark's skew join.  Nodes
    without an edge are absent.  Stops when the edge set does not change.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    stars = materialise(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if stars.isEmpty():
        return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    mark = None
    for _ in range(rounds):
        near = both(stars)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, stars = stars, materialise(small, "stars")
        release(before)
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
