"""Reachability over reference edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuebase.sources.shared import materialise

#: Tables that the nodes seen may consist of before they are put into one.
PARTS_MOST = 32


def reachable(edges: DataFrame, roots: DataFrame, hops: int = 4) -> DataFrame:
    """edges (src, dst), roots (node): every node that can be reached.

    A frontier loop: each round follows the newest nodes a few hops and is written out, so plans stay short and cycles end.
    It takes as many rounds as the farthest node is away, by hops.
    """
    edges = materialise(edges.where("src is not null and dst is not null").distinct())
    seen = newest = materialise(roots.where("node is not null").distinct())
    parts = 1
    while not newest.isEmpty():
        step, found = newest, None
        for _ in range(hops):
            step = edges.join(step.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
            found = step if found is None else found.unionByName(step)
        newest = materialise(found.distinct().join(seen, "node", "left_anti"))
        seen, parts = seen.unionByName(newest), parts + 1
        if parts == PARTS_MOST:
            seen, parts = materialise(seen), 1
    return seen
