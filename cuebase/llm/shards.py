"""Sharding by Karmarkar-Karp differencing: tight byte balance for indivisible groups.

A group is all rows of one text (64-bit name); it stays in one shard.  A partial
partition holds one sum for each shard.  Differencing repeatedly takes the two
partial partitions of largest spread and adds them oppositely ordered, so that
the heavy end of one meets the light end of the other.

The groups are dealt by hash into blocks of bounded size; each block is
differenced in a task of its own and leaves one partial partition, and the
blocks' partitions are differenced again in the same way until one is left.  Nothing
grows with the input in one task or on the driver.

Defined cases: null text has no bytes and is grouped with the empty ones; size is bytes plus 1, so
every row weighs something; a group heavier than a shard's fair part gets a
shard to itself as far as differencing can; repeated rows are equal texts; rows
of a shard are numbered by hash, ties by id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuebase.llm.common import broadcast_if, materialise

#: Groups (or blocks) that one task differences.
BLOCK = 20_000
#: Rows of a bucket that are numbered together; most buckets whose counts are sent to every task.
NUMBERED, SENT_MOST = 50_000, 500_000


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over n partial partitions, sums (n, k).

    Returns (place, total): place[i, j] is the shard that takes sum j of item i.
    """
    n, k = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    state = [np.take(sums[i], order[i]) for i in range(n)]
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(state)]
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        s = state[a] + state[b][::-1]
        o = np.argsort(-s, kind="stable")
        merged.append((a, b, o))
        state[a] = state[b] = None
        s = s[o]
        state.append(s)
        heapq.heappush(heap, (-int(s[0] - s[-1]), len(state) - 1))
    label: dict[int, np.ndarray] = {len(state) - 1: np.arange(k)}
    for m in range(len(merged) - 1, -1, -1):
        a, b, o = merged[m]
        own = np.empty(k, dtype=np.int64)
        own[o] = label.pop(n + m)
        label[a], label[b] = own, own[::-1]
    place = np.empty((n, k), dtype=np.int64)
    for i in range(n):
        place[i, order[i]] = label[i]
    return place, state[-1]


def _dealt(k: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable")
        place, total = difference(np.array(pdf["sums"].tolist(), dtype=np.int64).reshape(len(pdf), k))
        return pd.DataFrame({"item": pdf["item"].to_numpy(), "block": key[0], "place": place.astype(np.int32).tolist(), "total": [total.tolist()] + [None] * (len(pdf) - 1)})

    return run


def balance(groups: DataFrame, shards: int, block: int = BLOCK) -> DataFrame:
    """(item, shard) for groups (item, weight)."""
    k = shards
    zeros = F.array_repeat(F.lit(0).cast("long"), k - 1)
    level = groups.select(F.col("item").cast("long").alias("item"), F.concat(F.array(F.col("weight").cast("long")), zeros).alias("sums"))
    n = groups.count()
    placed, first = None, None
    while True:
        blocks = max(1, -(-n // block))
        own = level.withColumn("block", F.pmod(F.xxhash64("item", F.lit(n)), F.lit(blocks)))
        dealt = materialise(own.groupBy("block").applyInPandas(_dealt(k), "item long, block long, place array<int>, total array<long>"), "blocks")
        here = dealt.select("item", "block", "place")
        if placed is None:
            placed = here.select("item", "block", F.col("place")[0].alias("shard"))
        else:
            up = broadcast_if(here.select(F.col("item").alias("block"), F.col("block").alias("next"), "place"), n, SENT_MOST)
            placed = placed.join(up, "block").select("item", F.col("next").alias("block"), F.element_at("place", F.col("shard") + 1).alias("shard"))
        if blocks == 1:
            return placed.select("item", "shard")
        level = dealt.where("total is not null").select(F.col("block").alias("item"), F.col("total").alias("sums"))
        n = blocks


def numbered(rows: DataFrame, by: str, spread: list[str], ties: list[str], n: int, values: int) -> DataFrame:
    """Add slot: a gapless number from 0 within each value of `by`, without one task per value."""
    buckets = 16 + n // NUMBERED
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*spread), F.lit(buckets)))
    counts = rows.groupBy(by, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(by, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(by, "bucket").orderBy(*spread, *ties)
    rows = rows.withColumn("place", F.row_number().over(inside).cast("long"))
    return rows.join(broadcast_if(base, values * buckets, SENT_MOST), [by, "bucket"]).withColumn("slot", F.col("base") + F.col("place") - 1).drop("bucket", "base", "place")


def shard_rows(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a struct of the columns of docs) with size, text_crc32, law, shard, slot, grown_shard (null under this law).

    Rows that share id and text are numbered by their other columns' hash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("item"))
    groups = materialise(facts.groupBy("item").agg(F.sum("size").alias("weight"), F.count("*").alias("rows")), "groups")
    placed = balance(groups, shards)
    rows = facts.join(broadcast_if(placed, groups.count(), SENT_MOST), "item").withColumn("tie", F.xxhash64("row"))
    total = groups.agg(F.sum("rows")).first()[0] or 0
    out = numbered(rows, "shard", ["id", "item"], ["size", "text_crc32", "tie"], total, shards)
    return out.select("row", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("item"))
    facts = materialise(facts, "rows")
    placed = balance(facts.groupBy("item").agg(F.sum("size").alias("weight")), shards)
    rows = facts.join(placed, "item")
    out = numbered(rows, "shard", ["id", "item"], ["size", "text_crc32"], facts.count(), shards)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
