"""Poisson replication, differencing and the pipeline."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from cuebase.llm import queries
from cuebase.llm.mixing import poisson_mix, temperature_weights
from cuebase.llm.shards import difference, shard_by_bytes


def drawn(name: str, rate: float, seed: int = 1) -> int:
    parts = max(1, math.ceil(rate / 256))
    total = 0
    for i in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}|{i}|{name}".encode()).hexdigest()[:13], 16) / (1 << 52)
        p = c = math.exp(-rate / parts)
        k = 0
        while c <= u and k < 2000:
            k += 1
            p = p * (rate / parts) / k
            c += p
        total += k
    return total


def test_mixing_equals_model(spark, docs, rows):
    size = lambda t: len((t or "").encode())
    total = Counter()
    for r in rows:
        total[r[3]] += size(r[1])
    weight = {s: math.sqrt(n) for s, n in total.items()}
    rate = {s: sum(total.values()) * weight[s] / sum(weight.values()) / n if n else 0.0 for s, n in total.items()}
    want = Counter()
    for r in rows:
        name = str(r[0]) if r[0] is not None else hashlib.md5((r[1] or "").encode()).hexdigest()
        k = drawn(name, rate[r[3]])
        if k:
            want[str(r[0]), r[1], k] += k
    got = poisson_mix(docs, temperature_weights(docs), seed=1).collect()
    assert Counter((str(r.doc_id), r.text, r.copies) for r in got) == want
    assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)


def test_large_rates(spark):
    df = spark.createDataFrame([(k, "ab", "a") for k in range(200)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 1.0), ("gone", 5.0)], "source string, weight double")
    mixed = poisson_mix(df, weights, budget=400 * 1000.0).groupBy("doc_id").count().collect()
    mean = sum(r["count"] for r in mixed) / 200
    assert abs(mean - 1000) < 12 and all(abs(r["count"] - 1000) < 200 for r in mixed)
    assert poisson_mix(df.limit(0), weights).count() == 0


def test_partitions_grow_with_the_bytes(spark, monkeypatch):
    """The order is one over all partitions, however many the planned bytes ask for."""
    from cuebase.llm import mixing

    monkeypatch.setattr(mixing, "PARTITION_BYTES", 100)
    df = spark.createDataFrame([(k, "ab" * 10, "a") for k in range(200)], "doc_id long, text string, source string")
    mixed = poisson_mix(df, temperature_weights(df))
    assert mixed.rdd.getNumPartitions() == 40
    keys = [r.shuffle_key for r in mixed.collect()]
    assert keys == sorted(keys) and 120 < len(keys) < 280


def test_mixing_equals_sql(same):
    same(queries.QUERIES["op10_source_mixing"], queries.ORACLES["op10_source_mixing"])


def test_difference_places_every_sum():
    rng = np.random.default_rng(2)
    sums = np.zeros((500, 4), dtype=np.int64)
    sums[:, 0] = rng.integers(1, 1000, 500)
    place, total = difference(sums)
    own = np.zeros(4, dtype=np.int64)
    for p, s in zip(place, sums, strict=True):
        assert sorted(p) == [0, 1, 2, 3]
        np.add.at(own, p, s)
    assert (own == total).all() and total.max() - total.min() <= 1


def test_difference_beats_known_case():
    place, total = difference(np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]], dtype=np.int64))
    assert sorted(total.tolist()) == [14, 16] and len(place) == 5


def test_shards(docs, rows, empty):
    got = shard_by_bytes(docs, 4).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert Counter((str(r.doc_id), r.size, r.text_crc32) for r in got) == Counter((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    where, slots = defaultdict(set), defaultdict(list)
    for r in got:
        where[r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_by_bytes(empty, 4).count() == 0


def test_shards_of_several_blocks(spark, data, monkeypatch):
    from cuebase.llm import shards

    monkeypatch.setattr(shards.balance, "__defaults__", (16,))
    got = queries.op6_sharding(spark, data).groupBy("shard").sum("size").collect()
    sums = [r["sum(size)"] for r in got]
    assert len(sums) == 16 and max(sums) - min(sums) <= 0.02 * max(sums) + 40_000


def test_pipeline(spark, data):
    import corpus_pipeline

    from cuebase.llm import toxicity
    from cuebase.llm.decontaminate import find_leaks
    from cuebase.llm.ngram_join import ngram_jaccard_join

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, data).cache()
        assert docs.columns == columns, name
        if name == "ngram_jaccard":
            groups = ngram_jaccard_join(before)
            assert docs.count() == groups.where("n_shingles = 0").count() + groups.where("n_shingles > 0").select("component_id").distinct().count()
        if name == "decontamination":
            leaks = {r.doc_id for r in find_leaks(before, spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()} - leaks
        if name == "toxicity":
            assert docs.count() >= 0.85 * n
    final = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert final.count() == docs.count() and toxicity.DIM > 0
