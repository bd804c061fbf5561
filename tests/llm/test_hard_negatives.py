"""Hard-negative mining against a plain loop over all pairs; the parts of its index."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuebase.llm import hard_negatives, queries
from cuebase.llm.hard_negatives import Anchors, Bucket, bucket_row, integers, mine_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, row string, norm string, list int, score long"


def vectors(seed: int, n: int = 700) -> list[tuple]:
    """Clusters of near vectors, one very common vector, lengths of all sizes, ties, repeated rows, odd values."""
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    out = []
    for k in range(n):
        c = rnd.choice(centres)
        size = rnd.choice([0.1, 1, 1, 5])
        out.append((k, [size * (x + rnd.gauss(0, 0.15)) for x in c], rnd.randrange(4)))
    out += [(n + k, [1.0, 0.5, -0.25, 0.0, 0.0, 0.0, 0.0, 1.0], k % 3) for k in range(150)]
    out += [out[100], out[100], out[200]]
    out += [(5000, None, 1), (5100, [1.0, None], 1), (5200, [float("nan")], 1), (5300, [float("inf"), 1.0], 2), (5400, [1.0, 2.0], None), (None, [1.0, 2.0], 1)]
    out += [(5500, [], 1), (5600, [2.0, 1.0], 1), (5601, [0.0] * 8, 2), (5700, [0.0] * 8, 2), (5800, [-1.0] * 8, 9)]
    rnd.shuffle(out)
    return [(*r, "i", "r", "n", 1, None) for r in out]


def plain(rows, is_anchor, positives=5, negatives=10, band=(30, 90), scale=256) -> list[tuple]:
    own = [(r[0], r[2], [math.floor(scale * float(np.float32(x))) for x in r[1]]) for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    score = lambda a, b: max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a[2], b[2], strict=False))))
    out = []
    for i, a in enumerate(own):
        if not is_anchor(a[0]):
            continue
        scored = [(-score(a, b), b[0], b[1]) for j, b in enumerate(own) if j != i]
        for s, p, _ in sorted(x for x in scored if x[2] == a[1])[:positives]:
            inside = sorted(x for x in scored if x[2] != a[1] and band[0] * -s <= 100 * -x[0] <= band[1] * -s)[:negatives]
            out += [(a[0], p, k + 1, x[1], -s, -x[0]) for k, x in enumerate(inside)]
    return sorted(out)


def got(df) -> list[tuple]:
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize(("bucket", "slice_bytes"), [(2048, 16_000_000), (32, 1500)])
def test_equals_all_pairs(spark, bucket, slice_bytes, monkeypatch):
    """One bucket and one slice, and many of both."""
    monkeypatch.setattr(hard_negatives, "BUCKET", bucket)
    monkeypatch.setattr(hard_negatives, "BUCKET_LEAST", bucket // 4)
    monkeypatch.setattr(hard_negatives, "SLICE_BYTES", slice_bytes)
    rows = vectors(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows, lambda i: i % 100 == 0)
    assert len(want) > 300
    assert got(mine_negatives(df, F.col("id") % 100 == 0)) == want


def test_other_settings_and_labels(spark):
    rows = vectors(2, 200)
    df = spark.createDataFrame(rows, SCHEMA)
    named = df.withColumn("label", F.concat(F.lit("c"), F.col("label")))
    want = plain(rows, lambda i: i % 10 == 3, positives=2, negatives=4, band=(-50, 100), scale=10)
    assert got(mine_negatives(named, F.col("id") % 10 == 3, positives=2, negatives=4, band=(-50, 100), scale=10)) == want


def test_values_beyond_exact_floats(spark):
    """Inner products that no double holds are exact; those beyond 64 bits saturate."""
    rows = [(k, [float(np.float32(1e9 * (k % 7) + k)), 3e8, -1e9], k % 2) for k in range(40)] + [(100, [1e30, 1.0, 1.0], 0), (101, [1e30, 2.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    capped = [(i, [max(-(2.0**62) / 256, min(2.0**62 / 256, x)) for x in v], c) for i, v, c in rows]
    assert got(mine_negatives(df, F.col("id") % 10 == 0)) == plain(capped, lambda i: i % 10 == 0)


def test_pruned_rows_cannot_reach_the_threshold():
    """Candidates hold every row at or above the threshold, and far fewer than all rows where the threshold is high."""
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(30, 16)).astype(np.float32)
    rows = (base[rnd.integers(0, 30, 1500)] + rnd.normal(scale=0.05, size=(1500, 16))).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)  # as in a bucket, lengths are alike
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(range(1500)), pa.array([0] * 1500), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["row", "id", "label", "vector"])
    coded = next(integers(256)([batch]))
    bucket = Bucket({n: c[0] for n, c in zip(bucket_row(coded).schema.names, bucket_row(coded).columns, strict=True)})
    anchors = Anchors(pa.Table.from_batches([coded.slice(0, 40)]))
    share = []
    for a in range(40):
        score = bucket.scores(anchors, np.array([a]))[0]
        for least in np.sort(score)[[-1, -10, -100, -700]]:
            found = bucket.candidates(anchors, a, int(least))
            if found is not None:
                assert set(np.flatnonzero(score >= least)) <= set(found.tolist())
            if least == np.sort(score)[-10]:
                share.append(1 if found is None else len(found) / 1500)
    assert np.mean(share) < 0.5


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mine_negatives(none, F.col("id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert mine_negatives(alone, F.col("id") % 100 == 0).count() == 0


def test_query_equals_sql(same):
    same(queries.QUERIES["op11_hard_negatives"], queries.ORACLES["op11_hard_negatives"])
