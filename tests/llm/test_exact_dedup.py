"""Exact dedup against plain grouping, its tree rounds, and its defined cases."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cuebase.llm import exact_dedup, queries
from cuebase.llm.exact_dedup import drop_copies, exact_copies


def plain(rows, keep: str) -> list:
    members = defaultdict(list)
    for r in rows:
        members[r[1] or ""].append(r[0])
    out = []
    for text, ids in members.items():
        known = [i for i in ids if i is not None]
        stays = (max(known) if keep == "largest" else min(known)) if known else None
        left = 1
        for i in ids:
            kept = i == stays and left > 0
            left -= kept
            out.append((str(i), str(stays), len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("leaf_rows", [1 << 20, 1 / (1 << 14)])
def test_copies_equal_plain_groups(docs, rows, keep, leaf_rows, monkeypatch):
    """Two rounds, and four with tiny leaves; nulls, empty and very long texts, repeated rows, null ids, clashing columns."""
    monkeypatch.setattr(exact_dedup, "LEAF_ROWS", leaf_rows)
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_copies(docs, keep=keep).collect())
    assert got == plain(rows, keep)


def test_rounds_grow_with_the_rows():
    assert [exact_dedup.rounds_for(n) for n in (0, 10**6, 10**9, 10**11, 10**13)] == [2, 2, 2, 3, 4]


def test_a_merge_gets_a_row_from_each_partner(spark):
    """A digest that every node holds has FAN rows at most in each merge, and one row in the end."""
    same = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    table = exact_dedup.digest_rows(same, "doc_id", "text", None)
    leaves = exact_dedup.leaf_runs(table.withColumn("node", F.pmod(F.xxhash64("id", "row"), F.lit(1 << 12))), 2, "largest")
    assert leaves.count() <= 1 << 12
    once = exact_dedup.merged(leaves, 1, "largest")
    assert once.count() <= 1 << 6 and once.agg(F.sum("n")).first()[0] == 20_000
    top = exact_dedup.merged(leaves, 2, "largest").collect()
    assert len(top) == 1 and top[0].best.id == 19_999 and top[0].n == 20_000


def test_normalised_texts_and_rows(docs, rows):
    lower = lambda c: F.lower(c)
    got = drop_copies(docs, normalise=lower)
    assert got.columns == docs.columns
    want = sorted({(r[1] or "").lower() for r in rows})
    assert sorted((r.text or "").lower() for r in got.collect()) == want
    kept = {(r.doc_id, r.text) for r in drop_copies(docs, keep="smallest").collect()}
    assert {i for i, t in kept if t == rows[40][1]} == {40} and len(kept) == len({r[1] or "" for r in rows})


def test_empty(empty):
    assert exact_copies(empty).count() == 0 and drop_copies(empty).count() == 0


def test_query_equals_sql(same):
    same(queries.QUERIES["op13_exact_dedup"], queries.ORACLES["op13_exact_dedup"])


def test_no_python_on_the_executors(spark, data):
    plan = queries.QUERIES["op13_exact_dedup"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
