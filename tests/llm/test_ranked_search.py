"""Ranked search against a plain ranking of every document, and the parts of its index."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cuebase.llm import queries, ranked_search
from cuebase.llm.ranked_search import Ranking, Segment, build_index, counted, indexer, pack, unpack, width_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(UPPER))


def plain(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked, scored = terms(text), []
        for d, b in bags:
            m = 25 + 75 * b.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in asked if t in b)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def items_of(rows, seed: int, n: int = 12) -> list[tuple]:
    """Queries cut from the documents, with repeats, unknown words, none, and common words only."""
    rnd = random.Random(seed)
    words = [w for r in rows for w in terms(r[1])[:300]]
    out = [(k, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 20, 60])))) for k in range(n)]
    return out + [(100, "one one ONE a b"), (100, "one one ONE a b"), (101, "zzzzunknown"), (102, None), (103, ""), (104, "...?"), (None, rows[40][1])]


@pytest.mark.parametrize(("segment", "block", "piece"), [(16 << 20, 64, 1 << 20), (4000, 2, 512)])
def test_search_equals_plain_ranking(spark, docs, rows, segment, block, piece, monkeypatch):
    for name, x in (("SEGMENT_BYTES", segment), ("BLOCK", block), ("PIECE_BYTES", piece)):
        monkeypatch.setattr(ranked_search, name, x)
    items = items_of(rows, 5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked_search.ranked_search(docs, bench, k=10).collect()), key=key)
    want = sorted(plain([(r[0], r[1]) for r in rows], items, 10), key=key)
    assert got == want


def test_search_in_slices_over_a_ready_index(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(ranked_search, "PASS_BYTES", 600)
    monkeypatch.setattr(ranked_search, "SEGMENT_BYTES", 20_000)
    items = items_of(rows, 6)
    bench = spark.createDataFrame(items, "item_id long, text string")
    index = build_index(docs)
    assert index.count() > 3
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked_search.ranked_search(docs, bench, k=3, index=index).collect()), key=key)
    assert got == sorted(plain([(r[0], r[1]) for r in rows], items, 3), key=key)


def test_string_ids_and_empty_tables(spark, docs, rows, empty):
    bench = spark.createDataFrame([(1, rows[3][1])], "item_id long, text string")
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text")
    want = plain([(None if r[0] is None else f"d{r[0]}", r[1]) for r in rows], [(1, rows[3][1])], 10)
    got = ranked_search.ranked_search(named, bench).collect()
    assert sorted(r.score for r in got) == sorted(w[3] for w in want) and got[0].doc_id is not None
    assert ranked_search.ranked_search(empty, bench).count() == 0
    assert ranked_search.ranked_search(docs, bench.limit(0)).count() == 0


def test_blocks_come_back_as_packed():
    rnd = np.random.default_rng(1)
    count = rnd.integers(1, 60, 40)
    values = np.concatenate([rnd.integers(0, [1, 200, 60_000, 1 << 31][k % 4], n) for k, n in enumerate(count)])
    start = np.cumsum(count) - count
    width = width_of(np.maximum.reduceat(values, start))
    assert set(width.tolist()) == {0, 1, 2, 4}
    size = count * width
    at = np.cumsum(size) - size
    data = np.zeros(size.sum(), dtype=np.uint8)
    pack(values, count, width, at, data)
    assert (unpack(data, count, width, at) == values).all()
    few = np.array([7, 3, 20])
    assert (unpack(data, count[few], width[few], at[few]) == np.concatenate([values[start[k] : start[k] + count[k]] for k in few])).all()


def test_counted_sums_the_pieces_of_a_text():
    t, d, n = counted(np.array([5, 5, 2, 5], dtype=np.uint64), np.array([1, 0, 1, 1]), np.array([2, 1, 1, 4]))
    assert (t.tolist(), d.tolist(), n.tolist()) == ([2, 5, 5], [1, 0, 1], [1, 1, 6])


def test_blocks_of_other_documents_stay_compressed(monkeypatch):
    """With one rare and one common term, only the common term's block that holds the candidate is read."""
    import pyarrow as pa

    texts = [f"common w{k}" + " common" * (k % 3) for k in range(5000)] + ["rare common"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5001), pa.int64()), pa.array(texts)], names=["id", "text"])
    row = next(indexer(16 << 20, 1 << 20, 64)([batch]))
    asked = np.unique(np.concatenate([ranked_search.plain_words(np.frombuffer(w, dtype=np.uint8), np.array([0, len(w)]))[0] for w in (b"rare", b"common")]))
    seg = Segment({n: row.column(n)[0] for n in ("ids", *ranked_search.PARTS)}, Ranking(5001, 20_000), asked)
    read = []
    plain_postings = Segment.postings
    monkeypatch.setattr(Segment, "postings", lambda self, blocks: read.append(len(blocks)) or plain_postings(self, blocks))
    doc, score = seg.search(np.arange(2), np.where(seg.df[seg.lists] == 1, 3000, 100), 1, 1)
    assert seg.ids[int(doc[0])].as_py() == 5000 and len(score) == 1
    assert sum(read) <= 2 and (seg.first_block[1:] - seg.first_block[:-1]).max() > 70


def test_lengths_beyond_64_bits():
    big = Ranking(1 << 40, 1 << 52)
    assert big.impact(np.array([3]), np.array([1 << 30])).tolist() == [3_000_000_000 // (3000 + 8 * (25 + 75 * (1 << 30) * (1 << 40) // (1 << 52)))]


def test_query_equals_sql(same):
    same(queries.QUERIES["op12_ranked_search"], queries.ORACLES["op12_ranked_search"])
