"""Language, toxicity and decontamination: held-out accuracy, planted cases, edge cases."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuebase.llm import language, queries, toxicity
from cuebase.llm.decontaminate import drop_leaks, find_leaks


def test_language_held_out(spark, data, duck):
    truth = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    got = queries.op8_language_id(spark, data).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_edges(spark, docs, rows, empty):
    labelled = docs.where("lang is not null").select("lang", "text", F.lit(1).cast("bigint").alias("pick"))
    got = language.identify(docs, labelled).collect()
    assert len(got) == len(rows)
    texts = sorted(((str(r[0]), r[1]) for r in rows), key=str)
    und = sum(1 for _, t in texts if not t or not any(c.isalpha() for c in t))
    assert sum(r.lang_pred == "und" and r.score == 0 for r in got) == und
    assert language.identify(empty, labelled).count() == 0
    assert {r.lang_pred for r in language.identify(docs, labelled.limit(0)).collect()} == {"und"}


def test_language_mixture(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    a, b = (docs.where(f"lang = '{x}' and n_chars > 2000").orderBy("doc_id").first().text for x in ("en", "de"))
    mixed = spark.createDataFrame([(1, a[:2000]), (2, a[:2000] + "\n" + b[:2000]), (3, a[:3000] + "\n" + b[:700])], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(mixed, docs.select("lang", "text", F.xxhash64("doc_id").alias("pick"))).collect()}
    assert got[1].n_langs == 1 and got[2].n_langs == 2 and 0.35 < got[2].score < 0.65
    assert got[3].lang_pred == "en" and 0.7 < got[3].score < 0.95


@pytest.fixture(scope="module")
def model(spark):
    bad = ["awful", "nasty", "vile"]
    rows = [(f"filler{k % 17} word{k % 23} text{k % 29} " + (bad[k % 3] + " person" if k % 4 == 0 else "kind person"), float(k % 4 == 0), k) for k in range(800)]
    return toxicity.learn(spark.createDataFrame(rows, "text string, label double, pick long"), shards=2)


def test_toxicity_learns_words(spark, docs, rows, empty, model):
    weights, bias = model
    assert 0 < (weights != 0).sum() < 2000
    df = spark.createDataFrame([(1, "you NASTY, vile person"), (2, "kind text"), (3, None), (4, ""), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(df, weights, bias).collect()}
    assert got[1] > 0.7 > 0.5 > got[2] and got[3] == got[4]
    assert [r.doc_id for r in toxicity.keep_clean(df, weights, bias).orderBy("doc_id").collect()] == [2, 3, 4, 4]
    scored = toxicity.score_toxicity(docs, weights, bias).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score_toxicity(empty, weights, bias).count() == 0
    assert toxicity.keep_clean(docs, weights, bias).columns == docs.columns


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([(None, None, 1), (10**9, 1, 1)], "doc_id long, quality int, toxic int")
    weights, bias = toxicity.learn(toxicity.labelled_texts(docs, labels))
    assert not weights.any() and bias == 0.0


def test_toxicity_contract(spark, data):
    folder = data
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = queries.op9_toxicity(spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    clean = [r for r in held if labels[r.doc_id] == 0]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)


ITEMS = [(1, "The quick brown foxes jump over seventeen lazy hounds near river banks. Answer: because hounds sleep daily"), (2, None), (3, ""), (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")]


def test_leaks(spark, docs, rows, empty):
    bench = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, id string")
    filler = " ".join(f"w{k}" for k in range(400))
    texts = [(1, f"{filler} {ITEMS[0][1].upper()} {filler}"), (2, filler), (3, None), (4, "Alpha, beta gamma; delta epsilon zeta eta theta iota kappa lambda mu!"), (4, "alpha delta mu"), (5, ""), (6, f"{filler} {ITEMS[3][1]} {filler}" * 3)]
    df = spark.createDataFrame([(*t, 0.5) for t in texts], "doc_id long, text string, score double")
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(df, bench).collect()) == [(1, 1), (4, 4), (6, 4)]
    assert sorted(r.doc_id for r in drop_leaks(df, bench).collect()) == [2, 3, 4, 5]
    assert find_leaks(docs, bench).count() == 0 and find_leaks(empty, bench).count() == 0 and find_leaks(df, bench.limit(0)).count() == 0
    assert drop_leaks(docs, bench).count() == len(rows)


def test_leaks_on_table(spark, data, duck):
    """Every verbatim item is found; nothing is found without most of an item."""
    truth = set(duck.sql("SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)").fetchall())
    got = {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, data).collect()}
    assert truth <= got and len(got - truth) <= 0.1 * len(got) + 1


def plain_leaks(texts: list, items: list, stride: int, threshold: float) -> dict:
    """BM25 of every item for every window, in plain Python: the best score of each pair that passes the checks."""
    words = lambda t: re.findall(r"[0-9a-z\x80-\xff]+", t.lower().encode().decode("latin-1")) if t else []
    bags = {i: w for i, t in items if (w := words(t))}
    n, mean = len(bags), sum(map(len, bags.values())) / len(bags)
    df = Counter(w for b in bags.values() for w in set(b))

    def impacts(bag):
        tf = Counter(bag)
        raw = {w: math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(bag) / mean)) for w, c in tf.items()}
        return {w: x / sum(raw.values()) for w, x in raw.items()}

    impact, out = {i: impacts(b) for i, b in bags.items()}, {}
    for d, t in texts:
        w = words(t)
        for at in range(0, len(w), stride):
            own = w[at : at + 2 * stride]
            have = set(own)
            for i, weights in impact.items():
                score = sum(x for word, x in weights.items() if word in have)
                if score >= threshold:
                    bag = bags[i]
                    cut = len(bag) - max(1, len(bag) // 4)
                    k = min(3, max(1, cut))
                    runs = {tuple(bag[a : a + k]) for a in range(cut - k + 1)}
                    held = {tuple(own[a : a + k]) for a in range(len(own) - k + 1)}
                    if len(runs & held) >= 0.5 * len(runs) and len(set(bag[cut:]) & have) >= 0.5 * len(set(bag[cut:])):
                        out[d, i] = max(out.get((d, i), 0), score)
    return out


@pytest.mark.parametrize("pass_bytes", [20_000_000, 300])
def test_leaks_equal_plain_bm25(spark, monkeypatch, pass_bytes):
    """All pairs and scores of a plain BM25 over all passages and items, in one index and in many."""
    from cuebase.llm import decontaminate

    monkeypatch.setattr(decontaminate, "PASS_BYTES", pass_bytes)
    rnd = random.Random(4)
    vocabulary = [f"mot{k}é" for k in range(60)] + [f"rare{k}" for k in range(400)]
    some = lambda n: " ".join(rnd.choices(vocabulary, [9] * 60 + [1] * 400, k=n))
    items = [(k, some(rnd.randint(4, 30))) for k in range(60)] + [(60, None), (61, "?!"), (62, "mot1é mot1é mot2é")]
    texts = [(k, some(rnd.randint(0, 300))) for k in range(60)]
    for k in range(60):  # copies: whole, upper-cased, cut, with words changed
        w = items[k][1].split()
        part = [" ".join(w), " ".join(w).upper(), " ".join(w[: len(w) * 2 // 3]), " ".join(x if rnd.random() < 0.8 else "other" for x in w)][k % 4]
        texts.append((100 + k, f"{some(rnd.randint(0, 80))} {part} {some(rnd.randint(0, 80))}"))
    texts += [(200, None), (201, ""), (202, " ".join(t for _, t in items if t))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in find_leaks(df, bench).collect()}
    want = plain_leaks(texts, items, 32, 0.5)
    assert set(got) == set(want) and len(want) > 60
    assert all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_block_bounds_and_lookups_give_the_same(monkeypatch):
    """Reading all lists, looking up those after the pivot, and plain sums over all items agree on 3,000 items."""
    import numpy as np

    from cuebase.llm import decontaminate
    from cuebase.llm.decontaminate import Index, hashed, scored

    rnd = random.Random(9)
    words = [f"w{k}" for k in range(4000)]
    some = lambda n: " ".join(rnd.choices(words, [1 / (k + 3) for k in range(4000)], k=n))
    items = [(k, some(rnd.randint(5, 25))) for k in range(3000)]
    bags = [hashed(t) for _, t in items]
    name, df = np.unique(np.concatenate([np.unique(b) for b in bags]), return_counts=True)
    index = Index(items, len(items), float(np.mean([len(b) for b in bags])), 32, name, df)
    assert index.blocks > 300
    window, term = [], []
    for w in range(300):
        held = np.unique(np.searchsorted(index.vocabulary, hashed(some(40) + " " + (items[w * 7][1] if w % 2 else ""))))
        held = held[held < len(index.vocabulary)]
        held = held[np.argsort(index.rank[held])]
        window += [w] * len(held)
        term += held.tolist()
    window, term = np.array(window), np.array(term)
    dense = np.zeros((300, len(index.ids)))
    lists = {t: (index.post_item[a:b], index.post_impact[a:b]) for t in set(term.tolist()) for a, b in [(index.entry_start[index.first[t]], index.entry_start[index.first[t + 1] - 1] + index.entry_count[index.first[t + 1] - 1])]}
    for w, t in zip(window.tolist(), term.tolist(), strict=True):
        dense[w, lists[t][0]] += lists[t][1]
    want = {(int(w), int(i)): round(float(dense[w, i]), 5) for w, i in zip(*np.nonzero(dense >= 0.5), strict=True)}
    assert len(want) > 150
    for direct, cells in [(0, 1 << 21), (10**9, 1 << 21), (0, 500), (10**9, 500)]:
        monkeypatch.setattr(decontaminate, "DIRECT_BLOCKS", direct)
        monkeypatch.setattr(decontaminate, "CELLS_MOST", cells)
        got = {(w, i): s for w, i, s in scored(index, window, term, 0.5)}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_samples_do_not_become_empty(spark):
    """The share of a bounded sample is above 0 however many rows there are, and close to what is asked."""
    from cuebase.llm.common import hash_sample, sample_bound

    for n in (10, 10**5, 4 * 10**10, 10**15, 10**30):
        assert 0 < sample_bound(24_000, n) <= 1 << 62
    rows = spark.range(200_000).select(F.xxhash64("id").alias("pick"), F.lit("toxic words").alias("text"), F.lit(1.0).alias("label"))
    assert abs(hash_sample(rows, "pick", 200_000, 20_000).count() - 20_000) < 800
    assert hash_sample(rows, "pick", 200_000, 200_000).count() == 200_000
    # as if there were 4e10 rows: a share of 6e-7 still takes some of 2e7
    many = spark.range(20_000_000).select(F.xxhash64("id").alias("pick"))
    assert 0 < hash_sample(many, "pick", 4 * 10**10, 24_000).count() < 60


def test_leaks_of_long_items_and_null_ids(spark):
    """An item of any length and one without an id are found; the long one leaves the short ones' windows alone."""
    long = " ".join(f"term{k}x{k * k % 9973}" for k in range(30_000))
    null_item = "omicron pi rho sigma tau upsilon phi chi psi omega digamma stigma"
    filler = " ".join(f"w{k}" for k in range(400))
    bench = spark.createDataFrame([(1, ITEMS[3][1]), (2, long), (None, null_item), (3, "w " * 15_000 + "end")], "item_id long, text string")
    texts = [(1, f"{filler} {long} {filler}"), (2, f"{filler} {null_item}"), (3, f"{ITEMS[3][1]} {filler}"), (4, filler), (5, long[: len(long) // 4]), (6, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in find_leaks(df, bench).collect()} == {(1, 2), (2, None), (3, 1)}
    assert sorted(r.doc_id for r in drop_leaks(df, bench).collect()) == [4, 5, 6]
