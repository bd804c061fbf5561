"""Language mixtures, FTRL, differencing and the pipeline against plain sequential versions; clashing column names."""

from __future__ import annotations

import heapq
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuebase.llm import language, shards, toxicity
from cuebase.llm.common import materialise
from cuebase.llm.decontaminate import drop_leaks, find_leaks
from cuebase.llm.line_dedup import dedup_lines
from cuebase.llm.mixing import poisson_copies, poisson_mix, temperature_weights
from cuebase.llm.ngram_join import keep_one, ngram_jaccard_join
from cuebase.llm.substring_dedup import shared_passages, substring_dedup
from cuebase.llm.tiff import store_texts, tiff_digests, tiff_pages
from cuebase.llm.url_filter import filter_urls


def plain_mixture(table: np.ndarray, text: bytes) -> tuple[np.ndarray, int]:
    """EM over one text's words, one word and one language at a time, and the set of languages by penalised likelihood."""
    bucket, first, _ = language.grams(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    words = [bucket[a:b] for a, b in zip(first, [*first[1:], len(bucket)], strict=True)]
    k = table.shape[1]
    like = []
    for w in words:
        ll = [sum(float(table[g, j]) for g in w) for j in range(k)]
        like.append([math.exp(max(x - max(ll), -60.0)) for x in ll])

    def em(allowed, rounds):
        share = [1 / len(allowed) if j in allowed else 0.0 for j in range(k)]
        for _ in range(rounds):
            new = [0.0] * k
            for row in like:
                total = sum(x * s for x, s in zip(row, share, strict=True))
                for j in range(k):
                    new[j] += row[j] * share[j] / total
            share = [x / len(like) for x in new]
        return share, sum(math.log(max(sum(x * s for x, s in zip(row, share, strict=True)), 1e-30)) for row in like)

    share, _ = em(set(range(k)), language.ROUNDS)
    order = sorted(range(k), key=lambda j: -share[j])
    fits = []
    for m in range(1, k + 1):
        s, fit = em(set(order[:m]), 1 if m == 1 else language.FEWER_ROUNDS)
        fits.append((fit - 0.5 * (m - 1) * math.log(len(like) + 1), -m, s))
    _, m, s = max(fits, key=lambda x: x[:2])
    return np.array(s), -m


@pytest.mark.parametrize("piece", [1 << 20, 97])
def test_mixtures_equal_plain_em(monkeypatch, piece):
    """Proportions and sets of one to seven languages, whole and in pieces."""
    rnd = random.Random(5)
    letters = [[chr(97 + (j * 5 + i) % 26) for i in range(9)] for j in range(7)]
    word = lambda j: "".join(rnd.choice(letters[j]) for _ in range(rnd.randint(3, 8)))
    text = lambda langs, n: " ".join(word(rnd.choice(langs)) for _ in range(n)).encode()
    counts = np.full((language.BUCKETS, 7), language.SMOOTH)
    for j in range(7):
        t = np.frombuffer(text([j], 3000), dtype=np.uint8)
        np.add.at(counts[:, j], language.grams(t, np.array([0, len(t)]))[0], 1)
    table = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    texts = [text([0], 40), text([1, 2], 80), text([0, 3, 4], 150), text([0, 1, 2, 3, 4, 5], 600), text(list(range(7)), 900), b"", b"12 34", text([6], 1)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    monkeypatch.setattr(language, "PIECE", piece)
    at, share, number = language.infer(table, np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    assert at.tolist() == [0, 1, 2, 3, 4, 7]
    for i, t in enumerate(at):
        want, m = plain_mixture(table, texts[t])
        assert number[i] == m and np.allclose(share[i], want, atol=2e-3), t
    assert number[4] > 4


def plain_ftrl(rows: list, labels: list, epochs: int) -> dict:
    """FTRL-proximal, one coordinate at a time."""
    z, n = {}, {}
    toxic, clean = sum(labels), len(labels) - sum(labels)
    rare = max(1.0, clean / max(1.0, toxic)) ** toxicity.POWER
    bias = min(math.log((toxic + 1) / (clean + 1)), 0.0)

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for row, y in zip(rows, labels, strict=True):
            w = {i: weight(i) for i in row}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()) + bias))))
            g = (p - y) * (rare if y else 1.0)
            for i in row:
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / toxicity.ALPHA * w[i]
                n[i] = before + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_ftrl_equals_plain_version():
    rnd = random.Random(6)
    labels = [int(k % 5 == 0) for k in range(600)]
    rows = [sorted({rnd.randrange(40) for _ in range(6)} | ({1000 + k % 3} if labels[k] else {2000 + k % 4})) for k in range(600)]
    got, _ = toxicity.ftrl([np.array(r) for r in rows], np.array(labels, dtype=float), epochs=2)
    want = plain_ftrl(rows, labels, 2)
    assert want and {int(i) for i in np.flatnonzero(got)} == set(want)
    assert all(abs(got[i] - w) < 1e-9 for i, w in want.items())


def test_features_are_words_pairs_and_skip_pairs():
    from cuebase.llm.decontaminate import plain_words
    from cuebase.llm.textbatch import U64, mix64

    raw = b"You are so Bad, you ARE"
    data = np.frombuffer(raw, dtype=np.uint8)
    codes = plain_words(data, np.array([0, len(raw)]))[0]
    want = {int(c) % toxicity.DIM for c in codes}
    for gap, salt in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        for a, b in zip(codes[:-gap], codes[gap:], strict=True):
            one = np.array([(int(a) * 3 % 2**64 ^ int(b)) + salt & 2**64 - 1], dtype=U64)
            want.add(int(mix64(one)[0]) % toxicity.DIM)
    assert set(toxicity.features(data, np.array([0, len(raw)]))[0].tolist()) == want


def plain_differencing(weights: list[int], k: int) -> list[int]:
    """Multi-way Karmarkar-Karp on plain tuples; the sums of the k parts."""
    heap = [(-w, i, tuple([w] + [0] * (k - 1))) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    made = len(weights)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        c = tuple(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))
        heapq.heappush(heap, (c[-1] - c[0], made, c))
        made += 1
    return list(heap[0][2])


@pytest.mark.parametrize("k", [2, 5, 16])
def test_differencing_equals_plain_version(k):
    rnd = random.Random(k)
    weights = [rnd.choice([1, 7, 100, rnd.randint(1, 5000), rnd.randint(1, 300_000)]) for _ in range(700)]
    sums = np.zeros((700, k), dtype=np.int64)
    sums[:, 0] = weights
    place, total = shards.difference(sums)
    own = np.bincount(place[:, 0], weights=weights, minlength=k)
    assert sorted(own) == sorted(total) == sorted(plain_differencing(weights, k))


def test_shards_equal_differencing_on_a_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    groups = docs.groupBy("text").agg(F.sum(F.octet_length("text") + 1).alias("w")).collect()
    got = [r.n for r in shards.shard_by_bytes(docs, 16).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert sorted(got) == sorted(plain_differencing([r.w for r in groups], 16))


def test_shards_of_one_giant_group_and_null_ids(spark):
    rows = [(None if k % 3 else k, "same text") for k in range(300)] + [(k, f"own {k}") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = shards.shard_by_bytes(df, 4).collect()
    giant = {r.shard for r in got if r.size == 10}
    slots = sorted(r.slot for r in got if r.shard in giant)
    assert len(giant) == 1 and slots == list(range(len(slots))) and len(got) == 320


NAMES = "label pick steps parts x_own x_id x_name x_keep x_n row name item size shard slot bucket id key node n text_name lang_pred host line lines often pages doc word".split()


@pytest.fixture(scope="module")
def crowded(spark, data):
    """Documents with columns of the operators' own names, and those with the added names beside them."""
    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 150")
    return materialise(docs.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES], F.lit(1.5).alias("rate"), F.lit("c").alias("copies"), F.lit("d").alias("copy"), F.lit("k").alias("shuffle_key")))


def untouched(df, columns):
    assert df.columns == columns
    bad = F.lit(False)
    for n in NAMES:
        bad = bad | ~F.col(n).eqNullSafe(F.lit(f"own {n}"))
    assert df.where(bad | (F.col("rate") != 1.5) | (F.col("copies") != "c")).isEmpty()


def test_clashing_names_in_the_pipeline(spark, crowded, data):
    docs = crowded
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, data))
        untouched(docs, crowded.columns)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert last.columns[: len(crowded.columns)] == crowded.columns
    untouched(last.select(crowded.columns), crowded.columns)
    assert "shard_shard" in last.columns and "law" in last.columns


def test_clashing_names_in_each_operator(spark, crowded, data):
    n = crowded.count()
    bench = spark.read.parquet(f"{data}/benchmark.parquet").select("*", F.lit(1).alias("kind"), F.lit(2).alias("slice"), F.lit(3).alias("word"))
    labels = spark.read.parquet(f"{data}/labels.parquet").select("*", F.lit("x").alias("label"), F.lit("y").alias("pick"), F.lit("z").alias("label_id"))
    assert substring_dedup(crowded).count() == n and shared_passages(crowded).count() >= 0
    assert ngram_jaccard_join(crowded).count() == n and keep_one(crowded).columns == crowded.columns
    assert tiff_digests(store_texts(crowded), "doc_id").count() == n and tiff_pages(store_texts(crowded), "doc_id").count() >= n
    assert find_leaks(crowded, bench).count() >= 0 and drop_leaks(crowded, bench).columns == crowded.columns
    assert shards.shard_by_bytes(crowded, 4).count() == n
    assert language.identify(crowded, crowded.select("lang", "text", F.lit(1).alias("pick"), "label")).count() == n
    weights, bias = toxicity.learn(toxicity.labelled_texts(crowded, labels))
    assert toxicity.score_toxicity(crowded, weights, bias).count() == n and toxicity.keep_clean(crowded, weights, bias).columns == crowded.columns
    assert poisson_copies(crowded, temperature_weights(crowded)).select("row.*").columns == crowded.columns
    with pytest.raises(ValueError, match="shuffle_key"):
        poisson_mix(crowded, temperature_weights(crowded))
    web = spark.read.parquet(f"{data}/pages.parquet").select("*", *[F.lit(x).alias(x) for x in ("host", "path", "rule", "lines", "line", "often", "n", "pages", "digest", "short")])
    rules = spark.createDataFrame([("org", "/", "allow", "x")], "host string, path string, action string, r_host string")
    assert dedup_lines(web).count() == web.count() == filter_urls(web, rules).count()


def test_pipeline_equals_plain_steps(spark, data):
    """Each stage's rows from plain sets and loops over what the stage before kept."""
    from tests.llm.test_dedup import groups
    from tests.llm.test_mixing_and_shards import drawn
    from tests.llm.test_models import plain_leaks

    docs = spark.read.parquet(f"{data}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, data)
    labels = spark.read.parquet(f"{data}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    weights, bias = toxicity.learn(toxicity.labelled_texts(docs, labels))
    stay = []
    for r in docs.collect():
        raw = np.frombuffer((r.text or "").encode(), dtype=np.uint8)
        total = bias + sum(weights[i] for i in toxicity.features(raw, np.array([0, len(raw)]))[0])
        if 1 / (1 + math.exp(-total)) < 0.7:
            stay.append((r.doc_id, r.text))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in stay)
    first = {}
    for (d, text), (_, _, root) in zip(stay, groups(stay), strict=True):
        key = root if text and text.split() else f"blank {d}"
        first[key] = min(d, first.get(key, d))
    single = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(stay, "doc_id long, text string"), data)
    assert sorted(r.doc_id for r in single.collect()) == sorted(first.values())
    # benchmark leaks, by plain BM25 over all passages
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    stride = max(32, max(len(re.findall(r"[0-9a-z\x80-\xff]+", t.lower().encode().decode("latin-1"))) for _, t in bench))
    left = single.collect()
    leaking = {d for d, _ in plain_leaks([(r.doc_id, r.text) for r in left], bench, stride, 0.5)}
    assert leaking
    full = docs.where(F.col("doc_id").isin([r.doc_id for r in left]))
    unleaked = corpus_pipeline.drop_contaminated(spark, full, data)
    kept = {r.doc_id for r in left} - leaking
    assert sorted(r.doc_id for r in unleaked.collect()) == sorted(kept)
    # Poisson copies, drawn one by one
    rows = [r for r in docs.collect() if r.doc_id in kept]
    size = lambda t: len((t or "").encode())
    total = Counter()
    for r in rows:
        total[r.source] += size(r.text)
    root = {k: math.sqrt(n) for k, n in total.items()}
    rate = {k: sum(total.values()) * root[k] / sum(root.values()) / n if n else 0.0 for k, n in total.items()}
    want = Counter({r.doc_id: k for r in rows if (k := drawn(str(r.doc_id), rate[r.source]))})
    mixed = corpus_pipeline.mix_sources(spark, docs.where(F.col("doc_id").isin(list(kept))), data)
    copies = mixed.collect()
    assert Counter(r.doc_id for r in copies) == want and mixed.columns == docs.columns
    # shards, by plain differencing of the groups of equal texts
    again = spark.createDataFrame(copies, docs.schema)
    sharded = corpus_pipeline.put_into_shards(spark, again, data).collect()
    weight = Counter()
    for r in copies:
        weight[r.text] += size(r.text) + 1
    held = Counter()
    for r in sharded:
        held[r.shard] += r.size
    assert sorted([*held.values(), *[0] * (16 - len(held))]) == sorted(plain_differencing(list(weight.values()), 16))
    assert Counter(r.doc_id for r in sharded) == want
