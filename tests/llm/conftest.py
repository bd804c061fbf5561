"""Small corpora for the training-data operators."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, media string, score string, shingle string"


def corpus() -> list[tuple]:
    """Exact and near copies, shared passages, nulls, empty and very long texts, ties, repeated rows, odd ids."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijklmnoprstuvé") for _ in range(rnd.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(90), text(160)
    texts = [text(rnd.choice([3, 20, 150, 400])) for _ in range(40)]
    texts += [base] * 5
    for k in range(25):  # near copies, near and far from the base
        w = base.split()
        for _ in range(1 + k % 6):
            w[rnd.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [f"{text(60)} {passage} {text(40)}" for _ in range(12)]
    texts += [passage + "\n" + passage, "ab" * 700, "x" * 900, None, None, "", " \t\n", "one", "one two", "ONE two", "a b c d", "a b c d", "a b c d e", "A B c d E f"]
    texts += [text(30_000), "é" * 401, "日本語 テキスト"]
    rows = [(k, t, "en", "hot" if k % 3 else f"s{k % 5}", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[41], rows[41], (None, base, None, None, 1), (None, None, None, None, None), (7, text(50), "fr", None, None)]
    return [(*r, "i", "k", "m", "s", None) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
