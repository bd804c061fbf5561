"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed unigrams, bigrams and one-gap skip-grams of a
text's words.  Per-coordinate learning rates and an L1 penalty leave few weights
other than zero; those are broadcast for scoring.  Training takes a bounded,
hash-chosen sample of labelled rows; it may run in several tasks (shards), whose weights
Spark averages, but one learns more from the same rows.

Defined cases: null or wordless text scores by the bias alone; equal texts score alike;
labels that disagree for one id count as toxic if any does; null labels and ids are not learned;
without labels every score is 0.5; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuebase.llm.common import bounded_batches, hash_sample
from cuebase.llm.decontaminate import plain_words
from cuebase.llm.textbatch import U64, give_back, mix64, slices, text_buffer

#: About so many labelled rows are learned from, taken by hash of the id, in so many tasks.
TRAIN_ROWS, SHARDS, EPOCHS = 24_000, 1, 4
DIM = 1 << 20
#: FTRL-proximal's settings.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 16.0, 0.5
#: The rarer class weighs the class ratio to this power.
POWER = 0.7


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) pairs, distinct, by text: words, pairs of neighbours, pairs with one word between."""
    codes, text = plain_words(data, offsets)
    out, owner = [codes], [text]
    with np.errstate(over="ignore"):
        for gap, salt in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
            if len(codes) > gap:
                same = text[gap:] == text[:-gap]
                out.append(mix64((codes[:-gap] * U64(3) ^ codes[gap:]) + U64(salt))[same])
                owner.append(text[gap:][same])
    key = np.concatenate(owner) * DIM + (np.concatenate(out) & U64(DIM - 1)).astype(np.int64)
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return key % DIM, key // DIM


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights over DIM coordinates, and the bias: the log odds of the labels, so that a text without known words scores low."""
    z, n = np.zeros(DIM), np.zeros(DIM)
    toxic, clean = float((labels > 0).sum()), float((labels == 0).sum())
    rare = max(1.0, clean / max(1.0, toxic)) ** POWER
    weight = np.where(labels > 0, rare, 1.0)
    bias = min(float(np.log((toxic + 1) / (clean + 1))), 0.0) if toxic and clean else 0.0

    def at(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for i, y, c in zip(rows, labels, weight, strict=True):
            w = at(i)
            g = (1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y) * c
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return at(np.arange(DIM)), bias


def _train(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["pick", "text"], kind="stable")
    rows = []
    for text in pdf["text"]:
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        rows.append(features(raw, np.array([0, len(raw)]))[0].astype(np.int32))
    w, bias = ftrl(rows, pdf["label"].to_numpy())
    at = np.flatnonzero(w)
    del rows
    give_back()
    return pd.DataFrame({"feature": np.append(at, DIM), "weight": np.append(w[at], bias), "shard": key[0]})


def learn(labelled: DataFrame, train_rows: int = TRAIN_ROWS, shards: int = SHARDS) -> tuple[np.ndarray, float]:
    """labelled: (text, label 0 or 1, pick), already bounded.  The mean weights of the shards, and the bias."""
    parts = labelled.withColumn("shard", F.pmod(F.xxhash64("pick"), F.lit(shards)))
    rows = parts.groupBy("shard").applyInPandas(_train, "feature long, weight double, shard long")
    # at most DIM + 1 rows reach the driver; a weight that most shards left at zero is dropped
    mean = rows.groupBy("feature").agg(F.sum("weight").alias("weight"), F.count("*").alias("k")).toPandas()
    weights = np.zeros(DIM, dtype=np.float64)
    if not len(mean):
        return weights, 0.0
    used = max(1, int(mean["k"].max()))
    mean["weight"] /= used
    bias = float(mean.loc[mean["feature"] == DIM, "weight"].sum())
    keep = mean[(mean["feature"] < DIM) & (mean["k"] * 2 >= used)]
    weights[keep["feature"].to_numpy()] = keep["weight"].to_numpy()
    return weights, bias


def _score(index: np.ndarray, weights: np.ndarray, bias: float):
    def run(batches):
        table = np.zeros(DIM)
        table[index] = weights
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                n = len(part)
                feature, text = features(*text_buffer(part.column(1)))
                total = np.bincount(text, weights=table[feature], minlength=n) + bias if len(text) else np.full(n, bias)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["id", "score"])

    return run


def score_toxicity(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per document: id, score."""
    index = np.flatnonzero(weights)
    own = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_score(index, weights[index], bias), f"id {dict(docs.dtypes)[id_col]}, score double").withColumnRenamed("id", id_col)


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, label, pick): a bounded sample of the labelled documents, at about train_rows."""
    own = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label"))
    one = own.where("label_id is not null and label is not null").groupBy("label_id").agg((F.max("label") > 0).cast("double").alias("label"))
    one = one.withColumn("pick", F.xxhash64("label_id"))
    one = hash_sample(one, "pick", one.count(), train_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(one), F.col("doc_id") == F.col("label_id")).select("text", "label", "pick")


def keep_clean(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold."""
    index = np.flatnonzero(weights)
    own, held = weights[index], {}

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        if "table" not in held:
            held["table"] = np.zeros(DIM)
            held["table"][index] = own
        out = []
        for part in slices(pa.RecordBatch.from_arrays([text], names=["text"]), "text", 1 << 20):
            feature, owner = features(*text_buffer(part.column(0)))
            total = np.bincount(owner, weights=held["table"][feature], minlength=len(part)) + bias if len(owner) else np.full(len(part), bias)
            out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
        return pa.array(np.concatenate(out) if out else np.empty(0))

    return bounded_batches(docs).where(score(F.col(text_col)) < threshold)
