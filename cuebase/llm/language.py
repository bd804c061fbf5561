"""Language identification by multilingual mixture inference.

Each language has a byte-trigram distribution, learned from labelled documents.  A
document's words are draws from a mixture of languages: expectation-maximisation
estimates the proportions from the words' likelihoods, and the set of languages is
chosen by penalised likelihood (half the log of the word count for each further
language).  Sets of every size are judged, each made of the languages of largest proportion; a size is
left out only where its penalty alone already costs more than the best set so far (a likelihood is 1 at most).
The prediction is the language of largest proportion in that set.

A text of any length is cut at word borders into pieces of PIECE bytes for its trigrams; what remains of it is
one row of word likelihoods for each word.

Counting runs over partitions and is summed by Spark; only the table of counts
(languages x 65,536) reaches the driver.

Defined cases: null text, or text without a letter, is `und` with score 0; equal texts get
equal results; without labelled rows every text is `und`; ties go to the language first in
order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuebase.llm.common import bounded_batches, hash_sample
from cuebase.llm.textbatch import LOWER, U64, mix64, slices, text_buffer

#: About so many labelled rows are learned from, taken by hash of the id.
TRAIN_ROWS = 30_000
BUCKETS = 1 << 16
ROUNDS, FEWER_ROUNDS = 8, 6
#: Bytes of one text whose trigrams are looked up at once.
PIECE = 1 << 20
SMOOTH = 0.5
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SLOT = (mix64(np.arange(1 << 12, dtype=U64) * U64(0x9E3779B97F4A7C15)) & U64(BUCKETS - 1)).astype(np.uint32)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bucket of each letter byte, first gram of each word, text of each word); neighbours outside the text are spaces."""
    n = len(data)
    low = LOWER[data].astype(np.uint32)
    low[~_LETTER[data]] = 32
    before, after = np.empty_like(low), np.empty_like(low)
    before[1:], after[:-1] = low[:-1], low[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[0] = after[-1] = 32
    before[inner], after[inner - 1] = 32, 32
    letter = np.flatnonzero(low != 32)
    b, m, a = before[letter], low[letter], after[letter]
    bucket = (_SLOT[b * 16 ^ m] * 3 + _SLOT[m ^ a * 16] * 40503 + a) & (BUCKETS - 1)
    first = np.flatnonzero(b == 32)
    return bucket, first, np.searchsorted(offsets, letter[first], side="right") - 1


def _counts(batches):
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            data, offsets = text_buffer(part.column(1))
            if not len(data):
                continue
            langs = np.array(part.column(0).to_pylist(), dtype=object)
            for lo in range(0, len(data), PIECE):  # more than one for a single long text only
                bucket, first, text = grams(data[lo : lo + PIECE], np.clip(offsets - lo, 0, min(PIECE, len(data) - lo)))
                per_text = np.repeat(text, np.diff(np.r_[first, len(bucket)]))
                for lang in set(langs):
                    rows = np.flatnonzero(langs == lang)
                    held.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                    held[lang] += np.bincount(bucket[np.isin(per_text, rows)], minlength=BUCKETS)
    for lang, c in held.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "bucket", "n"])


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """labelled: (lang, text).  (languages in order, log probabilities (buckets, languages))."""
    rows = labelled.mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.full((BUCKETS, len(langs)), SMOOTH)
    if langs:
        table[rows["bucket"].to_numpy(), np.searchsorted(langs, rows["lang"].to_numpy(dtype=str))] += rows["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def _mix(like: np.ndarray, cut: np.ndarray, owner: np.ndarray, words: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for every text at once: (proportions, log likelihood) with only the allowed languages of each."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        part = like * share[owner]
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, cut, axis=0) / words[:, None]
    total = np.einsum("ij,ij->i", like, share[owner])
    return share, np.add.reduceat(np.log(np.maximum(total, 1e-30)), cut, dtype=np.float64)


def word_likelihoods(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(likelihood of each word in each language, 1 in its best one; text of each word), a piece of the texts at a time."""
    likes, texts, lo = [], [], 0
    while lo < len(data):
        hi = min(lo + PIECE, len(data))
        if hi < len(data):  # back to the last byte that is no letter; a word longer than a piece is cut
            gap = np.flatnonzero(~_LETTER[data[lo:hi]])
            hi = lo + int(gap[-1]) + 1 if len(gap) else hi
        own = np.unique(np.clip(offsets, lo, hi)) - lo
        bucket, first, text = grams(data[lo:hi], own)
        if len(first):
            ll = np.add.reduceat(table[bucket], first, axis=0)
            likes.append(np.exp(np.maximum(ll - ll.max(axis=1, keepdims=True), -60.0)))
            texts.append(np.searchsorted(offsets, own[text] + lo, side="right") - 1)
        lo = hi
    if not likes:
        return np.empty((0, table.shape[1]), dtype=np.float32), np.empty(0, dtype=np.int64)
    return np.concatenate(likes), np.concatenate(texts)


def infer(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, proportions in the chosen set, number of languages) of the texts with words."""
    like, text = word_likelihoods(table, data, offsets)
    if not len(text):
        return text, like, text
    cut = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    number_of = text[cut]
    words = np.diff(np.r_[cut, len(text)]).astype(np.float32)
    owner = np.repeat(np.arange(len(cut)), words.astype(np.int64))
    k = table.shape[1]
    share, _ = _mix(like, cut, owner, words, np.ones((len(cut), k), dtype=np.float32), ROUNDS)
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    best, gain = _mix(like, cut, owner, words, (rank < 1).astype(np.float32), 1)
    number = np.ones(len(cut), dtype=np.int32)
    price = 0.5 * np.log(words.astype(np.float64) + 1)
    open_ = np.arange(len(cut))
    for m in range(2, k + 1):
        stay = -(m - 1) * price[open_] > gain[open_]
        if not stay.any():
            break
        if not stay.all():
            inside = stay[owner]
            open_, like = open_[stay], like[inside]
            owner = (np.cumsum(stay) - 1)[owner[inside]]
            cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        s, fit = _mix(like, cut, owner, words[open_], (rank[open_] < m).astype(np.float32), FEWER_ROUNDS)
        fit = fit - (m - 1) * price[open_]
        better = fit > gain[open_]
        at = open_[better]
        best[at], gain[at], number[at] = s[better], fit[better], m
    return number_of, best, number


def _predict(langs: list[str], table: np.ndarray):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, offsets = text_buffer(part.column(1))
                n = len(part)
                pred, score, number = np.full(n, "und", dtype=object), np.zeros(n), np.zeros(n, dtype=np.int32)
                if langs and len(data) and _LETTER[data].any():
                    text, share, found = infer(table, data, offsets)
                    top = share.argmax(axis=1)
                    pred[text] = np.array(langs, dtype=object)[top]
                    score[text] = np.clip(share[np.arange(len(top)), top], 0, 1)
                    number[text] = found
                    # bytes above 127 may be no letters at all
                    plain = np.add.reduceat(np.r_[((data | 32) >= 97) & ((data | 32) <= 122), False], offsets[:-1]) if n else []
                    for i in np.flatnonzero((np.asarray(plain) == 0) & (pred != "und")).tolist():
                        if not any(c.isalpha() for c in part.column(1)[i].as_py()):
                            pred[i], score[i], number[i] = "und", 0.0, 0
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(number)], names=["id", "lang_pred", "score", "n_langs"])

    return run


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: id, lang_pred, score, n_langs.  labelled: (lang, text, pick), pick a hash that chooses the sample."""
    usable = labelled.where("lang is not null and text is not null")
    usable = hash_sample(usable, "pick", usable.count(), train_rows)
    langs, table = learn(usable.select("lang", "text"))
    own = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_predict(langs, table), f"id {dict(docs.dtypes)[id_col]}, lang_pred string, score double, n_langs int").withColumnRenamed("id", id_col)
