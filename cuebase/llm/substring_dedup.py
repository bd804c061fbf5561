"""Exact substring deduplication by bucket-pointer refinement over a sparse suffix array.

A byte goes if it lies in a string of `least` bytes (400) that also starts
anywhere else, in the same document or another; overlaps count.

The suffixes that matter are found by *anchors*: in every window of `least`
bytes the q-gram with the smallest hash (leftmost on ties) is the anchor.  Equal
windows have equal anchors at equal offsets, so it is enough to compare anchors:
about two in 370 positions.  Refinement then works as in bucket-pointer sorting:

* Anchors start in the bucket of their q-gram.  A bucket of one is final.
* A bucket is refined by the bucket identifiers (q-gram names) at later and
  earlier offsets, which name the longer window around the anchor.  Members
  whose whole reach agrees are settled as repeated, members that share no
  reach are settled as unique, and only the rest is refined again, over narrower
  ranges of window starts (all, 48, 8, then single ones).
* The outcome of a round is reused: a class of equal members goes on as one
  representative with its count.

Buckets are named by 64-bit hashes rather than ranks, because only equality of
buckets is asked for, never their lexicographic order; no bucket is ever
gathered in one place, it is only counted.

Defined cases: null text counts as empty bytes; texts shorter than `least` stay
whole; repeated rows and equal texts lose everything from `least` bytes on; an empty
table gives an empty result; other columns are ignored.  Spans are half-open byte
ranges, maximal and in order.

shared_passages() looks for shorter passages, counted in words, in the same way: the anchor of each window of
words is its smallest-hash run.  Texts that have an anchor with all its windows' words in common share a passage; the
windows of the rest, as far as another text has their anchor, are compared one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuebase.llm.common import bounded_batches, broadcast_if, materialise, release
from cuebase.llm.textbatch import BYTE_CODES, U64, mix64, powers, sequence_hashes, signed, slices, span_hashes, text_buffer, words

Q = 32
#: Bytes of text that are hashed at once; the low bits of a packed hash hold a position below 2**21.
CHUNK = 1_000_000
POSITION_BITS = 21
#: Words in a run that is an anchor of shared_passages().
RUN = 24
#: Window starts of one anchor that are judged together, round by round.
NARROWER = (48, 8, 1)
#: Most cells or spans (8 bytes each) that are sent to every task; more are shuffled together with the texts.
SENT_MOST = 3_000_000
_K = U64(0xFF51AFD7ED558CCD)


def gram_names(data: np.ndarray) -> np.ndarray:
    """Bucket of the q-gram at each position, by doubling: a run's name comes from the names of its halves."""
    h, width = BYTE_CODES[data], 1
    with np.errstate(over="ignore"):
        while width < Q:
            n = len(h) - width
            if n <= 0:
                return h[:0]
            h = (h[:n] * _K) ^ h[width : width + n]
            h ^= h >> U64(29)
            h *= U64(0x9E3779B97F4A7C15)
            width *= 2
    return mix64(h)


def window_names(grams: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Name of each window from the bucket identifiers at its later offsets (every Q bytes, and the last)."""
    with np.errstate(over="ignore"):
        h = mix64((end - start).astype(U64) * U64(0xD6E8FEB86659FD93) + salt.astype(U64))
        for k in range(-(-int((end - start).max(initial=Q)) // Q)):
            h ^= grams[np.minimum(start + Q * k, end - Q)]
            h *= _K
            h ^= h >> U64(32)
    return mix64(h)


def anchors(grams: np.ndarray, offsets: np.ndarray, least: int, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start): the runs of window starts that share an anchor, positions in the buffer."""
    wide = least - q + 1
    lengths = np.diff(offsets)
    count = np.maximum(lengths - least + 1, 0)
    if not count.sum():
        e = np.empty(0, dtype=np.int64)
        return e, e, e
    low = (grams >> U64(POSITION_BITS) << U64(POSITION_BITS)) | np.arange(len(grams), dtype=U64)
    width = 1
    while width * 2 <= wide:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < wide:
        low = np.minimum(low[: len(low) - (wide - width)], low[wide - width :])
    starts = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    at = (low[starts] & U64((1 << POSITION_BITS) - 1)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[cut], starts[cut], starts[np.r_[cut[1:] - 1, len(at) - 1]]


def packed(anchor: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """A cell: its anchor and the largest and smallest distance of a window start before it."""
    return anchor << 20 | most << 10 | least


def _rows(key: pa.Array, number: np.ndarray, base: np.ndarray, grams, anchor, most, least, width: int, length: int, weight: np.ndarray) -> pa.RecordBatch:
    """One row per cell: bucket (what all its windows share), reach (all that they cover), owner and weight."""
    step = least // width
    bucket = window_names(grams, anchor - width * step, anchor - width * step - (width - 1) + length, step * 1024 + width)
    reach = window_names(grams, anchor - most, anchor - least + length, (most << 20) + (least << 10) + width)
    return pa.RecordBatch.from_arrays(
        [signed(bucket), signed(reach), key.take(pa.array(number)), packed(anchor - base, most, least), weight.astype(np.int32)], names=["bucket", "reach", "key", "cell", "weight"]
    )


def _first(least: int):
    """The anchors of each text."""
    wide = least - Q + 1

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                data, offsets = text_buffer(part.column(1))
                for lo in range(0, len(data), CHUNK):  # only one text can be longer than a chunk
                    if lo and lo + least > len(data):
                        break
                    own = data[lo : lo + CHUNK + least - 1]
                    cuts = offsets if len(data) <= CHUNK else np.array([0, len(own)])
                    grams = gram_names(own)
                    at, s, e = anchors(grams, cuts, least)
                    if not len(at):
                        continue
                    number = np.searchsorted(cuts, at, side="right") - 1
                    if len(data) > CHUNK:
                        number, base = np.zeros_like(at) + int(np.argmax(np.diff(offsets))), np.zeros_like(at) - lo
                    else:
                        base = cuts[number]
                    yield _rows(part.column(0), number, base, grams, at, at - s, at - e, wide, least, np.ones(len(at), dtype=np.int32))

    return run


def _again(least: int, width: int):
    """Cut the cells of each text into narrower ones."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                data, offsets = text_buffer(part.column(1))
                cells = part.column(2)
                owner = np.repeat(np.arange(len(part)), cells.value_lengths().to_numpy(zero_copy_only=False))
                flat = cells.flatten()
                cell, weight = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
                at, most, lo = cell >> 20, cell >> 10 & 1023, cell & 1023
                count = most // width - lo // width + 1
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo // width, count)
                at, most, lo, owner, weight = (np.repeat(x, count) for x in (at, most, lo, owner, weight))
                most, lo = np.minimum(most, step * width + width - 1), np.maximum(lo, step * width)
                base = offsets[owner]
                for lo_byte in range(0, max(len(data), 1), CHUNK):  # more than one round for a text longer than a chunk only
                    left = max(0, lo_byte - 1024)
                    inside = np.flatnonzero((at + base >= lo_byte) & (at + base < lo_byte + CHUNK))
                    grams = gram_names(data[left : lo_byte + CHUNK + least]) if len(inside) else None
                    for a in range(0, len(inside), 200_000):
                        b = inside[a : a + 200_000]
                        yield _rows(part.column(0), owner[b], base[b] - left, grams, (at + base)[b] - left, most[b], lo[b], width, least, weight[b])

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ROW = "bucket long, reach long, key binary, cell long, weight int"


def _settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells whose windows all repeat, cells to refine) of one round."""
    classes = rows.groupBy("bucket", "reach").agg(F.sum("weight").alias("n"), F.count("*").alias("rows"), F.min(F.struct("key", "cell")).alias("one"))
    classes = materialise(classes.where("n > 1").withColumn("multi", F.lit(True)).unionByName(classes.where("n = 1").withColumn("multi", F.lit(False))), "classes")
    alike = classes.where("rows > 1").select("bucket", "reach")
    repeated = rows.join(alike, ["bucket", "reach"]).select("key", "cell").unionByName(classes.where("rows = 1 and n > 1").select("one.key", "one.cell"))
    open_ = classes.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket")
    further = classes.join(open_, "bucket").select("one.key", "one.cell", F.least("n", F.lit(2)).cast("int").alias("weight"))
    return repeated, further


def _merge(least: int):
    """The maximal spans of each text's cells."""
    def run(batches):
        for batch in batches:
            spans = []
            for cells in batch.column(1):
                c = np.asarray(cells.values)
                start, end = (c >> 20) - (c >> 10 & 1023), (c >> 20) - (c & 1023) + least
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate(end[order])
                first = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
                spans.append([{"start": x, "end": y} for x, y in zip(start[first].tolist(), end[np.r_[first[1:] - 1, len(end) - 1]].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], names=["key", "spans"])

    return run


def _cut(batches):
    """Take the spans out of each text."""
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = text_buffer(part.column(1))
            kept, spans = [], [x or [] for x in part.column(2).to_pylist()]
            for i, own in enumerate(spans):
                raw, stay, last = data[offsets[i] : offsets[i + 1]], [], 0
                for x in own:
                    stay.append(raw[last : x["start"]])
                    last = x["end"]
                stay.append(raw[last:])
                kept.append(b"".join(x.tobytes() for x in stay))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array(np.diff(offsets)), pa.array(spans, _SPANS), pa.array(kept, pa.binary())], names=["id", "key", "n_bytes", "spans", "kept"])


def text_key(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("key")


def run_names(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit name of the words from start to end."""
    with np.errstate(over="ignore"):
        up, down = powers(len(codes) + 1)
        sums = np.r_[U64(0), np.cumsum(codes * up[:-1], dtype=U64)]
        return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * _K)


def _word_anchors(part: pa.RecordBatch, least: int):
    """(words, anchor, first start, last start, text) of the windows of `least` words, in pieces of as many words as an anchor's position can count."""
    data, offsets = text_buffer(part.column(1))
    start, end, text = words(data, offsets)
    codes = span_hashes(data, start, end, lower=False)
    cuts = np.searchsorted(text, np.arange(len(part) + 1))
    step = (1 << POSITION_BITS) - least
    for lo in range(0, max(len(codes) - least + 1, 0), step):
        own = np.clip(cuts, lo, min(lo + step + least - 1, len(codes))) - lo
        piece = codes[lo : lo + step + least - 1]
        grams = sequence_hashes(piece, RUN)
        at, first, last = anchors(grams, own, least, RUN)
        if len(at):
            yield piece, grams[at], first, last, np.searchsorted(own, at, side="right") - 1


def _runs(least: int):
    """(run, reach, key) of the anchors of each text: the anchor's words, and all words of its windows."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                for codes, name, first, last, text in _word_anchors(part, least):
                    yield pa.RecordBatch.from_arrays([signed(name), signed(run_names(codes, first, last + least)), part.column(0).take(pa.array(text))], names=["run", "reach", "key"])

    return run


def _windows(least: int):
    """(window, key) of the windows whose anchors are among the text's runs."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                asked = part.column(2).flatten().to_numpy(zero_copy_only=False).view(U64)
                for codes, name, first, last, text in _word_anchors(part, least):
                    of = np.flatnonzero(np.isin(name, asked))
                    count = (last - first + 1)[of]
                    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first[of], count)
                    yield pa.RecordBatch.from_arrays([signed(run_names(codes, start, start + least)), part.column(0).take(pa.array(np.repeat(text[of], count)))], names=["window", "key"])

    return run


def _of_several(rows: DataFrame, *names: str) -> DataFrame:
    """The names that rows of different texts have."""
    return rows.groupBy(*names).agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select(*names)


def shared_passages(docs: DataFrame, text_col: str = "text", least: int = 51) -> DataFrame:
    """(key) of the texts that share a passage of `least` words, case kept, with a different text; equal texts are one text."""
    texts = bounded_batches(docs).select(text_key(text_col), F.col(text_col).alias("text"))
    rows = materialise(texts.mapInArrow(_runs(least), "run long, reach long, key binary"), "runs")
    # the names that several texts have are written first: sent to all tasks, or joined so that Spark can split what a frequent one has
    alike, often = (materialise(_of_several(rows, *names), "several") for names in (("run", "reach"), ("run",)))
    whole = materialise(rows.join(broadcast_if(alike, alike.count(), SENT_MOST // 2), ["run", "reach"]).select("key").distinct(), "settled")
    # a text that is not settled yet shares a passage only in windows whose anchor another text has
    met = rows.join(broadcast_if(often, often.count(), SENT_MOST), "run").select("run", "key")
    asked = materialise(met.join(whole, "key", "left_anti").select("run").distinct(), "asked")
    keys = materialise(rows.select("run", "key").distinct().join(broadcast_if(asked, asked.count(), SENT_MOST), "run").groupBy("key").agg(F.collect_list("run").alias("runs")), "keys")
    size = keys.agg(F.sum(F.size("runs") + 2)).first()[0] or 0
    held = texts.join(broadcast_if(keys, size, SENT_MOST), "key").select("key", "text", "runs")
    windows = materialise(held.mapInArrow(_windows(least), "window long, key binary").distinct(), "windows")
    same = materialise(_of_several(windows, "window"), "several")
    found = windows.join(broadcast_if(same, same.count(), SENT_MOST), "window").select("key")
    out = materialise(whole.unionByName(found).distinct(), "passages")
    release(rows, alike, often, whole, asked, keys, windows, same)
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 400) -> DataFrame:
    """One row per document: id, key (names the text), n_bytes, spans array<struct<start, end>>, kept binary."""
    assert 2 * Q <= least <= 1000
    texts = bounded_batches(docs).select(text_key(text_col), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    long_ones = texts.where(F.octet_length("text") >= least).select("key", "text")
    rows = materialise(long_ones.mapInArrow(_first(least), _ROW), "anchors")
    repeated, further = _settle(rows)
    further = materialise(further, "cells")
    found, used = [repeated], [rows, further]
    if not further.isEmpty():
        keys = materialise(further.select("key").distinct(), "keys")
        own = materialise(long_ones.join(broadcast_if(keys, keys.count(), SENT_MOST // 2), "key").groupBy("key").agg(F.first("text").alias("text")), "texts")
        for width in [w for w in NARROWER if w < least - Q + 1]:
            cells = further.groupBy("key").agg(F.collect_list(F.struct("cell", "weight")).alias("cells"))
            joined = own.join(broadcast_if(cells, further.count(), SENT_MOST), "key")
            rows = materialise(joined.select("key", "text", "cells").mapInArrow(_again(least, width), _ROW), "refined")
            repeated, further = _settle(rows)
            found.append(repeated)
            used.append(rows)
            if width > 1:
                further = materialise(further, "cells")
                used.append(further)
        used.extend([keys, own])
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    merged = spans.groupBy("key").agg(F.collect_set("cell").alias("cells")).mapInArrow(_merge(least), "key binary, spans array<struct<start:long,end:long>>")
    merged = materialise(merged, "spans")
    release(*used)
    size = merged.agg(F.sum(2 * F.size("spans") + 3)).first()[0] or 0
    return texts.join(broadcast_if(merged, size, SENT_MOST), "key", "left").select("id", "text", "spans", "key").mapInArrow(
        _cut, f"id {dict(docs.dtypes)[id_col]}, key binary, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    ).withColumnRenamed("id", id_col)
