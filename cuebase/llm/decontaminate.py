"""Benchmark decontamination: BM25 index of the test items, block-max WAND, question and answer check.

The inverted index is over the benchmark items.  Every passage of every document is a
query: a window of 2 * S words that moves by S, with S at least the longest
item's length, so a copy of an item lies whole in some window.  Items of over ITEM_BYTES
bytes have indexes of their own, one for each doubling of the length, with an S of their own,
so a long item neither widens the windows of the short ones nor is cut.  A score is the
BM25 sum of the item's words that the passage holds, over the item's score for
itself, so one threshold serves all items.  Words are runs of letters and digits, lower-cased in every alphabet.

Items lie in blocks; a posting list keeps its largest impact as a whole and in each block.  A passage's
lists are ordered by their largest impact.  The pivot is the last list from which on the rest could still
reach the threshold together: only blocks in the pivot's list or an earlier one can hold a result, and the later (common) words
are not read but looked up in those blocks.  A block whose bound stays below the threshold, with the later lists'
largest impacts first and their impacts in that block then, is skipped; the others are scored in full, so no
pair above the threshold is missed.  NumPy does this for a batch of passages at once.

The number of items, the document frequencies, the mean length and S are counted by Spark over the whole
benchmark, so scores do not depend on how its items are cut into indexes.  A benchmark of up to PASS_BYTES
takes one pass over the documents.

Passages above the threshold are verified: the share of the question's word trigrams
(in order) and of the answer's words that the passage holds.

Defined cases: null or blank texts and items match nothing; an item without an id is an item
like others and is reported with a null item_id; equal items are reported one by one;
repeated documents are reported each; an empty benchmark or table gives an empty result; other
columns are ignored.  Items without a marked answer take their last quarter of words as answer.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuebase.llm.common import bounded_batches, broadcast_if, materialise
from cuebase.llm.textbatch import U64, sequence_hashes, signed, slices, span_hashes, text_buffer

#: Most bytes of item texts that one pass sends to every task (one item at least); a larger benchmark takes several.
PASS_BYTES = 20_000_000
#: Longest text, in bytes, of a short item; short items share one stride.
ITEM_BYTES = 20_000
#: Most entries of posting lists, or lookups in them, worked on at a time.
CELLS_MOST = 1 << 21
BLOCK = 8
#: Most blocks of an index whose lists are all read; with more, those after the pivot are only looked up.
DIRECT_BLOCKS = 64
#: Fixed values of BM25.
K1, B = 1.2, 0.75
LEAST_STRIDE = 32
#: What bounds allow for rounding.
SLACK = 1e-4
#: Most leaking texts named in a broadcast; beyond, the texts are shuffled.
NAMED_MOST = 1_000_000
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ANSWER = re.compile(r"(?is)^(.*?)(?:\banswer\s*:|\?)\s*(\S.*)$")


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each run of letters and digits, A-Z lower-cased."""
    if not len(data):
        return np.empty(0, dtype=U64), np.empty(0, dtype=np.int64)
    solid = np.zeros(len(data) + 1, dtype=bool)
    solid[:-1] = _WORD[data]
    cuts = np.zeros(len(data) + 1, dtype=bool)
    cuts[offsets] = True
    first = solid[:-1].copy()
    first[1:] &= ~solid[:-2] | cuts[1:-1]
    last = solid[:-1] & (~solid[1:] | cuts[1:])
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(data, start, end), np.searchsorted(offsets, start, side="right") - 1


def hashed(text: str) -> np.ndarray:
    raw = np.frombuffer(pc.utf8_lower(pa.scalar(text)).as_py().encode(), dtype=np.uint8)
    return plain_words(raw, np.array([0, len(raw)]))[0]


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after the other."""
    before = np.cumsum(count) - count
    return np.arange(count.sum()) + np.repeat(start - before, count)


class Index:
    """Sparse postings of the items, ordered by word and block, and the parts to verify.

    Entry e of `entry_*` is one word in one block: its largest impact, and its run of `post_*`; `top` is each word's
    largest impact.  items: (item_id, text); n, mean, stride: of the whole benchmark; words, df: its document
    frequencies, those of the items' words at least, ordered by word.
    """

    def __init__(self, items: list[tuple[int | None, str]], n: int, mean: float, stride: int, words: np.ndarray, df: np.ndarray):
        items = [(i, t, bag) for i, t in items if t and len(bag := hashed(t))]
        bags = [x[2] for x in items]
        self.vocabulary = np.unique(np.concatenate(bags)) if bags else np.empty(0, dtype=U64)
        own, size = len(items), len(self.vocabulary)
        length = np.array([len(x) for x in bags], dtype=np.float64)
        item = np.repeat(np.arange(own), length.astype(np.int64))
        term = np.searchsorted(self.vocabulary, np.concatenate(bags)) if own else np.empty(0, dtype=np.int64)
        pair, tf = np.unique(item * max(size, 1) + term, return_counts=True)
        item, term = pair // max(size, 1), pair % max(size, 1)
        df = df[np.searchsorted(words, self.vocabulary)]
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / max(mean, 1)))
        impact /= np.maximum(np.bincount(item, impact, minlength=own), 1e-9)[item]
        # similar items share a block: order by their heaviest word, which keeps the bounds tight
        heavy = np.lexsort((-impact, item))
        heavy = term[heavy[np.r_[True, item[1:] != item[:-1]]]] if own else term
        order = np.argsort(heavy, kind="stable")
        place = np.empty(own, dtype=np.int64)
        place[order] = np.arange(own)
        self.ids = [items[j][0] for j in order]
        self.blocks = max(1, -(-own // BLOCK))
        by = np.lexsort((place[item], term))
        term, self.post_item, self.post_impact = term[by], place[item[by]].astype(np.int32), impact[by].astype(np.float32)
        entry = term * self.blocks + self.post_item // BLOCK
        self.entry_start = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]]) if own else entry
        self.entry_key = entry[self.entry_start]
        self.entry_count = np.diff(np.r_[self.entry_start, len(entry)]).astype(np.int32)
        self.entry_bound = np.maximum.reduceat(self.post_impact, self.entry_start) if own else self.post_impact
        self.first = np.searchsorted(self.entry_key, np.arange(size + 1) * self.blocks)
        self.top = np.maximum.reduceat(self.entry_bound, self.first[:-1]).astype(np.float64) if size else np.empty(0)
        self.by_top = np.argsort(-self.top, kind="stable")  # words by their largest impact, and each word's place among them
        self.rank = np.argsort(self.by_top)
        self.maybe = np.zeros(1 << 20, dtype=bool)  # a cheap first look at a word's low bits
        self.maybe[self.vocabulary & U64((1 << 20) - 1)] = True
        self.stride = max(LEAST_STRIDE, stride)
        parts = [self._parts(items[j][1]) for j in order]
        self.parts, self.widths = [p[:2] for p in parts], [p[2] for p in parts]

    @staticmethod
    def _parts(text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Trigrams of the question (shorter runs if it is shorter), distinct words of the answer, words in a run."""
        if m := _ANSWER.match(text):
            question, answer = hashed(m[1]), hashed(m[2])
        else:
            w = hashed(text)
            cut = len(w) - max(1, len(w) // 4)
            question, answer = w[:cut], w[cut:]
        width = min(3, max(1, len(question)))
        return np.unique(sequence_hashes(question, width)), np.unique(answer), width


def scored(index: Index, window: np.ndarray, term: np.ndarray, threshold: float):
    """(window, item, score) of the pairs that reach the threshold; distinct (window, term) pairs, by window and then by falling impact."""
    top = index.top[term]
    cut = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
    end = np.r_[cut[1:], len(window)]
    sums = np.r_[0.0, np.cumsum(top)]
    # what this list and the later ones can add up to; lists up to the pivot reach the threshold
    rest = np.repeat(sums[end], end - cut) - sums[:-1]
    heads = np.add.reduceat((rest >= threshold - SLACK).astype(np.int64), cut)
    live = heads > 0
    cut, end, pivot = cut[live], end[live], (cut + heads)[live]
    if index.blocks <= DIRECT_BLOCKS:
        pivot = end  # reading all lists costs less than looking some up
    light = sums[end] - sums[pivot]
    reads = np.r_[0, np.cumsum(index.first[term + 1] - index.first[term])]
    cost = np.cumsum(reads[pivot] - reads[cut])
    lo = 0
    while lo < len(cut):
        # as many windows at a time as keep the work arrays small, one at least
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + CELLS_MOST, side="right")))
        at = expand(cut[lo:hi], pivot[lo:hi] - cut[lo:hi])
        reach = index.first[term[at] + 1] - index.first[term[at]]
        entry = expand(index.first[term[at]], reach)
        rank = np.repeat(np.repeat(np.arange(hi - lo), pivot[lo:hi] - cut[lo:hi]), reach)
        of = rank * index.blocks + index.entry_key[entry] % index.blocks
        if (hi - lo) * index.blocks > 2 * len(of):
            # only the (window, block) pairs that a list touches
            pairs, of = np.unique(of, return_inverse=True)
        else:
            pairs = np.arange((hi - lo) * index.blocks)
        bound = np.bincount(of, index.entry_bound[entry], minlength=len(pairs))
        keep = (bound > 0) & (bound + light[lo + pairs // index.blocks] >= threshold - SLACK)
        cells, inside = pairs[keep] + lo * index.blocks, keep[of]
        entry, of, bound = entry[inside], (np.cumsum(keep) - 1)[of[inside]], bound[keep]
        by = np.argsort(of, kind="stable")
        entry, of = entry[by], of[by]
        later = (end - pivot)[cells // index.blocks]
        probes = np.cumsum(later)
        a = 0
        while a < len(cells):
            b = max(a + 1, int(np.searchsorted(probes, (probes[a - 1] if a else 0) + CELLS_MOST, side="right")))
            own, w = cells[a:b] % index.blocks, cells[a:b] // index.blocks
            c = np.repeat(np.arange(b - a), later[a:b])
            key = term[expand(pivot[w], later[a:b])] * index.blocks + own[c]
            e = np.minimum(np.searchsorted(index.entry_key, key), max(len(index.entry_key) - 1, 0))
            hit = index.entry_key[e] == key
            e, c = e[hit], c[hit]
            good = bound[a:b] + np.bincount(c, index.entry_bound[e], minlength=b - a) >= threshold - SLACK
            mine = slice(*np.searchsorted(of, [a, b]))
            e, c = np.concatenate([entry[mine], e]), np.concatenate([of[mine] - a, c])
            e, c = e[good[c]], c[good[c]]
            posts = expand(index.entry_start[e], index.entry_count[e])
            score = np.bincount(np.repeat(c, index.entry_count[e]) * BLOCK + index.post_item[posts] % BLOCK, index.post_impact[posts], minlength=(b - a) * BLOCK)
            for i in np.flatnonzero(score >= threshold - 1e-6).tolist():
                yield int(window[cut[w[i // BLOCK]]]), int(own[i // BLOCK]) * BLOCK + i % BLOCK, round(float(score[i]), 6)
            a = b
        lo = hi


def search(indexes, threshold: float, question_least: float, answer_least: float):
    """(id, text) batches to (id, item_id, score, question_overlap, answer_overlap), the best passage of each pair; indexes is broadcast."""

    def windows(index, codes, text, n):
        s, size = index.stride, max(1, len(index.vocabulary))
        if not len(codes) or not index.ids:
            return []
        first = np.searchsorted(text, np.arange(n + 1))
        # segment numbers run through all texts; a text ends its own
        base = np.concatenate([[0], np.cumsum(-(-np.diff(first) // s))])
        hit = np.flatnonzero(index.maybe[codes & U64((1 << 20) - 1)])
        term = np.searchsorted(index.vocabulary, codes[hit])
        term[term == len(index.vocabulary)] = 0
        known = index.vocabulary[term] == codes[hit]
        hit, term = hit[known], term[known]
        owner, term = text[hit], index.rank[term]
        seg = base[owner] + (hit - first[owner]) // s
        # window w holds segments w and w + 1 of one text
        back = seg > base[owner]
        keys = np.concatenate([seg * size + term, (seg[back] - 1) * size + term[back]])
        if not len(keys):
            return []
        keys.sort()
        keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
        found = {}
        for top, item, score in scored(index, keys // size, index.by_top[keys % size], threshold):
            t = int(np.searchsorted(base, top, side="right") - 1)
            begin = first[t] + (top - base[t]) * s
            own = codes[begin : min(begin + 2 * s, first[t + 1])]
            question, answer = index.parts[item]
            q = float(np.isin(question, sequence_hashes(own, index.widths[item])).mean()) if len(question) else 1.0
            a = float(np.isin(answer, own).mean()) if len(answer) else 1.0
            if q >= question_least and a >= answer_least:
                found[t, item] = max(found.get((t, item), (0.0, 0.0, 0.0)), (score, q, a))
        return [(t, index.ids[item], *x) for (t, item), x in sorted(found.items())]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffer(pc.utf8_lower(part.column(1)))
                codes, text = plain_words(data, offsets)
                rows = [r for index in indexes.value for r in windows(index, codes, text, len(offsets) - 1)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array([r[0] for r in rows]))] + [pa.array([r[k] for r in rows], pa.int64() if k == 1 else pa.float64()) for k in range(1, 5)],
                        names=["id", "item_id", "score", "question_overlap", "answer_overlap"],
                    )

    return run


def _item_words(batches):
    """(kind, slice, word, n): each item's distinct words, and one row without a word for its length."""
    for batch in batches:
        for part in slices(batch, "text"):
            codes, text = plain_words(*text_buffer(pc.utf8_lower(part.column(2))))
            cut = np.searchsorted(text, np.arange(len(part) + 1))
            bags = [np.unique(codes[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            at = pa.array(np.repeat(np.arange(len(part)), [len(x) for x in bags]))
            for rows, word, n in (
                (at, pa.array(signed(np.concatenate(bags)) if bags else []), pa.nulls(len(at), pa.int64())),
                (pa.array(np.arange(len(part))), pa.nulls(len(part), pa.int64()), pa.array(np.diff(cut))),
            ):
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), word, n], names=["kind", "slice", "word", "n"])


def passes(sliced: DataFrame) -> list[list[tuple[int, int]]]:
    """The (kind, slice) groups of items, put together as far as one pass over the documents may hold."""
    out, size = [], 0
    for r in sliced.groupBy("kind", "slice").agg(F.sum("bytes").alias("bytes")).orderBy("kind", "slice").collect():
        if not out or size + r.bytes > PASS_BYTES:
            out.append([])
            size = 0
        out[-1].append((r.kind, r.slice))
        size += r.bytes
    return out


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, question_least: float = 0.5, answer_least: float = 0.5
) -> DataFrame:
    """One row per (document, item) leak: id, item_id, score, question_overlap, answer_overlap."""
    spark = docs.sparkSession
    # short items are one kind; each doubling of the length beyond is another, with an index and a stride of its own
    size = F.octet_length("text")
    kind = F.when(size <= ITEM_BYTES, 0).otherwise(F.ceil(F.log2(size / F.lit(ITEM_BYTES)))).cast("int")
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text", size.cast("long").alias("bytes"), kind.alias("kind"))
    own = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(docs.dtypes)[id_col]}, item_id long, score double, question_overlap double, answer_overlap double"
    # slices by a hash of the text are close to even; each is a bounded set that every task gets
    parts = {r.kind: max(1, -(-r.bytes // PASS_BYTES)) for r in items.groupBy("kind").agg(F.sum("bytes").alias("bytes")).collect()}
    of = F.lit(1)
    for k, m in parts.items():
        of = F.when(F.col("kind") == k, m).otherwise(of)
    sliced = items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), of))
    words = materialise(sliced.select("kind", "slice", "text").mapInArrow(_item_words, "kind int, slice long, word long, n long"), "words")
    lengths = words.where("n > 0").groupBy("kind").agg(F.count("*").alias("items"), F.sum("n").alias("words"), F.max("n").alias("longest")).collect()
    n = sum(r["items"] for r in lengths)
    mean = sum(r.words for r in lengths) / max(n, 1)
    stride = {r.kind: r.longest for r in lengths}
    df = words.where("word is not null").groupBy("word").agg(F.count("*").alias("df"))

    def index(k: int, j: int) -> Index:
        mine = (F.col("kind") == k) & (F.col("slice") == j)
        table = df.join(words.where(mine & F.col("word").isNotNull()).select("word").distinct(), "word").toArrow()
        word = table["word"].to_numpy().view(U64)
        by = np.argsort(word)
        rows = sliced.where(mine).orderBy("item_id", "text").select("item_id", "text").collect()
        return Index([(r.item_id, r.text) for r in rows], n, mean, stride.get(k, 0), word[by], table["df"].to_numpy()[by])

    out = None
    for group in passes(sliced) or [[]]:
        indexes = spark.sparkContext.broadcast([index(k, j) for k, j in group])
        found = own.mapInArrow(search(indexes, threshold, question_least, answer_least), schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text holds no benchmark item; a row travels whole, so its columns may have any name."""
    own = docs.select(F.struct("*").alias("row"), F.xxhash64(text_col).alias("name"), F.col(text_col).alias("text"))
    leaks = materialise(find_leaks(own, benchmark, "name", "text").select(F.col("name").alias("leak")).distinct(), "leaks")
    return own.join(broadcast_if(leaks, leaks.count(), NAMED_MOST), F.col("name") == F.col("leak"), "left_anti").select("row.*")
