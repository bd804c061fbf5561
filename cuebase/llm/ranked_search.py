"""Ranked lexical search: an inverted index in segments, searched by Block-Max MaxScore.

Index.  A task tokenises its documents and seals a segment for every SEGMENT_BYTES of text: one row with the
segment's vocabulary, its posting lists in compressed blocks and the documents' ids and lengths.  A segment's documents are
numbered by rising length, so a block's documents are of like length and its bound (largest tf, least length) is tight.
A block holds BLOCK postings as gaps and counts of 0, 1, 2 or 4 bytes each.  Nothing is shuffled; every row is indexed.
The statistics (documents, terms, document frequencies of the queries' terms) are sums over all segments, so
scores do not depend on how documents were cut into segments.

Search.  Queries are collected in slices of PASS_BYTES at most, one broadcast for each.  A task searches its segments one
by one and keeps a heap of k results for each query, whose least score is the threshold that the next segment starts with.  In a segment a
query's lists are ordered by their largest possible contribution.  Lists are read from the greatest on and their documents scored
until what the other lists can add together is below the threshold: those are not essential, since a document that is only
in them cannot be a result.  They are not read but looked up: a candidate whose score, with the bound of the one block that could hold it and
the bounds of the lists after, stays below the threshold is rejected before the block is decompressed.
The heaps of all tasks are merged by a window over (query, score).

Scores are 64-bit integers: a term's weight is floor(1000 ln((2N+2)/(2df+1))); it contributes weight * (10^9 tf div (1000 tf + 8 m)),
m = 25 + 75 n N div L.  Terms are maximal runs of ASCII letters, digits and non-ASCII characters, only A-Z lower-cased, known by 64-bit hashes.

Defined cases: null or term-less texts are in no result and not counted; queries without terms have no rows; equal queries are
answered one by one; equal scores rank by rising id, null ids last; repeated rows are documents of their own; a text is cut at term ends
when it is long, so it may have any length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuebase.llm.common import bounded_batches, materialise
from cuebase.llm.decontaminate import _WORD, expand, plain_words
from cuebase.llm.textbatch import U64, give_back, slices, text_buffer

#: Text of a segment; longest piece of a text that is tokenised at once; postings of a block.
SEGMENT_BYTES, PIECE_BYTES, BLOCK = 16 << 20, 1 << 20, 64
#: Most bytes of query texts that one pass sends to every task (one query at least).
PASS_BYTES = 4_000_000
WIDTHS = (0, 1, 2, 4)
#: The binary columns of a segment and the kinds of their numbers.
PARTS = {"lengths": "<i8", "vocabulary": "<u8", "df": "<i4", "first_block": "<i4", "block_doc": "<i4", "block_count": "u1", "block_tf": "<i4", "block_length": "<i8", "block_at": "<i8", "block_width": "u1", "data": "u1"}


def pieces(data: np.ndarray, offsets: np.ndarray, most: int):
    """(bytes, offsets) of the texts, a long one alone in pieces that end between terms."""
    if len(data) <= most or len(offsets) > 2:
        yield data, offsets
        return
    at = 0
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data) and _WORD[data[end]]:
            gap = np.flatnonzero(~_WORD[data[end : end + most]])
            end = end + int(gap[0]) if len(gap) else min(end + most, len(data))
        yield data[at:end], np.array([0, end - at])
        at = end


def counted(term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (term, doc) pairs in order and the sums of their tf."""
    if not len(term):
        return term, doc, tf
    by = np.lexsort((doc, term))
    term, doc, tf = term[by], doc[by], tf[by]
    start = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])
    return term[start], doc[start], np.add.reduceat(tf, start)


def width_of(largest: np.ndarray) -> np.ndarray:
    """Bytes that hold these numbers."""
    return np.select([largest == 0, largest < 1 << 8, largest < 1 << 16], WIDTHS[:3], WIDTHS[3]).astype(np.uint8)


def pack(values: np.ndarray, count: np.ndarray, width: np.ndarray, at: np.ndarray, data: np.ndarray) -> None:
    """Write the blocks' values, one block after the other, at their places in data."""
    start = np.cumsum(count) - count
    for w in WIDTHS[1:]:
        own = np.flatnonzero(width == w)
        raw = values[expand(start[own], count[own])].astype(f"<u{w}").view(np.uint8)
        data[expand(at[own], count[own] * w)] = raw


def unpack(data: np.ndarray, count: np.ndarray, width: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(int(count.sum()), dtype=np.int64)
    start = np.cumsum(count) - count
    for w in WIDTHS[1:]:
        own = np.flatnonzero(width == w)
        if len(own):
            out[expand(start[own], count[own])] = data[expand(at[own], count[own] * w)].view(f"<u{w}")
    return out


def sealed(ids: list[pa.Array], lengths: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, id_type: pa.DataType, block: int) -> pa.RecordBatch:
    """The row of a segment; doc numbers and lengths are in order of arrival, documents without terms have length 0."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    place = np.zeros(len(lengths), dtype=np.int64)
    place[order] = np.arange(len(order))
    term, doc, tf = counted(term, place[doc], tf)
    length = lengths[order]
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    df = np.diff(np.r_[first, len(term)])
    blocks = -(-df // block)
    first_block = np.r_[0, np.cumsum(blocks)]
    start = expand(np.zeros_like(blocks), blocks) * block + np.repeat(first, blocks)
    count = np.minimum(np.repeat(first + df, blocks) - start, block)
    gap = np.diff(doc, prepend=0)
    gap[start] = 0
    gap_width = width_of(np.maximum.reduceat(gap, start))
    most = np.maximum.reduceat(tf, start)
    tf_width = width_of(most - 1)
    size = count * (gap_width.astype(np.int64) + tf_width)
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), dtype=np.uint8)
    pack(gap, count, gap_width, at, data)
    pack(tf - 1, count, tf_width, at + count * gap_width, data)
    # documents are in order of length: a block's first one is its shortest
    parts = [length, term[first], df, first_block, doc[start], count, most, length[doc[start]], at, gap_width * 16 + tf_width, data]
    names = pa.concat_arrays(ids).take(pa.array(order))
    columns = [pa.array([len(order)], pa.int64()), pa.array([int(length.sum())], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), names.cast(id_type))]
    columns += [pa.array([np.ascontiguousarray(x).astype(kind).tobytes()], pa.binary()) for x, kind in zip(parts, PARTS.values(), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["docs", "terms", "ids", *PARTS])


def indexer(segment_bytes: int, piece_bytes: int, block: int):
    """(id, text) batches to segments."""

    def run(batches):
        ids, lengths, found, held, kind = [], [], [], 0, None

        def seal():
            term, doc, tf = (np.concatenate([x[k] for x in found]) for k in range(3))
            return sealed(ids, np.concatenate(lengths), term, doc, tf, kind, block)

        for batch in batches:
            kind = batch.schema.field(0).type
            for part in slices(batch, "text", min(piece_bytes, segment_bytes)):
                data, offsets = text_buffer(part.column(1))
                base, n = sum(map(len, lengths)), np.zeros(len(part), dtype=np.int64)
                for raw, cuts in pieces(data, offsets, piece_bytes):
                    code, text = plain_words(raw, cuts)
                    n += np.bincount(text, minlength=len(part))
                    term, doc, tf = counted(code, text, np.ones(len(code), dtype=np.int64))
                    found.append((term, doc + base, tf))
                ids.append(part.column(0))
                lengths.append(n)
                held += len(data)
                if held >= segment_bytes:
                    if any(x.any() for x in lengths):
                        yield seal()
                    ids, lengths, found, held = [], [], [], 0
                    give_back()
        if any(x.any() for x in lengths):
            yield seal()

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of docs as a table of segments in the shared folder; it is read once for the statistics of a pass, and once for its search."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"docs long, terms long, ids array<{kind}>, " + ", ".join(f"{x} binary" for x in PARTS)
    own = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return materialise(own.mapInArrow(indexer(SEGMENT_BYTES, PIECE_BYTES, BLOCK), schema), "segments")


class Ranking:
    """The whole index's numbers that turn tf and a document's length into the integer contribution."""

    def __init__(self, docs: int, terms: int):
        self.docs, self.terms = docs, max(terms, 1)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df + 1)))

    def impact(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        if len(length) and 75 * int(length.max()) * self.docs >= 1 << 63:
            m = np.array([25 + 75 * int(n) * self.docs // self.terms for n in length], dtype=np.int64)
        else:
            m = 25 + 75 * length * self.docs // self.terms
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Segment:
    """A row of the index and the bounds of its blocks for the terms that are asked for."""

    def __init__(self, row: dict[str, pa.Scalar], ranking: Ranking, asked: np.ndarray):
        for name, kind in PARTS.items():
            setattr(self, name, np.frombuffer(row[name].as_buffer(), dtype=kind))
        self.ids, self.ranking, self._rank = row["ids"].values, ranking, None
        at = np.minimum(np.searchsorted(self.vocabulary, asked), len(self.vocabulary) - 1)
        self.known = self.vocabulary[at] == asked
        self.lists = at  # of each asked term, if known
        own = np.unique(at[self.known])
        run = np.diff(self.first_block)[own]
        blocks = expand(self.first_block[own].astype(np.int64), run)
        self.bound = np.zeros(len(self.block_doc), dtype=np.int64)
        self.bound[blocks] = ranking.impact(self.block_tf[blocks].astype(np.int64), self.block_length[blocks])
        self.top = np.zeros(len(self.vocabulary), dtype=np.int64)
        if len(own):
            self.top[own] = np.maximum.reduceat(self.bound[blocks], np.cumsum(run) - run)

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(doc, impact) of the blocks, decompressed."""
        count = self.block_count[blocks].astype(np.int64)
        gap_width, tf_width = self.block_width[blocks] >> 4, self.block_width[blocks] & 15
        gap = unpack(self.data, count, gap_width, self.block_at[blocks])
        tf = unpack(self.data, count, tf_width, self.block_at[blocks] + count * gap_width) + 1
        run = np.cumsum(gap)
        start = np.cumsum(count) - count
        doc = run - np.repeat(run[start] - self.block_doc[blocks], count)
        return doc, self.ranking.impact(tf, self.lengths[doc])

    def rank(self) -> np.ndarray:
        """Each document's place by rising id, null ids last."""
        if self._rank is None:
            by = pc.array_sort_indices(self.ids, null_placement="at_end").to_numpy()
            self._rank = np.empty(len(by), dtype=np.int64)
            self._rank[by] = np.arange(len(by))
        return self._rank

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, score) of the k best documents that score `least` or more, equal scores by id; terms: numbers of asked terms."""
        inside = self.known[terms] & (weights > 0)
        lists, weights = self.lists[terms[inside]], weights[inside]
        upper = weights * self.top[lists]
        order = np.argsort(-upper, kind="stable")
        lists, weights, upper = lists[order], weights[order], upper[order]
        # rest[j]: what list j and the later ones can add together
        rest = np.r_[np.cumsum(upper[::-1])[::-1], 0]
        score = np.zeros(len(self.lengths), dtype=np.int64)
        j = 0
        while j < len(lists) and rest[j] >= least:
            doc, impact = self.postings(np.arange(self.first_block[lists[j]], self.first_block[lists[j] + 1]))
            score[doc] += weights[j] * impact
            j += 1
            # the k-th best of what is known so far bounds the threshold from below
            if len(score) > k:
                least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))
        doc = np.flatnonzero((score > 0) & (score + rest[j] >= least))
        own = score[doc]
        for j in range(j, len(lists)):
            if not len(doc):
                break
            a, b = self.first_block[lists[j]], self.first_block[lists[j] + 1]
            block = a - 1 + np.searchsorted(self.block_doc[a:b], doc, side="right")
            bound = np.where(block >= a, weights[j] * self.bound[np.maximum(block, a)], 0)
            stay = own + bound + rest[j + 1] >= least
            doc, own, block = doc[stay], own[stay], block[stay]
            asked = np.unique(block[block >= a])
            if len(asked):
                there, impact = self.postings(asked)
                at = np.minimum(np.searchsorted(there, doc), len(there) - 1)
                own = own + np.where(there[at] == doc, weights[j] * impact[at], 0)
            if len(own) >= k:
                least = max(least, int(np.partition(own, len(own) - k)[len(own) - k]))
            stay = own + rest[j + 1] >= least
            doc, own = doc[stay], own[stay]
        best = np.lexsort((self.rank()[doc], -own))[:k]
        return doc[best], own[best]


def searcher(queries, ranking: Ranking, k: int):
    """Segments to (query, id, score): the k best of the task's segments; queries, broadcast: the asked terms and each query's (terms, weights)."""

    def run(batches):
        asked, wanted = queries.value
        heaps: list[list[tuple]] = [[] for _ in wanted]
        kind = None
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for i in range(len(batch)):
                segment = Segment({name: batch.column(name)[i] for name in ("ids", *PARTS)}, ranking, asked)
                for q, (terms, weights) in enumerate(wanted):
                    heap = heaps[q]
                    doc, score = segment.search(terms, weights, k, -heap[-1][0] if len(heap) == k else 1)
                    if len(doc):
                        heaps[q] = sorted([*heap, *((-s, x is None, x) for s, x in zip(score.tolist(), segment.ids.take(pa.array(doc)).to_pylist(), strict=True))], key=lambda r: (r[0], r[1], r[2] if not r[1] else 0))[:k]
        if kind is not None:
            rows = [(q, x, -s) for q, heap in enumerate(heaps) for s, _, x in heap]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], names=["query", "id", "score"])
        give_back()

    return run


def frequencies(asked):
    """Segments to (term number, df) of the asked terms, broadcast."""

    def run(batches):
        terms = asked.value
        total = np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for own, counts in zip(batch.column("vocabulary"), batch.column("df"), strict=True):
                own, counts = np.frombuffer(own.as_buffer(), dtype="<u8"), np.frombuffer(counts.as_buffer(), dtype="<i4")
                at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                total += np.where(own[at] == terms, counts[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["term", "df"])

    return run


def query_slices(queries: DataFrame, text_col: str) -> tuple[DataFrame, int]:
    """The queries with a slice number; slices are close to even by a hash, and there are as many as keep each within PASS_BYTES."""
    total = queries.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-total // PASS_BYTES))
    return queries.withColumn("slice", F.pmod(F.xxhash64("query_id", text_col), F.lit(n))), n


def ranked_search(
    docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", index: DataFrame | None = None
) -> DataFrame:
    """(query_id, rank, id_col, score): the k best documents of each query; index: what build_index() gave, else it is built."""
    spark = docs.sparkSession
    index = build_index(docs, id_col, text_col) if index is None else index
    whole = index.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    ranking = Ranking(whole.docs or 0, whole.terms or 0)
    sliced, n = query_slices(queries.select(F.col(query_id).alias("query_id"), F.col(query_text).alias("text")).where("text is not null"), "text")
    kind, name = dict(docs.dtypes)[id_col], dict(queries.dtypes)[query_id]
    out = None
    for j in range(n):
        rows = sliced.where(F.col("slice") == j).orderBy("query_id", "text").collect()
        bags = []
        for r in rows:
            raw = np.frombuffer(r.text.encode(), dtype=np.uint8)
            bags.append(np.unique(plain_words(raw, np.array([0, len(raw)]))[0], return_counts=True))
        asked = np.unique(np.concatenate([np.empty(0, dtype=U64), *(b[0] for b in bags)]))
        df = np.zeros(len(asked), dtype=np.int64)
        found = index.select("vocabulary", "df").mapInArrow(frequencies(spark.sparkContext.broadcast(asked)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df[found["term"].to_numpy()] = found["df"].to_numpy()
        weight = np.array([ranking.weight(int(x)) for x in df], dtype=np.int64)
        wanted = [(at, weight[at] * n_term) for at, n_term in ((np.searchsorted(asked, t), c) for t, c in bags)]
        heaps = index.select("ids", *PARTS).mapInArrow(searcher(spark.sparkContext.broadcast((asked, wanted)), ranking, k), f"query int, id {kind}, score long")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
        best = heaps.withColumn("rank", rank).where(F.col("rank") <= k)
        names = F.broadcast(spark.createDataFrame([(q, r.query_id) for q, r in enumerate(rows)], f"query int, query_id {name}"))
        got = best.join(names, "query").select(F.col("query_id").alias(query_id), "rank", F.col("id").alias(id_col), "score")
        out = got if out is None else out.unionByName(got)
    return out
