"""Hard-negative mining: exact inner-product search with length buckets and coordinate pruning.

Index.  Vectors become integers, floor(scale * x), and are laid out by label and falling length; BUCKET consecutive rows are a
bucket: one row with their ids, labels, integers, and for each coordinate the list of rows sorted by that coordinate of the
unit vector.  Copies of one vector are spread by a hash of their ids.

Search.  Anchors come in slices of SLICE_BYTES at most, each broadcast and held against all buckets, twice: for each
anchor's best rows of its own label (positives), then for the best rows of other labels whose score lies in the band that a positive's
score opens (negatives).  A task keeps the best of each anchor or band, whose least score is the anchor's threshold from then on.
A bucket whose greatest length cannot reach an anchor's threshold is skipped.  Else the threshold over both lengths is
a least cosine, and with that each focus coordinate of the anchor (its largest ones) has a range of feasible values: a part of the
bucket's sorted list.  Rows in all ranges are scored exactly; where the shortest range is still a large part of the bucket, pruning does
not pay and the whole bucket is scored as a matrix product.  The best of all tasks are merged by a window for each anchor or band.

Anchors are a stated share of the rows, so the work is their number times that of the rows, as of any exact search; nothing is sampled.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part; an empty vector scores 0, a
shorter one counts as ending in zeros; equal scores rank by rising id; repeated rows are rows of their own, an anchor's
positives are rows other than itself; a negative positive score opens no band; components beyond 2^62 and scores beyond
64 bits saturate; an empty table gives an empty result; other columns are ignored.  Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuebase.llm.common import bounded_batches, materialise
from cuebase.llm.textbatch import give_back

#: Rows of a bucket, and the least of one that ends with its label.
BUCKET, BUCKET_LEAST = 2048, 512
#: Bytes of anchors in one broadcast; anchors scored at once; focus coordinates; share of a bucket from which on all of it is scored.
SLICE_BYTES, GROUP, FOCUS, LARGE = 16_000_000, 128, 3, 0.25
#: What ranges and bounds allow for rounding.
SLACK = 1e-5
NONE, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
CODED = "row long, id long, label long, code binary, width int, norm double"
INDEX = "n int, width int, unit int, longest double, ids binary, rows binary, labels binary, codes binary, lists binary, sorted binary"


def integers(scale: float):
    """(row, id, label, vector) batches to CODED."""

    def run(batches):
        for batch in batches:
            vectors = batch.column(3)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            width = np.diff(vectors.offsets.to_numpy())
            with np.errstate(over="ignore"):
                code = np.clip(np.floor(scale * flat), -(2.0**62), 2.0**62)
            at = np.r_[0, np.cumsum(width)]
            norm = np.sqrt(np.array([np.dot(code[a:b], code[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], dtype=np.float64))
            raw = code.astype("<i8")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([raw[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array(width, pa.int32()), pa.array(norm, pa.float64())],
                names=["row", "id", "label", "code", "width", "norm"],
            )

    return run


def matrix(codes: pa.Array, width: int) -> np.ndarray:
    """The rows' integers, shorter rows filled up with zeros."""
    out = np.zeros((len(codes), width), dtype=np.int64)
    for i, raw in enumerate(codes):
        own = np.frombuffer(raw.as_buffer(), dtype="<i8")
        out[i, : len(own)] = own
    return out


def bucket_row(rows: pa.RecordBatch) -> pa.RecordBatch:
    width = max(rows.column("width").to_pylist())
    codes = matrix(rows.column("code"), width)
    norm = rows.column("norm").to_numpy()
    unit = (codes / np.maximum(norm, 1e-300)[:, None]).astype(np.float32)
    lists = np.argsort(unit, axis=0, kind="stable")
    by_value = np.take_along_axis(unit, lists, axis=0)
    most = int(np.abs(codes).max(initial=0))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    parts = [rows.column("id").to_numpy().astype("<i8"), rows.column("row").to_numpy().astype("<i8"), rows.column("label").to_numpy().astype("<i8"), codes.astype(kind), np.ascontiguousarray(lists.T).astype("<u2"), np.ascontiguousarray(by_value.T).astype("<f4")]
    columns = [pa.array([x], t) for x, t in ((len(rows), pa.int32()), (width, pa.int32()), (int(kind[-1]), pa.int32()), (float(norm.max()), pa.float64()))]
    return pa.RecordBatch.from_arrays(columns + [pa.array([x.tobytes()], pa.binary()) for x in parts], names=[c.split()[0] for c in INDEX.split(", ")])


def buckets(most: int, least: int):
    """CODED rows in the index's order to buckets: `most` rows, or fewer where a label ends that has `least`."""

    def run(batches):
        held, label = [], None

        def cut(n: int):
            nonlocal held
            whole = pa.Table.from_batches(held).combine_chunks()
            rest = whole.slice(n)
            held = rest.to_batches() if len(rest) else []
            return bucket_row(whole.slice(0, n).combine_chunks().to_batches()[0])

        for batch in batches:
            labels = batch.column("label").to_numpy()
            edge = np.flatnonzero(np.r_[len(labels) > 0, labels[1:] != labels[:-1]])
            for a, b in zip(edge, [*edge[1:], len(labels)], strict=True):
                size = sum(map(len, held))
                if size >= least and labels[a] != label:
                    yield cut(size)
                label = labels[a]
                held.append(batch.slice(a, b - a))
                while sum(map(len, held)) >= most:
                    yield cut(most)
        if held:
            yield cut(sum(map(len, held)))
        give_back()

    return run


def build_index(coded: DataFrame) -> DataFrame:
    """The buckets of all coded rows, by label and falling length; equal rows are dealt out by a hash."""
    keys = [F.col("label"), F.col("norm").desc(), F.xxhash64("id", "row")]
    return materialise(coded.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(buckets(BUCKET, BUCKET_LEAST), INDEX), "buckets")


class Anchors:
    """A slice of anchors: ids, rows, labels, integers, lengths and focus coordinates."""

    def __init__(self, table: pa.Table):
        self.ids, self.rows, self.labels = (table[c].to_numpy() for c in ("id", "row", "label"))
        self.codes = matrix(table["code"].combine_chunks() if len(table) else pa.array([], pa.binary()), max(table["width"].to_pylist(), default=0))
        self.norm = table["norm"].to_numpy()
        unit = self.codes / np.maximum(self.norm, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        self.angle = np.arccos(np.clip(np.take_along_axis(unit, self.focus, axis=1), -1, 1))
        self.largest = np.abs(self.codes).max(axis=1, initial=0)

    def __len__(self):
        return len(self.ids)


class Bucket:
    def __init__(self, row: dict):
        self.n, self.width, self.longest = row["n"].as_py(), row["width"].as_py(), row["longest"].as_py()
        self.ids, self.rows, self.labels = (np.frombuffer(row[c].as_buffer(), dtype="<i8") for c in ("ids", "rows", "labels"))
        self.codes = np.frombuffer(row["codes"].as_buffer(), dtype=f"<i{row['unit'].as_py()}").reshape(self.n, self.width)
        self.lists = np.frombuffer(row["lists"].as_buffer(), dtype="<u2").reshape(self.width, self.n)
        self.sorted = np.frombuffer(row["sorted"].as_buffer(), dtype="<f4").reshape(self.width, self.n)
        self.largest = int(np.abs(self.codes.astype(np.int64)).max(initial=0))
        self.dense = self.codes.astype(np.float64)

    def scores(self, anchors: Anchors, which: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Inner products of these anchors with the rows (all by default): floats where they are exact, else Python's integers."""
        w = min(self.width, anchors.codes.shape[1])
        mine, own = anchors.codes[which, :w], self.codes[:, :w] if rows is None else self.codes[rows, :w]
        if int(anchors.largest[which].max(initial=0)) * self.largest * max(w, 1) < 1 << 53:
            own = self.dense[:, :w] if rows is None else self.dense[rows, :w]
            return (mine.astype(np.float64) @ own.T).astype(np.int64)
        exact = np.dot(mine.astype(object), own.astype(object).T) if w else np.zeros((len(mine), len(own)), dtype=object)
        return np.clip(exact, NONE + 1, MOST).astype(np.int64)

    def candidates(self, anchors: Anchors, a: int, least: int) -> np.ndarray | None:
        """Rows that can reach the anchor's threshold; None: the whole bucket is to be scored."""
        reach = float(anchors.norm[a]) * self.longest
        if least <= 0 or reach == 0:
            return None if least <= 0 else np.empty(0, dtype=np.int64)
        cosine = least / reach
        if cosine > 1 + SLACK:
            return np.empty(0, dtype=np.int64)
        turn = np.arccos(min(cosine, 1.0))
        focus, angle = anchors.focus[a], anchors.angle[a]
        high = np.cos(np.maximum(angle - turn, 0)) + SLACK
        low = np.cos(np.minimum(angle + turn, np.pi)) - SLACK
        runs = [(f, *np.searchsorted(self.sorted[f], (lo, hi))) for f, lo, hi in zip(focus.tolist(), low, high, strict=True) if f < self.width]
        if not runs or min(e - s for _, s, e in runs) > LARGE * self.n:
            return None
        f, s, e = min(runs, key=lambda r: r[2] - r[1])
        found = self.lists[f, s:e].astype(np.int64)
        for g, s, e in runs:
            if g != f and len(found):
                inside = np.zeros(self.n, dtype=bool)
                inside[self.lists[g, s:e]] = True
                found = found[inside[found]]
        return found


def scored(bucket: Bucket, anchors: Anchors, least: np.ndarray, some: np.ndarray):
    """(anchor, rows, scores) of all rows of the bucket that can reach the anchors' thresholds; some: the anchors that are asked for."""
    some = some[(least[some] <= 0) | (anchors.norm[some] * bucket.longest * (1 + SLACK) >= least[some])]
    whole = []
    for a in some.tolist():
        rows = bucket.candidates(anchors, a, int(least[a]))
        if rows is None:
            whole.append(a)
        elif len(rows):
            yield a, rows, bucket.scores(anchors, np.array([a]), rows)[0]
    every = np.arange(bucket.n)
    for k in range(0, len(whole), GROUP):
        group = np.array(whole[k : k + GROUP])
        for a, own in zip(group.tolist(), bucket.scores(anchors, group), strict=True):
            yield a, every, own


class Best:
    """The k best (score, id, row) of each of n lists."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least, self.found = k, least.copy(), [np.empty((3, 0), dtype=np.int64) for _ in range(n)]

    def add(self, i: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(score) > self.k:
            cut = np.partition(score, len(score) - self.k)[len(score) - self.k]
            stay = score >= cut
            score, ids, rows = score[stay], ids[stay], rows[stay]
        both = np.concatenate([self.found[i], np.stack([score, ids, rows])], axis=1)
        self.found[i] = both[:, np.lexsort((both[2], both[1], -both[0]))[: self.k]]
        if self.found[i].shape[1] == self.k:
            self.least[i] = max(self.least[i], self.found[i][0, -1])

    def batch(self) -> pa.RecordBatch:
        n = [x.shape[1] for x in self.found]
        flat = np.concatenate(self.found, axis=1) if n else np.empty((3, 0), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(n)), n), pa.int32())] + [pa.array(x) for x in flat], names=["list", "score", "id", "row"])


def opened(batches):
    names = [c.split()[0] for c in INDEX.split(", ")]
    for batch in batches:
        for i in range(len(batch)):
            yield Bucket({c: batch.column(c)[i] for c in names})


def positives_of(slice_, k: int):
    """Buckets to the task's k best rows of each anchor's own label, other than itself."""

    def run(batches):
        anchors = slice_.value
        best = Best(len(anchors), k, np.full(len(anchors), NONE))
        for bucket in opened(batches):
            for a, rows, score in scored(bucket, anchors, best.least, np.flatnonzero(np.isin(anchors.labels, np.unique(bucket.labels)))):
                ok = (bucket.labels[rows] == anchors.labels[a]) & (bucket.rows[rows] != anchors.rows[a]) & (score >= best.least[a])
                if ok.any():
                    best.add(a, score[ok], bucket.ids[rows[ok]], bucket.rows[rows[ok]])
        yield best.batch()
        give_back()

    return run


def negatives_of(slice_, bands_, k: int):
    """Buckets to the task's k best rows of other labels in each band; bands: (anchor, least, most), by anchor."""

    def run(batches):
        anchors, (owner, low, high) = slice_.value, bands_.value
        best = Best(len(owner), k, low)
        first = np.searchsorted(owner, np.arange(len(anchors) + 1))
        asked = np.flatnonzero(np.diff(first))
        top = np.zeros(len(anchors), dtype=np.int64)
        np.maximum.at(top, owner, high)
        for bucket in opened(batches):
            least = np.full(len(anchors), MOST)
            np.minimum.at(least, owner, best.least)
            for a, rows, score in scored(bucket, anchors, least, asked):
                ok = (bucket.labels[rows] != anchors.labels[a]) & (score >= least[a]) & (score <= top[a])
                if not ok.any():
                    continue
                rows, score = rows[ok], score[ok]
                for i in range(first[a], first[a + 1]):
                    own = (score >= best.least[i]) & (score <= high[i])
                    if own.any():
                        best.add(i, score[own], bucket.ids[rows[own]], bucket.rows[rows[own]])
        yield best.batch()
        give_back()

    return run


def first_k(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("list").orderBy(F.col("score").desc(), "id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def coded_rows(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float) -> DataFrame:
    """CODED: the rows that take part."""
    label = F.col(label_col).cast("long") if dict(vectors.dtypes)[label_col] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(label_col)
    vector = F.col(vector_col).cast("array<double>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~odd)
    own = bounded_batches(whole).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), label.alias("label"), vector.alias("vector"))
    return materialise(own.mapInArrow(integers(scale), CODED), "coded")


def mine_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    band: tuple[int, int] = (30, 90),
    scale: float = 256,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); is_anchor: a condition on the column `id`; band: percent of the positive's score."""
    spark = vectors.sparkSession
    coded = coded_rows(vectors, id_col, label_col, vector_col, scale)
    index = build_index(coded)
    anchors = coded.where(is_anchor)
    size = anchors.agg(F.count("*").alias("n"), F.max("width").alias("width")).first()
    slices = max(1, -(-size.n * max(size.width or 1, 8) * 8 // SLICE_BYTES))
    out = None
    for j in range(slices):
        table = anchors.where(F.pmod(F.xxhash64("id", "row"), F.lit(slices)) == j).orderBy("id", "row").toArrow()
        own = Anchors(table)
        shared = spark.sparkContext.broadcast(own)
        found = first_k(index.mapInArrow(positives_of(shared, positives), "list int, score long, id long, row long"), positives).select("list", "score", "id", "row").orderBy("list", "rank").toArrow()
        owner, score = found["list"].to_numpy().astype(np.int64), found["score"].to_numpy()
        low = np.array([-(-band[0] * s // 100) for s in score.tolist()], dtype=np.int64)
        high = np.array([band[1] * s // 100 for s in score.tolist()], dtype=np.int64)
        open_ = low <= high
        bands = spark.sparkContext.broadcast((owner[open_], low[open_], high[open_]))
        # a slice's anchors with their positives: as bounded as the slice
        names = pa.table({"list": pa.array(np.arange(int(open_.sum())), pa.int32()), "anchor_id": own.ids[owner[open_]], "positive_id": found["id"].to_numpy()[open_], "positive_score": score[open_]})
        best = first_k(index.mapInArrow(negatives_of(shared, bands, negatives), "list int, score long, id long, row long"), negatives)
        got = best.join(spark.createDataFrame(names), "list").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = got if out is None else out.unionByName(got)
    return out
