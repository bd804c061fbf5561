"""N-gram Jaccard self-join: a size-aware heavy-light join over word-shingle sets.

A document's set holds its distinct five-word shingles; two documents link when
100 * intersection >= 80 * union.  Documents with equal sets are one *node* (a
64-bit name of the set), so exact copies never meet each other.

* Small (light) sets enumerate fixed-size subsets: for each partner size they
  emit every subset of just the overlap that a link needs.  A shared subset is
  a proven link, so nothing is checked afterwards.
* Large (heavy) sets are scanned through inverted lists of their prefix: two
  linked sets share one of their n - ceil(0.8 n) + 1 rarest shingles.
* The boundary between both is the size at which the counted cost (subsets of
  all smaller sets plus list rows of all larger ones) is least.

An inverted list is not expanded into pairs.  Each member is first compared
with the member in which the shingle comes earliest (the most central one);
then components are drawn, and only pairs of one list that lie in different
components and pass the size and position bounds are compared.  Shingle order is
rarest first: the most frequent ones go last.  That table is bounded; its counts cover
all documents and leave out only shingles met once in a task's batch.  Any
common order gives the same result, so it only sets how fast the join runs.

Defined cases: null or blank text has the empty set, n_shingles 0, no links and
its own id as component; fewer than five words make one shingle; repeated rows
are one node; a component's id is its least non-null id, null if it has none; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuebase.llm.common import bounded_batches, broadcast_if, connected_components, materialise, release
from cuebase.llm.textbatch import U64, mix64, sequence_hashes, signed, slices, span_hashes, text_buffer, words

#: Most shingles that the order knows as frequent (16 bytes each, sent to every task).
FREQUENT = 1 << 17
#: Most ranges of counts that are told apart at once when the frequent shingles are chosen.
RANGES = 4096
#: Largest size that may count as light.
LIGHT_MOST = 16
#: Places of the subsets of light sets, by the set's role in the pair of sizes.
SMALLER, LARGER = -2, -1
#: Most texts to be compared that are named in a broadcast; beyond, the texts are shuffled.
NAMED_MOST = 1_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    start, end, text = words(data, offsets)
    codes = span_hashes(data, start, end)
    n = len(offsets) - 1
    bounds = np.searchsorted(text, np.arange(n + 1))
    runs = sequence_hashes(codes, width)
    out = []
    for i in range(n):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if b - a >= width:
            s = np.sort(runs[a : b - width + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        else:
            out.append(sequence_hashes(codes[a:b], b - a, salt=99) if b > a else runs[:0])
    return out


def set_name(s: np.ndarray) -> int | None:
    if not len(s):
        return None
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix64(s + U64(0x9E3779B97F4A7C15)), dtype=U64) + U64(len(s))
    return int(signed(mix64(np.array([total], dtype=U64)))[0])


def overlap_needed(n: int, m: int, percent: int) -> int:
    """Least intersection for 100 * i >= percent * (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def least_partner(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def partner_sizes(n: int, percent: int) -> range:
    return range(max(1, least_partner(n, percent)), 100 * n // percent + 1)


def subsets_of(n: int, percent: int) -> int:
    return sum(comb(n, overlap_needed(n, m, percent)) for m in partner_sizes(n, percent))


def boundary(sizes: dict[int, int], list_length: float, percent: int, most: int = LIGHT_MOST) -> int:
    """Largest size that counts as light, at the least total cost; sizes: documents by set size."""
    def cost(b: int) -> float:
        light = sum(k * subsets_of(n, percent) for n, k in sizes.items() if n <= b)
        heavy = sum(k * (n - least_partner(n, percent) + 1) * list_length for n, k in sizes.items() if b < n <= most)
        return light + heavy

    return min(range(most + 1), key=cost)


def _facts(width: int):
    """(doc, set name, size, text name) of each document, and (shingle, count) of those met twice in one task."""
    def run(batches):
        held, amount, kind = [], 0, pa.int64()

        def frequent():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            u, c = u[c > 1], c[c > 1]
            none = pa.nulls(len(u), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(u), kind), none, c.astype(np.int64), none, signed(u)], names=["id", "node", "n", "text_name", "shingle"])

        for batch in batches:
            kind = batch.column(0).type
            for part in slices(batch, "text"):
                sets = shingle_sets(*text_buffer(part.column(1)), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([set_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), part.column(2), pa.nulls(len(sets), pa.int64())],
                    names=["id", "node", "n", "text_name", "shingle"],
                )
                held += [s for s in sets if len(s)]
                amount += sum(map(len, sets))
                if amount > 2_000_000:
                    yield frequent()
                    held, amount = [], 0
        if held:
            yield frequent()

    return run


def _list_rows(width: int, percent: int, light: int, frequent):
    """(shingle or subset, node, n, place) of each set; places below 0 mark a subset of a light set.

    A subset is emitted for a pair of sizes.  It proves a link to a set of the smaller size only: two sets
    of the larger size would need to share more.
    """
    def run(batches):
        known, rank = frequent.value
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for s in shingle_sets(*text_buffer(part.column(0)), width):
                    n = len(s)
                    if not n:
                        continue
                    name = set_name(s)
                    if n <= light:
                        for m in (m for m in partner_sizes(n, percent) if m <= light):
                            keys = np.array([hash_subset(n, m, c) for c in combinations(s.tolist(), overlap_needed(n, m, percent))], dtype=U64)
                            out.append((keys, name, n, np.full(len(keys), SMALLER if n <= m else LARGER)))
                    if n > light or 100 * n >= percent * (light + 1):
                        if len(known):
                            at = np.searchsorted(known, s)
                            at[at == len(known)] = 0
                            often = known[at] == s
                            f = s[often]
                            s = np.concatenate([s[~often], f[np.argsort(rank[at[often]])]])
                        k = n - least_partner(n, percent) + 1
                        out.append((s[:k], name, n, np.arange(k)))
                if out:
                    count = [len(x[0]) for x in out]
                    yield pa.RecordBatch.from_arrays(
                        [signed(np.concatenate([x[0] for x in out])), np.repeat(np.array([x[1] for x in out], dtype=np.int64), count), np.repeat(np.array([x[2] for x in out], dtype=np.int32), count), np.concatenate([x[3] for x in out]).astype(np.int32)],
                        names=["shingle", "node", "n", "place"],
                    )

    return run


def most_frequent(often: DataFrame, most: int) -> DataFrame:
    """(shingle, n): the `most` rows of greatest n, 4 at least; of equal n those of least shingle.

    Counting narrows down the n at which the table is full, in so many ranges at a time that the driver holds; the rows
    of that n are cut by their hash first, so the last sort gets little more than it gives.
    """
    often = often.where("n >= 4")
    low, high, taken = 4, (often.agg(F.max("n")).first()[0] or 0) + 1, 0
    while low < high and most > 0:
        width = -(-(high - low) // RANGES)
        ranges = often.where((F.col("n") >= low) & (F.col("n") < high)).groupBy(F.expr(f"(n - {low}) div {width}").alias("r")).agg(F.count("*").alias("k"))
        for r in ranges.orderBy(F.desc("r")).collect():
            if taken + r.k > most:
                break
            taken += r.k
        else:
            return often
        low, high = low + r.r * width, min(low + (r.r + 1) * width, high)
        if width == 1:
            room = most - taken
            share = min(1.0, (room + 6 * room**0.5 + 100) / r.k)
            upto = min(2**63 - 1, int(2**64 * share) - 2**63)
            cut = often.where((F.col("n") > low) | (F.col("n") == low) & (F.col("shingle") <= F.lit(upto)))
            return cut.orderBy(F.desc("n"), "shingle").limit(most)
    return often.limit(0)


def hash_subset(n: int, m: int, subset: tuple[int, ...]) -> int:
    h = min(n, m) * 64 + max(n, m)
    for x in subset:
        h = ((h ^ x) * 0xFF51AFD7ED558CCD + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 32
    return h


def _checked(width: int, percent: int):
    """Keep the pairs (a, b) whose texts link."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "ta"):
                left, right = (shingle_sets(*text_buffer(part.column(k)), width) for k in (2, 3))
                ok = []
                for x, y in zip(left, right, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id, node, text_name, rep_id, rep_text.

    (rep_id, rep_text) name the component's representative: the row of its least id
    (nulls last), then of its least text_name.
    """
    spark = docs.sparkSession
    texts = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_name"))
    facts = materialise(texts.mapInArrow(_facts(width), f"id {dict(docs.dtypes)[id_col]}, node long, n long, text_name long, shingle long"), "sets")
    members = facts.where("shingle is null").drop("shingle")
    often = facts.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n"))
    often = materialise(often, "often")
    steps = often.agg(F.sum(F.least("n", F.lit(4096))).alias("mass"), F.count("*").alias("lists")).first()
    mass, lists = steps.mass or 0, steps.lists
    rows = most_frequent(often, FREQUENT).toArrow()
    by_rank = np.lexsort((rows["shingle"].to_numpy(), rows["n"].to_numpy()))
    known = rows["shingle"].to_numpy()[by_rank].view(U64)
    release(often)
    by_name = np.argsort(known)
    frequent = spark.sparkContext.broadcast((known[by_name], by_name))
    sizes = {r.n: r.k for r in members.where(F.col("n").between(1, LIGHT_MOST)).groupBy("n").agg(F.count("*").alias("k")).collect()}
    light = boundary(sizes, mass / lists if lists else 2.0, percent)

    lists = texts.select("text").mapInArrow(_list_rows(width, percent, light, frequent), "shingle long, node long, n int, place int")
    heads = (
        lists.groupBy("shingle")
        .agg(F.min(F.struct("place", "n", "node")).alias("head"), F.min("node").alias("lo"), F.max("node").alias("hi"))
        .where("lo <> hi")
        .select("shingle", F.col("head.place").alias("head_place"), F.col("head.n").alias("head_n"), F.col("head.node").alias("head"))
    )
    heads = materialise(heads, "heads")
    shared = materialise(lists.join(heads, "shingle").distinct(), "lists")
    release(heads)

    def may_link(n, place, m, other):
        need = F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))
        return F.least(n - place, m - other) >= need

    proven = (F.col("place") < 0) & (F.col("head_place") == SMALLER)
    star = shared.where("node <> head").where(proven | (F.col("place") >= 0) & may_link(F.col("n"), F.col("place"), F.col("head_n"), F.col("head_place")))
    star = materialise(star.groupBy(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).agg(F.min("place").alias("place")), "star")
    names = materialise(members.where("n > 0").groupBy("node").agg(F.min("text_name").alias("text_name")), "names")

    used = []

    def linked(pairs: DataFrame) -> DataFrame:
        wanted = materialise(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(names, "node"), "wanted")
        named = broadcast_if(wanted, wanted.count(), NAMED_MOST)
        own = texts.select("text_name", "text").join(named, "text_name").groupBy("node").agg(F.first("text").alias("text"))
        own = materialise(own, "texts")
        used.extend([wanted, own])
        left = own.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        right = own.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(_checked(width, percent), "a long, b long")

    first = materialise(linked(star.where("place >= 0")).unionByName(star.where("place < 0").select("a", "b")), "links")
    release(*used)
    roots = materialise(connected_components(first), "roots")
    release(first)
    # lists whose members still lie in several components
    rooted = shared.where("place >= 0").join(roots, "node", "left").select("shingle", "node", "n", "place", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle")
    rooted = materialise(rooted.join(mixed, "shingle", "left_semi"), "mixed")
    release(shared)
    x, y = rooted.alias("x"), rooted.alias("y")
    rest = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") > F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & may_link(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place")))
    rest = rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(star.select("a", "b"), ["a", "b"], "left_anti")
    rest = materialise(rest, "rest")
    release(rooted, star)
    used = [rest]
    more = linked(rest)
    links = materialise(more.join(roots, F.col("a") == F.col("node"), "left").select(F.coalesce("root", "a").alias("a"), "b").join(roots, F.col("b") == F.col("node"), "left").select("a", F.coalesce("root", "b").alias("b")), "links")
    release(*used)
    joined = connected_components(links)
    final = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    final = final.unionByName(joined.join(roots, "node", "left_anti").select("node", "root"))

    placed = members.join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = materialise(placed.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_name")).alias("rep")), "best")
    return placed.join(best, "root", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("rep.id")).otherwise(F.col("id")).alias("component_id"),
        "node",
        "text_name",
        F.when(F.col("n") > 0, F.col("rep.id")).otherwise(F.col("id")).alias("rep_id"),
        F.when(F.col("n") > 0, F.col("rep.text_name")).otherwise(F.col("text_name")).alias("rep_text"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without all but one document of each group; repeated rows stay once.

    Only the rows to drop (and those that repeat) are joined to the texts.  A row travels whole beside the join's
    own columns, so docs may have columns of any name.
    """
    groups = ngram_jaccard_join(docs, id_col, text_col, width, percent)
    keep = F.col(id_col).eqNullSafe(F.col("rep_id")) & F.col("text_name").eqNullSafe(F.col("rep_text"))
    rows = groups.groupBy(F.col(id_col).alias("x_id"), F.col("text_name").alias("x_name")).agg(F.max(keep).alias("x_keep"), F.count("*").alias("x_n"))
    rows = materialise(rows.where("not x_keep or x_n > 1"), "drop")
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("name"))
    marked = own.join(broadcast_if(rows, rows.count(), NAMED_MOST), F.col("id").eqNullSafe(F.col("x_id")) & (F.col("name") == F.col("x_name")), "left")
    once = marked.where("x_keep and x_n > 1").dropDuplicates(["id", "name"])
    return marked.where("x_keep is null").select("row").unionByName(once.select("row")).select("row.*")
