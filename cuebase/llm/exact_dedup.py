"""Exact dedup: a tree merge of sorted digest runs, in DataFrame functions only.

Texts are read once and become rows of a digest table.  Every row belongs to one of FAN ** levels nodes
by a hash of its id, and a node's run has one row for each digest: how often it occurs there and the id
that stays.  In each round the nodes that differ in one digit only exchange runs: a row goes to the partner whose
digit is the digest's own digit of that round.  There FAN runs are merged by sorting (head, digest, length), so
the sorted aggregation of Spark is the multiway merge.  After the last round a node's number is a part of the digest and
each digest has one row.  A row of a run stands for all copies of its node, so the largest group sends
FAN rows to a merge, whatever its size; no task and not the driver ever sees a group.

A run is ordered by the digest's first 60 bits; identifiers are merged only where all 256 bits and the lengths agree.

The answers go back by the leaves: a digest with copies meets its rows in the leaves (one for each node at most), and
each row finds its answer by (node, digest), so a group of a third of all rows is spread over all nodes.

Defined cases: null text counts as empty; a null id comes after all others, so it stays only in a group without ids; of repeated
rows (same id and text) one is kept and each is reported; an empty table gives an empty result; other columns are ignored by
exact_copies() and travel whole in drop_copies().
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuebase.llm.common import materialise

#: Runs that meet in one merge, the least number of rounds, and rows of a leaf from which on there is another round.
FAN_BITS, LEAST_ROUNDS, LEAF_ROWS = 6, 2, 1 << 20
KEY = ["head", "digest", "n_bytes"]


def digit(number: Column, place: int) -> Column:
    """Bits of a non-negative number that are its digit at this place, left where they stand."""
    return number.bitwiseAND(F.lit(((1 << FAN_BITS) - 1) << (FAN_BITS * place)))


def digest_rows(docs: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column] | None) -> DataFrame:
    """(id, row, digest, n_bytes, head): texts are hashed here and are not needed again; row numbers tell repeated rows apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = text if normalise is None else F.coalesce(normalise(text), F.lit(""))
    hashed = docs.select(F.col(id_col).alias("id"), F.sha2(text.cast("binary"), 256).alias("hex"), F.octet_length(text).cast("long").alias("n_bytes"))
    head = F.conv(F.substring("hex", 1, 15), 16, 10).cast("long")
    return hashed.select("id", F.monotonically_increasing_id().alias("row"), F.unhex("hex").alias("digest"), "n_bytes", head.alias("head"))


def rounds_for(rows: int) -> int:
    return max(LEAST_ROUNDS, math.ceil(math.log(max(rows / LEAF_ROWS, 1), 1 << FAN_BITS)))


def leaf_runs(rows: DataFrame, rounds: int, keep: str) -> DataFrame:
    """The run of each leaf: (node, head, digest, n_bytes) with the identifier that stays and the number of copies."""
    # the kept one is the greatest (id, -row), or the least (null last, id, row)
    rank = F.struct("id", (-F.col("row")).alias("row")) if keep == "largest" else F.struct(F.col("id").isNull().alias("none"), "id", "row")
    best = F.max(rank) if keep == "largest" else F.min(rank)
    return rows.groupBy("node", *KEY).agg(best.alias("best"), F.count("*").alias("n"))


def merged(runs: DataFrame, rounds: int, keep: str) -> DataFrame:
    """One row for each digest, after all rounds."""
    best = F.max("best") if keep == "largest" else F.min("best")
    for place in range(rounds):
        to = F.col("node") - digit(F.col("node"), place) + digit(F.col("head"), place)
        runs = runs.withColumn("node", to).groupBy("node", *KEY).agg(best.alias("best"), F.sum("n").alias("n"))
    return runs


def _copies(docs: DataFrame, id_col: str, text_col: str, keep: str, normalise: Callable[[Column], Column] | None) -> DataFrame:
    """(id, row, digest, n_bytes, keep_id, group_size, kept) for each row of docs."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    table = materialise(digest_rows(docs, id_col, text_col, normalise), "digests")
    rounds = rounds_for(table.count())
    node = F.pmod(F.xxhash64("id", "row"), F.lit(1 << (FAN_BITS * rounds))).alias("node")
    rows = table.select("*", node)
    leaves = leaf_runs(rows, rounds, keep)
    groups = merged(leaves, rounds, keep).where("n > 1").select(*KEY, "best", "n")
    # only digests with copies go back; in the leaves each has a row for a node at most
    answers = leaves.select("node", *KEY).join(groups, KEY)
    found = rows.join(answers, ["node", *KEY], "left")
    kept = F.col("n").isNull() | ((F.abs("row") == F.abs(F.col("best.row"))) & F.col("id").eqNullSafe(F.col("best.id")))
    return found.select(
        "id", "row", "digest", "n_bytes",
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        kept.alias("kept"),
    )


def exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None
) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256 (of the text after normalise, if that is given)."""
    found = _copies(docs, id_col, text_col, keep, normalise)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of docs, all columns, that exact_copies() keeps; rows that agree in id and text count as one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = text if normalise is None else F.coalesce(normalise(text), F.lit(""))
    gone = materialise(_copies(docs, id_col, text_col, keep, normalise).where("not kept").select(F.struct("id", "digest").alias("name"), F.col("keep_id").eqNullSafe(F.col("id")).alias("again")), "gone")
    own = docs.select(F.struct("*").alias("row"), F.struct(F.col(id_col).alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")).alias("own"))
    # a row is known by id and digest; names whose kept row has the same id and text are those of repeated rows
    same = F.col("own").eqNullSafe(F.col("name"))
    other, again = gone.where("not again").select("name").distinct(), gone.where("again").select("name").distinct()
    stay = own.join(other, same, "left_anti")
    if again.isEmpty():
        return stay.select("row.*")
    repeated = stay.join(again, same, "left_semi").groupBy("own").agg(F.first("row").alias("row"))
    return stay.join(again, same, "left_anti").select("row").unionByName(repeated.select("row")).select("row.*")
