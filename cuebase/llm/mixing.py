"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the output bytes over
the bytes that it has.  A document's count is drawn by inverting the Poisson
distribution with that mean at a uniform number that hashes seed and document;
the document is exploded by its count, and the copies are put into one global
pseudo-random order: that of a digest, whose leading bits name the partition, so that counts
are drawn in one pass.  All steps are DataFrame functions.

The distribution is tabulated once for each source.  Rates above PART_MOST are
drawn as a sum of independent parts (Poisson counts add), so that no probability
underflows.

Defined cases: a null source is a source of its own; null text has no bytes; a source
without bytes, weight or target row gets the rate 0; repeated rows with one id draw one count each,
the same; a null id is replaced by the text's digest; an empty table gives an empty result; other
columns are kept, whatever their names; poisson_mix() refuses columns that are called as those it adds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuebase.llm.common import broadcast_if, materialise

PART_MOST = 256.0
#: Most sources whose tables are sent to every task; more are shuffled.
SOURCES_MOST = 20_000
#: Planned bytes of text in one partition of the output; below, there are spark.sql.shuffle.partitions of them.
PARTITION_BYTES = 1 << 28


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _steps(mean: Column) -> Column:
    """Cumulative Poisson probabilities from 0 on, until the rest is below any uniform number's step."""
    last = (F.ceil(mean + F.lit(12.0) * F.sqrt(mean)) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    return F.aggregate(
        F.sequence(F.lit(1), last),
        start,
        lambda a, k: F.struct((a["p"] * mean / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * mean / k)).alias("c")),
        lambda a: a["c"],
    )


def temperature_weights(docs: DataFrame, source_col: str = "source", text_col: str = "text", power: float = 0.5) -> DataFrame:
    """(source, weight): each source's bytes to the given power."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    total = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("bytes"))
    amount = F.col("bytes").cast("double")
    return total.select("source", (F.sqrt(amount) if power == 0.5 else F.pow(amount, F.lit(power))).alias("weight"))


def rates(docs: DataFrame, weights: DataFrame, source_col: str = "source", text_col: str = "text", budget: float | None = None) -> DataFrame:
    """(source, bytes, rate): target bytes over own bytes; budget: bytes of the output, those of the input by default."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    own = docs.groupBy(F.col(source_col).alias("s")).agg(F.sum(size).alias("bytes"))
    both = materialise(own.join(weights, F.col("s").eqNullSafe(F.col("source")), "left").select(F.col("s").alias("source"), "bytes", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight")), "sources")
    all_ = both.agg(F.sum("weight").alias("weight"), F.sum("bytes").alias("bytes")).first()
    target = float(budget if budget is not None else all_.bytes or 0)
    rate = F.lit(target) * F.col("weight") / F.lit(float(all_.weight or 1.0)) / F.col("bytes")
    return both.select("source", "bytes", F.when((F.col("bytes") > 0) & (F.col("weight") > 0), rate).otherwise(F.lit(0.0)).alias("rate"))


def poisson_copies(docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 1, budget: float | None = None) -> DataFrame:
    """row (a struct of the columns of docs), repeated, with rate, copies, copy (from 1) and shuffle_key, in the order of shuffle_key."""
    table = rates(docs, weights, source_col, text_col, budget)
    parts = F.greatest(F.ceil(F.col("rate") / F.lit(PART_MOST)), F.lit(1)).cast("int")
    table = table.withColumn("parts", parts).withColumn("steps", _steps(F.col("rate") / F.col("parts")))
    table = materialise(table.withColumnRenamed("source", "mix_source"), "rates")
    planned = table.agg(F.sum(F.col("rate") * F.col("bytes"))).first()[0] or 0.0
    table = broadcast_if(table, table.count(), SOURCES_MOST)
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    own = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("own_source"), name.alias("name"))
    joined = own.join(table, F.col("own_source").eqNullSafe(F.col("mix_source")))
    # one digest for each part, not for each step of the table
    numbers = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda i: uniform(F.lit(str(seed)), i.cast("string"), F.col("name")))
    count = F.aggregate(numbers, F.lit(0), lambda a, u: a + F.size(F.filter("steps", lambda c: c <= u)))
    # the count is drawn once for each row, before the copies are made
    drawn = joined.select("row", "name", "rate", count.alias("copies")).where("copies > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed} order"), F.col("copy").cast("string"), F.col("name")))
    keyed = copies.select("row", "rate", "copies", "copy", key.alias("shuffle_key"))
    # keys are digests, so equal ranges of their first 32 bits hold about equally many: no sample has to find the borders
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(planned / PARTITION_BYTES))
    first = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long")
    return keyed.repartitionById(n, F.shiftright(first * n, 32).cast("int")).sortWithinPartitions("shuffle_key", "copy")


def poisson_mix(docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 1, budget: float | None = None) -> DataFrame:
    """The columns of docs, repeated, with rate, copies, copy (from 1) and shuffle_key, in the order of shuffle_key."""
    added = ["rate", "copies", "copy", "shuffle_key"]
    if clash := set(added) & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has columns of the names that are added: {sorted(clash)}; poisson_copies() keeps rows apart")
    return poisson_copies(docs, weights, id_col, source_col, text_col, seed, budget).select("row.*", *added)
