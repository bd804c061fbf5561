"""Corpus pipeline: toxicity, near duplicates, benchmark leaks, source mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as
Parquet in the shared folder, gives it to the next and empties it when that is written.  All stages
return the columns of documents, the last one with each row's shard.  Nulls, blank texts and repeated rows follow the operators' own rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuebase.llm import toxicity
from cuebase.llm.common import materialise, release, table
from cuebase.llm.decontaminate import drop_leaks
from cuebase.llm.mixing import poisson_copies, temperature_weights
from cuebase.llm.ngram_join import keep_one
from cuebase.llm.shards import shard_rows

#: SQL cannot express training, near duplicates or differencing; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    weights, bias = toxicity.learn(toxicity.labelled_texts(docs, labels))
    return toxicity.keep_clean(docs, weights, bias, threshold=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: the one of least id."""
    return keep_one(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated at their source's rate and put into a global pseudo-random order."""
    return poisson_copies(docs, temperature_weights(docs, power=0.5), seed=1).select("row.*")


def put_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sixteen shards of near equal bytes: the columns of docs and each row's size, shard and place in it."""
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    taken = {c.lower() for c in docs.columns}
    out = shard_rows(docs, 16)
    # a column that docs has under such a name stays, and the new one is called shard_<name>
    return out.select("row.*", *[F.col(c).alias(f"shard_{c}" if c in taken else c) for c in added])


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", put_into_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        if k:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
