"""Comparison of two outputs: differing samples and replies, runs, alerts, context, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare_samples(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a, b (keys, value): every key of either side, with both values and whether they differ."""
    rows = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), keys, "full_outer")
    return rows.select(*keys, "a", "b", (~F.col("a").eqNullSafe(F.col("b"))).alias("differs"))


def compare_replies(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b (device, frame_no, at, byte): frames whose ordered byte lists differ."""
    def lists(df: DataFrame, name: str) -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "byte"))), lambda s: s["byte"].cast("string"))
        return df.groupBy("device", "frame_no").agg(F.array_join(ordered, ",").alias(name))

    rows = lists(a, "a").join(lists(b, "b"), ["device", "frame_no"], "full_outer")
    return rows.where(~F.col("a").eqNullSafe(F.col("b"))).select("device", "frame_no", "a", "b")


def differing_replies(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b (device, frame_no, at, byte): frames whose ordered byte lists differ, without the lists.

    Rows of both sides meet in one grouping; a frame of no device is a frame like others.
    """
    both = a.select("device", "frame_no", "at", "byte", F.lit(0).alias("side")).unionByName(b.select("device", "frame_no", "at", "byte", F.lit(1).alias("side")))
    own = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("at", "byte"))))
    bytes_of = lambda side: F.transform(own(side), lambda s: s["byte"])
    return both.groupBy("device", "frame_no").agg((bytes_of(0) != bytes_of(1)).alias("differs")).where("differs").select("device", "frame_no")


def differing_frames(pcm2: DataFrame) -> DataFrame:
    return pcm2.where("a <> b").select("series", "idx").distinct()


def diff_runs(diffs: DataFrame) -> DataFrame:
    """diffs (series, idx): consecutive differing positions as runs; one still open at the end counts."""
    island = F.col("idx") - F.row_number().over(Window.partitionBy("series").orderBy("idx"))
    runs = diffs.withColumn("island", island).groupBy("series", "island").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n"))
    return runs.select("series", "first", "last", "n")


#: Run lengths that raise an alert, and the step of further ones.
ALERTS, EVERY = (10, 50, 100), 1000


def run_alerts(runs: DataFrame, alerts: tuple[int, ...] = ALERTS, every: int = EVERY) -> DataFrame:
    """Alert positions inside each run."""
    marks = F.concat(F.lit(list(alerts)).cast("array<bigint>"), F.when(F.col("n") >= every, F.sequence(F.lit(every).cast("bigint"), F.col("n"), F.lit(every).cast("bigint"))).otherwise(F.array().cast("array<bigint>")))
    rows = runs.withColumn("length", F.explode(F.filter(marks, lambda x: x <= F.col("n"))))
    return rows.select("series", "first", "length", (F.col("first") + F.col("length") - 1).alias("idx"))


def context_commands(diffs: DataFrame, commands: DataFrame, most: int = 16) -> DataFrame:
    """diffs (device, at), commands (device, at, byte): up to `most` latest commands at or before each difference, since the one before.

    Commands and differences form one ordered series; each command belongs to the next difference, so no interval join is needed.
    """
    both = commands.select("device", "at", F.lit(0).alias("kind"), "byte").unionByName(diffs.select("device", "at", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("byte")))
    w = Window.partitionBy("device").orderBy("at", "kind")
    owner = F.first(F.when(F.col("kind") == 1, F.col("at")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = both.withColumn("diff_at", owner).where("kind = 0 and diff_at is not null")
    rank = F.row_number().over(Window.partitionBy("device", "diff_at").orderBy(F.desc("at")))
    return rows.withColumn("back", rank.cast("int")).where(F.col("back") <= most).select("device", "diff_at", "at", "byte", "back")


def validation_report(pcm2: DataFrame, replies: DataFrame) -> DataFrame:
    """pcm2 (frame_no, a, b); replies: frames whose replies differ, as compare_replies() or differing_replies() gives them.  A reply that differs fails the set as a sample does."""
    bad = F.col("a") != F.col("b")
    facts = pcm2.agg(F.count("*").alias("samples"), F.count_if(bad).alias("bad_samples"), F.count_distinct(F.when(bad, F.col("frame_no"))).alias("bad_frames"))
    facts = facts.crossJoin(replies.agg(F.count("*").alias("bad_reply_frames")))  # one row each
    return facts.withColumn("verdict", F.when((F.col("bad_samples") == 0) & (F.col("bad_reply_frames") == 0), "pass").otherwise("fail"))


def suite_rollup(pcm2: DataFrame, allowed: int = 0) -> DataFrame:
    """Verdict of each series, and one row for all (series null)."""
    own = pcm2.groupBy("series").agg((F.count_if(F.col("a") != F.col("b")) <= allowed).alias("ok"))
    return own.unionByName(own.agg(F.coalesce(F.every("ok"), F.lit(True)).alias("ok")).withColumn("series", F.lit(None).cast("bigint")))


def diagnostic_counts(rows: DataFrame, level: str = "level") -> DataFrame:
    """Warnings, errors and fatal ones; a fatal one is an error too."""
    c = F.col(level)
    return rows.agg(F.count_if(c == "warning").alias("warnings"), F.count_if(c.isin("error", "fatal")).alias("errors"), F.count_if(c == "fatal").alias("fatal"))
