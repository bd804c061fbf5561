"""Command byte streams: framing, classes, replies, sessions, and live comparison, in batch and as Structured Streaming.

The batch forms cut a device's log at quiet gaps, where the framing state starts afresh, so each piece
is small; the streaming forms take bytes in event-time order and keep the same state between micro-batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuebase.functions.scalar import micros, seconds
from cuebase.sources.shared import shared_folder
from cuebase.streaming.ordered import STORE, in_order, use_rocksdb

#: Words that start a four-byte command, dead words, version queries.
MASTER, CHANNELS, CONTROLS = 0x55AA, (0x55AB, 0x55B2), (0x55BA, 0x55C1)
DEAD, VERSION_HIGH, VERSION_LOW = (0x55B3, 0x55B9), 0x55C2, 0x55C3
OUT = "device long, event_id long, word int, value int"


def frame_bytes(state: tuple[int, int, int, float], rows: list[tuple[float, int, int]], timeout: float, judged: bool = False) -> tuple[tuple[int, int, int, float], list[tuple]]:
    """Take (seconds, event id, byte) rows in order: the new state and the commands (event id, word, value).

    judged: instead the ends of all four-byte commands, whole or not: (event id, word, third byte, fourth byte).
    """
    held, word, first, last = state
    out: list[tuple[int, int, int | None]] = []
    for at, event, byte in rows:
        if at - last >= timeout:
            held = 0
        last = at
        if held == 0:
            word, held = byte << 8, 1
        elif held == 1:
            word |= byte
            held = 0
            if MASTER <= word <= CHANNELS[1] or CONTROLS[0] <= word <= CONTROLS[1]:
                first, held = word, 2
            elif not judged and not DEAD[0] <= word <= DEAD[1] and (word in (VERSION_HIGH, VERSION_LOW) or word < 0x8000):
                out.append((event, word, None))
        elif held == 2:
            word, held = byte, 3
        else:
            if judged:
                out.append((event, first, word, byte))
            elif word == byte ^ 0xFF:
                out.append((event, first, word))
            held = 0
    return (held, word, first, last), out


def sessions_of(port: DataFrame, quiet: float) -> DataFrame:
    """Add session: a number that grows at each quiet gap of the device."""
    w = Window.partitionBy("device").orderBy("ts", "event_id")
    gap = micros(F.col("ts")) - micros(F.lag("ts").over(w)) >= int(quiet * 1e6)
    return port.withColumn("session", F.sum(F.coalesce(gap, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _framed(port: DataFrame, timeout: float, judged: bool, schema: str) -> DataFrame:
    at = (micros(F.col("ts")) / 1e6).alias("at")
    pieces = sessions_of(port, timeout).groupBy("device", "session").agg(F.array_sort(F.collect_list(F.struct(at, "event_id", "byte"))).alias("rows"))

    def run(batches):
        for pdf in batches:
            out = []
            for device, rows in zip(pdf["device"], pdf["rows"], strict=True):
                _, found = frame_bytes((0, 0, 0, float("-inf")), [(r["at"], r["event_id"], r["byte"]) for r in rows], timeout, judged)
                out += [(device, *x) for x in found]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)

    return pieces.select("device", "rows").mapInPandas(run, schema)


def frame_commands(port: DataFrame, timeout: float) -> DataFrame:
    """port (device, ts, event_id, byte): the framed commands, batch form."""
    return _framed(port, timeout, False, OUT)


def frame_commands_stream(port: DataFrame, timeout: float, delay: float | None = None, buckets: int | None = None) -> DataFrame:
    """The same for a streaming port whose bytes come up to `delay` seconds late (the timeout, if not given).

    One small state per device, which goes after its quiet time: then framing starts afresh anyway.
    """

    def step(key, state, at, event, byte):
        held, word, first, last = state or (0, 0, 0, at)
        (held, word, first, _), found = frame_bytes((held, word, first, last / 1e6), [(at / 1e6, event, byte)], timeout)
        return (held, word, first, at), [(key[0], *x) for x in found]

    return in_order(port, "device", "event_id long, byte int", OUT, step, timeout if delay is None else delay, timeout, buckets=buckets)


def classify(word: Column) -> Column:
    return (
        F.when(word == MASTER, "master volume").when(word.between(*CHANNELS), "channel volume").when(word.between(*CONTROLS), "control")
        .when(word.isin(VERSION_HIGH, VERSION_LOW), "version query").when(word.between(*DEAD) | (word >= 0x8000), "discarded").otherwise("track")
    )


def complement_check(port: DataFrame, timeout: float) -> DataFrame:
    """Each four-byte command of the port: its third and fourth byte, and whether one is the complement of the other; those that fail are no commands."""
    ends = _framed(port, timeout, True, "device long, event_id long, word int, third int, fourth int")
    return ends.withColumn("ok", F.col("third") == F.col("fourth").bitwiseXOR(F.lit(255)))


def reply_rules(commands: DataFrame, rules: DataFrame) -> DataFrame:
    """rules (word, reply): commands with a rule answer it and are not queued."""
    return commands.join(F.broadcast(rules), "word", "left").select("device", "event_id", "word", "reply", F.when(F.col("reply").isNull(), "queue").otherwise("reply").alias("action"))


def boot_window(port: DataFrame, resets: DataFrame, within: float) -> DataFrame:
    """port and resets (device, ts, event_id): the first byte within the window after each reset.

    Both are one ordered series by device, so the next byte after a reset is found without a range join.
    """
    both = resets.select("device", "ts", "event_id", F.lit(0).alias("kind")).unionByName(port.select("device", "ts", "event_id", F.lit(1).alias("kind")))
    w = Window.partitionBy("device").orderBy("ts", "kind", "event_id").rowsBetween(1, Window.unboundedFollowing)
    byte = F.first(F.when(F.col("kind") == 1, F.struct("ts", "event_id")), ignorenulls=True).over(w)
    rows = both.withColumn("byte", byte).where("kind = 0 and byte is not null")
    return rows.where(micros(F.col("byte.ts")) - micros(F.col("ts")) <= int(within * 1e6)).select("device", F.col("event_id").alias("reset_id"), F.col("byte.event_id").alias("byte_id"))


def sessions(port: DataFrame, gap: str) -> DataFrame:
    """Groups of bytes without a quiet gap; the same text runs on a stream with a watermark."""
    return port.groupBy("device", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).select("device", seconds(F.col("w.start")).alias("start"), "n", "first_id")


def windows(rows: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows over ts: count and sum of pcm."""
    return rows.groupBy(F.window("ts", length, slide or length).alias("w")).agg(F.count("*").alias("n"), F.sum("pcm").cast("bigint").alias("total")).select(seconds(F.col("w.start")).alias("start"), "n", "total")


def read_port(spark: SparkSession, path: str) -> DataFrame:
    """A streaming source of timed bytes from an events table."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    folder, _, name = path.rpartition("/")
    # a stream watches a folder: a table of one file is picked out of its own
    alone = any(f.endswith(f"/{name}") for f in table.inputFiles())
    events = reader.option("pathGlobFilter", name).parquet(folder) if alone else reader.parquet(path)
    kind = F.col("event_type")
    byte = F.when(kind == "click", 85).when(kind == "view", 171).when(kind == "purchase", 84).when(kind == "signup", 1).otherwise(194)
    return events.select(F.col("user_id").alias("device"), "ts", "event_id", byte.alias("byte"), "event_type", "value")


def run_available(stream: DataFrame, also: Callable[[DataFrame, int], None] | None = None, keep_on: bool = False) -> DataFrame:
    """Run a stream over what is there, batch by batch, into Parquet in the shared folder, and read that.

    keep_on: for sources that bound their batches themselves and so cannot say at the start where to stop.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def both(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")
        also(df, epoch)

    writer = stream.writeStream.option("checkpointLocation", f"{base}/state")
    writer = writer.trigger(processingTime="0 seconds") if keep_on else writer.trigger(availableNow=True)
    before = use_rocksdb(spark)
    try:
        query = (writer.format("parquet").option("path", f"{base}/out").outputMode("append") if also is None else writer.foreachBatch(both)).start()
        if keep_on:
            try:
                query.processAllAvailable()
            finally:
                query.stop()
        else:
            query.awaitTermination()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{base}/out/*" if also else f"{base}/out")


def write_replies(replies: DataFrame) -> DataFrame:
    """Replies to one sink and their counts to another, from one pass; returns the counts."""
    spark, name = replies.sparkSession, uuid.uuid4().hex
    path = f"{shared_folder(spark)}/replies-{name}"
    run_available(replies, lambda df, epoch: df.groupBy("reply").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/epoch={epoch}"))
    return spark.read.parquet(f"{path}/*").groupBy("reply").agg(F.sum("n").alias("n"))


def live_compare(a: DataFrame, b: DataFrame, length: str) -> DataFrame:
    """Streams (key, ts, value): samples of both sides aligned by key, those that differ or that one side lacks when the watermark passes."""
    left = a.select("key", F.col("ts").cast("timestamp").alias("ts_a"), F.col("value").alias("a")).withWatermark("ts_a", length)
    right = b.select(F.col("key").alias("key_b"), F.col("ts").cast("timestamp").alias("ts_b"), F.col("value").alias("b")).withWatermark("ts_b", length)
    joined = left.join(right, F.expr("key = key_b AND ts_a = ts_b"), "full_outer")
    return joined.where("not (a <=> b)").select(F.coalesce("key", "key_b").alias("key"), "a", "b")


def live_counts(a: DataFrame, b: DataFrame, length: str, delay: str) -> DataFrame:
    """Streams (key, ts, frame_no, value): for each window the samples, those that differ (or that one side lacks) and the frames with any; a window comes when the watermark has passed it.

    Three aggregations one after the other: samples of both sides meet by window, frame and key, then count by frame, then by window.
    """
    one = lambda df, own, other: df.select("key", "frame_no", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias(own), F.lit(None).cast(df.schema["value"].dataType).alias(other))
    both = one(a, "a", "b").unionByName(one(b, "b", "a")).withWatermark("ts", delay)
    again = lambda: F.window(F.window_time("w"), length).alias("w")
    samples = both.groupBy(F.window("ts", length).alias("w"), "frame_no", "key").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    frames = samples.groupBy(again(), "frame_no").agg(F.count("*").alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("bad"))
    whole = frames.groupBy(again()).agg(F.sum("n").alias("samples"), F.sum("bad").alias("bad_samples"), F.count_if(F.col("bad") > 0).alias("bad_frames"))
    return whole.select(seconds(F.col("w.start")).alias("start"), "samples", "bad_samples", "bad_frames")


def live_runs(rows: DataFrame, delay: float, idle: float, alerts: tuple[int, ...] = (10, 50, 100), buckets: int | None = None) -> DataFrame:
    """Stream (series, ts, idx, differs): each run of differing positions when it ends, and alerts inside runs as they grow.

    A run ends with the next row that does not continue it, or when its series has been silent for `idle` seconds.
    """

    def end(key, state):
        return [(key[0], "run", state[0], state[1])] if state and state[0] >= 0 else []

    def step(key, state, at, idx, differs):
        first, n = state or (-1, 0)
        if differs and first >= 0 and idx == first + n:
            found, n = [], n + 1
        else:
            found = end(key, (first, n))
            first, n = (idx, 1) if differs else (-1, 0)
        if differs and (n in alerts or n % 1000 == 0):
            found.append((key[0], "alert", first, n))
        return (first, n), found

    return in_order(rows, "series", "idx long, differs boolean", "series long, kind string, first long, n long", step, delay, idle, end, buckets)


def boot_stream(rows: DataFrame, within: float, delay: float | None = None, buckets: int | None = None) -> DataFrame:
    """Stream (device, ts, event_id, kind reset or byte): the first byte within the window after each reset.

    Resets wait in the device's state until a byte comes, or until the watermark passes their window; at one time a reset comes before a byte.
    """

    def step(key, state, at, order, event):
        waiting, since = state or ([], [])
        if not order:
            return ([*waiting, event], [*since, at]), []
        return ([], []), [(key[0], r, event) for r, t in zip(waiting, since, strict=True) if at - t <= within * 1e6]

    ordered = rows.withColumn("place", F.when(F.col("kind") == "reset", 0).otherwise(1))
    return in_order(ordered, "device", "place int, event_id long", "device long, reset_id long, byte_id long", step, within if delay is None else delay, within, buckets=buckets)


def recent_ring(rows: DataFrame, delay: float, idle: float, most: int = 16, buckets: int | None = None) -> DataFrame:
    """Stream (device, ts, event_id, byte, differs): at each difference the latest `most` bytes since the one before; a device silent for `idle` seconds starts anew."""

    def step(key, state, at, event, byte, differs):
        ids, held = state or ([], [])
        ids, held = [*ids, event][-most:], [*held, byte][-most:]
        if not differs:
            return (ids, held), []
        return ([], []), [(key[0], event, a, b, k + 1) for k, (a, b) in enumerate(zip(reversed(ids), reversed(held), strict=True))]

    return in_order(rows, "device", "event_id long, byte int, differs boolean", "device long, diff_at long, at long, byte int, back int", step, delay, idle, buckets=buckets)


def pending_deferred(rows: DataFrame, delay: float, idle: float, buckets: int | None = None) -> DataFrame:
    """Stream (channel, ts, event_id, kind load or trigger): each trigger fires the pending load of its channel, once; a load is forgotten after `idle` silent seconds."""

    def step(key, state, at, event, kind):
        if kind == "load":
            return (event,), []
        return (-1,), [(key[0], event, state[0])] if state and state[0] >= 0 else []

    return in_order(rows, "channel", "event_id long, kind string", "channel long, trigger_id long, load_id long", step, delay, idle, buckets=buckets)
