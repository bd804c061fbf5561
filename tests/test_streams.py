"""Streams in event time: micro-batches of rows in any order within the watermark give what the batch forms give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cuebase.operators import validate
from cuebase.streaming import commands as J

PORT = "device long, ts timestamp, event_id long, byte int, kind string, differs boolean"


def log(seed: int = 1, n: int = 600) -> list[tuple]:
    """(second, device, event id, byte, kind, differs): three devices with short and long pauses, commands cut by them."""
    rnd = random.Random(seed)
    now, out = 1000, []  # a watermark starts at second 0
    for k in range(n):
        now += rnd.choice([0, 1, 1, 2, 3, 20 if k % 40 == 0 else 1])
        byte = rnd.choice([0x55, 0xAA, 0xAB, 0x54, 0x01, 0x00, 0xFE, 0xC2, 0xBA])
        out.append((now, rnd.randrange(3), k, byte, rnd.choice(["load", "trigger", "load"]), rnd.random() < 0.6))
    return out


@pytest.fixture(scope="module", params=[(1, 0), (3, 1), (5, 2)])
def arrived(spark, tmp_path_factory, request):
    """(stream, rows that the watermark passes, late seconds): files in arrival order, rows up to 8 seconds late and shuffled."""
    files, seed = request.param
    rows, late = log(seed), 8
    rnd = random.Random(seed)
    order = sorted(rows, key=lambda r: r[0] + (rnd.uniform(0, late - 1) if files > 1 else 0))
    folder = str(tmp_path_factory.mktemp("port"))
    size = -(-len(order) // files)
    for i in range(files):
        part = order[i * size : (i + 1) * size]
        rnd.shuffle(part)
        df = spark.createDataFrame(part, "at long, device long, event_id long, byte int, kind string, differs boolean").select("device", F.timestamp_seconds("at").alias("ts"), "event_id", "byte", "kind", "differs")
        df.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(PORT).option("maxFilesPerTrigger", 1).parquet(folder)
    passed = spark.read.schema(PORT).parquet(folder).where(F.unix_micros("ts") <= (max(r[0] for r in rows) - late) * 1_000_000)
    return stream, passed.cache(), late


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    a, b = sorted((tuple(r) for r in got.collect()), key=key), sorted((tuple(r) for r in want.select(*got.columns).collect()), key=key)
    assert a == b
    return len(a)


def test_commands(arrived):
    stream, passed, late = arrived
    assert same(J.run_available(J.frame_commands_stream(stream, 13.0, late)), J.frame_commands(passed, 13.0)) > 60


def test_boot_window(arrived):
    stream, passed, late = arrived
    mark = lambda df: df.withColumn("kind", F.when(F.col("byte") == 1, "reset").otherwise("byte"))
    want = J.boot_window(passed.where("byte <> 1"), passed.where("byte = 1"), 3.0)
    assert same(J.run_available(J.boot_stream(mark(stream), 3.0, late)), want) > 20


def test_runs(arrived, spark):
    """Runs of positions of a device; those whose end the watermark has passed."""
    stream, passed, late = arrived
    rows = stream.select(F.lit(1).cast("long").alias("series"), "ts", F.col("event_id").alias("idx"), "differs")
    live = J.run_available(J.live_runs(rows, late, 1000, alerts=(3, 5)))
    marked = passed.where("differs").select(F.lit(1).cast("long").alias("series"), F.col("event_id").alias("idx"))
    last = passed.agg(F.max("event_id")).first()[0]
    runs = validate.diff_runs(marked).where(F.col("first") + F.col("n") <= last)
    assert same(live.where("kind = 'run'").select("series", "first", "n"), runs) > 50
    want = validate.diff_runs(marked).select("series", "first", F.explode(F.array(F.lit(3), F.lit(5))).alias("length"), "n").where("length <= n")
    assert same(live.where("kind = 'alert'").select("series", "first", "n"), want.select("series", "first", F.col("length").alias("n"))) > 10


def test_recent_ring(arrived):
    stream, passed, late = arrived
    got = J.run_available(J.recent_ring(stream, late, 1000, most=4))
    want, ring = [], {}
    for r in passed.orderBy("ts", "event_id").collect():
        own = ring.setdefault(r.device, [])
        own.append((r.event_id, r.byte))
        if r.differs:
            want += [(r.device, r.event_id, a, b, k + 1) for k, (a, b) in enumerate(reversed(own[-4:]))]
            ring[r.device] = []
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 100


def test_pending_deferred(arrived):
    stream, passed, late = arrived
    got = J.run_available(J.pending_deferred(stream.withColumnRenamed("device", "channel"), late, 15))
    want, held = [], {}
    for r in passed.orderBy("ts", "event_id").collect():
        load, at = held.get(r.device, (None, None))
        if at is not None and (r.ts - at).total_seconds() > 15:
            load = None
        if r.kind == "trigger" and load is not None:
            want.append((r.device, r.event_id, load))
        held[r.device] = (r.event_id if r.kind == "load" else None, r.ts)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 30


def test_state_of_silent_keys_goes(spark, tmp_path):
    """A device that falls silent is closed by the watermark that others move: its open run is given, and no state row is left for it."""
    rows = [(k + 1, 1, k, True) for k in range(5)] + [(k + 1, 2, k, False) for k in range(0, 300, 10)]
    for i, part in enumerate([rows[:15], rows[15:25], rows[25:]]):
        df = spark.createDataFrame(part, "at long, series long, idx long, differs boolean").select("series", F.timestamp_seconds("at").alias("ts"), "idx", "differs")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series long, ts timestamp, idx long, differs boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = J.run_available(J.live_runs(stream, 5, 60))
    assert [tuple(r) for r in got.collect()] == [(1, "run", 0, 5)]
    folder = got.inputFiles()[0].rsplit("/", 2)[0]
    left = spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", "state").load()
    assert {r.key.series for r in left.select("key").collect()} == {2}


def test_live_counts(spark, tmp_path):
    """Samples of both sides in shuffled micro-batches: each closed window counts what the batch report counts."""
    rnd = random.Random(7)
    rows = [(k, 1000 + 3 * k, k // 5, k * 7 % 50) for k in range(400)]
    other = [(k, t, f, v + (k % 19 < 2)) for k, t, f, v in rows if k % 23]
    for side, own in (("a", rows), ("b", other)):
        order = sorted(own, key=lambda r: r[1] + rnd.uniform(0, 9))
        for i in range(4):
            part = order[i * 100 : (i + 1) * 100]
            df = spark.createDataFrame(part, "key long, at long, frame_no long, value long").select("key", "frame_no", F.timestamp_seconds("at").alias("ts"), "value")
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / side))
    read = lambda side: spark.readStream.schema("key long, frame_no long, ts timestamp, value long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / side))
    got = {r.start: (r.samples, r.bad_samples, r.bad_frames) for r in J.run_available(J.live_counts(read("a"), read("b"), "60 seconds", "10 seconds")).collect()}
    right, want = {r[0]: r[3] for r in other}, {}
    for k, t, f, v in rows:
        n = want.setdefault(t // 60 * 60, [0, 0, set()])
        n[0] += 1
        if right.get(k) != v:
            n[1] += 1
            n[2].add(f)
    last = max(r[1] for r in rows) - 10
    assert got == {t: (a, b, len(c)) for t, (a, b, c) in want.items() if t + 60 <= last} and len(got) > 15


def test_keys_share_state_by_bucket(spark, tmp_path):
    """Many devices in few groups: the same commands as by device, in as many state rows as groups."""
    rnd = random.Random(11)
    rows = [(1000 + k // 20, rnd.randrange(90), k, rnd.choice([0x55, 0xAA, 0x01, 0x00, 0xFE])) for k in range(3000)]
    for i in range(3):
        df = spark.createDataFrame(rows[i * 1000 : (i + 1) * 1000], "at long, device long, event_id long, byte int").select("device", F.timestamp_seconds("at").alias("ts"), "event_id", "byte")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "device long, ts timestamp, event_id long, byte int"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    passed = spark.read.schema(schema).parquet(str(tmp_path / "in")).where(F.unix_micros("ts") <= (max(r[0] for r in rows) - 8) * 1_000_000)
    got = J.run_available(J.frame_commands_stream(stream, 13.0, 8, buckets=5))
    assert same(got, J.frame_commands(passed, 13.0)) > 200
    folder = got.inputFiles()[0].rsplit("/", 1)[0].removesuffix("/out")
    assert spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", "state").load().count() == 5


def test_ring_takes_the_last_hour(spark, tmp_path):
    """j11: rows behind the watermark's last place count too, and a device that was silent for two months goes on."""
    from cuebase import registry

    at = [0, 86400 * 60, 86400 * 60 + 1800, 86400 * 60 + 1801]
    events = spark.createDataFrame([(100 + k, 1_700_000_000 + t, 7) for k, t in enumerate(at)] + [(194, 1_700_000_000 + at[-1], 7)], "event_id long, at long, user_id long")
    events.select("event_id", F.timestamp_seconds("at").alias("ts"), "user_id", F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props")).write.parquet(str(tmp_path / "events.parquet"))
    got = registry.queries()["j11_recent_ring"](spark, str(tmp_path))
    assert sorted((r.diff_at, r["at"], r.back) for r in got.collect()) == [(100, 100, 1), (101, 101, 1), (194, 102, 3), (194, 103, 2), (194, 194, 1)]
