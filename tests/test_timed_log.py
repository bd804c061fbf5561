"""The log of timed bytes: batch and stream give the same bytes, in bounded micro-batches, and a restart goes on."""

from __future__ import annotations

import os

from cuebase.plans.bindings import Views
from cuebase.sources import timed_log
from cuebase.streaming import commands as J

SIZE = timed_log.RECORD.itemsize


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_log_comes_back(spark, data, tmp_path):
    port = Views(spark, data).port.select("device", "ts", "event_id", "byte")
    timed_log.write_log(port, f"file://{tmp_path}/log", 3)
    names = sorted(os.listdir(tmp_path / "log"))
    assert names == ["log-000000", "log-000001", "log-000002"]
    want = rows(port.withColumn("ts", port.ts.cast("timestamp")))
    assert rows(timed_log.read_log(spark, f"file://{tmp_path}/log")) == want
    assert sum((tmp_path / "log" / n).stat().st_size for n in names) == SIZE * len(want)


def test_micro_batches_are_bounded(spark, data, tmp_path):
    """A log of a thousand bytes in five micro-batches of 200 records and partitions of 64."""
    port = Views(spark, data).port.select("device", "ts", "event_id", "byte")
    folder = f"file://{tmp_path}/log"
    timed_log.write_log(port, folder, 2)
    n, sizes = port.count(), []
    stream = timed_log.stream_log(spark, folder, most_bytes=200 * SIZE + 5)
    got = J.run_available(stream, also=lambda df, epoch: sizes.append(df.count()), keep_on=True)
    assert rows(got) == rows(timed_log.read_log(spark, folder))
    assert [x for x in sizes if x] == [200] * (n // 200) + ([n % 200] if n % 200 else [])
    log = timed_log._Log({"path": folder, "partitionBytes": str(64 * SIZE)})
    assert all(r.end - r.start <= 64 * SIZE for r in log.ranges(100 * SIZE, 900 * SIZE))
    assert sum(r.end - r.start for r in log.ranges(100 * SIZE, 900 * SIZE)) == 800 * SIZE


def test_restart_and_growth(spark, data, tmp_path):
    """A stopped query goes on after what it has committed, with more files and a record that was not whole."""
    port = Views(spark, data).port.select("device", "ts", "event_id", "byte")
    folder = f"file://{tmp_path}/log"
    timed_log.write_log(port, folder, 1)
    whole = (tmp_path / "log" / "log-000000").read_bytes()
    (tmp_path / "log" / "log-000000").write_bytes(whole[: 300 * SIZE + 7])

    def run():
        stream = timed_log.stream_log(spark, folder, most_bytes=90 * SIZE, progress=f"file://{tmp_path}/progress")
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        query.processAllAvailable()
        query.stop()
        return spark.read.parquet(f"{tmp_path}/out").count()

    assert run() == 300
    (tmp_path / "log" / "log-000000").write_bytes(whole[: 500 * SIZE])
    assert run() == 500
    (tmp_path / "log" / "log-000001").write_bytes(whole[500 * SIZE :])
    assert run() == port.count()
    assert rows(spark.read.parquet(f"{tmp_path}/out").select("device", "ts", "event_id", "byte")) == rows(timed_log.read_log(spark, folder))


def test_empty_log(spark, data, tmp_path):
    (tmp_path / "log").mkdir()
    assert timed_log.read_log(spark, str(tmp_path / "log")).count() == 0
