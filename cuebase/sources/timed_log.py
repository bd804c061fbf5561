"""Logs of timed command bytes: fixed-size records in files that are read in the order of their names.

write_log() writes a port as such a log; the data source `timed_log` reads it as a batch, and as a stream in offsets of
records.  A stream takes maxBytesPerBatch at most into a micro-batch (all that is there, if it is not given) and cuts each micro-batch into
partitions of partitionBytes.  Files may grow and new ones may follow, with names after those there are; a record that is not yet whole waits.
With the option progress (a folder), the last committed offset is kept there, so that a restarted query goes on with batches of the same bound.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from cuebase.functions.scalar import micros
from cuebase.sources.shared import open_folder

#: A record: device, microseconds since 1970, event id, byte; little-endian.
RECORD = np.dtype([("device", "<i8"), ("at", "<i8"), ("event_id", "<i8"), ("byte", "<i4")])
SCHEMA = "device long, ts timestamp, event_id long, byte int"
PARTITION_BYTES = 32 << 20


def write_log(port: DataFrame, folder: str, files: int) -> None:
    """port (device, ts, event_id, byte) as a log: about even files in the order of time."""
    rows = port.select("device", micros(F.col("ts")).alias("at"), "event_id", F.col("byte").cast("int").alias("byte")).where("device is not null and at is not null and byte is not null")

    def run(batches):
        from pyspark import TaskContext

        store, base = open_folder(folder)
        context = TaskContext.get()
        # a task writes a file of its own attempt and renames it, so a repeated task leaves one
        own = posixpath.join(base, f"_{context.partitionId()}-{context.taskAttemptId()}")
        size = 0
        with store.open_output_stream(own) as out:
            for batch in batches:
                part = np.empty(len(batch), dtype=RECORD)
                for name in RECORD.names:
                    part[name] = batch.column(name).fill_null(-1).to_numpy(zero_copy_only=False)
                out.write(part.tobytes())
                size += part.nbytes
        store.move(own, posixpath.join(base, f"log-{context.partitionId():06d}"))
        yield pa.RecordBatch.from_arrays([pa.array([size])], names=["size"])

    store, base = open_folder(folder)
    store.create_dir(base, recursive=True)
    rows.repartitionByRange(files, "at", "event_id").sortWithinPartitions("at", "event_id").mapInArrow(run, "size long").collect()


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class _Log:
    """Files of a log and the records in them; offsets count bytes over all files in the order of their names."""

    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("maxBytesPerBatch", 1 << 62)) // RECORD.itemsize * RECORD.itemsize
        self.part = max(RECORD.itemsize, int(options.get("partitionBytes", PARTITION_BYTES)) // RECORD.itemsize * RECORD.itemsize)
        if self.most < RECORD.itemsize:
            raise ValueError(f"maxBytesPerBatch is {RECORD.itemsize} at least")

    def files(self) -> list[tuple[str, int]]:
        store, base = open_folder(self.path)
        found = store.get_file_info(fs.FileSelector(base))
        return sorted((f.path, f.size // RECORD.itemsize * RECORD.itemsize) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))

    def ranges(self, start: int, end: int) -> list[Range]:
        out, base = [], 0
        for name, size in self.files():
            a, b = max(start - base, 0), min(end - base, size)
            out += [Range(name, x, min(x + self.part, b)) for x in range(a, b, self.part)]
            base += size
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.end:
            return
        store, _ = open_folder(self.path)
        with store.open_input_file(partition.file) as f:
            step = (1 << 20) // RECORD.itemsize * RECORD.itemsize
            for at in range(partition.start, partition.end, step):
                rows = np.frombuffer(f.read_at(min(partition.end - at, step), at), dtype=RECORD)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["device"]), pa.array(rows["at"]).cast(pa.timestamp("us", "UTC")), pa.array(rows["event_id"]), pa.array(rows["byte"])], names=["device", "ts", "event_id", "byte"]
                )


class LogReader(_Log, DataSourceReader):
    def partitions(self):
        return self.ranges(0, sum(n for _, n in self.files())) or [Range("", 0, 0)]


class LogStream(_Log, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        self.progress = options.get("progress")
        self.admitted = 0
        if self.progress:
            store, base = open_folder(self.progress)
            own = posixpath.join(base, "offset")
            if store.get_file_info(own).is_file:
                with store.open_input_file(own) as f:
                    self.admitted = json.loads(f.read())["bytes"]

    def initialOffset(self) -> dict:
        return {"bytes": 0}

    def latestOffset(self) -> dict:
        self.admitted = min(self.admitted + self.most, max(self.admitted, sum(n for _, n in self.files())))
        return {"bytes": self.admitted}

    def partitions(self, start: dict, end: dict):
        return self.ranges(start["bytes"], end["bytes"])

    def commit(self, end: dict) -> None:
        if self.progress:
            store, base = open_folder(self.progress)
            store.create_dir(base, recursive=True)
            with store.open_output_stream(posixpath.join(base, "_offset")) as f:
                f.write(json.dumps(end).encode())
            store.move(posixpath.join(base, "_offset"), posixpath.join(base, "offset"))


class TimedLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "timed_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return LogReader(self.options)

    def streamReader(self, schema):
        return LogStream(self.options)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(TimedLog)
    return spark.read.format("timed_log").load(folder)


def stream_log(spark: SparkSession, folder: str, most_bytes: int | None = None, progress: str | None = None) -> DataFrame:
    """The log as a stream; most_bytes: of a micro-batch."""
    spark.dataSource.register(TimedLog)
    reader = spark.readStream.format("timed_log")
    for name, value in (("maxBytesPerBatch", most_bytes), ("progress", progress)):
        if value is not None:
            reader = reader.option(name, str(value))
    return reader.load(folder)
