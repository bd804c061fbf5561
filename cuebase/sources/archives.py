"""Archive members, programs and extracts as DataFrames."""

from __future__ import annotations

import os
import posixpath
import struct
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from cuebase.sources.shared import materialise, open_folder

#: Operand bytes of each opcode, those of older versions that differ, and the extract header (magic, version, channels, rate).
OPERANDS = {0: 0, 1: 5, 2: 1, 3: 2, 4: 1, 5: 1, 6: 2, 7: 2, 8: 2, 9: 2, 10: 4, 11: 4, 12: 4, 13: 0, 14: 1, 15: 0, 16: 2, 17: 4, 18: 4}
OLDER = {"1993a": {4: 3, 6: 0}, "1993b": {6: 0}}
MAGIC, CHANNELS, RATE = b"DCSa", 1, 0x7A12
#: Packed bytes of an archive's members that one task reads.
MEMBER_BYTES = 32 << 20
#: Bytes and files of extracts that are handed to Spark at once.
EXTRACT_BYTES, EXTRACT_FILES = 4 << 20, 1000


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """File name and size of every file under a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), "length")


def _directory(batches):
    """(path) of archives to their members: number, name, size, where the member's data lies, its packed size and method; only the index at the archive's end is read."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, own = open_folder(path)
            with store.open_input_file(own) as f, zipfile.ZipFile(f) as z:
                files = [i for i in z.infolist() if not i.is_dir()]
            odd = [i.filename for i in files if i.flag_bits & 1 or i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)]
            if odd:
                raise ValueError(f"{path}: members that are encrypted or packed by another method: {odd[:3]}")
            columns = [[path] * len(files), list(range(len(files))), *([getattr(i, c) for i in files] for c in ("filename", "file_size", "header_offset", "compress_size", "compress_type", "CRC"))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _DIRECTORY.types, strict=True)], schema=_DIRECTORY)


_DIRECTORY = pa.schema([("set_id", pa.string()), ("file_no", pa.int32()), ("name", pa.string()), ("size", pa.int64()), ("at", pa.int64()), ("packed", pa.int64()), ("method", pa.int32()), ("crc", pa.int64())])


def _contents(batches):
    """Members to their contents: each is read by its own range of the archive and inflated, one at a time."""
    for batch in batches:
        rows, held = batch.to_pylist(), None
        try:
            for r in rows:
                if held is None or held[0] != r["set_id"]:
                    if held is not None:
                        held[1].close()
                    store, own = open_folder(r["set_id"])
                    held = r["set_id"], store.open_input_file(own)
                name, extra = struct.unpack("<HH", held[1].read_at(4, r["at"] + 26))
                raw = held[1].read_at(r["packed"], r["at"] + 30 + name + extra)
                data = zlib.decompress(raw, -15) if r["method"] == zipfile.ZIP_DEFLATED else raw
                if zlib.crc32(data) != r["crc"]:
                    raise ValueError(f"{r['set_id']}: {r['name']} is damaged")
                yield pa.RecordBatch.from_arrays([pa.array([r["set_id"]]), pa.array([r["file_no"]], pa.int32()), pa.array([r["name"]]), pa.array([r["size"]], pa.int64()), pa.array([data], pa.binary())], names=["set_id", "file_no", "name", "size", "content"])
        finally:
            if held is not None:
                held[1].close()


def list_members(spark: SparkSession, path: str) -> DataFrame:
    """(set_id, file_no, name, size, at, packed, method, crc) of every member of the ZIP archives under a path; folders are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return files.select("path").mapInArrow(_directory, "set_id string, file_no int, name string, size long, at long, packed long, method int, crc long")


def load_images(spark: SparkSession, path: str) -> DataFrame:
    """(set_id, file_no, name, size, content) of every member of the ZIP archives under a path; folders are skipped.

    Archives are never held whole: their directories are read first, then the members, not the archives, are dealt out to
    tasks, which read each by its own range.  So one large archive is the work of many tasks.
    """
    members = materialise(list_members(spark, path), "members")
    total = members.agg(F.sum("packed")).first()[0] or 0
    # about MEMBER_BYTES of members in a task, neighbours of one archive together; the number is given, as Spark knows only the sizes of these short rows
    block = F.sum("packed").over(Window.partitionBy("set_id").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    dealt = members.withColumn("block", F.floor(F.coalesce(block, F.lit(0)) / MEMBER_BYTES)).repartition(1 + total // MEMBER_BYTES, "set_id", "block").sortWithinPartitions("set_id", "at")
    return dealt.drop("block").mapInArrow(_contents, "set_id string, file_no int, name string, size long, content binary")


def write_sets(rows: DataFrame, path: str, most_files: int = 500, most_bytes: int = 4_000_000) -> DataFrame:
    """rows (id, data), to ZIP archives of bounded groups in a folder that all executors share; one row (set, files) per archive.

    Each task cuts its own rows into groups, so no row is shuffled; null data is an empty file.
    """
    folder = path.removeprefix("file://")
    if "://" in folder:
        raise ValueError("archives are written as files: give a mounted folder that all executors share")

    def put(name, files):
        os.makedirs(folder, exist_ok=True)
        # a retried task writes the same name with the same members
        part = f"{folder}/.{name}.{os.getpid()}"
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
            for k, (i, data) in enumerate(files):
                z.writestr(zipfile.ZipInfo(f"{k:04d}_{'none' if i is None else i}.rom"), data, zipfile.ZIP_DEFLATED, 1)
        os.replace(part, f"{folder}/{name}")
        return name, len(files)

    def run(batches):
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            done = []
            for i, data in zip(batch.column(0), batch.column(1), strict=True):
                data = data.as_py() or b""
                if held and (len(held) >= most_files or size + len(data) > most_bytes):
                    done.append(put(f"set_{task:06d}_{n:06d}.zip", held))
                    n, held, size = n + 1, [], 0
                held.append((i.as_py(), data))
                size += len(data)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], names=["set", "files"])
        if held:
            x = put(f"set_{task:06d}_{n:06d}.zip", held)
            yield pa.RecordBatch.from_arrays([pa.array([x[0]]), pa.array([x[1]], pa.int64())], names=["set", "files"])

    return rows.select("id", F.col("data").cast("binary").alias("data")).mapInArrow(run, "set string, files long")


def widths(version: str | None) -> dict[int, int]:
    """Operand bytes of each opcode in a version; those without a table of their own have the latest one."""
    return OPERANDS | OLDER.get(version or "", {})


def program_rows(data: bytes, version: str | None = None) -> list[tuple[int, int, int, int, str]]:
    """(seq, offset, wait, opcode, operands) up to the end of the program: an end, an endless wait, or a code that does not exist, that step included."""
    known, out, at = widths(version), [], 0
    while at + 3 <= len(data):
        (wait,), opcode = struct.unpack_from(">H", data, at), data[at + 2]
        n = known.get(opcode, 0)
        if at + 3 + n > len(data):
            break
        out.append((len(out), at, wait, opcode, data[at + 3 : at + 3 + n].hex().upper()))
        at += 3 + n
        if wait == 0xFFFF or opcode == 0 or opcode not in known:
            break
    return out


def explode_programs(programs: DataFrame, id_col: str, data_col: str, version_col: str | None = None) -> DataFrame:
    """One row per step of each program, decoded by its version (1993a, 1993b, 1994, 1995; the latest without one)."""
    def run(batches):
        for pdf in batches:
            rows = [(i, *r) for i, data, version in zip(pdf["id"], pdf["data"], pdf["version"], strict=True) if data is not None for r in program_rows(bytes(data), version)]
            yield pd.DataFrame(rows, columns=["id", "seq", "offset", "wait", "opcode", "operands"])

    version = F.lit(None).cast("string") if version_col is None else F.col(version_col)
    own = programs.select(F.col(id_col).cast("long").alias("id"), F.col(data_col).cast("binary").alias("data"), version.alias("version"))
    return own.mapInPandas(run, "id long, seq int, offset int, wait int, opcode int, operands string")


def register_program_rows(spark: SparkSession) -> None:
    """SQL: SELECT * FROM t, LATERAL program_rows(t.data, t.version), and SELECT * FROM program_table(TABLE(SELECT id, data, version FROM t))."""
    from pyspark.sql.functions import udtf

    steps = "seq int, offset int, wait int, opcode int, operands string"

    class Rows:
        def eval(self, data: bytes, version: str | None = None):
            if data is not None:
                yield from program_rows(bytes(data), version)

    class Table:
        def eval(self, row):
            if row["data"] is not None:
                for r in program_rows(bytes(row["data"]), row["version"]):
                    yield row["id"], *r

    spark.udtf.register("program_rows", udtf(Rows, returnType=steps))
    spark.udtf.register("program_table", udtf(Table, returnType=f"id long, {steps}"))


def register_functions(spark: SparkSession) -> None:
    """Address, time and level helpers as SQL functions, without Python."""
    # 1.15 product: the factor is squared bit by bit and multiplied in where the exponent's bit is clear
    power = (
        "aggregate(sequence(0, 7), named_struct('v', {start}, 'f', {factor}), (a, i) -> named_struct("
        "'v', CASE WHEN shiftright({exponent}, i) & 1 = 0 THEN shiftright(a.v * a.f, 15) ELSE a.v END, 'f', shiftright(a.f * a.f, 15)), a -> a.v)"
    )
    for text in (
        "chip_of(addr BIGINT) RETURNS INT RETURN CAST(shiftright(addr, 21) & 7 AS INT)",
        "offset_of(addr BIGINT) RETURNS BIGINT RETURN addr & 2097151",
        "address_of(chip BIGINT, off BIGINT) RETURNS BIGINT RETURN off | shiftleft(chip - 2, 21)",
        f"gain_of(volume BIGINT) RETURNS BIGINT RETURN CASE WHEN volume = 0 THEN 0L ELSE 2L * {power.format(start='16383L', factor='32152L', exponent='volume')} END",
        f"attenuation_of(total BIGINT, volume BIGINT) RETURNS BIGINT RETURN 2L * {power.format(start='shiftleft(volume, 7)', factor='31892L', exponent='(shiftright(total, 6) & 1023) + 128')}",
        "frames_of(ms DOUBLE) RETURNS BIGINT RETURN CAST(floor(ms / CAST(7.68 AS DOUBLE) + 0.5) AS BIGINT)",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")


class ExtractSource(DataSource):
    """Writer for extracts: one file per row (name, version, payload) under the given path, raw with a 36-byte header, or WAV."""

    @classmethod
    def name(cls) -> str:
        return "extracts"

    def schema(self) -> str:
        return "name string, version int, payload binary"

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return ExtractWriter(self.options["path"], self.options.get("form", "raw"))


@dataclass
class Staged(WriterCommitMessage):
    """A task's folder of whole files, and how many there are."""

    folder: str
    files: int


class ExtractWriter(DataSourceArrowWriter):
    """Tasks write to folders of their own attempt under a hidden one; the driver moves the folders of the attempts that Spark
    took into place, one for each task, when all are done, and removes the rest.  So a failed task or job leaves no visible file."""

    def __init__(self, path: str, form: str):
        self.path, self.form, self.job = path, form, uuid.uuid4().hex

    def header(self, version: int, size: int) -> bytes:
        if self.form == "wav":
            return struct.pack("<4sI8sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVEfmt ", 16, 1, 1, 31250, 62500, 2, 16, b"data", size)
        return struct.pack(">4sHHH22xI", MAGIC, version, CHANNELS, RATE, size)

    def staging(self) -> str:
        return posixpath.join(open_folder(self.path)[1], f"_staged-{self.job}")

    def write(self, iterator) -> WriterCommitMessage:
        store, _ = open_folder(self.path)
        context = TaskContext.get()
        own, n = posixpath.join(self.staging(), f"part-{context.partitionId():06d}-{context.taskAttemptId()}"), 0
        for batch in iterator:
            for name, version, payload in zip(*[batch.column(c).to_pylist() for c in ("name", "version", "payload")], strict=True):
                if not name or "/" in name or payload is None:
                    raise ValueError(f"an extract needs a plain file name and a payload: {name!r}")
                if not n:
                    store.create_dir(own, recursive=True)
                with store.open_output_stream(posixpath.join(own, name)) as f:
                    f.write(self.header(version, len(payload)) + payload)
                n += 1
        return Staged(own, n)

    def commit(self, messages) -> None:
        store, base = open_folder(self.path)
        store.create_dir(base, recursive=True)
        for m in messages:
            if m is not None and m.files:
                store.move(m.folder, posixpath.join(base, f"{posixpath.basename(m.folder)}-{self.job}"))
        self._clear(store)

    def abort(self, messages) -> None:
        self._clear(open_folder(self.path)[0])

    def _clear(self, store) -> None:
        if store.get_file_info(self.staging()).type == FileType.Directory:
            store.delete_dir(self.staging())


def write_extracts(extracts: DataFrame, path: str, form: str = "raw") -> None:
    """extracts (name, version, payload), to files in one folder for each task under path, which is on any file system that Arrow opens (file, hdfs, s3, gs).

    Names are unique within a task's folder; equal ones there overwrite each other, so names should tell rows apart.
    """
    extracts.sparkSession.dataSource.register(ExtractSource)
    extracts.select("name", F.col("version").cast("int").alias("version"), F.col("payload").cast("binary").alias("payload")).write.format("extracts").mode("append").option("path", path).option("form", form).save()


def _extracts(batches):
    """Folders of write_extracts() to the files in them, which are read one after the other."""
    def batch_of(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _EXTRACT.types, strict=True)], schema=_EXTRACT)

    for batch in batches:
        for folder in batch.column(0).to_pylist():
            store, own = open_folder(folder)
            held, size = [], 0
            for info in store.get_file_info(FileSelector(own)):
                if held and (len(held) >= EXTRACT_FILES or size + info.size > EXTRACT_BYTES):
                    yield batch_of(held)
                    held, size = [], 0
                with store.open_input_file(info.path) as f:
                    held.append((info.base_name, info.size, f.read()))
                size += info.size
            if held:
                yield batch_of(held)


_EXTRACT = pa.schema([("name", pa.string()), ("size", pa.int64()), ("content", pa.binary())])


def read_extracts(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, content) of every file that write_extracts() put under a path.

    The driver lists only the folders, one for each task that wrote; what is in a folder is listed and read by one task, so
    the number of tasks does not grow with that of the files.
    """
    store, base = open_folder(path)
    folders = [f"{path}/{i.base_name}" for i in store.get_file_info(FileSelector(base)) if i.type == FileType.Directory and not i.base_name.startswith("_")]
    dealt = spark.sparkContext.parallelize([(f,) for f in sorted(folders)], max(len(folders), 1))
    return spark.createDataFrame(dealt, "folder string").mapInArrow(_extracts, "name string, size long, content binary")
