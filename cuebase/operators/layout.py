"""Images, their checks and their layout: patterns, checksums, slots, packing, reachability.

Image contents travel as hex text, so bytes are found by position with built-in functions.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuebase.functions.scalar import byte_at
from cuebase.operators.patterns import find_patterns, parse


def parts_of(h: Column, digits: int) -> Column:
    """A hex text cut into parts of so many digits, in one pass over it; the last may be shorter."""
    return F.regexp_extract_all(h, F.lit(f"(.{{1,{digits}}})"), 1)


#: Bytes that a step in Python works on at a time, whatever a batch or a text holds.
SLICE_BYTES = 1 << 20


def bytes_of(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, laid end to end (a view, nothing is copied), and where each value begins; nulls are empty."""
    if data.null_count:
        data = data.fill_null(b"")
    _, offsets, raw = data.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    raw = np.frombuffer(raw, dtype=np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, dtype=np.uint8)
    return raw, at - at[0]


def _sums(batches):
    """(doc_id, even, odd) of (doc_id, data): one pass over each value's bytes."""
    for batch in batches:
        raw, at = bytes_of(batch.column(1))
        spans = list(zip(at[:-1], at[1:], strict=True))
        sums = [[int(raw[a + k : z : 2].sum(dtype=np.int64)) for a, z in spans] for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in sums]], names=["doc_id", "even", "odd"])


def narrow(blob: DataFrame, rows: int = 250) -> DataFrame:
    """blob, for a step in Python: batches of so many rows at most, set for the session as the text operators do."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(blob.sparkSession.conf.get(name))
    if now <= 0 or now > rows:
        blob.sparkSession.conf.set(name, str(rows))
    return blob


def byte_sums(blob: DataFrame) -> DataFrame:
    """(doc_id, even, odd): sums of the bytes at even and odd offsets; rows of one key are summed together."""
    rows = narrow(blob).select("doc_id", F.unhex("h").alias("data")).mapInArrow(_sums, f"doc_id {dict(blob.dtypes)['doc_id']}, even long, odd long")
    return rows.groupBy("doc_id").agg(F.sum("even").alias("even"), F.sum("odd").alias("odd"))


def byte_checksum(blob: DataFrame) -> DataFrame:
    return byte_sums(blob).select("doc_id", (F.col("even") % 256 * 256 + F.col("odd") % 256).alias("checksum"))


def balance_bytes(blob: DataFrame) -> DataFrame:
    """The two bytes that bring the checksum to zero."""
    rows = byte_checksum(blob)
    return rows.select("doc_id", F.pmod(-F.expr("checksum div 256"), F.lit(256)).alias("even"), F.pmod(-F.col("checksum"), F.lit(256)).alias("odd"))


def compile_pattern(pattern: str) -> tuple[str, list[str]]:
    """Hex nibbles with * for any, a space for a byte that is skipped and small letters g-z for captures: a regex, and the captured names in order."""
    names, out = [], []
    for m in re.finditer(r"[0-9A-F* ]|([g-z])\1*", pattern):
        t = m[0]
        if t == " ":
            out.append("[0-9A-F]{2}")
        elif t == "*":
            out.append("[0-9A-F]")
        elif t[0] in "0123456789ABCDEF":
            out.append(t)
        else:
            names.append(t[0])
            out.append(f"([0-9A-F]{{{len(t)}}})")
    return "".join(out), names


def pattern_find(blob: DataFrame, pattern: str, align: int = 4) -> DataFrame:
    """First aligned match of a nibble pattern in each blob: byte offset and captured numbers."""
    regex, names = compile_pattern(pattern)
    lead = f"^(?:[0-9A-F]{{{2 * align}}})*?"
    groups = [F.conv(F.regexp_extract("h", lead + regex, k + 1), 16, 10).cast("bigint").alias(n) for k, n in enumerate(names)]
    prefix = F.regexp_extract("h", f"^((?:[0-9A-F]{{{2 * align}}})*?){regex}", 1)
    rows = blob.where(F.col("h").rlike(lead + regex))
    return rows.select("doc_id", (F.length(prefix) / 2).cast("bigint").alias("offset"), *groups)


#: Fixed value: an image's first instruction is a jump (its unit of four bytes); the signature stands behind it.
JUMP = "1[89AB][0-9A-F]{3}F[0-9A-F]{2}"


def valid_signature(blob: DataFrame, opening: str = JUMP, end: str = "00", most: int = 120) -> DataFrame:
    """The text behind the opening and before the end byte, where it is at most so many printable ASCII characters, else empty."""
    text = F.regexp_extract("h", f"^(?:{opening})((?:[2-7][0-9A-E]|[2-6]F){{0,{most}}}){end}", 1)
    return blob.select("doc_id", F.decode(F.unhex(text), "UTF-8").alias("signature"))


def locate_catalog(images: DataFrame, candidates: list[int], unit: int = 4096, also: tuple[str, ...] = ()) -> DataFrame:
    """First candidate offset at which an image's own catalog entry stands: its size in units, chip 0 and checksum 0 (two bytes each).

    Columns named in `also` are kept, so that later steps need no join.
    """
    h, size = F.col("h"), F.length("h") / 2
    word = lambda c: byte_at(h, c) * 256 + byte_at(h, c + 1)
    own = lambda c: (size >= c + 6) & (word(c) * unit == size) & (byte_at(h, c + 2) == 0) & (word(c + 4) == 0)
    return images.select("doc_id", *also, F.coalesce(*[F.when(own(c), F.lit(c)) for c in candidates]).alias("catalog"))


def channels_of(n: str, m: str) -> Column:
    ones = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(F.col(n), F.lit(31)).cast("int")) - 1
    return F.when((F.col(n) < 31) & (F.col(m) == ones), F.col(n)).otherwise(0).cast("int")


def channel_count(captured: DataFrame) -> DataFrame:
    """captured (doc_id, n, m): n channels if the mask m fits, else 0."""
    return captured.select("doc_id", "n", "m", channels_of("n", "m").alias("channels"))


#: Where code is searched (from, bytes; a match ends before the last unit of its stretch), and the patterns
#: that tell the versions apart and hold the number of channels.
CODE_95 = (0x2C00, 0x5FC, "4vvvvE 0F16F8 93300E 18***F 4wwwwE 0F1608 0F16F8 93300E 18***F")
CODE_93, CODE_93A = (0x1400, 0x5FC, "380026 3C1005 0C00C0"), (0x2800, 0x3FC, "47FFF2 47C946")
CHANNELS = (0, 0x5FFC, "22200F 4000n4 26E20F 221800 9****A 8****A 400mm4 26E20F 18***1")


#: Version numbers of software that does not name its own, what each is called, and years of named ones.
DEFAULT_NUMBER = {"1993a": 0x100, "1993b": 0x100, "1994": 0x101}
SOFTWARE = {"1993a": "Software 1.0a (1993)", "1993b": "Software 1.0b (1993)", "1994": "Software 1.01 (1993)", "1995": "Software 1.02 (1995)"}
YEARS = {0x103: "1995", 0x104: "1997", 0x105: "1997"}
#: What the two kinds of hardware are called here.
HARDWARE = {1993: "first audio board", 1995: "second audio board"}


def version_info(versions: DataFrame, hardware: dict[int, str] = HARDWARE) -> DataFrame:
    """versions (…, hardware, version, nominal): add number (the named one, else the version's own, else 0) and a readable text."""
    look = lambda column, table, other: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column), other)
    major, minor = F.shiftright("nominal", 8), F.col("nominal").bitwiseAND(255)
    named = F.concat(F.lit("Software "), major.cast("string"), F.lit("."), F.when(minor < 10, F.concat(F.lit("0"), minor.cast("string"))).otherwise(minor.cast("string")), F.lit(" ("), look(F.col("nominal").cast("int"), YEARS, F.lit("1995+")), F.lit(")"))
    software = F.when(F.col("version").isNull(), "Not detected").when(F.col("nominal").isNotNull(), named).otherwise(look(F.col("version"), SOFTWARE, F.lit("Unknown")))
    board = F.when(F.col("hardware").isNull(), "Hardware type not detected").otherwise(look(F.col("hardware"), hardware, F.lit("Unknown hardware type")))
    number = F.coalesce("nominal", look(F.col("version"), DEFAULT_NUMBER, F.lit(0)).cast("bigint"))
    return versions.withColumns({"number": number, "info": F.concat(board, F.lit(", "), software)})


def infer_version(images: DataFrame, newest: int = 0x6000, code_95=CODE_95, code_93=CODE_93, code_93a=CODE_93A, align: int = 4, channels=None) -> DataFrame:
    """images (doc_id, h, catalog): hardware by the catalog's place, software by code patterns, and the version number that 1995 code names.

    All patterns are found in one pass over the code of the images that have a catalog.  With a pattern for channels (captures n
    and m), they are counted as well.
    """
    at = F.col("catalog")
    rules = {"95": code_95, "93": code_93, "93a": code_93a} | ({"channels": channels} if channels else {})
    found = images.select("doc_id", "catalog", find_patterns(F.when(at.isNotNull(), F.unhex("h")), rules, align).alias("found"))
    has = lambda rule: F.coalesce(F.map_contains_key("found", F.lit(rule)), F.lit(False))
    captured = lambda rule, letter: F.try_element_at(F.try_element_at("found", F.lit(rule))["captured"], F.lit(letter))
    new = at == newest
    software = F.when(at.isNull(), None).when(new, "1995").when(~has("93"), "1994").when(has("93a"), "1993a").otherwise("1993b")
    out = found.select(
        "doc_id", F.when(at.isNull(), None).when(new, 1995).otherwise(1993).alias("hardware"), software.alias("version"),
        F.when(new, captured("95", parse(code_95[2]).captures[0][0])).alias("nominal"),
        *([captured("channels", "n").alias("n"), captured("channels", "m").alias("m")] if channels else []),
    )
    return out.withColumn("channels", F.coalesce(channels_of("n", "m"), F.lit(0))).drop("n", "m") if channels else out


def version_census(versions: DataFrame) -> DataFrame:
    return versions.groupBy("version").agg(F.count("*").alias("n"))


def verify_images(catalog: DataFrame, images: DataFrame) -> DataFrame:
    """catalog and images (set_id, entry_no, size, checksum): pass, or the number of the first bad entry plus 2.

    Sets with more images than entries fail as well.
    """
    rows = catalog.alias("c").join(images.alias("i"), ["set_id", "entry_no"], "full_outer")
    good = F.col("c.size").eqNullSafe(F.col("i.size")) & F.col("c.checksum").eqNullSafe(F.col("i.checksum"))
    facts = rows.groupBy("set_id").agg(F.count("c.size").alias("entries"), F.count("i.size").alias("images"), F.count_if(good).alias("good"), F.min(F.when(~good, F.col("entry_no"))).alias("first_bad"))
    return facts.select("set_id", "entries", "images", F.when((F.col("entries") == F.col("images")) & (F.col("good") == F.col("entries")), 1).otherwise(F.col("first_bad") + 2).cast("bigint").alias("code"))


def first_failure(catalog: DataFrame, images: DataFrame) -> DataFrame:
    """catalog and images (set_id, entry_no, size, checksum): the first bad entry of each set that has one, and what is wrong with it."""
    rows = catalog.alias("c").join(images.alias("i"), ["set_id", "entry_no"], "full_outer")
    problem = (
        F.when(F.col("i.size").isNull(), "missing").when(F.col("c.size").isNull(), "not in the catalog")
        .when(F.col("c.size") != F.col("i.size"), "size").when(~F.col("c.checksum").eqNullSafe(F.col("i.checksum")), "checksum")
    )
    bad = rows.select("set_id", "entry_no", problem.alias("problem")).where("problem is not null")
    return bad.groupBy("set_id").agg(F.min("entry_no").alias("entry_no"), F.min_by("problem", "entry_no").alias("problem"), F.count("*").alias("bad"))


def pick_primary(images: DataFrame, head: str, digit: str = "2", named: str | None = None) -> DataFrame:
    """images (set_id, file_no, name, head): first file that starts with head and has the digit in its name, or that is called `named` (case ignored); sets without are errors."""
    fits = (F.substring("head", 1, len(head)) == head) & F.col("name").contains(digit)
    if named is not None:
        fits = F.coalesce(fits, F.lit(False)) | (F.lower("name") == named.lower())
    first = images.groupBy("set_id").agg(F.min(F.when(fits, F.col("file_no"))).alias("file_no"))
    return first.select("set_id", "file_no", F.when(F.col("file_no").isNull(), "no primary image").alias("problem"))


#: What a file says of itself (its digit is the second group), and sets whose digit for a slot is another one.
SIGNATURE = r"^[SU]([^\d]*)(\d).*?\s+\d\d/\d\d/\d\d$"
EXCEPTIONS = [(r"(?i)^cc_\d.*", 7, 6)]


def assign_slots(images: DataFrame, exceptions: list[tuple[str, int, int]] = EXCEPTIONS, first: int = 3, last: int = 9) -> DataFrame:
    """images (set_id, file_no, name, signature): for each slot the first file, not taken yet, that has its digit in the name and in the signature.

    exceptions (pattern of the set, slot, digit): there this digit serves as well.  Slots are filled in their order, as one fold over
    the files of a set, which are a short list; files of one number go by name.
    """
    digit = F.regexp_extract("signature", SIGNATURE, 2)
    files = F.array_sort(F.collect_list(F.struct("file_no", "name", F.when(digit != "", digit.cast("int")).alias("digit"))))
    sets = images.where("file_no is not null and name is not null").groupBy("set_id").agg(files.alias("files"))
    other = F.lit(None).cast("int")

    def fill(state, slot):
        also = other
        for pattern, at, of in exceptions:
            also = F.when(F.col("set_id").rlike(pattern) & (slot == at), of).otherwise(also)
        fits = F.filter("files", lambda f: F.contains(f["name"], slot.cast("string")) & ((f["digit"] == slot) | F.coalesce(f["digit"] == also, F.lit(False))) & ~F.exists(state, lambda t: (t["file_no"] == f["file_no"]) & (t["name"] == f["name"])))
        pick = F.try_element_at(fits, F.lit(1))
        return F.when(pick.isNull(), state).otherwise(F.concat(state, F.array(F.struct(slot.alias("slot"), pick["file_no"].alias("file_no"), pick["name"].alias("name")))))

    empty = F.array().cast("array<struct<slot:int,file_no:bigint,name:string>>")
    taken = F.aggregate(F.sequence(F.lit(first), F.lit(last)), empty, fill)
    return sets.select("set_id", F.explode(taken).alias("t")).select("set_id", "t.slot", "t.file_no", "t.name")


def scan_container_headers(blob: DataFrame, magic: str, versions: tuple[int, ...] = (0x93, 0x94), channels: int = 1, rate: int = 0x7A12) -> DataFrame:
    """Files whose 36-byte header has the magic, one of the versions, and this many channels and samples a second: version and data size (the header's last number)."""
    h, at = F.col("h"), len(magic) // 2
    word = lambda k: byte_at(h, at + 2 * k) * 256 + byte_at(h, at + 2 * k + 1)
    rows = blob.where(h.startswith(magic) & (F.length(h) >= 2 * 36) & word(0).isin(*versions) & (word(1) == channels) & (word(2) == rate))
    return rows.select("doc_id", word(0).alias("version"), F.conv(F.substring(h, 2 * 32 + 1, 8), 16, 10).cast("bigint").alias("data_size"))


def read_track_index(blob: DataFrame, stride: int = 3) -> DataFrame:
    """Big-endian numbers of `stride` bytes; slots whose first byte is FF are empty."""
    kind = dict(blob.dtypes)["doc_id"]

    part = SLICE_BYTES // stride

    def run(batches):
        for batch in batches:
            raw, at = bytes_of(batch.column(1))
            held, size = [], 0

            def flush():
                owner, slot, value = (np.concatenate(x) for x in zip(*held, strict=True))
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(slot.astype(np.int32)), pa.array(value)], names=["doc_id", "slot", "addr"])

            for k, (a, z) in enumerate(zip(at[:-1], at[1:], strict=True)):
                # a value is cut at whole slots, so that neither it nor its rows are ever spread out as a whole
                whole = raw[a : a + (z - a) // stride * stride].reshape(-1, stride)
                for first in range(0, len(whole), part):
                    own = whole[first : first + part]
                    full = np.flatnonzero(own[:, 0] != 0xFF)
                    value = np.zeros(len(full), dtype=np.int64)
                    for byte in range(stride):
                        value = value << 8 | own[full, byte]
                    held.append((np.full(len(full), k), full + first, value))
                    size += len(full)
                    if size >= part:
                        yield flush()
                        held, size = [], 0
            if held:
                yield flush()

    return narrow(blob).select("doc_id", F.unhex("h").alias("data")).mapInArrow(run, f"doc_id {kind}, slot int, addr long")


def collapse_fill(blob: DataFrame, word: str, least: int = 4) -> DataFrame:
    """Runs of more than `least` fill words, on word borders, as (offset in words, count)."""
    words = blob.where(F.col("h").contains(word)).select("doc_id", F.posexplode(parts_of(F.col("h"), len(word))).alias("at", "part"))
    own = words.where(F.col("part") == word).select("doc_id", F.col("at").cast("bigint").alias("at"))
    island = F.col("at") - F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    return own.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("at").alias("offset"), F.count("*").alias("n")).where(F.col("n") > least).select("doc_id", "offset", "n")


def render_name(names: DataFrame, date: str, most: int = 75) -> DataFrame:
    """names (id, name): path stripped, extension swapped, <date> filled in, cut to `most` characters with a warning."""
    base = F.regexp_replace(F.regexp_replace("name", r"^.*/", ""), r"\.[^.]*$", "")
    text = F.replace(F.concat(base, F.lit("-<date>.out")), F.lit("<date>"), F.lit(date))
    return names.select("id", F.substring(text, 1, most).alias("name"), F.when(F.length(text) > most, "cut").alias("warning"))


#: Legal ranges of the compression parameters.
PARAM_RANGES = {"TYPE": (-1, 1), "SUBTYPE": (-1, 3), "POWERCUT": (0, 100), "MINRANGE": (0, 65536), "MAXERROR": (0, 65536), "BITRATE": (48000, 256000)}
WHOLE = ("TYPE", "SUBTYPE", "BITRATE")


def parse_param_text(rows: DataFrame) -> DataFrame:
    """rows (id, text `NAME=value, NAME=value`): one row per parameter, typed, with its problem; a part without = has no value, of a repeated name each counts."""
    part = F.explode(F.filter(F.split("text", ","), lambda x: F.trim(x) != ""))
    each = rows.select("id", part.alias("part")).select("id", F.trim(F.substring_index("part", "=", 1)).alias("key"), F.when(F.contains("part", F.lit("=")), F.trim(F.expr("substring(part, instr(part, '=') + 1)"))).alias("raw"))
    return typed_params(each)


def parse_params(rows: DataFrame) -> DataFrame:
    """rows (id, params map<string, string>): one row per parameter, typed, with its problem if it has one."""
    return typed_params(rows.select("id", F.explode("params").alias("key", "raw")))


def typed_params(each: DataFrame) -> DataFrame:
    """each (id, key, raw): * stands for -1 where any type is allowed; whole numbers are cut."""
    ranges = F.broadcast(each.sparkSession.createDataFrame([(k, a, z) for k, (a, z) in PARAM_RANGES.items()], "name string, low int, high int"))
    each = each.select("id", F.upper("key").alias("name"), "raw")
    number = F.expr("try_cast(raw as double)")
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("double")
    value = F.when((F.col("raw") == "*") & F.col("name").isin("TYPE", "SUBTYPE"), F.lit(-1.0)).when(F.col("name").isin(*WHOLE), whole).otherwise(number)
    joined = each.join(ranges, "name", "left").withColumn("value", value)
    problem = F.when(F.col("low").isNull(), "unknown").when(F.col("value").isNull(), "not a number").when(~F.col("value").between(F.col("low"), F.col("high")), "out of range")
    return joined.select("id", "name", "value", problem.alias("problem"))


def allocate_ids(named: DataFrame, warn: int = 0x50, most: int = 254) -> DataFrame:
    """named (owner, item, id or null): items without an id take the owner's lowest free ids up to `most` in order."""
    taken = named.where("id is not null").select("owner", "id").distinct()
    asking = named.where("id is null").withColumn("n", F.row_number().over(Window.partitionBy("owner").orderBy("item")))
    free = named.select("owner").distinct().select("owner", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(most).cast("bigint"))).alias("id")).join(taken, ["owner", "id"], "left_anti")
    free = free.withColumn("n", F.row_number().over(Window.partitionBy("owner").orderBy("id")))
    got = asking.select("owner", "item", "n").join(free, ["owner", "n"], "left").select("owner", "item", "id")
    all_ = named.where("id is not null").select("owner", "item", "id").unionByName(got)
    return all_.select("owner", "item", "id", F.when(F.col("id").isNull(), "error").when(F.col("id") >= warn, "warning").alias("problem"))


def layout_offsets(items: DataFrame) -> DataFrame:
    """items (image, item, size): running offsets inside each image, aligned to even bytes."""
    w = Window.partitionBy("image").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    return items.select("image", "item", "size", F.coalesce(F.sum(F.col("size") + F.col("size") % 2).over(w), F.lit(0)).cast("bigint").alias("offset"))


def space_report(items: DataFrame, capacity: int) -> DataFrame:
    used = F.sum(F.col("size") + F.col("size") % 2).cast("bigint")
    return items.groupBy("image").agg(used.alias("used")).select("image", "used", (F.lit(capacity) - F.col("used")).cast("bigint").alias("free"))


def pack_best_fit(items: DataFrame, capacity: int, most: int = 8) -> DataFrame:
    """items (build, item, size): biggest first into the tightest image that fits, a new one if none does, at most `most`.

    Sequential inside a build, parallel over builds; a build is a bounded list.
    """
    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        free: list[int] = []
        out = []
        for item, size in pdf.sort_values(["size", "item"], ascending=[False, True])[["item", "size"]].itertuples(index=False):
            fits = [(f, k) for k, f in enumerate(free) if f >= size]
            if fits:
                k = min(fits)[1]
            elif len(free) < most and size <= capacity:
                free.append(capacity)
                k = len(free) - 1
            else:
                out.append((key[0], item, size, None, "no room"))
                continue
            free[k] -= size
            out.append((key[0], item, size, k, None))
        return pd.DataFrame(out, columns=["build", "item", "size", "image", "problem"]).astype({"image": "Int32"})

    return items.groupBy("build").applyInPandas(pack, "build string, item long, size long, image int, problem string")


def bridged_gaps(reached: DataFrame, most: int = 64) -> DataFrame:
    """reached (series, pos, hit): unreached runs of at most `most` between reached ones become reached, and are marked."""
    w = Window.partitionBy("series").orderBy("pos")
    # a gap is bridged where the nearest other rows on both sides are reached ones and lie close enough: one order serves all, rows need not meet their runs again
    rows = reached.where("series is not null").withColumn("at", F.row_number().over(w))
    other = F.when(~F.col("hit").eqNullSafe(F.lit(False)), F.struct("at", "hit"))
    before = F.last(other, ignorenulls=True).over(w.rowsBetween(-most - 1, -1))
    after = F.first(other, ignorenulls=True).over(w.rowsBetween(1, most + 1))
    rows = rows.withColumns({"before": before, "after": after}).where("hit is not null")
    close = F.col("after.at") - F.col("before.at") - 1 <= most
    bridged = F.coalesce(~F.col("hit") & F.col("before.hit") & F.col("after.hit") & close, F.lit(False))
    return rows.select("series", "pos", (F.col("hit") | bridged).alias("hit"), bridged.alias("bridged"))
