"""Listing and cross-referencing of programs, tracks, streams and indirect tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuebase.functions.scalar import FRAME_SAMPLES, b, chip_of, hex_of, hex_whole, mmss, offset_of

#: Opcode numbers and the shape of their operands in the readable form.
PLAY, STOP, QUEUE, WRITE, TRIGGER, STORE, LEVEL, LOOP, LOOP_END, END = 1, 2, 3, 4, 5, 6, 7, 14, 15, 0


def play_refs(instr: DataFrame) -> DataFrame:
    return instr.where(F.col("opcode") == PLAY).select("track_no", "seq", "addr", "channel", "repeat_n")


def stream_list(instr: DataFrame, stream: DataFrame) -> DataFrame:
    """Distinct streams that programs play, with address parts and compression figures, by address."""
    refs = play_refs(instr).select("addr").distinct()
    return compression_stats(refs.join(stream, "addr")).select("addr", chip_of(F.col("addr")).alias("chip"), offset_of(F.col("addr")).alias("offset"), "n_frames", "n_bytes", "seconds", "ratio", "saved").orderBy("addr")


def compression_stats(stream: DataFrame) -> DataFrame:
    frames, size = F.col("n_frames").cast("double"), F.col("n_bytes").cast("double")
    raw = F.col("n_frames").cast("bigint") * (2 * FRAME_SAMPLES)
    empty = (F.col("n_frames") == 0) | (F.col("n_bytes") == 0)
    return stream.withColumns({
        "seconds": F.round(frames * b(0.00768), 5),
        "raw_bytes": raw,
        "ratio": F.when(empty, b(1.0)).otherwise(F.round(raw.cast("double") / size, 6)),
        "saved": F.when(empty, b(0.0)).otherwise(F.round((b(1.0) - size / raw.cast("double")) * b(100.0), 4)),
        "bit_rate": F.when(empty, b(0.0)).otherwise(F.round(size * b(8.0) / (frames * b(0.00768)), 3)),
    })


def format_code(stream: DataFrame) -> DataFrame:
    """stream (addr, kind, minor): format name, major alone for the first kind, else major.minor from the header bits."""
    text = F.when(F.col("kind") == 0, F.lit("1")).otherwise(F.concat(F.col("kind").cast("string"), F.lit("."), F.col("minor").cast("string")))
    return stream.select("addr", text.alias("format"))


def format_compatible(stream: DataFrame, version: int) -> DataFrame:
    """stream (addr, version, major): streams of the wanted version are copied, others encoded anew; versions are numbers such as 0x9301, of which the high byte is the family.

    Major type 0 is alike in both versions of the family 0x93.
    """
    own = F.col("version")
    same = (own == version) | ((F.shiftright(own, 8) == 0x93) & F.lit(version >> 8 == 0x93) & (F.col("major") == 0))
    return stream.select("addr", "version", F.when(same, "copy").otherwise("encode").alias("action"))


def mnemonic(instr: DataFrame, track: DataFrame, *also: str) -> DataFrame:
    """Readable form of each step, with further columns of it; the track's own channel is left out.  In programs of version 1993a (a column version, if there is one) code 4 also sets a timer."""
    own = instr.join(track.select("track_no", F.col("channel").alias("own")), "track_no", "left")
    ch, a = F.col("channel"), hex_of(F.col("addr"), 6)
    tag = F.when(ch.eqNullSafe(F.col("own")), "").otherwise(F.concat(F.lit("channel "), ch.cast("string"), F.lit(", ")))
    repeat = F.when(F.col("repeat_n") == 0, ", repeat forever").when(F.col("repeat_n") == 1, "").otherwise(F.concat(F.lit(", repeat "), F.col("repeat_n").cast("string")))
    op, low = F.col("opcode"), F.col("level").bitwiseAND(255)
    timed = (F.col("version") == "1993a") if "version" in instr.columns else F.lit(False)
    level = lambda first: F.concat(F.lit("SetMixingLevel("), tag, F.when(op % 3 == first, "level").when(op % 3 == (first + 1) % 3, "increase").otherwise("decrease"), F.lit(" "), F.col("level").cast("string"))
    text = (
        F.when(op == END, "End;")
        .when(op == PLAY, F.concat(F.lit("Play("), tag, F.lit("stream $"), a, repeat, F.lit(");")))
        .when(op == STOP, F.concat(F.lit("Stop(channel "), ch.cast("string"), F.lit(");")))
        .when(op == QUEUE, F.concat(F.lit("Queue(track $"), F.hex("addr"), F.lit(");")))
        .when((op == WRITE) & timed, F.concat(F.lit("SetChannelTimer(byte $"), hex_of(low, 2), F.lit(", counter $"), hex_of(F.col("addr").bitwiseAND(65535), 4), F.lit(");")))
        .when(op == WRITE, F.concat(F.lit("WriteDataPort(byte $"), hex_of(low, 2), F.lit(");")))
        .when(op == TRIGGER, F.concat(F.lit("StartDeferred(channel "), ch.cast("string"), F.lit(");")))
        .when(op == STORE, F.concat(F.lit("SetVariable(var $"), hex_whole(F.col("var_id"), 2), F.lit(", value $"), hex_of(low, 2), F.lit(");")))
        .when(op.between(7, 9), F.concat(level(1), F.lit(");")))
        .when(op.between(10, 12), F.concat(level(1), F.lit(", steps "), F.col("wait").cast("string"), F.lit(");")))
        .when(op == 13, "NOP;")
        .when((op == LOOP) & (F.col("repeat_n") == 0), "Loop {")
        .when(op == LOOP, F.concat(F.lit("Loop ("), F.col("repeat_n").cast("string"), F.lit(") {")))
        .otherwise("}")
    )
    return own.select("track_no", "seq", "opcode", "channel", "wait", text.alias("text"), *also)


def hex_desc(instr: DataFrame) -> DataFrame:
    """Bytes of each step, grouped by operand."""
    op, two = F.col("opcode"), lambda c: hex_of(c, 2)
    ch, level = two(F.col("channel")), two(F.col("level").bitwiseAND(255))
    tail = (
        F.when(op == PLAY, F.concat_ws(" ", ch, hex_of(F.col("addr"), 6), two(F.col("repeat_n"))))
        .when(op.isin(STOP, TRIGGER), ch)
        .when(op == QUEUE, hex_of(F.col("addr").bitwiseAND(65535), 4))
        .when(op == WRITE, level)
        .when(op == STORE, F.concat_ws(" ", two(F.col("var_id").bitwiseAND(255)), level))
        .when(op.between(7, 9), F.concat_ws(" ", ch, level))
        .when(op.between(10, 12), F.concat_ws(" ", ch, level, hex_of(F.col("wait"), 4)))
        .when(op == LOOP, two(F.col("repeat_n")))
    )
    return instr.select("track_no", "seq", F.concat_ws(" ", hex_of(F.col("wait"), 4), two(op), tail).alias("bytes"))


def valid_tracks(track: DataFrame) -> DataFrame:
    """Populated tracks of channel 0..7 and type 1..3, the deferred link split into variable and table."""
    linked = F.col("type") > 1
    return track.where(F.col("channel").between(0, 7) & F.col("type").between(1, 3)).select(
        "track_no", "type", "channel",
        F.when(linked, F.shiftright("defer_code", 8)).alias("var_id"),
        F.when(linked, F.col("defer_code").bitwiseAND(255)).alias("table_id"),
    )


def track_times(instr: DataFrame) -> DataFrame:
    """(track_no, time): summed waits of each program."""
    return instr.groupBy("track_no").agg(F.sum("wait").cast("bigint").alias("time"))


def steps_with_streams(instr: DataFrame, stream: DataFrame) -> DataFrame:
    frames = F.when(F.col("repeat_n") != 0, F.col("n_frames").cast("bigint") * F.col("repeat_n"))
    return play_refs(instr).join(stream, "addr").select("track_no", "seq", "addr", "n_frames", "n_bytes", frames.alias("play_frames"))


def referenced_streams(instr: DataFrame, stream: DataFrame) -> DataFrame:
    return stream.join(play_refs(instr), "addr", "left_semi").select("addr", "n_bytes")


def orphan_streams(instr: DataFrame, stream: DataFrame) -> DataFrame:
    return stream.join(play_refs(instr), "addr", "left_anti").select("addr", "n_bytes")


def resolve_symbols(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """refs (ref_id, name) against defs (def_id, name), case ignored; several definitions: the first id; none: an error."""
    one = defs.groupBy(F.upper("name").alias("upper_name")).agg(F.min("def_id").alias("def_id"))
    joined = refs.join(one, F.upper(refs["name"]) == F.col("upper_name"), "left")
    return joined.select("ref_id", "def_id", F.when(F.col("def_id").isNull(), "unresolved").alias("problem"))


def variable_range(instr: DataFrame, track: DataFrame) -> DataFrame:
    """Largest value stored in each variable; variables only read by deferred links count as 0."""
    stored = instr.where(F.col("opcode") == STORE).groupBy(F.col("var_id").bitwiseAND(255).cast("int").alias("var_id")).agg(F.max("level").alias("stored"))
    read = valid_tracks(track).where("type = 3").select("var_id").distinct()
    return stored.join(read, "var_id", "full_outer").select("var_id", F.coalesce("stored", F.lit(0)).alias("max_value"))


def table_sizes(instr: DataFrame, track: DataFrame) -> DataFrame:
    links = valid_tracks(track).where("type = 3").select("table_id", "var_id").distinct()
    return links.join(variable_range(instr, track), "var_id").groupBy("table_id").agg((F.max("max_value") + 1).cast("int").alias("n"))


def table_entries(tables: DataFrame, contents: DataFrame) -> DataFrame:
    """tables (table_id, n), contents (table_id, pos, track_no): the first n entries of each table."""
    return contents.join(tables, "table_id").where(F.col("pos") < F.col("n")).select("table_id", "pos", "track_no")


def indirect_tables(instr: DataFrame, track: DataFrame, contents: DataFrame) -> DataFrame:
    """Each populated table with its ordered tracks and its variables."""
    links = valid_tracks(track).where("type = 3").select("table_id", "var_id")
    sizes = table_sizes(instr, track)
    entries = table_entries(sizes, contents).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("pos", "track_no"))).alias("e"))
    names = links.groupBy("table_id").agg(F.array_sort(F.collect_set("var_id")).alias("v"))
    return entries.join(names, "table_id").select(
        "table_id",
        F.array_join(F.transform("e", lambda x: x["track_no"].cast("string")), ",").alias("tracks"),
        F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("variables"),
    )


def check_table_bounds(instr: DataFrame, track: DataFrame, sizes: DataFrame) -> DataFrame:
    """sizes (table_id, n): stores whose value lies at or beyond the length of a table read through that variable, or that reach no table."""
    links = valid_tracks(track).where("type = 3").select("table_id", "var_id").distinct()
    stores = instr.where(F.col("opcode") == STORE).select("track_no", "seq", F.col("var_id").bitwiseAND(255).cast("int").alias("var_id"), "level")
    joined = stores.join(links, "var_id").join(sizes, "table_id", "left")
    return joined.where(F.col("n").isNull() | (F.col("level") >= F.col("n"))).select("track_no", "seq", "var_id", "level", "table_id", F.when(F.col("n").isNull(), "no table").otherwise("out of range").alias("problem"))


def resolve_indirect(instr: DataFrame, track: DataFrame, contents: DataFrame) -> DataFrame:
    """The track that each deferred indirect link reaches at its variable's largest value."""
    links = valid_tracks(track).where("type = 3")
    reach = links.join(variable_range(instr, track), "var_id").withColumnRenamed("max_value", "pos").withColumnRenamed("track_no", "from_track")
    entries = table_entries(table_sizes(instr, track), contents)
    return reach.join(entries, ["table_id", "pos"]).select("from_track", "table_id", "pos", "track_no")


def track_listing(track: DataFrame, instr: DataFrame, names: DataFrame) -> DataFrame:
    """Number, channel, type name, time and loop mark of each track; names (type, type_name)."""
    looping = instr.where((F.col("opcode") == LOOP) & (F.col("repeat_n") == 0)).select("track_no").distinct().withColumn("looping", F.lit(True))
    rows = track.join(F.broadcast(names), "type").join(track_times(instr), "track_no", "left").join(looping, "track_no", "left")
    time = F.concat(mmss(F.col("time")), F.when(F.col("looping"), " (loop)").otherwise(""))
    return rows.select("track_no", "channel", "type_name", F.when(F.col("type") == 1, time).alias("time"), F.when(F.col("type") > 1, F.lpad(F.hex("defer_code"), 4, "0")).alias("link"))


def playback_summary(track: DataFrame, instr: DataFrame) -> DataFrame:
    rows = track.where("type = 1").join(track_times(instr), "track_no")
    total = rows.agg(F.count("*").alias("n_tracks"), F.coalesce(F.sum("time"), F.lit(0)).cast("bigint").alias("frames"))
    return total.select("n_tracks", "frames", mmss(F.col("frames")).alias("time"))


def program_text(instr: DataFrame, track: DataFrame) -> DataFrame:
    """One text per track: its steps in order, indented by loop depth, waits in front; null if no step can be written.  Steps of no track are in no program."""
    from cuebase.operators.programs import with_depth

    lines = mnemonic(with_depth(instr.where(F.col("track_no").isNotNull())), track, "depth")
    indent = F.expr("repeat('  ', cast(depth as int))")
    line = F.concat(indent, F.when(F.col("wait") > 0, F.concat(F.lit("Wait("), F.col("wait").cast("string"), F.lit(") "))).otherwise(""), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    whole = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return lines.groupBy("track_no").agg(F.nullif(whole, F.lit("")).alias("program"))


def dense_index(numbers: DataFrame, of: str) -> DataFrame:
    """Every number from 0 to the largest, with present marked; the range is Spark's, not the driver's."""
    top = numbers.agg(F.coalesce(F.max(of), F.lit(-1)).alias("top"))
    chunk = 65536
    # the blocks are dealt out before they are filled, so that no task makes the whole range
    blocks = top.select("top", F.explode(F.expr(f"sequence(0L, greatest(top, 0L) div {chunk})")).alias("block")).repartition("block")
    all_ = blocks.where("top >= 0").select(F.explode(F.expr(f"sequence(block * {chunk}, least(top, block * {chunk} + {chunk - 1}))")).alias(of))
    return all_.join(numbers.select(of).distinct().withColumn("present", F.lit(True)), of, "left").select(of, F.coalesce("present", F.lit(False)).alias("present"))


def duplicate_names(defs: DataFrame, name: str) -> DataFrame:
    return defs.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def oversized(stream: DataFrame, largest: int) -> DataFrame:
    return stream.where(F.col("n_bytes") > largest - 16).select("addr", "n_bytes")


def overlay(base: DataFrame, patch: DataFrame, key: str, value: str) -> DataFrame:
    """Patch rows replace base rows of their key; doubled keys and missing targets are reported and change nothing."""
    twice = patch.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("new")).withColumn("twice", F.col("n") > 1)
    rows = base.select(key, F.col(value).alias("old")).join(twice, key, "full_outer")
    return rows.select(
        key,
        F.when(F.col("n").isNull() | F.col("twice"), F.col("old")).otherwise(F.when(F.col("old").isNotNull(), F.col("new"))).alias(value),
        F.when(F.col("twice"), "patched twice").when(F.col("old").isNull(), "no target").when(F.col("n").isNotNull(), "patched").otherwise("kept").alias("state"),
    )


def search_path(files: DataFrame, prefixes: DataFrame, existing: DataFrame) -> DataFrame:
    """files (file_id, name), prefixes (priority, prefix), existing (path): the first path that exists, else the name."""
    own = prefixes.where("prefix is not null").groupBy("prefix").agg(F.min("priority").alias("priority"))
    # an existing path is cut behind each length that a prefix has, so that prefixes and names meet by equality
    lengths = own.agg(F.collect_set(F.length("prefix")).alias("lengths"))
    cut = existing.where("path is not null").select("path").distinct().crossJoin(lengths).select("path", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
    parts = cut.select("path", F.expr("substring(path, 1, n)").alias("prefix"), F.expr("substring(path, n + 1)").alias("name"))
    hit = parts.join(own, "prefix").groupBy("name").agg(F.min_by("path", "priority").alias("found"))
    return files.join(hit, "name", "left").select("file_id", F.coalesce("found", "name").alias("path"), F.col("found").isNotNull().alias("exists"))


def prefix_lookup(keys: DataFrame, registry: DataFrame) -> DataFrame:
    """keys (key), registry (name): an exact match (case ignored) wins, else the only name that the key begins.

    Names are expanded into their prefixes of the lengths asked for, so both sides meet by equality.
    """
    asked = keys.select("key", F.lower("key").alias("k")).distinct()
    lengths = asked.select(F.length("k").alias("n")).distinct()
    names = registry.select("name", F.lower("name").alias("low")).distinct()
    heads = names.join(F.broadcast(lengths), F.length("low") >= F.col("n")).select("name", "low", F.expr("substring(low, 1, n)").alias("k"))
    hits = asked.join(heads, "k", "left").groupBy("key").agg(F.count("name").alias("n"), F.min("name").alias("one"), F.min(F.when(F.col("low") == F.col("k"), F.col("name"))).alias("exact"))
    found = F.coalesce("exact", F.when(F.col("n") == 1, F.col("one")))
    return hits.select("key", found.alias("name"), F.when(found.isNotNull(), "found").when(F.col("n") == 0, "unknown").otherwise("ambiguous").alias("state"))


def title_of(ids: DataFrame, rules: DataFrame) -> DataFrame:
    """First title (by priority) of each id, else [Unknown]."""
    first = rules.groupBy("id").agg(F.min_by("title", "priority").alias("title"))
    return ids.join(first, "id", "left").select("id", F.coalesce("title", F.lit("[Unknown]")).alias("title"))


def classify_title(texts: DataFrame, rules: list[tuple[int, str, str]]) -> DataFrame:
    """texts (id, text); rules (priority, title, pattern): the first pattern that the text holds, case ignored."""
    column = F.lit(None).cast("string")
    for _, title, pattern in sorted(rules, reverse=True):
        column = F.when(F.col("text").rlike(f"(?i){pattern}"), title).otherwise(column)
    return texts.select("id", F.coalesce(column, F.lit("[Unknown]")).alias("title"))


def extract_manifest(instr: DataFrame, stream: DataFrame, prefix: str = "set") -> DataFrame:
    """File name and state of every stream to be extracted, named by first use."""
    from cuebase.operators.programs import first_seen

    seen = first_seen(instr)
    rows = seen.join(stream, "addr", "left")
    name = F.format_string(f"{prefix}_%04X_%02d_%06X.raw", F.col("track_no"), F.col("number"), F.col("addr"))
    return rows.select("addr", name.alias("file"), F.when(F.col("n_bytes").isNull(), "missing").when(F.col("n_frames") == 0, "empty").otherwise("ok").alias("state"), (F.coalesce("n_bytes", F.lit(0)) + 36).cast("bigint").alias("size"))


def manifest_counts(manifest: DataFrame) -> DataFrame:
    """How many extracts there are, how many are written whole, and how many are not."""
    ok = F.col("state") != "missing"
    return manifest.agg(F.count("*").alias("found"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("errors"))


def edges_union(instr: DataFrame, track: DataFrame, contents: DataFrame) -> DataFrame:
    """Track to track references: queued, triggered through a deferred link, and indirect."""
    queue = instr.where(F.col("opcode") == QUEUE).select(F.col("track_no").alias("src"), F.col("addr").alias("dst"), F.lit("queue").alias("kind"))
    deferred = valid_tracks(track).where("type = 2").select(F.col("track_no").alias("src"), (F.col("var_id") * 256 + F.col("table_id")).cast("bigint").alias("dst"), F.lit("deferred").alias("kind"))
    indirect = resolve_indirect(instr, track, contents).select(F.col("from_track").alias("src"), F.col("track_no").alias("dst"), F.lit("indirect").alias("kind"))
    return queue.unionByName(deferred).unionByName(indirect)


def save_catalog(images: DataFrame, path: str) -> None:
    """Persist the entries of write_catalog() and a zero terminator by set: the sets given are replaced as a whole, others stay, and doing it again changes nothing.

    A set is a partition of its own, so a task that fails leaves the old one in place.
    """
    entries = write_catalog(images)
    end = entries.select("set_id").distinct().select("set_id", F.lit(8).alias("slot"), *[F.lit(0).cast(t).alias(c) for c, t in entries.dtypes if c not in ("set_id", "slot")])
    whole = entries.unionByName(end).repartition("set_id").sortWithinPartitions("set_id", "slot")
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("set_id").parquet(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The entries of each saved set before the first of size zero, as a reader of the index takes them."""
    kept = spark.read.option("basePath", path).schema("slot int, size_4k bigint, chip_code int, checksum bigint, set_id string").parquet(path)
    ended = F.sum((F.col("size_4k") == 0).cast("int")).over(Window.partitionBy("set_id").orderBy("slot"))
    return kept.withColumn("ended", ended).where("ended = 0").select("set_id", "slot", "size_4k", "chip_code", "checksum")


def write_catalog(images: DataFrame, slots: int = 8) -> DataFrame:
    """images (set_id, slot, size, checksum): eight entries a set, empty ones zero."""
    sets = images.select("set_id").distinct().select("set_id", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    rows = images.groupBy("set_id", "slot").agg(F.max("size").alias("size"), F.max("checksum").alias("checksum"))
    filled = sets.join(rows, ["set_id", "slot"], "left")
    return filled.select("set_id", "slot", F.coalesce(F.expr("size div 4096"), F.lit(0)).cast("bigint").alias("size_4k"), F.when(F.col("size").isNull(), 0).otherwise(F.col("slot") * 256).cast("int").alias("chip_code"), F.coalesce("checksum", F.lit(0)).cast("bigint").alias("checksum"))
