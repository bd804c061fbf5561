"""Small cases of the operators: streams equal batches, sequential models, sources and sinks, edges."""

from __future__ import annotations

import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from cuebase import registry
from cuebase.functions import scalar as S
from cuebase.operators import catalog, graph, layout, patterns, programs, signal, spectrum, validate
from cuebase.plans.bindings import Views
from cuebase.sources import archives
from cuebase.streaming import commands as J


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


rows_of = rows


def test_framing_rules():
    start = (0, 0, 0, float("-inf"))
    feed = lambda *b: [(float(k), k, x) for k, x in enumerate(b)]
    assert J.frame_bytes(start, feed(0x55, 0xAA, 0x10, 0xEF), 13)[1] == [(3, 0x55AA, 0x10)]
    assert J.frame_bytes(start, feed(0x55, 0xAA, 0x10, 0x10, 0x00, 0x05), 13)[1] == [(5, 5, None)]
    assert J.frame_bytes(start, feed(0x55, 0xB5, 0x80, 0x00, 0x55, 0xC2), 13)[1] == [(5, 0x55C2, None)]
    assert J.frame_bytes(start, [(0, 0, 0x55), (20, 1, 0x00), (21, 2, 0x07)], 13)[1] == [(2, 7, None)]


def test_live_compare_keeps_one_sided_samples(spark, tmp_path):
    """A sample of one side only is reported when the watermark has passed it, with a null for the other."""
    rows = lambda *keys: [(k, 3600 * k, 10 * k) for k in keys]
    for side, keys in (("a", (1, 2, 4, 200)), ("b", (1, 3, 4, 200))):
        df = spark.createDataFrame(rows(*keys), "key long, at long, value long").select("key", F.timestamp_seconds("at").alias("ts"), F.when((F.col("key") == 4) & F.lit(side == "b"), 41).otherwise(F.col("value")).alias("value"))
        df.write.parquet(str(tmp_path / side))
    read = lambda side: spark.readStream.schema("key long, ts timestamp, value long").parquet(str(tmp_path / side))
    got = J.run_available(J.live_compare(read("a"), read("b"), "1 hour")).fillna(-1)
    assert rows_of(got, "key", "a", "b") == [(2, 20, -1), (3, -1, 30), (4, 40, 41)]


def test_nesting_clamps_and_times(spark):
    ops = [(1, 0, 15, 5, 0), (1, 1, 14, 1, 2), (1, 2, 14, 1, 3), (1, 3, 13, 2, 0), (1, 4, 15, 1, 0), (1, 5, 15, 1, 0), (1, 6, 0, 4, 0), (1, 7, 13, 9, 0)]
    df = spark.createDataFrame(ops, "track_no long, seq long, opcode int, wait int, repeat_n int")
    assert [r.depth for r in programs.nesting(df).orderBy("seq").collect()] == [0, 0, 1, 2, 2, 1, 0, 0]
    assert rows(programs.track_time(df), "frames") == [(5 + 1 + 1 * 2 + (2 + 1) * 6 + 1 * 2 + 4,)]
    assert [r.seq for r in programs.unmatched_ends(df).collect()] == [0]


def test_timeline_plays_loops_out(spark):
    ops = [(1, 0, 14, 0, 2), (1, 1, 1, 10, 1), (1, 2, 15, 0, 0), (1, 3, 0, 5, 0)]
    df = spark.createDataFrame(ops, "track_no long, seq long, opcode int, wait int, repeat_n int")
    assert rows(programs.timeline(df, 100), "frame", "seq") == sorted([(0, 0), (10, 1), (10, 2), (20, 1), (20, 2), (25, 3)])


def test_timeline_has_no_cap(spark):
    """An endless loop is played to the horizon; one that takes no time ends after its first pass."""
    ops = [(1, 0, 14, 0, 0), (1, 1, 13, 1, 1), (1, 2, 15, 0, 0), (2, 0, 14, 3, 0), (2, 1, 13, 0, 1), (2, 2, 15, 0, 0), (2, 3, 13, 9, 0)]
    df = spark.createDataFrame(ops, "track_no long, seq long, opcode int, wait int, repeat_n int")
    got = programs.timeline(df, 120_000).groupBy("track_no").agg(F.count("*").alias("n"), F.max("frame").alias("last"))
    assert rows(got, "track_no", "n", "last") == [(1, 240_001, 120_000), (2, 3, 3)]


def test_endless_waits_last_as_long_as_their_stream(spark):
    ops = [(1, 0, 1, 5, 0, 7), (1, 1, 14, 2, 3, 0), (1, 2, 1, 1, 0, 8), (1, 3, 13, 65535, 0, 0), (1, 4, 13, 9, 0, 0), (2, 0, 1, 4, 0, 7), (2, 1, 14, 0, 2, 0), (2, 2, 15, 1, 0, 0), (2, 3, 13, 65535, 0, 0), (3, 0, 14, 2, 0, 0), (3, 1, 15, 3, 0, 0), (3, 2, 13, 50, 0, 0), (4, 0, 1, 4, 1, 7), (4, 1, 13, 65535, 0, 0)]
    df = spark.createDataFrame(ops, "track_no long, seq long, opcode int, wait int, repeat_n int, addr long")
    streams = spark.createDataFrame([(7, 100), (8, 20)], "addr long, n_frames int")
    # 5 + 2 + 3 passes of 1 and stream 8; 4 + 2 passes of 1 + stream 7; an endless loop counts once; no endless stream: no time
    assert rows(programs.track_time(df, streams), "track_no", "frames", "looping") == [(1, 70, True), (2, 106, True), (3, 5, True), (4, 4, True)]


def test_images_are_told_apart(spark):
    """Catalog by its own size, chip 0 and checksum 0; version by place and code; only FF slots are empty."""
    def image(size, at, units, chip=0, check=0, code=()):
        raw = bytearray(size)
        raw[at : at + 6] = struct.pack(">HHH", units, chip, check)
        for place, text in code:
            raw[place : place + len(bytes.fromhex(text))] = bytes.fromhex(text)
        return raw.hex().upper()

    files = [(1, image(0x8000, 0x3000, 8)), (2, image(0x8000, 0x4000, 8, code=[(0x1408, "380026FF3C1005FF0C00C0FF")])), (3, image(0x8000, 0x6000, 8)), (4, image(0x8000, 0x3000, 7)), (5, image(0x8000, 0x3000, 8, check=1)), (6, "00")]
    files.append((7, image(0x8000, 0x4000, 8, code=[(0x1408, "380026FF3C1005FF0C00C0FF"), (0x2804, "47FFF2FF47C946FF")])))
    df = spark.createDataFrame(files, "doc_id int, h string")
    found = df.join(layout.locate_catalog(df, [0x3000, 0x4000, 0x6000]), "doc_id")
    got = {r.doc_id: (r.hardware, r.version) for r in layout.infer_version(found).collect()}
    assert got == {1: (1993, "1994"), 2: (1993, "1993b"), 3: (1995, "1995"), 4: (None, None), 5: (None, None), 6: (None, None), 7: (1993, "1993a")}
    index = layout.read_track_index(spark.createDataFrame([(1, "C50000FF0000000010AB")], "doc_id int, h string"))
    assert rows(index, "slot", "addr") == [(0, 0xC50000), (2, 16)]


def test_code_patterns_by_units(spark):
    """Instructions are three bytes in units of four; the last unit of a stretch is not matched; number and channels come from the same pass."""
    old, early = "380026FF3C1005000C00C0AB", "47FFF2FF47C946FF"
    named = "40104EFF0F16F8FF93300EFF18ABCFFF" + "40104EFF0F1608FF0F16F8FF93300EFF18ABCFFF"
    loop = "22200FFF4000{}4FF26E20FFF221800FF9ABCDAFF8ABCDAFF400{}4FF26E20FFF18ABC1FF"

    def image(at, *code):
        raw = bytearray(b"\xff" * 0x8000)
        raw[at : at + 6] = struct.pack(">HHH", 8, 0, 0)
        for place, text in code:
            raw[place : place + len(text) // 2] = bytes.fromhex(text)
        return raw.hex().upper()

    files = [
        image(0x6000, (0x2C00 + 40, named), (0x100, loop.format("6", "3F"))),  # 1.04 and 6 channels
        image(0x6000, (0x2C00 + 42, named), (0x100, loop.format("6", "3E"))),  # not at a unit; the mask does not fit
        image(0x3000, (0x1400 + 0x600 - 16, old)),  # ends before the last unit
        image(0x3000, (0x1400 + 0x600 - 12, old)),  # ends with it
        image(0x3000, (0x1400, old), (0x2800 + 0x400 - 12, early)),
        image(0x3000, (0x1400, old.replace("0C00C0", "0C00C1")), (0x1500, old)),  # a literal that is not confirmed comes first
        image(0x3100, (0x1400, old)),  # no catalog
        "",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(files, 1)), "doc_id int, h string")
    found = df.join(layout.locate_catalog(df, [0x3000, 0x4000, 0x6000]), "doc_id")
    got = layout.version_info(layout.infer_version(found, channels=layout.CHANNELS))
    assert rows(got, "doc_id", "version", "nominal", "channels", "number") == [
        (1, "1995", 0x104, 6, 0x104), (2, "1995", None, 0, 0), (3, "1993b", None, 0, 0x100), (4, "1994", None, 0, 0x101), (5, "1993a", None, 0, 0x100),
        (6, "1993b", None, 0, 0x100), (7, None, None, 0, 0), (8, None, None, 0, 0), (9, None, None, 0, 0),
    ]


def test_volume_shift_counts_free_bits(spark):
    """Silence 8, small sums large shifts, full scale 0; from 2 ** 31 on leading ones are free."""
    def plain(total):
        sign, free = total >> 31 & 1, 0
        while free < 31 and total >> (30 - free) & 1 == sign:
            free += 1
        return max(0, min(8, free - 3))

    levels = [(k, 1, v) for k, v in enumerate([0, 1, 2, 7, 15, 31, 60, 100, 128, 255])] + [(10, 1, 255)] * 8 + [(11, 1, 255)] * 4 + [(11, 1, 4)]
    df = spark.createDataFrame(levels, "track_no int, opcode int, level int")
    sums = {}
    for track, _, level in levels:
        sums[track] = sums.get(track, 0) + level * 256 * 0x7FFE
    assert rows(programs.volume_shift(df), "track_no", "shift") == sorted((k, plain((x >> 2) % 2**32)) for k, x in sums.items())


def test_silent_streams_keep_all_bands(spark):
    frames = [(1, 0, k, 0) for k in range(64)] + [(2, 0, k, 100 if k == 0 else 10) for k in range(64)]
    df = spark.createDataFrame(frames, "stream int, frame_no long, bin int, q int")
    # roots: 400 of band 0, then 40 each: 40 * 15 + 400 = 1000
    assert rows(spectrum.band_cutoff(df), "stream", "keep") == [(1, 16), (2, 13)]
    assert rows(spectrum.band_cutoff(df, 40), "stream", "keep") == [(1, 16), (2, 0)]
    assert rows(spectrum.band_rms(df).where("band = 0"), "stream", "rms", "total") == [(1, 0.0, 0.0), (2, 400.0, 1000.0)]


def test_codes_wrap_around(spark):
    """A width of 2 bits at 4096 holds -2 to 1: 3 * 4096 is stored as -1, and so is as wrong as 4 * 4096."""
    df = spark.createDataFrame([(1, 0, 0, 3 * 4096)], "stream int, frame_no long, bin int, q int")
    assert rows(spectrum.quant_error(df).where("code in (1, 4)"), "code", "error") == [(1, (4 * 4096) ** 2), (4, (256 * 64) ** 2)]


def test_endless_waits_are_not_folded(spark):
    ops = [(1, 0, 13, 5), (1, 1, 13, 7), (1, 2, 1, 1), (1, 3, 13, 4), (1, 4, 13, 65535), (1, 5, 13, 2), (1, 6, 2, 3), (1, 7, 13, 9)]
    df = spark.createDataFrame(ops, "track_no int, seq int, opcode int, wait int")
    assert rows(programs.fold_waits(df), "seq", "opcode", "wait") == [(2, 1, 13), (4, 13, 65535), (6, 2, 5)]


def test_peaks_and_their_figure(spark):
    """The mean does not hide a peak in bin 1; without a lower peak the strongest's own level counts; too few peaks: -1."""
    spectra = {"low": [9000, 1000, 0, 10, 1, 0], "alone": [0, 0, 500, 0, 0, 0], "near": [0, 0, 900, 100, 800, 0], "edge": [0, 0, 100, 0, 0, 1000], "none": [0, 1, 2, 3, 4, 5]}
    df = spark.createDataFrame([(s, 0, k, x) for s, xs in spectra.items() for k, x in enumerate(xs)], "stream string, frame_no long, k int, x int")
    assert rows(spectrum.snr(df), "stream", "snr") == [("alone", 0.0), ("edge", -20.0), ("low", 40.0), ("near", 0.0), ("none", -1.0)]
    assert rows(spectrum.snr(df, expected=2), "stream", "snr")[:2] == [("alone", -1.0), ("edge", -1.0)]


def test_gaps_of_the_limit_are_bridged(spark):
    hits = [(1, k, h == "x") for k, h in enumerate("x..x...x.")]
    df = spark.createDataFrame(hits, "series int, pos long, hit boolean")
    assert rows(layout.bridged_gaps(df, 2).where("bridged"), "pos") == [(1,), (2,)]


def test_fades_start_where_others_end(spark):
    """Against a mixer that is advanced frame by frame: unfinished fades, limits, commands in one frame, negative parameters."""
    rng = random.Random(7)
    commands = [(k, c, rng.randrange(40), i, rng.randrange(3), rng.choice([127, -128, 200, *range(-9, 9)]), rng.choice([0, 0, 1, 3, 7, 30])) for k in range(12) for c in range(2) for i in range(9)]
    seen = {}
    for key in range(12):
        for channel in range(2):
            own = sorted((x[2], x[3], *x[4:]) for x in commands if x[:2] == (key, channel))
            now = left = delta = target = 0
            seq = None
            for frame in range(80):
                for at, i, mode, param, steps in own:
                    if at == frame:
                        change = (param - 256 if param > 127 else param) * 64
                        wanted = change if mode == 0 else now + change if mode == 1 else now - change
                        seq, left, target = i, steps, max(-8191, min(8191, wanted))
                        if steps:
                            delta = int((wanted - now) / steps)
                        else:
                            now = target
                            seen[key, channel, i, frame] = now
                if left:
                    left -= 1
                    now = target if left == 0 else max(-8191, min(8191, now + delta))
                    seen[key, channel, seq, frame + 1] = now
    df = spark.createDataFrame([*commands, (None, 1, 1, 1, 1, 1, 1), (1, 1, None, 1, 1, 1, 1)], "key int, channel int, frame int, seq int, mode int, param int, steps int")
    got = {(r.key, r.channel, r.seq, r.frame): r.level for r in programs.mixing_levels(df).collect()}
    assert got == seen
    assert programs.mixing_levels(df.limit(0)).count() == 0


def test_fade_steps_come_before_the_limit(spark):
    df = spark.createDataFrame([(1, 0, 11, 100, 4)], "track_no int, seq int, opcode int, level int, wait int")
    assert rows(programs.fade_ramp(df), "frame", "level") == [(1, 8000), (2, 8191), (3, 8191), (4, 8191)]


def test_signature_stands_behind_a_jump(spark):
    """Four bytes of a jump, then at most 120 printable characters and a zero; anything else has none."""
    text = b"S2 1995 sounds 01/02/95"
    code = [b"\x18\x12\x3f\xff" + text + b"\0rest", b"\x1b\0\x0f\0\0", b"\x1c\x12\x3f\xff" + text + b"\0", b"\x18\x12\x3e\xff" + text + b"\0", text + b"\0"]
    code += [b"\x19\0\xff\0" + b"x" * n + b"\0" for n in (120, 121)] + [b"\x18\0\x0f\0a\x7f\0", b"\x18\0\x0f\0" + text, b""]
    df = spark.createDataFrame([(k, c.hex().upper()) for k, c in enumerate(code)], "doc_id int, h string")
    found = {r.doc_id: r.signature for r in layout.valid_signature(df).collect()}
    assert found == {k: "" for k in range(10)} | {0: text.decode(), 5: "x" * 120}


def test_pattern_table_equals_brute_force(spark):
    """Random code of few byte values, so that literals overlap and fail late, against a search at every unit."""
    rng = random.Random(5)
    rules = {f"r{k}": (rng.randrange(0, 20), rng.choice([None, 3, 40, 90]), text) for k, text in enumerate(["AA", "AAAA AB", "A*BA", "gA hA gB", "** g*", "ABABAB ABAB", "ABg"])}
    code = [bytes(rng.choice([0xAA, 0xAB, 0xBA, 0xAA]) for _ in range(rng.randrange(0, 150))).hex().upper() for _ in range(60)]

    def plain(h, rule):
        start, size, text = rule
        nibbles = text.replace(" ", "**")
        nibbles += "*" * (len(nibbles) % 2)
        part = h[2 * start :] if size is None else h[2 * start : 2 * (start + size)]
        for at in range(0, len(part) - len(nibbles) + 1, 4):
            here = part[at : at + len(nibbles)]
            if all(p in "*gh" or p == c for p, c in zip(nibbles, here, strict=True)):
                return start + at // 2, {p: int(c, 16) for p, c in zip(nibbles, here, strict=True) if p in "gh"}

    df = spark.createDataFrame([(k, h) for k, h in enumerate([*code, None])], "doc_id int, h string")
    got = {(r.doc_id, r.rule): (r.offset, r.captured) for r in patterns.pattern_table(df, rules, align=2).collect()}
    assert got == {(k, name): hit for k, h in enumerate(code) for name, rule in rules.items() if (hit := plain(h, rule))}
    assert patterns.pattern_table(df.limit(0), rules).count() == 0


def test_pcm_round_trip(spark):
    df = spark.range(-32768, 32768).select(F.col("id").cast("int").alias("x"))
    assert df.where(S.float_to_pcm(S.pcm_to_float(F.col("x"))) != F.col("x")).count() == 0
    clip = spark.createDataFrame([(0.95,), (1.5,), (-33.0,)], "x double").select(S.float_to_pcm(F.col("x")).alias("y"))
    assert [r.y for r in clip.collect()] == [31129, 32767, -32768]


def test_volume_gain_edges(spark):
    df = spark.createDataFrame([(0,), (255,)], "v int").select(S.volume_gain(F.col("v")).alias("g"))
    assert [r.g for r in df.collect()] == [0, 0x3FFF * 2]


def test_linear_resample_keeps_a_line(spark):
    df = spark.createDataFrame([(1, k, 10 * k) for k in range(9)], "series long, idx long, pcm int")
    out = {r.idx: r.x for r in signal.linear_resample(df, 3, 2).collect()}
    assert all(abs(out[k] - 10 * k * 2 / 3) < 1e-5 for k in range(12))
    assert signal.length_check(df, signal.hold_resample(df, 3, 2), 3, 2).first().ok


def test_reachable_ends_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (None, 1)], "src long, dst long")
    r = spark.createDataFrame([(1,), (None,)], "node long")
    assert rows(graph.reachable(e, r), "node") == [(1,), (2,), (3,)]
    assert graph.reachable(e.limit(0), r).count() == 1


def test_reachable_along_a_chain(spark, monkeypatch):
    """A chain is followed to its end, over tables that are put together on the way."""
    monkeypatch.setattr(graph, "PARTS_MOST", 3)
    chain = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert rows(graph.reachable(chain, spark.range(1).withColumnRenamed("id", "node"), hops=8), "node") == [(k,) for k in range(61)]


def test_pack_best_fit(spark):
    items = spark.createDataFrame([("a", k, s) for k, s in enumerate([60, 50, 40, 30, 200])], "build string, item long, size long")
    got = {r.item: (r.image, r.problem) for r in layout.pack_best_fit(items, 100).collect()}
    assert got == {0: (0, None), 1: (1, None), 2: (0, None), 3: (1, None), 4: (None, "no room")}


def test_patterns():
    assert layout.compile_pattern("0A*gg") == ("0A[0-9A-F]([0-9A-F]{2})", ["g"])


def test_peaks_and_snr(spark):
    spec = spark.createDataFrame([(0, 0, k, x) for k, x in enumerate([0, 1000, 10, 100, 5, 1, 0])], "stream int, frame_no int, k int, x int")
    assert rows(spectrum.local_peaks(spec), "k") == [(1,), (3,)]
    assert abs(spectrum.snr(spec).first().snr - 20.0) < 1e-4
    smooth = lambda *x: [r.x for r in spectrum.smooth_troughs(spark.createDataFrame([(0, 0, k, v) for k, v in enumerate(x)], "stream int, frame_no int, k int, x int")).orderBy("k").collect()]
    # only the gap between neighbouring peaks is filled, from the smaller one
    assert smooth(0, 1000, 0, 10, 0, 1000, 0) == [0, 1000, 9.99, 10, 9.99, 1000, 0]
    got = smooth(7, 3, 500, 1, 2, 400, 9, 8)
    assert all(abs(a - b) < 1e-5 for a, b in zip(got, [7, 3, 500, 0.999**2 * 400, 0.999 * 400, 400, 9, 8], strict=True))
    assert smooth(1, 2, 3) == [1, 2, 3]


def test_overlay_and_symbols(spark):
    base = spark.createDataFrame([(1, 10), (2, 20)], "k long, v long")
    patch = spark.createDataFrame([(2, 21), (3, 30), (1, 5), (1, 6)], "k long, v long")
    assert rows(catalog.overlay(base, patch, "k", "v").fillna(-1), "k", "v", "state") == [(1, 10, "patched twice"), (2, 21, "patched"), (3, -1, "no target")]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("dir/", b"")
        z.writestr("u2.rom", b"\x00\x05\x0d\x00\x07\x00")
    images = archives.load_images(spark, str(tmp_path))
    assert [(r.file_no, r.name, r.size) for r in images.collect()] == [(0, "u2.rom", 6)]
    steps = archives.explode_programs(images.withColumn("id", F.lit(7)), "id", "content")
    assert rows(steps, "id", "offset", "wait", "opcode") == [(7, 0, 5, 13), (7, 3, 7, 0)]


def test_write_extracts(spark, tmp_path):
    df = spark.createDataFrame([("x.raw", 0x93, bytearray(b"abc")), ("y.raw", 0x94, bytearray(b""))], "name string, version int, payload binary").repartition(2, "name")
    archives.write_extracts(df, str(tmp_path / "out"))
    found = {f.name: f for f in (tmp_path / "out").rglob("*") if f.is_file()}
    raw = found["x.raw"].read_bytes()
    assert raw[:4] == b"DCSa" and struct.unpack(">HHH", raw[4:10]) == (0x93, 1, 0x7A12) and raw[-3:] == b"abc" and len(raw) == 39
    assert set(found) == {"x.raw", "y.raw"} and not any(p.name.startswith("_") for p in (tmp_path / "out").iterdir())
    archives.write_extracts(df, f"file://{tmp_path}/wav", "wav")
    assert next((tmp_path / "wav").rglob("x.raw")).read_bytes()[:4] == b"RIFF"


def test_failed_extracts_leave_no_file(spark, tmp_path):
    """One task fails after others have written: nothing is visible, and the folder that was there stays as it was."""
    good = [(f"f{k}.raw", 0x94, bytearray(b"x" * k)) for k in range(40)]
    schema = "name string, version int, payload binary"
    archives.write_extracts(spark.createDataFrame(good[:3], schema), str(tmp_path / "out"))
    before = sorted(p for p in (tmp_path / "out").rglob("*"))
    bad = spark.createDataFrame([*good, ("broken.raw", 0x94, None)], schema).repartition(4, "name")
    with pytest.raises(Exception, match="payload"):
        archives.write_extracts(bad, str(tmp_path / "out"))
    assert sorted(p for p in (tmp_path / "out").rglob("*")) == before


def test_catalog_is_replaced_by_set(spark, tmp_path):
    path = str(tmp_path / "catalog")
    images = lambda *x: spark.createDataFrame(x, "set_id string, slot int, size long, checksum long")
    catalog.save_catalog(images(("a", 0, 8192, 0), ("a", 1, 4096, 7), ("b", 0, 4096, 0), ("c", 1, 4096, 3)), path)
    for _ in range(2):  # again changes nothing
        catalog.save_catalog(images(("b", 0, 12288, 1), ("b", 1, 4096, 2), ("b", 3, 4096, 9)), path)
        assert rows(catalog.read_catalog(spark, path), "set_id", "slot", "size_4k", "chip_code", "checksum") == [("a", 0, 2, 0, 0), ("a", 1, 1, 256, 7), ("b", 0, 3, 0, 1), ("b", 1, 1, 256, 2)]
    assert spark.read.parquet(path).count() == 27


def test_version_texts(spark):
    df = spark.createDataFrame([(1, 1995, "1995", 0x104), (2, 1995, "1995", None), (3, 1993, "1993a", None), (4, 1993, "1994", None), (5, None, None, None), (6, 1995, "1995", 0x210)], "doc_id int, hardware int, version string, nominal long")
    got = {r.doc_id: (r.number, r.info) for r in layout.version_info(df, {1993: "old", 1995: "new"}).collect()}
    assert got == {1: (0x104, "new, Software 1.04 (1997)"), 2: (0, "new, Software 1.02 (1995)"), 3: (0x100, "old, Software 1.0a (1993)"), 4: (0x101, "old, Software 1.01 (1993)"), 5: (0, "Hardware type not detected, Not detected"), 6: (0x210, "new, Software 2.16 (1995+)")}


def test_program_rows_in_sql(spark):
    archives.register_program_rows(spark)
    got = spark.sql("SELECT p.opcode, p.operands FROM VALUES (X'0001010102030405000100') t(d), LATERAL program_rows(t.d) p").collect()
    assert [(r.opcode, r.operands) for r in got] == [(1, "0102030405"), (0, "")]


def test_search_path_meets_by_equality(spark, capsys):
    """Prefixes need not be folders, names may hold folders; files and prefixes are not multiplied."""
    files = spark.createDataFrame([(1, "a.txt"), (2, "sub/b.txt"), (3, "gone"), (4, None), (5, "a.txt")], "file_id int, name string")
    prefixes = spark.createDataFrame([(3, ""), (1, "x/"), (2, "x/pre-"), (4, None)], "priority int, prefix string")
    existing = spark.createDataFrame([("x/pre-a.txt",), ("a.txt",), ("x/sub/b.txt",), ("sub/b.txt",), (None,)], "path string")
    found = catalog.search_path(files, prefixes, existing)
    assert rows(found, "file_id", "path", "exists") == [(1, "x/pre-a.txt", True), (2, "x/sub/b.txt", True), (3, "gone", False), (4, None, False), (5, "x/pre-a.txt", True)]
    found.explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[-1]
    # the one product left is with a single row, the lengths of the prefixes
    assert plan.count("NestedLoopJoin") + plan.count("CartesianProduct") == 1 and "collect_set" in plan
    assert catalog.search_path(files, prefixes.limit(0), existing).where("exists").count() == 0


def test_list_images_reads_every_document(spark, data):
    """One row per document as a member file, with the size and digest of its text."""
    from cuebase import registry

    v = Views(spark, data)
    got = registry.queries()["a1_list_images"](spark, data).select(F.regexp_extract("name", "_(.*)[.]rom$", 1).alias("id"), "size", "sha256")
    want = v.documents.select(F.col("doc_id").cast("string").alias("id"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    assert rows(got, "id", "size", "sha256") == rows(want, "id", "size", "sha256")


def test_members_of_one_archive_are_many_tasks(spark, tmp_path, monkeypatch):
    """Stored and deflated members, names beyond ASCII, an empty one and a folder; members of one archive are read by several tasks; a damaged one is an error."""
    monkeypatch.setattr(archives, "MEMBER_BYTES", 3000)
    want = {}
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        z.writestr("folder/", b"")
        for k in range(30):
            data = bytes([k, k + 1, 255 - k]) * (k * 37)
            z.writestr(f"folder/é{k}.rom", data, zipfile.ZIP_STORED if k % 2 else zipfile.ZIP_DEFLATED)
            want[k] = (f"folder/é{k}.rom", len(data), data)
    images = archives.load_images(spark, f"file://{tmp_path}")
    assert {r.file_no: (r.name, r.size, bytes(r.content)) for r in images.collect()} == want
    assert images.rdd.getNumPartitions() > 1 and images.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    raw = bytearray((tmp_path / "big.zip").read_bytes())
    raw[raw.find(want[29][2][:50]) + 10] ^= 1
    (tmp_path / "big.zip").write_bytes(bytes(raw))
    with pytest.raises(Exception, match="damaged"):
        archives.load_images(spark, str(tmp_path)).collect()


def test_write_sets_in_bounded_groups(spark, tmp_path):
    df = spark.createDataFrame([(k, "x" * 10) for k in range(7)] + [(None, None), (8, "y" * 100)], "id long, data string").coalesce(1)
    done = archives.write_sets(df, f"file://{tmp_path}/sets", most_files=3, most_bytes=50).collect()
    assert sorted(r.files for r in done) == [1, 2, 3, 3]
    images = archives.load_images(spark, f"{tmp_path}/sets").collect()
    assert len({r.set_id for r in images}) == 4 and sorted(r.size for r in images) == [0] + [10] * 7 + [100]


def test_builds_stay_bounded(spark):
    """More parts make more builds, not larger ones, and none runs out of room."""
    from cuebase import registry

    packed = registry.queries()["h5_pack_best_fit"](spark, "/root/testdata/sf0.1")
    sizes = packed.groupBy("build").agg(F.count("*").alias("n"), F.count("problem").alias("left")).agg(F.max("n").alias("n"), F.sum("left").alias("left"), F.sum("n").alias("all")).first()
    assert sizes.n < 100 and sizes.left == 0 and sizes["all"] == spark.read.parquet("/root/testdata/sf0.1/part.parquet").count()


def test_schedule_over_many_groups(spark):
    times = [(t, t * 7 % 11) for t in range(-20, 150, 3)]
    got = {r.track_no: r.start for r in programs.schedule(spark.createDataFrame(times, "track_no long, time long"), width=4).collect()}
    now = 0
    for t, time in times:
        assert got.pop(t) == now
        now += time + 1
    assert not got


def test_list_images_hold_every_document(spark, data):
    """Archives are cut by partition, so names of sets are not fixed; their members are the documents."""
    got = registry.queries()["a1_list_images"](spark, data).collect()
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")).collect()
    assert sorted((r.name.split("_")[1], r.size, r.sha256) for r in got) == sorted((f"{r.doc_id}.rom", r.n, r.digest) for r in texts)
    sets = {}
    for r in got:
        sets.setdefault(r.set, []).append(r.file_no)
    assert all(sorted(x) == list(range(len(x))) for x in sets.values())


def tone_level(rows, freq: float) -> float:
    """Amplitude of a frequency in samples, by projection."""
    import numpy as np

    x = np.array([r.x for r in rows])
    return 2 * abs(np.mean(x * np.exp(-2j * np.pi * freq * np.arange(len(x)))))


def test_kernel_is_stretched_to_the_lower_rate(spark):
    """Down by 4: a tone above the new Nyquist rate goes, one below stays; up by 3/2: both stay."""
    import math

    for freq, down in ((0.4, 0.0), (0.04, 1.0)):
        df = spark.createDataFrame([(1, k, int(round(10_000 * math.sin(2 * math.pi * freq * k)))) for k in range(800)], "series long, idx long, pcm int")
        low = [r for r in signal.bandlimited_resample(df, 1, 4, half_width=12, steps=64).orderBy("idx").collect()][20:180]
        assert abs(tone_level(low, freq * 4) / 10_000 - down) < 0.01
        up = [r for r in signal.bandlimited_resample(df, 3, 2, half_width=12, steps=64).orderBy("idx").collect()][60:1140]
        assert abs(tone_level(up, freq * 2 / 3) / 10_000 - 1) < 0.01


def test_published_quality_of_converters(spark):
    """The fastest band-limited converter and the hold reach every published figure and peak."""
    from cuebase.operators import quality

    got = quality.golden_figures(spark, ["hold", "sinc_fastest"], length=1 << 13).collect()
    assert len(got) == 17 and {r.verdict for r in got} == {"pass"}
    for name in ("hold", "sinc_fastest"):
        own = [r for r in got if r.converter == name]
        assert {r.worst for r in own} == {min(r.figure for r in own)}


def test_spectra_of_streams_are_apart(spark):
    """Equal frame numbers of two streams do not meet."""
    a, c = [0, 5, 0, 9, 0], [100] * 5
    spec = spark.createDataFrame([("a", 0, k, x) for k, x in enumerate(a)] + [("b", 0, k, x) for k, x in enumerate(c)], "stream string, frame_no int, k int, x int")
    assert rows(spectrum.local_peaks(spec), "stream", "k") == [("a", 1), ("a", 3)]
    assert {(r.stream, r.k): r.db for r in spectrum.log_spectrum(spec).collect()}["a", 3] == 0.0
    assert rows(spectrum.snr(spec, expected=2), "stream", "snr") == [("a", 0.0), ("b", -1.0)]
    assert rows(signal.downmix(spec.withColumnsRenamed({"k": "bin", "x": "q"})), "stream", "idx", "x")[:2] == [("a", 0, 2.5), ("a", 1, 4.5)]


def test_programs_of_three_versions():
    """One byte string is three listings: code 4 takes three bytes in the oldest version, code 6 none in both old ones."""
    raw = bytes.fromhex("000104AA" "000206" "0100" "000007" "0203" "FFFF" "1011")
    steps = {v: [(r[1], r[2], r[3], r[4]) for r in archives.program_rows(raw, v)] for v in ("1993a", "1993b", "1995")}
    assert steps["1995"] == [(0, 1, 4, "AA"), (4, 2, 6, "0100"), (9, 0, 7, "0203"), (14, 0xFFFF, 0x10, "")][:3]
    assert steps["1993b"] == [(0, 1, 4, "AA"), (4, 2, 6, ""), (7, 0x0100, 0, "")]
    assert steps["1993a"] == [(0, 1, 4, "AA0002"), (6, 0x0601, 0, "")]
    assert [r[3] for r in archives.program_rows(bytes.fromhex("000110010200011201020304000113000100"), "1994")] == [0x10, 0x12, 0x13]


def test_slots_go_by_signature(spark):
    files = [("a", 1, "s35", "S5 sound 01/02/93"), ("a", 2, "u3.rom", "U-3 snd 11/12/94"), ("a", 3, "x3", "S3 again 11/12/94"), ("a", 4, "y4", "no signature"), ("a", 5, "z6_5", "S5 more 01/02/93")]
    files += [("cc_13", 1, "cc67", "S6 a 01/02/98"), ("cc_13", 2, "cc76", "S6 b 01/02/98"), ("other", 1, "cc7", "S6 b 01/02/98"), ("other", 2, None, "S3 01/02/98")]
    df = spark.createDataFrame(files, "set_id string, file_no long, name string, signature string")
    got = rows(layout.assign_slots(df), "set_id", "slot", "name")
    assert got == [("a", 3, "u3.rom"), ("a", 5, "s35"), ("cc_13", 6, "cc67"), ("cc_13", 7, "cc76")]
    assert layout.assign_slots(df.limit(0)).count() == 0


def test_headers_are_checked(spark):
    head = lambda version, channels, rate, size: (struct.pack(">4sHHH22xI", b"DCSa", version, channels, rate, size) + b"xy").hex().upper()
    files = [(1, head(0x93, 1, 0x7A12, 2)), (2, head(0x95, 1, 0x7A12, 2)), (3, head(0x94, 2, 0x7A12, 2)), (4, head(0x94, 1, 0x7A13, 2)), (5, head(0x94, 1, 0x7A12, 70000)), (6, "44435361"), (7, None)]
    got = layout.scan_container_headers(spark.createDataFrame(files, "doc_id int, h string"), b"DCSa".hex())
    assert rows(got, "doc_id", "version", "data_size") == [(1, 0x93, 2), (5, 0x94, 70000)]


def test_programs_end_at_endless_waits_and_unknown_codes(spark):
    ops = [(1, 0, 13, 1), (1, 1, 13, 65535), (1, 2, 13, 1), (2, 0, 13, 1), (2, 1, 19, 1), (2, 2, 0, 1), (3, 0, 18, 1), (3, 1, 0, 1), (3, 2, 13, 1)]
    df = spark.createDataFrame(ops, "track_no long, seq long, opcode int, wait int")
    assert rows(programs.live_steps(df), "track_no", "seq") == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1)]


def test_primary_by_name(spark):
    files = spark.createDataFrame([("a", 1, "main.rom", "xx"), ("a", 2, "u2.rom", "JU.."), ("b", 1, "u3", "JU"), ("c", 1, "MAIN.ROM", None)], "set_id string, file_no int, name string, head string")
    got = layout.pick_primary(files, "JU", named="Main.rom")
    assert rows(got.fillna(-1), "set_id", "file_no") == [("a", 1), ("b", -1), ("c", 1)]


def test_timeline_of_nested_loops_and_ends(spark):
    """Against a walk through the program: nested counts, loops that are never closed, ends inside loops, stray ends, zero waits."""
    import random

    def walk(steps, horizon):
        out, stack, now, i = [], [], 0, 0
        while i < len(steps):
            seq, op, wait, n = steps[i]
            now += wait
            if now > horizon:
                break
            out.append((now, seq))
            if op == 0:
                break
            if op == 14:
                stack.append([i, n, now])
            elif op == 15 and stack:
                start, left, since = stack[-1]
                if left == 1:
                    stack.pop()
                elif left == 0 and now == since:
                    break
                else:
                    stack[-1][1:] = max(left - 1, 0), now
                    i = start
            i += 1
        return out

    rnd, ops = random.Random(3), []
    for track in range(120):
        for seq in range(rnd.randint(1, 14)):
            op = rnd.choice([14, 14, 15, 15, 13, 1, 0 if rnd.random() < 0.3 else 13])
            ops.append((track, seq, op, rnd.choice([0, 0, 1, 2, 7]), rnd.choice([0, 1, 2, 3]) if rnd.random() < 0.9 else 200))
    df = spark.createDataFrame(ops, "track_no long, seq long, opcode int, wait int, repeat_n int")
    want = sorted((t, at, seq) for t in range(120) for at, seq in walk([(s, o, w, n) for tr, s, o, w, n in ops if tr == t], 60))
    assert rows(programs.timeline(df, 60), "track_no", "frame", "seq") == want and len(want) > 1500
    plan = programs.timeline(df, 60)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


STORES = "track_no long, seq long, opcode int, channel int, addr long, wait int, level int, var_id long, repeat_n int"


def test_variables_keep_all_their_digits(spark):
    """b3: a variable above 255 is written with all its hex digits, one below 16 with two."""
    df = spark.createDataFrame([(1, k, 6, 0, 0, 0, 7, var, 0) for k, var in enumerate([5, 255, 0x19C, 0x12345])], STORES)
    track = spark.createDataFrame([(1, 0)], "track_no long, channel int")
    assert [r.text for r in catalog.mnemonic(df, track).orderBy("seq").collect()] == [f"SetVariable(var ${x}, value $07);" for x in ("05", "FF", "19C", "12345")]


def test_program_text_keeps_digits_of_variables(spark):
    """d7: the text of a program holds variables as the mnemonics do."""
    df = spark.createDataFrame([(1, 0, 6, 0, 0, 3, 7, 0x373, 0), (1, 1, 0, 0, 0, 0, 0, 1, 0)], STORES)
    track = spark.createDataFrame([(1, 0)], "track_no long, channel int")
    assert rows(catalog.program_text(df, track), "program") == [("Wait(3) SetVariable(var $373, value $07);\nEnd;",)]


def test_report_counts_changed_replies_only(spark, tmp_path):
    """d17: a frame counts for an event whose number is a multiple of 37 and not of 1000003; one that is a multiple of the latter alone does not."""
    events = [(k, k % 2, "view") for k in (37, 40, 1000003, 1000004, 1000003 * 37)] + [(74, None, "click")]
    df = spark.createDataFrame(events, "event_id long, user_id long, event_type string")
    df.select("event_id", F.timestamp_seconds("event_id").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit("").alias("props")).write.parquet(str(tmp_path / "events.parquet"))
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = registry.queries()["d17_validation_report"](spark, str(tmp_path))
    assert rows(got, "samples", "bad_reply_frames", "verdict") == [(6, 2, "fail")]
    assert [tuple(r) for r in got.collect()] == c.sql(registry.oracles()["d17_validation_report"]).select(*got.columns).fetchall()


def sorts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Sort [")


def test_gaps_are_bridged_in_one_order(spark):
    """e10: one sort serves all windows and no join follows; unknown rows part runs and are left out."""
    hits = [True, False, False, True, False, False, False, True, None, False, True, False]
    df = spark.createDataFrame([(1, k, h) for k, h in enumerate(hits)] + [(None, 0, True)], "series long, pos long, hit boolean")
    got = layout.bridged_gaps(df, 2)
    assert sorts(got) == 1
    assert rows(got, "pos", "hit", "bridged") == [(k, h or k in (1, 2), k in (1, 2)) for k, h in enumerate(hits) if h is not None]


def test_levels_in_one_order(spark):
    """e2: one sort serves all windows; steps before the first set count from the default level."""
    ops = [(8, 5), (1, 0), (7, 50), (9, 8), (1, 0), (10, 3), (1, 0)]
    df = spark.createDataFrame([(1, k, 0, op, level) for k, (op, level) in enumerate(ops)], "track_no long, seq long, channel int, opcode int, level int")
    got = programs.running_level(df)
    assert sorts(got) == 1
    assert rows(got, "seq", "level") == [(1, 105), (4, 42), (6, 3)]


def test_bytes_are_not_spread_out():
    """d2, d3, a6: the bytes of a batch are a view of it, so that Python holds them once."""
    import numpy as np
    import pyarrow as pa

    raw, at = layout.bytes_of(pa.array([b"abc", None, b"", b"de"], pa.binary()))
    assert raw.dtype == np.uint8 and bytes(raw) == b"abcde" and at.tolist() == [0, 3, 3, 3, 5]


def test_long_indexes_are_cut(spark):
    """a6: an index longer than a slice, its empty slots and its unfinished last one."""
    data = b"\x01\x02\x03\xff\x00\x00" * 200_000 + b"\x01\x02"
    df = spark.createDataFrame([(1, data.hex().upper()), (2, None), (3, "0A0B0C0D")], "doc_id long, h string")
    got = layout.read_track_index(df)
    assert rows(got.where("doc_id = 3"), "doc_id", "slot", "addr") == [(3, 0, 0x0A0B0C)]
    own = got.where("doc_id = 1").agg(F.count("*"), F.min("slot"), F.max("slot"), F.sum("slot"), F.min("addr"), F.max("addr")).first()
    assert tuple(own) == (200_000, 0, 399_998, 199_999 * 200_000, 0x010203, 0x010203)
    assert rows(layout.byte_checksum(df), "doc_id", "checksum") == [(1, (sum(data[::2]) % 256) * 256 + sum(data[1::2]) % 256), (2, 0), (3, (0x0A + 0x0C) * 256 + 0x0B + 0x0D)]


def test_program_bytes_by_translate(spark, tmp_path):
    """k2, a5: every byte modulo 20, zeros kept, in one translation instead of a lambda for each byte."""
    from cuebase.plans import ports

    texts = ["".join(map(chr, range(256))), "\x00\x14(", "äß€𝄞", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = ports.programs(Views(spark, str(tmp_path)))
    assert {r.id: bytes(r.data) for r in got.collect()} == {k: bytes(x % 20 for x in t.encode()) for k, t in enumerate(texts)}
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()


def test_program_text_without_writable_steps(spark):
    """d7, as its SQL: a program none of whose steps can be written is null, not empty; a step that cannot be is left out; steps of no track are in no program."""
    df = spark.createDataFrame([(1, 0, 2, None, 0, 3, 7, 1, 0), (2, 0, 2, None, 0, 3, 7, 1, 0), (2, 1, 0, 0, 0, 0, 0, 1, 0), (None, 0, 0, 0, 0, 0, 0, 1, 0)], STORES)
    track = spark.createDataFrame([(1, 0), (2, 0)], "track_no long, channel int")
    assert [(r.track_no, r.program) for r in catalog.program_text(df, track).orderBy("track_no").collect()] == [(1, None), (2, "End;")]


def test_extracts_are_read_by_folder(spark, tmp_path, data, monkeypatch):
    """a7: as many tasks read the files as wrote them, however many files there are; all are read whole, staged ones are not."""
    from cuebase import registry

    monkeypatch.setattr(archives, "EXTRACT_FILES", 7)
    df = spark.createDataFrame([(f"f{k}.raw", 0x94, bytearray(b"x" * k)) for k in range(40)], "name string, version int, payload binary").repartition(2, "name")
    assert registry.queries()["a7_write_extracts"](spark, data).rdd.getNumPartitions() <= Views(spark, data).documents.rdd.getNumPartitions()
    archives.write_extracts(df.limit(0), str(tmp_path))
    assert archives.read_extracts(spark, str(tmp_path)).count() == 0
    archives.write_extracts(df, str(tmp_path))
    (tmp_path / "_staged-1").mkdir()
    (tmp_path / "_staged-1" / "g.raw").write_bytes(b"part")
    got = archives.read_extracts(spark, str(tmp_path))
    assert sorted((r.name, r.size, len(r.content), bytes(r.content)[36:]) for r in got.collect()) == sorted((f"f{k}.raw", 36 + k, 36 + k, b"x" * k) for k in range(40))
    assert got.rdd.getNumPartitions() == 2


@pytest.mark.parametrize("name", ["d2_byte_checksum", "d3_balance_bytes"])
def test_checksums_of_odd_blobs(spark, tmp_path, name):
    """d2, d3, as their SQL: no row for a text without a byte, one row for all texts of an id, also of none."""
    import duckdb

    texts = [(1, "abc"), (2, ""), (3, None), (4, "x"), (4, "äß€"), (4, ""), (5, ""), (5, None), (6, "\x00"), (None, "ab"), (None, "abc"), (7, "z" * 70_000)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = c.sql(registry.oracles()[name])
    ours = registry.queries()[name](spark, str(tmp_path))
    plain = lambda found: sorted(found, key=str)
    assert plain(tuple(r) for r in ours.select(theirs.columns).collect()) == plain(theirs.fetchall())
