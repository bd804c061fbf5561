"""Ordered operators over program steps: levels, nesting, waits, durations, schedules, fades, timers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuebase.operators.catalog import END, LOOP, LOOP_END, PLAY

#: Default channel level, longest wait of one step, limit of a level, the wait that never ends.
DEFAULT_LEVEL, LONGEST_WAIT, LEVEL_LIMIT, ENDLESS_WAIT = 100, 65534, 8191, 65535
#: Fixed value: the last code that exists.
LAST_CODE = 0x12


def steps(*extra: str):
    return Window.partitionBy("track_no", *extra).orderBy("seq")


def upto(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def first_seen(instr: DataFrame) -> DataFrame:
    """Streams numbered within the track that plays them first."""
    first = instr.where(F.col("opcode") == PLAY).groupBy("addr").agg(F.min(F.struct("track_no", "seq")).alias("at"))
    rows = first.select("addr", "at.track_no", "at.seq")
    return rows.withColumn("number", F.row_number().over(Window.partitionBy("track_no").orderBy("seq")).cast("bigint"))


def running_level(instr: DataFrame, strict: bool = False) -> DataFrame:
    """Mixing level of the channel at each play step; strict reads opcode 12 as the reference does: as nothing."""
    op = F.col("opcode")
    is_set = op.isin(7, 10).cast("int")
    down = op.isin(9) if strict else op.isin(9, 12)
    delta = F.when(op.isin(8, 11), F.col("level")).when(down, -F.col("level")).otherwise(0)
    # one ordered series for each channel: what the sums since the last set need is kept at it, so nothing is sorted again
    w = upto(steps("channel"))
    rows = instr.select("track_no", "seq", "channel", "opcode", "level", delta.alias("delta")).withColumn("total", F.sum("delta").over(w))
    base = F.last(F.when(is_set == 1, F.struct((F.col("level") - F.col("total")).alias("v"))), ignorenulls=True).over(w)
    rows = rows.withColumn("base", base).withColumn("now", (F.col("total") + F.when(F.col("base").isNull(), DEFAULT_LEVEL).otherwise(F.col("base.v"))).cast("bigint"))
    return rows.where(op == PLAY).select("track_no", "seq", "channel", F.col("now").alias("level"))


def with_depth(instr: DataFrame) -> DataFrame:
    """Add depth: how many loops are open at each step; ends without a loop change nothing."""
    delta = F.when(F.col("opcode") == LOOP, 1).when(F.col("opcode") == LOOP_END, -1).otherwise(0)
    w = steps()
    rows = instr.withColumn("total", F.sum(delta).over(upto(w)))
    rows = rows.withColumn("after", F.col("total") - F.least(F.lit(0), F.min("total").over(upto(w))))
    return rows.withColumn("depth", F.coalesce(F.lag("after").over(w), F.lit(0)).cast("int")).drop("total", "after")


def nesting(instr: DataFrame) -> DataFrame:
    """Loop depth at each step, and the step that opened the loop around it; ends without a loop change nothing."""
    rows = with_depth(instr.select("track_no", "seq", "opcode"))
    opened = rows.where(F.col("opcode") == LOOP).select("track_no", "seq", (F.col("depth") + 1).alias("key"), F.col("seq").alias("opener"))
    asked = rows.select("track_no", "seq", F.col("depth").alias("key"), F.lit(None).cast("bigint").alias("opener"), F.col("depth"), F.lit(True).alias("asks"))
    both = asked.unionByName(opened.withColumn("depth", F.lit(None).cast("int")).withColumn("asks", F.lit(False)))
    last = F.last("opener", ignorenulls=True).over(before(Window.partitionBy("track_no", "key").orderBy("seq")))
    return both.withColumn("parent", F.when(F.col("key") > 0, last)).where("asks").select("track_no", "seq", "depth", "parent")


def live_steps(instr: DataFrame) -> DataFrame:
    """Steps up to the first that ends the program, that one included: an end, an endless wait, or a code that does not exist."""
    last = (F.col("opcode") == END) | (F.col("wait") == ENDLESS_WAIT) | ~F.col("opcode").between(0, LAST_CODE)
    ended = F.coalesce(F.sum(last.cast("int")).over(before(steps())), F.lit(0))
    return instr.withColumn("ended", ended).where("ended = 0").select("track_no", "seq", "opcode")


def unmatched_ends(instr: DataFrame) -> DataFrame:
    return nesting(instr).join(instr.select("track_no", "seq", "opcode"), ["track_no", "seq"]).where((F.col("opcode") == LOOP_END) & (F.col("depth") == 0)).select("track_no", "seq")


def schedule(times: DataFrame, width: int = 4096) -> DataFrame:
    """times (track_no, time): start frame of each track, after all before it plus a frame each.

    The running sum has three levels: the tracks of a block, the blocks of a group, and the groups.  Only the last is
    one task's, with a row for each width * width track numbers.
    """
    def earlier(col, w):
        return F.coalesce(F.sum(col).over(before(w)), F.lit(0))

    rows = times.withColumn("block", F.expr(f"track_no div {width}"))
    blocks = rows.groupBy("block").agg(F.sum(F.col("time") + 1).alias("n")).withColumn("group", F.expr(f"block div {width}"))
    groups = blocks.groupBy("group").agg(F.sum("n").alias("n")).select("group", earlier("n", Window.orderBy("group")).alias("top"))
    base = blocks.withColumn("base", earlier("n", Window.partitionBy("group").orderBy("block"))).join(groups, "group").select("block", (F.col("base") + F.col("top")).alias("base"))
    inside = earlier(F.col("time") + 1, Window.partitionBy("block").orderBy("track_no"))
    return rows.withColumn("inside", inside).join(base, "block").select("track_no", "time", (F.col("base") + F.col("inside")).cast("bigint").alias("start"))


def stream_remaining(instr: DataFrame, stream: DataFrame) -> DataFrame:
    """Frames left of the track's last started stream at each step."""
    rows = instr.withColumn("plays", F.sum((F.col("opcode") == PLAY).cast("int")).over(upto(steps()))).where("plays > 0")
    w = steps("plays")
    rows = rows.withColumns({"playing": F.first("addr").over(upto(w)), "waited": F.sum("wait").over(upto(w)) - F.first("wait").over(upto(w))})
    joined = rows.join(stream.select(F.col("addr").alias("playing"), "n_frames"), "playing")
    return joined.select("track_no", "seq", F.greatest(F.lit(0), F.col("n_frames") - F.col("waited")).cast("bigint").alias("frames_left"))


def fold_waits(instr: DataFrame, idle: int = 13) -> DataFrame:
    """Waits of steps without effect go to the next step that has one; an endless wait stays where it is, and swallows what was before it."""
    endless = F.col("wait") == ENDLESS_WAIT
    acts = (F.col("opcode") != idle) | endless
    rows = instr.withColumn("group", F.coalesce(F.sum(acts.cast("int")).over(before(steps())), F.lit(0)))
    folded = F.when(endless, F.col("wait")).otherwise(F.sum("wait").over(upto(steps("group"))))
    return rows.withColumn("folded", folded.cast("bigint")).where(acts).select("track_no", "seq", "opcode", F.col("folded").alias("wait"))


def split_waits(waits: DataFrame) -> DataFrame:
    """waits (id, wait): long waits as several rows of at most LONGEST_WAIT."""
    parts = waits.withColumn("part", F.explode(F.expr(f"sequence(0, cast(greatest(wait - 1, 0) div {LONGEST_WAIT} as int))")))
    return parts.select("id", "part", F.least(F.lit(LONGEST_WAIT), F.col("wait") - F.col("part") * LONGEST_WAIT).cast("bigint").alias("wait"))


def unroll_stop_all(instr: DataFrame, channels: int = 8) -> DataFrame:
    """A stop step with repeat 0 means every other channel: one row for each."""
    rows = instr.where("opcode = 2 and repeat_n = 0").withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))
    return rows.where("target <> channel").select("track_no", "seq", "channel", "target")


def track_time(instr: DataFrame, stream: DataFrame | None = None) -> DataFrame:
    """Duration of each program, and whether it goes on for ever: waits times the counts of the loops around them.

    An endless loop counts once and ends the program.  So does an endless wait; it lasts as long as the endlessly repeated
    stream (addr, n_frames) that its own loop level played last, if any.
    """
    zero, op = F.lit(0).cast("bigint"), F.col("opcode")
    rows = instr.withColumn("held", zero)
    if stream is not None:
        rows = instr.join(stream.select("addr", F.col("n_frames").cast("bigint").alias("own")), "addr", "left")
        rows = rows.withColumn("held", F.when((op == PLAY) & (F.col("repeat_n") == 0), F.coalesce("own", zero)).otherwise(zero))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "opcode", "wait", "repeat_n", "held")))
    start = F.struct(
        zero.alias("total"), F.array().cast("array<bigint>").alias("stack"), F.lit(1).cast("bigint").alias("times"), F.lit(False).alias("done"),
        F.lit(False).alias("endless"), F.array(zero).alias("held"),
    )

    def step(a, s):
        top = F.element_at(a["stack"], -1)
        closes = (s["opcode"] == LOOP_END) & (F.size(a["stack"]) > 0)
        opens, waits = s["opcode"] == LOOP, s["wait"] == ENDLESS_WAIT
        count = F.greatest(s["repeat_n"], F.lit(1)).cast("bigint")
        last = F.element_at(a["held"], -1)
        up = F.slice(a["held"], F.lit(1), F.size(a["held"]) - 1)
        ended = closes & (F.when(closes, top) == 0)
        moved = F.struct(
            (a["total"] + F.when(waits, last).otherwise(s["wait"]) * a["times"]).alias("total"),
            F.when(opens & ~waits, F.concat(a["stack"], F.array(s["repeat_n"].cast("bigint")))).when(closes & ~waits, F.slice(a["stack"], F.lit(1), F.size(a["stack"]) - 1)).otherwise(a["stack"]).alias("stack"),
            F.when(opens, a["times"] * count).when(closes, (a["times"] / F.greatest(F.when(closes, top), F.lit(1))).cast("bigint")).otherwise(a["times"]).alias("times"),
            (waits | ended | (s["opcode"] == END)).alias("done"),
            (waits | ended).alias("endless"),
            F.when(opens, F.concat(a["held"], F.array(zero))).when(closes, up).when(s["opcode"] == PLAY, F.concat(up, F.array(s["held"]))).otherwise(a["held"]).alias("held"),
        )
        return F.when(a["done"], a).otherwise(moved)

    out = F.aggregate(ordered, start, step, lambda a: F.struct(a["total"].alias("frames"), (a["endless"] | F.array_contains(a["stack"], F.lit(0).cast("bigint"))).alias("looping")))
    return rows.groupBy("track_no").agg(out.alias("t")).select("track_no", "t.frames", "t.looping")


def first_pass(steps: Column, horizon: int) -> Column:
    """struct<at, loops> of a program's steps (array of seq, opcode, wait, repeat_n in order): the frame at which each step is first reached, and the closed loops.

    A loop (opener, closer, n, time of a pass) is closed when its end is reached; a step belongs to it after its opener up to its closer.
    Loops that are left before add nothing.  An end of the program or of an endless loop (n = 0) is the last step.  Times stop at
    horizon + 1, so nested counts cannot overflow.
    """
    zero = F.lit(0).cast("bigint")
    most = lambda x: F.least(x, F.lit(horizon + 1).cast("bigint"))
    start = F.struct(
        zero.alias("now"), F.lit(False).alias("done"), F.array().cast("array<struct<o:bigint,n:bigint,acc:bigint>>").alias("stack"),
        F.array().cast("array<struct<seq:bigint,opcode:int,first:bigint>>").alias("at"), F.array().cast("array<struct<o:bigint,c:bigint,n:bigint,pass:bigint>>").alias("loops"),
    )

    def step(a, s):
        now = most(a["now"] + s["wait"])
        held = F.size(a["stack"])
        up = F.slice(a["stack"], F.lit(1), F.greatest(held - 1, F.lit(0)))
        top = F.try_element_at(a["stack"], F.lit(-1))
        taken = most(top["acc"] + s["wait"])
        closes = (s["opcode"] == LOOP_END) & (held > 0)
        later = (F.greatest(top["n"], F.lit(1)) - 1) * taken  # the passes after the first
        own = F.when(held > 0, F.concat(up, F.array(F.struct(top["o"].alias("o"), top["n"].alias("n"), taken.alias("acc"))))).otherwise(a["stack"])
        outer = F.try_element_at(up, F.lit(-1))
        popped = F.when(held > 1, F.concat(F.slice(up, F.lit(1), F.greatest(held - 2, F.lit(0))), F.array(F.struct(outer["o"].alias("o"), outer["n"].alias("n"), most(outer["acc"] + taken + later).alias("acc"))))).otherwise(up)
        opened = F.concat(own, F.array(F.struct(s["seq"].cast("bigint").alias("o"), s["repeat_n"].cast("bigint").alias("n"), zero.alias("acc"))))
        loop = F.struct(top["o"].alias("o"), s["seq"].cast("bigint").alias("c"), top["n"].alias("n"), taken.alias("pass"))
        moved = F.struct(
            F.when(closes, most(now + later)).otherwise(now).alias("now"),
            ((s["opcode"] == END) | F.coalesce(closes & (top["n"] == 0), F.lit(False))).alias("done"),
            F.when(closes, popped).when(s["opcode"] == LOOP, opened).otherwise(own).alias("stack"),
            F.concat(a["at"], F.array(F.struct(s["seq"].cast("bigint").alias("seq"), s["opcode"].cast("int").alias("opcode"), now.alias("first")))).alias("at"),
            F.when(closes, F.concat(a["loops"], F.array(loop))).otherwise(a["loops"]).alias("loops"),
        )
        return F.when(a["done"] | (a["now"] > horizon), a).otherwise(moved)

    return F.aggregate(steps, start, step, lambda a: F.struct(a["at"].alias("at"), a["loops"].alias("loops")))


def timeline(instr: DataFrame, horizon: int = 2000) -> DataFrame:
    """Events at absolute frames with the loops played out, up to a horizon; a program is one row of steps.

    Loop algebra: a step in loops with passes of T1, T2, ... frames is reached at first + k1 T1 + k2 T2 + ..., each k below
    its loop's count; the numbers k come from sequences that end at the horizon.  An endless loop that takes no time
    never reaches another frame: its program ends after that pass.
    """
    steps_ = F.array_sort(F.collect_list(F.struct("seq", "opcode", "wait", "repeat_n")))
    whole = instr.groupBy("track_no").agg(steps_.alias("steps")).select("track_no", first_pass(F.col("steps"), horizon).alias("p"))
    rows = whole.select("track_no", F.explode("p.at").alias("s"), F.col("p.loops").alias("loops")).where(F.col("s.first") <= horizon)
    around = F.array_sort(F.filter("loops", lambda x: (x["o"] < F.col("s.seq")) & (F.col("s.seq") <= x["c"])))

    def play(times, loop):
        fits = lambda t: F.expr(f"{horizon}L") - t
        passes = lambda t: F.when(loop["pass"] == 0, F.greatest(loop["n"], F.lit(1)) - 1).when(loop["n"] == 0, F.floor(fits(t) / loop["pass"])).otherwise(F.least(loop["n"] - 1, F.floor(fits(t) / loop["pass"])))
        return F.flatten(F.transform(times, lambda t: F.transform(F.sequence(F.lit(0).cast("bigint"), passes(t)), lambda k: t + k * loop["pass"])))

    frames = F.aggregate(around, F.array(F.col("s.first")), play)
    return rows.select("track_no", F.explode(frames).alias("frame"), F.col("s.seq").alias("seq"), F.col("s.opcode").alias("opcode"))


def asof_deferred(events: DataFrame) -> DataFrame:
    """events (channel, ts, event_id, kind load or trigger): each trigger fires the latest load still pending.

    Loads replace each other and a trigger consumes, so a trigger fires just if the event before it is a load.
    """
    w = Window.partitionBy("channel").orderBy("ts", "event_id")
    rows = events.withColumns({"was": F.lag("kind").over(w), "load_id": F.lag("event_id").over(w)})
    return rows.where("kind = 'trigger' and was = 'load'").select("channel", F.col("event_id").alias("trigger_id"), "load_id")


def controller_changes(instr: DataFrame) -> DataFrame:
    """instr with stream_channel: play steps whose stream channel was last played from another channel of the same program."""
    plays = instr.where(F.col("opcode") == PLAY)
    rows = plays.withColumn("was", F.lag("channel").over(steps("stream_channel")))
    return rows.where(F.col("was").isNotNull() & (F.col("was") != F.col("channel"))).select("track_no", "seq", "stream_channel", "was", F.col("channel").alias("now"))


def channel_mix(instr: DataFrame) -> DataFrame:
    signed = F.when(F.col("opcode").isin(9, 12), -F.col("level")).otherwise(F.col("level")) * 64
    total = F.sum(signed)
    return instr.where(F.col("opcode").between(7, 12)).groupBy("track_no", "channel").agg(F.greatest(F.lit(-LEVEL_LIMIT), F.least(F.lit(LEVEL_LIMIT), total)).cast("bigint").alias("mix"))


def volume_shift(instr: DataFrame, volume: int = 0x7FFE) -> DataFrame:
    """Normalising shift 0..8 of each program: the free bits of the summed multiplier times volume of its play steps, less 3.

    Sums are 32 bits wide, with a sign: from 2 ** 31 on, leading ones count as free bits.  Silence is shifted by 8.
    """
    total = F.sum(F.col("level").cast("bigint") * 256 * volume)
    rows = instr.where(F.col("opcode") == PLAY).groupBy("track_no").agg(F.pmod(F.shiftright(total, 2), F.lit(1 << 32)).alias("total"))
    plain = F.when(F.col("total") >= 1 << 31, F.lit((1 << 32) - 1) - F.col("total")).otherwise(F.col("total"))
    width = F.when(plain == 0, 0).otherwise(F.length(F.bin(plain)))
    return rows.select("track_no", F.greatest(F.lit(0), F.least(F.lit(8), 28 - width)).cast("int").alias("shift"))


def clamped(level: Column) -> Column:
    return F.greatest(F.lit(-LEVEL_LIMIT), F.least(F.lit(LEVEL_LIMIT), level))


def signed_byte(x: Column) -> Column:
    return F.pmod(x.cast("bigint") + 128, F.lit(256)) - 128


def fade_ramp(instr: DataFrame) -> DataFrame:
    """Level at each frame of a fade from the default level; the last frame is the target.  The step is that of the target before it is limited."""
    rows = instr.where(F.col("opcode").between(10, 12) & (F.col("wait") > 0))
    start, change = F.lit(DEFAULT_LEVEL * 64).cast("bigint"), signed_byte(F.col("level")) * 64
    target = F.when(F.col("opcode") == 10, change).when(F.col("opcode") == 11, start + change).otherwise(start - change)
    rows = rows.withColumn("start", start).withColumn("target", target).withColumn("step", F.expr("(target - start) div wait"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("wait"))))
    level = F.when(F.col("k") == F.col("wait"), clamped(F.col("target"))).otherwise(clamped(F.col("start") + F.col("k") * F.col("step")))
    return rows.select("track_no", "seq", F.col("k").cast("bigint").alias("frame"), level.cast("bigint").alias("level"))


def level_after(start: int, step: int, steps: int, target: int, frames: int) -> int:
    """The level so many frames after a command."""
    return target if frames >= steps else max(-LEVEL_LIMIT, min(LEVEL_LIMIT, start + frames * step))


def _ramps(batches):
    """Commands by key and time: each with the level that it starts from, its step and its target.  Only the last command is held."""
    last = None
    for batch in batches:
        out = []
        for key, channel, frame, _, mode, param, steps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last is None or last[0] != (key, channel):
                start = 0
            else:
                start = level_after(*last[2:], frame - last[1])
            wanted = (param << 6) if mode == 0 else start + (param << 6) * (1 if mode == 1 else -1)
            step = int(abs(wanted - start) // steps) * (1 if wanted >= start else -1) if steps else 0
            target = max(-LEVEL_LIMIT, min(LEVEL_LIMIT, wanted))
            last = ((key, channel), frame, start, step, steps, target)
            out.append(last[2:])
        if out:
            kept = [batch.column(i) for i in range(4)]
            ramps = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(kept + ramps, [*batch.schema.names[:4], "start", "step", "steps", "target"])


def mixing_levels(commands: DataFrame) -> DataFrame:
    """commands (key, channel, frame, seq, mode, param, steps): the level from each frame on at which it changes.

    Mode 0 sets, 1 raises, 2 lowers by param (a signed byte) times 64; with steps it is a fade.  A command starts from the level
    that an unfinished fade has reached, and ends that fade.  Levels start at 0.  Commands without a key, frame, mode or param are
    left out, null steps are none; commands of one frame go by seq.  Keys are spread over tasks and read in order, one command at a time.
    """
    kinds = dict(commands.dtypes)
    known = commands.where("key is not null and channel is not null and frame is not null and mode between 0 and 2 and param is not null")
    ordered = known.select("key", "channel", F.col("frame").cast("bigint").alias("frame"), "seq", F.col("mode").cast("int").alias("mode"), signed_byte(F.col("param")).alias("param"), F.greatest(F.coalesce("steps", F.lit(0)), F.lit(0)).cast("bigint").alias("steps"))
    ordered = ordered.repartition("key", "channel").sortWithinPartitions("key", "channel", "frame", "seq")
    ramps = ordered.mapInArrow(_ramps, f"key {kinds['key']}, channel {kinds['channel']}, frame long, seq {kinds['seq']}, start long, step long, steps long, target long")
    following = F.lead("frame").over(Window.partitionBy("key", "channel").orderBy("frame", "seq"))
    lasting = F.least(F.col("steps"), F.coalesce(following - F.col("frame"), F.col("steps")))
    rows = ramps.withColumn("lasting", lasting).where("steps = 0 or lasting > 0")
    rows = rows.withColumn("k", F.explode(F.sequence(F.when(F.col("steps") == 0, 0).otherwise(1).cast("bigint"), F.col("lasting"))))
    level = F.when(F.col("k") >= F.col("steps"), F.col("target")).otherwise(clamped(F.col("start") + F.col("k") * F.col("step")))
    return rows.select("key", "channel", "seq", (F.col("frame") + F.col("k")).alias("frame"), level.alias("level"))


def periodic_events(timers: DataFrame, horizon: int) -> DataFrame:
    """timers (device, start, event_id, every): fire each `every` frames until the device's next timer, or the horizon."""
    w = Window.partitionBy("device").orderBy("start", "event_id")
    rows = timers.withColumn("end", F.least(F.coalesce(F.lead("start").over(w) - 1, F.lit(horizon)), F.lit(horizon)))
    rows = rows.where(F.col("start") + F.col("every") <= F.col("end"))
    return rows.select("device", "event_id", F.explode(F.expr("sequence(start + every, end, every)")).alias("frame"))
