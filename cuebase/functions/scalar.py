"""Column functions of the data model: addresses, time, text forms, fixed-point levels, samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds and samples of a frame, and the sentinel for "no end".
FRAME_MS, FRAME_SAMPLES, ENDLESS = 7.68, 240, 65535
SHIFT = {1993: 20, 1995: 21}


def b(x: float) -> Column:
    return F.lit(float(x))


def chip_of(addr: Column, hw: int = 1995) -> Column:
    return F.shiftright(addr, SHIFT[hw]).bitwiseAND(7).cast("int")


def offset_of(addr: Column, hw: int = 1995) -> Column:
    return addr.bitwiseAND((1 << SHIFT[hw]) - 1)


def encode_address(chip: Column, offset: Column, hw: int = 1995) -> Column:
    return offset.bitwiseOR(F.shiftleft((chip - 2).cast("bigint"), SHIFT[hw]))


def to_frames(x: Column, unit: str = "ms") -> Column:
    """Frames of a time in ms or sec, rounded to the nearest; frames pass through."""
    if unit == "frames":
        return x.cast("bigint")
    factor = {"ms": 1.0, "sec": 1000.0}[unit]
    return F.floor(x * b(factor) / b(FRAME_MS) + b(0.5))


def to_ms(frames: Column) -> Column:
    return frames.cast("double") * b(FRAME_MS)


def time_problem(x: Column) -> Column:
    return F.when(x < 0, "error").when(x == 0, "warning")


def mmss(frames: Column) -> Column:
    seconds = F.floor(to_ms(frames) / b(1000.0))
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def hex_of(x: Column, digits: int) -> Column:
    return F.lpad(F.hex(x.cast("bigint")), digits, "0")


def hex_whole(x: Column, least: int) -> Column:
    """All hex digits of a number, padded to `least`; hex_of() keeps the first ones only."""
    text = F.hex(x.cast("bigint"))
    return F.when(F.length(text) < least, F.lpad(text, least, "0")).otherwise(text)


def _fixed_power(start: int | Column, factor: int, bits: int, exponent: Column) -> Column:
    """Product in 1.15: the factor is squared bit by bit and multiplied in where the exponent's bit is clear."""
    state = F.struct((F.lit(start) if isinstance(start, int) else start).cast("bigint").alias("v"), F.lit(factor).cast("bigint").alias("f"))

    def step(a, i):
        bit = F.call_function("shiftright", exponent.cast("bigint"), i).bitwiseAND(1)
        v = F.when(bit == 0, F.shiftright(a["v"] * a["f"], 15)).otherwise(a["v"])
        return F.struct(v.alias("v"), F.shiftright(a["f"] * a["f"], 15).alias("f"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), state, step, lambda a: a["v"])


def volume_gain(volume: Column) -> Column:
    """1.15 gain of a volume 0..255; 0 is silence."""
    return F.when(volume == 0, F.lit(0).cast("bigint")).otherwise(_fixed_power(0x3FFF, 0x7D98, 8, volume) * 2)


def mix_attenuation(total: Column, volume: Column, oldest: bool = False) -> Column:
    """1.15 attenuation of a channel's summed level, from its own volume 0..255; the oldest version starts from full scale."""
    exponent = F.shiftright(total.cast("bigint"), 6).bitwiseAND(0x3FF) + 0x80
    start = F.lit(0x7FFF).cast("bigint") if oldest else F.shiftleft(volume.cast("bigint"), 7)
    return _fixed_power(start, 0x7C94, 8, exponent) * 2


def pcm_to_float(x: Column) -> Column:
    return x.cast("double") / b(32768.0)


def float_to_pcm(x: Column) -> Column:
    """Clip to 32 bits, then keep the high 16."""
    scaled = F.rint(F.greatest(b(-2147483648.0), F.least(b(2147483647.0), x * b(2147483648.0)))).cast("bigint")
    return F.shiftright(scaled, 16).cast("int")


def half_away(x: Column) -> Column:
    """Round to the nearest integer, halves away from zero."""
    return (F.signum(x) * F.floor(F.abs(x) + b(0.5))).cast("bigint")


def byte_at(hex_text: Column, at: Column | int) -> Column:
    """The byte at a 0-based position of a hex text."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(hex_text, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time as written, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def seconds(ts: Column) -> Column:
    return F.floor(micros(ts) / 1000000).cast("bigint")
