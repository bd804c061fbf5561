"""Sample series: resampling, frames, windows, spectra, channel layouts.

Ratios are whole numbers p/q, so output positions are exact.  Each input sample
makes the outputs that fall to it, so resampling needs no join between inputs and outputs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuebase.functions.scalar import b


def in_series():
    return Window.partitionBy("series").orderBy("idx")


def reverse_series(sample: DataFrame) -> DataFrame:
    top = F.max("idx").over(Window.partitionBy("series"))
    return sample.select("series", (top - F.col("idx")).alias("idx"), "pcm")


def _outputs(sample: DataFrame, p: int, q: int) -> DataFrame:
    """One row for each output k whose position k * q / p lies in [idx, idx + 1)."""
    first = F.expr(f"cast(ceil(idx * {p} / double({q})) as bigint)")
    last = F.expr(f"cast(ceil((idx + 1) * {p} / double({q})) as bigint) - 1")
    rows = sample.withColumn("idx", F.col("idx").cast("bigint")).withColumns({"first": first, "last": last}).where("first <= last")
    return rows.withColumn("k", F.explode(F.sequence("first", "last"))).withColumn("frac", (F.col("k") * q - F.col("idx") * p).cast("double") / b(p))


def hold_resample(sample: DataFrame, p: int, q: int) -> DataFrame:
    return _outputs(sample.select("series", "idx", "pcm"), p, q).select("series", F.col("k").alias("idx"), "pcm")


def linear_resample(sample: DataFrame, p: int, q: int, digits: int | None = 6) -> DataFrame:
    rows = sample.select("series", "idx", "pcm", F.coalesce(F.lead("pcm").over(in_series()), F.col("pcm")).alias("next"))
    x = F.col("pcm") + F.col("frac") * (F.col("next") - F.col("pcm"))
    return _outputs(rows, p, q).select("series", F.col("k").alias("idx"), (x if digits is None else F.round(x, digits)).alias("x"))


def cubic_resample(sample: DataFrame, p: int, q: int) -> DataFrame:
    """Four-point Hermite; beyond the ends the last sample holds."""
    w, x = in_series(), F.col("pcm").cast("double")
    near = lambda f, n, other: F.coalesce(f("pcm", n).over(w).cast("double"), other)
    one = near(F.lead, 1, x)
    rows = sample.select("series", "idx", x.alias("x0"), near(F.lag, 1, x).alias("xm"), one.alias("x1"), near(F.lead, 2, one).alias("x2"))
    rows = _outputs(rows, p, q)
    t, xm, x0, x1, x2 = (F.col(c) for c in ("frac", "xm", "x0", "x1", "x2"))
    c1 = (x1 - xm) * b(0.5)
    c2 = xm - x0 * b(2.5) + x1 * b(2.0) - x2 * b(0.5)
    c3 = (x2 - xm) * b(0.5) + (x0 - x1) * b(1.5)
    return rows.select("series", F.col("k").alias("idx"), F.round(((c3 * t + c2) * t + c1) * t + x0, 6).alias("x"))


def kernel_table(half_width: int, steps: int) -> list[float]:
    """Half a Hann-windowed sinc, steps entries a sample, with an end of 0."""
    out = []
    for i in range(half_width * steps + 2):
        d = i / steps
        sinc = 1.0 if d == 0 else math.sin(math.pi * d) / (math.pi * d)
        out.append(round(sinc * (0.5 + 0.5 * math.cos(math.pi * min(d / half_width, 1.0))), 12))
    return out


def bandlimited_resample(sample: DataFrame, p: int, q: int, half_width: int = 4, steps: int = 8, kernel: Callable[[Column], Column] | None = None, digits: int | None = 4) -> DataFrame:
    """Each input adds kernel(position - idx) * pcm to the outputs within the half width; the sums combine before the shuffle.

    To a lower rate (p < q) the kernel is stretched by q / p and scaled by p / q, so that its cutoff is that of the output and the
    gain stays 1.  kernel: a function of the distance (within the half width) in samples of the lower rate; by default a table of
    `steps` entries a sample, read by interpolation.
    """
    low = max(p, q)  # distances are counted in steps of 1 / low of a sample of the lower rate
    top = F.max(F.col("idx").cast("bigint")).over(Window.partitionBy("series"))
    rows = sample.select("series", F.col("idx").cast("bigint").alias("idx"), "pcm", top.alias("top"))
    reach = half_width * low
    first = F.expr(f"greatest(0L, cast(ceil((idx * {p} - {reach}) / double({q})) as bigint))")
    last = F.expr(f"least(cast(floor((idx * {p} + {reach}) / double({q})) as bigint), cast(floor(top * {p} / double({q})) as bigint))")
    rows = rows.withColumns({"first": first, "last": last}).where("first <= last").withColumn("k", F.explode(F.sequence("first", "last")))
    far = F.abs(F.col("k") * q - F.col("idx") * p).cast("double")
    if kernel is None:
        table = F.lit(kernel_table(half_width, steps))
        rows = rows.withColumn("at", far * b(steps) / b(low)).withColumn("cell", F.floor("at").cast("int"))
        lower, upper = F.element_at(table, F.col("cell") + 1), F.element_at(table, F.col("cell") + 2)
        weight = lower + (F.col("at") - F.col("cell")) * (upper - lower)
    else:
        weight = kernel(far / b(low))
    gain = b(min(p / q, 1.0))
    total = F.sum(weight * F.col("pcm")) * gain
    return rows.groupBy("series", F.col("k").alias("idx")).agg((total if digits is None else F.round(total, digits)).alias("x"))


def cosine_kernel(half_width: int, terms: list[float]) -> Callable[[Column], Column]:
    """A sinc under a sum of cosines (the window's coefficients, highest at distance 0), as an expression of the distance."""

    def at(d: Column) -> Column:
        turn = d * b(math.pi)
        window = b(terms[0])
        for k, a in enumerate(terms[1:], 1):
            window = window + b(a) * F.cos(turn * b(k / half_width))
        return F.when(d == 0, b(sum(terms))).otherwise(F.sin(turn) / turn * window) / b(sum(terms))

    return at


def timewarp_resample(sample: DataFrame, schedule: DataFrame) -> DataFrame:
    """schedule (series, from_idx, ratio in thousandths): the latest entry at or before a sample applies, 1000 before the first; output positions are running sums of ratios.

    Entries and samples of a series are one ordered run, so the latest entry is found without a range join.
    """
    entry = schedule.groupBy("series", F.col("from_idx").alias("idx")).agg(F.max("ratio").alias("ratio")).select("series", "idx", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("pcm"), F.col("ratio").cast("bigint").alias("ratio"))
    both = sample.select("series", "idx", F.lit(1).alias("kind"), F.col("pcm").cast("int").alias("pcm"), F.lit(None).cast("bigint").alias("ratio")).unionByName(entry)
    latest = F.last("ratio", ignorenulls=True).over(Window.partitionBy("series").orderBy("idx", "kind").rowsBetween(Window.unboundedPreceding, 0))
    sample, ratio = both.withColumn("ratio", F.coalesce(latest, F.lit(1000))).where("kind = 1"), F.col("ratio")
    w = in_series()
    rows = sample.select("series", "idx", "pcm", ratio.cast("bigint").alias("ratio"), F.coalesce(F.lead("pcm").over(w), F.col("pcm")).alias("next"))
    rows = rows.withColumn("start", F.coalesce(F.sum("ratio").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumns({"first": F.expr("(start + 999) div 1000"), "last": F.expr("(start + ratio + 999) div 1000 - 1")}).where("first <= last")
    rows = rows.withColumn("k", F.explode(F.sequence("first", "last")))
    frac = (F.col("k") * 1000 - F.col("start")).cast("double") / F.col("ratio").cast("double")
    return rows.select("series", F.col("k").alias("idx"), F.round(F.col("pcm") + frac * (F.col("next") - F.col("pcm")), 6).alias("x"))


def length_check(given: DataFrame, made: DataFrame, p: int, q: int, slack: int = 0) -> DataFrame:
    n = given.groupBy("series").agg(F.count("*").alias("n_in"))
    out = made.groupBy("series").agg(F.count("*").alias("n_out"))
    most = math.ceil(max(q / p, 1)) + slack
    return n.join(out, "series", "left").select("series", "n_in", F.coalesce("n_out", F.lit(0)).alias("n_out"), (F.abs(F.col("n_in") * p - F.coalesce("n_out", F.lit(0)) * q) <= most * q).alias("ok"))


def peak(sample: DataFrame) -> DataFrame:
    return sample.groupBy("series").agg(F.max(F.abs("pcm")).alias("peak"))


def quality_gate(measured: DataFrame, cases: DataFrame) -> DataFrame:
    """measured (converter, case, n, peak, figure) against cases (converter, case, want_n, want_peak, least): verdict of each, beside the converter's worst figure."""
    ok = (F.abs(F.col("n") - F.col("want_n")) <= 4) & (F.abs(F.col("peak") - F.col("want_peak")) <= b(0.01)) & (F.col("figure") >= F.col("least"))
    worst = F.min("figure").over(Window.partitionBy("converter"))
    judged = measured.join(cases, ["converter", "case"]).withColumn("worst", worst)
    return judged.select("converter", "case", F.when(ok, "pass").otherwise("fail").alias("verdict"), "figure", "worst")


def cut_frames(sample: DataFrame, size: int = 256, hop: int = 240) -> DataFrame:
    """Frames of `size` that start every `hop`; the first begins with zeros, the last ends with them."""
    lap = size - hop
    place = F.col("idx") + lap
    both = F.when((F.expr(f"(idx + {lap}) % {hop}") < lap) & (place >= hop), F.array(F.expr(f"(idx + {lap}) div {hop}"), F.expr(f"(idx + {lap}) div {hop} - 1"))).otherwise(F.array(F.expr(f"(idx + {lap}) div {hop}")))
    held = sample.select("series", place.alias("place"), "pcm", F.explode(both).alias("frame_no")).select("series", "frame_no", (F.col("place") - F.col("frame_no") * hop).cast("int").alias("pos"), "pcm")
    last = sample.groupBy("series").agg(F.max("idx").alias("top"))
    all_ = last.select("series", F.explode(F.expr(f"sequence(0L, top div {hop})")).alias("frame_no")).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return all_.join(held, ["series", "frame_no", "pos"], "left").select("series", "frame_no", "pos", F.coalesce("pcm", F.lit(0)).alias("pcm"))


def window_table(lap: int) -> Column:
    return F.lit([(2 * i + 1) * 32768 // (2 * lap) for i in range(lap)])


def taper(frames: DataFrame, size: int, lap: int) -> DataFrame:
    """First and last samples of a frame times a rising and falling ramp in 1.15."""
    w, pos = window_table(lap), F.col("pos")
    factor = F.when(pos < lap, F.element_at(w, pos + 1)).when(pos >= size - lap, F.element_at(w, F.lit(size) - pos)).otherwise(32768)
    return frames.select("series", "frame_no", "pos", (F.col("pcm") * factor).cast("bigint").alias("scaled"))


def crossfade(frames: DataFrame, size: int, lap: int) -> DataFrame:
    """Head of a frame faded in over the tail of the one before."""
    c, pos = window_table(lap), F.col("pos")
    hop = size - lap
    tail = frames.where(pos >= hop).select("series", (F.col("frame_no") + 1).alias("frame_no"), (pos - hop).alias("pos"), F.col("pcm").alias("before"))
    rows = frames.where(pos < hop).join(tail, ["series", "frame_no", "pos"], "left")
    faded = F.col("pcm") * F.element_at(c, F.least(pos, F.lit(lap - 1)) + 1) + F.coalesce("before", F.lit(0)) * F.element_at(c, F.greatest(F.lit(lap) - pos, F.lit(1)))
    return rows.select("series", "frame_no", "pos", F.when(pos < lap, faded).otherwise(F.col("pcm") * 32768).cast("bigint").alias("scaled"))


def spectrum(frames: DataFrame, size: int = 16) -> DataFrame:
    """Cosine and sine sums of each frame, as a join with a scaled whole-number basis."""
    basis = [(k, n, round(32768 * math.cos(2 * math.pi * k * n / size)), round(32768 * math.sin(2 * math.pi * k * n / size))) for k in range(size // 2 + 1) for n in range(size)]
    table = F.broadcast(frames.sparkSession.createDataFrame(basis, "k int, pos int, c int, s int"))
    rows = frames.join(table, "pos")
    return rows.groupBy("series", "frame_no", "k").agg(F.sum(F.col("pcm").cast("bigint") * F.col("c")).alias("re"), F.sum(F.col("pcm").cast("bigint") * F.col("s")).alias("im"))


def _rfft(batches):
    """Frames of a batch that are equally long are transformed as one table."""
    for batch in batches:
        values = batch.column(2)
        length, flat = values.value_lengths().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)
        start, out = np.r_[0, np.cumsum(length)], [None] * len(batch)
        for n in np.unique(length).tolist():
            rows = np.flatnonzero(length == n)
            power = np.abs(np.fft.rfft(flat[start[rows][:, None] + np.arange(n)].astype(float), axis=1)) if n else np.empty((len(rows), 0))
            for i, p in zip(rows.tolist(), power, strict=True):
                out[i] = p
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], names=["series", "frame_no", "p"])


def spectrum_fast(frames: DataFrame, digits: int | None = 3) -> DataFrame:
    """Magnitude of each frequency of each frame, by one FFT over the frames of a batch."""
    kinds = dict(frames.dtypes)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "pcm"))), lambda s: s["pcm"])
    held = frames.groupBy("series", "frame_no").agg(ordered.alias("a"))
    rows = held.mapInArrow(_rfft, f"series {kinds['series']}, frame_no {kinds['frame_no']}, p array<double>")
    return rows.select("series", "frame_no", F.posexplode("p").alias("k", "x")).select("series", "frame_no", "k", (F.col("x") if digits is None else F.round("x", digits)).alias("magnitude"))


def sine_series(params: DataFrame, length: int, digits: int | None = 6) -> DataFrame:
    """params (series, freq, amplitude, phase if there is one): Hann-windowed sums of sines, summed by series."""
    rows = params.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    hann = b(0.5) - b(0.5) * F.cos(F.col("idx").cast("double") * b(2 * math.pi / (length - 1)))
    turn = F.col("idx").cast("double") * F.col("freq") * b(2 * math.pi)
    x = F.sum(F.col("amplitude") * F.sin(turn + F.col("phase") if "phase" in params.columns else turn) * hann)
    return rows.groupBy("series", "idx").agg(x.alias("x") if digits is None else (F.round(x, digits) + b(0.0)).alias("x"))


def downmix(frame: DataFrame) -> DataFrame:
    """Mean of each pair of channels (even and odd bins) of each frame of a stream."""
    return frame.groupBy("stream", "frame_no", F.expr("bin div 2").cast("int").alias("idx")).agg((F.sum("q").cast("double") / b(2.0)).alias("x"))


def upmix(mono: DataFrame, channels: int = 2) -> DataFrame:
    return mono.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(channels - 1)))).select("stream", "frame_no", "idx", "channel", "x")


def deinterleave(values: Column, channel: int, channels: int) -> Column:
    return F.filter(values, lambda x, i: i % channels == channel)


def interleave(left: Column, right: Column) -> Column:
    return F.flatten(F.zip_with(left, right, lambda x, y: F.array(x, y)))
