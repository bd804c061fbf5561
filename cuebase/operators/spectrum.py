"""Frame spectra: bands, levels, candidate codes and formats, peaks.

Signal values are scaled integers, so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cuebase.functions.scalar import b, half_away

#: Sizes of the 16 bands of a 64-bin frame, candidate codes (width in bits, scale), sample clock.
BAND_SIZES = [1, 3] + [4] * 13 + [8]
CODES = [(1, 2, 4096), (2, 3, 2048), (3, 5, 512), (4, 8, 64)]
SAMPLE_RATE, FRAME_SAMPLES = 31250, 240


def layout(df: DataFrame) -> DataFrame:
    """(bin, band, size): 64 rows, sent to every task."""
    rows, at = [], 0
    for band, n in enumerate(BAND_SIZES):
        rows += [(k, band, n) for k in range(at, at + n)]
        at += n
    return F.broadcast(df.sparkSession.createDataFrame(rows, "bin int, band int, size int"))


def bins_to_bands(frame: DataFrame) -> DataFrame:
    return frame.join(layout(frame), "bin").select("stream", "frame_no", "bin", "band", "q")


def band_stats(frame: DataFrame) -> DataFrame:
    q = F.col("q").cast("bigint")
    return bins_to_bands(frame).groupBy("stream", "frame_no", "band").agg(F.min("q").alias("lo"), F.max("q").alias("hi"), F.sum(q * q).alias("power"))


def stream_band_stats(frame: DataFrame) -> DataFrame:
    return band_stats(frame).groupBy("stream", "band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("power").alias("power"))


def band_rms(frame: DataFrame) -> DataFrame:
    """Power of each band by its size, its root and the sum of the stream's roots; roots are added as millionths, so the order does not matter."""
    sizes = layout(frame).select("band", "size").distinct()
    rows = stream_band_stats(frame).join(F.broadcast(sizes), "band").withColumn("scaled", F.expr("power * 16 div size"))
    root = F.sqrt(F.col("scaled").cast("double"))
    rows = rows.withColumn("millionths", F.floor(root * 1e6)).withColumn("all", F.sum("millionths").over(Window.partitionBy("stream")))
    return rows.select("stream", "band", "scaled", F.round(root, 6).alias("rms"), (F.col("all") / 1e6).alias("total"), "millionths", "all")


def band_cutoff(frame: DataFrame, percent: int = 90) -> DataFrame:
    """First band from below at which the share of the summed roots reaches the cutoff; 16 if none does, or in silence."""
    so_far = F.sum("millionths").over(Window.partitionBy("stream").orderBy("band"))
    rows = band_rms(frame).withColumn("so_far", so_far)
    reached = F.min(F.when((F.col("so_far") * 100 >= F.col("all") * percent) & (F.col("all") > 0), F.col("band")))
    return rows.groupBy("stream").agg(F.coalesce(reached, F.lit(16)).alias("keep"))


def bit_budget(shares: DataFrame, rate: int, keep: int) -> DataFrame:
    """shares (band, size, share): whole bits of each kept band out of a frame's bits."""
    bits = rate * FRAME_SAMPLES // SAMPLE_RATE
    kept = shares.where(F.col("band") < keep)
    total = kept.agg(F.sum(F.col("share") * F.col("size")).alias("total"))
    return kept.join(F.broadcast(total)).select("band", F.expr(f"share * {bits} div total").cast("int").alias("bits"))


def nearest_scale(targets: DataFrame, scales: DataFrame) -> DataFrame:
    """targets (…, target), scales (code, factor): largest code whose factor lies below the target, else 0.

    The scale table has 64 rows; it is turned into ranges, so each target meets one row.
    """
    w = Window.orderBy("factor")
    ranges = scales.withColumn("next", F.lead("factor").over(w))
    hit = targets.join(F.broadcast(ranges), (F.col("target") > F.col("factor")) & (F.col("next").isNull() | (F.col("target") <= F.col("next"))), "left")
    return hit.withColumn("code", F.coalesce("code", F.lit(0))).drop("factor", "next")


def quant_error(frame: DataFrame, most: int = 600) -> DataFrame:
    """Squared error of each candidate code for each band of each frame; ok if within most squared for each bin.

    A code keeps the low bits of a value, so values outside its width wrap around.
    """
    codes = frame.sparkSession.createDataFrame(CODES, "code int, width int, scale int")
    rows = bins_to_bands(frame).join(F.broadcast(codes))
    scaled = half_away(F.col("q").cast("double") / F.col("scale").cast("double"))
    half = F.expr("shiftleft(1, width - 1)")
    kept = F.pmod(scaled + half, half * 2) - half
    error = F.col("q") - kept * F.col("scale")
    sums = rows.groupBy("stream", "frame_no", "band", "code", "width").agg(F.sum(error * error).cast("bigint").alias("error"), F.count("*").alias("n"))
    return sums.withColumn("ok", F.col("error") <= F.col("n") * (most * most))


def best_code(frame: DataFrame, most: int = 600, least_range: int = 64) -> DataFrame:
    """Narrowest code that passes, then least error; without one least error; lowest code on ties; 0 for a flat band."""
    order = F.struct((~F.col("ok")).cast("int").alias("fails"), F.when(F.col("ok"), F.col("width")).otherwise(0).alias("width"), "error", "code")
    best = quant_error(frame, most).groupBy("stream", "frame_no", "band").agg(F.min(order).alias("best"))
    flat = band_stats(frame).select("stream", "frame_no", "band", (F.col("hi") - F.col("lo") < least_range).alias("flat"))
    return best.join(flat, ["stream", "frame_no", "band"]).select(
        "stream", "frame_no", "band", F.when(F.col("flat"), 0).otherwise(F.col("best.code")).alias("code"), F.when(F.col("flat"), F.lit(None)).otherwise(F.col("best.error")).alias("error")
    )


def code_deltas(frame: DataFrame) -> DataFrame:
    """Change of each band's code against the stream's previous frame; the range check is kept as a column."""
    w = Window.partitionBy("stream", "band").orderBy("frame_no")
    rows = best_code(frame).withColumn("delta", (F.col("code") - F.coalesce(F.lag("code").over(w), F.lit(0))).cast("int"))
    return rows.select("stream", "frame_no", "band", "code", "delta", F.when(~F.col("delta").between(-16, 14), "error").alias("problem"))


def quantised(frame: DataFrame, step: int = 1024) -> DataFrame:
    value = half_away(F.col("q").cast("double") / b(step))
    return bins_to_bands(frame).select("stream", "frame_no", "bin", "band", value.cast("int").alias("value"))


def codebook_bits(frame: DataFrame, codebook: DataFrame, width: int = 7) -> DataFrame:
    """codebook (value, nbits): bits of each quantised value; those outside take the fixed width."""
    rows = quantised(frame).join(F.broadcast(codebook), "value", "left")
    return rows.select("stream", "frame_no", "bin", "band", "value", F.coalesce("nbits", F.lit(width)).alias("nbits"))


def zero_pairs(frame: DataFrame) -> DataFrame:
    """Runs of zeros in a band taken as pairs from the left, and the single ones left over."""
    own = ["stream", "frame_no", "band"]
    island = F.col("bin") - F.row_number().over(Window.partitionBy(*own).orderBy("bin"))
    runs = quantised(frame).where("value = 0").withColumn("island", island).groupBy(*own, "island").agg(F.count("*").alias("n"))
    return runs.groupBy(*own).agg(F.sum(F.expr("n div 2")).alias("pairs"), F.sum(F.col("n") % 2).alias("singles"))


def encoded_size(frame: DataFrame, codebook: DataFrame) -> DataFrame:
    """Bytes of each stream in each format: header, and the bits of its values in whole bytes."""
    bits = codebook_bits(frame, codebook).groupBy("stream").agg(F.sum("nbits").cast("bigint").alias("bits"), F.sum(F.lit(7)).cast("bigint").alias("plain"))
    formats = frame.sparkSession.createDataFrame([(0, 16, 0), (1, 1, 0), (2, 16, 1)], "format int, header int, plain_bits int")
    rows = bits.join(F.broadcast(formats))
    used = F.when(F.col("plain_bits") == 1, F.col("plain")).otherwise(F.col("bits"))
    return rows.select("stream", "format", (2 + F.col("header") + F.ceil(used / b(8.0))).cast("bigint").alias("size"))


def best_format(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (stream, wanted): smallest allowed format, -1 allows all, first on ties; none is an error."""
    allowed = (F.col("wanted") == -1) | (F.col("format") == F.col("wanted"))
    best = wanted.join(sizes, "stream", "left").groupBy("stream").agg(F.min(F.when(allowed, F.struct("size", "format"))).alias("best"))
    return best.select("stream", "best.format", "best.size", F.when(F.col("best").isNull(), "no format").alias("problem"))


def spectra(frame: DataFrame) -> DataFrame:
    return frame.select("stream", "frame_no", F.col("bin").alias("k"), F.abs("q").alias("x"))


def in_frame() -> WindowSpec:
    return Window.partitionBy("stream", "frame_no")


def is_peak(x: str) -> Column:
    """Above the value before and not below the one after, in one spectrum."""
    w = in_frame().orderBy("k")
    return (F.lag(x).over(w) < F.col(x)) & (F.col(x) >= F.lead(x).over(w))


def local_peaks(spec: DataFrame) -> DataFrame:
    return spec.withColumn("peak", is_peak("x")).where("peak").select("stream", "frame_no", "k", "x")


def log_spectrum(spec: DataFrame) -> DataFrame:
    """Decibels below the frame's largest value; the first bin (the mean) does not count and is at the floor of -200."""
    top = F.max(F.when(F.col("k") > 0, F.col("x"))).over(in_frame())
    db = F.greatest(b(-200.0), b(20.0) * F.log10(F.col("x").cast("double") / F.col("top").cast("double")))
    value = F.when((F.col("k") == 0) | (F.col("x") == 0), b(-200.0)).otherwise(db)
    return spec.withColumn("top", top).select("stream", "frame_no", "k", F.round(value, 6).alias("db"))


def ranked_peaks(peaks: DataFrame, k: int) -> DataFrame:
    """peaks (stream, frame_no, k, db): the k highest of each spectrum, their rank, and how far they lie below the strongest."""
    rank = F.row_number().over(in_frame().orderBy(F.desc("db"), "k"))
    top = peaks.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.withColumn("below", F.max("db").over(in_frame()) - F.col("db"))


def snr(spec: DataFrame, k: int = 10, gap: float = 10.0, expected: int = 1) -> DataFrame:
    """How far below the frame's top the first of the k highest peaks is that lies more than `gap` below the strongest; the strongest's level if none does.

    The mean in bin 0 counts as 0.  Fewer peaks than expected: -1.
    """
    levels = log_spectrum(spec)
    peaks = local_peaks(spec.withColumn("x", F.when(F.col("k") > 0, F.col("x")).otherwise(0))).join(levels, ["stream", "frame_no", "k"])
    low = F.col("below") > gap
    found = ranked_peaks(peaks, k).groupBy("stream", "frame_no").agg(
        F.count("*").alias("n"), F.min_by(F.when(low, F.abs("db")), F.when(low, F.col("rank"))).alias("figure"), F.max("db").alias("strongest")
    )
    every = spec.select("stream", "frame_no").distinct().join(found, ["stream", "frame_no"], "left")
    figure = F.when(F.coalesce("n", F.lit(0)) < expected, b(-1.0)).otherwise(F.coalesce("figure", "strongest"))
    return every.select("stream", "frame_no", F.round(figure, 5).alias("snr"))


def snr_of_levels(levels: DataFrame, expected: DataFrame, k: int = 10, gap: float = 10.0) -> DataFrame:
    """levels (stream, frame_no, k, x in decibels), expected (stream, peaks): how far down the first of the k highest peaks is that lies more than `gap`
    below the strongest; that of the strongest if none does; -1 if there are fewer peaks than expected."""
    peaks = ranked_peaks(local_peaks(levels).withColumnRenamed("x", "db"), k)
    low = F.col("below") > gap
    found = peaks.groupBy("stream", "frame_no").agg(F.count("*").alias("n"), F.min_by(F.when(low, -F.col("db")), F.when(low, F.col("rank"))).alias("figure"), F.max("db").alias("top"))
    every = levels.select("stream", "frame_no").distinct().join(found, ["stream", "frame_no"], "left").join(F.broadcast(expected), "stream")
    few = F.coalesce("n", F.lit(0)) < F.least("peaks", F.lit(k))
    return every.select("stream", "frame_no", F.when(few, b(-1.0)).otherwise(F.coalesce("figure", "top")).alias("snr"))


def smooth_troughs(spec: DataFrame, decay: float = 0.999) -> DataFrame:
    """Between adjacent peaks, from the smaller one on, a bin below the one before it takes that one's decayed level.

    Bins before the first and after the last peak stay; of equal peaks the later counts as the smaller.  A spectrum is one
    array: it is run through once in each direction, and each bin takes the run that starts at its gap's smaller peak.
    """
    peak = F.coalesce(is_peak("x"), F.lit(False))
    ordered = F.array_sort(F.collect_list(F.struct("k", F.col("x").cast("double").alias("x"), F.col("peak").alias("peak"))))
    rows = spec.withColumn("peak", peak).groupBy("stream", "frame_no").agg(ordered.alias("a"))
    nothing = F.lit(None).cast("double")

    def run(a):
        start = F.struct(nothing.alias("v"), nothing.alias("top"), F.array().cast("array<struct<v:double,top:double>>").alias("out"))

        def step(s, e):
            v = F.when(~e["peak"] & (e["x"] < s["v"]), s["v"] * decay).otherwise(e["x"])
            top = F.when(e["peak"], e["x"]).otherwise(s["top"])
            return F.struct(v.alias("v"), top.alias("top"), F.concat(s["out"], F.array(F.struct(v.alias("v"), top.alias("top")))).alias("out"))

        return F.aggregate(a, start, step, lambda s: s["out"])

    both = rows.select("stream", "frame_no", F.explode(F.arrays_zip("a", run(F.col("a")).alias("up"), F.reverse(run(F.reverse("a"))).alias("down"))).alias("e"))
    e, up, down = F.col("e.a"), F.col("e.up"), F.col("e.down")
    level = F.when(e["peak"] | up["top"].isNull() | down["top"].isNull(), e["x"]).when(down["top"] > up["top"], up["v"]).otherwise(down["v"])
    return both.select("stream", "frame_no", e["k"].alias("k"), F.round(level, 6).alias("x"))
