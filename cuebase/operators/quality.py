"""The published quality figures of the sample-rate converters, measured: converters x test signals, worst figure by converter.

Every test signal is a series of its own, made by sine_series(), converted, transformed as one frame, put in decibels, smoothed
between peaks and judged by snr_of_levels().  Samples are single-precision numbers, as they were for the published figures: their
rounding is the noise floor, and the smoothing counts on peaks of noise everywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuebase.functions.scalar import b
from cuebase.operators import signal, spectrum

#: Coefficients of two cosine-sum windows (4 terms, side lobes of -98 dB; 7 terms, -180 dB).
NUTTALL = [0.3635819, 0.4891775, 0.1365995, 0.0106411]
SEVEN_TERM = [0.27105140069342, 0.43329793923448, 0.21812299954311, 0.06592544638803, 0.01081174209837, 0.00077658482522, 0.00001388721735]
#: Band-limited converters: half width in samples of the lower rate, window.
SINC = {"sinc_fastest": (20, NUTTALL), "sinc_medium": (56, SEVEN_TERM), "sinc_best": (72, SEVEN_TERM)}
#: Fixed values, published: (tones, ratio p / q, peaks in the pass band) and for each converter the least figure in dB and the peak.
SIGNALS = [
    ([0.01111111111], (3, 1), 1),
    ([0.01111111111], (3, 5), 1),
    ([0.01111111111], (3, 10), 1),
    ([0.01111111111], (1, 1), 1),
    ([0.01111111111], (1001, 1000), 1),
    ([0.011111, 0.324], (19999, 10000), 2),
    ([0.012345, 0.457], (456789, 1000000), 1),
    ([0.011111, 0.45], (3, 5), 1),
    ([0.3511111111], (133, 100), 1),
    ([0.43111111111], (133, 100), 1),
]
LEAST = {
    "hold": {0: (28, 1.0), 1: (36, 1.0), 2: (36, 1.0), 3: (150, 1.0), 4: (38, 1.0), 5: (14, 1.0), 6: (12, 1.0), 8: (10, 1.0)},
    "linear": {0: (73, 1.0), 1: (73, 1.0), 2: (73, 1.0), 3: (150, 1.0), 4: (77, 1.0), 5: (15, 0.94), 6: (25, 0.96), 8: (22, 0.99)},
    "sinc_fastest": {0: (100, 1.0), 1: (99, 1.0), 2: (100, 1.0), 3: (150, 1.0), 4: (100, 1.0), 5: (97, 1.0), 6: (100, 0.5), 7: (97, 0.5), 8: (97, 1.0)},
    "sinc_medium": {0: (145, 1.0), 1: (132, 1.0), 2: (138, 1.0), 3: (157, 1.0), 4: (148, 1.0), 5: (127, 1.0), 6: (123, 0.5), 7: (126, 0.5), 9: (121, 1.0)},
    "sinc_best": {0: (147, 1.0), 1: (147, 1.0), 2: (148, 1.0), 3: (155, 1.0), 4: (148, 1.0), 5: (146, 1.0), 6: (147, 0.5), 7: (144, 0.5), 9: (145, 1.0)},
}


def convert(sample: DataFrame, converter: str, p: int, q: int) -> DataFrame:
    """(series, idx, x) of a converter by name."""
    if converter == "hold":
        return signal.hold_resample(sample, p, q).withColumnRenamed("pcm", "x")
    if converter == "linear":
        return signal.linear_resample(sample, p, q, digits=None)
    half_width, window = SINC[converter]
    return signal.bandlimited_resample(sample, p, q, half_width, kernel=signal.cosine_kernel(half_width, window), digits=None)


def golden_figures(spark: SparkSession, converters: list[str] | None = None, length: int = 1 << 13) -> DataFrame:
    """(converter, case, verdict, figure, worst) for the published cases, at outputs of about `length` samples."""
    parts, wanted = [], []
    for converter in converters or list(LEAST):
        for number, (least, peak) in LEAST[converter].items():
            tones, (p, q), peaks = SIGNALS[number]
            made = length // 16 * 16
            given = math.ceil(made * q / p)
            params = spark.createDataFrame([(number, f, 1.0 / len(tones), 0.9 * math.pi / len(tones)) for f in tones], "series int, freq double, amplitude double, phase double")
            tone = signal.sine_series(params, given, digits=None).select("series", "idx", F.col("x").cast("float").cast("double").alias("pcm"))
            parts.append(convert(tone, converter, p, q).where(F.col("idx") < made).select(F.lit(converter).alias("converter"), F.col("series").alias("case"), "idx", F.col("x").cast("float").cast("double").alias("x")))
            wanted.append((converter, number, made, float(peak), float(least), min(peaks, 10)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    cases = spark.createDataFrame(wanted, "converter string, case int, want_n int, want_peak double, least double, peaks int")
    # a case of a converter is a stream of one frame
    own = out.withColumn("stream", F.concat_ws(":", "converter", "case"))
    facts = own.groupBy("stream", "converter", "case").agg(F.count("*").alias("n"), F.max(F.abs("x")).alias("peak"))
    frames = own.select(F.col("stream").alias("series"), F.lit(0).alias("frame_no"), F.col("idx").alias("pos"), F.col("x").alias("pcm"))
    lines = signal.spectrum_fast(frames, digits=None).select(F.col("series").alias("stream"), "frame_no", "k", F.col("magnitude").alias("x"))
    levels = spectrum.smooth_troughs(spectrum.log_spectrum(lines).withColumnRenamed("db", "x"))
    expected = cases.select(F.concat_ws(":", "converter", "case").alias("stream"), "peaks")
    figures = spectrum.snr_of_levels(levels, expected).select("stream", F.round("snr", 2).alias("figure"))
    measured = facts.join(figures, "stream").select("converter", "case", "n", "peak", "figure")
    return signal.quality_gate(measured, cases.drop("peaks"))
