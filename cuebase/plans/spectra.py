"""Queries of the spectrum operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuebase.operators import spectrum as X
from cuebase.registry import query

LAYOUT = "lay AS (SELECT bin, band, size FROM (VALUES " + ", ".join(
    f"({k}, {band}, {n})" for band, n in enumerate(X.BAND_SIZES) for k in range(sum(X.BAND_SIZES[:band]), sum(X.BAND_SIZES[:band]) + n)
) + ") t(bin, band, size))"
STATS = LAYOUT + """,
  bb AS (SELECT stream, frame_no, frame.bin, band, size, q FROM frame JOIN lay ON lay.bin = frame.bin),
  bs AS (SELECT stream, frame_no, band, min(q) AS lo, max(q) AS hi, sum(q::BIGINT * q)::BIGINT AS power FROM bb GROUP BY ALL),
  ss AS (SELECT stream, band, min(lo) AS lo, max(hi) AS hi, sum(power)::BIGINT AS power FROM bs GROUP BY ALL),
  rm AS (SELECT ss.stream, ss.band, power * 16 // size AS scaled, (sum(power * 16 // size) OVER (PARTITION BY stream))::BIGINT AS total FROM ss JOIN (SELECT DISTINCT band, size FROM lay) l ON l.band = ss.band)"""
ROUND = "(sign({0}) * floor(abs({0}) + 0.5::DOUBLE))::BIGINT"
QUANT = STATS + f""",
  cd(code, width, scale) AS (VALUES {', '.join(map(str, X.CODES))}),
  qk AS (SELECT stream, frame_no, band, code, width, scale, q, (({ROUND.format('(q::DOUBLE / scale::DOUBLE)')} + (1 << (width - 1))) & ((1 << width) - 1)) - (1 << (width - 1)) AS kept FROM bb, cd),
  qe AS (SELECT stream, frame_no, band, code, width, sum((q - kept * scale) * (q - kept * scale))::BIGINT AS error, count(*) AS n FROM qk GROUP BY ALL),
  qo AS (SELECT *, error <= n * 360000 AS ok FROM qe),
  rk AS (SELECT *, row_number() OVER (PARTITION BY stream, frame_no, band ORDER BY ok DESC, CASE WHEN ok THEN width ELSE 0 END, error, code) AS k FROM qo),
  bc AS (SELECT rk.stream, rk.frame_no, rk.band, CASE WHEN hi - lo < 64 THEN 0 ELSE code END AS code, CASE WHEN hi - lo < 64 THEN NULL ELSE error END AS error
         FROM rk JOIN bs ON bs.stream = rk.stream AND bs.frame_no = rk.frame_no AND bs.band = rk.band WHERE k = 1)"""
VALUE = STATS + f""",
  qv AS (SELECT stream, frame_no, bin, band, {ROUND.format('(q::DOUBLE / 1024.0::DOUBLE)')}::INT AS value FROM bb),
  bk(value, nbits) AS (VALUES (0, 1), (1, 3), (-1, 3), (2, 4), (-2, 4), (3, 5), (-3, 5)),
  cb AS (SELECT stream, frame_no, bin, band, qv.value, coalesce(nbits, 7) AS nbits FROM qv LEFT JOIN bk ON bk.value = qv.value),
  bt AS (SELECT stream, sum(nbits)::BIGINT AS bits, (count(*) * 7)::BIGINT AS plain FROM cb GROUP BY stream),
  fm(format, header, plain_bits) AS (VALUES (0, 16, 0), (1, 1, 0), (2, 16, 1)),
  es AS (SELECT stream, format, (2 + header + ceil(CASE WHEN plain_bits = 1 THEN plain ELSE bits END / 8.0::DOUBLE))::BIGINT AS size FROM bt, fm)"""
SPEC = """sp AS (SELECT stream, frame_no, bin AS k, abs(q) AS x FROM take),
  nb AS (SELECT *, lag(x) OVER f AS was, lead(x) OVER f AS next, max(x) FILTER (WHERE k > 0) OVER (PARTITION BY stream, frame_no) AS top FROM sp WINDOW f AS (PARTITION BY stream, frame_no ORDER BY k)),
  lg AS (SELECT stream, frame_no, k, x, was, next, round(CASE WHEN k = 0 OR x = 0 THEN -200.0 ELSE greatest(-200.0::DOUBLE, 20.0::DOUBLE * log10(x::DOUBLE / top::DOUBLE)) END::DOUBLE, 6) AS db FROM nb)"""


def book(v):
    return v.spark.createDataFrame([(0, 1), (1, 3), (-1, 3), (2, 4), (-2, 4), (3, 5), (-3, 5)], "value int, nbits int")


@query("c12_bins_to_bands", f"WITH {STATS} SELECT stream, frame_no, bin, band, q FROM bb")
def _(v):
    return X.bins_to_bands(v.frame)


@query("d9_band_stats", f"WITH {STATS} SELECT * FROM bs")
def _(v):
    return X.band_stats(v.frame)


@query("d10_stream_band_stats", f"WITH {STATS} SELECT * FROM ss")
def _(v):
    return X.stream_band_stats(v.frame)


ROOTS = f"{STATS}, ro AS (SELECT stream, band, scaled, floor(sqrt(scaled::DOUBLE) * 1e6::DOUBLE)::BIGINT AS millionths FROM rm)"


@query("d11_band_rms", f"""
  WITH {ROOTS} SELECT stream, band, scaled, round(sqrt(scaled::DOUBLE), 6) AS rms, (sum(millionths) OVER (PARTITION BY stream))::BIGINT::DOUBLE / 1e6::DOUBLE AS total FROM ro""")
def _(v):
    return X.band_rms(v.frame).drop("millionths", "all")


@query("e6_band_cutoff", f"""
  WITH {ROOTS}, c AS (SELECT *, sum(millionths) OVER (PARTITION BY stream ORDER BY band) AS so_far, sum(millionths) OVER (PARTITION BY stream) AS total FROM ro)
  SELECT stream, coalesce(min(band) FILTER (WHERE so_far * 100 >= total * 90 AND total > 0), 16) AS keep FROM c GROUP BY stream""")
def _(v):
    return X.band_cutoff(v.frame)


@query("d12_bit_budget", f"""
  WITH {STATS}, s AS (SELECT rm.band, size, sum(scaled)::BIGINT AS share FROM rm JOIN (SELECT DISTINCT band, size FROM lay) l ON l.band = rm.band WHERE rm.band < 12 GROUP BY ALL)
  SELECT band, (share * 983 // (SELECT sum(share * size) FROM s))::INT AS bits FROM s""")
def _(v):
    sizes = X.layout(v.frame).select("band", "size").distinct()
    shares = X.band_rms(v.frame).join(sizes, "band").groupBy("band", "size").agg(F.sum("scaled").alias("share"))
    return X.bit_budget(shares, 128_000, 12)


@query("c13_nearest_scale", f"""
  WITH {STATS}, sc AS (SELECT k::INT AS code, (k * k * 40 + 3)::BIGINT AS factor FROM range(1, 65) x(k))
  SELECT stream, frame_no, band, (hi - lo)::BIGINT AS target, coalesce((SELECT max(code) FROM sc WHERE factor < hi - lo), 0) AS code FROM bs""")
def _(v):
    scales = v.spark.range(1, 65).select(F.col("id").cast("int").alias("code"), (F.col("id") * F.col("id") * 40 + 3).alias("factor"))
    return X.nearest_scale(X.band_stats(v.frame).select("stream", "frame_no", "band", (F.col("hi") - F.col("lo")).cast("bigint").alias("target")), scales)


@query("d13_quant_error", f"WITH {QUANT} SELECT stream, frame_no, band, code, width, error, n, ok FROM qo")
def _(v):
    return X.quant_error(v.frame)


@query("d14_best_code", f"WITH {QUANT} SELECT * FROM bc")
def _(v):
    return X.best_code(v.frame)


@query("e19_code_deltas", f"""
  WITH {QUANT}, d AS (SELECT stream, frame_no, band, code, (code - coalesce(lag(code) OVER (PARTITION BY stream, band ORDER BY frame_no), 0))::INT AS delta FROM bc)
  SELECT *, CASE WHEN delta NOT BETWEEN -16 AND 14 THEN 'error' END AS problem FROM d""")
def _(v):
    return X.code_deltas(v.frame)


@query("c17_codebook_bits", f"WITH {VALUE} SELECT * FROM cb")
def _(v):
    return X.codebook_bits(v.frame, book(v))


@query("e20_zero_pairs", f"""
  WITH {VALUE}, z AS (SELECT *, bin - row_number() OVER (PARTITION BY stream, frame_no, band ORDER BY bin) AS island FROM qv WHERE value = 0),
  r AS (SELECT stream, frame_no, band, island, count(*) AS n FROM z GROUP BY ALL)
  SELECT stream, frame_no, band, sum(n // 2)::BIGINT AS pairs, sum(n % 2)::BIGINT AS singles FROM r GROUP BY ALL""")
def _(v):
    return X.zero_pairs(v.frame)


@query("d15_encoded_size", f"WITH {VALUE} SELECT * FROM es")
def _(v):
    return X.encoded_size(v.frame, book(v))


@query("d16_best_format", f"""
  WITH {VALUE}, w AS (SELECT DISTINCT stream, (CASE stream % 4 WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 9 END) AS wanted FROM frame),
  r AS (SELECT w.stream, format, size, row_number() OVER (PARTITION BY w.stream ORDER BY size, format) AS k FROM w JOIN es ON es.stream = w.stream WHERE wanted = -1 OR format = wanted)
  SELECT w.stream, format, size, CASE WHEN size IS NULL THEN 'no format' END AS problem FROM w LEFT JOIN r ON r.stream = w.stream AND k = 1""")
def _(v):
    m = F.col("stream") % 4
    wanted = v.frame.select("stream").distinct().withColumn("wanted", F.when(m == 0, -1).when(m == 1, 1).when(m == 2, 2).otherwise(9))
    return X.best_format(X.encoded_size(v.frame, book(v)), wanted)


@query("e12_local_peaks", f"WITH {SPEC} SELECT stream, frame_no, k, x FROM nb WHERE was < x AND x >= next")
def _(v):
    return X.local_peaks(X.spectra(v.take))


@query("e14_log_spectrum", f"WITH {SPEC} SELECT stream, frame_no, k, db FROM lg")
def _(v):
    return X.log_spectrum(X.spectra(v.take))


@query("e13_snr", f"""
  WITH {SPEC}, p AS (SELECT *, row_number() OVER (PARTITION BY stream, frame_no ORDER BY db DESC, k) AS rank FROM lg WHERE k > 0 AND CASE WHEN k = 1 THEN 0 ELSE was END < x AND x >= next),
  t AS (SELECT *, max(db) OVER (PARTITION BY stream, frame_no) AS strongest FROM p WHERE rank <= 10),
  f AS (SELECT stream, frame_no, coalesce(min_by(abs(db), rank) FILTER (WHERE strongest - db > 10), max(strongest)) AS figure FROM t GROUP BY stream, frame_no)
  SELECT s.stream, s.frame_no, round(coalesce(figure, -1.0::DOUBLE), 5) AS snr FROM (SELECT DISTINCT stream, frame_no FROM sp) s LEFT JOIN f ON f.stream = s.stream AND f.frame_no = s.frame_no""")
def _(v):
    return X.snr(X.spectra(v.take))


@query("e15_smooth_troughs", f"""
  WITH RECURSIVE {SPEC}, p AS (SELECT stream, frame_no, k, x::DOUBLE AS x, coalesce(was < x AND x >= next, false) AS peak FROM nb),
  m AS (SELECT *, max(CASE WHEN peak THEN k END) OVER (PARTITION BY stream, frame_no ORDER BY k) AS low, min(CASE WHEN peak THEN k END) OVER (PARTITION BY stream, frame_no ORDER BY k DESC) AS high FROM p),
  u(stream, frame_no, k, v) AS (SELECT stream, frame_no, k, x FROM p WHERE k = 0 UNION ALL SELECT p.stream, p.frame_no, p.k, CASE WHEN NOT p.peak AND p.x < u.v THEN u.v * 0.999::DOUBLE ELSE p.x END FROM u JOIN p ON p.stream = u.stream AND p.frame_no = u.frame_no AND p.k = u.k + 1),
  d(stream, frame_no, k, v) AS (SELECT stream, frame_no, k, x FROM p WHERE k = 63 UNION ALL SELECT p.stream, p.frame_no, p.k, CASE WHEN NOT p.peak AND p.x < d.v THEN d.v * 0.999::DOUBLE ELSE p.x END FROM d JOIN p ON p.stream = d.stream AND p.frame_no = d.frame_no AND p.k = d.k - 1)
  SELECT m.stream, m.frame_no, m.k, round(CASE WHEN m.peak OR low IS NULL OR high IS NULL THEN m.x WHEN h.x > l.x THEN u.v ELSE d.v END, 6) AS x
  FROM m JOIN u ON u.stream = m.stream AND u.frame_no = m.frame_no AND u.k = m.k JOIN d ON d.stream = m.stream AND d.frame_no = m.frame_no AND d.k = m.k
    LEFT JOIN p l ON l.stream = m.stream AND l.frame_no = m.frame_no AND l.k = m.low LEFT JOIN p h ON h.stream = m.stream AND h.frame_no = m.frame_no AND h.k = m.high""")
def _(v):
    return X.smooth_troughs(X.spectra(v.take))
