"""Queries of the signal operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cuebase.functions import scalar as C
from cuebase.operators import signal as S
from cuebase.registry import query

SIZE, HOP = 16, 12
CUT = f"""top AS (SELECT series, max(idx) AS top FROM sample GROUP BY series),
  al AS (SELECT series, frame_no, pos::INT AS pos FROM top, unnest(range(0, top // {HOP} + 1)) f(frame_no), range(0, {SIZE}) p(pos)),
  cf AS (SELECT al.series, al.frame_no, al.pos, coalesce(pcm, 0) AS pcm FROM al LEFT JOIN sample s ON s.series = al.series AND s.idx = al.frame_no * {HOP} + al.pos - {SIZE - HOP})"""
OUT = "nx AS (SELECT series, idx, pcm, coalesce(lead(pcm) OVER w, pcm) AS next FROM sample WINDOW w AS (PARTITION BY series ORDER BY idx)), ks AS (SELECT nx.*, k FROM nx, unnest(range(ceil(idx * {p} / {q}::DOUBLE)::BIGINT, ceil((idx + 1) * {p} / {q}::DOUBLE)::BIGINT)) x(k))"
RAMP = "[" + ", ".join(str((2 * i + 1) * 32768 // (2 * (SIZE - HOP))) for i in range(SIZE - HOP)) + "]"
TABLE = "[" + ", ".join(f"{x!r}::DOUBLE" for x in S.kernel_table(4, 8)) + "]"
BASIS = ", ".join(f"({k}, {n}, {round(32768 * math.cos(2 * math.pi * k * n / 16))}, {round(32768 * math.sin(2 * math.pi * k * n / 16))})" for k in range(9) for n in range(16))


@query("b16_pcm_float", """
  SELECT event_id, pcm::DOUBLE / 32768.0::DOUBLE AS x, ((round_even(greatest(-2147483648.0::DOUBLE, least(2147483647.0::DOUBLE, pcm::DOUBLE / 32768.0::DOUBLE * 2147483648.0::DOUBLE)), 0))::BIGINT >> 16)::INT AS back,
    (round_even(greatest(-2147483648.0::DOUBLE, least(2147483647.0::DOUBLE, pcm::DOUBLE / 8192.0::DOUBLE * 2147483648.0::DOUBLE)), 0)::BIGINT >> 16)::INT AS clipped FROM sample""")
def _(v):
    x = C.pcm_to_float(F.col("pcm"))
    return v.sample.select("event_id", x.alias("x"), C.float_to_pcm(x).alias("back"), C.float_to_pcm(x * 4).alias("clipped"))


@query("b17_pcm8_to_pcm16", "SELECT event_id, (byte - 128) * 256 AS pcm FROM port")
def _(v):
    return v.port.select("event_id", ((F.col("byte") - 128) * 256).alias("pcm"))


@query("b18_downmix", "SELECT stream, frame_no, (bin // 2)::INT AS idx, sum(q)::DOUBLE / 2 AS x FROM take GROUP BY ALL")
def _(v):
    return S.downmix(v.take)


@query("b18_upmix", "SELECT stream, frame_no, idx, c::INT AS channel, x FROM (SELECT stream, frame_no, (bin // 2)::INT AS idx, sum(q)::DOUBLE / 2 AS x FROM take GROUP BY ALL), range(0, 2) t(c)")
def _(v):
    return S.upmix(S.downmix(v.take))


@query("b18_interleave", """
  WITH a AS (SELECT stream, frame_no, list(q ORDER BY bin) AS v FROM take GROUP BY stream, frame_no)
  SELECT stream, frame_no, array_to_string(v, ',') AS again, array_to_string(list_filter(v, lambda x, i: i % 2 = 1), ',') AS first FROM a""")
def _(v):
    values = F.transform(F.array_sort(F.collect_list(F.struct("bin", "q"))), lambda s: s["q"])
    rows = v.take.groupBy("stream", "frame_no").agg(values.alias("v"))
    left, right = S.deinterleave(F.col("v"), 0, 2), S.deinterleave(F.col("v"), 1, 2)
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return rows.select("stream", "frame_no", text(S.interleave(left, right)).alias("again"), text(left).alias("first"))


@query("b27_reverse_series", "SELECT series, max(idx) OVER (PARTITION BY series) - idx AS idx, pcm FROM sample")
def _(v):
    return S.reverse_series(v.sample)


@query("c8_hold_resample", f"WITH {OUT.format(p=3, q=2)} SELECT series, k AS idx, pcm FROM ks")
def _(v):
    return S.hold_resample(v.sample, 3, 2)


@query("c9_linear_resample", f"WITH {OUT.format(p=3, q=2)} SELECT series, k AS idx, round(pcm + ((k * 2 - idx * 3)::DOUBLE / 3.0::DOUBLE) * (next - pcm), 6) AS x FROM ks")
def _(v):
    return S.linear_resample(v.sample, 3, 2)


@query("c10_cubic_resample", """
  WITH n AS (SELECT series, idx, pcm::DOUBLE AS x0, coalesce(lag(pcm) OVER w, pcm)::DOUBLE AS xm, coalesce(lead(pcm) OVER w, pcm)::DOUBLE AS x1, coalesce(lead(pcm, 2) OVER w, lead(pcm) OVER w, pcm)::DOUBLE AS x2
             FROM sample WINDOW w AS (PARTITION BY series ORDER BY idx)),
  k AS (SELECT n.*, k, (k * 3 - idx * 4)::DOUBLE / 4.0::DOUBLE AS t FROM n, unnest(range(ceil(idx * 4 / 3::DOUBLE)::BIGINT, ceil((idx + 1) * 4 / 3::DOUBLE)::BIGINT)) x(k))
  SELECT series, k AS idx, round(((((x2 - xm) * 0.5::DOUBLE + (x0 - x1) * 1.5::DOUBLE) * t + (xm - x0 * 2.5::DOUBLE + x1 * 2.0::DOUBLE - x2 * 0.5::DOUBLE)) * t + (x1 - xm) * 0.5::DOUBLE) * t + x0, 6) AS x FROM k""")
def _(v):
    return S.cubic_resample(v.sample, 4, 3)


def bandlimited(p, q, width=4):
    low = max(p, q)
    return f"""
  WITH s AS (SELECT series, idx, pcm, max(idx) OVER (PARTITION BY series) AS top FROM sample),
  k AS (SELECT s.*, k, abs(k * {q} - idx * {p})::DOUBLE * 8.0::DOUBLE / {low}.0::DOUBLE AS pos
        FROM s, unnest(range(greatest(0, ceil((idx * {p} - {width * low}) / {q}::DOUBLE)::BIGINT), least(floor((idx * {p} + {width * low}) / {q}::DOUBLE)::BIGINT, floor(top * {p} / {q}::DOUBLE)::BIGINT) + 1)) x(k)),
  t AS (SELECT *, floor(pos)::INT AS cell, {TABLE} AS tab FROM k)
  SELECT series, k AS idx, round(sum((tab[cell + 1] + (pos - cell) * (tab[cell + 2] - tab[cell + 1])) * pcm) * {min(p / q, 1.0)!r}::DOUBLE, 4) AS x FROM t GROUP BY series, k"""


@query("c11_bandlimited_resample", bandlimited(3, 2))
def _(v):
    return S.bandlimited_resample(v.sample, 3, 2)


@query("c11_bandlimited_downsample", bandlimited(2, 5))
def _(v):
    return S.bandlimited_resample(v.sample, 2, 5)


@query("c22_timewarp_resample", """
  WITH n AS (SELECT series, idx, pcm, coalesce(lead(pcm) OVER w, pcm) AS next, CASE WHEN idx >= 40 + series % 3 THEN 700 WHEN idx >= 20 THEN 1500 ELSE 1000 END AS ratio FROM sample WINDOW w AS (PARTITION BY series ORDER BY idx)),
  p AS (SELECT *, coalesce(sum(ratio) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM n)
  SELECT series, k AS idx, round(pcm + ((k * 1000 - start)::DOUBLE / ratio::DOUBLE) * (next - pcm), 6) AS x FROM p, unnest(range((start + 999) // 1000, (start + ratio + 999) // 1000)) x(k)""")
def _(v):
    at = F.explode(F.expr("array(struct(0L AS from_idx, 1000 AS ratio), struct(20L AS from_idx, 1500 AS ratio), struct(40 + series % 3 AS from_idx, 700 AS ratio))"))
    return S.timewarp_resample(v.sample, v.sample.select("series").distinct().withColumn("e", at).select("series", "e.from_idx", "e.ratio"))


@query("d29_length_check", f"""
  WITH {OUT.format(p=3, q=2)}, i AS (SELECT series, count(*) AS n_in FROM sample GROUP BY 1), o AS (SELECT series, count(*) AS n_out FROM ks GROUP BY 1)
  SELECT i.series, n_in, coalesce(n_out, 0) AS n_out, abs(n_in * 3 - coalesce(n_out, 0) * 2) <= 2 AS ok FROM i LEFT JOIN o ON o.series = i.series""")
def _(v):
    return S.length_check(v.sample, S.hold_resample(v.sample, 3, 2), 3, 2)


@query("d30_peak", "SELECT series, max(abs(pcm)) AS peak FROM sample GROUP BY series")
def _(v):
    return S.peak(v.sample)


@query("d28_quality_gate", f"""
  WITH {OUT.format(p=3, q=2)},
  o AS (SELECT 'hold' AS converter, series, pcm::DOUBLE AS x FROM ks UNION ALL SELECT 'linear', series, round(pcm + ((k * 2 - idx * 3)::DOUBLE / 3.0::DOUBLE) * (next - pcm), 6) FROM ks),
  m AS (SELECT converter, series AS "case", count(*) AS n, max(abs(x)) / 32768.0::DOUBLE AS peak, round(avg(abs(x)), 4) AS figure FROM o GROUP BY ALL),
  c AS (SELECT series AS "case", count(*) * 3 // 2 + series % 9 AS want_n, max(abs(pcm))::DOUBLE / 32768.0::DOUBLE AS want_peak, 3000.0::DOUBLE AS least FROM sample GROUP BY series)
  SELECT converter, "case", CASE WHEN abs(n - want_n) <= 4 AND abs(peak - want_peak) <= 0.01::DOUBLE AND figure >= least THEN 'pass' ELSE 'fail' END AS verdict, figure, min(figure) OVER (PARTITION BY converter) AS worst
  FROM m JOIN c USING ("case")""")
def _(v):
    made = S.hold_resample(v.sample, 3, 2).select(F.lit("hold").alias("converter"), "series", F.col("pcm").cast("double").alias("x"))
    made = made.unionByName(S.linear_resample(v.sample, 3, 2).select(F.lit("linear").alias("converter"), "series", "x"))
    measured = made.groupBy("converter", F.col("series").alias("case")).agg(F.count("*").alias("n"), (F.max(F.abs("x")) / 32768.0).alias("peak"), F.round(F.avg(F.abs("x")), 4).alias("figure"))
    cases = v.sample.groupBy(F.col("series").alias("case")).agg((F.expr("count(*) * 3 div 2") + F.col("case") % 9).alias("want_n"), (F.max(F.abs("pcm")).cast("double") / 32768.0).alias("want_peak"), C.b(3000.0).alias("least"))
    return S.quality_gate(measured, cases.withColumn("converter", F.explode(F.array(F.lit("hold"), F.lit("linear")))))


@query("e16_cut_frames", f"WITH {CUT} SELECT * FROM cf")
def _(v):
    return S.cut_frames(v.sample, SIZE, HOP)


@query("e17_taper", f"""
  WITH {CUT} SELECT series, frame_no, pos, (pcm * CASE WHEN pos < {SIZE - HOP} THEN {RAMP}[pos + 1] WHEN pos >= {HOP} THEN {RAMP}[{SIZE} - pos] ELSE 32768 END)::BIGINT AS scaled FROM cf""")
def _(v):
    return S.taper(S.cut_frames(v.sample, SIZE, HOP), SIZE, SIZE - HOP)


@query("e18_crossfade", f"""
  WITH {CUT} SELECT a.series, a.frame_no, a.pos, CASE WHEN a.pos < {SIZE - HOP} THEN a.pcm * {RAMP}[least(a.pos, {SIZE - HOP - 1}) + 1] + coalesce(p.pcm, 0) * {RAMP}[greatest({SIZE - HOP} - a.pos, 1)] ELSE a.pcm * 32768 END::BIGINT AS scaled
  FROM cf a LEFT JOIN cf p ON p.series = a.series AND p.frame_no = a.frame_no - 1 AND p.pos = a.pos + {HOP} WHERE a.pos < {HOP}""")
def _(v):
    return S.crossfade(S.cut_frames(v.sample, SIZE, HOP), SIZE, SIZE - HOP)


@query("h6_spectrum", f"""
  WITH {CUT}, bs(k, pos, c, s) AS (VALUES {BASIS})
  SELECT series, frame_no, k, sum(pcm::BIGINT * c)::BIGINT AS re, sum(pcm::BIGINT * s)::BIGINT AS im FROM cf JOIN bs ON bs.pos = cf.pos GROUP BY ALL""")
def _(v):
    return S.spectrum(S.cut_frames(v.sample, SIZE, HOP), SIZE)


@query("h6_spectrum_fast", f"""
  WITH {CUT}, w AS (SELECT series, frame_no, k::INT AS k, sum(pcm * cos({2 * math.pi!r}::DOUBLE * k * pos / {SIZE})) AS re, sum(pcm * sin({2 * math.pi!r}::DOUBLE * k * pos / {SIZE})) AS im FROM cf, range(0, {SIZE // 2 + 1}) t(k) GROUP BY ALL)
  SELECT series, frame_no, k, round(sqrt(re * re + im * im), 3) AS magnitude FROM w""")
def _(v):
    return S.spectrum_fast(S.cut_frames(v.sample, SIZE, HOP))


@query("h7_sine_series", f"""
  WITH p AS (SELECT s_nationkey AS series, (1 + s_suppkey % 7)::DOUBLE / 64.0::DOUBLE AS freq, s_acctbal AS amplitude FROM supplier)
  SELECT series, i::INT AS idx, round(sum(amplitude * sin(i::DOUBLE * freq * {2 * math.pi!r}::DOUBLE) * (0.5::DOUBLE - 0.5::DOUBLE * cos(i::DOUBLE * {2 * math.pi / 63!r}::DOUBLE))), 6) + 0.0::DOUBLE AS x
  FROM p, range(0, 64) t(i) GROUP BY series, i""")
def _(v):
    params = v.supplier.select(F.col("s_nationkey").alias("series"), ((1 + F.col("s_suppkey") % 7).cast("double") / 64.0).alias("freq"), F.col("s_acctbal").alias("amplitude"))
    return S.sine_series(params, 64)
