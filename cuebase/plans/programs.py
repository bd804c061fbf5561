"""Queries of the step operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuebase.functions.scalar import seconds
from cuebase.operators import catalog, programs
from cuebase.registry import query

ORDER = "ORDER BY seq"
UP = "ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BEFORE = "ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

NEST = f"""
  n0 AS (SELECT track_no, seq, opcode, sum(CASE opcode WHEN 14 THEN 1 WHEN 15 THEN -1 ELSE 0 END) OVER (PARTITION BY track_no {UP}) AS total FROM instr),
  n1 AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY track_no {UP})) AS after FROM n0),
  n2 AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY track_no {ORDER}), 0)::INT AS depth FROM n1)
"""


@query("e1_first_seen", """
  WITH p AS (SELECT addr, track_no, seq, row_number() OVER (PARTITION BY addr ORDER BY track_no, seq) AS k FROM instr WHERE opcode = 1)
  SELECT addr, track_no, seq, row_number() OVER (PARTITION BY track_no ORDER BY seq)::BIGINT AS number FROM p WHERE k = 1""")
def _(v):
    return programs.first_seen(v.instr)


@query("e2_running_level", f"""
  WITH s AS (SELECT *, sum(CASE WHEN opcode IN (7, 10) THEN 1 ELSE 0 END) OVER (PARTITION BY track_no, channel {UP}) AS seg,
                    CASE WHEN opcode IN (8, 11) THEN level WHEN opcode IN (9, 12) THEN -level ELSE 0 END AS delta FROM instr),
  l AS (SELECT *, sum(delta) OVER (PARTITION BY track_no, channel, seg {UP}) + CASE WHEN seg = 0 THEN 100 ELSE first_value(level) OVER (PARTITION BY track_no, channel, seg {UP}) END AS now FROM s)
  SELECT track_no, seq, channel, now::BIGINT AS level FROM l WHERE opcode = 1""")
def _(v):
    return programs.running_level(v.instr)


@query("e3_nesting", f"""
  WITH {NEST}
  SELECT a.track_no, a.seq, a.depth, (SELECT max(b.seq) FROM n2 b WHERE b.track_no = a.track_no AND b.opcode = 14 AND b.seq < a.seq AND b.depth = a.depth - 1) AS parent FROM n2 a""")
def _(v):
    return programs.nesting(v.instr)


@query("e4_live_steps", f"""
  WITH s AS (SELECT *, coalesce(sum(CASE WHEN opcode = 0 OR wait = 50 OR var_id % 40 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY track_no {BEFORE}), 0) AS ended FROM instr)
  SELECT track_no, seq, CASE WHEN var_id % 40 = 0 THEN 19 ELSE opcode END AS opcode FROM s WHERE ended = 0""")
def _(v):
    """Waits of 50 are endless here, and steps on every fortieth variable have a code that does not exist."""
    odd = F.when(F.col("var_id") % 40 == 0, 19).otherwise(F.col("opcode"))
    return programs.live_steps(v.instr.withColumns({"opcode": odd, "wait": F.when(F.col("wait") == 50, 65535).otherwise(F.col("wait"))}))


@query("e5_unmatched_ends", f"WITH {NEST} SELECT track_no, seq FROM n2 WHERE opcode = 15 AND depth = 0")
def _(v):
    return programs.unmatched_ends(v.instr)


@query("e7_schedule", """
  WITH t AS (SELECT i.track_no, sum(wait)::BIGINT AS time FROM instr i JOIN track t USING (track_no) WHERE t.type = 1 GROUP BY i.track_no)
  SELECT track_no, time, coalesce(sum(time + 1) OVER (ORDER BY track_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM t""")
def _(v):
    times = catalog.track_times(v.instr).join(v.track.where("type = 1").select("track_no"), "track_no", "left_semi")
    return programs.schedule(times)


@query("e21_stream_remaining", f"""
  WITH p AS (SELECT *, sum(CASE WHEN opcode = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY track_no {UP}) AS plays FROM instr),
  w AS (SELECT *, first_value(addr) OVER (PARTITION BY track_no, plays {UP}) AS playing,
               sum(wait) OVER (PARTITION BY track_no, plays {UP}) - first_value(wait) OVER (PARTITION BY track_no, plays {UP}) AS waited FROM p WHERE plays > 0)
  SELECT track_no, seq, greatest(0, n_frames - waited)::BIGINT AS frames_left FROM w JOIN stream s ON s.addr = w.playing""")
def _(v):
    return programs.stream_remaining(v.instr, v.stream)


@query("e22_fold_waits", f"""
  WITH g AS (SELECT *, coalesce(sum(CASE WHEN opcode <> 13 THEN 1 ELSE 0 END) OVER (PARTITION BY track_no {BEFORE}), 0) AS grp FROM instr),
  f AS (SELECT *, sum(wait) OVER (PARTITION BY track_no, grp {UP}) AS folded FROM g)
  SELECT track_no, seq, opcode, folded::BIGINT AS wait FROM f WHERE opcode <> 13""")
def _(v):
    return programs.fold_waits(v.instr)


@query("e23_split_waits", """
  WITH w AS (SELECT o_orderkey AS id, floor(o_totalprice)::BIGINT AS wait FROM orders)
  SELECT id, part::INT AS part, least(65534, wait - part * 65534)::BIGINT AS wait FROM w, unnest(range(0, greatest(wait - 1, 0) // 65534 + 1)) x(part)""")
def _(v):
    return programs.split_waits(v.orders.select(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").alias("wait")))


@query("e26_unroll_stop_all", """
  SELECT track_no, seq, channel, target::INT AS target FROM instr, range(0, 8) c(target) WHERE opcode = 2 AND repeat_n = 0 AND target <> channel""")
def _(v):
    return programs.unroll_stop_all(v.instr)


@query("h3_track_time", """
  WITH RECURSIVE s AS (SELECT track_no, seq, opcode, repeat_n, CASE WHEN wait = 50 THEN 65535 ELSE wait END AS wait, CASE WHEN opcode = 1 AND repeat_n = 0 THEN coalesce(n_frames, 0) ELSE 0 END::BIGINT AS held
      FROM instr LEFT JOIN stream USING (addr)),
  r AS (
    SELECT track_no, seq AS pos, 0::BIGINT AS total, []::BIGINT[] AS stack, 1::BIGINT AS times, false AS done, false AS endless, [0::BIGINT] AS held FROM s WHERE seq = 0
    UNION ALL
    SELECT r.track_no, r.pos + 1,
      CASE WHEN r.done THEN r.total ELSE r.total + CASE WHEN i.wait = 65535 THEN r.held[-1] ELSE i.wait END * r.times END,
      CASE WHEN r.done OR i.wait = 65535 THEN r.stack WHEN i.opcode = 14 THEN list_append(r.stack, i.repeat_n::BIGINT) WHEN i.opcode = 15 AND len(r.stack) > 0 THEN r.stack[1:len(r.stack) - 1] ELSE r.stack END,
      CASE WHEN i.opcode = 14 THEN r.times * greatest(i.repeat_n, 1) WHEN i.opcode = 15 AND len(r.stack) > 0 THEN r.times // greatest(r.stack[-1], 1) ELSE r.times END,
      r.done OR i.wait = 65535 OR i.opcode = 0 OR (i.opcode = 15 AND len(r.stack) > 0 AND r.stack[-1] = 0),
      r.endless OR (NOT r.done AND (i.wait = 65535 OR (i.opcode = 15 AND len(r.stack) > 0 AND r.stack[-1] = 0))),
      CASE WHEN i.opcode = 14 THEN list_append(r.held, 0::BIGINT) WHEN i.opcode = 15 AND len(r.stack) > 0 THEN r.held[1:len(r.held) - 1] WHEN i.opcode = 1 THEN list_append(r.held[1:len(r.held) - 1], i.held) ELSE r.held END
    FROM r JOIN s i ON i.track_no = r.track_no AND i.seq = r.pos)
  SELECT track_no, max_by(total, pos) AS frames, max_by(endless OR list_contains(stack, 0), pos) AS looping FROM r GROUP BY track_no""")
def _(v):
    return programs.track_time(v.instr.withColumn("wait", F.when(F.col("wait") == 50, programs.ENDLESS_WAIT).otherwise(F.col("wait"))), v.stream)


@query("h4_timeline", """
  WITH RECURSIVE p AS (SELECT track_no, seq, opcode, wait, repeat_n, row_number() OVER (PARTITION BY track_no ORDER BY seq) AS i FROM instr),
  r AS (
    SELECT track_no, i, wait::BIGINT AS now, seq, opcode, repeat_n, []::STRUCT(back BIGINT, times BIGINT, since BIGINT)[] AS stack FROM p WHERE i = 1 AND wait <= 2000
    UNION ALL
    SELECT p.track_no, p.i, s.now + p.wait, p.seq, p.opcode, p.repeat_n, s.stack FROM (
      SELECT track_no, now,
        CASE WHEN closes AND stack[-1].times <> 1 THEN stack[-1].back + 1 ELSE i + 1 END AS upcoming,
        CASE WHEN opcode = 14 THEN list_append(stack, {'back': i, 'times': repeat_n::BIGINT, 'since': now}) WHEN closes AND stack[-1].times = 1 THEN stack[1:len(stack) - 1]
          WHEN closes THEN list_append(stack[1:len(stack) - 1], {'back': stack[-1].back, 'times': greatest(stack[-1].times - 1, 0), 'since': now}) ELSE stack END AS stack
      FROM (SELECT *, opcode = 15 AND len(stack) > 0 AS closes FROM r)
      WHERE opcode <> 0 AND NOT (closes AND stack[-1].times = 0 AND stack[-1].since = now)) s
    JOIN p ON p.track_no = s.track_no AND p.i = s.upcoming WHERE s.now + p.wait <= 2000)
  SELECT track_no, now AS frame, seq, opcode FROM r""")
def _(v):
    return programs.timeline(v.instr)


@query("c7_asof_deferred", """
  WITH e AS (SELECT user_id AS channel, ts, event_id, CASE event_type WHEN 'view' THEN 'load' ELSE 'trigger' END AS kind FROM events WHERE event_type IN ('view', 'click')),
  w AS (SELECT *, lag(kind) OVER (PARTITION BY channel ORDER BY ts, event_id) AS was, lag(event_id) OVER (PARTITION BY channel ORDER BY ts, event_id) AS load_id FROM e)
  SELECT channel, event_id AS trigger_id, load_id FROM w WHERE kind = 'trigger' AND was = 'load'""")
def _(v):
    kinds = v.events.where("event_type in ('view', 'click')").select(F.col("user_id").alias("channel"), "ts", "event_id", F.when(F.col("event_type") == "view", "load").otherwise("trigger").alias("kind"))
    return programs.asof_deferred(kinds)


@query("c23_controller_changes", f"""
  WITH p AS (SELECT *, (var_id % 2)::INT AS stream_channel, lag(channel) OVER (PARTITION BY track_no, var_id % 2 {ORDER}) AS was FROM instr WHERE opcode = 1)
  SELECT track_no, seq, stream_channel, was, channel AS now FROM p WHERE was IS NOT NULL AND was <> channel""")
def _(v):
    return programs.controller_changes(v.instr.withColumn("stream_channel", (F.col("var_id") % 2).cast("int")))


@query("d21_channel_mix", """
  SELECT track_no, channel, greatest(-8191, least(8191, sum(CASE WHEN opcode IN (9, 12) THEN -level ELSE level END * 64)))::BIGINT AS mix
  FROM instr WHERE opcode BETWEEN 7 AND 12 GROUP BY track_no, channel""")
def _(v):
    return programs.channel_mix(v.instr)


@query("d22_volume_shift", """
  WITH t AS (SELECT track_no, (sum(level::BIGINT * 256 * 32766)::BIGINT >> 2) % 4294967296 AS total FROM instr WHERE opcode = 1 GROUP BY track_no)
  SELECT track_no, greatest(0, least(8, 28 - length(ltrim(bin(CASE WHEN total >= 2147483648 THEN 4294967295 - total ELSE total END), '0'))))::INT AS shift FROM t""")
def _(v):
    return programs.volume_shift(v.instr)


@query("e27_fade_ramp", """
  WITH f AS (SELECT track_no, seq, wait, 6400::BIGINT AS start, CASE opcode WHEN 10 THEN level * 64 WHEN 11 THEN 6400 + level * 64 ELSE 6400 - level * 64 END::BIGINT AS target
             FROM instr WHERE opcode BETWEEN 10 AND 12 AND wait > 0)
  SELECT track_no, seq, k AS frame, greatest(-8191, least(8191, CASE WHEN k = wait THEN target ELSE start + k * trunc((target - start) / wait)::BIGINT END))::BIGINT AS level
  FROM f, unnest(range(1, wait + 1)) x(k)""")
def _(v):
    return programs.fade_ramp(v.instr)


@query("e27_fades_in_time", """
  WITH RECURSIVE t AS (SELECT track_no, channel, seq, opcode, level * 5 - 128 AS param, CASE WHEN opcode >= 10 THEN var_id % 40 ELSE 0 END AS steps,
      coalesce(sum(wait) OVER (PARTITION BY track_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS frame FROM instr),
  c AS (SELECT *, (opcode - 7) % 3 AS mode, row_number() OVER (PARTITION BY track_no, channel ORDER BY frame, seq) AS n,
      lead(frame) OVER (PARTITION BY track_no, channel ORDER BY frame, seq) AS after FROM t WHERE opcode BETWEEN 7 AND 12),
  r AS (SELECT track_no, channel, seq, n, frame, after, steps, 0::BIGINT AS start, (CASE mode WHEN 2 THEN -param ELSE param END * 64)::BIGINT AS wanted FROM c WHERE n = 1
    UNION ALL SELECT c.track_no, c.channel, c.seq, c.n, c.frame, c.after, c.steps, now, (CASE mode WHEN 0 THEN param * 64 WHEN 1 THEN now + param * 64 ELSE now - param * 64 END)::BIGINT
    FROM (SELECT *, greatest(-8191, least(8191, CASE WHEN after - frame >= steps THEN wanted ELSE start + (after - frame) * trunc((wanted - start) / greatest(steps, 1))::BIGINT END))::BIGINT AS now FROM r) p
    JOIN c ON c.track_no = p.track_no AND c.channel = p.channel AND c.n = p.n + 1)
  SELECT track_no AS "key", channel, seq, (frame + k)::BIGINT AS frame, greatest(-8191, least(8191, CASE WHEN k >= steps THEN wanted ELSE start + k * trunc((wanted - start) / greatest(steps, 1))::BIGINT END))::BIGINT AS level
  FROM r, unnest(range(CASE WHEN steps = 0 THEN 0 ELSE 1 END, least(steps, coalesce(after - frame, steps)) + 1)) x(k)""")
def _(v):
    before = F.sum("wait").over(Window.partitionBy("track_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    own = v.instr.withColumn("frame", F.coalesce(before, F.lit(0))).where("opcode between 7 and 12")
    steps = F.when(F.col("opcode") >= 10, F.col("var_id") % 40).otherwise(0)
    return programs.mixing_levels(own.select(F.col("track_no").alias("key"), "channel", "frame", "seq", ((F.col("opcode") - 7) % 3).alias("mode"), (F.col("level") * 5 - 128).alias("param"), steps.alias("steps")))


@query("e28_periodic_events", """
  WITH t AS (SELECT user_id AS device, event_id, epoch_us(ts) // 3600000000 AS start, 24 * (1 + event_id % 5) AS every FROM events WHERE event_type = 'click'),
  h AS (SELECT max(epoch_us(ts) // 3600000000) AS horizon FROM events),
  e AS (SELECT t.*, least(coalesce(lead(start) OVER (PARTITION BY device ORDER BY start, event_id) - 1, horizon), horizon) AS stop FROM t, h)
  SELECT device, event_id, frame FROM e, unnest(range(start + every, stop + 1, every)) x(frame)""")
def _(v):
    hour = F.floor(seconds(F.col("ts")) / 3600).cast("bigint")
    timers = v.events.where("event_type = 'click'").select(F.col("user_id").alias("device"), "event_id", hour.alias("start"), (F.lit(24) * (1 + F.col("event_id") % 5)).alias("every"))
    horizon = v.events.agg(F.max(hour)).first()[0] or 0
    return programs.periodic_events(timers, horizon)
