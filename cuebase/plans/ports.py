"""Queries of the command stream operators, sources and SQL functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cuebase.registry import query
from cuebase.sources import archives, timed_log
from cuebase.sources.shared import materialise, shared_folder
from cuebase.streaming import commands as J

HOURS = 3600.0
#: Groups of devices that share state in a stream.
BUCKETS = 2048
#: Device of the mark at the end of a log.
NO_DEVICE = -(1 << 63)


def _value(x):
    return F.floor(x * 64)


CLASS = """CASE WHEN {0} = 21930 THEN 'master volume' WHEN {0} BETWEEN 21931 AND 21938 THEN 'channel volume' WHEN {0} BETWEEN 21946 AND 21953 THEN 'control'
  WHEN {0} IN (21954, 21955) THEN 'version query' WHEN {0} BETWEEN 21939 AND 21945 OR {0} >= 32768 THEN 'discarded' ELSE 'track' END"""


def port_stream(v):
    return J.read_port(v.spark, f"{v.folder}/events.parquet")


def logged(v, ends_after=None):
    """The port as a log of timed bytes, read as a stream in four micro-batches or so.

    ends_after: seconds that the watermark lags; then the log ends with a mark of no device so late that the watermark passes all rows before it.
    """
    port = v.port
    if ends_after is not None:
        late = F.max("ts") + F.expr(f"interval {int(ends_after) + 1} seconds")
        port = port.unionByName(port.agg(late.alias("ts")).select(F.lit(NO_DEVICE).alias("device"), "ts", F.lit(-1).cast("bigint").alias("event_id"), F.lit(-1).alias("byte")))
    folder = f"{shared_folder(v.spark)}/log-{uuid.uuid4().hex}"
    timed_log.write_log(port, folder, max(3, v.spark.sparkContext.defaultParallelism))
    size = sum(n for _, n in timed_log._Log({"path": folder}).files())
    return timed_log.stream_log(v.spark, folder, most_bytes=max(timed_log.RECORD.itemsize, size // 4))


def live(stream):
    return J.run_available(stream, keep_on=True)


def passed(seconds):
    """Microseconds up to which a watermark that lags so many seconds has passed the events in the end."""
    return f"(SELECT (max(epoch_us(ts)) // 1000 - {seconds * 1000}) * 1000 FROM events)"


FRAMED = """
  WITH RECURSIVE g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY device ORDER BY ts, event_id)) < 21600000000 THEN 0 ELSE 1 END AS new FROM port),
  s AS (SELECT *, sum(new) OVER (PARTITION BY device ORDER BY ts, event_id) AS session FROM g),
  b AS (SELECT device, session, event_id, byte, row_number() OVER (PARTITION BY device, session ORDER BY ts, event_id) AS i FROM s),
  r AS (
    SELECT device, session, i, event_id, 1 AS held, byte * 256 AS word, 0 AS head, false AS whole, 0 AS value FROM b WHERE i = 1
    UNION ALL
    SELECT device, session, i, event_id,
      CASE held WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN longer THEN 2 ELSE 0 END WHEN 2 THEN 3 ELSE 0 END,
      CASE held WHEN 0 THEN byte * 256 WHEN 1 THEN pair WHEN 2 THEN byte ELSE word END,
      CASE WHEN held = 1 THEN pair ELSE head END,
      CASE held WHEN 1 THEN NOT longer AND pair NOT BETWEEN 21939 AND 21945 AND pair < 32768 WHEN 3 THEN word = xor(byte, 255) ELSE false END,
      CASE WHEN held = 3 THEN word END
    FROM (SELECT b.*, r.held, r.word, r.head, r.word + b.byte AS pair, r.word + b.byte BETWEEN 21930 AND 21938 OR r.word + b.byte BETWEEN 21946 AND 21953 AS longer
          FROM r JOIN b ON b.device = r.device AND b.session = r.session AND b.i = r.i + 1))
  SELECT device, event_id, head AS word, value FROM r WHERE whole"""


@query("j1_frame_commands", FRAMED)
def _(v):
    return J.frame_commands(v.port, 6 * HOURS)


@query("j1_frame_commands_stream", FRAMED.replace("AS new FROM port)", f"AS new FROM port WHERE epoch_us(ts) <= {passed(3600)})"))
def _(v):
    return live(J.frame_commands_stream(logged(v), 6 * HOURS, HOURS, BUCKETS))


COMMANDS = FRAMED.replace("SELECT device, event_id, head AS word, value FROM r WHERE whole", "{0}")
TAILS = COMMANDS.replace("0 AS value FROM b", "0 AS value, false AS tail, 0 AS fourth FROM b").replace("CASE WHEN held = 3 THEN word END\n", "CASE WHEN held = 3 THEN word END, held = 3, byte\n")


@query("j2_classify_commands", COMMANDS.format(f"SELECT device, event_id, head AS word, {CLASS.format('head')} AS kind FROM r WHERE whole"))
def _(v):
    return J.frame_commands(v.port, 6 * HOURS).select("device", "event_id", "word", J.classify(F.col("word")).alias("kind"))


@query("j3_complement_check", TAILS.format("SELECT device, event_id, head AS word, value AS third, fourth, value = xor(fourth, 255) AS ok FROM r WHERE tail"))
def _(v):
    return J.complement_check(v.port, 6 * HOURS)


@query("j4_reply_rules", COMMANDS.format("""SELECT device, event_id, head AS word, CASE head WHEN 21954 THEN 1 WHEN 21955 THEN 5 WHEN 341 THEN 17 END AS reply,
    CASE WHEN head IN (21954, 21955, 341) THEN 'reply' ELSE 'queue' END AS action FROM r WHERE whole"""))
def _(v):
    rules = v.spark.createDataFrame([(21954, 1), (21955, 5), (341, 17)], "word int, reply int")
    return J.reply_rules(J.frame_commands(v.port, 6 * HOURS), rules)


BOOT = """
  WITH b AS (SELECT user_id AS device, ts, event_id, CASE event_type WHEN 'signup' THEN 0 ELSE 1 END AS kind FROM events),
  r AS (SELECT r.device, r.event_id AS reset_id, r.ts, (SELECT min(struct_pack(ts := x.ts, event_id := x.event_id)) FROM b x WHERE x.kind = 1 AND x.device = r.device AND x.ts >= r.ts) AS f FROM b r WHERE r.kind = 0)
  SELECT device, reset_id, f.event_id AS byte_id FROM r WHERE f IS NOT NULL AND epoch_us(f.ts) - epoch_us(ts) <= 21600000000"""


@query("j5_boot_window", BOOT)
def _(v):
    reset = F.col("event_type") == "signup"
    rows = v.events.select(F.col("user_id").alias("device"), "ts", "event_id", "event_type")
    return J.boot_window(rows.where(~reset), rows.where(reset), 6 * HOURS)


@query("j5_boot_window_stream", BOOT.replace("AS kind FROM events)", f"AS kind FROM events WHERE epoch_us(ts) <= {passed(3600)})"))
def _(v):
    rows = logged(v).select("device", "ts", "event_id", F.when(F.col("byte") == 1, "reset").otherwise("byte").alias("kind"))
    return live(J.boot_stream(rows, 6 * HOURS, HOURS, BUCKETS))


CLOSED = "(SELECT max(epoch_us(ts)) - 3600000000 FROM events)"


def timed(v):
    """The events as a stream of samples with a watermark of an hour: windows that end before it are final."""
    rows = port_stream(v).select("device", "event_id", F.col("ts").cast("timestamp").alias("ts"), _value(F.col("value")).cast("int").alias("pcm"))
    return rows.withWatermark("ts", "1 hour")


@query("j6_sessions_stream", f"""
  WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY device ORDER BY ts, event_id)) < 21600000000 THEN 0 ELSE 1 END AS new FROM port),
  s AS (SELECT *, sum(new) OVER (PARTITION BY device ORDER BY ts, event_id) AS session FROM g)
  SELECT device, epoch_us(min(ts)) // 1000000 AS start, count(*) AS n, min(event_id) AS first_id FROM s GROUP BY device, session HAVING epoch_us(max(ts)) + 21600000000 <= {CLOSED}""")
def _(v):
    return J.run_available(J.sessions(timed(v), "6 hours"))


@query("j7_frame_windows_stream", f"""
  SELECT epoch_us(ts) // 86400000000 * 86400 AS start, count(*) AS n, sum(pcm)::BIGINT AS total FROM sample GROUP BY 1 HAVING (start + 86400) * 1000000 <= {CLOSED}""")
def _(v):
    return J.run_available(J.windows(timed(v), "1 day"))


@query("j8_overlap_windows_stream", f"""
  SELECT (epoch_us(ts) // 21600000000 - k) * 21600 AS start, count(*) AS n, sum(pcm)::BIGINT AS total FROM sample, range(0, 2) t(k)
  WHERE epoch_us(ts) < ((epoch_us(ts) // 21600000000 - k) * 21600 + 28800) * 1000000 GROUP BY 1 HAVING (start + 28800) * 1000000 <= {CLOSED}""")
def _(v):
    return J.run_available(J.windows(timed(v), "8 hours", "6 hours"))


@query("j6_sessions", """
  WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY device ORDER BY ts, event_id)) < 21600000000 THEN 0 ELSE 1 END AS new FROM port),
  s AS (SELECT *, sum(new) OVER (PARTITION BY device ORDER BY ts, event_id) AS session FROM g)
  SELECT device, epoch_us(min(ts)) // 1000000 AS start, count(*) AS n, min(event_id) AS first_id FROM s GROUP BY device, session""")
def _(v):
    return J.sessions(v.port, "6 hours")


@query("j7_frame_windows", "SELECT epoch_us(ts) // 86400000000 * 86400 AS start, count(*) AS n, sum(pcm)::BIGINT AS total FROM sample GROUP BY 1")
def _(v):
    return J.windows(v.sample, "1 day")


@query("j8_overlap_windows", """
  SELECT (epoch_us(ts) // 21600000000 - k) * 21600 AS start, count(*) AS n, sum(pcm)::BIGINT AS total FROM sample, range(0, 2) t(k)
  WHERE epoch_us(ts) < ((epoch_us(ts) // 21600000000 - k) * 21600 + 28800) * 1000000 GROUP BY 1""")
def _(v):
    return J.windows(v.sample, "8 hours", "6 hours")


@query("j9_live_compare", "SELECT event_id AS key, floor(value * 64)::BIGINT AS a, floor(value * 64)::BIGINT + 1 AS b FROM events WHERE event_id % 97 < 5")
def _(v):
    left, right = port_stream(v), port_stream(v)
    changed = _value(F.col("value")) + F.when(F.col("event_id") % 97 < 5, 1).otherwise(0)
    return J.run_available(J.live_compare(left.select(F.col("event_id").alias("key"), "ts", _value(F.col("value")).alias("value")), right.select(F.col("event_id").alias("key"), "ts", changed.alias("value")), "30 days"))


MONTH = 30 * 24 * HOURS
#: Silence that no log reaches.
AGES = 12_000 * MONTH


@query("j9_live_counts", f"""
  WITH x AS (SELECT epoch_us(ts) // 86400000000 * 86400 AS start, event_id // 10 AS frame_no, event_id % 97 < 5 OR event_id % 211 = 0 AS bad FROM events)
  SELECT start, count(*) AS samples, (count(*) FILTER (WHERE bad))::BIGINT AS bad_samples, count(DISTINCT frame_no) FILTER (WHERE bad) AS bad_frames FROM x
  GROUP BY start HAVING (start + 86400) * 1000000 <= {passed(3600)}""")
def _(v):
    """One side lacks some samples, others differ."""
    rows = lambda s, value: s.select(F.col("event_id").alias("key"), "ts", F.expr("event_id div 10").alias("frame_no"), value.alias("value"))
    left, right = port_stream(v), port_stream(v)
    changed = _value(F.col("value")) + F.when(F.col("event_id") % 97 < 5, 1).otherwise(0)
    return J.run_available(J.live_counts(rows(left, _value(F.col("value"))), rows(right.where("event_id % 211 <> 0"), changed), "1 day", "1 hour"))


@query("j10_live_runs", f"""
  WITH e AS (SELECT * FROM events WHERE epoch_us(ts) <= {passed(3600)}),
  d AS (SELECT user_id AS series, event_id AS idx, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM e WHERE event_id % 97 < 5),
  r AS (SELECT series, min(idx) AS first, count(*) AS n FROM d GROUP BY series, island), m(length) AS (SELECT unnest([1, 2, 10, 50, 100]) UNION ALL SELECT k * 1000 FROM range(1, 1000) t(k)),
  l AS (SELECT user_id AS series, max(event_id) AS last FROM e GROUP BY user_id)
  SELECT r.series, 'run' AS kind, first, n FROM r JOIN l ON l.series = r.series WHERE last >= first + n UNION ALL SELECT series, 'alert', first, length FROM r JOIN m ON length <= n""")
def _(v):
    rows = logged(v).select(F.col("device").alias("series"), "ts", F.col("event_id").alias("idx"), (F.col("event_id") % 97 < 5).alias("differs"))
    return live(J.live_runs(rows, HOURS, MONTH, alerts=(1, 2, 10, 50, 100), buckets=BUCKETS))


@query("j11_recent_ring", """
  WITH d AS (SELECT device, event_id AS diff_at, lag(event_id) OVER (PARTITION BY device ORDER BY event_id) AS prev FROM port WHERE event_id % 97 < 5),
  c AS (SELECT d.device, diff_at, p.event_id AS pos, byte, row_number() OVER (PARTITION BY d.device, diff_at ORDER BY p.event_id DESC)::INT AS back FROM d JOIN port p ON p.device = d.device AND p.event_id <= diff_at AND (prev IS NULL OR p.event_id > prev))
  SELECT device, diff_at, pos AS "at", byte, back FROM c WHERE back <= 16""")
def _(v):
    """All rows, those of the last hour too; no device is forgotten."""
    rows = logged(v, ends_after=HOURS).withColumn("differs", (F.col("event_id") % 97 < 5) & (F.col("device") != NO_DEVICE))
    return live(J.recent_ring(rows, HOURS, AGES, buckets=BUCKETS))


@query("j12_pending_deferred", f"""
  WITH e AS (SELECT user_id AS channel, ts, event_id, CASE event_type WHEN 'view' THEN 'load' ELSE 'trigger' END AS kind FROM events WHERE event_type IN ('view', 'click') AND epoch_us(ts) <= (SELECT (max(epoch_us(ts)) // 1000 - 3600000) * 1000 FROM events WHERE event_type IN ('view', 'click'))),
  w AS (SELECT *, lag(kind) OVER (PARTITION BY channel ORDER BY ts, event_id) AS was, lag(event_id) OVER (PARTITION BY channel ORDER BY ts, event_id) AS load_id FROM e)
  SELECT channel, event_id AS trigger_id, load_id FROM w WHERE kind = 'trigger' AND was = 'load'""")
def _(v):
    rows = logged(v).where("byte in (171, 85)").select(F.col("device").alias("channel"), "ts", "event_id", F.when(F.col("byte") == 171, "load").otherwise("trigger").alias("kind"))
    return live(J.pending_deferred(rows, HOURS, MONTH, BUCKETS))


@query("a1_list_images")
def _(v):
    folder = f"{shared_folder(v.spark)}/archives-{uuid.uuid4().hex}"
    written = materialise(archives.write_sets(v.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("data")), folder), "sets")
    if written.isEmpty():
        return v.spark.createDataFrame([], "set string, file_no int, name string, size long, sha256 string")
    images = archives.load_images(v.spark, folder)
    return images.select(F.regexp_extract("set_id", "[^/]*$", 0).alias("set"), "file_no", "name", "size", F.sha2("content", 256).alias("sha256"))


@query("a7_write_extracts", "SELECT doc_id || '.raw' AS name, (coalesce(octet_length(encode(text)), 0) + 36)::BIGINT AS size, sha256(coalesce(text, '')) AS payload_sha256 FROM documents")
def _(v):
    """One file for each text under the shared folder, read back."""
    folder = f"{shared_folder(v.spark)}/extracts-{uuid.uuid4().hex}"
    texts = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    archives.write_extracts(v.documents.select(F.concat(F.col("doc_id").cast("string"), F.lit(".raw")).alias("name"), F.lit(0x94).alias("version"), texts.alias("payload")), folder)
    files = archives.read_extracts(v.spark, folder)
    return files.select("name", "size", F.sha2(F.expr("substring(content, 37)"), 256).alias("payload_sha256"))


#: Bytes of texts taken as codes that exist, in three versions.
PROGRAMS = """
  WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id AS id, doc_id % 3 AS v, array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: lpad(hex(('0x' || x)::INT % 20), 2, '0')), '') AS h FROM documents WHERE text IS NOT NULL),
  r AS (
    SELECT k, id, v, -1 AS seq, 0 AS place, 0 AS next_at, 0 AS wait, 1 AS opcode, '' AS operands FROM d
    UNION ALL
    SELECT k, id, v, seq + 1, next_at, next_at + 3 + n, wait, opcode, substr(h, 2 * next_at + 7, 2 * n) FROM (
      SELECT *, CASE WHEN v < 2 AND opcode = 6 THEN 0 WHEN v = 0 AND opcode = 4 THEN 3 ELSE [0, 5, 1, 2, 1, 1, 2, 2, 2, 2, 4, 4, 4, 0, 1, 0, 2, 4, 4, 0][opcode + 1] END AS n FROM (
        SELECT r.k, r.id, r.v, r.seq, r.next_at, h, TRY_CAST('0x' || substr(h, 2 * r.next_at + 1, 4) AS INT) AS wait, TRY_CAST('0x' || substr(h, 2 * r.next_at + 5, 2) AS INT) AS opcode
        FROM r JOIN d ON d.k = r.k WHERE r.wait <> 65535 AND r.opcode BETWEEN 1 AND 18 AND 2 * (r.next_at + 3) <= length(h)))
    WHERE 2 * (next_at + 3 + n) <= length(h))
  SELECT id, seq, place AS "offset", wait, opcode, operands FROM r WHERE seq >= 0"""


def programs(v):
    """(id, data, version): the bytes of texts, each modulo 20, as programs of three versions."""
    # each byte is a character of Latin-1; translate() would drop what it maps to character 0, so 20 stands for it at first
    whole = F.translate(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"), "".join(map(chr, range(256))), "".join(chr(k % 20 or 20) for k in range(256)))
    data = F.encode(F.replace(whole, F.lit(chr(20)), F.lit(chr(0))), "ISO-8859-1")
    m = F.col("doc_id") % 3
    return v.documents.where("text is not null").select(F.col("doc_id").alias("id"), data.alias("data"), F.when(m == 0, "1993a").when(m == 1, "1993b").otherwise("1995").alias("version"))


@query("a5_explode_programs", PROGRAMS)
def _(v):
    return archives.explode_programs(programs(v), "id", "data", "version")


@query("a10_read_port", "SELECT device, event_id, byte FROM port")
def _(v):
    return live(logged(v).select("device", "event_id", "byte"))


@query("a11_write_replies", "SELECT byte AS reply, count(*) AS n FROM port GROUP BY byte")
def _(v):
    return J.write_replies(port_stream(v).select(F.col("byte").alias("reply"), "event_id"))


@query("k1_sql_functions", "SELECT addr, ((addr * 4099 >> 21) & 7)::INT AS chip, addr * 4099 & 2097151 AS off, (addr * 37 & 2097151) | ((addr % 6) << 21) AS address, floor(n_frames::DOUBLE / 7.68::DOUBLE + 0.5::DOUBLE)::BIGINT AS frames FROM stream")
def _(v):
    archives.register_functions(v.spark)
    return v.stream.selectExpr("addr", "chip_of(addr * 4099) AS chip", "offset_of(addr * 4099) AS off", "address_of(addr % 6 + 2, addr * 37 & 2097151) AS address", "frames_of(n_frames) AS frames")


@query("k1_level_functions", """
  WITH RECURSIVE v AS (SELECT track_no, seq, level * 5 AS vol, level * 97 AS total, 255 - level AS own FROM instr),
  r AS (SELECT DISTINCT vol, 0 AS k, 16383::BIGINT AS x, 32152::BIGINT AS y FROM v UNION ALL SELECT vol, k + 1, CASE WHEN (vol >> k) & 1 = 0 THEN (x * y) >> 15 ELSE x END, (y * y) >> 15 FROM r WHERE k < 8),
  q AS (SELECT DISTINCT total, own, 0 AS k, own::BIGINT << 7 AS x, 31892::BIGINT AS y FROM v UNION ALL SELECT total, own, k + 1, CASE WHEN ((((total >> 6) & 1023) + 128) >> k) & 1 = 0 THEN (x * y) >> 15 ELSE x END, (y * y) >> 15 FROM q WHERE k < 8)
  SELECT track_no, seq, CASE WHEN v.vol = 0 THEN 0 ELSE r.x * 2 END AS gain, q.x * 2 AS attenuation FROM v JOIN r ON r.vol = v.vol AND r.k = 8 JOIN q ON q.total = v.total AND q.own = v.own AND q.k = 8""")
def _(v):
    archives.register_functions(v.spark)
    return v.instr.selectExpr("track_no", "seq", "gain_of(level * 5) AS gain", "attenuation_of(level * 97, 255 - level) AS attenuation")


@query("k2_program_rows", PROGRAMS)
def _(v):
    archives.register_program_rows(v.spark)
    return v.spark.sql("SELECT t.id, p.* FROM {d} t, LATERAL program_rows(t.data, t.version) p", d=programs(v))


@query("k2_program_table", PROGRAMS)
def _(v):
    archives.register_program_rows(v.spark)
    return v.spark.sql("SELECT * FROM program_table(TABLE(SELECT id, data, version FROM {d}))", d=programs(v))
