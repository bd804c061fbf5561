"""Queries of the listing operators and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cuebase.functions import scalar as S
from cuebase.operators import catalog
from cuebase.registry import query
from cuebase.sources.shared import shared_folder

#: Rules over the test texts, in order of priority.
TITLE_RULES = [(1, "German", "(^| )und( |$)"), (2, "French", "(^| )les( |$)"), (3, "Spanish", "(^| )que( |$)"), (4, "English", "(^| )the( |$)")]

STATS = """round(n_frames::DOUBLE * 0.00768::DOUBLE, 5) AS seconds, round((n_frames::BIGINT * 480)::DOUBLE / n_bytes::DOUBLE, 6) AS ratio,
  round((1.0::DOUBLE - n_bytes::DOUBLE / (n_frames::BIGINT * 480)::DOUBLE) * 100.0::DOUBLE, 4) AS saved"""
LINKS = """links AS (SELECT track_no, type, channel, CASE WHEN type > 1 THEN defer_code >> 8 END AS var_id, CASE WHEN type > 1 THEN defer_code & 255 END AS table_id
  FROM track WHERE channel BETWEEN 0 AND 7 AND type BETWEEN 1 AND 3)"""
RANGE = LINKS + """,
  st AS (SELECT (var_id & 255)::INT AS var_id, max(level) AS stored FROM instr WHERE opcode = 6 GROUP BY 1),
  rd AS (SELECT DISTINCT var_id FROM links WHERE type = 3),
  vr AS (SELECT coalesce(st.var_id, rd.var_id) AS var_id, coalesce(stored, 0) AS max_value FROM st FULL JOIN rd ON st.var_id = rd.var_id),
  ts AS (SELECT table_id, (max(max_value) + 1)::INT AS n FROM (SELECT DISTINCT table_id, var_id FROM links WHERE type = 3) l JOIN vr USING (var_id) GROUP BY table_id),
  te AS (SELECT table_id, pos::INT AS pos, (table_id * 97 + pos)::BIGINT AS track_no FROM ts, unnest(range(0, n)) x(pos)),
  ri AS (SELECT l.track_no AS from_track, l.table_id, te.pos, te.track_no FROM links l JOIN vr USING (var_id) JOIN te ON te.table_id = l.table_id AND te.pos = vr.max_value WHERE l.type = 3)"""
MNEMONIC = """(SELECT i.track_no, i.seq, i.opcode, i.channel, i.wait,
  CASE WHEN i.opcode = 0 THEN 'End;'
   WHEN i.opcode = 1 THEN 'Play(' || tag || 'stream $' || lpad(hex(addr), 6, '0') || CASE repeat_n WHEN 0 THEN ', repeat forever' WHEN 1 THEN '' ELSE ', repeat ' || repeat_n END || ');'
   WHEN i.opcode = 2 THEN 'Stop(channel ' || i.channel || ');'
   WHEN i.opcode = 3 THEN 'Queue(track $' || hex(addr) || ');'
   WHEN i.opcode = 4 AND version = '1993a' THEN 'SetChannelTimer(byte $' || lpad(hex(level & 255), 2, '0') || ', counter $' || lpad(hex(addr & 65535), 4, '0') || ');'
   WHEN i.opcode = 4 THEN 'WriteDataPort(byte $' || lpad(hex(level & 255), 2, '0') || ');'
   WHEN i.opcode = 5 THEN 'StartDeferred(channel ' || i.channel || ');'
   WHEN i.opcode = 6 THEN 'SetVariable(var $' || right(lpad(hex(var_id), 16, '0'), greatest(2, length(hex(var_id)))) || ', value $' || lpad(hex(level & 255), 2, '0') || ');'
   WHEN i.opcode BETWEEN 7 AND 12 THEN 'SetMixingLevel(' || tag || CASE i.opcode % 3 WHEN 1 THEN 'level' WHEN 2 THEN 'increase' ELSE 'decrease' END || ' ' || level || CASE WHEN i.opcode > 9 THEN ', steps ' || wait ELSE '' END || ');'
   WHEN i.opcode = 13 THEN 'NOP;'
   WHEN i.opcode = 14 AND repeat_n = 0 THEN 'Loop {' WHEN i.opcode = 14 THEN 'Loop (' || repeat_n || ') {' ELSE '}' END AS text
  FROM (SELECT i.*, CASE WHEN i.track_no % 4 = 1 THEN '1993a' ELSE '1994' END AS version, CASE WHEN i.channel IS NOT DISTINCT FROM t.channel THEN '' ELSE 'channel ' || i.channel || ', ' END AS tag FROM instr i LEFT JOIN track t ON t.track_no = i.track_no) i)"""


def versioned(v):
    """Steps of programs of two versions."""
    return v.instr.withColumn("version", F.when(F.col("track_no") % 4 == 1, "1993a").otherwise("1994"))


def kinds(v):
    """Streams with the kind and minor number of their format."""
    return v.stream.withColumns({"kind": (F.col("addr") % 3).cast("int"), "minor": F.shiftright(F.col("n_bytes"), 3).bitwiseAND(3).cast("int")})


def contents(v):
    """The tables that tracks refer to: as many entries as a variable has values, position p of table t names track 97 t + p."""
    used = catalog.valid_tracks(v.track).where("type = 3").select("table_id").distinct()
    return used.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(255)))).select("table_id", "pos", (F.col("table_id") * 97 + F.col("pos")).cast("bigint").alias("track_no"))


@query("d1_stream_list", f"""
  WITH p AS (SELECT DISTINCT addr FROM instr WHERE opcode = 1)
  SELECT p.addr, ((p.addr >> 21) & 7)::INT AS chip, p.addr & 2097151 AS "offset", n_frames, n_bytes, {STATS} FROM p JOIN stream s ON s.addr = p.addr""")
def _(v):
    return catalog.stream_list(v.instr, v.stream)


@query("b1_decode_address", 'SELECT track_no, seq, ((addr * 4099 >> 21) & 7)::INT AS chip, addr * 4099 & 2097151 AS "offset" FROM instr')
def _(v):
    a = F.col("addr") * 4099
    return v.instr.select("track_no", "seq", S.chip_of(a).alias("chip"), S.offset_of(a).alias("offset"))


@query("b2_encode_address", "SELECT addr, (addr * 37 & 2097151) | ((addr % 6)::BIGINT << 21) AS address FROM stream")
def _(v):
    return v.stream.select("addr", S.encode_address(F.col("addr") % 6 + 2, (F.col("addr") * 37).bitwiseAND(2097151)).alias("address"))


@query("b3_mnemonic", f"SELECT * FROM {MNEMONIC} m")
def _(v):
    return catalog.mnemonic(versioned(v), v.track)


@query("b4_hex_desc", """
  SELECT track_no, seq, lpad(hex(wait), 4, '0') || ' ' || lpad(hex(opcode), 2, '0') || CASE
    WHEN opcode = 1 THEN ' ' || lpad(hex(channel), 2, '0') || ' ' || lpad(hex(addr), 6, '0') || ' ' || lpad(hex(repeat_n), 2, '0')
    WHEN opcode IN (2, 5) THEN ' ' || lpad(hex(channel), 2, '0')
    WHEN opcode = 3 THEN ' ' || lpad(hex(addr & 65535), 4, '0')
    WHEN opcode = 4 THEN ' ' || lpad(hex(level & 255), 2, '0')
    WHEN opcode = 6 THEN ' ' || lpad(hex(var_id & 255), 2, '0') || ' ' || lpad(hex(level & 255), 2, '0')
    WHEN opcode BETWEEN 7 AND 9 THEN ' ' || lpad(hex(channel), 2, '0') || ' ' || lpad(hex(level & 255), 2, '0')
    WHEN opcode BETWEEN 10 AND 12 THEN ' ' || lpad(hex(channel), 2, '0') || ' ' || lpad(hex(level & 255), 2, '0') || ' ' || lpad(hex(wait), 4, '0')
    WHEN opcode = 14 THEN ' ' || lpad(hex(repeat_n), 2, '0') ELSE '' END AS bytes FROM instr""")
def _(v):
    return catalog.hex_desc(v.instr)


@query("b5_valid_tracks", f"WITH {LINKS} SELECT * FROM links")
def _(v):
    return catalog.valid_tracks(v.track)


@query("b6_play_refs", "SELECT track_no, seq, addr, channel, repeat_n FROM instr WHERE opcode = 1")
def _(v):
    return catalog.play_refs(v.instr)


@query("b7_to_frames", """
  SELECT event_id, floor(value * 1000.0::DOUBLE / 7.68::DOUBLE + 0.5::DOUBLE)::BIGINT AS frames, round(floor(value)::BIGINT::DOUBLE * 7.68::DOUBLE, 4) AS ms,
    CASE WHEN value - 1 < 0 THEN 'error' WHEN value - 1 = 0 THEN 'warning' END AS problem FROM events""")
def _(v):
    x = F.col("value")
    return v.events.select("event_id", S.to_frames(x, "sec").alias("frames"), F.round(S.to_ms(F.floor(x)), 4).alias("ms"), S.time_problem(x - 1).alias("problem"))


@query("b8_compression_stats", f"""
  SELECT addr, n_frames, n_bytes, p_brand, n_frames::BIGINT * 480 AS raw_bytes, {STATS}, round(n_bytes::DOUBLE * 8.0::DOUBLE / (n_frames::DOUBLE * 0.00768::DOUBLE), 3) AS bit_rate FROM stream""")
def _(v):
    return catalog.compression_stats(v.stream)


@query("b9_format_code", "SELECT addr, CASE WHEN addr % 3 = 0 THEN '1' ELSE (addr % 3)::INT || '.' || ((n_bytes >> 3) & 3)::INT END AS format FROM stream")
def _(v):
    return catalog.format_code(kinds(v))


@query("b10_classify_title", """
  SELECT doc_id AS id, CASE WHEN regexp_matches(text, '(?i)(^| )und( |$)') THEN 'German' WHEN regexp_matches(text, '(?i)(^| )les( |$)') THEN 'French'
    WHEN regexp_matches(text, '(?i)(^| )que( |$)') THEN 'Spanish' WHEN regexp_matches(text, '(?i)(^| )the( |$)') THEN 'English' ELSE '[Unknown]' END AS title FROM documents""")
def _(v):
    return catalog.classify_title(v.documents.select(F.col("doc_id").alias("id"), "text"), TITLE_RULES)


@query("b20_volume_gain", """
  WITH RECURSIVE v AS (SELECT track_no, seq, level * 5 AS vol FROM instr), 
  r AS (SELECT DISTINCT vol, 0 AS k, 16383::BIGINT AS x, 32152::BIGINT AS y FROM v
        UNION ALL SELECT vol, k + 1, CASE WHEN (vol >> k) & 1 = 0 THEN (x * y) >> 15 ELSE x END, (y * y) >> 15 FROM r WHERE k < 8)
  SELECT track_no, seq, CASE WHEN v.vol = 0 THEN 0 ELSE r.x * 2 END AS gain FROM v JOIN r ON r.vol = v.vol AND r.k = 8""")
def _(v):
    return v.instr.select("track_no", "seq", S.volume_gain(F.col("level") * 5).alias("gain"))


@query("b21_mix_attenuation", """
  WITH RECURSIVE v AS (SELECT track_no, seq, (level * 97) AS total, 255 - level AS vol FROM instr),
  r AS (SELECT DISTINCT total, vol, 0 AS k, (vol::BIGINT << 7) AS x, 31892::BIGINT AS y FROM v
        UNION ALL SELECT total, vol, k + 1, CASE WHEN ((((total >> 6) & 1023) + 128) >> k) & 1 = 0 THEN (x * y) >> 15 ELSE x END, (y * y) >> 15 FROM r WHERE k < 8)
  SELECT track_no, seq, r.x * 2 AS gain FROM v JOIN r ON r.vol = v.vol AND r.total = v.total AND r.k = 8""")
def _(v):
    return v.instr.select("track_no", "seq", S.mix_attenuation(F.col("level") * 97, 255 - F.col("level")).alias("gain"))


@query("b21_mix_attenuation_oldest", """
  WITH RECURSIVE v AS (SELECT track_no, seq, (level * 97) AS total FROM instr),
  r AS (SELECT DISTINCT total, 0 AS k, 32767::BIGINT AS x, 31892::BIGINT AS y FROM v
        UNION ALL SELECT total, k + 1, CASE WHEN ((((total >> 6) & 1023) + 128) >> k) & 1 = 0 THEN (x * y) >> 15 ELSE x END, (y * y) >> 15 FROM r WHERE k < 8)
  SELECT track_no, seq, r.x * 2 AS gain FROM v JOIN r ON r.total = v.total AND r.k = 8""")
def _(v):
    return v.instr.select("track_no", "seq", S.mix_attenuation(F.col("level") * 97, F.col("level"), oldest=True).alias("gain"))


@query("b24_format_compatible", """
  WITH s AS (SELECT addr, [37633, 37634, 37888][1 + addr % 3]::INT AS version, addr // 3 % 2 AS major FROM stream)
  SELECT addr, version, CASE WHEN version = 37633 OR version // 256 = 147 AND major = 0 THEN 'copy' ELSE 'encode' END AS action FROM s""")
def _(v):
    version = F.when(F.col("kind") == 0, 0x9301).when(F.col("kind") == 1, 0x9302).otherwise(0x9400)
    return catalog.format_compatible(kinds(v).withColumns({"version": version, "major": F.expr("addr div 3 % 2")}), 0x9301)


@query("b25_mmss", """
  WITH t AS (SELECT track_no, floor(sum(wait)::DOUBLE * 100.0::DOUBLE * 7.68::DOUBLE / 1000.0::DOUBLE)::BIGINT AS s FROM instr GROUP BY track_no)
  SELECT track_no, (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS time FROM t""")
def _(v):
    return catalog.track_times(v.instr).select("track_no", S.mmss(F.col("time") * 100).alias("time"))


@query("b26_play_length", """
  SELECT track_no, seq, i.addr, nullif(repeat_n, 0)::BIGINT * n_frames AS play_frames, n_frames, n_bytes FROM instr i JOIN stream s ON s.addr = i.addr WHERE opcode = 1""")
@query("c1_steps_with_streams", """
  SELECT track_no, seq, i.addr, nullif(repeat_n, 0)::BIGINT * n_frames AS play_frames, n_frames, n_bytes FROM instr i JOIN stream s ON s.addr = i.addr WHERE opcode = 1""")
def _(v):
    return catalog.steps_with_streams(v.instr, v.stream)


@query("c2_resolve_symbols", """
  WITH d AS (SELECT upper(n_name) AS u, min(n_nationkey) AS def_id FROM nation GROUP BY 1),
  r AS (SELECT c_custkey AS ref_id, CASE WHEN c_acctbal < 0 THEN n_name || ' owes' ELSE lower(n_name) END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT ref_id, def_id, CASE WHEN def_id IS NULL THEN 'unresolved' END AS problem FROM r LEFT JOIN d ON upper(r.name) = d.u""")
def _(v):
    refs = v.customer.join(v.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("ref_id"), F.when(F.col("c_acctbal") < 0, F.concat("n_name", F.lit(" owes"))).otherwise(F.lower("n_name")).alias("name")
    )
    defs = v.nation.select(F.col("n_nationkey").alias("def_id"), F.col("n_name").alias("name"))
    return catalog.resolve_symbols(refs, defs)


@query("c3_referenced_streams", "SELECT addr, n_bytes FROM stream WHERE addr IN (SELECT addr FROM instr WHERE opcode = 1)")
def _(v):
    return catalog.referenced_streams(v.instr, v.stream)


@query("c3_orphan_streams", "SELECT addr, n_bytes FROM stream WHERE addr NOT IN (SELECT addr FROM instr WHERE opcode = 1)")
def _(v):
    return catalog.orphan_streams(v.instr, v.stream)


@query("c5_check_table_bounds", f"""
  WITH {LINKS}, l AS (SELECT DISTINCT table_id, var_id FROM links WHERE type = 3),
  s AS (SELECT track_no, seq, (var_id & 255)::INT AS var_id, level FROM instr WHERE opcode = 6),
  z AS (SELECT DISTINCT table_id, 40 - table_id % 7 AS n FROM links WHERE type = 3 AND table_id % 5 <> 0)
  SELECT track_no, seq, s.var_id, level, l.table_id, CASE WHEN n IS NULL THEN 'no table' ELSE 'out of range' END AS problem
  FROM s JOIN l ON l.var_id = s.var_id LEFT JOIN z ON z.table_id = l.table_id WHERE n IS NULL OR level >= n""")
def _(v):
    sizes = catalog.valid_tracks(v.track).where("type = 3 and table_id % 5 <> 0").select("table_id", (F.lit(40) - F.col("table_id") % 7).cast("int").alias("n")).distinct()
    return catalog.check_table_bounds(v.instr, v.track, sizes)


@query("c6_resolve_indirect", f"WITH {RANGE} SELECT from_track, table_id, pos, track_no FROM ri")
def _(v):
    return catalog.resolve_indirect(v.instr, v.track, contents(v))


@query("c18_overlay", """
  WITH p AS (SELECT l_orderkey AS o_orderkey, l_extendedprice AS price FROM lineitem
             UNION ALL SELECT o_orderkey + 1000000000, o_totalprice FROM orders),
  g AS (SELECT o_orderkey, count(*) AS n, min(price) AS price FROM p GROUP BY 1)
  SELECT coalesce(o.o_orderkey, g.o_orderkey) AS o_orderkey, CASE WHEN n IS NULL OR n > 1 THEN o.o_totalprice WHEN o.o_orderkey IS NOT NULL THEN g.price END AS price,
    CASE WHEN n > 1 THEN 'patched twice' WHEN o.o_orderkey IS NULL THEN 'no target' WHEN n IS NOT NULL THEN 'patched' ELSE 'kept' END AS state
  FROM orders o FULL JOIN g ON g.o_orderkey = o.o_orderkey""")
def _(v):
    patch = v.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("price"))
    patch = patch.unionByName(v.orders.select((F.col("o_orderkey") + 1000000000).alias("o_orderkey"), F.col("o_totalprice").alias("price")))
    return catalog.overlay(v.orders.select("o_orderkey", F.col("o_totalprice").alias("price")), patch, "o_orderkey", "price")


@query("c19_search_path", """
  WITH f AS (SELECT page_id AS file_id, regexp_extract(url, '[^/]*$') AS name FROM pages), x AS (SELECT DISTINCT url AS path FROM pages),
  p(priority, prefix) AS (SELECT row_number() OVER (ORDER BY prefix), prefix FROM (SELECT DISTINCT regexp_extract(url, '^.*/') AS prefix FROM pages WHERE url IS NOT NULL)),
  h AS (SELECT file_id, min_by(prefix || name, priority) AS found FROM f, p JOIN x ON x.path = prefix || name GROUP BY file_id)
  SELECT f.file_id, coalesce(found, name) AS path, found IS NOT NULL AS "exists" FROM f LEFT JOIN h ON h.file_id = f.file_id""")
def _(v):
    files = v.pages.select(F.col("page_id").alias("file_id"), F.regexp_extract("url", "[^/]*$", 0).alias("name"))
    heads = v.pages.where("url is not null").select(F.regexp_extract("url", "^.*/", 0).alias("prefix")).distinct()
    # the order of prefixes is their own: no need to number them
    return catalog.search_path(files, heads.withColumn("priority", F.col("prefix")), v.pages.select(F.col("url").alias("path")))


@query("c20_prefix_lookup", """
  WITH k AS (SELECT DISTINCT upper(substr(n_name, 1, 3)) AS key FROM nation UNION SELECT lower(n_name) FROM nation UNION SELECT substr(p_name, 1, 9) FROM part),
  r AS (SELECT DISTINCT n_name AS name FROM nation UNION SELECT DISTINCT p_name FROM part),
  h AS (SELECT key, count(name) AS n, min(name) AS one, min(CASE WHEN lower(name) = lower(key) THEN name END) AS exact FROM k LEFT JOIN r ON starts_with(lower(name), lower(key)) GROUP BY key)
  SELECT key, coalesce(exact, CASE WHEN n = 1 THEN one END) AS name, CASE WHEN exact IS NOT NULL OR n = 1 THEN 'found' WHEN n = 0 THEN 'unknown' ELSE 'ambiguous' END AS state FROM h""")
def _(v):
    keys = v.nation.select(F.upper(F.substring("n_name", 1, 3)).alias("key")).union(v.nation.select(F.lower("n_name"))).union(v.part.select(F.substring("p_name", 1, 9))).distinct()
    names = v.nation.select(F.col("n_name").alias("name")).union(v.part.select("p_name")).distinct()
    return catalog.prefix_lookup(keys, names)


@query("c21_title_of", """
  WITH f AS (SELECT n_regionkey AS id, min_by(n_name, n_nationkey) AS title FROM nation WHERE n_regionkey <> 2 GROUP BY 1)
  SELECT s_suppkey AS supplier, (s_suppkey % 6)::INT AS id, coalesce(title, '[Unknown]') AS title FROM supplier LEFT JOIN f ON f.id = s_suppkey % 6""")
def _(v):
    rules = v.nation.where("n_regionkey <> 2").select(F.col("n_regionkey").alias("id"), F.col("n_name").alias("title"), F.col("n_nationkey").alias("priority"))
    ids = v.supplier.select(F.col("s_suppkey").alias("supplier"), (F.col("s_suppkey") % 6).cast("int").alias("id"))
    return ids.join(catalog.title_of(ids.select("id").distinct(), rules), "id")


@query("d4_variable_range", f"WITH {RANGE} SELECT var_id, max_value FROM vr")
def _(v):
    return catalog.variable_range(v.instr, v.track)


@query("d5_table_sizes", f"WITH {RANGE} SELECT table_id, n FROM ts")
def _(v):
    return catalog.table_sizes(v.instr, v.track)


@query("d6_indirect_tables", f"""
  WITH {RANGE}, e AS (SELECT table_id, string_agg(track_no::VARCHAR, ',' ORDER BY pos) AS tracks FROM te GROUP BY 1),
  n AS (SELECT table_id, string_agg(var_id::VARCHAR, ',' ORDER BY var_id) AS variables FROM (SELECT DISTINCT table_id, var_id FROM links WHERE type = 3) GROUP BY 1)
  SELECT e.table_id, tracks, variables FROM e JOIN n ON n.table_id = e.table_id""")
def _(v):
    return catalog.indirect_tables(v.instr, v.track, contents(v))


@query("d7_program_text", f"""
  WITH n0 AS (SELECT track_no, seq, sum(CASE opcode WHEN 14 THEN 1 WHEN 15 THEN -1 ELSE 0 END) OVER (PARTITION BY track_no ORDER BY seq) AS total FROM instr),
  n1 AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY track_no ORDER BY seq)) AS after FROM n0),
  n2 AS (SELECT track_no, seq, coalesce(lag(after) OVER (PARTITION BY track_no ORDER BY seq), 0)::INT AS depth FROM n1)
  SELECT m.track_no, string_agg(repeat('  ', depth) || CASE WHEN wait > 0 THEN 'Wait(' || wait || ') ' ELSE '' END || text, chr(10) ORDER BY m.seq) AS program
  FROM {MNEMONIC} m JOIN n2 ON n2.track_no = m.track_no AND n2.seq = m.seq GROUP BY m.track_no""")
def _(v):
    return catalog.program_text(versioned(v), v.track)


@query("d8_track_listing", """
  WITH t AS (SELECT track_no, sum(wait)::BIGINT AS time, bool_or(opcode = 14 AND repeat_n = 0) AS looping FROM instr GROUP BY track_no)
  SELECT r.track_no, r.channel, r_name AS type_name,
    CASE WHEN type = 1 THEN (floor(time * 7.68::DOUBLE / 1000)::BIGINT // 60) || ':' || lpad((floor(time * 7.68::DOUBLE / 1000)::BIGINT % 60)::VARCHAR, 2, '0') || CASE WHEN looping THEN ' (loop)' ELSE '' END END AS time,
    CASE WHEN type > 1 THEN lpad(hex(defer_code), 4, '0') END AS link
  FROM track r JOIN region ON r_regionkey = type LEFT JOIN t ON t.track_no = r.track_no""")
def _(v):
    return catalog.track_listing(v.track, v.instr, v.region.select(F.col("r_regionkey").alias("type"), F.col("r_name").alias("type_name")))


@query("d18_playback_summary", """
  WITH s AS (SELECT count(*) AS n_tracks, sum(time)::BIGINT AS frames FROM (SELECT track_no, sum(wait) AS time FROM instr GROUP BY track_no) JOIN track USING (track_no) WHERE type = 1)
  SELECT n_tracks, frames, (floor(frames * 7.68::DOUBLE / 1000)::BIGINT // 60) || ':' || lpad((floor(frames * 7.68::DOUBLE / 1000)::BIGINT % 60)::VARCHAR, 2, '0') AS time FROM s""")
def _(v):
    return catalog.playback_summary(v.track, v.instr)


@query("d23_dense_index", """
  WITH m AS (SELECT max(o_orderkey) AS top FROM orders) 
  SELECT n AS track_no, t.track_no IS NOT NULL AS present FROM m, unnest(range(0, top + 1)) x(n) LEFT JOIN (SELECT DISTINCT track_no FROM track WHERE type = 1) t ON t.track_no = n
  WHERE n <= (SELECT max(track_no) FROM track WHERE type = 1)""")
def _(v):
    return catalog.dense_index(v.track.where("type = 1"), "track_no")


@query("d24_duplicate_names", "SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def _(v):
    return catalog.duplicate_names(v.documents, "text")


@query("d26_oversized", "SELECT addr, n_bytes FROM stream WHERE n_bytes > (SELECT max(p_size) * 400 FROM part) - 16")
def _(v):
    largest = v.part.agg(F.max("p_size") * 400).first()[0] or 0
    return catalog.oversized(v.stream, largest)


@query("f1_by_address", "SELECT addr, n_frames, n_bytes FROM stream ORDER BY addr")
def _(v):
    return v.stream.select("addr", "n_frames", "n_bytes").orderBy("addr")


@query("f2_by_size_desc", "SELECT addr, n_bytes FROM stream ORDER BY n_bytes DESC, addr")
def _(v):
    return v.stream.select("addr", "n_bytes").orderBy(F.desc("n_bytes"), "addr")


@query("f4_largest_image", "SELECT p_brand, max(n_bytes) AS largest FROM stream GROUP BY p_brand")
def _(v):
    return v.stream.groupBy("p_brand").agg(F.max("n_bytes").alias("largest"))


@query("g1_edges_union", f"""
  WITH {RANGE} SELECT track_no AS src, addr AS dst, 'queue' AS kind FROM instr WHERE opcode = 3
  UNION ALL SELECT track_no, (var_id * 256 + table_id)::BIGINT, 'deferred' FROM links WHERE type = 2
  UNION ALL SELECT from_track, track_no, 'indirect' FROM ri""")
def _(v):
    return catalog.edges_union(v.instr, v.track, contents(v))


@query("g2_pass_through", """
  SELECT page_id AS file_no, url AS name, 'image' AS kind FROM pages WHERE contains(url, 'html') UNION ALL SELECT page_id, url, 'other' FROM pages WHERE NOT contains(url, 'html') OR url IS NULL""")
def _(v):
    rows = v.pages.select(F.col("page_id").alias("file_no"), F.col("url").alias("name"))
    hit = F.col("name").contains("html")
    return rows.where(hit).withColumn("kind", F.lit("image")).unionByName(rows.where(~F.coalesce(hit, F.lit(False))).withColumn("kind", F.lit("other")))


@query("a8_extract_manifest", """
  WITH p AS (SELECT addr, track_no, seq, row_number() OVER (PARTITION BY addr ORDER BY track_no, seq) AS k FROM instr WHERE opcode = 1),
  f AS (SELECT addr, track_no, row_number() OVER (PARTITION BY track_no ORDER BY seq) AS number FROM p WHERE k = 1)
  SELECT f.addr, 'set_' || right(lpad(hex(track_no), 16, '0'), greatest(4, length(hex(track_no)))) || '_' || lpad(number::VARCHAR, 2, '0') || '_' || lpad(hex(f.addr), 6, '0') || '.raw' AS file,
    CASE WHEN n_bytes IS NULL THEN 'missing' WHEN n_frames = 0 THEN 'empty' ELSE 'ok' END AS state, (coalesce(n_bytes, 0) + 36)::BIGINT AS size
  FROM f LEFT JOIN stream s ON s.addr = f.addr""")
def _(v):
    return catalog.extract_manifest(v.instr, v.stream)


@query("a8_manifest_counts", """
  WITH p AS (SELECT DISTINCT addr FROM instr WHERE opcode = 1)
  SELECT count(*) AS found, count(n_bytes) AS ok, count(*) - count(n_bytes) AS errors FROM p LEFT JOIN stream s ON s.addr = p.addr""")
def _(v):
    return catalog.manifest_counts(catalog.extract_manifest(v.instr, v.stream))


@query("a9_write_catalog", """
  WITH i AS (SELECT p_brand AS set_id, (p_partkey % 6)::INT AS slot, max(p_size * 10000) AS size, max(p_partkey * 7 % 65536) AS checksum FROM part GROUP BY 1, 2),
  s AS (SELECT DISTINCT set_id FROM i)
  SELECT s.set_id, k::INT AS slot, coalesce(size // 4096, 0)::BIGINT AS size_4k, CASE WHEN size IS NULL THEN 0 ELSE k * 256 END::INT AS chip_code, coalesce(checksum, 0)::BIGINT AS checksum
  FROM s, range(0, 8) x(k) LEFT JOIN i ON i.set_id = s.set_id AND i.slot = k""")
def _(v):
    images = v.part.select(F.col("p_brand").alias("set_id"), (F.col("p_partkey") % 6).cast("int").alias("slot"), (F.col("p_size") * 10000).alias("size"), (F.col("p_partkey") * 7 % 65536).alias("checksum"))
    return catalog.write_catalog(images)


@query("a9_saved_catalog", """
  WITH i AS (SELECT p_brand AS set_id, (p_partkey % 6)::INT AS slot, max(p_size * 10000) AS size, max(p_partkey * 7 % 65536) AS checksum FROM part WHERE p_partkey % 6 < 5 OR ends_with(p_brand, '1') GROUP BY 1, 2),
  c AS (SELECT set_id, slot, (size // 4096)::BIGINT AS size_4k, (slot * 256)::INT AS chip_code, (checksum + CASE WHEN ends_with(set_id, '1') THEN 1 ELSE 0 END)::BIGINT AS checksum FROM i)
  SELECT * FROM c WHERE slot < (SELECT coalesce(min(k), 8) FROM range(0, 8) x(k) WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.set_id = c.set_id AND d.slot = k AND d.size_4k > 0))""")
def _(v):
    """All sets are saved, some of them again with other images; then the index is read back."""
    path = f"{shared_folder(v.spark)}/catalog-{uuid.uuid4().hex}"
    again = F.col("p_brand").endswith("1")
    images = lambda rows, more: rows.select(F.col("p_brand").alias("set_id"), (F.col("p_partkey") % 6).cast("int").alias("slot"), (F.col("p_size") * 10000).alias("size"), (F.col("p_partkey") * 7 % 65536 + more).alias("checksum"))
    catalog.save_catalog(images(v.part.where("p_partkey % 6 < 5"), 0), path)
    catalog.save_catalog(images(v.part.where(again), 1), path)
    return catalog.read_catalog(v.spark, path)
