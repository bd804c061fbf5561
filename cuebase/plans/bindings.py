"""Views that the operators run on, built from the test tables.

One SQL text serves Spark and DuckDB; where the dialects differ, both are given.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: name: (tables or views that it reads, Spark text, DuckDB text or None if equal)
TEXTS: dict[str, tuple[tuple[str, ...], str, str | None]] = {
    "instr": (
        ("lineitem",),
        """SELECT l_orderkey AS track_no,
             CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice)-1 AS BIGINT) AS seq,
             CAST(l_partkey % 16 AS INT) AS opcode, CAST(l_suppkey % 8 AS INT) AS channel, l_partkey AS addr,
             CAST(l_quantity AS INT) AS wait, CAST(l_quantity AS INT) AS level, l_suppkey AS var_id, CAST(l_linenumber % 3 AS INT) AS repeat_n FROM {lineitem}""",
        None,
    ),
    "track": (
        ("orders",),
        """SELECT o_orderkey AS track_no, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS type,
             CAST(o_custkey % 8 AS INT) AS channel, CAST(o_custkey*41 % 65536 AS INT) AS defer_code FROM {orders}""",
        None,
    ),
    "stream": (
        ("part",),
        "SELECT p_partkey AS addr, p_size*10 AS n_frames, CAST(p_size*10*(20 + p_partkey % 40) + 18 AS BIGINT) AS n_bytes, p_brand FROM {part}",
        None,
    ),
    "sample": (
        ("events",),
        """SELECT user_id AS series, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id)-1 AS BIGINT) AS idx,
             event_id, ts, CAST(floor(value*64) AS INT) AS pcm FROM {events}""",
        None,
    ),
    "frame": (
        ("embeddings",),
        """SELECT label AS stream, vec_id AS frame_no, bin, CAST(floor(CAST(x AS DOUBLE)*32768+0.5) AS INT) AS q
             FROM {embeddings} LATERAL VIEW posexplode(embedding) AS bin, x""",
        """SELECT label AS stream, vec_id AS frame_no, CAST(i-1 AS INT) AS bin,
             CAST(floor(CAST(embedding[i] AS DOUBLE)*32768+0.5) AS INT) AS q FROM {embeddings}, range(1,65) r(i)""",
    ),
    # the same with frames numbered within each stream, so that numbers repeat
    "take": (
        ("embeddings",),
        """SELECT CAST(vec_id % 10 AS INT) AS stream, vec_id DIV 10 AS frame_no, bin, CAST(floor(CAST(x AS DOUBLE)*32768+0.5) AS INT) AS q
             FROM {embeddings} LATERAL VIEW posexplode(embedding) AS bin, x""",
        """SELECT CAST(vec_id % 10 AS INT) AS stream, vec_id // 10 AS frame_no, CAST(i-1 AS INT) AS bin,
             CAST(floor(CAST(embedding[i] AS DOUBLE)*32768+0.5) AS INT) AS q FROM {embeddings}, range(1,65) r(i)""",
    ),
    "blob": (
        ("documents",),
        "SELECT doc_id, hex(encode(text,'UTF-8')) AS h FROM {documents}",
        "SELECT doc_id, hex(encode(text)) AS h FROM {documents}",
    ),
    "port": (
        ("events",),
        """SELECT user_id AS device, ts, event_id, CASE event_type WHEN 'click' THEN 85 WHEN 'view' THEN 171 WHEN 'purchase' THEN 84
             WHEN 'signup' THEN 1 ELSE 194 END AS byte FROM {events}""",
        None,
    ),
    "pcm2": (
        ("sample",),
        """SELECT series, idx, event_id, event_id DIV 10 AS frame_no, pcm AS a, pcm + CASE WHEN event_id % 97 < 5 THEN 1 ELSE 0 END AS b FROM {sample}""",
        """SELECT series, idx, event_id, event_id // 10 AS frame_no, pcm AS a, pcm + CASE WHEN event_id % 97 < 5 THEN 1 ELSE 0 END AS b FROM {sample}""",
    ),
    "edge": (("orders",), "SELECT o_orderkey AS src, o_custkey AS dst FROM {orders}", None),
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Views:
    """Tables and views of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name not in TEXTS:
            raise AttributeError(name)
        needs, text, _ = TEXTS[name]
        return self.spark.sql(text, **{n: getattr(self, n) for n in needs})


def with_views(sql: str) -> str:
    """The DuckDB text with a CTE in front for every view that it names."""
    used: list[str] = []

    def add(name: str) -> None:
        for n in TEXTS[name][0]:
            if n in TEXTS:
                add(n)
        if name not in used:
            used.append(name)

    for name in TEXTS:
        if re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", sql):
            add(name)
    ctes = [f"{n} AS ({(TEXTS[n][2] or TEXTS[n][1]).format(**{t: t for t in TEXTS[n][0]})})" for n in used]
    body = sql.strip()
    recursive = bool(re.match(r"(?i)WITH\s+RECURSIVE\b", body))
    if m := re.match(r"(?i)WITH(\s+RECURSIVE)?\s+", body):
        ctes.append(body[m.end():])
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes)
    return (f"WITH {', '.join(ctes)}\n" if ctes else "") + body
