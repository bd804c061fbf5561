"""URL filter: host-suffix and path-prefix expressions, hash-prefix equi-join, digest check, rule precedence.

Native: DataFrame functions only.  A URL's expressions are all pairs of a
suffix of its host (at label borders) and a prefix of its path (at the lengths
that occur among the rules).  Rules and expressions meet on the first 32 bits of
their SHA-256; the full digest then decides, and the longest rule wins.

Defined cases: a null URL or one without `://` has empty host and path and is
judged by the default; null or empty rules are ignored; equal rules that differ in action
count as block; of rules of equal length the one with the longer host wins;
repeated URLs are judged once and every row is returned; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuebase.llm.common import broadcast_if

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rules to be broadcast; more are shuffled on the hash prefix.
RULES_MOST = 1_000_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """rules: (host, path, action).  One row per page: id, host, path, rule, verdict."""
    rules = rules.where("host is not null and path is not null and action is not null and host <> ''")
    rules = rules.groupBy(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path")).agg(F.max("action").alias("action"))
    text = F.concat("r_host", F.lit("\n"), "r_path")
    rules = rules.withColumn("digest", F.sha2(text, 256)).withColumn("short", F.substring("digest", 1, 8))
    facts = rules.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.length("r_path"))).alias("lengths")).first()

    own = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.lit(list(facts.lengths) or [0]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    asked = (
        own.select("host", "path").where("host <> ''").distinct()
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("x_digest", F.sha2(F.concat("suffix", F.lit("\n"), "prefix"), 256))
        .withColumn("x_short", F.substring("x_digest", 1, 8))
    )
    found = asked.join(broadcast_if(rules, facts.n, RULES_MOST), (F.col("x_short") == F.col("short")) & (F.col("x_digest") == F.col("digest")))
    size = F.length("r_host") + F.length("r_path")
    best = found.groupBy("host", "path").agg(F.max(F.struct(size.alias("size"), F.length("r_host").alias("long"), "action", "r_host", "r_path")).alias("best"))
    return own.join(best, ["host", "path"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.concat("best.r_host", "best.r_path").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
