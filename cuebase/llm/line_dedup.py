"""Line dedup by site-relative frequency: drop lines that most pages of a host repeat.

Native: DataFrame functions only.  A page's lines are its visible text, cut at
block tags and line ends.  For each host, the number of pages that hold a line is divided by the
number of its pages; lines above the boilerplate ratio go, from every page of
that host.  A host has at most (mean lines of a page) / ratio such lines, so they travel as one
array for each host, and texts are never regrouped.  The lines are cut once and written,
and both the counting and the result read them.

Defined cases: null html has no lines; a null URL, or one without a host, belongs to the
host ''; lines on fewer than least_seen pages of their host (two at least) stay, and so does
a line on exactly the ratio of its pages; a line counts once for each page, and repeated
pages count as pages; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuebase.llm.common import broadcast_if, materialise
from cuebase.llm.url_filter import host_of

#: What is not text, tags inside a line, and what ends a line.
HIDDEN = r"(?is)<script\b.*?</script *>|<style\b.*?</style *>|<head\b.*?</head *>|<!--.*?-->"
INLINE = r"(?i)</?(?:a|abbr|b|big|cite|code|em|font|i|mark|q|s|small|span|strong|sub|sup|tt|u)(?:[ \t\n\r\f][^>]*)?>"
BREAK = r"[ \t\r\f]*(?:<[^>]*>|\n)[ \t\r\f]*"
#: Most hosts whose boilerplate is sent to every task; more are shuffled.
HOSTS_MOST = 100_000


def lines_of(html: Column) -> Column:
    """The non-blank lines of a page's visible text."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n"), INLINE, "")
    return F.filter(F.transform(F.split(text, BREAK), lambda x: F.trim(x)), lambda x: x != "")


def dedup_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = 0.5, least_seen: int = 5) -> DataFrame:
    """One row per page: id, host, n_lines, n_removed, kept (the text left, one line each)."""
    own = materialise(pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), lines_of(F.col(html_col)).alias("lines")), "lines")
    totals = own.groupBy("host").agg(F.count("*").alias("pages"))
    held = own.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    often = held.where(F.col("n") >= max(2, least_seen)).join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    often = materialise(often.groupBy("host").agg(F.collect_list("line").alias("often")), "boilerplate")
    marked = own.join(broadcast_if(often, often.count(), HOSTS_MOST), "host", "left")
    kept = F.filter("lines", lambda x: F.col("often").isNull() | ~F.array_contains("often", F.xxhash64(x)))
    return marked.withColumn("stay", kept).select(
        F.col("id").alias(id_col), "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("stay")).cast("long").alias("n_removed"), F.array_join("stay", "\n").alias("kept")
    )
