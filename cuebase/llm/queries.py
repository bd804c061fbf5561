"""One query for each training-data operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuebase.llm import language, toxicity
from cuebase.llm.common import table
from cuebase.llm.decontaminate import find_leaks
from cuebase.llm.exact_dedup import exact_copies
from cuebase.llm.hard_negatives import mine_negatives
from cuebase.llm.line_dedup import dedup_lines
from cuebase.llm.mixing import poisson_mix, temperature_weights
from cuebase.llm.ngram_join import ngram_jaccard_join
from cuebase.llm.ranked_search import ranked_search
from cuebase.llm.shards import shard_by_bytes
from cuebase.llm.substring_dedup import shared_passages, substring_dedup
from cuebase.llm.tiff import store_texts, tiff_digests
from cuebase.llm.url_filter import filter_urls

#: The rules that op7_url_filters applies.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = substring_dedup(docs, least=400).select(
        "key",
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
    # texts are not shuffled for the last column: only digests are joined
    shared = shared_passages(docs, least=51).withColumn("shares_passage", F.lit(1))
    return digest.join(shared, "key", "left").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("shares_passage", F.lit(0)).alias("shares_passage"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "pages"), ratio=0.1, least_seen=2)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff_digests(store_texts(table(spark, sf_dir, "documents")), "doc_id").drop("pages", "error")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), 16)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def id_remainder(m: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % m


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.where(id_remainder(5) != 0).select("lang", "text", F.xxhash64("doc_id").alias("pick"))
    found = language.identify(docs, labelled)
    return found.select("doc_id", F.coalesce(id_remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_langs")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(id_remainder(3) != 1)
    weights, bias = toxicity.learn(toxicity.labelled_texts(docs, labels))
    scored = toxicity.score_toxicity(docs, weights, bias)
    return scored.select("doc_id", F.coalesce(id_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = poisson_mix(docs, temperature_weights(docs, power=0.5), seed=1)
    return mixed.select("doc_id", "source", F.round("rate", 6).alias("rate"), "copies", "copy", "shuffle_key")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return mine_negatives(vectors, F.col("id") % 100 == 0, positives=5, negatives=10, band=(30, 90), scale=256)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents"), keep="largest")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_line_dedup": op3_line_dedup,
    "op4_media_columns": op4_media_columns,
    "op5_decontamination": op5_decontamination,
    "op6_sharding": op6_sharding,
    "op7_url_filters": op7_url_filters,
    "op8_language_id": op8_language_id,
    "op9_toxicity": op9_toxicity,
    "op10_source_mixing": op10_source_mixing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_ranked_search": op12_ranked_search,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": r"""
        WITH t AS (
          SELECT page_id,
                 translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script *>|<style\b.*?</style *>|<head\b.*?</head *>|<!--.*?-->', chr(10), 'g'),
                   '(?i)</?(?:a|abbr|b|big|cite|code|em|font|i|mark|q|s|small|span|strong|sub|sup|tt|u)(?:[ \t\n\r\f][^>]*)?>', '', 'g') AS body
          FROM pages),
        l AS (SELECT page_id, host, list_filter(list_transform(regexp_split_to_array(body, '[ \t\r\f]*(?:<[^>]*>|\n)[ \t\r\f]*'), lambda x: trim(x)), lambda x: x <> '') AS lines FROM t),
        h AS (SELECT host, count(*) AS pages FROM l GROUP BY host),
        e AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM l) GROUP BY host, line),
        b AS (SELECT e.host, list(line) AS often FROM e JOIN h USING (host) WHERE n >= 2 AND n > 0.1 * pages GROUP BY e.host),
        k AS (SELECT l.page_id, l.host, l.lines, list_filter(l.lines, lambda x: b.often IS NULL OR NOT list_contains(b.often, x)) AS stay FROM l LEFT JOIN b USING (host))
        SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(stay))::BIGINT AS n_removed, array_to_string(stay, chr(10)) AS kept FROM k
    """,
    "op7_url_filters": r"""
        WITH u AS (
          SELECT page_id,
                 translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
          FROM pages),
        r(r_host, r_path, action) AS (VALUES ('org','/','allow'), ('example.org','/es/','block'), ('example.org','/en/1','block'), ('com','/fr/','allow'), ('com','/de/','block')),
        m AS (SELECT u.page_id, u.host, u.path, r.*, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r_host) + length(r_path) DESC) AS k
              FROM u JOIN r ON (u.host = r.r_host OR ends_with(u.host, '.' || r.r_host)) AND starts_with(u.path, r.r_path))
        SELECT u.page_id, u.host, u.path, m.r_host || m.r_path AS rule, coalesce(m.action, 'allow') AS verdict
        FROM u LEFT JOIN m ON m.page_id = u.page_id AND m.k = 1
    """,
    "op10_source_mixing": r"""
        WITH RECURSIVE s AS (SELECT source, sum(coalesce(strlen(text), 0))::BIGINT AS bytes FROM documents GROUP BY source),
        w AS (SELECT source, bytes, sqrt(bytes::DOUBLE) AS weight FROM s),
        r AS (SELECT source, CASE WHEN bytes > 0 THEN (SELECT sum(bytes) FROM w)::DOUBLE * weight / (SELECT sum(weight) FROM w) / bytes ELSE 0.0 END AS rate FROM w),
        p(source, rate, k, p, c) AS (
          SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
          UNION ALL
          SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM p WHERE k < ceil(rate + 12.0 * sqrt(rate)) + 30),
        d AS (SELECT doc_id, source, ('0x' || substr(md5('1|1|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
        n AS (SELECT d.doc_id, d.source, any_value(p.rate) AS rate, count(*) FILTER (WHERE p.c <= d.u)::INT AS copies
              FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source GROUP BY d.doc_id, d.source)
        SELECT doc_id, source, round(rate, 6) AS rate, copies, copy::INT AS copy, md5('1 order|' || copy || '|' || doc_id) AS shuffle_key
        FROM n, unnest(range(1, copies + 1)) x(copy)
    """,
    "op11_hard_negatives": r"""
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, list_inner_product(a.e, v.e)::BIGINT AS score FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
    """,
    "op12_ranked_search": r"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
        l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
        s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM l),
        d AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
        i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        q AS (SELECT item_id, term, count(*) AS qtf FROM i GROUP BY item_id, term),
        w AS (SELECT item_id, term, qtf * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM q JOIN d USING (term), s),
        m AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM l, s),
        x AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM w JOIN p USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM x WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
    """,
    "op13_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
        FROM t JOIN g USING (text)
    """,
}
