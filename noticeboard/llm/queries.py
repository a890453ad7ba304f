"""Registered queries of the training-data operators: name -> (query, SQL twin or None)."""
from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, fingerprints, language_id, line_dedup, merkle, minhash, mixing, ngram_join, packing, pii, quality_rules, sharding, token_files
from .common import documents, shared_folder
from .tokens import tokenizer_path

WEIGHTS = (3, 1, 2)


def op1_sharding(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
                       F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    dealt = sharding.shuffle_to_shards(rows, ["doc_id", "text_crc32"], shards=24, seed=20)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op2_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf))


def op3_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    found = ngram_join.link_documents(documents(spark, sf), width=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op4_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf))
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


# the thresholds and words are written out here, so that a change in the operator's table shows
OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT k, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) AS g, unnest(range(1, len(words) - 6)) AS i FROM w),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n > 1),
c AS (SELECT k, CAST(sum(least(8, i - before)) AS BIGINT) AS n_repeat_words FROM (SELECT k, i, coalesce(lag(i) OVER (PARTITION BY k ORDER BY i), -7) AS before FROM r) GROUP BY k),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
  len(list_filter(words, lambda x: lower(x) IN ('the','of','and','to','in','is','that','for','with','as','are','be','at','on','by','it','or','from','was',
   'le','la','les','de','des','du','et','un','une','en','est','que','qui','dans','pour','au','ce','se','der','die','das','und','zu','den','von','mit','ist',
   'ein','eine','nicht','sich','auf','im','dem','el','los','las','y','del','por','con','una','es','no','su','lo'))) AS n_stop,
  len(list_filter(words, lambda x: regexp_matches(x, '\\p{L}'))) AS n_alpha,
  len(list_filter(lines, lambda x: regexp_matches(x, '^[ \\t]*[*\u2022-]'))) AS n_bullet,
  len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|\u2026)[ \\t\\r]*$'))) AS n_dots FROM w LEFT JOIN c USING (k)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words <= 100000 AND word_chars >= 2.5 * n_words AND word_chars <= 12 * n_words AND n_symbols <= 0.1 * n_words
  AND n_stop >= 0.01 * n_words AND n_alpha >= 0.7 * n_words AND n_dup_lines <= 0.5 * n_lines AND n_bullet <= 0.9 * n_lines AND n_dots <= 0.3 * n_lines AS kept FROM b
"""


def op5_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, sf))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in ("email", "ip", "card", "phone")), F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
                        pii.written(F.col("spans")).alias("spans"))


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    deduped = line_dedup.dedup_lines(documents(spark, sf), every_position=True, short_lines=True)
    return deduped.select("doc_id", "text", "n_lines", "n_removed")


def op7_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """All pages by markup and address, and all documents by text with their source as host."""
    docs = documents(spark, sf)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    key = lambda doc, page: F.struct(doc.cast("long").alias("doc_id"), page.cast("long").alias("page_id")).alias("key")
    null = F.lit(None)
    rows = pages.select(key(null, F.col("page_id")), F.col("url").alias("address"), "html", null.cast("string").alias("text")).union(
        docs.select(key(F.col("doc_id"), null), F.col("source").alias("address"), null.cast("string").alias("html"), F.coalesce("text", F.lit("")).alias("text")))
    found = language_id.identify(rows, *language_id.train(docs.select("doc_id", "text", "lang")))
    return found.select("key.doc_id", "key.page_id", "lang", F.round("probability", 6).alias("probability"), "text_lang", "declared", "host")


def op8_token_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark)
    token_files.write_tokens(documents(spark, sf), folder, tokenizer_path(), end_id=1)
    return token_files.document_digests(spark, folder)


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix_copies(documents(spark, sf), WEIGHTS)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP9_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
o AS (SELECT *, 2.0E0 * source_size / w AS ratio FROM r),
c AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
  sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM o),
l AS (SELECT max(CAST(150 * (SELECT sum(source_size) FROM s) - 100 * full_before AS DOUBLE) / CAST(100 * free AS DOUBLE)) AS level FROM c
  WHERE CAST(150 * (SELECT sum(source_size) FROM s) - 100 * full_before AS DOUBLE) / CAST(100 * free AS DOUBLE) < ratio),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR w * level >= 2 * source_size THEN CAST(2 * source_size AS DOUBLE) ELSE w * level END AS target FROM r, l),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0E0 END AS rate,
  CAST(('0x' || substring(md5('9:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0E0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM j
"""


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(documents(spark, sf), tokenizer_path(), capacity=2048, end_id=0)


def op11_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.align_documents(documents(spark, sf), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.when(picked, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))
    return merkle.verify(merkle.manifest_of(docs, tampered=lowered))


def op13_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.link_near_duplicates(documents(spark, sf), width=5, num=85, den=100)


QUERIES = {
    "op1_sharding": (op1_sharding, None),
    "op2_fingerprints": (op2_fingerprints, None),
    "op3_ngram_join": (op3_ngram_join, None),
    "op4_quality_rules": (op4_quality_rules, OP4_SQL),
    "op5_pii": (op5_pii, None),
    "op6_line_dedup": (op6_line_dedup, None),
    "op7_language_id": (op7_language_id, None),
    "op8_token_files": (op8_token_files, None),
    "op9_mixing": (op9_mixing, OP9_SQL),
    "op10_packing": (op10_packing, None),
    "op11_alignment": (op11_alignment, None),
    "op12_merkle_manifest": (op12_merkle_manifest, None),
    "op13_minhash": (op13_minhash, None),
}
