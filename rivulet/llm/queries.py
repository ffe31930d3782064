"""The queries of this subpackage: ``op<N>_<name>`` over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    own = r"\### Assistant: </turn> ok"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    path = _tokenizer("byte_bpe_50k.json")
    return chat.read_back(chat.format_conversations(rows.union(more), path), path)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secretscan

    return secretscan.find(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokenfiles

    folder, manifest = tokenfiles.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer("byte_bpe_50k.json"))
    return tokenfiles.read_documents(spark, folder, manifest)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pages

    return pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    found = simhash.groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, budget=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import phrases

    return phrases.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.digest(pii.detect(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_secret_scan, op3_token_files, op4_main_text, op5_simhash, op6_repeated_passages, op7_quality, op8_pii, op9_decontamination, op10_bpe)}

_OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), written AS (
  SELECT *, replace(replace(role, '\', '\\'), '<|', '<\|') AS r, replace(replace(text, '\', '\\'), '<|', '<\|') AS t FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|turn|>') + length(r) + length('<|text|>') + length(t) + length('<|end|>')) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""

_OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
shared AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN shared USING (s), range(0, 13) AS r(k) WHERE least < doc_id),
word AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

_OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM w, unnest(range(1, len(w) - 6)) AS t(i)),
twice AS (SELECT doc_id, s FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win JOIN twice USING (doc_id, s), range(0, 8) AS r(k) GROUP BY doc_id),
line AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM d, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i)),
judged AS (
  SELECT doc_id, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM line
), failed AS (
  SELECT doc_id, len(w) AS n, again,
    again
    OR (len(w) <= 25 AND regexp_matches(line, '(?i)all rights reserved|\b(?:licen[sc]ed|released|distributed) under\b|\bcopyright (?:©|\(c\)|\d{4})|\bcookies?\b.*\b(?:accept|policy|consent)|\bprivacy policy\b|\bterms (?:of (?:use|service)|and conditions)\b|\bsubscribe (?:now|to)\b|\bclick here\b|\bsign (?:in|up) (?:to|for|now)\b|\benable javascript\b|\blorem ipsum\b|tous droits réservés|politique de confidentialité|\bcliquez ici\b|\babonnez-vous\b|alle rechte vorbehalten|datenschutzerklärung|\bhier klicken\b|\bjetzt abonnieren\b|todos los derechos reservados|política de privacidad|\bhaga clic aquí\b|\bsuscríbase\b'))
    OR length(line) - length(replace(line, '|', '')) >= greatest(2, 0.15 * len(w))
    OR (len(w) >= 3 AND length(line) - length(translate(line, '#*$%&|<>', '')) > 0.6 * len(w))
    OR (len(w) >= 3 AND (length(line) - length(replace(line, '!!', ''))) / 2 > 0.3 * len(w))
    OR (len(w) >= 4 AND len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x)) > 0.6 * len(w))
    OR (len(w) >= 10 AND len(list_distinct(w)) < 0.35 * len(w) AND (len(list_filter(range(1, len(w)), lambda k: w[k] = w[k + 1])) > 0.3 * len(w) OR len(list_distinct(w)) < 0.1 * len(w)))
    OR (len(w) > 15 AND NOT regexp_matches(line, '[.!?;:,。！？؟…]')) AS fails
  FROM judged WHERE len(w) > 0
), sums AS (
  SELECT doc_id, count(*) FILTER (WHERE again) AS dup, coalesce(sum(n) FILTER (WHERE NOT fails), 0) AS left_words FROM failed GROUP BY doc_id
), counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(left_words, 0) AS BIGINT) AS kept_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN sums USING (doc_id)
), based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND kept_words >= 0.5 * n_words AS kept, kept_words FROM based
"""

ORACLE = {"op6_repeated_passages": _OP6_SQL, "op7_quality": _OP7_SQL, "op1_chat_formatting": _OP1_SQL}
