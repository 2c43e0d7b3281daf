"""One query per operator over the test tables, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelift.llm import (bpe, chat, decontaminate, exact_dedup, html_text, jaccard_join,
                          lexical_search, packing, quality, secret_scan, sharding, token_counts, whitening)
from linelift.llm.common import read_table


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; its folder is LINELIFT_TOKENIZERS, else the installed one."""
    folder = os.environ.get("LINELIFT_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


# Fixed value: how the byte-level vocabulary splits a text before its merges.
BPE_PATTERN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read_table(spark, sf_dir, "documents"), k=4, percent=85)


def op2_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return sharding.extendible_shards(
        docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
                    .alias("n_bytes")), limit=SHARD_BYTES)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"),
                           read_table(spark, sf_dir, "labels"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.conversation_digests(chat.format_conversations(turns.union(hard)))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"),
                                     tokenizer=tokenizer_path("byte_bpe_50k.json"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("blob")


def op7_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_dedup(
        read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read_table(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"),
                                      read_table(spark, sf_dir, "benchmark"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"),
                        tokenizer=tokenizer_path("word_bpe_49k.json"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"),
                          ranks=tokenizer_path("byte_bpe_50k.tiktoken"), pattern=BPE_PATTERN)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(read_table(spark, sf_dir, "embeddings"), components=8)
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(read_table(spark, sf_dir, "documents"),
                                        read_table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_jaccard_join, op2_extendible_shards, op3_quality, op4_chat_format, op5_token_counts,
    op6_secret_scan, op7_grace_dedup, op8_html_text, op9_decontaminate, op10_pack,
    op11_byte_bpe, op12_whitening, op13_ranked_search, pipeline)}

SHARD_BYTES = 1 << 20

_SHARD_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT), 48, '0') AS bits
  FROM documents),
s AS (
  SELECT left(bits, k) AS shard, k AS depth, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows
  FROM d, range(0, 49) r(k) GROUP BY ALL HAVING sum(n_bytes) <= {SHARD_BYTES} OR count(*) = 1),
f AS (
  SELECT bits, min(depth) AS depth FROM (SELECT DISTINCT bits FROM d) b JOIN s ON starts_with(bits, shard)
  GROUP BY bits)
SELECT doc_id, n_bytes, shard, f.depth::INTEGER AS depth, shard_bytes::BIGINT AS shard_bytes,
       shard_rows::BIGINT AS shard_rows
FROM d JOIN f USING (bits) JOIN s ON s.shard = left(bits, f.depth) AND s.depth = f.depth
"""

_DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id)
"""

_CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
c AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g'))
             + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 12
               ELSE 20 + length(role) + length(regexp_replace(role, '[^<\[\\]', '', 'g')) END) + 3
           AS formatted_chars,
         string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a'
                    ELSE 'x' END, '' ORDER BY turn, role, text) AS path
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars,
       regexp_full_match(path, 's?(ua)*u?') AND path <> 's' AS valid
FROM c
"""



def _spans_sql(rule: secret_scan.Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{rule.kind}' AS kind, {rank} AS rank, {int(rule.base)} AS base, s AS start, s + length(whole) AS stop
  FROM (
    SELECT doc_id, unnest(whole) AS whole, unnest(part) AS part, unnest(list_transform(range(1, len(whole) + 1),
             lambda k: list_sum(list_transform(gap[1:k], lambda x: length(x)))
                  + coalesce(list_sum(list_transform(whole[1:k - 1], lambda x: length(x))), 0))) AS s
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS whole,
                 regexp_extract_all(t, '{pattern}', {rule.group}) AS part,
                 string_split_regex(t, '{pattern}') AS gap
          FROM d WHERE regexp_matches(t, '{pattern}')))
  WHERE length(part) >= {rule.least}"""


_SECRETS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_spans_sql(r, i) for i, r in enumerate(secret_scan.RULES))}),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(concat_ws(':', kind, start::BIGINT, stop::BIGINT), ',' ORDER BY start, rank) FILTER (base = 1) AS base,
         string_agg(concat_ws(':', kind, start::BIGINT, stop::BIGINT), ',' ORDER BY start, rank) AS spans
  FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""

_TERMS = ("unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term")

_SEARCH_SQL = f"""
WITH t AS (SELECT doc_id, {_TERMS} FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
s AS (SELECT doc_id, sum(tf)::BIGINT AS words FROM f GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(words)::BIGINT AS total FROM s),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
      FROM f, c GROUP BY term, docs),
r AS (SELECT item_id, doc_id,
             sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * words * docs) // total))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN f USING (term) JOIN s USING (doc_id), c GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 10
"""

ORACLE_SQL = {
    "op2_extendible_shards": _SHARD_SQL,
    "op4_chat_format": _CHAT_SQL,
    "op6_secret_scan": _SECRETS_SQL,
    "op7_grace_dedup": _DEDUP_SQL,
    "op13_ranked_search": _SEARCH_SQL,
}
