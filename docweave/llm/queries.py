"""Queries of the training-data operators: ``opN_<name>`` over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import bpe, chat, langid, mixing, ordermin, sharding, simhash, tokenio, topk, urlfilter
from docweave.llm._common import stage, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    found = sharding.assign(docs, ["doc_id", "text_crc32", "size"], 8)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = stage(
        docs.select("doc_id", "source", mixing.words_in(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")), "sized"
    )
    found = mixing.draws(slim, F.col("size"), ["doc_id", "text_hash"])
    return found.select(
        "doc_id",
        "size",
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.size("__shards") * F.col("size")).cast("long").alias("taken"),
        F.array_join(F.col("__shards").cast("array<string>"), ",").alias("shards"),
    )


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op5_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, urlfilter.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
       ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
     split AS (SELECT row_number() OVER () AS n, page_id, coalesce(substr(url, nullif(instr(url, '://'), 0) + 3), '') AS rest FROM pages),
     urls AS (SELECT n, page_id,
                translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
     fits AS (SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                arg_max(verdict, length(rule_host || rule_path)) AS verdict
              FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
              GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN fits USING (n)
"""


def op6_ordermin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = tokenio.data_set_path(spark, "documents")
    tokenio.write_ids(tokenio.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2), path)
    return tokenio.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_turns(turns.unionByName(more)))


OP8_SQL = r"""
WITH rows AS (SELECT conv_id, turn, role, text FROM conversations
              UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
     turns AS (SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS t, coalesce(role = 'assistant', false) AS learned FROM rows),
     sizes AS (SELECT *, list_sum(list_transform([r, t], lambda x: 3 * length(x) - length(replace(x, '\', ''))
                  - length(regexp_replace(x, '#{3,}', '', 'g')) + (length(x) - length(replace(x, '</turn>', ''))) // 7))
                + length(r) - length(replace(r, ':', '')) + length('### : </turn>' || chr(10)) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
  CAST(sum(CASE WHEN learned THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN learned THEN t ELSE '' END, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sizes GROUP BY conv_id
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.n AS qn, q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.n <> c.n AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY qn ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""


QUERIES = {"op1_simhash": op1_simhash, "op2_langid": op2_langid, "op3_sharding": op3_sharding, "op4_mixing": op4_mixing, "op5_urlfilter": op5_urlfilter, "op6_ordermin": op6_ordermin, "op7_token_ids": op7_token_ids, "op8_chat": op8_chat, "op9_bpe": op9_bpe, "op10_topk": op10_topk}

ORACLE: dict[str, str] = {"op5_urlfilter": OP5_SQL, "op8_chat": OP8_SQL, "op10_topk": OP10_SQL}
