"""A training corpus from raw documents, in four stages.

Each stage takes what the one before kept and returns the columns of
``documents``; the last one returns token ids. ``run`` writes each stage as a
table in the shared folder and reads it back for the next.

1. language ID: documents whose language can't be told go: those without a
   letter, and those where the best language has a posterior below
   ``MIN_SCORE``.
2. near duplicates, by a similarity of 0.8 or more between their sets of
   five-word shingles: of each group the document with the smallest doc_id
   stays. Candidates are SimHash links (operator 1) completed by MinHash bands,
   see docweave/llm/similar.py; every link is verified on the whole sets.
3. mixing: sources are taken to their target weights, so a document stays 0 to
   3 times; rows leave in the order of the output shards, each shard shuffled.
4. BPE: ids of every row's whole text, and a digest of what they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import bpe, langid, mixing, similar
from docweave.llm._common import stage, table

MIN_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs, docs.columns)
    kept = found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_SCORE))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.words_in(F.col("text"))).select(*docs.columns)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode(docs, path, ["doc_id", "source"], digest=True)
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding", encode_bpe),
]

#: Model scores, near-dedup and BPE have no SQL; tests/llm/test_pipeline.py holds a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = stage(step(spark, docs, sf_dir), f"pipeline{i}")
    return docs
