import collections
import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from test_similar import expected
from tokenizers import Tokenizer

import corpus_pipeline
from docweave.llm import langid, mixing

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain(spark, docs):
    """Rows of run() by plain loops over collected rows; the classifier and the
    mix have brute-force tests of their own."""
    scored = {(r.doc_id, r.text): r for r in langid.identify(docs, ["doc_id", "text"]).collect()}
    kept = [r for r in docs.collect() if scored[r.doc_id, r.text].lang_pred != "und" and scored[r.doc_id, r.text].score >= corpus_pipeline.MIN_SCORE]
    stays = {d for none, d in expected([(r.doc_id, r.text) for r in kept])}
    kept = [r for r in kept if r.doc_id in stays]
    mixed = mixing.mix(spark.createDataFrame(kept, docs.schema), mixing.words_in(F.col("text"))).collect()
    return [(r.doc_id, r.source, LIBRARY.encode(r.text, add_special_tokens=False).ids, r.text) for r in mixed]


def test_run_against_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    want = plain(spark, docs)
    assert sorted((r.doc_id, r.source, r.ids) for r in got) == sorted(w[:3] for w in want)
    digest = {w[0]: hashlib.sha256(w[3].encode()).hexdigest() for w in want}
    assert all(r.decoded_sha256 == digest[r.doc_id] for r in got)
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert max(collections.Counter(r.doc_id for r in got).values()) <= 3


def test_stages_handle_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    rows = [(1, "the cat sat on the mat and the dog", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "le chat et le chien", "fr", None, 3)]
    rows += [(1, "the cat sat on the mat and the dog", "en", "a", 5), (4, "the cat sat on the mat and the dog", "en", "b", 5), (5, "$$$ 123", "en", "b", 7)]
    for data in (rows, []):
        now = spark.createDataFrame(data, docs.schema)
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, now, sf)
            if name != "BPE encoding":
                assert out.columns == docs.columns
            now = spark.createDataFrame(out.collect(), out.schema)
        assert (now.count() > 0) == bool(data)
