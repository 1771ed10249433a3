import hashlib

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe.Codec(PATH)
PIECES = [
    "the", "The", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "  ", "　", "\x1c", "\x85", "'", "''", "'s", "'ll", "'re", "!'s", "don't", "qz", "zq", "123", "4$5",
    "$$$", "###", "é", "ß", "日本語", "\U0001f600", "<|endoftext|>", "<|endo", "ftext|>", "|>", "<|", "é", "ا", "़", "‍", "Ω", "~", "`", "\x00", "\x7f",
]
TEXT = st.one_of(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), st.text(max_size=40))


def ours(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    out = []
    for part in bpe._parts(CODEC, batch):
        ids, offsets = CODEC.encode(part.column("text"))
        out += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


@settings(max_examples=1500, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_ids_equal_the_library(texts):
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert ours(texts) == want


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in bpe.digests(docs, PATH, ["doc_id"]).collect()}
    for r in docs.collect():
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows_round_trip(spark):
    long = "qz'$ \n" * 60_000
    texts = [None, "", "a", "a", long, "x" * 30_000, "<|endoftext|>a<|endoftext|>", " '<|endoftext|>", "<|endo", "ftext|>"]
    rows = [(i, t, i, "n") for i, t in enumerate(texts)] + [(None, "null id", 1, "m"), (2, "a", 2, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, n_tokens string")
    coded = bpe.encode(docs.withColumnRenamed("ids", "extra"), PATH, ["doc_id", "extra"])
    back = bpe.decode(coded, PATH, ["doc_id", "extra"]).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text) for r in back), key=key) == sorted(((r[0], r[1] or "") for r in rows), key=key)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(empty, PATH, ["doc_id"]).count() == 0
