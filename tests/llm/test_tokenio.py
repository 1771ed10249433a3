import heapq
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docweave.llm import tokenio

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = tokenio.Encoder(PATH)
PIECES = [
    "the", "The", "THE", " ", "  ", "\n", "\t", " ", "\x1c", "'", "''", "'s", "'S", "'ll", "!'s", "don't", "123", "4$5", "$$$", "é", "É", "é", "İ",
    "ß", "日本語", "\U0001f600", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", "़", "٣", "Σ", "ς", "ﬁ", "`", "\x00", "a̋", "'re", "x'd", "×", "÷", "ñ,", "Ñ ", "Ã", "ÿ1", "–", "…", "\u0301", "¡ñ", "ç's",
]
TEXT = st.one_of(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), st.text(max_size=40))


@settings(max_examples=1200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_ids_equal_the_library(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    got = {}
    for part in tokenio._parted(batch):
        ids, sizes = ENCODER.encode(part.column("text"))
        for t, x in zip(part.column("text").to_pylist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            got[t] = x.tolist()
    assert got == {t: LIBRARY.encode(t, add_special_tokens=False).ids for t in texts}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=60))
def test_code_is_a_prefix_code_and_optimal(counts):
    counts = np.array(counts)
    lengths = tokenio.code_lengths(counts, 20)
    used = counts > 0
    assert ((lengths > 0) == used).all()
    if used.sum() > 1:
        assert sum(2.0 ** -int(x) for x in lengths[used]) == 1.0
        heap = sorted(int(c) for c in counts[used])
        cost = 0
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            cost += x
            heapq.heappush(heap, x)
        assert int((counts * lengths).sum()) == cost or lengths.max() == 20
    short = tokenio.code_lengths(counts, 6)
    assert short.max(initial=0) <= 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), max_size=2000), st.integers(0, 2**32))
def test_blocks_round_trip(ids, seed):
    ids = np.array(ids, np.int64)
    counts = np.bincount(ids, minlength=501) * np.random.default_rng(seed).integers(1, 9**5, 501)
    code = tokenio.Code(tokenio.code_lengths(counts))
    payload, offsets = code.encode(ids)
    assert code.decode(payload, offsets, len(ids)).tolist() == ids.tolist()


def run(spark, docs, tmp_path):
    path = str(tmp_path / "set")
    tokenio.write_ids(tokenio.tokenize(docs, PATH, 2), path)
    return tokenio.read_ids(spark, path).collect()


def expected(rows):
    out, start = [], 0
    ids = [(d, np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for d, t in rows]
    for d, x in sorted(ids, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        out.append((d, start, len(x) // 4, zlib.crc32(x)))
        start += len(x) // 4
    return out


def test_documents(spark, sf, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((r.start, r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in run(spark, docs, tmp_path))
    assert [(d, s, n, c) for s, d, n, c in got] == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark, tmp_path):
    rows = [(3, None), (1, ""), (2, "a <|endoftext|> b"), (2, "same"), (2, "same"), (None, "no id"), (None, None), (9, "word's $$ 12 " * 40_000)]
    docs = spark.createDataFrame([(d, t, b"x", 1) for d, t in rows], "doc_id long, text string, ids binary, part int")
    got = sorted((r.start, r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in run(spark, docs, tmp_path))
    assert [(d, s, n, c) for s, d, n, c in got] == expected(rows)
    assert run(spark, docs.limit(0), tmp_path / "none") == []
