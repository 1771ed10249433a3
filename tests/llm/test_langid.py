import math
import zlib

import numpy as np
import pytest

from docweave.llm import langid

SCHEMA = "doc_id long, text string, lang string, score double, lang_pred int"


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.identify(docs, ["doc_id", "lang"]).withColumn("held_out", langid.held_out()).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    test = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in test) / len(test) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def grams(text, bits=langid.DIM_BITS):
    """Hashed n-grams of a text, one by one."""
    kept = "".join(c if langid.letters()[ord(c)] else " " for c in f" {text.lower()} ")
    while "  " in kept:
        kept = kept.replace("  ", " ")
    for n in langid.SIZES:
        for i in range(len(kept) - n + 1):
            gram = kept[i : i + n]
            if gram.strip():
                code = 0
                for c in gram:
                    code = (code << 21) + ord(c)
                yield ((code + n) % 2**64 * int(langid._MULTIPLIER)) % 2**64 >> (64 - bits)


def brute(model, text):
    langs, logs = model
    sums = [0.0] * len(langs)
    for at in grams(text, logs.shape[1].bit_length() - 1):
        for k in range(len(langs)):
            sums[k] += float(logs[k][at])
    best = max(range(len(langs)), key=lambda k: sums[k])
    return langs[best], 1 / sum(math.exp(s - sums[best]) for s in sums)


def learned(rows, langs, bits):
    """The matrix of (text, lang) rows by plain counting."""
    out = []
    for lang in langs:
        counts = [0.5] * (1 << bits)
        for t, own in rows:
            if own == lang:
                for at in grams(t, bits):
                    counts[at] += 1
        total = sum(counts)
        out.append([math.log(c / total) for c in counts])
    return np.array(out)


@pytest.mark.parametrize("cells", [langid.CELLS, 1 << 14])
def test_training_against_plain_counting(spark, sf, monkeypatch, cells):
    monkeypatch.setattr(langid, "CELLS", cells)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    rows = [(r.text, r.lang) for r in docs.collect() if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    langs, logs = langid.train(docs, ~langid.held_out())
    assert langs == sorted({lang for _, lang in rows})
    assert logs.size <= cells
    assert np.abs(logs - learned(rows, langs, logs.shape[1].bit_length() - 1)).max() < 1e-3


def test_a_long_text_goes_in_pieces(monkeypatch):
    text = "Ab c,,, d  e" * 50 + " .. " + "xy" * 30
    whole = list(langid.features([text]))
    for piece in (1, 2, 7, 64):
        monkeypatch.setattr(langid, "PIECE", piece)
        parts = list(langid.features([text]))
        k = len(langid.SIZES)
        for i in range(k):
            assert np.concatenate([h for h, _ in parts[i::k]]).tolist() == whole[i][0].tolist()


def test_odd_rows_against_plain_code(spark):
    texts = ["the cat and the dog", "le chat et le chien", None, "", "123 $$$", "x", "Ünïcödé ǅ 中文 \U00010400", "the " * 50_000, "the"]
    rows = [(i, t, ("en", "fr", None)[i % 3], 0.5, 1) for i, t in enumerate(texts)] + [(None, "the dog", "en", 0.0, 0), (0, texts[0], "en", 0.0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs, ~langid.held_out())
    got = langid.predict(docs, model, ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        if not any(langid.letters()[ord(c)] for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            lang, score = brute(model, r.text)
            assert r.lang_pred == lang and abs(r.score - score) < 1e-3


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.identify(empty, ["doc_id"]).count() == 0
    docs = spark.createDataFrame([(1, "some text", None, 0.0, 0)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in langid.identify(docs, ["doc_id"]).collect()] == [("und", 0.0)]
