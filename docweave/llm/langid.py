"""Language identification by multinomial naive Bayes over hashed character
n-grams.

Text is lower-cased, everything that is no letter becomes a space, and runs of
spaces become one. Features are the 2- and 3-grams of the result (with a space
at both ends) that hold a letter, hashed to 2**``DIM_BITS`` columns by one
multiplication; with more than ``CELLS`` / 2**``DIM_BITS`` languages to fewer,
so that the matrix keeps its size. Counts of n-grams by language are summed on
the executors; what reaches the driver, and the broadcast log-probability
matrix, is at most ``CELLS`` numbers for any corpus. Scoring gathers matrix
rows at the hashed positions and adds them up per document; a text of over
``PIECE`` characters goes through in pieces. All languages have the same prior
probability, as the sample is not drawn in proportion.

Training takes a bounded sample: about ``MAX_TRAIN`` documents of each
language, chosen by a hash of id and text (``max_train`` is the parameter).
Every document is scored over its whole text.

Defined results: null text, or text without a letter, is ``und`` with score 0;
if nothing was learned every text is ``und``; of languages that score alike the
first by code point is predicted. Rows that repeat score alike. An id may be
null or repeat; it only decides who is in the training sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm._common import bounded_collect, lean, slices

#: Lengths of the n-grams.
SIZES = (2, 3)
DIM_BITS = 16
#: Numbers in the matrix, and columns at least; more languages than CELLS / LEAST are an error.
CELLS, LEAST = 1 << 25, 1 << 8
MAX_TRAIN = 4000
SLICE = 1 << 19
#: Characters of a single text that are looked at at once.
PIECE = 1 << 18
UNDETERMINED = "und"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """By code point: is it a letter (general category L)?"""
    global _letters
    if _letters is None:
        _letters = np.fromiter((category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return _letters


def _grams(code: np.ndarray, blank: np.ndarray, owner: np.ndarray, texts: int, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of normalized code points, text after text, and their number by text."""
    size = max(0, len(code) - n + 1)
    packed = code[:size]
    for i in range(1, n):
        packed = (packed << np.uint64(21)) + code[i : size + i]
    inside = owner[:size] == owner[n - 1 : size + n - 1]
    lettered = ~blank[:size]
    for i in range(1, n):
        lettered |= ~blank[i : size + i]
    inside &= lettered
    hashed = ((packed[inside] + np.uint64(n)) * _MULTIPLIER) >> np.uint64(64 - bits)
    return hashed.astype(np.int32), np.bincount(owner[:size][inside], minlength=texts)


def _normal(text: str, owner: np.ndarray, ahead: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, are they blank, owners) with runs of blanks as one space;
    ``ahead``: a blank stands before."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = ~letters()[code]
    keep = ~(blank & np.concatenate([[ahead], blank[:-1] & (owner[1:] == owner[:-1])]))
    code = np.where(blank[keep], np.uint64(32), code[keep].astype(np.uint64))
    return code, blank[keep], owner[keep]


def features(texts: list[str | None], bits: int = DIM_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed n-grams, text after text, and their number by text: once for
    each n, for a single long text once for each n and piece of it."""
    if len(texts) > 1 or len(texts[0] or "") <= PIECE:
        padded = [f" {(t or '').lower()} " for t in texts]
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, padded), np.int64, len(padded)))
        code, blank, owner = _normal("".join(padded), owner, False)
        for n in SIZES:
            yield _grams(code, blank, owner, len(texts), n, bits)
        return
    whole = f" {texts[0].lower()} "
    code, blank = np.zeros(0, np.uint64), np.zeros(0, bool)
    for i in range(0, len(whole), PIECE):
        part = whole[i : i + PIECE]
        new, empty, _ = _normal(part, np.zeros(len(part), np.int32), bool(len(blank) and blank[-1]))
        for n in SIZES:
            # the n-grams that end in this piece
            old = min(n - 1, len(code))
            both, blanks = np.concatenate([code[len(code) - old :], new]), np.concatenate([blank[len(blank) - old :], empty])
            yield _grams(both, blanks, np.zeros(len(both), np.int32), 1, n, bits)
        code, blank = np.concatenate([code, new])[-max(SIZES) :], np.concatenate([blank, empty])[-max(SIZES) :]


def _count_batches(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                langs = part.column("lang").to_pylist()
                for hashed, n in features(part.column("text").to_pylist(), bits):
                    at = np.cumsum(n) - n
                    for i, lang in enumerate(langs):
                        into = sums.setdefault(lang, np.zeros(1 << bits, np.int64))
                        into += np.bincount(hashed[at[i] : at[i] + n[i]], minlength=1 << bits)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())],
                ["lang", "feature", "n"],
            )

    return lean(run)


def train(docs: DataFrame, usable: Column, id_col="doc_id", text_col="text", lang_col="lang", max_train: int = MAX_TRAIN):
    """(languages, log probabilities as float32 [languages, columns]) of the
    rows where ``usable`` holds and text and language are known."""
    spark = docs.sparkSession
    rows = docs.filter(usable & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    known = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("of"))
    langs = sorted(r["lang"] for r in bounded_collect(known, CELLS // LEAST, "languages"))
    if not langs:
        return [], np.zeros((0, 1 << DIM_BITS), np.float32)
    bits = min(DIM_BITS, (CELLS // len(langs)).bit_length() - 1)
    # one row by language, no more than fits
    shares = F.broadcast(known.select(F.col("lang").alias("__lang"), F.least(F.lit(1.0), F.lit(float(max_train)) / F.col("of")).alias("__share")))
    drawn = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 20)) < F.col("__share") * (1 << 20)
    sample = rows.join(shares, F.col(lang_col) == F.col("__lang")).filter(drawn).select(F.col(text_col).alias("text"), F.col("__lang").alias("lang"))
    counted = sample.mapInArrow(_count_batches(bits), "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    numbered = F.broadcast(spark.createDataFrame(list(enumerate(langs)), "place int, lang string"))
    found = counted.join(numbered, "lang").select("place", "feature", "n").toArrow()
    counts = np.zeros((len(langs), 1 << bits), np.float32)
    counts[found.column("place").to_numpy(), found.column("feature").to_numpy()] = found.column("n").to_numpy()
    counts += 0.5
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True, dtype=np.float64)).astype(np.float32)


def _predict(model, keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = model.value
        names = np.array([*langs, UNDETERMINED], dtype=object)
        bits = logs.shape[1].bit_length() - 1
        for batch in batches:
            for part in slices(batch, text, SLICE):
                total, found = np.zeros((len(langs), part.num_rows)), np.zeros(part.num_rows, np.int64)
                for hashed, n in features(part.column(text).to_pylist(), bits):
                    some = np.flatnonzero(n)
                    if len(some):
                        at = (np.cumsum(n) - n)[some]
                        found += n
                        for k in range(len(langs)):
                            total[k, some] += np.add.reduceat(logs[k][hashed], at, dtype=np.float64)
                best, score = np.full(part.num_rows, len(langs)), np.zeros(part.num_rows)
                some = np.flatnonzero(found)
                if len(some) and langs:
                    best[some] = total[:, some].argmax(axis=0)
                    score[some] = 1 / np.exp(total[:, some] - total[:, some].max(axis=0)).sum(axis=0)
                columns = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(names[best], pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"]
                )

    return lean(run)


def predict(docs: DataFrame, model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with lang_pred and score (the posterior probability);
    ``model`` comes from train()."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    types = dict(docs.dtypes)
    names = [f"k{i}" for i in range(len(keep))]
    text = names[keep.index(text_col)] if text_col in keep else "text"
    more = [] if text_col in keep else [F.col(text_col).alias(text)]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], *more)
    schema = ", ".join([f"{n} {types[c]}" for c, n in zip(keep, names, strict=True)] + ["lang_pred string", "score double"])
    out = rows.mapInArrow(_predict(sent, names, text), schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Train on what is not held out, predict every row."""
    return predict(docs, train(docs, ~held_out()), keep)
