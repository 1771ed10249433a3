"""Token ids on disk: canonical length-limited Huffman coding.

Counts of all ids over all documents give a code of at most ``MAX_BITS`` bits
(package-merge), canonical, so that a file needs only code lengths. Ids are
written in ascending order of document id, in blocks that each decode by
themselves: a block holds whole documents (about ``BLOCK`` ids; a longer
document is a block of its own) as one bit string with the bit offset of every
``CHECKPOINT``-th id. A reader decodes all checkpoints of a block in step,
each step one look-up in a table of 2**MAX_BITS entries.

On disk a data set is two Parquet tables: ``blocks`` (part, block, before: ids
of the part ahead of the block, doc_ids, counts, offsets, payload) and
``code`` (id, bits). Spark's writer commits them, so lost executors and
any file system are Spark's concern.

Tokenization goes by fragments: text is cut where the class of characters
changes (letter, digit, white space, other ASCII; see cuts()), never after
white space or an apostrophe, which the normalizer and the splitter of the
vocabulary cannot notice. Distinct fragments are encoded once per worker by the
tokenizers library. Texts with ``<|`` (the start of an added token) go to the
library whole.

Defined results: null text counts as empty and has the end id only; documents
of one id stand in the order of their ids' bytes, those that share the first
``PREFIX`` bytes in the order of a hash; null ids come first; an empty
table gives empty files.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm._common import lean, own_dir, ragged, raw_text, slices, stage

MAX_BITS = 18
BLOCK = 1 << 18
PREFIX = 16
CHECKPOINT = 128
SLICE = 8 << 20
#: Fragments that a worker remembers; the table starts anew beyond that.
REMEMBER = 1_000_000
#: Fragments that go to the library in one call.
CHUNK = 400

_SIMPLE = re.compile(rb"[ \t\n\r\x0b\x0c]*[a-z]+")
_CLASS = np.full(256, 4, np.uint8)
_CLASS[:128] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = 1
_CLASS[65:91] = _CLASS[97:123] = 2


def cuts(data: np.ndarray) -> np.ndarray:
    """By place between two bytes: may a text be cut there? Classes are white
    space 0, digits 1, letters 2 (ASCII and those that UTF-8 writes as C3 and a
    byte, other than the signs of multiplication and division), other ASCII 3,
    and 4 for what is not told apart: after it only white space is a cut."""
    kind = _CLASS[data]
    latin = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    kind[1:][latin] = 2
    kind[:-1][latin] = 2
    left, right = kind[:-1], kind[1:]
    return (left != right) & (right < 4) & (left > 0) & (data[:-1] != ord("'")) & ((left < 4) | (right == 0))


# --------------------------------------------------------------- tokenization
class Encoder:
    """Ids of whole texts by fragments."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # for words of lower-case ASCII letters, which normalizing leaves as they
        # are and splitting leaves whole
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.parting, self.parting_id = spec["added_tokens"][0]["content"], spec["added_tokens"][0]["id"]
        suffix = spec["model"]["end_of_word_suffix"]
        size = self.tokenizer.get_vocab_size()
        self.width = "<u2" if size <= 1 << 16 else "<u4"
        self.ends = np.zeros(size, bool)
        for token, i in spec["model"]["vocab"].items():
            self.ends[i] = token.endswith(suffix)
        self.forget()

    def forget(self):
        self.known: dict[bytes, int] = {}
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _one(self, text: str, tokenizer=None) -> np.ndarray:
        return np.array((tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _encode(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(ids one fragment after another, their number by fragment, the
        fragments in the order of both)."""
        simple = _SIMPLE.fullmatch
        ascii_ = [f for f in fragments if simple(f)]
        plain, rest = [], []
        for f in fragments if len(ascii_) < len(fragments) else ():
            if not simple(f):
                (plain if f.decode("utf-8", "replace").strip().isalpha() else rest).append(f)
        flat, sizes, order = [], [], []
        for words, tokenizer in ((ascii_, self.model), (plain, self.tokenizer)):
            for k in range(0, len(words), CHUNK):
                # words of letters are one piece each, which ends in a marked token
                part = words[k : k + CHUNK]
                ids = self._one(b" ".join(part).decode("utf-8", "replace"), tokenizer)
                ends = np.flatnonzero(self.ends[ids]) + 1
                if len(ends) != len(part):
                    rest += part
                    continue
                flat.append(ids)
                sizes.append(np.diff(ends, prepend=0))
                order += part
        for k in range(0, len(rest), CHUNK):
            part = rest[k : k + CHUNK]
            ids = self._one(self.parting.join([f.decode("utf-8", "replace") for f in part]))
            parted = ids == self.parting_id
            bounds = np.concatenate([[-1], np.flatnonzero(parted), [len(ids)]])
            flat.append(ids[~parted])
            sizes.append(np.diff(bounds) - 1)
            order += part
        return np.concatenate(flat), np.concatenate(sizes), order

    def numbers(self, fragments: list[bytes]) -> np.ndarray:
        """Numbers of fragments in the table of what is known."""
        found = list(map(self.known.get, fragments))
        new = [f for f, i in zip(fragments, found, strict=True) if i is None]
        if len(self.known) + len(new) > REMEMBER:
            self.forget()
            new = fragments
        if new:
            flat, sizes, order = self._encode(new)
            self.known.update(zip(order, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, flat])
            known = self.known
            found = [known[f] if i is None or new is fragments else i for f, i in zip(fragments, found, strict=True)]
        return np.array(found, np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their number by text)."""
        data, offsets = raw_text(column)
        if b"<|" in data.tobytes():
            whole = self.tokenizer.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)
            sizes = np.array([len(e.ids) for e in whole], np.int64)
            return np.array([i for e in whole for i in e.ids], np.uint32), sizes
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        data = data.copy()
        data[(data >= 65) & (data <= 90)] += 32
        marks = np.zeros(len(data) + 1, bool)
        marks[1:-1] = cuts(data)
        marks[offsets] = True
        bounds = np.flatnonzero(marks)
        coded = pa.Array.from_buffers(
            pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]
        ).dictionary_encode()
        own = self.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        sizes = self.sizes[own]
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(bounds, offsets)]
        return self.flat[ragged(self.starts[own], sizes)], np.diff(upto)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _parted(part: pa.RecordBatch):
    """Texts with an added token's start apart from the others."""
    special = pc.fill_null(pc.match_substring(part.column("text"), "<|"), False)
    if not pc.any(special).as_py():
        return [part] if part.num_rows else []
    return [p for p in (part.filter(pc.invert(special)), part.filter(special)) if p.num_rows]


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary value of each run of values."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(
        pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
    )


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(path)
        for batch in batches:
            for whole in slices(batch, "text", SLICE):
                for part in _parted(whole):
                    ids, sizes = e.encode(part.column("text"))
                    out = np.full(len(ids) + len(sizes), end_id, e.width)
                    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
                    width = pa.array(np.full(len(sizes), out.itemsize, np.int32))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), width, _binary(out, sizes + 1)], ["doc_id", "width", "ids"])

    return lean(run)


def tokenize(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, width, ids): ids as little-endian unsigned integers of
    ``width`` bytes (2 where the vocabulary allows), with the end id after each
    document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_tokenize(path, end_id), "doc_id long, width int, ids binary")


# ----------------------------------------------------------------------- code
def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Bits of an optimal prefix code of at most ``limit`` bits (package-merge);
    0 for what does not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    merged, kinds = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        merged = both[by]
        kinds.append(by < len(leaves))
    take = 2 * len(leaves) - 2
    for kind in reversed(kinds):
        n = int(kind[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


class Code:
    """The canonical code of some lengths (0: id not coded)."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        bits = self.lengths[order]
        self.bits = int(bits[-1]) if len(bits) else 1
        spans = np.int64(1) << (self.bits - bits)
        firsts = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (firsts >> (self.bits - bits)).astype(np.uint64)
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        self.symbol[: int(spans.sum())] = np.repeat(order, spans)
        self.step = self.lengths[self.symbol]

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bit string, bit offset of every CHECKPOINT-th id)."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        bits = self.lengths[ids]
        ends = np.cumsum(bits)
        starts = ends - bits
        words = starts >> 5
        # at most 2 words of 32 bits hold a code; every word has a code starting in it
        placed = self.codes[ids] << (64 - (starts & 31) - bits).astype(np.uint64)
        firsts = np.flatnonzero(np.diff(words, prepend=-1))
        joined = np.bitwise_or.reduceat(placed, firsts)
        out = np.zeros(int(words[-1]) + 2, np.uint64)
        out[:-1] |= joined >> np.uint64(32)
        out[1:] |= joined & np.uint64(0xFFFFFFFF)
        return out.astype(">u4").tobytes(), starts[::CHECKPOINT]

    def decode(self, payload: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(offsets) * CHECKPOINT, np.uint32).reshape(-1, CHECKPOINT)
        if not n:
            return out.reshape(-1)
        words = np.frombuffer(payload, ">u4").astype(np.uint64)
        pairs = (words << np.uint64(32)) | np.append(words[1:], np.uint64(0))
        at = offsets.astype(np.int64)
        last = n - (len(offsets) - 1) * CHECKPOINT
        mask = np.uint64((1 << self.bits) - 1)
        for k in range(CHECKPOINT):
            if k == last:
                at = at[:-1]
            found = (pairs[at >> 5] >> (64 - self.bits - (at & 31)).astype(np.uint64)) & mask
            found = found.astype(np.int64)
            out[: len(at), k] = self.symbol[found]
            at = at + self.step[found]
        return out.reshape(-1)[:n]


# ------------------------------------------------------------------ file format
def _values(batch: pa.RecordBatch):
    """The ids of each row of (width, ids)."""
    for width, value in zip(batch.column("width").to_pylist(), batch.column("ids"), strict=True):
        yield np.frombuffer(value.as_buffer(), f"<u{width}")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(0, np.int64)
    for batch in batches:
        # all ids of rows of one width at once: counting costs the vocabulary each time
        by: dict[str, list] = {}
        for ids in _values(batch):
            by.setdefault(ids.dtype.str, []).append(ids)
        for own in (np.bincount(np.concatenate(x)) for x in by.values()):
            if len(own) > len(counts):
                counts = np.append(counts, np.zeros(len(own) - len(counts), np.int64))
            counts[: len(own)] += own
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["id", "n"])


BLOCKS = "part int, block int, before long, doc_ids array<long>, counts array<long>, offsets array<long>, payload binary"


def _write_blocks(code):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = code.value
        part, block, before = TaskContext.get().partitionId(), 0, 0
        docs, held, size = [], [], 0

        def row():
            payload, offsets = c.encode(np.concatenate(held) if held else np.zeros(0, np.uint32))
            types = [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            values = [part, block, before, docs, [len(x) for x in held], offsets, payload]
            names = [f.split()[0] for f in BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), _values(batch), strict=True):
                if held and size + len(ids) > BLOCK:
                    yield row()
                    block, before = block + 1, before + size
                    docs, held, size = [], [], 0
                docs.append(doc)
                held.append(ids.copy())
                size += len(ids)
        if docs:
            yield row()

    return run


def write_ids(tokens: DataFrame, path: str) -> None:
    """Write tokens(doc_id, width, ids) as a data set in ascending doc_id order."""
    spark = tokens.sparkSession
    tokens = stage(tokens, "tokens")
    # at most one row per id of the vocabulary
    counted = tokens.select("width", "ids").mapInArrow(lean(_count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = counted.column("id").to_numpy(), counted.column("n").to_numpy()
    counts = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    counts[ids] = n
    # more ids than MAX_BITS can tell apart get a longer limit
    lengths = code_lengths(counts, max(MAX_BITS, len(ids).bit_length() + 1))
    code = spark.sparkContext.broadcast(Code(lengths))
    coded = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(coded, "id int, bits int").coalesce(1).write.parquet(f"{path}/code")
    # many documents of one id, and many copies of one document, may go to several partitions
    keyed = tokens.withColumns({"start": F.substring("ids", 1, PREFIX), "tie": F.xxhash64("ids"), "copy": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("doc_id", "start", "tie", "copy").sortWithinPartitions("doc_id", "start", "tie").drop("start", "tie", "copy")
    ordered.mapInArrow(lean(_write_blocks(code)), BLOCKS).write.parquet(f"{path}/blocks")


def _read_blocks(code):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = code.value
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda k, i=i: batch.column(k)[i]
                counts = get("counts").values.to_numpy()
                ids = c.decode(get("payload").as_buffer(), get("offsets").values.to_numpy(), int(counts.sum()))
                same = lambda k, i=i: pa.array([get(k, i).as_py()] * len(counts), pa.int64())
                starts = np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays(
                    [same("part"), pa.array(get("before").as_py() + starts), get("doc_ids").values, pa.array(counts), _binary(ids, counts)],
                    ["part", "inside", "doc_id", "n_tokens", "ids"],
                )

    return run


def read_ids(spark: SparkSession, path: str, blocks: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a data set; start counts the ids of
    all documents before."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks") if blocks is None else blocks
    lengths = spark.read.schema("id int, bits int").parquet(f"{path}/code").toArrow()  # at most the vocabulary
    ids, bits = lengths.column("id").to_numpy(), lengths.column("bits").to_numpy()
    table = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    table[ids] = bits
    code = spark.sparkContext.broadcast(Code(table))
    # one row per part: bounded by the number of partitions that wrote
    sums = blocks.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n"))
    starts, total = [], 0
    for part, n in sorted(sums.collect()):
        starts.append((part, total))
        total += n
    rows = blocks.mapInArrow(lean(_read_blocks(code)), "part long, inside long, doc_id long, n_tokens long, ids binary")
    ahead = F.broadcast(spark.createDataFrame(starts, "part long, ahead long"))
    return rows.join(ahead, "part").select("doc_id", (F.col("ahead") + F.col("inside")).alias("start"), "n_tokens", "ids")


def data_set_path(spark: SparkSession, name: str) -> str:
    """A new folder for a data set; it goes when the session ends."""
    return f"{own_dir(spark, 'ids')}/{name}-{uuid.uuid4().hex}"
