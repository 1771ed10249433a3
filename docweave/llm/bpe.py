"""Byte-level BPE over whole texts, with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged, nor
lie inside a merge result, so a text may be cut there and its fragments
encoded one by one. Cuts are found for a whole batch in numpy by a 65,536-entry
table built from the vocabulary. Pre-tokenization must not notice a cut, so
one is taken only where

- it lies between characters, not inside one;
- the left character is no white space (the pre-tokenizer looks ahead in runs
  of white space), or is not ASCII and the right one is ASCII white space;
- the right character is no apostrophe (the pre-tokenizer tries contractions
  first at the start of a fragment);
- it is outside an added token, whose ends are always cuts.

Distinct fragments are encoded once per worker and kept in a table of bounded
size; the fragments of a text are then joined by lookup. Fragments are handed
to the tokenizers library many at a time, parted by an added token.

Defined results: null text counts as empty and has no ids; rows that repeat
are encoded alike; any columns asked for are passed through.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._common import lean, ragged, raw_text, slices

#: Fragments that a worker remembers; the table starts anew beyond that.
REMEMBER = 300_000
#: Fragments that go to the library in one call.
CHUNK = 400
SLICE = 2 << 20
#: Ids that are decoded at a time.
IDS = 1 << 18
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _byte_of() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_of()
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.parting = spec["added_tokens"][0]["content"]
        self.parting_id = spec["added_tokens"][0]["id"]
        self.bytes_of: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.bytes_of |= {i: t for t, i in self.added.items()}
        inside = np.zeros(65_536, bool)
        for token in self.bytes_of.values():
            inside[[a << 8 | b for a, b in zip(token, token[1:], strict=False)]] = True
        left, right = np.arange(65_536) >> 8, np.arange(65_536) & 255
        safe = (right < 0x80) | (right >= 0xC0)
        safe &= (right != ord("'")) & ~_WHITE[left]
        safe &= (left < 0x80) | _WHITE[right]
        self.cut = ~inside & safe
        self.digits = {i: str(i) for i in self.bytes_of}
        listed = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.widths = np.fromiter(map(len, listed), np.int64, len(listed))
        self.places = np.cumsum(self.widths) - self.widths
        self.spelled = np.frombuffer(b"".join(listed), np.uint8)
        self.forget()

    def forget(self):
        self.known: dict[bytes, int] = {}
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """By place from 0 to the end of ``data``: is it certain that no token
        crosses it?"""
        out = np.zeros(len(data) + 1, bool)
        if len(data) < 2:
            return out
        pair = data[:-1].astype(np.uint16) << 8 | data[1:]
        marks = self.cut[pair]
        whole = data.tobytes()
        for token in self.added:
            at = whole.find(token)
            while at >= 0:
                marks[max(0, at - 1) : at + len(token)] = False
                marks[[p - 1 for p in (at, at + len(token)) if 0 < p < len(data)]] = True
                at = whole.find(token, at + len(token))
        out[1:-1] = marks
        return out

    def encode_fragments(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of fragments, each encoded by itself, their number by fragment)."""
        flat, sizes = [], []
        for k in range(0, len(fragments), CHUNK):
            part = fragments[k : k + CHUNK]
            special = [i for i, f in enumerate(part) if f in self.added]
            texts = ["" if f in self.added else f.decode("utf-8", "replace") for f in part]
            ids = np.array(self.tokenizer.encode_batch_fast([self.parting.join(texts)], add_special_tokens=False)[0].ids, np.int32)
            parted = ids == self.parting_id
            bounds = np.concatenate([[-1], np.flatnonzero(parted), [len(ids)]])
            ids, size = ids[~parted], np.diff(bounds) - 1
            if special:
                at = np.cumsum(size)[special]
                ids = np.insert(ids, at, [self.added[part[i]] for i in special])
                size[special] = 1
            flat.append(ids)
            sizes.append(size)
        return np.concatenate(flat), np.concatenate(sizes)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ids that lie one after another, added tokens included."""
        widths = self.widths[ids]
        data = self.spelled[ragged(self.places[ids], widths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(widths)])[offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def numbers(self, fragments: list[bytes]) -> np.ndarray:
        """Numbers of fragments in the table of what is known."""
        new = [f for f in fragments if f not in self.known]
        if len(self.known) + len(new) > REMEMBER:
            self.forget()
            new = fragments
        if new:
            flat, sizes = self.encode_fragments(new)
            self.known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, flat])
        return np.fromiter(map(self.known.__getitem__, fragments), np.int64, len(fragments))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text); an added token may not seem to
        span two texts of the column."""
        distinct, order, ends = fragment_slices(self, column)
        own = self.numbers(distinct)[order] if distinct else np.zeros(0, np.int64)
        sizes = self.sizes[own]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[ragged(self.starts[own], sizes)], np.concatenate([[0], upto[ends]])


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, one per worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def fragment_slices(codec_: Codec, column: pa.Array):
    """(distinct fragments, fragment numbers of all texts, ends by text)."""
    data, offsets = raw_text(column)
    marks = codec_.cuts(data)
    marks[offsets] = True  # text boundaries are always cuts
    bounds = np.flatnonzero(marks)
    if bounds[-1] == 0:
        return [], np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    whole = pa.Array.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]
    )
    coded = whole.dictionary_encode()
    ends = np.searchsorted(bounds, offsets[1:])
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), ends


def _parts(codec_: Codec, whole: pa.RecordBatch):
    """Slices of rows in which no added token can seem to span two texts."""
    data, _ = raw_text(whole.column("text"))
    text = data.tobytes()
    if any(t in text for t in codec_.added):
        yield from (whole.slice(i, 1) for i in range(whole.num_rows))
    else:
        yield whole


def _sha(texts: list[str]) -> list[str]:
    return [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def _encode(path: str, keep: list[str], digest: bool):
    names = [*keep, "ids", *["decoded_sha256"] * digest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for whole in slices(batch, "text", SLICE):
                for part in _parts(c, whole):
                    ids, offsets = c.encode(part.column("text"))
                    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                    read = [pa.array(_sha(c.decode(ids, offsets)))] if digest else []
                    yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], lists, *read], names)

    return lean(run)


def _rows(docs: DataFrame, keep: list[str], text_col: str):
    types = dict(docs.dtypes)
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text_col).alias("text"))
    return rows, names, ", ".join(f"{n} {types[c]}" for c, n in zip(keep, names, strict=True))


def _named(out: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *[c for c in out.columns if c not in names])


def encode(docs: DataFrame, path: str, keep: list[str], text_col: str = "text", digest: bool = False) -> DataFrame:
    """Columns ``keep`` and ids (array of int) of every whole text; with
    ``digest`` also the SHA-256 of the text that the ids decode to."""
    rows, names, types = _rows(docs, keep, text_col)
    schema = f"{types}, ids array<int>" + ", decoded_sha256 string" * digest
    return _named(rows.mapInArrow(_encode(path, names, digest), schema), keep, names)


def _decode(path: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
            ids = pc.list_flatten(batch.column("ids")).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            # about IDS ids at a time; a single longer text stays whole
            cuts = np.flatnonzero(np.diff(ends[1:] // IDS, prepend=0)).tolist()
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                part, own = batch.slice(a, b - a), ids[ends[a] : ends[b]]
                texts = c.decode(own, ends[a : b + 1] - ends[a])
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], pa.array(texts, pa.string())], [*keep, "text"])

    return lean(run)


def decode(encoded: DataFrame, path: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """Columns ``keep`` and the text of ``ids_col``; null ids give an empty text."""
    types = dict(encoded.dtypes)
    names = [f"k{i}" for i in range(len(keep))]
    rows = encoded.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(ids_col).alias("ids"))
    schema = ", ".join([*[f"{n} {types[c]}" for c, n in zip(keep, names, strict=True)], "text string"])
    return _named(rows.mapInArrow(_decode(path, names), schema), keep, names)


def _digest(path: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        sha, digits = hashlib.sha256, c.digits.__getitem__
        for batch in batches:
            for whole in slices(batch, "text", SLICE):
                for part in _parts(c, whole):
                    ids, offsets = c.encode(part.column("text"))
                    id_hex, text_hex = [], _sha(c.decode(ids, offsets))
                    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                        id_hex.append(sha(",".join(map(digits, ids[a:b].tolist())).encode()).hexdigest())
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(k) for k in keep], pa.array(np.diff(offsets)), pa.array(id_hex), pa.array(text_hex)],
                        [*keep, "n_tokens", "ids_sha256", "decoded_sha256"],
                    )

    return lean(run)


def digests(docs: DataFrame, path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep``, n_tokens and SHA-256 of ids (decimal, joined by
    commas) and of the text decoded from them, by document."""
    rows, names, types = _rows(docs, keep, text_col)
    schema = f"{types}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _named(rows.mapInArrow(_digest(path, names), schema), keep, names)
