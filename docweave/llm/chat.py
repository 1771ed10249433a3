"""Chat formatting by columnar byte assembly.

A turn is written as ``### <role>: <text></turn>`` and a line feed. So that no
text can end a turn or start one, a backslash is put before each backslash,
each ``#`` in a run of three or more, and the slash of ``</turn>`` (in roles,
also before each colon); dropping those backslashes gives the text back.

A batch is assembled at once: segment lengths, their cumulative offsets and
the scatter index of every byte are computed in numpy, and headers and
contents are copied into one preallocated buffer that becomes the Arrow
column. No text is handled by itself.

Output rows are pieces of conversations, (conv_id, part, piece, formatted,
loss_starts, loss_ends): consecutive whole turns, with the byte spans of
assistant texts that the loss mask covers. Rows are dealt out by ranges of
(conversation, turn), so a conversation of any length is spread over tasks and
never held as a whole; its pieces stand in the order of (part, piece).

Defined results: null text and null role count as empty; turns with the same
number stand in the order of role and text; a null turn comes first; rows that
repeat are turns of their own; rows of a null conv_id form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._common import ragged, raw_text, slices, stage

OPEN, MIDDLE, CLOSE = b"### ", b": ", b"</turn>\n"
LEARNED = "assistant"
SLICE = 2 << 20
PIECES = "conv_id long, part int, piece long, formatted string, loss_starts array<long>, loss_ends array<long>"


def _escapes(data: np.ndarray, role: bool) -> np.ndarray:
    """Which bytes get a backslash before them; values end in a zero byte."""
    out = data == ord("\\")
    if role:
        out |= data == ord(":")
    hashes = data == ord("#")
    if hashes.any():
        run = np.concatenate([[False, False], hashes, [False, False]])
        three = run[:-2] & run[1:-1] & run[2:]
        out |= (three[:-2] | three[1:-1] | three[2:]) & hashes
    whole, at = data.tobytes(), -1
    while (at := whole.find(b"</turn>", at + 1)) >= 0:
        out[at + 1] = True
    return out


def _pool(column: pa.Array, role: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, escapes, starts, lengths) of a string column."""
    empty, stop = pa.scalar("", pa.large_string()), pa.scalar("\0", pa.large_string())
    ended = pc.binary_join_element_wise(pc.fill_null(column.cast(pa.large_string()), empty), empty, stop)
    data, offsets = raw_text(ended)
    return data, _escapes(data, role), offsets[:-1], np.diff(offsets) - 1


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all turns, end by turn, start and end of each turn's text)."""
    n = len(roles)
    fixed = np.frombuffer(OPEN + MIDDLE + CLOSE, np.uint8)
    role_data, role_esc, role_at, role_len = _pool(roles, True)
    text_data, text_esc, text_at, text_len = _pool(texts, False)
    pool = np.concatenate([fixed, role_data, text_data])
    escaped = np.concatenate([np.zeros(len(fixed), bool), role_esc, text_esc])
    starts = np.stack(
        [
            np.zeros(n, np.int64),
            len(fixed) + role_at,
            np.full(n, len(OPEN)),
            len(fixed) + len(role_data) + text_at,
            np.full(n, len(OPEN) + len(MIDDLE)),
        ],
        axis=1,
    )
    sizes = np.stack([np.full(n, len(OPEN)), role_len, np.full(n, len(MIDDLE)), text_len, np.full(n, len(CLOSE))], axis=1)
    source = ragged(starts.reshape(-1), sizes.reshape(-1))
    extra = escaped[source]
    upto = np.concatenate([[0], np.cumsum(extra)])
    out = np.empty(len(source) + int(upto[-1]), np.uint8)
    place = np.arange(len(source)) + upto[1:]
    out[place] = pool[source]
    out[place[extra] - 1] = ord("\\")
    bounds = np.concatenate([[0], np.cumsum(sizes.reshape(-1))])
    bounds = (bounds + upto[bounds])[1:].reshape(n, 5)
    return out, bounds[:, 4], bounds[:, 2], bounds[:, 3]


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, piece = TaskContext.get().partitionId(), 0
    for batch in batches:
        for rows in slices(batch, "text", SLICE):
            n = rows.num_rows
            if not n:
                continue
            out, ends, text_starts, text_ends = assemble(rows.column("role"), rows.column("text"))
            conv = rows.column("conv_id")
            ids, null = pc.fill_null(conv, 0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
            firsts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])]))
            last = np.append(firsts[1:], n) - 1
            starts = np.concatenate([[0], ends])[firsts]
            learned = np.flatnonzero(pc.fill_null(pc.equal(rows.column("role"), LEARNED), False).to_numpy(zero_copy_only=False))
            owner = np.searchsorted(firsts, learned, side="right") - 1
            spans = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(firsts)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(spans), pa.array(x[learned] - starts[owner])) for x in (text_starts, text_ends)]
            bounds = np.append(starts, ends[last[-1]]).astype(np.int32)
            texts = pa.StringArray.from_buffers(len(firsts), pa.py_buffer(bounds), pa.py_buffer(out))
            numbers = np.arange(piece, piece + len(firsts))
            piece += len(firsts)
            yield pa.RecordBatch.from_arrays(
                [conv.take(pa.array(firsts)), pa.array(np.full(len(firsts), part, np.int32)), pa.array(numbers), texts, *lists],
                ["conv_id", "part", "piece", "formatted", "loss_starts", "loss_ends"],
            )


def format_turns(turns: DataFrame) -> DataFrame:
    """Pieces of the conversations in turns(conv_id, turn, role, text), staged."""
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    ordered = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return stage(ordered.mapInArrow(_format, PIECES), "pieces")


# -------------------------------------------------------------------- read back
def unescape(value: bytes) -> bytes:
    return re.sub(rb"\\(.)", rb"\1", value, flags=re.DOTALL) if b"\\" in value else value


_HEAD = re.compile(rb"### ((?:[^\\:]|\\.)*): ", re.DOTALL)


def parse(piece: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn of a formatted piece."""
    out = []
    for turn in piece.split(CLOSE)[:-1]:
        head = _HEAD.match(turn)
        out.append((unescape(head[1]), unescape(turn[head.end() :])))
    return out


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces sorted by conversation: one row each, hashed as they come."""
    now, state, done = None, None, []
    names = [f.split()[0] for f in DIGESTS.split(", ")]

    def close():
        if state is not None:
            done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for batch in batches:
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != now:
                close()
                now, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = row["formatted"].encode()
            for role, content in parse(text):
                state[0] += 1
                state[1].update(role + b"\n" + content + b"\n")
            for s, e in zip(row["loss_starts"], row["loss_ends"], strict=True):
                learned = unescape(text[s:e])
                state[2] += len(learned.decode())
                state[3].update(learned)
            state[4] += len(row["formatted"])
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], _SCHEMA)
            done = []
    close()
    if done:
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], _SCHEMA)


_SCHEMA = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in DIGESTS.split(", ")])


def digests(pieces: DataFrame) -> DataFrame:
    """What each conversation reads back as. A SHA-256 of a conversation is
    sequential, so its pieces stream through one task, a batch at a time."""
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return ordered.mapInArrow(_digest, DIGESTS)
