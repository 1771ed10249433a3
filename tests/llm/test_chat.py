import hashlib

import duckdb
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import chat, queries

PIECES = ["\\", "#", "##", "###", "####", "### Assistant: ", "</turn>", "</turn>\n", "</turn", ">", "<", "/turn>", ":", ": ", "\n", "é", "日", "ok", " ", "\x00", "\\/", "\\n"]
TEXT = st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=12).map("".join), st.text(max_size=12))


@settings(max_examples=800, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=5))
def test_turns_read_back(turns):
    roles, texts = zip(*turns, strict=True)
    out, ends, starts, stops = chat.assemble(pa.array(roles, pa.string()), pa.array(texts, pa.string()))
    whole, want = out.tobytes(), [((r or "").encode(), (t or "").encode()) for r, t in turns]
    assert chat.parse(whole) == want
    assert [chat.unescape(whole[a:b]) for a, b in zip(starts, stops, strict=True)] == [t for _, t in want]
    # a turn's bytes depend on the turn alone
    at = 0
    for (r, t), end in zip(turns, ends.tolist(), strict=True):
        one, *_ = chat.assemble(pa.array([r], pa.string()), pa.array([t], pa.string()))
        assert one.tobytes() == whole[at:end]
        at = end


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, (role or "").encode(), text is not None, (text or "").encode()))
    out = {}
    for conv, turns in by.items():
        turns = [(r, t) for *_, r, _, t in sorted(turns)]
        learned = b"".join(t for r, t in turns if r == b"assistant")
        out[conv] = (
            len(turns), hashlib.sha256(b"".join(r + b"\n" + t + b"\n" for r, t in turns)).hexdigest(), len(learned.decode()), hashlib.sha256(learned).hexdigest(),
        )
    return out


def compare(spark, rows):
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, piece int, part string")
    pieces = chat.format_turns(turns)
    got = {r.conv_id: r for r in chat.digests(pieces).collect()}
    assert {c: tuple(r)[1:5] for c, r in got.items()} == expected(rows)
    chars = {}
    for p in pieces.collect():
        chars[p.conv_id] = chars.get(p.conv_id, 0) + len(p.formatted)
    assert chars == {c: r.formatted_chars for c, r in got.items()}


def test_conversations(spark, sf):
    compare(spark, [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()])


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "SLICE", 2000)
    rows = [(1, i, ("user", "assistant")[i % 2], f"\\### turn {i} </turn>\n" * (i % 7)) for i in range(3000)]
    rows += [(2, 0, None, None), (2, 0, "assistant", None), (3, None, "a: b", "x"), (3, 1, "", ""), (3, 1, "", ""), (None, 0, "user", "n"), (None, 1, "assistant", "m")]
    rows += [(4, 0, "assistant", "long " * 100_000), (5, 5, "Assistant", "not learned")]
    compare(spark, rows)
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_turns(turns)).count() == 0


def test_query_equals_sql(spark, sf, tmp_path):
    rows = [(1, 0, "user", "## and ### and \\\\ ####"), (1, 1, "assistant", "</turn></turn> é日"), (2, 0, "a: b###", None), (2, 0, None, "x"), (None, None, "assistant", "n"), (3, 1, "assistant", "")]
    odd = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    odd.write.parquet(f"{tmp_path}/conversations.parquet")
    for place, files in (sf, f"{sf}/conversations.parquet"), (str(tmp_path), f"{tmp_path}/conversations.parquet/*.parquet"):
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{files}'")
        done = duck.execute(queries.ORACLE["op8_chat"])
        names = [d[0] for d in done.description]
        got = queries.QUERIES["op8_chat"](spark, place).select(*names).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, done.fetchall()))
