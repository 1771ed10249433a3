import os
import posixpath
import random

from docweave.functions import text as tx
from pyspark.sql import functions as F


def test_normalize_like_posixpath(spark):
    rng = random.Random(1)
    paths = ["/".join(rng.choice(["a", "b", "..", ".", "", "c"]) for _ in range(rng.randint(1, 7))) for _ in range(300)]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", tx.normalize(F.col("p")).alias("n"), tx.dirname(F.col("p")).alias("d")).collect()
    for r in rows:
        want = posixpath.normpath(r.p)
        assert r.n == ("/" + want.lstrip("/") if r.p.startswith("/") else want), r.p


def test_safe_path(spark):
    rows = [("/repo", "a/../b"), ("/repo", "../repo/x"), ("/repo", "../repo2/x"), ("/repo", "/repo/y"), ("/repo", "/etc"), ("/repo", ""), ("/", "x")]
    got = [r[0] for r in spark.createDataFrame(rows, "r string, p string").select(tx.safe_path(F.col("r"), F.col("p"))).collect()]
    assert got == ["/repo/b", "/repo/x", None, "/repo/y", None, "/repo", "/x"]


def test_numbered_slugs(spark):
    cases = [["setup", "setup", "setup"], ["setup", "setup-1", "setup"], ["a-1", "a", "a"], []]
    from docweave.parsing.markdown import Slugger

    rows = spark.createDataFrame([(c,) for c in cases], "s array<string>").select(tx.numbered_slugs(F.col("s"))).collect()
    for c, r in zip(cases, rows, strict=True):
        s = Slugger()
        assert r[0] == [s.slug(x) for x in c]


def test_lines_escapes_and_folding(spark):
    df = spark.createDataFrame([("a\nb\n\nd\n", "50%\r\n,:", "ÄB")], "t string, e string, f string")
    r = df.select(
        tx.slice_lines(F.col("t"), F.lit(2), F.lit(3)).alias("s"), tx.splice_lines(F.col("t"), F.lit(1), F.lit(4), F.lit("x")).alias("n"),
        tx.escape_message(F.col("e")).alias("m"), tx.escape_property(F.col("e")).alias("p"), tx.ascii_lower(F.col("f")).alias("l"),
    ).first()
    assert (r.s, r.n, r.m, r.p, r.l) == ("b\n", "x\n", "50%25%0D%0A,:", "50%25%0D%0A%2C%3A", "Äb")


def test_gitignore(tmp_path, spark):
    from docweave.sources.files import discover

    for name in ("src/a.ts", "src/b.test.ts", "docs/x.md", "dist/y.js", ".hidden/z.ts", "tmp/q.js", "tmp/keep.js", "readme.txt", "lib/deep/m.tsx"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / ".gitignore").write_text("# c\n*.test.ts\n/tmp/*\n!/tmp/keep.js\ndeep/\n")
    assert [r.path for r in discover(spark, str(tmp_path)).collect()] == ["docs/x.md", "src/a.ts", "tmp/keep.js"]


def test_doc_comment_splits_its_lines_once(spark):
    cases = ["/** One. */", "/**\n * A\n *\n * b.\n * @param x  the x \n * more\n * @returns\n */", "/** @only tag */", "/***/", None, "/**\n * \u00a0wide\u00a0\n * a @not b\n * @ no\n */"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, raw string").repartition(1)
    found = df.select("i", tx.doc_comment(F.col("raw")).alias("d")).select("i", "d.description", "d.tags")
    got = {r.i: (r.description, r.tags and [tuple(t) for t in r.tags]) for r in found.collect()}
    assert got == {
        0: ("One.", []), 1: ("A b.", [("param", "x  the x"), ("returns", "")]), 2: (None, [("only", "tag")]), 3: (None, []), 4: (None, None),
        5: ("wide a @not b @ no", []),
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
