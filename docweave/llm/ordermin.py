"""Document fingerprints by Order MinHash.

A text is cut into tokens (runs of characters that are no white space; a run of
over ``PIECE`` characters gives the pieces of that length at every position, so
that an insertion changes only those around it); k-mers are ``K`` tokens in a
row. Each k-mer is numbered by its occurrence in the text, and (k-mer,
occurrence) is hashed. Each of ``TUPLES`` tuples hashes all numbered k-mers of
the text anew, under seeds of its own: one 64-bit hash, whose halves select a
minimal numbered k-mer each. The two are put in the order in which they stand
in the text, and the tuple is hashed. So a tuple is equal in two texts if they
share both minimal k-mers in the same order: moving a passage changes about
half the tuples, which plain MinHash would not notice, in texts of any length.
The share of equal tuples estimates likeness under edit distance.

Everything is DataFrame operations. Rows are dealt out by document once;
occurrence numbers and minima group by document and more, so nothing is dealt
out again. The minima of a text are 2 x ``TUPLES`` numbers in one aggregate; a
text's tokens and k-mers are an array of its row, which the sort for the
occurrence numbers may spill.

Defined results: null text counts as empty; texts without a token have an empty
fingerprint, and two of those are alike (1.0), one and another text are not
(0.0); texts of fewer than ``K`` tokens form one k-mer of what there is; rows
that repeat id and text count as one document for "the next document" and get
the same result; null ids come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm._common import stage
from docweave.llm.sharding import number_rows

K = 2
TUPLES = 32
PIECE = 12
#: Code points that one task of the text exchange gets, about.
CHARS_PER_DEAL = 4_000_000
#: Stands for a null id, which is thereby the smallest.
NO_ID = -(1 << 63)


def kmers(text: Column) -> Column:
    """Hashes of the k-mers of a text, in text order."""

    def hashed(tokens):
        grams = F.transform(tokens, lambda t, i: F.xxhash64(t, *[F.get(tokens, i + j) for j in range(1, K)]))
        return F.slice(grams, 1, F.greatest(F.size(tokens) - (K - 1), F.lit(1)))

    # a piece, then one character on while a whole piece is left, else to the end of the run
    pattern = rf"(?=((?<!\S)\S{{1,{PIECE}}}(?!\S)|\S{{{PIECE}}}))(?:\S(?=\S{{{PIECE}}})|\S{{1,{PIECE}}})"
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    # a lambda variable holds the tokens, so that they are found once
    return F.transform(F.array(tokens), hashed)[0]


def signatures(texts: DataFrame, key: list[str], columns: list[str], facts: list[Column] | None = None) -> DataFrame:
    """(key..., sig_<column> for each of ``columns``, fact0, fact1, ...): a
    signature is an array of the hashes of the tuples, null if the text has no
    token. ``facts`` are longs to carry along. ``key`` identifies a row; if
    ``texts`` is dealt out by it, nothing is dealt out again."""
    facts = facts or [F.lit(0)]
    kinds = [F.struct(F.lit(i).alias("kind"), kmers(F.col(c)).alias("grams")) for i, c in enumerate(columns)]
    carried = F.struct(F.lit(-1).alias("kind"), F.array(*[f.cast("long") for f in facts]).alias("grams"))
    parts = texts.select(*key, F.explode(F.array(*kinds, carried)).alias("x")).select(*key, "x.kind", "x.grams")
    grams = parts.select(*key, "kind", F.posexplode("grams").alias("pos", "gram"))
    # the k-mer leads the sort: its bits differ early
    seen = F.row_number().over(Window.partitionBy("gram", *key, "kind").orderBy("pos"))
    numbered = grams.select(*key, "kind", "pos", "gram", F.xxhash64("gram", seen).alias("h"))
    hashed = numbered.select(*key, "kind", "pos", "gram", *[F.xxhash64("h", F.lit(t)).alias(f"x{t}") for t in range(TUPLES)])
    # a minimum holds half a hash in its high bits and the place in the text in its 31 low ones
    place = F.col("pos").cast("long")
    packed = lambda half: F.shiftleft(half, 31).bitwiseOR(place)
    upper = lambda t: F.min(packed(F.shiftrightunsigned(f"x{t}", 32))).alias(f"a{t}")
    lower = lambda t: F.min(packed(F.col(f"x{t}").bitwiseAND(F.lit(0xFFFFFFFF)))).alias(f"b{t}")
    fact = [F.max(F.when((F.col("kind") < 0) & (F.col("pos") == i), F.col("gram"))).alias(f"fact{i}") for i in range(len(facts))]
    least = hashed.groupBy(*key, "kind").agg(*[f(t) for t in range(TUPLES) for f in (upper, lower)], *fact)

    def made(t: int) -> Column:
        first, second = F.col(f"a{t}"), F.col(f"b{t}")
        at = lambda m: m.bitwiseAND(F.lit((1 << 31) - 1))
        order = F.when(at(first) == at(second), 0).when(at(first) < at(second), 1).otherwise(2)
        return F.xxhash64(F.lit(t), order, F.shiftright(first, 31), F.shiftright(second, 31))

    signed = least.select(*key, "kind", F.array(*[made(t) for t in range(TUPLES)]).alias("sig"), *[f"fact{i}" for i in range(len(facts))])
    return signed.groupBy(*key).agg(
        *[F.any_value(F.when(F.col("kind") == i, F.col("sig")), F.lit(True)).alias(f"sig_{c}") for i, c in enumerate(columns)],
        *[F.max(f"fact{i}").alias(f"fact{i}") for i in range(len(facts))],
    )


def likeness(a: str, b: str) -> Column:
    """Share of equal tuples; both texts without tokens: 1, one of them: 0."""
    one, other = F.col(f"sig_{a}"), F.col(f"sig_{b}")
    same = F.size(F.filter(F.zip_with(one, other, lambda x, y: x == y), lambda e: e))
    return F.when(one.isNull() & other.isNull(), 1.0).when(one.isNull() | other.isNull(), 0.0).otherwise(same / F.lit(TUPLES))


def as_text(column: str) -> Column:
    """The signature as hex digits, 16 by tuple."""
    digits = F.transform(f"sig_{column}", lambda x: F.lower(F.lpad(F.hex(x), 16, "0")))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def _as_longs(hex_: Column) -> list[Column]:
    """A SHA-256 in hex as four longs."""
    return [F.conv(F.substring(hex_, 1 + 16 * i, 16), 16, -10).cast("long") for i in range(4)]


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint, that of its edited text (the last half of
    its code points replaced by as many of the next document's first), and how
    alike they and the next document's are."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("d", F.xxhash64("text").alias("th"), "text")
    slim = rows.select("d", "th", F.length("text").cast("long").alias("n")).groupBy("d", "th", "n").agg(F.count("*").alias("copies"))
    numbered, total = number_rows(slim, ["d", "th", "n"], "row")
    half = F.call_function("div", F.col("n"), F.lit(2))
    follower = F.pmod(F.col("row") + 1, F.lit(max(1, total)))
    before = numbered.select(follower.alias("row"), half.alias("wanted"), F.col("d").alias("for_d"), F.col("th").alias("for_th"))
    plan = stage(numbered.join(before, "row"), "plan")
    size, repeated = plan.agg(F.sum("n"), F.max("copies")).first()

    # texts are dealt out once by document, and the starts of their successors to them
    deals = max(1, -(-(size or 0) // CHARS_PER_DEAL))
    dealt = rows.repartition(deals, "d", "th")
    if (repeated or 0) > 1:
        dealt = dealt.dropDuplicates(["d", "th"])
    own = dealt.join(plan.select("d", "th", "n"), ["d", "th"])
    gives = plan.select("d", "th", "for_d", "for_th", "wanted")
    given = dealt.join(gives, ["d", "th"]).select(
        F.col("for_d").alias("d"), F.col("for_th").alias("th"), F.substring(F.col("text"), F.lit(1), F.col("wanted").cast("int")).alias("start")
    )
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n") - half).cast("int"))
    pairs = own.join(given, ["d", "th"]).select("d", "th", "text", F.concat(kept, "start").alias("edited"))
    signed = stage(signatures(pairs, ["d", "th"], ["text", "edited"], _as_longs(F.sha2("edited", 256))), "signatures")

    following = signed.join(plan.select("d", "th", "for_d", "for_th"), ["d", "th"]).select(
        F.col("for_d").alias("d"), F.col("for_th").alias("th"), F.col("sig_text").alias("sig_next")
    )
    joined = signed.join(following, ["d", "th"]).join(plan.select("d", "th", "n", "copies"), ["d", "th"])
    if (repeated or 0) > 1:
        joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    hex_ = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return joined.select(
        F.when(F.col("d") != NO_ID, F.col("d")).alias(id_col),
        F.col("n").alias("n_chars"),
        F.concat(*[hex_(f"fact{i}") for i in range(4)]).alias("edited_sha256"),
        as_text("text").alias("fingerprint"),
        as_text("edited").alias("edited_fingerprint"),
        likeness("text", "edited").alias("near_edited"),
        likeness("text", "next").alias("near_next"),
    )
