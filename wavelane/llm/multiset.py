"""Homomorphic multiset fingerprints of documents, in built-in expressions.

A document is the multiset of its paragraphs (lines with text). Every paragraph is hashed to a wide
vector, and the fingerprint is the sum of the vectors, lane by lane, modulo powers of two. So the
order of paragraphs doesn't matter, and paragraphs are put in or taken out by adding or
subtracting their own vectors (``plus``, ``minus``).

Lanes: ``EXACT`` lanes modulo 2**32 of the paragraph's SHA-256 (equality), and ``WIDE`` lanes modulo
2**32 of signed sums over the paragraph's clauses (likeness): a clause adds one to the lanes where
its hash has a one bit. Two documents' likeness is the cosine of their centred wide lanes, no less
than 0: about the share of clauses they have in common, with an error of about ``1 / sqrt(WIDE)``;
equal fingerprints have likeness 1.

The sums are aggregates over exploded paragraphs, combined before they leave a task. Documents are
dealt once, by ranges of ids that also hold the next document; all later steps keep that dealing.

Defined cases: null text counts as empty (all lanes 0); two documents without paragraphs are alike
(1), one without is unlike any with (0); null ids come after all others; repeated rows stand next
to each other and stay; a single document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelane.functions.ordinals import ordinal
from wavelane.llm.common import text_of

EXACT, WIDE = 8, 128
#: Ids that are dealt together.
RANGE = 1024
#: Two lanes of a wide vector travel in one 64-bit sum, 32 bits apart.
_PAIR = 0x0000000100000001


def paragraphs(text: Column) -> Column:
    """Lines with text, without white space around; an empty text has one empty entry, so that it isn't lost."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r"))), lambda x: x != "")
    return F.when(F.size(lines) == 0, F.array(F.lit(""))).otherwise(lines)


def sums(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` with ``exact`` and ``wide`` (arrays of bigint) and ``clauses``: the summed vectors of each key's texts."""
    lines = rows.select(*keys, F.explode(paragraphs(F.col(text))).alias("p"))
    # The digest is taken before a line becomes its clauses, so that they don't carry the line along.
    hashed = lines.select(*keys, F.when(F.col("p") != "", F.sha2("p", 256)).alias("h"), F.split("p", r"[.,;:!?|]+\s+").alias("cs"))
    clauses = hashed.select(*keys, "h", F.posexplode("cs").alias("i", "c"))
    there, first = F.col("h").isNotNull(), F.col("h").isNotNull() & (F.col("i") == 0)
    exact = [F.sum(F.when(first, F.conv(F.substring("h", 8 * j + 1, 8), 16, 10).cast("bigint")).otherwise(0)).alias(f"e{j}") for j in range(EXACT)]
    wide = []
    for word in range(WIDE // 64):
        bits = F.xxhash64(F.lit(word), "c")
        wide += [F.sum(F.when(there, F.shiftrightunsigned(bits, j).bitwiseAND(F.lit(_PAIR))).otherwise(0)).alias(f"w{32 * word + j}") for j in range(32)]
    added = clauses.groupBy(*keys).agg(F.sum(there.cast("bigint")).alias("clauses"), *exact, *wide)
    low, high = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)), lambda c: F.shiftrightunsigned(F.col(c), 32)
    lanes = [f(f"w{i}") for i in range(WIDE // 2) for f in (low, high)]
    return added.select(*keys, F.array(*[F.col(f"e{j}") % (1 << 32) for j in range(EXACT)]).alias("exact"), F.array(*lanes).alias("wide"), "clauses")


def plus(a: str | Column, b: str | Column, bits: int) -> Column:
    """Lanes of a multiset and of what is put in."""
    return F.zip_with(a, b, lambda x, y: (x + y) % (1 << bits))


def minus(a: str | Column, b: str | Column, bits: int) -> Column:
    """Lanes of a multiset without what is taken out."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(1 << bits)))


def written(exact: str | Column, wide: str | Column) -> Column:
    """All lanes in lowercase hex."""
    part = lambda lanes, width: F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), width, "0")), "")
    return F.concat(part(exact, 8), part(wide, 8))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two ``struct(exact, wide, clauses)``."""
    pairs = F.zip_with(F.transform(a["wide"], lambda x: 2.0 * x - a["clauses"]), F.transform(b["wide"], lambda x: 2.0 * x - b["clauses"]), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    start = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"))
    total = F.aggregate(
        pairs, start, lambda s, p: F.struct((s["xy"] + p["x"] * p["y"]).alias("xy"), (s["xx"] + p["x"] * p["x"]).alias("xx"), (s["yy"] + p["y"] * p["y"]).alias("yy")),
        lambda s: F.when((s["xx"] > 0) & (s["yy"] > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), s["xy"] / F.sqrt(s["xx"] * s["yy"])))).otherwise(0.0),
    )
    return F.when((a["exact"] == b["exact"]) & (a["wide"] == b["wide"]), 1.0).otherwise(total)


def with_next(docs: DataFrame) -> DataFrame:
    """``block, place, doc_id, text, next_text``: the next document in descending order of ids; after the last, the first.

    Ids are dealt in ranges; a range's last document takes the first text of the next range that
    has one, and one row a range is all that is compared between ranges.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    block = F.coalesce(-F.floor(F.col("doc_id") / RANGE).cast("bigint"), F.lit((1 << 62) - 1))
    dealt = rows.withColumn("block", block)
    inside = Window.partitionBy("block").orderBy(F.desc_nulls_last("doc_id"), "text")
    near = dealt.withColumn("place", F.row_number().over(inside)).withColumn("inner", F.lead("text").over(inside)).withColumn("last", F.lead(F.lit(1)).over(inside).isNull())
    firsts = dealt.groupBy("block").agg(F.min(F.struct((-F.coalesce("doc_id", F.lit(0))).alias("k"), "text")).alias("first")).select("block", F.col("first.text").alias("text"))
    ranked = ordinal(firsts.select("block"), [], ["block"], F.shiftright(F.col("block"), 12), "rank", total="ranks")
    heads = ranked.join(firsts, "block").select(F.when(F.col("rank") == 1, F.col("ranks")).otherwise(F.col("rank") - 1).alias("rank"), F.col("text").alias("head"))
    follow = ranked.select("block", "rank").join(heads, "rank").select("block", "head")
    return near.join(follow, "block").select("block", "place", "doc_id", "text", F.when(F.col("last"), F.col("head")).otherwise(F.col("inner")).alias("next_text"))


def compare(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``: one row for each row of ``docs``.

    The edited text is the document with its second half replaced by the beginning of the next one.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs).withColumn("edited", edited)
    texts = F.array(*[F.struct(F.lit(k).alias("which"), F.col(c).alias("t")) for k, c in enumerate(("text", "edited", "next_text"))])
    known = ["block", "place", "doc_id", "n_chars", "edited_sha256"]
    each = rows.select("block", "place", "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.explode(texts).alias("x")).select(*known, "x.which", "x.t")
    vectors = sums(each, [*known, "which"], "t").withColumn("f", F.struct("exact", "wide", "clauses"))
    own, other, after = (F.max(F.when(F.col("which") == k, F.col("f"))).alias(n) for k, n in enumerate(("own", "other", "after")))
    rows = vectors.groupBy(*known).agg(own, other, after)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written("own.exact", "own.wide").alias("fingerprint"), written("other.exact", "other.wide").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
