"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` names a ratio, a lower and an upper bound. ``measure`` adds the counts the ratios need
and ``verdict`` turns the table into one Boolean expression; both are built-in expressions, with
no shuffle, so a document costs one pass over its own text wherever it lies.

Defined cases: null text counts as empty (no words, base failed, not kept); ties and repeated rows
are judged alone; the input's columns travel in one struct, so no name of theirs can clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelane.llm.common import text_of

BLANK = " \t\n\x0b\f\r"


class Rule(NamedTuple):
    """A document passes when ``low <= ratio <= high``; None leaves a side open."""

    ratio: str
    low: float | None
    high: float | None


#: Common function words of the four languages the rules serve.
STOP_WORDS = (
    "the of and to in is that it for was on are with as be at by this from or have an not a "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er "
    "de la el en y que los se del las un por con no una su para es al lo como "
    "le et les des du dans une est pour qui il sur pas par plus au avec ce elle ne se"
).split()

RULES = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbols_per_word", None, 0.3),
    Rule("shouts_per_word", None, 0.2),
    Rule("stop_word_share", 0.01, None),
    Rule("duplicate_line_share", None, 0.5),
    Rule("repeated_word_share", None, 0.4),
)


def _words(text: Column) -> Column:
    """Words without white space around; an empty text has none."""
    trimmed = F.btrim(text, F.lit(BLANK))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _windows(words: str) -> Column:
    """Three-word windows in text order; words hold no spaces, so a space between them is unambiguous."""
    n = F.size(words)
    zipped = F.arrays_zip(F.slice(words, F.lit(1), n - 2).alias("a"), F.slice(words, F.lit(2), n - 2).alias("b"), F.slice(words, F.lit(3), n - 2).alias("c"))
    return F.when(n < 3, F.array().cast("array<string>")).otherwise(F.transform(zipped, lambda x: F.concat_ws(" ", x["a"], x["b"], x["c"])))


def _ordered(windows: str) -> Column:
    """Windows with their places, equal ones together; empty where no window is found twice, as in most texts."""
    placed = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(placed)).otherwise(F.array().cast("array<struct<w:string,i:int>>"))


def _twice(ordered: str) -> Column:
    """Places of the windows that are found twice or more, in text order."""
    m = F.size(ordered)
    pairs = F.arrays_zip(F.slice(ordered, F.lit(1), m - 1).alias("p"), F.slice(ordered, F.lit(2), m - 1).alias("q"))
    same = F.filter(pairs, lambda x: x["p"]["w"] == x["q"]["w"])
    both = F.flatten(F.transform(same, lambda x: F.array(x["p"]["i"], x["q"]["i"])))
    return F.when(m == 0, F.array().cast("array<int>")).otherwise(F.sort_array(F.array_distinct(both)))


def _covered(places: str) -> Column:
    """Words inside the windows at these places: three each, less where the next one begins earlier."""
    begun = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(places, begun, lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(3), x - s["last"])).alias("n")), lambda s: s["n"])


def measure(docs: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``q_*``: exact counts over the whole text."""
    plain = docs.select(F.struct(*docs.columns).alias("row"), text_of().alias("q_text")).withColumn("q_words", _words(F.col("q_text")))
    lines = F.filter(F.split("q_text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    counted = plain.withColumn("q_lines", lines).withColumn("q_windows", _windows("q_words")).withColumn("q_ordered", _ordered("q_windows")).withColumn("q_places", _twice("q_ordered"))
    letters = F.translate("q_text", BLANK, "")
    lowered = F.split(F.lower(F.btrim("q_text", F.lit(BLANK))), r"[\x20\x09-\x0D.,;:]+")
    return counted.select(
        "row",
        F.size("q_words").cast("bigint").alias("q_n_words"),
        F.length(letters).cast("bigint").alias("q_word_chars"),
        (F.length("q_text") - F.length(F.translate("q_text", "#*$%&|<>", ""))).cast("bigint").alias("q_n_symbols"),
        (F.length("q_text") - F.length(F.translate("q_text", "!", ""))).cast("bigint").alias("q_n_shouts"),
        F.size("q_lines").cast("bigint").alias("q_n_lines"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("bigint").alias("q_n_dup_lines"),
        _covered("q_places").cast("bigint").alias("q_n_repeat_words"),
        F.size(F.filter(lowered, lambda x: x.isin(*sorted(set(stop_words))))).cast("bigint").alias("q_n_stop_words"),
    )


def ratios() -> dict[str, Column]:
    """The ratios a rule may name; undefined ones (no words, no lines) are null."""
    words, lines = F.nullif(F.col("q_n_words"), F.lit(0)), F.nullif(F.col("q_n_lines"), F.lit(0))
    return {
        "n_words": F.col("q_n_words").cast("double"),
        "mean_word_chars": F.col("q_word_chars") / words,
        "symbols_per_word": F.col("q_n_symbols") / words,
        "shouts_per_word": F.col("q_n_shouts") / words,
        "stop_word_share": F.col("q_n_stop_words") / words,
        "duplicate_line_share": F.col("q_n_dup_lines") / lines,
        "repeated_word_share": F.col("q_n_repeat_words") / words,
    }


def base_failed() -> Column:
    return (F.col("q_n_words") < 50) | (100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words"))


def verdict(rules: Sequence[Rule] = RULES) -> Column:
    """The whole table as one expression: an undefined ratio fails its rule."""
    known, passed = ratios(), F.lit(True)
    for rule in rules:
        value = known[rule.ratio]
        for bound in ([value >= rule.low] if rule.low is not None else []) + ([value <= rule.high] if rule.high is not None else []):
            passed = passed & F.coalesce(bound, F.lit(False))
    return passed


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``."""
    measured = measure(docs)
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    counts = [F.col(f"q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    failed = base_failed()
    return measured.select(*own, *counts, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents the rules keep, with their own columns."""
    # A plain filter would be moved below the projections and repeat all their work in its own
    # condition; the id made beside the verdict, which it also reads, holds it above them.
    judged = measure(docs).select("row", (~base_failed() & verdict(rules)).alias("q_kept"), F.monotonically_increasing_id().alias("q_at"))
    return judged.filter(F.col("q_kept") & (F.col("q_at") >= 0)).select("row.*")


def sql(rules: Sequence[Rule] = RULES, stop_words: Sequence[str] = STOP_WORDS, table: str = "documents") -> str:
    """The same projection as a DuckDB statement over ``table``."""
    stops = ", ".join("'" + w + "'" for w in sorted(set(stop_words)))
    defined = {
        "n_words": "n_words::DOUBLE", "mean_word_chars": "word_chars::DOUBLE / nullif(n_words, 0)", "symbols_per_word": "n_symbols::DOUBLE / nullif(n_words, 0)",
        "shouts_per_word": "n_shouts::DOUBLE / nullif(n_words, 0)", "stop_word_share": "n_stop_words::DOUBLE / nullif(n_words, 0)",
        "duplicate_line_share": "n_dup_lines::DOUBLE / nullif(n_lines, 0)", "repeated_word_share": "n_repeat_words::DOUBLE / nullif(n_words, 0)",
    }
    tests = [f"coalesce({defined[r.ratio]} {sign} {bound}, false)" for r in rules for sign, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
    return f"""
WITH src AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {table}),
tok AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM src),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM tok)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + j AS p FROM dup, (VALUES (0), (1), (2)) o(j)) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_shouts,
 len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
 len(list_filter(regexp_extract_all(lower(t), '[^\\x20\\x09-\\x0D.,;:]+'), lambda x: x IN ({stops})))::BIGINT AS n_stop_words FROM tok LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(tests)} AS kept FROM f
"""
