"""Spelling variants: words one edit apart, found by pivotal grams, and the form each leads to.

Bigrams are ordered by the number of words that hold them, rare first. A word's *prefix* is its
three rarest bigrams (with all places of the last one); its *pivots* are two disjoint ones of them,
the cheapest pair by dynamic programming. One edit spoils at most one of two disjoint grams. So of
two words one edit apart, the one whose prefix ends earlier in the order keeps a pivot that stands
in the other's prefix, moved by one place at most.

The index holds pivots, the other side prefixes, and they meet in an equi-join. Position limits are
part of its key: left of the second pivot's start (or right of the first one's end) lies the edit,
on the other side of the pivot the words are equal, and of the stretch with the edit one half is
equal too. The key is a hash of those two equal parts. A prefix gram may stand for a pivot one place
on, so it takes the keys of all places that the limit leaves. Candidates are verified by their edit
distance; nothing is left out.

The bigrams of the alphabet number at most 8,100, whatever the corpus; their order is sent to all tasks.

Defined cases: null and empty texts have no words; a null id counts as an empty one in the hash
that picks deletions; rows that repeat count each time; ties of forms go to the first word in code
point order; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelane.llm.common import bounded_batches, cut, text_of

#: Letters of a word once A-Z are lowered: no more than 90, so that bigrams number at most 8,100.
LETTERS = "a-zÀ-ÿ"
#: Fewest code points of a word, and of its occurrences.
LEAST, TWICE = 7, 2
#: Of this many occurrences of pairs (document, run), one loses a code point.
EVERY = 31
#: Distinct words that a task adds up before it hands their counts on.
HELD = 1 << 19


def count_words(docs: DataFrame, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """``word, n``: occurrences of every run of ``least`` letters or more, thinned by the deletion rule."""
    bounded_batches(docs.sparkSession)
    run_of = re.compile(f"[{LETTERS}]{{{least},}}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for frame in frames:
            for doc, text in zip(frame["doc"], frame["text"]):
                lead = zlib.crc32(doc.encode())
                for word, n in Counter(run_of.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), lead)
                    if not h % every:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})

    doc = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    parts = docs.select(doc.alias("doc"), text_of().alias("text")).mapInPandas(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def gram_order(words: DataFrame) -> dict[str, int]:
    """Place of every bigram in the order, rare first; at most 8,100 for words of ``LETTERS``."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, 2)))
    counts = words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return {r.gram: k for k, r in enumerate(counts.orderBy("n", "gram").collect())}


def prefix_of(word: str, order: dict[str, int]) -> list[tuple[int, int]]:
    """(place in the word, place in the order) of the grams of its prefix, left to right."""
    ranked = [(i, order[word[i : i + 2]]) for i in range(len(word) - 1)]
    last = sorted([r for _, r in ranked])[2]
    return [(i, r) for i, r in ranked if r <= last]


def pivots_of(prefix: list[tuple[int, int]]) -> tuple[int, int]:
    """Places of the two disjoint grams with the least sum of orders: best single so far, best pair so far."""
    pair, single, waiting = (1 << 62, 0, 0), (1 << 62, 0), None
    for place, cost in prefix:
        if waiting and waiting[1] < place - 1:
            single, waiting = min(single, waiting), None
        pair = min(pair, (single[0] + cost, single[1], place))
        if waiting:
            single = min(single, waiting)
        waiting = (cost, place)
    return pair[1], pair[2]


def pivot_keys(word: str, first: int, second: int) -> list[str]:
    """Keys of a word by its own pivots."""
    n = len(word)
    middle, rest = second // 2, (n - first - 2) // 2
    return [
        f"<{word[:middle]} {word[second:]}",  # an edit in the right half of what is left of the second pivot
        f"<{word[middle:]}",  # in its left half
        f">{word[: first + 2]} {word[n - rest :]}",  # in the left half of what is right of the first pivot
        f">{word[: n - rest]}",  # in its right half
    ]


def prefix_keys(word: str, prefix: list[tuple[int, int]]) -> set[str]:
    """Keys of all words one edit away of which a gram of this prefix is the pivot."""
    n, out = len(word), set()
    for at, _ in prefix:
        tail = word[at:]
        for second in (at - 1, at, at + 1):
            if second >= 2:
                out.add(f"<{word[: second // 2]} {tail}")
                out.add(f"<{word[at - (second - second // 2) :]}")
        head = word[: at + 2]
        for length in (n - 1, n, n + 1):
            if length >= at + 4:
                rest = (length - at - 2) // 2
                out.add(f">{head} {word[n - rest :] if rest else ''}")
                out.add(f">{word[: length - rest]}")
    return out


def _keyed(words: DataFrame, order: dict[str, int], pivots: bool) -> DataFrame:
    """``key, word, n``: a row for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashed = xxhash.xxh3_64_intdigest
        for batch in batches:
            keys, ends = [], [0]
            for word in batch["word"].to_pylist():
                prefix = prefix_of(word, order)
                keys += [hashed(k) for k in (pivot_keys(word, *pivots_of(prefix)) if pivots else prefix_keys(word, prefix))]
                ends.append(len(keys))
            held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(keys, dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([held, batch["word"], batch["n"]], names=["keys", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "keys array<bigint>, word string, n bigint").select(F.explode("keys").alias("key"), "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: every ordered pair of words (``word, n``, distinct, five letters or more) one edit apart."""
    order = gram_order(words)
    index = _keyed(words, order, True).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    others = _keyed(words, order, False).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = index.join(others, "key").filter((F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1))
    both = F.array(*[F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in ("ab", "ba")])
    # A word has at most a few thousand near words (places times letters), so one task can hold all of them.
    return met.select(F.explode(both).alias("p")).select("p.*").repartition("word").dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the links ``word, form`` end. Counts grow tenfold along a link, so chains are short."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return at


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``word, n``."""
    words = cut(words)
    # The largest count first, then the first word in code point order.
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left")
    strong = -F.col("best.minus") >= ratio * F.col("n")
    formed = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.minus")).alias("form_n")))
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
