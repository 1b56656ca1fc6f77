"""Secret scan: fixed patterns plus a randomness test battery, all in built-in expressions.

Base spans come from three patterns. The battery looks at every maximal run of 16 or more
characters of base64, of base64url and of letters and digits alone, so a key is seen as part of a
path or after a dashed prefix too. The encoding is inferred from the characters (decimal, hex,
base32, base36, base64), the run becomes symbol values of that alphabet, and three tests ask
whether uniform random symbols could look like it: chi-squared uniformity over the alphabet, runs
about the alphabet's middle, and lag-one serial correlation. A run's p-value is three times the
smallest of them. Over the whole corpus, per encoding and length class, the Benjamini-Hochberg
step-up rule then rejects runs as not random: of those dismissed, a share ``ALPHA`` at most is
expected to be random.

What the battery leaves must also be unlike text. A run's odds are its probability as uniform
symbols of its encoding over its probability as words, numbers and separators (a fixed chain over
pairs of characters, with shares for repeats, for steps of one and for anything). If a run is drawn
from that chain, the expected odds are 1 at most, so the step-up rule on odds, again per encoding
and length class, holds the share of such text among the reported ``random`` spans to ``ALPHA``:
with ``k`` of ``n`` runs reported, each has odds of ``n / (ALPHA * k)`` at least. Dismissed runs
count as odds 0. Digits alone have a chain of their own, with shares for zeros, repeats and steps.
A
reported run that holds other reported ones is a span in their place only where what it adds has
odds of ``1 / ALPHA`` at least. Both rules need counts in fixed bins only (a few thousand rows for most inputs,
bounded for any); their cut-offs are one row that goes to every task.

A document's spans are made from its own text in one projection; documents are never shuffled.

Defined cases: null text counts as empty (no spans; it stays null); repeated rows are scanned each;
the input's columns travel in one struct, so no name of theirs can clash; an empty table gives no
rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelane.functions.ordinals import attach_row
from wavelane.llm.common import text_of

#: Kinds in the order that breaks ties between spans with one start.
KINDS = ("assign", "access", "hex", "random")
#: The base patterns, the group that must be long enough, and how long.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: Cheap tests a text must pass before a pattern's matches are taken from it.
HINTS = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA", "hex": r"[0-9a-f]{32}", "random": r"[A-Za-z0-9+/_-]{16}"}
RUNS = (r"[A-Za-z0-9+/]{16,}", r"[A-Za-z0-9_-]{16,}", r"[A-Za-z0-9]{16,}")
DIGITS, UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ALPHABETS = {"decimal": DIGITS, "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "base32": UPPER + "234567", "base36": DIGITS + LOWER, "BASE36": DIGITS + UPPER, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_"}
LENGTHS = (16, 20, 24, 32, 48, 96)
ALPHA = 0.05
STEP, BINS = 0.05, 400
#: Odds are kept as whole bits, rounded down, from 0 to this.
MOST_BITS = 40
SYMBOLS = UPPER + LOWER + DIGITS + "+/-_"
#: Quarter bits, as base-62 digits, of each next letter at a word's start and after each letter: half English prose and
#: identifiers, half the four languages of the test documents.
PAIRS = """
ELHHDKQLFZWJLIEKSHGBOQMgcY QOIJNYPUGcVFJ9QPcEEAHSUXUj GZRV8YacKIe7ZZFVeMNYHfdeFZ FfSaEbh8BjIITaAXdMRENcfiRi
FNVN5YVMCchOcNCXhMIKKcReSh FTKFJOTRJfbGPBOOU9DHQRRNWT FUTRFGVT9eYJWU9TcCMJHZbeSZ DPUa6aQGFeWKSGJVeHEKJUReRU
AOWh5fXKGnYNaLGXgMKGUXPmbW ORINFJOZVgdJK6CQZNEDfPbUoS 5TST8TTTRTSTTTEQTRITGTTTTT KSTP3TQLHXWJVLPKVRESOVJXWW
EWWO7EdiDgfEaZGWgYJMKcdlCf BMbP6cfeDgbSMZECgTKSJfdgag GPJBCTCMIdUNWLETXOHAQSRgZa TPMKTGVjLcXOK6SMcAIJCRPbec
9cSQBHdPLgaEVaDJeCMFJVXgJg XYYWYXYYXXYPXVTYXTVX1YXYYY DPOQ6WMOGgTQNIEVeHIHNSSjOb KVHU9ZTDFXXQRSJLVQH8KeViQk
HUTYCYe6AocRZSGThGKMLcTjPP JONM9OTSLjaGJBMJWDGFbWYFjb AaYb4ZaZ9cbbUXIabZWabaZbbb CZaSFZd4BddTcNIbaIMZbcWadc
ETBVDRXUEYYMNYJDPLR8XPXQPV IMQTCSVIHZZLLFFCXMCBWVKYVU GNMR8VPRFTQNNTORRQNM6QWWVP
""".split()
#: Shares of the chain of characters: the kinds' own pairs, the same again, one further, anything.
SHARES = (0.8, 0.06, 0.06, 0.08)
#: Of numbers: a zero, the same digit, the next one, anything.
NUMBERS = (0.2, 0.2, 0.2, 0.4)
#: After a lower-case letter, an upper-case one, a digit, a separator: how often each of these follows.
FOLLOW = {"l": (0.88, 0.02, 0.03, 0.07), "u": (0.42, 0.5, 0.04, 0.04), "d": (0.12, 0.08, 0.6, 0.2), "s": (0.6, 0.15, 0.2, 0.05)}


def _kind(c: str) -> str:
    return "l" if c in LOWER else "u" if c in UPPER else "d" if c in DIGITS else "s"


def word_bits() -> list[float]:
    """Bits of ``SYMBOLS[j]`` after ``SYMBOLS[i]`` in text, at ``i * len(SYMBOLS) + j``; a run begins as after a separator."""
    digits = DIGITS + UPPER + LOWER
    letter = [[2 ** (-digits.index(x) / 4) for x in row] for row in PAIRS]
    letter = [[x / sum(row) for x in row] for row in letter]
    own, same, further, any_ = SHARES
    out = []
    for a in SYMBOLS:
        for b in SYMBOLS:
            k = _kind(b)
            share = FOLLOW[_kind(a)]["luds".index(k)]
            if k in "lu":
                share *= letter[1 + LOWER.index(a.lower()) if _kind(a) in "lu" else 0][LOWER.index(b.lower())]
            else:
                share /= 10 if k == "d" else 4
            step = SYMBOLS.index(b) - SYMBOLS.index(a) == 1 and k == _kind(a)
            out.append(-math.log2(own * share + same * (a == b) + further * step + any_ / len(SYMBOLS)))
    return out


def number_bits() -> list[float]:
    """The same for runs of digits: zeros, the same digit, the next one and anything; other places are never looked up."""
    zero, same, further, any_ = NUMBERS
    own = lambda a, b: zero * (b == "0") + same * (a == b) + further * (a in DIGITS and (ord(b) - ord(a)) % 10 == 1) + any_ / 10
    return [-math.log2(own(a, b)) if b in DIGITS else 0.0 for a in SYMBOLS for b in SYMBOLS]


def _spans(text: Column, pattern: str, group: int, least: int, kind: str) -> Column:
    """``struct(start, kind, end)`` of the leftmost non-overlapping matches whose group is long enough."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m)).alias("width"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.length(m)).alias("inner"),
    )
    number = KINDS.index(kind)

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["gap"])
        end = start + F.coalesce(x["width"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["inner"] >= least, F.concat(done["out"], span)).otherwise(done["out"]).alias("out"))

    empty = F.struct(F.lit(0).alias("at"), _no_spans().alias("out"))
    return F.aggregate(parts, empty, step, lambda done: done["out"])


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def base_spans(text: Column) -> Column:
    found = [F.when(text.rlike(HINTS[k]), _spans(text, *BASE[k], k)).otherwise(_no_spans()) for k in BASE]
    return F.sort_array(F.concat(*found))


def _encoding(v: Column) -> Column:
    tests = [("decimal", "^[0-9]+$"), ("hex", "^[0-9a-f]+$"), ("HEX", "^[0-9A-F]+$"), ("base32", "^[A-Z2-7]+$"), ("base36", "^[0-9a-z]+$"), ("BASE36", "^[0-9A-Z]+$"), ("base64", "^[A-Za-z0-9+/]+$"), ("base64url", "^[A-Za-z0-9_-]+$")]
    out = F.lit(None).cast("string")
    for name, pattern in reversed(tests):
        out = F.when(v.rlike(pattern), name).otherwise(out)
    return out


def upper_tail(z: Column) -> Column:
    """Normal upper tail by the logistic approximation (absolute error below 2e-4)."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.070565992 * z * z * z)))


def battery(runs: Column) -> Column:
    """For an array of ``struct(start, v)``: ``struct(start, end, class, bin, odds, weight, joined)`` of the runs.

    ``weight`` is the odds' bits as they are, ``joined`` whether the run has a separator.
    """
    listed = lambda x: F.split(F.lit(",".join(f"{b:.4f}" for b in x)), ",").cast("array<double>")
    bits, digits = listed(word_bits()), listed(number_bits())
    alphabets = F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])
    named = F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["v"].alias("v"), _encoding(r["v"]).alias("code")))
    spelled = F.transform(named, lambda r: F.struct(r["start"].alias("start"), r["code"].alias("code"), alphabets[r["code"]].alias("letters"), F.filter(F.split(r["v"], ""), lambda c: c != "").alias("chars")))
    valued = F.transform(spelled, lambda r: F.struct(r["start"].alias("start"), r["code"].alias("code"), F.length(r["letters"]).alias("a"), F.transform(r["chars"], lambda c: F.instr(r["letters"], c) - 1).alias("x"), F.transform(r["chars"], lambda c: F.instr(F.lit(SYMBOLS), c) - 1).alias("y")))

    def moments(r: Column) -> Column:
        n = F.size(r["x"])
        counts = F.transform(F.sequence(F.lit(0), r["a"] - 1), lambda s: F.size(F.filter(r["x"], lambda e: e == s)))
        fits = F.aggregate(counts, F.lit(0.0), lambda t, c: t + (c - n / r["a"]) * (c - n / r["a"]))
        high = F.size(F.filter(r["x"], lambda e: 2 * e >= r["a"]))
        pairs = F.arrays_zip(F.slice(r["x"], F.lit(1), n - 1).alias("p"), F.slice(r["x"], F.lit(2), n - 1).alias("q"))
        turns = F.size(F.filter(pairs, lambda e: (2 * e["p"] >= r["a"]) != (2 * e["q"] >= r["a"])))
        total = F.aggregate(r["x"], F.lit(0.0), lambda t, e: t + e)
        squares = F.aggregate(r["x"], F.lit(0.0), lambda t, e: t + e * e)
        lagged = F.aggregate(pairs, F.lit(0.0), lambda t, e: t + e["p"] * e["q"])
        ends = F.element_at(r["x"], 1) + F.element_at(r["x"], -1)
        after = F.arrays_zip(F.concat(F.array(F.lit(SYMBOLS.index("-"))), F.slice(r["y"], F.lit(1), n - 1)).alias("p"), r["y"].alias("q"))
        at = lambda e: e["p"] * len(SYMBOLS) + e["q"]
        words = F.when(r["code"] == "decimal", F.aggregate(after, F.lit(0.0), lambda t, e: t + F.get(digits, at(e)))).otherwise(F.aggregate(after, F.lit(0.0), lambda t, e: t + F.get(bits, at(e))))
        return F.struct(r["start"].alias("start"), r["code"].alias("code"), r["a"].alias("a"), (words - n * F.log2(r["a"])).alias("odds"), F.exists(r["y"], lambda e: e >= 62).alias("joined"), n.cast("double").alias("n"), (fits * r["a"] / n).alias("chi"), high.cast("double").alias("hi"), turns.cast("double").alias("turns"), total.alias("total"), squares.alias("squares"), lagged.alias("lagged"), ends.cast("double").alias("ends"))

    def p_values(m: Column) -> Column:
        n, df = m["n"], m["a"] - 1
        chi = upper_tail((F.pow(m["chi"] / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        both = 2 * m["hi"] * (n - m["hi"])
        spread = both * (both - n) / (n * n * (n - 1))
        runs_z = F.abs(m["turns"] - both / n) / F.sqrt(F.greatest(spread, F.lit(1e-9)))
        runs_p = F.when(both == 0, F.pow(F.lit(0.5), n - 1)).otherwise(2 * upper_tail(runs_z))
        mean = m["total"] / n
        power = m["squares"] - n * mean * mean
        together = m["lagged"] - mean * (2 * m["total"] - m["ends"]) + (n - 1) * mean * mean
        serial_z = F.abs(together / power + 1 / n) * F.sqrt(n)
        serial_p = F.when(power <= 0, 0.0).otherwise(2 * upper_tail(serial_z))
        p = F.least(F.lit(1.0), 3 * F.least(chi, runs_p, serial_p))
        place = F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) / STEP)).cast("int")
        length = F.lit(0)
        for i, least in enumerate(LENGTHS):
            length = F.when(n >= least, i).otherwise(length)
        return F.struct(m["start"].alias("start"), (m["start"] + n.cast("int")).alias("end"), F.concat_ws("/", m["code"], length.cast("string")).alias("class"), place.alias("bin"), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(MOST_BITS)), m["odds"]))).cast("int").alias("odds"), m["odds"].alias("weight"), m["joined"].alias("joined"))

    return F.transform(F.transform(valued, moments), p_values)


def candidates(text: Column) -> Column:
    """Runs of encoding characters with their battery results, by start."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,v:string>>").alias("out"))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["gap"])
        run = F.array(F.struct(start.alias("start"), x["v"].alias("v")))
        return F.struct((start + F.coalesce(F.length(x["v"]), F.lit(0))).alias("at"), F.when(x["v"].isNotNull(), F.concat(done["out"], run)).otherwise(done["out"]).alias("out"))

    def places(pattern: str) -> Column:
        parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"))
        return F.aggregate(parts, empty, step, lambda done: done["out"])

    none = F.array().cast("array<struct<start:int,end:int,class:string,bin:int,odds:int,weight:double,joined:boolean>>")
    return F.when(text.rlike(HINTS["random"]), battery(F.sort_array(F.array_distinct(F.concat(*[places(p) for p in RUNS]))))).otherwise(none)


def told_apart(runs: Column, alpha: float) -> Column:
    """Of reported runs: joined ones that add enough to the runs in them, and the others outside of those."""
    plain = F.filter(runs, lambda r: ~r["joined"])
    within = lambda q, r: (q["start"] >= r["start"]) & (q["end"] <= r["end"])
    held = lambda r: F.aggregate(F.filter(plain, lambda q: within(q, r)), F.lit(0.0), lambda t, q: t + q["weight"])
    wide = F.filter(runs, lambda r: r["joined"] & ((held(r) == 0) | (r["weight"] >= held(r) - math.log2(alpha))))
    return F.concat(wide, F.filter(plain, lambda q: ~F.exists(wide, lambda r: within(q, r))))


def cut_offs(tested: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One row: a map from class to the smallest bin dismissed as not random (null: none) and the fewest bits reported.

    Classes in which nothing is reported are not in the map.
    """
    bins = tested.select(F.explode("secret_runs").alias("r")).groupBy("r.class", "r.bin", "r.odds").agg(F.count(F.lit(1)).alias("n"))
    of_class = Window.partitionBy("class")
    upto, whole = F.sum("n").over(of_class.orderBy(F.desc("bin"))), F.sum("n").over(of_class)
    ranked = bins.withColumn("whole", whole).withColumn("rejected", F.pow(F.lit(10.0), -F.col("bin") * STEP) <= alpha * upto / F.col("whole"))
    edged = ranked.withColumn("edge", F.min(F.when(F.col("rejected"), F.col("bin"))).over(of_class))
    alive = F.when(F.col("edge").isNull() | (F.col("bin") < F.col("edge")), F.col("n")).otherwise(0)
    reported = edged.withColumn("alive", alive).withColumn("upto", F.sum("alive").over(of_class.orderBy(F.desc("odds"))))
    passes = reported.filter((F.col("alive") > 0) & (F.pow(F.lit(2.0), F.col("odds")) * alpha * F.col("upto") >= F.col("whole")))
    edges = passes.groupBy("class").agg(F.min("edge").alias("edge"), F.min("odds").alias("least"))
    return edges.agg(F.map_from_entries(F.collect_list(F.struct("class", F.struct("edge", "least")))).alias("secret_edges"))


def find(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``row`` (all columns of ``docs``), ``secret_base``, ``secret_spans``: arrays of ``struct(start, kind, end)``, sorted."""
    text = text_of(F.col("row.text"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    tested = rows.withColumn("secret_runs", candidates(text))
    edged = attach_row(tested.withColumn("secret_base", base_spans(text)), cut_offs(tested, alpha))
    edge = lambda r: F.try_element_at(F.col("secret_edges"), r["class"])
    random = F.filter("secret_runs", lambda r: F.coalesce(r["odds"] >= edge(r)["least"], F.lit(False)) & F.coalesce(r["bin"] < edge(r)["edge"], F.lit(True)))
    as_spans = F.transform(told_apart(random, alpha), lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), r["end"].alias("end")))
    return edged.select("row", "secret_base", F.sort_array(F.concat("secret_base", as_spans)).alias("secret_spans"))


def written(spans: str | Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans``: one row for each row of ``docs``."""
    found = find(docs.select("doc_id", "text"), alpha)
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == KINDS.index(k))).cast("bigint").alias(f"n_{k}")
    return found.select("row.doc_id", *[count(k) for k in KINDS], F.sha2(written("secret_base"), 256).alias("base_sha256"), written("secret_spans").alias("spans"))


def redact(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``docs`` with every span (overlapping ones together) replaced by ``[kind]``; ``n_chars`` follows where it is a column."""
    found = find(docs, alpha)
    names = F.array(*[F.lit(k) for k in KINDS])
    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(done: Column, s: Column) -> Column:
        piece = F.array(F.substring(F.col("row.text"), done["at"] + 1, s["start"] - done["at"]), F.concat(F.lit("["), names[s["kind"]], F.lit("]")))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(s["start"] >= done["at"], F.concat(done["out"], piece)).otherwise(done["out"]).alias("out"))

    tail = lambda done: F.concat(F.array_join(done["out"], ""), F.substring(F.col("row.text"), done["at"] + 1, F.length("row.text")))
    clean = F.when(F.size("secret_spans") == 0, F.col("row.text")).otherwise(F.aggregate("secret_spans", begun, step, tail))
    out = found.withColumn("secret_text", clean)
    changed = {"text": F.col("secret_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("secret_spans") > 0, F.length("secret_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
