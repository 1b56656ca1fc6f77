import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from wavelane.functions import bootstrap, hashing, ordinals, quantiles, scans
from wavelane.operators import intervals


def test_ordinal_is_exact_on_a_hot_key(spark):
    rows = [("hot" if i % 3 else "cold", (i * 7919) % 1009) for i in range(1009)]
    df = spark.createDataFrame(rows, "k string, v bigint").repartition(5)
    out = ordinals.ordinal(df, ["k"], ["v"], F.floor(F.col("v") / 50), "pos", total="n").collect()
    for key in ("hot", "cold"):
        ordered = sorted(v for k, v in rows if k == key)
        got = {r["v"]: (r["pos"], r["n"]) for r in out if r["k"] == key}
        assert got == {v: (i + 1, len(ordered)) for i, v in enumerate(ordered)}


def test_quantiles_match_numpy_with_ties_signs_and_narrow_ranges(spark):
    rng = random.Random(3)
    groups = {
        "wide": [rng.gauss(0, 1) * 10 ** rng.randint(-6, 6) for _ in range(501)], "ties": [rng.randint(-3, 3) * 1.0 for _ in range(400)],
        "narrow": [100 + rng.random() * 1e-6 for _ in range(333)], "one": [2.5], "const": [0.0] * 9,
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("wide", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    probs = [0.0, 0.025, 0.5, 0.9, 0.99, 1.0]
    for r in quantiles.exact_quantiles(df, ["k"], "v", probs).collect():
        assert math.isclose(r["value"], float(np.quantile(groups[r["k"]], r["p"])), rel_tol=1e-9, abs_tol=1e-12)
    for r in quantiles.exact_quantiles(df, ["k"], "v", probs, method="nearest").collect():
        ordered = sorted(groups[r["k"]])
        assert r["value"] == ordered[max(math.ceil(len(ordered) * r["p"]), 1) - 1]


def _mix(x):
    for _ in range(2):
        x = (((x >> 16) ^ x) * bootstrap.MULTIPLIER) % bootstrap.WORD
    return (x >> 16) ^ x


def test_bootstrap_equals_plain_poisson_weights(spark):
    rows = [("a", i, float(i % 7), 1 + i % 3) for i in range(600)] + [("b", 5, 3.0, 2), (None, 6, 1.0, 1), (None, 7, 5.0, 1)]
    df = spark.createDataFrame(rows, "k string, c bigint, s double, n bigint").repartition(5)
    out = {r["k"]: r for r in bootstrap.percentile_ci(df, ["k"], ["c"], ["s"], "n", 9, 150).collect()}
    cuts = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(14)]
    for key in ("a", None):
        seed = int(hashlib.sha256(f"9:{key or ''}".encode()).hexdigest()[:8], 16)
        data = [(s, n, int(hashlib.sha256(str(c).encode()).hexdigest()[:8], 16)) for k, c, s, n in rows if k == key]
        means = []
        for rep in range(150):
            second = _mix((_mix(seed) + rep) % bootstrap.WORD)
            copies = [sum(_mix((second + spot) % bootstrap.WORD) >= math.floor(c * bootstrap.WORD) for c in cuts if c * bootstrap.WORD < bootstrap.WORD - 1) for _, _, spot in data]
            total = sum(w * n for w, (_, n, _) in zip(copies, data))
            if total:
                means.append(sum(w * s for w, (s, _, _) in zip(copies, data)) / total)
        lo, hi = np.quantile(means, [0.025, 0.975])
        assert math.isclose(out[key]["s_lo"], lo) and math.isclose(out[key]["s_hi"], hi)
    assert out["b"]["s_lo"] == out["b"]["s_hi"] == 1.5


def test_bootstrap_weights_are_poisson():
    w = bootstrap.weights(12345, np.arange(3000) * 7919, 500)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - math.exp(-1)) < 0.005
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.15


def test_bootstrap_hands_on_full_tables_of_sums(spark, monkeypatch):
    """More keys than a task holds at once."""
    rows = [(k, c, float(c % 5), 1) for k in range(40) for c in range(12)]
    df = spark.createDataFrame(rows, "k bigint, c bigint, s double, n bigint")
    whole = sorted(tuple(r) for r in bootstrap.percentile_ci(df, ["k"], ["c"], ["s"], "n", 1, 50).collect())
    monkeypatch.setattr(bootstrap, "HELD", 500)
    assert sorted(tuple(r) for r in bootstrap.percentile_ci(df, ["k"], ["c"], ["s"], "n", 1, 50).collect()) == whole


def test_set_hash_ignores_order_and_copies(spark):
    a = spark.createDataFrame([("x", i % 300) for i in range(900)], "k string, v bigint")
    b = spark.createDataFrame([("x", 299 - i) for i in range(300)], "k string, v bigint").repartition(4)
    c = spark.createDataFrame([("x", i) for i in range(299)], "k string, v bigint")
    h = [hashing.set_hash(d, ["k"], F.col("v")).first() for d in (a, b, c)]
    assert h[0] == h[1] and h[0]["members"] == 300 and h[2]["set_hash"] != h[0]["set_hash"]


def test_intervals_against_brute_force(spark):
    rng = random.Random(5)
    spans = [(s, lo, lo + rng.randint(0, 40)) for s in range(3) for lo in [rng.randint(0, 400) for _ in range(30)]]
    df = spark.createDataFrame(spans, "s bigint, lo_tick bigint, hi_tick bigint").repartition(3)
    covered = {s: set() for s in range(3)}
    for s, a, z in spans:
        covered[s].update(range(a, z))
    got = {r["s"]: r["covered"] for r in intervals.union_length(df, ["s"], block=16).collect()}
    assert got == {s: len(v) for s, v in covered.items()}
    for r in intervals.merged(df, ["s"], block=16).collect():
        assert r["hi"] >= r["lo"] and set(range(r["lo"], r["hi"])) <= covered[r["s"]]


def test_allowed_starts_cross_rate_and_touching(spark):
    length = 10
    rows = [(1, 7, 44100, 3, 40), (2, 7, 48000, 0, 60), (3, 8, 48000, 0, 25), (4, 7, 44100, 0, 5)]
    protected = [(7, 1600, 3200), (7, 3100, 4000), (9, 0, 100)]
    df = spark.createDataFrame(rows, "row_id bigint, src bigint, sample_rate int, origin bigint, length_samples bigint")
    p = spark.createDataFrame(protected, "src bigint, lo_tick bigint, hi_tick bigint")
    got = {}
    for r in intervals.allowed_starts(df, p, "src", length).collect():
        got.setdefault(r["row_id"], set()).update(range(r["lo"], r["hi"] + 1))
    for row_id, src, rate, origin, size in rows:
        t = 160 if rate == 44100 else 147
        want = {s for s in range(0, size - length + 1) if all((origin + s + length) * t <= lo or (origin + s) * t >= hi for q, lo, hi in protected if q == src)}
        assert got.get(row_id, set()) == want


def test_affine_maps_compose_like_a_loop():
    """Groups that end inside batches, cross several, and have null ids."""
    import pandas as pd

    rng = np.random.default_rng(2)
    ids = np.repeat([1.0, 2.0, np.nan, 3.0, 4.0], [40, 1, 33, 150, 7])
    a, b = rng.uniform(0, 1, len(ids)), rng.normal(size=len(ids))
    a[rng.random(len(ids)) < 0.1] = 0.0
    rows = pd.DataFrame({"k": ids, "a": a, "b": b})
    for emit in ("after", "before"):
        want, last, x, y = [], None, 1.0, 0.0
        for k, p, q in zip(ids, a, b):
            k = None if np.isnan(k) else k
            if k != last or not want:
                last, x, y = k, 1.0, 0.0
            before = (x, y)
            x, y = p * x, p * y + q
            want.append((x, y) if emit == "after" else before)
        for size in (1, 7, 64, 500):
            parts = [rows.iloc[i : i + size].copy() for i in range(0, len(rows), size)]
            got = pd.concat(scans._running(iter(parts), ["k"], "a", "b", emit))
            assert np.allclose(got[["a", "b"]].to_numpy(), np.array(want), rtol=1e-9, atol=1e-12), (emit, size)
