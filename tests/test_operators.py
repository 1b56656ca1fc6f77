import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wavelane.functions.ordinals import block
from wavelane.operators import aggregates, graph, joins, rules, sampling, selection, sequence, signal
from wavelane.streaming import monitors


def test_greedy_selection_equals_the_sequential_scan(spark):
    for seed in range(3):
        rng = random.Random(seed)
        # A third of the rows share one key.
        rows = [(i, 0 if rng.random() < 0.34 else rng.randint(1, 40), rng.randint(0, 30)) for i in range(150)]
        used_p, used_w, want = set(), set(), set()
        for i, p, w in rows:
            if p not in used_p and w not in used_w:
                want.add(i)
                used_p.add(p)
                used_w.add(w)
        df = spark.createDataFrame(rows, "id bigint, p bigint, w bigint").repartition(4)
        got = graph.greedy_distinct(df, "id", "id", ["p", "w"]).collect()
        assert len(got) == 150 and {r["id"] for r in got if r["selected"]} == want
    chain = spark.createDataFrame([(1, "p1", "w1"), (2, "p1", "w2"), (3, "p2", "w2")], "id int, p string, w string")
    assert {r["id"] for r in graph.greedy_distinct(chain, "id", "id", ["p", "w"]).filter("selected").collect()} == {1, 3}


def test_components_on_chains_and_hubs(spark):
    rows = [(i, f"k{i}") for i in range(40)] + [(i + 1, f"k{i}") for i in range(39)] + [(i, "hub") for i in range(100, 160)]
    df = spark.createDataFrame(rows, "id bigint, alias string").repartition(4)
    got = {r["id"]: r["component"] for r in graph.alias_components(df).collect()}
    assert got == {**{i: 0 for i in range(40)}, **{i: 100 for i in range(100, 160)}}


def test_balanced_selection_and_disjoint_roles(spark):
    rng = random.Random(1)
    rows = [(i, f"g{i % 5}", f"a{rng.randint(0, 6)}", f"p{rng.randint(0, 60)}", f"w{rng.randint(0, 50)}") for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, genre string, author string, pcm string, work string")
    def key(r):
        import hashlib
        return hashlib.sha256(f"7:{r[0]}".encode()).hexdigest()
    authors, seen, want = {}, set(), []
    counts = {g: sum(r[1] == g for r in rows) for g in {r[1] for r in rows}}
    for g in sorted(counts, key=lambda g: (counts[g], g)):
        n = 0
        for r in sorted((r for r in rows if r[1] == g), key=key):
            if authors.get(r[2], 0) >= 3 or {r[3], r[4]} & seen:
                continue
            want.append(r[0])
            authors[r[2]] = authors.get(r[2], 0) + 1
            seen |= {r[3], r[4]}
            n += 1
            if n == 4:
                break
    for page in (2, 256):
        got = graph.select_balanced(df, "id", "genre", "author", ["pcm", "work"], 7, page=page).orderBy("pick").collect()
        assert [r["id"] for r in got] == want
    draws = spark.createDataFrame([(d, (d * 7 + j) % 60, (d + j) % 45) for d in range(60) for j in range(3)], "draw_id bigint, track_id bigint, src bigint")
    chosen = graph.disjoint_roles(draws, 4, 11, ["track_id", "src"]).collect()
    keys = [{("t", (d["draw_id"] * 7 + j) % 60) for j in range(3)} | {("s", (d["draw_id"] + j) % 45) for j in range(3)} for d in chosen]
    assert len(chosen) == 4 and all(not (keys[a] & keys[b]) for a in range(4) for b in range(a))


def test_balanced_schedule_contract(spark):
    rows = [(i, "m" if i % 4 else "s", f"t{i // 3}-{'m' if i % 4 else 's'}", 1.0 + i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "row_id bigint, corpus string, track_id string, sampling_weight double")
    spans = spark.createDataFrame([(i, 0, 9) for i in range(90)] + [(i, 20, 24) for i in range(90)], "row_id bigint, lo bigint, hi bigint")
    out = sampling.balanced_schedule(df, spans, {"m": 4, "s": 1}, 30, 5).collect()
    assert len(out) == 150
    owner = {r[0]: r[2] for r in rows}
    for step in range(30):
        draw = sorted((r["slot"], r["corpus"], r["track_id"]) for r in out if r["step"] == step)
        assert [d[1] for d in draw] == ["m"] * 4 + ["s"] and len({d[2] for d in draw}) == 5
    assert all(owner[r["row_id"]] == r["track_id"] and (0 <= r["start"] <= 9 or 20 <= r["start"] <= 24) for r in out)
    uses = {}
    for r in out:
        if r["corpus"] == "m":
            uses[r["track_id"]] = uses.get(r["track_id"], 0) + 1
    assert max(uses.values()) - min(uses.values()) <= 1


def test_repairs_take_the_nearest_unused_start(spark):
    specs = spark.createDataFrame([(1, 1, 5), (2, 1, 6), (3, 1, 30), (4, 2, 0)], "spec_id bigint, row_id bigint, start bigint")
    spans = spark.createDataFrame([(1, 0, 4), (1, 28, 40), (2, 0, 3)], "row_id bigint, lo bigint, hi bigint")
    got = {r["spec_id"]: (r["start"], r["moved"]) for r in sequence.repair_overlaps(specs, spans).collect()}
    assert got == {1: (4, True), 2: (3, True), 3: (30, False), 4: (0, False)}


def test_recordings_count_once_and_copies_do_not_reweight(spark):
    rows = [("s1", 2.0, 1.0)] * 3 + [("s2", 4.0, 1.0)]
    df = spark.createDataFrame(rows, "source string, a double, b double").withColumn("g", F.lit("x"))
    assert aggregates.paired_sources(df, ["g"], "source", {"d": ("a", "b")}).agg(F.avg("d")).first()[0] == 2.0
    clustered = spark.createDataFrame([("t1", 0.0)] * 10 + [("t2", 10.0)], "track_id string, v double").withColumn("k", F.when(F.col("track_id") == "t1", 1).otherwise(2)).withColumn("g", F.lit("x"))
    ci = aggregates.cluster_bootstrap_ci(clustered, ["g"], "k", ["v"], 3, 500).first()
    assert abs(ci["v_mean"] - 10 / 11) < 1e-12 and ci["v_hi"] > 5


def test_failures_are_loud(spark):
    m = spark.createDataFrame([("t", 1.0), ("t", -1.0)], "track_id string, w double")
    with pytest.raises(Exception, match="sampling weights"):
        aggregates.recording_weights(m, "track_id", "w").collect()
    with pytest.raises(Exception, match="duplicate review"):
        joins.join_reviews(spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(1, "a"), (1, "b")], "id int, s string")).collect()
    strata = spark.createDataFrame([(i, str(i)) for i in range(9)], "id int, s string")
    with pytest.raises(Exception, match="cap cannot preserve"):
        sampling.stratified_cap(strata, ["s"], "id", 4, 1).collect()
    bad = strata.withColumn("violations", rules.violations([("nine", F.col("id") == 8)]))
    with pytest.raises(Exception, match="rule broken"):
        rules.require_clean(bad).collect()
    assert rules.held(bad).count() == 1


def test_manifest_rules_find_planted_duplicates(spark):
    cols = "row_id bigint, track_id string, corpus string, schema_version int, recipe_hash string, split string, sample_rate int, channel_role string, held_out boolean, start_sample bigint, length_samples bigint, residual_alignment_samples int, measured_cutoff_hz double, clean_path string"
    ok = (1, "a:t", "a", 2, "r", "train", 48000, "mono", False, 0, 10, 0, 9000.0, "x/y")
    rows = [ok, ok, (2, *ok[1:13], "x/../y"), (3, *ok[1:12], float("nan"), "x")]
    names = [c.split()[0] for c in cols.split(", ")]
    out = rules.validate_manifest(spark.createDataFrame(rows, cols), "r", ["a"], required=names).select("row_id", F.array_join("violations", ",").alias("v")).collect()
    assert sorted((r["row_id"], r["v"]) for r in out) == [(1, "duplicate_row_id"), (1, "duplicate_row_id"), (2, "unsafe_path"), (3, "cutoff")]


def test_manifest_needs_rows_and_all_fields(spark):
    cols = [c for c in rules.REQUIRED_FIELDS if c not in ("sample_rate", "start_sample", "length_samples", "residual_alignment_samples", "measured_cutoff_hz", "schema_version", "held_out", "codec_mode")]
    schema = ", ".join(f"{c} string" for c in cols) + ", sample_rate int, start_sample bigint, length_samples bigint, residual_alignment_samples int, measured_cutoff_hz double, schema_version int, held_out boolean"
    row = {c: "x/y" for c in cols} | {"track_id": "a:t", "corpus": "a", "recipe_hash": "r", "split": "train", "channel_role": "mono", "sample_rate": 48000, "start_sample": 0, "length_samples": 5, "residual_alignment_samples": 0, "measured_cutoff_hz": 900.0, "schema_version": 2, "held_out": False}
    rows = [row | {"row_id": "1"}, row | {"row_id": "2", "encoder": None, "degraded_path": None}, row | {"row_id": "3", "degraded_path": "/abs"}]
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    out = {r.row_id: (r.missing_fields, r.violations) for r in rules.validate_manifest(rules.require_rows(df), "r", ["a"]).collect()}
    assert out["1"] == (["codec_mode"], ["missing_field"])  # no such column
    assert out["2"] == (["encoder", "codec_mode", "degraded_path"], ["missing_field", "unsafe_path"])
    assert out["3"][1] == ["missing_field", "unsafe_path"]
    with pytest.raises(ValueError, match="at least one row"):
        rules.require_rows(df.limit(0))


def test_receipts_bind_reviews(spark):
    evidence = spark.createDataFrame([(1, "https://a/b", "p1", "h1"), (2, "http://a/b", "p2", "h2"), (2, "https://a", "p9", "h9"), (3, "https://a", "p3", "other")], "id bigint, url string, path string, sha256 string")
    kept = spark.createDataFrame([("p1", "h1"), ("p2", "h2"), ("p3", "h3")], "path string, sha256 string")
    got = {r.id: sorted(r.receipt_errors) for r in rules.receipt_errors(evidence, kept).collect()}
    assert got == {1: [], 2: ["missing_or_changed_primary_evidence", "missing_primary_evidence_url"], 3: ["missing_or_changed_primary_evidence"]}


def test_results_do_not_depend_on_partitioning(spark):
    rows = [(i, f"c{i % 3}", f"t{i % 17}", ((i * 37) % 101) / 7.0) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id bigint, corpus string, track_id string, v double")
    for op in (
        lambda d: selection.median_case(d.select("corpus", "row_id", "v"), ["corpus"], "v", "row_id"),
        lambda d: sampling.stratified_cap(d, ["corpus"], "row_id", 40, 3).select("row_id", "mandatory"),
        lambda d: aggregates.top_k(d, ["corpus"], "row_id", "v", 5).select("corpus", "rank", "row_id"),
    ):
        assert sorted(map(tuple, op(df.repartition(1)).collect())) == sorted(map(tuple, op(df.repartition(7)).collect()))


def test_excerpts_keep_every_sample(spark):
    rows = [("a", i, float(i + 1)) for i in range(70)] + [("b", 0, 1.0), ("b", 3, 4.0)]
    out = {(r.k, r.excerpt): r for r in signal.excerpts(spark.createDataFrame(rows, "k string, i bigint, x double"), ["k"], "i", ["x"], 32).collect()}
    assert sorted(out) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)] and all(len(r.x) == 32 for r in out.values())
    assert out["a", 2].valid == 6 and out["a", 2].x[:7] == [65.0, 66.0, 67.0, 68.0, 69.0, 70.0, 0.0]
    assert out["b", 0].x[:5] == [1.0, 0.0, 0.0, 4.0, 0.0] and sum(sum(r.x) for r in out.values()) == sum(x for _, _, x in rows)


def test_draws_are_never_lost(spark):
    rows = [("a", i, 1.0 / (i + 3), 9000) for i in range(500)] + [("b", 1, 0.0, 9000)]
    df = spark.createDataFrame(rows, "corpus string, row bigint, w double, n bigint")
    assert sampling.weighted_draws(df, "corpus", "row", "w", "n", {"a": 1.0}, 3000, 4, 100, block("row", 64)).count() == 3000
    for absent in ("b", "c"):
        with pytest.raises(ValueError, match=absent):
            sampling.weighted_draws(df, "corpus", "row", "w", "n", {"a": 1.0, absent: 1.0}, 10, 4, 100, block("row"))


def test_balanced_selection_is_the_same_for_any_page(spark):
    rows = [(i, None if i % 2 else "g", None if i % 3 == 0 else f"a{i % 4}", f"k{i // 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, genre string, author string, key string")
    picks = [sorted((r.id, r.pick) for r in graph.select_balanced(df, "id", "genre", "author", ["key"], 5, page=p).collect()) for p in (1, 3, 256)]
    assert picks[0] == picks[1] == picks[2] and {i % 2 for i, _ in picks[0]} == {0, 1}
    chosen = {i for i, _ in picks[0]}
    assert any(i % 3 == 0 for i in chosen) and sum(i % 3 == 0 for i in chosen) <= 3


def test_streaks_and_gates_of_runs_that_begin_anywhere(spark):
    rows = [("r", s, s in (1000, 1001), "2024-01-01 00:00:00") for s in range(1000, 1004)]
    df = spark.createDataFrame(rows, "run string, seq bigint, missed boolean, t string").withColumn("event_time", F.to_timestamp("t"))
    assert monitors.window_streaks(df, ["run"], "seq", "1 minute").first().max_streak == 2
    gate = spark.createDataFrame([("r", s, True, False) for s in (10, 13, 14, 65534, 65537, 65538)], "run string, seq bigint, ready boolean, silent boolean")
    out = {r.seq: r.enhance for r in monitors.healthy_gate(gate, ["run"], "seq", F.col("ready"), F.col("silent")).collect()}
    assert out == {10: False, 13: False, 14: True, 65534: False, 65537: False, 65538: True}


def test_cap_ranks_only_what_it_can_keep(spark):
    rows = [(i, f"s{i % 7}" if i % 11 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, s string")
    out = sampling.stratified_cap(df, ["s"], "id", 50, 3).collect()
    assert len(out) == 50 and sum(r.mandatory for r in out) == 8 and {r.s for r in out} == {None, *(f"s{k}" for k in range(7))}


def test_expected_pairs_that_were_never_shipped_are_missing(spark):
    got = {(r.codec, r.label) for r in entry.queries()["u02_expected_minus_actual"](spark, SF).collect()}
    table = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    shipped = table("lineitem").join(table("part"), F.col("l_partkey") == F.col("p_partkey")).join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    ever = {(r.n_name, r.p_brand) for r in shipped.select("n_name", "p_brand").distinct().collect()}
    grid = {(n.n_name, p.p_brand) for n in table("nation").collect() for p in table("part").select("p_brand").distinct().collect()}
    assert grid - ever and grid - ever <= got
