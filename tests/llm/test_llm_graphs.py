"""Passage dedup, spelling variants and the Merkle manifest against plain loops."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelane.llm import debruijn, merkle, pivots

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ["e", "f", "block", "doc", "place", "tag", "word", "n", "key", "path", "root", "leaf", "name", "_at"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def messy(spark):
    passage = " ".join(f"passage{i}" for i in range(30))
    texts = [(3, passage + " tail"), (3, passage + " tail"), (3, "other " + passage), (None, passage), (None, None), (4, None), (5, ""), (6, " \n\t "), (7, " ".join(["again"] * 70)), (8, f"{passage} Straße naïvely straßen " * 400), (9, "x" * 60000)]
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k}", None if k == 2 else len(t or "")) + (k,) * len(CLASHING) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in CLASHING))


# ---------------------------------------------------------------- passages


def passages(rows, k=20):
    """(n_words, n_removed, sha256) of each (document, text) by a dictionary of all windows."""
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, w in words:
        gone = {j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < (d, i) for j in range(i, i + k)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out)


def deduped(docs, **options):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.dedup(docs, **options).collect())


def test_passages_with_branches_and_short_periods(spark):
    rng = random.Random(1)
    shared = [[f"p{i}w{j}" for j in range(rng.randint(15, 60))] for i in range(12)]
    rows = []
    for d in range(120):
        parts = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.5:
                w = list(rng.choice(shared))
                w = w[rng.randint(0, 5) : len(w) - rng.randint(0, 5)]
                if rng.random() < 0.4:
                    w[rng.randrange(len(w))] = f"x{d}"
            elif kind < 0.8:
                w = [f"u{d}_{rng.random()}" for _ in range(rng.randint(1, 30))]
            else:
                w = ["aa"] * rng.randint(15, 50) if kind < 0.9 else ["ab", "cd"] * rng.randint(8, 30)
            parts.append(" ".join(w))
        rows.append((d, "\n".join(parts)))
    rows += [(600 + d, t) for d, t in rows[:10]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = passages(rows)
    assert sum(r[2] > 0 for r in want) > 60
    assert deduped(docs) == want and deduped(docs, block=3000) == want
    assert deduped(docs, k=9, m=4, block=20000) == passages(rows, 9)


def test_passages_of_the_given_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert deduped(documents, block=1 << 16) == passages(rows)


def test_passage_in_a_third_of_all_texts_makes_a_row_a_block(spark):
    """A passage of 40 words in 900 texts: its edges are sent once a block."""
    hot = " ".join(f"hot{i}" for i in range(40))
    rows = [(d, f"{hot} own{d}" if d % 3 else f"own{d} alone") for d in range(1350)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert deduped(docs, block=1 << 15) == passages(rows)


def test_passages_of_messy_rows(spark, messy):
    got = debruijn.dedup(messy, block=4096).collect()
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r.doc_id].append((r.n_words, r.n_removed))
    assert len(got) == messy.count()
    assert sorted(by_id[None]) == [(0, 0), (30, 0)]  # a null id comes first
    assert sorted(by_id[3]) == [(31, 30), (31, 30), (31, 30)]
    assert by_id[4] == by_id[5] == by_id[6] == [(0, 0)] and by_id[9] == [(1, 0)]
    assert by_id[7] == [(70, 69)]  # every window but the first repeats it
    assert debruijn.dedup(messy.limit(0)).collect() == []


def test_window_hashes():
    words = np.random.default_rng(3).integers(0, 2**64, 300, dtype=np.uint64)
    words = np.concatenate([words, words])
    for width in (1, 2, 3, 8, 20, 21):
        h = debruijn.windows(words, width)
        assert len(h) == 601 - width and (h[: 301 - width] == h[300:]).all() and len(np.unique(h)) == 300
        assert (debruijn.least(h, 13) == [h[i : i + 13].min() for i in range(len(h) - 12)]).all()


# ---------------------------------------------------------------- spelling variants


def counted(rows, every=31):
    out = collections.Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return out


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def near_of(words):
    """Near words by the strings that one deletion leaves: two words one edit apart share one."""
    left = collections.defaultdict(set)
    for w in words:
        for x in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            left[x].add(w)
    near = collections.defaultdict(set)
    for group in left.values():
        for a in group:
            near[a] |= {b for b in group if b != a and one_apart(a, b)}
    return near


def varied(words, ratio=10):
    near = near_of(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def test_variants_of_the_given_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    words = {w: n for w, n in counted(rows).items() if n >= 2}
    counts = pivots.count_words(documents).filter("n >= 2")
    assert {r.word: r.n for r in counts.collect()} == words
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in pivots.variants(counts).collect()}
    assert got == varied(words) and sum(v[0] is not None for v in got.values()) >= 5


def test_variants_of_dense_words_and_chains(spark):
    """Few letters, so that grams repeat inside words and most words have near ones; counts make chains of forms."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(7, 10))): 10 ** rng.randint(0, 4) + 1 for _ in range(3000)}
    words |= {"aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaaaaa": 2000, "ÀÁéééèè": 3, "Àéééèèè": 40}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in pivots.variants(frame).collect()}
    assert got == varied(words)
    assert any(v[0] and v[0] != v[1] for v in got.values())


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(7)
    for _ in range(500):
        places = sorted(rng.sample(range(9), rng.randint(3, 6)))
        prefix = [(p, rng.randint(0, 50)) for p in places]
        a, b = pivots.pivots_of(prefix)
        cost = dict(prefix)
        pairs = [cost[x] + cost[y] for x in places for y in places if y >= x + 2]
        assert b >= a + 2 and cost[a] + cost[b] == min(pairs)


def test_variants_of_messy_rows(messy):
    rows = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    assert {r.word: r.n for r in pivots.count_words(messy).collect()} == counted(rows)
    words = {w: n for w, n in counted(rows).items() if n >= 2}
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in pivots.variants(pivots.count_words(messy).filter("n >= 2")).collect()} == varied(words)
    assert pivots.variants(pivots.count_words(messy.limit(0))).collect() == []


# ---------------------------------------------------------------- manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def proof(tree, at):
    steps = []
    for level in tree[:-1]:
        beside = at ^ 1
        steps.append((at & 1, level[beside] if beside < len(level) else None))
        at >>= 1
    return steps


def folded(digest, steps):
    for odd, beside in steps:
        digest = sha(digest) if beside is None else sha(beside, digest) if odd else sha(digest, beside)
    return digest


def audited(rows, tampered):
    langs = collections.defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in order:
        langs[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append(levels([leaf_of(r) for r in langs[lang]]))
    crown = levels([t[-1][0] for t in trees])
    root = crown[-1][0]
    out = []
    for k, lang in enumerate(order):
        for at, r in enumerate(langs[lang]):
            steps = proof(trees[k], at) + proof(crown, k)
            changed = leaf_of(r[:3] + (r[3] + 1,) + r[4:]) if tampered(r[0]) and r[3] is not None else leaf_of(r)
            end = folded(changed, steps)
            out.append((r[0], leaf_of(r), trees[k][-1][0], root, sha(*[s for _, s in steps if s]), end, end == root))
    return sorted(out, key=repr)


def by_crc(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0


def proofs_of(docs, band):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return sorted((tuple(r) for r in merkle.audit(docs, tampered, band).collect()), key=repr)


@pytest.mark.parametrize("band", [1, 3, 10])
def test_manifest_equals_plain_trees(documents, band):
    rows = [tuple(r) for r in documents.select(*merkle.FIELDS).collect()]
    got = proofs_of(documents, band)
    assert got == audited(rows, by_crc) and 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 9])
def test_manifest_of_small_trees(spark, n):
    rows = [(d, f"s{d}", "a", d, f"text {d}") for d in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert proofs_of(docs, 2) == audited(rows, by_crc)


def test_manifest_of_messy_rows(messy):
    rows = [tuple(r) for r in messy.select(*merkle.FIELDS).collect()]
    assert proofs_of(messy, 2) == audited(rows, by_crc)
    assert proofs_of(messy.limit(0), 2) == []
