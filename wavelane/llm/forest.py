"""MinHash near-duplicate groups by an LSH forest with exact confirmation.

Every document becomes its set of distinct five-word shingles and a signature of MinHash values.
A *tree* of the forest is one order of the signature: tree ``t`` starts with its own ``BASE``
values and goes on through the others. Documents that share the first ``BASE`` values of a tree
form a *region*.

1. Equal sets are one class; only its smallest id goes on.
2. In a few trees each document meets the neighbour with the longest common prefix: regions that
   hold more than ``REGION`` classes are cut at a greater depth, chosen from the region's own size,
   sorted by the signature order, and each row is paired with the next one. Documents of such large
   regions are also indexed by their rarest shingles (any two sets at the wanted similarity share
   one of those; holders that no partner at a shingle's best place could match are left out), and
   for each of them meet the holder at the best place and one more, a different one by shingle.
3. Regions and shingles whose documents are by then in one component are done. In the others,
   small regions of any tree compare their documents across components, and so do the holders of a
   rare shingle, so that no link is left out and a large group of copies makes no pairs.

Pairs are first held against the signature estimate, far below the wanted similarity, then
confirmed on the full shingle sets. A pair at 0.75 shares no region with probability below 1e-7.

Defined cases: null text counts as empty; empty texts have no shingles and are their own group;
with fewer than five words the whole sequence is the one shingle; repeated rows stay and get the
same group; a row without an id takes the group of an equal text, or none, its ``kept`` is null and
``keep_one`` leaves it in. Extra columns are ignored by ``components`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelane.llm.common import bounded_batches, cut
from wavelane.llm.hashing import WordHasher, shingles

TREES, BASE = 32, 3
#: Trees whose neighbours are compared first.
FIRST = 6
#: Largest region whose documents are compared across components directly.
REGION = 32
#: Signature values a sorted order goes on with beyond the base.
DEEPER = 9
ESTIMATE = 0.5
#: Ids that may be sent to every task to pick their texts (8 bytes each); more ids go through a shuffled join.
SENT_IDS = 1 << 20
#: Rows of one shingle that are counted together.
HOT = 1 << 16


def _signature_keys() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    keys = rng.integers(0, 2**64, (2, TREES * BASE), dtype=np.uint64)
    return keys[0] | np.uint64(1), keys[1]


def signature(x: np.ndarray, keys: tuple[np.ndarray, np.ndarray], block: int = 512) -> bytes:
    """MinHash values as big-endian 32-bit integers, so that byte order is value order."""
    a, b = keys
    best = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for low in range(0, len(x), block):
        np.minimum(best, (x[low : low + block, None] * a + b).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(">u4").tobytes()


def sketch(docs: DataFrame, width: int = 5) -> DataFrame:
    """``doc_id, n_shingles, set_key, sig`` of every row; empty sets have null keys."""
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, keys = WordHasher(), _signature_keys()
        for frame in frames:
            texts = ["" if t is None else t for t in frame["text"]]
            out: list = [(0, None, None)] * len(texts)
            for low in range(0, len(texts), 256):
                part = [t.encode() for t in texts[low : low + 256]]
                for i, words in hasher.texts(part):
                    x = shingles(words, width)
                    if len(x):
                        out[low + i] = (len(x), hashlib.blake2b(x.tobytes(), digest_size=16).digest(), signature(x, keys))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_shingles": [o[0] for o in out], "set_key": [o[1] for o in out], "sig": [o[2] for o in out]})

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInPandas(run, "doc_id bigint, n_shingles bigint, set_key binary, sig binary")


def shingle_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """``doc_id, shingles``: the full sets as sorted 64-bit hashes."""
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for frame in frames:
            for low in range(0, len(frame), 256):
                part = frame.iloc[low : low + 256]
                found = dict(hasher.texts([t.encode() for t in part["text"]]))
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "shingles": [shingles(found[i], width).view(np.int64) for i in range(len(part))]})

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInPandas(run, "doc_id bigint, shingles array<bigint>")


def _tree_key(t: int, depth: int):
    """The first ``depth`` values of tree ``t``'s order."""
    twice = F.concat("sig", "sig")
    return F.substring(twice, 4 * BASE * t + 1, 4 * depth)


def _likely(pairs: DataFrame, sigs: DataFrame, floor: float) -> DataFrame:
    """Pairs whose signatures agree in a share of at least ``floor`` of their values."""
    both = pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x, y = (np.frombuffer(b"".join(frame[c]), dtype=">u4").reshape(len(frame), -1) for c in ("sig_a", "sig_b"))
                yield frame.loc[(x == y).mean(axis=1) >= floor, ["a", "b"]]

    return both.mapInPandas(run, "a bigint, b bigint")


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of ``ids`` (``doc_id``); texts stay where they are while the ids are few."""
    few = ids.count() <= SENT_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = shingle_sets(_picked(docs, wanted), width).dropDuplicates(["doc_id"])
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sizes"))
    return shared.filter(100 * F.col("both") >= percent * (F.col("sizes") - F.col("both"))).select("a", "b")


def connect(links: DataFrame) -> DataFrame:
    """``id, label``: smallest id reachable over the links (``a, b``), for ids that have one.

    Each round takes the smallest label of the neighbours and then the label's own label.
    """
    edges = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    labels = edges.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("label"))
    while True:
        near = edges.join(labels, edges["v"] == labels["id"]).groupBy("u").agg(F.min("label").alias("near"))
        lowered = labels.join(near, labels["id"] == near["u"]).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        target = lowered.select(F.col("id").alias("label"), F.col("label").alias("jump"))
        step = cut(lowered.join(target, "label").select("id", F.least("label", "jump").alias("label"), (F.least("label", "jump") < F.col("old")).alias("moved")))
        labels = step.select("id", "label")
        if step.filter("moved").isEmpty():
            return labels


def _labelled(rows: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    named = labels.select(F.col("id").alias(id_column), F.col("label").alias("known"))
    return rows.join(named, id_column, "left").withColumn("label", F.coalesce("known", id_column)).drop("known")


def _with_frequency(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """Adds ``df``, how many rows hold the shingle ``s``; all that more than ``hot`` rows hold count as ``hot + 1``.

    Any fixed order of the shingles would do, so the most frequent ones needn't meet in one task.
    """
    frequent = cut(rows.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("s"))
    many = frequent.count()
    every = F.count(F.lit(1)).over(Window.partitionBy("s"))
    if not many:
        return rows.withColumn("df", every)
    # There are at most rows / hot of them.
    frequent = F.broadcast(frequent) if many <= SENT_IDS else frequent
    rest = rows.join(frequent, "s", "left_anti").select(*rows.columns).withColumn("df", every)
    return rest.unionByName(rows.join(frequent, "s", "left_semi").select(*rows.columns).withColumn("df", F.lit(hot + 1).cast("bigint")))


def _rare_holders(sets: DataFrame, percent: int) -> DataFrame:
    """``doc_id, n, s, p``: the rarest shingles of each set (``doc_id, shingles``) with their place.

    With all shingles in one order, rarest first, two sets of the wanted similarity share one of
    the first ``n - ceil(percent * n / 100) + 1``. At the first one they share, at places ``p`` and
    ``q``, the overlap is at most ``n - p``, and the other set has ``q`` shingles more than it; so
    ``100 * (n - p) >= percent * (n + q)``, with ``q`` no less than the shingle's best place.
    """
    rows = sets.select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    order = _with_frequency(rows).groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("order"))
    keep = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    placed = order.select("doc_id", "n", F.posexplode(F.slice("order", F.lit(1), keep)).alias("p", "o")).filter("o.df > 1").select("doc_id", "n", F.col("o.s").alias("s"), "p")
    best = placed.groupBy("s").agg(F.min("p").alias("best"))
    return placed.join(best, "s").filter(100 * (F.col("n") - F.col("p")) >= percent * (F.col("n") + F.col("best"))).drop("best")


def _hub_pairs(holders: DataFrame) -> DataFrame:
    """Each holder of a shingle with the one where it stands at the best place, and with one that the shingle's own hash order picks.

    The holder at the best place has the fewest shingles of its own: of a group of copies, the one
    closest to all others.
    """
    drawn = F.struct(F.xxhash64("doc_id", "s").alias("h"), "doc_id")
    hubs = holders.groupBy("s").agg(F.min(F.struct("p", "n", "doc_id")).alias("best"), F.min(drawn).alias("drawn")).select("s", F.array("best.doc_id", "drawn.doc_id").alias("hubs"))
    met = holders.join(hubs, "s").select("doc_id", F.explode("hubs").alias("hub")).filter("doc_id <> hub")
    return met.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b"))


def _open(holders: DataFrame, labels: DataFrame) -> DataFrame:
    """Holders with labels, without the shingles whose holders have one label."""
    named = _labelled(holders, labels)
    kinds = named.groupBy("s").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return named.join(kinds.filter("low <> high").select("s"), "s", "left_semi")


def _rare_pairs(held: DataFrame, percent: int) -> DataFrame:
    """Exact candidates across labels that share a rare shingle.

    Of each shingle's holders, those of its most frequent label need no pairs among themselves: the
    others meet all holders. So a group of near copies costs its size times the number of others.
    """
    sizes = held.groupBy("s", "label").agg(F.count(F.lit(1)).alias("size"))
    major = sizes.groupBy("s").agg(F.max(F.struct("size", "label")).alias("major")).select("s", F.col("major.label").alias("major"))
    minor = held.join(major, "s").filter("label <> major").drop("major")
    other = held.select(F.col("doc_id").alias("b"), F.col("label").alias("label_b"), F.col("n").alias("n_b"), F.col("p").alias("q"), "s")
    room = F.least(F.col("n") - F.col("p"), F.col("n_b") - F.col("q"))
    near = (F.col("label") != F.col("label_b")) & ((100 + percent) * room >= percent * (F.col("n") + F.col("n_b")))
    return minor.join(other, "s").filter(near).select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b")).distinct()


def components(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    known = cut(sketch(docs, width))
    classes = known.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    reps = known.join(classes, "set_key").filter("doc_id = rep").select("doc_id", "sig").dropDuplicates(["doc_id"])

    trees = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), _tree_key(t, BASE)).alias("region"), (_tree_key(t, BASE + DEEPER) if t < FIRST else F.lit(None).cast("binary")).alias("order")) for t in range(TREES)])
    rows = reps.select("doc_id", F.explode(trees).alias("x")).select("doc_id", "x.*")
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = cut(rows.join(sizes, "region"))

    # Depth of a region: at the wanted similarity each further value keeps three quarters.
    extra = F.least(F.lit(DEEPER), F.greatest(F.lit(0), F.ceil(F.log(F.col("size") / REGION) / F.log(F.lit(4 / 3))).cast("int")))
    first = members.filter(F.col("t") < FIRST).withColumn("cell", F.substring("order", F.lit(1), 4 * (BASE + extra)))
    ahead = F.lead("doc_id").over(Window.partitionBy("region", "cell").orderBy("order", "doc_id"))
    next_pairs = first.select("doc_id", ahead.alias("b")).filter("b is not null").select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b"))
    large = cut(members.filter(F.col("size") > REGION).select("doc_id").distinct())
    holders = cut(_rare_holders(shingle_sets(_picked(docs, large), width).dropDuplicates(["doc_id"]), percent))
    near = cut(_likely(next_pairs.union(_hub_pairs(holders)).distinct(), reps, ESTIMATE))
    labels = connect(_confirmed(near, docs, percent, width))

    placed = _labelled(members.filter(F.col("size") <= REGION).select("region", "doc_id"), labels)
    open_regions = placed.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("region")
    small = placed.join(open_regions, "region", "left_semi")
    other = small.select("region", F.col("doc_id").alias("b"), F.col("label").alias("label_b"))
    across = small.join(other, "region").filter((F.col("doc_id") < F.col("b")) & (F.col("label") != F.col("label_b"))).select(F.col("doc_id").alias("a"), "b")
    rest = cut(_likely(across.union(_rare_pairs(_open(holders, labels), percent)).distinct(), reps, ESTIMATE))
    more = _confirmed(rest, docs, percent, width)
    ends = _labelled(_labelled(more.withColumnRenamed("a", "doc_id"), labels).select(F.col("label").alias("a"), F.col("b").alias("doc_id")), labels)
    merged = connect(ends.select("a", F.col("label").alias("b")))
    labels = _labelled(labels.select(F.col("id"), F.col("label").alias("doc_id")), merged).select("id", "label").union(merged.join(labels.select("id"), "id", "left_anti"))

    by_class = _labelled(classes.select("set_key", F.col("rep").alias("doc_id")), labels).select("set_key", F.col("label").alias("component"))
    out = known.select("doc_id", "n_shingles", "set_key").join(by_class, "set_key", "left")
    group = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", group.alias("component_id"), (F.col("doc_id") == group).alias("kept"))



def keep_one(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their group, with their own columns; of rows that repeat an id, one."""
    gone = cut(components(docs, percent, width).filter("not kept").select("doc_id").distinct())
    left = docs.join(F.broadcast(gone) if gone.count() <= SENT_IDS else gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = cut(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    few = repeated.count()
    if not few:
        return left
    single = left.join(F.broadcast(repeated) if few <= SENT_IDS else repeated, "doc_id", "left_anti").select(*docs.columns)
    return single.unionByName(_picked(left, repeated).select(*docs.columns).dropDuplicates(["doc_id"]))
