"""Substring dedup: long word passages that stand earlier too, by a compacted de Bruijn graph.

An edge of the graph is a k-mer of ``K`` consecutive words, between the nodes of its first and last
``K - 1`` words. Whole copies of an earlier text are set aside first, by digest: all their windows
stand earlier. The other texts are dealt to blocks of about ``BLOCK`` bytes; three steps use the blocks.

1. Only repeated edges matter. Every k-mer holds a *minimizer*, its ``M``-word window of least hash,
   and equal k-mers hold the same one. A block sends each of its distinct minimizers once; those that
   two blocks send, or that a block holds twice, leave candidates. The others can't be repeated.
2. A block sends each of its distinct candidate edges once, with the least source coordinate
   (document, place), the number of occurrences and the word that always follows, if one does. Per
   edge, Spark finds the first occurrence of all and whether one edge follows everywhere. Where
   it does and is as frequent, the two have the same occurrences, one place on: the node between
   them doesn't branch. Along the source coordinates, runs of edges linked so compact to one path,
   named by its head, with length and digest.
3. A join of the paths with the blocks' edges finds the blocks that hold a head. A block takes the spans that its heads begin, checks
   each span's digest, and removes the words of all spans but the one at the path's own coordinate.

So an edge that stands in a third of all texts makes one row a block, not one a text, and a path of
any length travels as one row. Edges are told apart by 96 bits of two hashes.

Defined cases: null text counts as empty; texts of fewer than ``K`` words keep all; null ids come
first and count as one document, as do rows that share an id. Of different texts under one id, the
one with the smaller hash comes first. Equal rows are the same document and get equal results: a
window is removed only for an occurrence at a smaller coordinate; they meet in one block. An empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelane.llm.common import bounded_batches, cut, text_of
from wavelane.llm.hashing import WordHasher, mix

#: Words of an edge, words of a minimizer.
K, M = 20, 8
#: Bytes of text in a block.
BLOCK = 6 << 20
#: The id that null ids take in the order.
NO_ID = -(1 << 63)
#: Follower of an edge that has none, or several.
BRANCH = 0
_FOLLOW = (1 << 32) - 1


def windows(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``width`` consecutive words: a polynomial, added up by halves of the width."""
    factor, total, done = mix(np.array([seed + 1], dtype=np.uint64))[0] | np.uint64(1), None, 0
    piece, size = words, 1
    while True:
        if width & size:
            n = len(words) - done - size + 1
            total = piece[:n] if total is None else total[:n] * _power(factor, size) + piece[done : done + n]
            done += size
        if 2 * size > width:
            return mix(total)
        piece = piece[:-size] * _power(factor, size) + piece[size:]
        size *= 2


def _power(factor: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(factor), n, 1 << 64))


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


class Block:
    """Edges of a block's texts, those of all texts in one array."""

    def __init__(self, texts: list[str], k: int, m: int):
        self.k, self.raw = k, [t.encode() for t in texts]
        found = dict(WordHasher(lower=False).texts(self.raw))
        self.words = [found[i] for i in range(len(texts))]
        self.long = [i for i, w in enumerate(self.words) if len(w) >= k]
        counts = np.array([len(self.words[i]) - k + 1 for i in self.long], dtype=np.int64)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.m, self.small = m, [windows(self.words[i], m) for i in self.long]
        self.minimizers = np.concatenate([least(x, k - m + 1) for x in self.small]) if self.long else np.empty(0, dtype=np.uint64)

    def _joined(self, of) -> np.ndarray:
        parts = [of(self.words[i]) for i in self.long]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)

    def distinct_minimizers(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct minimizers, and whether texts of this block hold them in two places."""
        changes = np.ones(len(self.minimizers), dtype=bool)
        changes[1:] = self.minimizers[1:] != self.minimizers[:-1]
        changes[self.starts] = True
        keys, counts = np.unique(self.minimizers[changes], return_counts=True)
        # One run of places can hold a minimizer twice where words repeat at a short distance.
        small = np.concatenate(self.small) if self.small else self.minimizers
        close = [small[d:][small[d:] == small[:-d]] for d in range(1, self.k - self.m + 1) if d < len(small)]
        return keys, (counts > 1) | np.isin(keys, np.concatenate(close) if close else small)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """The 64-bit and the 32-bit hash of every edge."""
        first = self._joined(lambda w: windows(w, self.k))
        second = self._joined(lambda w: windows(w, self.k, 1) >> np.uint64(32))
        return first, second.astype(np.int64)

    def followers(self) -> np.ndarray:
        """A number for the word after each edge (one in 2**31), ``BRANCH`` at the end of a text."""
        out = np.full(len(self.minimizers), BRANCH, dtype=np.int64)
        for i, low, high in zip(self.long, self.starts, self.ends):
            out[low : high - 1] = (self.words[i][self.k :] >> np.uint64(33)) + np.uint64(1)
        return out

    def places(self, docs: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source coordinates of all edges: document, and text tag with place."""
        sizes = self.ends - self.starts
        at = np.arange(len(self.minimizers)) - np.repeat(self.starts, sizes)
        return np.repeat(docs[self.long], sizes), np.repeat(tags[self.long] << 32, sizes) + at


def _own_texts(frame: pd.DataFrame, told: pd.DataFrame) -> list[str]:
    """The block's texts, empty where a copy of an earlier one stands; ``told`` lists these as ``kind`` 1."""
    copies = told[told["kind"] == 1]
    gone = set(zip(copies["doc"], copies["place"]))
    return ["" if key in gone else text for text, key in zip(frame["text"], zip(frame["doc"], frame["key"]))]


def _minimizers(k: int, m: int):
    def run(key: tuple, frame: pd.DataFrame, copies: pd.DataFrame) -> pd.DataFrame:
        keys, twice = Block(_own_texts(frame, copies), k, m).distinct_minimizers()
        return pd.DataFrame({"block": key[0], "h": keys.view(np.int64), "twice": twice})

    return run


def _edges(k: int, m: int):
    def run(key: tuple, frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        block = Block(_own_texts(frame, told), k, m)
        shared = told.loc[told["kind"] == 0, "h"].to_numpy(dtype=np.int64)
        wanted = np.flatnonzero(np.isin(block.minimizers.view(np.int64), shared))
        first, second = block.edges()
        docs, places = block.places(frame["doc"].to_numpy(), frame["tag"].to_numpy())
        follows = block.followers()[wanted]
        e, f, docs, places = first[wanted].view(np.int64), second[wanted], docs[wanted], places[wanted]
        order = np.lexsort((places, docs, f, e))
        e, f, docs, places, follows = e[order], f[order], docs[order], places[order], follows[order]
        new = np.ones(len(e), dtype=bool)
        new[1:] = (e[1:] != e[:-1]) | (f[1:] != f[:-1])
        at = np.flatnonzero(new)
        if not len(at):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("e", "f", "block", "doc", "place", "link")})
        low, high = np.minimum.reduceat(follows, at), np.maximum.reduceat(follows, at)
        return pd.DataFrame({"e": e[at], "f": f[at], "block": key[0], "doc": docs[at], "place": places[at], "link": np.diff(np.append(at, len(e))) << 32 | np.where(low == high, low, BRANCH)})

    return run


def _removed(k: int, m: int):
    def run(key: tuple, frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        block, paths = Block(_own_texts(frame, told), k, m), told[told["kind"] == 0]
        n_words = np.array([len(w) for w in block.words], dtype=np.int64)
        base = np.cumsum(n_words) - n_words
        cover = np.zeros(int(n_words.sum()) + 1, dtype=np.int64)
        if len(paths) and len(block.long):
            first, second = block.edges()
            docs, places = block.places(frame["doc"].to_numpy(), frame["tag"].to_numpy())
            digest = np.zeros(len(first) + 1, dtype=np.uint64)
            np.bitwise_xor.accumulate(first, out=digest[1:])
            known = paths.sort_values(["e", "f"])
            heads, checks = known["e"].to_numpy(), known["f"].to_numpy()
            mine = first.view(np.int64)
            hits = np.flatnonzero(np.isin(mine, heads))
            at = np.searchsorted(heads, mine[hits])
            while True:  # heads with one first hash stand side by side
                step = (at < len(heads) - 1) & (heads[np.minimum(at + 1, len(heads) - 1)] == mine[hits]) & (checks[at] < second[hits])
                if not step.any():
                    break
                at = at + step
            right = checks[at] == second[hits]
            hits, at = hits[right], at[right]
            lengths = known["edges"].to_numpy()[at]
            text = np.searchsorted(block.ends, hits, side="right")
            if (hits + lengths > block.ends[text]).any() or (digest[hits + lengths] ^ digest[hits] != known["digest"].to_numpy()[at].view(np.uint64)).any():
                raise ValueError("a path's span differs from its source")
            later = (docs[hits] != known["doc"].to_numpy()[at]) | (places[hits] != known["place"].to_numpy()[at])
            hits, lengths, text = hits[later], lengths[later], text[later]
            begin = base[np.array(block.long)[text]] + hits - block.starts[text]
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + lengths + k - 1, -1)
        kept = np.cumsum(cover[:-1]) == 0
        out = []
        for text, low, n in zip(frame["text"], base, n_words):
            words = text.encode().split()
            keep = kept[low : low + n]
            if len(words) != n:  # a copy, of which all windows stand earlier
                left = words if len(words) < k else []
            else:
                left = words if keep.all() else list(compress(words, keep.tolist()))
            out.append((len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
        rows = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])
        return rows.assign(doc=frame["doc"].to_numpy())

    return run


def numbered(edges: DataFrame) -> DataFrame:
    """Adds to each block's row of an edge (``e, f, block, doc, place, link``) what holds for all of its rows.

    ``first``: the least source coordinate; ``times``: occurrences; ``onward``: the word that
    follows every one of them, or ``BRANCH``. An edge has at most one row a block.
    """
    every = Window.partitionBy("e", "f")
    follow = F.col("link").bitwiseAND(_FOLLOW)
    onward = F.when(F.min(follow).over(every) == F.max(follow).over(every), follow).otherwise(BRANCH)
    times = F.sum(F.shiftright("link", 32)).over(every)
    return edges.withColumn("times", times).withColumn("first", F.min(F.struct("doc", "place", "block")).over(every)).withColumn("onward", onward).filter("times > 1")


def paths_of(told: DataFrame) -> DataFrame:
    """``e, f, doc, place, edges, digest``: the paths of repeated edges, each named by its head."""
    graph = told.filter(F.struct("doc", "place", "block") == F.col("first")).select("e", "f", "doc", F.shiftright("place", 32).alias("tag"), "place", "times", "onward")
    # An edge whose every occurrence goes on to the same word links to the edge at the next coordinate, if that is as frequent.
    source = Window.partitionBy("doc", "tag").orderBy("place")
    links = (F.lag("place").over(source) == F.col("place") - 1) & (F.lag("onward").over(source) != BRANCH) & (F.lag("times").over(source) == F.col("times"))
    headed = graph.withColumn("head", ~F.coalesce(links, F.lit(False)))
    # A path is a run of linked edges along its source: a text holds no more edges than words.
    found = headed.withColumn("start", F.max(F.when(F.col("head"), F.col("place"))).over(source)).groupBy("doc", "tag", "start")
    heads = found.agg(F.max(F.when(F.col("head"), F.struct("e", "f"))).alias("key"), F.count(F.lit(1)).alias("edges"), F.bit_xor("e").alias("digest"))
    return heads.select("key.e", "key.f", "doc", F.col("start").alias("place"), "edges", "digest")


def _copies(rows: DataFrame) -> DataFrame:
    """``block, doc, key`` of the rows (``block, doc, key, text_key``) whose text also stands under a smaller id."""
    groups = cut(rows.groupBy("text_key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter(F.col("first") < F.col("last")).select("text_key", "first"))
    return cut(rows.join(groups, "text_key").filter(F.col("doc") > F.col("first")).select("block", "doc", "key").distinct())


def dedup(docs: DataFrame, k: int = K, m: int = M, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``: one row for each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    text = text_of()
    whole = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-whole // block))
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID).cast("bigint"))
    placed = docs.select(doc.alias("doc"), text.alias("text")).withColumn("key", F.xxhash64("text"))
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("doc", "key"), F.lit(blocks)))
    light = dealt.select("block", "doc", "key", F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("text_key"))
    copies = _copies(light).select("block", F.lit(1).alias("kind"), "doc", F.col("key").alias("place"))
    # Where ids repeat, a tag orders the texts that share one; else it would only take room.
    repeated = not light.groupBy("doc").agg(F.countDistinct("key").alias("n")).filter("n > 1").isEmpty()
    dealt = dealt.withColumn("tag", F.col("key").bitwiseAND((1 << 30) - 1) if repeated else F.lit(0).cast("bigint")).groupBy("block")

    sent = dealt.cogroup(copies.groupBy("block")).applyInPandas(_minimizers(k, m), "block bigint, h bigint, twice boolean")
    every = Window.partitionBy("h")
    shared = sent.withColumn("blocks", F.count(F.lit(1)).over(every)).filter("twice or blocks > 1").select("block", F.lit(0).alias("kind"), "h")
    edge_rows = dealt.cogroup(_both(shared, copies).groupBy("block")).applyInPandas(_edges(k, m), "e bigint, f bigint, block bigint, doc bigint, place bigint, link bigint")
    # The join below asks for this filter; asked for here, both uses of the edges share one exchange.
    told = numbered(edge_rows.filter("e is not null and f is not null"))
    # A block that holds the source alone has nothing to remove.
    elsewhere = told.filter((F.struct("doc", "place", "block") != F.col("first")) | (F.shiftright("link", 32) > 1))
    spans = elsewhere.select("block", F.lit(0).alias("kind"), "e", "f").join(paths_of(told), ["e", "f"])
    out = dealt.cogroup(_both(spans, copies).groupBy("block")).applyInPandas(_removed(k, m), "doc bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def _both(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """The two in one table, with zeros for the columns that one lacks."""
    names = [*rows.columns, *[c for c in copies.columns if c not in rows.columns]]
    padded = [d.select(*[F.col(c) if c in d.columns else F.lit(0).cast("bigint").alias(c) for c in names]) for d in (rows, copies)]
    return padded[0].union(padded[1])
