"""Weighted backoff automaton for language-model scores, learned from the whole corpus.

States are the words (and the start of a text), plus a root. A state ``h`` has an arc for every
word ``w`` that followed it in the training texts, with weight
``(c(h, w) + k * p(w)) / (c(h) + k)``; any other word takes the failure arc to the root, of weight
``k / (c(h) + k)``, and is read there with ``p(w) = (c(w) + 1) / (N + V + 1)``. Arc weights and
failure weights of a state add up to one. A word that training never saw leads to the root itself.
A text is read once from left to right: each token adds the log of its arc (or of the failure arc
and the root's) and moves the state.

Counting and lookup are one exchange. Texts are dealt to blocks of about ``BLOCK`` bytes. A block
sends the sorted keys of its distinct words and word pairs, each key range to its own task, with
how often training texts of the block hold them. The key range's task adds the counts up and
answers each block with the totals in the order of its own keys; the block, which makes the same
keys again, so has exactly the part of the automaton that its texts can reach. Keys are 64-bit
hashes in byte planes of their differences. Nothing is gathered that doesn't shrink with more
blocks; only two totals go to the driver.

Defined cases: null text counts as empty (one token, the end); null ids count as training; repeated
rows are counted and scored each; without training texts every score uses ``N = V = 0``; extra
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelane.llm.common import bounded_batches, cut, text_of
from wavelane.llm.hashing import WordHasher, mix

BLOCK = 12 << 20
#: Weight of the root's distribution in a state, in tokens.
PRIOR = 50.0
START, END = np.uint64(0x51A27), np.uint64(0xE4D)
SENT = "part bigint, block bigint, pairs boolean, keys binary, counts binary"
ANSWER = "block bigint, part bigint, pairs boolean, totals binary, n bigint, v bigint"


def packed(x: np.ndarray) -> bytes:
    """Byte planes of unsigned integers, compressed."""
    width = x.dtype.itemsize
    return zlib.compress(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def unpacked(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


class Tokens:
    """Words and pairs of a block's texts: keys in text order, and where each text's tokens begin."""

    def __init__(self, texts: list[str]):
        found = dict(WordHasher().texts([t.encode() for t in texts]))
        one = np.array([END])
        parts = [x for i in range(len(texts)) for x in (found[i], one)]
        self.words = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
        lengths = np.array([len(found[i]) + 1 for i in range(len(texts))], dtype=np.int64)
        self.starts = np.cumsum(lengths) - lengths
        self.lengths = lengths
        before = np.empty_like(self.words)
        before[1:] = self.words[:-1]
        before[self.starts] = START
        self.before = before
        self.pairs = mix(mix(before) * np.uint64(0x9E3779B97F4A7C15) + self.words)


def _keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(x, return_inverse=True)


def _ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Borders of ``parts`` equal key ranges in sorted keys."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def _send(parts: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        tokens = Tokens(list(frame["text"]))
        training = np.repeat(~frame["held_out"].to_numpy(dtype=bool), tokens.lengths)
        begins = mix(np.array([START]))[0]
        out = []
        for pairs, x in ((False, np.append(tokens.words, begins)), (True, tokens.pairs)):
            keys, at = _keys(x)
            counts = np.bincount(at[: len(training)][training], minlength=len(keys)).astype(np.uint32)
            if not pairs:  # how many training texts begin: the count of the start state
                counts[at[-1]] += int((~frame["held_out"]).sum())
            borders = _ranges(keys, parts)
            for p in np.flatnonzero(np.diff(borders)):
                low, high = borders[p], borders[p + 1]
                out.append((int(p), key[0], pairs, packed(np.diff(keys[low:high], prepend=np.uint64(0))), packed(counts[low:high])))
        return pd.DataFrame(out, columns=["part", "block", "pairs", "keys", "counts"])

    return run


def _answer(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    part, pairs = key
    sent = [np.cumsum(unpacked(k, 8), dtype=np.uint64) for k in frame["keys"]]
    counts = np.concatenate([unpacked(c, 4) for c in frame["counts"]])
    keys, at = _keys(np.concatenate(sent))
    totals = np.bincount(at, weights=counts, minlength=len(keys)).astype(np.uint64)
    out, low = [], 0
    for block, x in zip(frame["block"], sent):
        out.append((block, part, pairs, packed(totals[at[low : low + len(x)]]), 0, 0))
        low += len(x)
    if not pairs:
        words = keys != mix(np.array([START]))[0]
        out.append((-1, part, pairs, b"", int(totals[words].sum()), int((totals[words] > 0).sum())))
    return pd.DataFrame(out, columns=["block", "part", "pairs", "totals", "n", "v"])


def _score(n: int, v: int, prior: float):
    def run(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return docs.assign(n_tokens=0, n_known=0, base_score=0.0, score=0.0)[["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]]
        tokens = Tokens(list(docs["text"]))
        totals = {}
        for pairs in (False, True):
            mine = answers[answers["pairs"] == pairs].sort_values("part")
            totals[pairs] = np.concatenate([unpacked(t, 8) for t in mine["totals"]]).astype(np.float64)
        begins = mix(np.array([START]))[0]
        keys, at = _keys(np.append(tokens.words, begins))
        word_count = totals[False][at[:-1]]
        start_count = totals[False][at[-1]]
        pair_count = totals[True][_keys(tokens.pairs)[1]]
        # The state a token is read in: the word before it, or the start of the text.
        state_count = np.empty_like(word_count)
        state_count[1:] = word_count[:-1]
        state_count[tokens.starts] = start_count
        root = (word_count + 1) / (n + v + 1)
        arc = (pair_count + prior * root) / (state_count + prior)
        total = lambda x: np.add.reduceat(x, tokens.starts)
        return pd.DataFrame({
            "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": tokens.lengths, "n_known": total((word_count > 0).astype(np.int64)),
            "base_score": total(np.log10(root)), "score": total(np.log10(arc)),
        })

    return run


def scores(docs: DataFrame, held_out, prior: float = PRIOR, block: int = BLOCK) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: one row for each row of ``docs``.

    Texts for which the Column ``held_out`` is true are scored, not learned from.
    """
    bounded_batches(docs.sparkSession)
    text = text_of()
    whole = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-whole // block))
    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text.alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))
    sent = dealt.groupBy("block").applyInPandas(_send(blocks), SENT)
    answers = cut(sent.groupBy("part", "pairs").applyInPandas(_answer, ANSWER))
    n, v = answers.filter("block < 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    both = dealt.groupBy("block").cogroup(answers.filter("block >= 0").select("block", "part", "pairs", "totals").groupBy("block"))
    out = both.applyInPandas(_score(n, v, prior), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")


def seventh_held_out(column: str = "doc_id"):
    """crc32 of the id as text, modulo 7, is 2."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 7 == 2
