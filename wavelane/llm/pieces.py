"""Sampled subword segmentation: forward filtering, backward sampling over the piece lattice.

A text's bytes form a lattice whose edges are the vocabulary's pieces and, where a byte is no piece
of its own, byte pieces. The forward pass sums, for every position, the weights of all
segmentations that end there; the backward pass draws the last piece in proportion, then the one
before it, and so on. So whole segmentations are drawn exactly in proportion to the product of
their pieces' weights.

No piece goes on after a space or beyond a byte that stands in no longer piece, so the lattice
falls apart at such places. Each distinct segment of a batch is filtered once; its occurrences draw
for themselves. A draw is a hash of the row's key, the seed and the place in the text, so reruns,
retries and other partitionings give the same pieces.

The vocabulary file gives an order of pieces, not probabilities; a piece's weight is
``1 / (rank + SHIFT)``, to the power ``theta``. A space is encoded as itself, nothing is
normalised, and every byte can be written, so decoding gives back every text exactly.

Defined cases: null text counts as empty (no pieces); a null key seeds as 0; repeated rows get the
same pieces; very long segments are filtered one by one in logarithms.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelane.llm.common import bounded_batches, text_of
from wavelane.llm.hashing import mix

SHIFT = 20.0
#: Longest segment that is filtered in arrays.
LONGEST = 24
#: Bytes of text that are segmented together.
BATCH = 4 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BITS = 22


class Vocabulary:
    """Pieces of a file as byte strings with ids, weights and a hash index."""

    def __init__(self, path: str, theta: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_of = [b""] * size
        self.byte_id = np.full(256, -1, dtype=np.int64)
        ids = {}
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i).replace("▁", " ").encode()
                ids.setdefault(piece, i)
                self.bytes_of[i] = piece
        self.ids = ids
        ranks = {i: r for r, i in enumerate(sorted(ids.values(), key=lambda i: -model.get_score(i)))}
        total = sum(1 / (r + SHIFT) for r in ranks.values())
        self.log_weight = np.full(size, -math.inf)
        for i, r in ranks.items():
            self.log_weight[i] = -theta * math.log((r + SHIFT) * total)
        floor = -theta * math.log(10 * (len(ranks) + SHIFT) * total)
        self.log_weight[self.byte_id[self.byte_id >= 0]] = floor
        self.longest = max(map(len, ids))
        self.inner = np.zeros(256, dtype=bool)
        for piece in ids:
            if len(piece) > 1:
                self.inner[list(piece)] = True
        self.own = np.zeros(256, dtype=bool)
        self.own[[p[0] for p in ids if len(p) == 1]] = True
        # Weights times a constant a byte leave every draw as it is and stay near one.
        self.weight = np.exp(self.log_weight + 2.5 * np.array([len(b) for b in self.bytes_of]))
        self.powers = np.cumprod(np.full(LONGEST, _BASE, dtype=np.uint64), dtype=np.uint64)
        self.inverse = np.cumprod(np.full(LONGEST, pow(_BASE, -1, 1 << 64), dtype=np.uint64), dtype=np.uint64)
        pieces = [(self._hash(p), i) for p, i in ids.items() if len(p) <= LONGEST]
        order = sorted(pieces)
        self.keys = np.array([k for k, _ in order], dtype=np.uint64)
        self.key_ids = np.array([i for _, i in order], dtype=np.int64)
        self.maybe = np.zeros(1 << _BITS, dtype=bool)
        self.maybe[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.offsets = np.cumsum(self.lengths) - self.lengths

    def _hash(self, piece: bytes) -> int:
        values = (np.frombuffer(piece, dtype=np.uint8).astype(np.uint64) + np.uint64(1)) * self.powers[: len(piece)]
        return int(mix(values.sum(keepdims=True, dtype=np.uint64) * self.inverse[:1] + np.uint64(len(piece)))[0])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 where there is none."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        likely = np.flatnonzero(self.maybe[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[likely]), len(self.keys) - 1)
        same = self.keys[at] == hashes[likely]
        out[likely[same]] = self.key_ids[at[same]]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        begins = np.cumsum(lengths) - lengths
        at = np.repeat(self.offsets[ids] - begins, lengths) + np.arange(int(lengths.sum()))
        return self.flat[at].tobytes()


def _uniform(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (mix(keys + places.astype(np.uint64) * np.uint64(_BASE)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Sampler:
    def __init__(self, vocabulary: Vocabulary, seed: int = 0):
        self.v, self.seed = vocabulary, seed

    def __call__(self, texts: list[bytes], keys: list[int]) -> list[np.ndarray]:
        """Piece ids of each text, drawn with its key."""
        v, joined = self.v, b"".join(texts)
        if not joined:
            return [np.empty(0, dtype=np.int64) for _ in texts]
        data = np.frombuffer(joined, dtype=np.uint8)
        n = len(data)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        edges = np.cumsum(lengths)
        begin = np.zeros(n + 1, dtype=bool)
        begin[0] = True
        begin[edges] = True
        space, lone = data == 32, ~v.inner[data]
        begin[1:n] |= (space[1:] & ~space[:-1]) | lone[1:] | lone[:-1]
        starts = np.flatnonzero(begin[:n])
        sizes = np.diff(np.append(starts, n))
        text_of_segment = np.searchsorted(edges, starts, side="right")
        row_keys = mix(np.array([(k & (2**64 - 1)) for k in keys], dtype=np.uint64) + mix(np.array([self.seed + 1], dtype=np.uint64)))
        seg_keys = row_keys[text_of_segment]
        seg_places = starts - (edges - lengths)[text_of_segment]
        out = np.full(n, -1, dtype=np.int64)
        for size in np.unique(sizes):
            mine = np.flatnonzero(sizes == size)
            if size > LONGEST:
                for k in mine:
                    self._one(joined[starts[k] : starts[k] + size], starts[k], seg_keys[k], int(seg_places[k]), out)
            else:
                self._many(data, starts[mine], int(size), seg_keys[mine], seg_places[mine], out)
        counts = np.add.reduceat(np.append(out >= 0, False).astype(np.int64), np.minimum(edges - lengths, n))
        counts[lengths == 0] = 0
        ids = out[out >= 0]
        stops = np.cumsum(counts)
        return [ids[s - c : s] for s, c in zip(stops, counts)]

    def _many(self, data: np.ndarray, starts: np.ndarray, size: int, keys: np.ndarray, places: np.ndarray, out: np.ndarray) -> None:
        """Segments of one length: the lattices of the distinct ones, then a draw for each occurrence."""
        v = self.v
        chars = data[starts[:, None] + np.arange(size)]
        marks = (chars.astype(np.uint64) + np.uint64(1)) * v.powers[:size]
        prefix = np.zeros((len(starts), size + 1), dtype=np.uint64)
        np.cumsum(marks, axis=1, out=prefix[:, 1:])
        _, first, row = np.unique(prefix[:, -1], return_index=True, return_inverse=True)
        prefix, chars = prefix[first], chars[first]
        d, most = len(first), min(size, v.longest)
        alpha = np.zeros((d, size + 1))
        alpha[:, 0] = 1.0
        share = np.zeros((size + 1, d, most))
        piece = np.full((size + 1, d, most), -1, dtype=np.int32)
        for end in range(1, size + 1):
            for length in range(1, min(end, most) + 1):
                low = end - length
                hashes = mix((prefix[:, end] - prefix[:, low]) * v.inverse[low] + np.uint64(length))
                found = v.find(hashes)
                if length == 1:
                    byte = chars[:, low]
                    found = np.where(v.own[byte], found, v.byte_id[byte])
                known = found >= 0
                piece[end, :, length - 1] = found
                share[end, :, length - 1] = np.where(known, alpha[:, low] * v.weight[np.maximum(found, 0)], 0.0)
            alpha[:, end] = share[end].sum(axis=1)
        upto = np.cumsum(share, axis=2)
        at, here = np.arange(len(starts)), np.full(len(starts), size)
        while len(at):
            rows = row[at]
            draw = _uniform(keys[at], places[at] + here) * alpha[rows, here]
            length = np.minimum((upto[here, rows] <= draw[:, None]).sum(axis=1), np.minimum(here, most) - 1) + 1
            chosen = piece[here, rows, length - 1]
            here = here - length
            out[starts[at] + here] = chosen
            going = here > 0
            at, here = at[going], here[going]

    def _one(self, segment: bytes, start: int, key: np.uint64, place: int, out: np.ndarray) -> None:
        v, n = self.v, len(segment)
        alpha = [0.0] + [-math.inf] * n
        edges: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        for end in range(1, n + 1):
            for length in range(1, min(end, v.longest) + 1):
                i = v.ids.get(segment[end - length : end], -1)
                if i < 0 and length == 1:
                    i = int(v.byte_id[segment[end - 1]])
                if i >= 0 and alpha[end - length] > -math.inf:
                    edges[end].append((length, i, alpha[end - length] + v.log_weight[i]))
            top = max(x for _, _, x in edges[end])
            alpha[end] = top + math.log(sum(math.exp(x - top) for _, _, x in edges[end]))
        end = n
        while end:
            draw = float(_uniform(np.array([key]), np.array([place + end]))[0])
            for length, i, x in edges[end]:
                draw -= math.exp(x - alpha[end])
                if draw < 0:
                    break
            out[start + end - length] = i
            end -= length


def sample(docs: DataFrame, path: str, theta: float = 1.0, seed: int = 0, with_ids: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_pieces, ids_crc32, lossless`` and, if wanted, ``ids``: one row for each row of ``docs``.

    ``lossless`` is found by decoding the pieces and comparing with the text.
    """
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler(Vocabulary(path, theta), seed)
        for frame in frames:
            names, texts, low = list(frame["doc_id"]), [t.encode() for t in frame["text"]], 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high]) <= BATCH):
                    size += len(texts[high])
                    high += 1
                part = texts[low:high]
                pieces = sampler(part, [0 if pd.isna(k) else int(k) for k in names[low:high]])
                rows = {
                    "doc_id": pd.array([None if pd.isna(k) else int(k) for k in names[low:high]], dtype="Int64"), "n_bytes": [len(t) for t in part], "n_pieces": [len(p) for p in pieces],
                    "ids_crc32": [zlib.crc32(p.astype("<u4").tobytes()) for p in pieces], "lossless": [sampler.v.decode(p) == t for p, t in zip(pieces, part)],
                }
                yield pd.DataFrame(rows | ({"ids": [p.astype(np.int32) for p in pieces]} if with_ids else {}))
                low = high

    schema = "doc_id bigint, n_bytes bigint, n_pieces bigint, ids_crc32 bigint, lossless boolean"
    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInPandas(run, schema + (", ids array<int>" if with_ids else ""))
