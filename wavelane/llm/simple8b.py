"""Token ids in Simple-8b blocks: word-aligned coding with selectors, escapes and per-block offsets.

File format (one row of a Parquet table is one block; Spark writes and commits it, so a lost task
leaves nothing behind and any store will do):

``shard, block``        range partition of the ids' order and the block's number in it
``start``               ids of the shard before this block
``n_ids``               ids in the block; a block ends with the document that brings it to ``BLOCK``
``words``               little-endian 64-bit words; the top four bits of a word are its selector
``doc_ids, doc_counts`` the documents of the block with their id counts

Selector ``s`` below 15 packs ``COUNTS[s]`` ids of ``60 // COUNTS[s]`` bits, lowest first.
Selector 15 is an escape: the next word is one raw id of up to 64 bits. The last packed word may
hold fewer ids than its selector says; ``n_ids`` tells. All words of a block with one selector are
decoded in one array operation.

Defined cases: null text counts as empty (the end id alone); null ids come first; repeated rows
are written each, ordered by text; an empty table gives an empty file.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavelane.llm.common import bounded_batches, text_of

#: Ids a word holds, by selector.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
HELD = np.array([*COUNTS, 1, 1], dtype=np.uint8)
BLOCK = 1 << 16
#: Cached units of one Python worker.
CACHED = 5 << 18
#: Characters of the texts that are split together.
CHARS = 1 << 23
#: Characters that stand for the bytes that are none in print, in byte-level vocabularies.
BYTE_LEVEL = {b: chr(256 + k) for k, b in enumerate([*range(33), *range(127, 161), 173])}
#: White space beside the space and the line feed.
OTHER_SPACES = "\t\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SCHEMA = "shard int, block int, start bigint, n_ids bigint, words binary, doc_ids array<bigint>, doc_counts array<bigint>"


def _selectors(ids: np.ndarray) -> np.ndarray:
    """For every position: the selector of the fullest word that could begin there.

    Ids that fit a fuller word also fit every emptier one, so selectors are tried from the emptiest
    on. The largest id of a window is that of two windows of a power of two, made by doubling.
    """
    n, most = len(ids), int(ids.max()).bit_length()
    top = np.zeros(n + COUNTS[0], dtype=np.uint16 if most <= 16 else np.uint32 if most <= 32 else np.uint64)
    top[:n] = ids
    selector, reach = np.full(n, ESCAPE, dtype=np.uint8), 1
    for s in range(len(COUNTS) - 1, -1, -1):
        count, bits = COUNTS[s], 60 // COUNTS[s]
        while 2 * reach <= count:
            top, reach = np.maximum(top[:-reach], top[reach:]), 2 * reach
        if bits >= most:
            selector[:] = s
        else:
            fits = np.maximum(top[:n], top[count - reach : count - reach + n]) < 1 << bits
            if not fits.any():
                break
            selector[fits] = s
    return selector


def encode(ids: np.ndarray) -> bytes:
    """Simple-8b words of one block of unsigned ids."""
    n = len(ids)
    if not n:
        return b""
    padded = np.zeros(n + COUNTS[0], dtype=np.uint64)
    padded[:n] = ids
    selector = _selectors(padded[:n])
    jumps, walk, i = HELD[selector].tobytes(), [], 0
    while i < n:
        walk.append(i)
        i += jumps[i]
    starts = np.array(walk)
    chosen = selector[starts]
    escaped = chosen == ESCAPE
    place = np.cumsum(1 + escaped) - (1 + escaped)
    words = np.zeros(int((1 + escaped).sum()), dtype=np.uint64)
    words[place[escaped]] = np.uint64(ESCAPE << 60)
    words[place[escaped] + 1] = padded[starts[escaped]]
    for s, count in enumerate(COUNTS):
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            first, packed = starts[mine], np.full(len(mine), s << 60, dtype=np.uint64)
            for j in range(count):
                packed |= padded[first + j] << np.uint64(j * (60 // count))
            words[place[mine]] = packed
    return words.astype("<u8", copy=False).tobytes()


def decode(words: bytes, n_ids: int) -> np.ndarray:
    """The ids of a block."""
    w = np.frombuffer(words, dtype="<u8")
    if not len(w):
        return np.empty(0, dtype=np.uint64)
    selector = (w >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(w), dtype=bool)
    for k in np.flatnonzero(selector == ESCAPE):
        if not raw[k]:
            raw[k + 1] = True
    held = HELD[selector].astype(np.int64)
    held[(selector == ESCAPE) & ~raw] = 0
    held[raw] = 1
    ends = np.cumsum(held)
    out = np.zeros(int(ends[-1]), dtype=np.uint64)
    out[ends[raw] - 1] = w[raw]
    for s, count in enumerate(COUNTS):
        mine = np.flatnonzero((selector == s) & ~raw)
        if len(mine):
            bits = 60 // count
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            values = (w[mine, None] >> shifts) & np.uint64((1 << bits) - 1)
            out[(ends[mine] - count)[:, None] + np.arange(count)] = values
    return out[:n_ids]


def _mapped(word: str) -> str:
    """A word as the byte-level pre-tokenizer writes it: one character for each byte."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LEVEL)


class UnitEncoder:
    """Ids of texts by the tokenizers library.

    The byte-level pre-tokenizer always parts a text before a space that follows another character
    and is no first one of several spaces, on both sides of a line feed between two other characters
    that are no white space, and between a letter and one of ``MARKS``. Units cut there are given to
    the library once, many in one text with line feeds between them, and kept, with two bytes an id
    where they suffice. A unit is held without its space; ``LINE`` begins one that has a line feed
    there instead, and the first of a text. Texts with two spaces in a row, with other white space,
    with a lone space on a line or with an added token go to the library whole.

    Arrow splits the texts and numbers their different units, so that the cache is asked once for each.
    A unit of letters is one piece to the pre-tokenizer, so the library's model gets it directly.
    """

    MARKS = ",.!?;:|$%&*#"
    LINE = "\r"  # a text with it goes whole, so no unit has one

    def __init__(self, path: str):
        # Library, ids' bytes and cache outlive the task in a reused worker process, in a module made for them.
        store = vars(sys.modules.setdefault("_token_unit_cache", types.ModuleType("_token_unit_cache")))
        if path not in store:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            most = max(library.get_vocab(with_added_tokens=True).values())
            codes = np.arange(most + 1, dtype="<u2" if most < 1 << 16 else "<u4")
            store[path] = library, codes.dtype, [c.tobytes() for c in codes], {}
        self.library, self.dtype, self.code, self.known = store[path]
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        (self.feed,) = self.library.encode("\n", add_special_tokens=False).ids

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, units: list[str]) -> None:
        """Learn units; those of other characters than letters, but without line feeds, go in as lines of one text."""
        known, line, width, code, feed = self.known, self.LINE, self.dtype.itemsize, self.code, self.code[self.feed]
        tokenize, plain, left = self.library.model.tokenize, [], []
        for u in units:
            if u.isalpha():
                known[u] = b"".join([code[t.id] for t in tokenize(f"Ġ{_mapped(u)}")])
            elif (word := u[1:]).isalpha() and u[0] == line:
                known[u] = feed + b"".join([code[t.id] for t in tokenize(_mapped(word))])
            else:
                (plain if u and u != line and "\n" not in u else left).append(u)
        for low in range(0, len(plain), 8192):
            part = plain[low : low + 8192]
            lines = "".join([f"{u[1:]}\n" if u[0] == line else f" {u}\n" for u in part])
            ids = np.array(self.library.encode_batch_fast([lines], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = np.flatnonzero(ids == self.feed)
            if len(ends) == len(part):
                data, begin = ids.tobytes(), 0
                for u, end in zip(part, (width * ends).tolist()):
                    known[u] = feed + data[begin:end] if u[0] == line else data[begin:end]
                    begin = end + width
            else:
                left += part
        bare = self._raw([u[1:] if u[:1] == line else f" {u}" for u in left])
        known.update((u, feed + ids if u[:1] == line else ids) for u, ids in zip(left, bare))

    def _learn(self, units: list[str]) -> None:
        known, split, fresh = self.known, [], set()
        for unit in units:
            word = unit.rstrip(self.MARKS)
            if len(word) != len(unit) and word and word[-1].isalpha():
                split.append((unit, word))
                if word not in known:
                    fresh.add(word)
            else:
                fresh.add(unit)
        self._apart(list(fresh))
        marks_of = list({unit[len(word) :] for unit, word in split})
        after = dict(zip(marks_of, self._raw(marks_of)))
        for unit, word in split:
            known[unit] = known[word] + after[unit[len(word) :]]

    def _split(self, texts: list[str]) -> tuple[pa.ListArray, list[int]]:
        """The units of every text, and the places of those that go whole (they hold ``LINE`` alone).

        A line feed parts units only where no longer run of white space needs to stay together.
        """
        column = pa.array(texts, pa.string())
        whole = pc.match_substring_regex(column, f"  |\n \n|\n \\z|[{OTHER_SPACES}]")
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(column, token))
        kept = pc.match_substring_regex(column, " \n|\n\n\n|\n\n |\n\n\\z")
        column = pc.if_else(kept, column, pc.replace_substring(column, "\n", " " + self.LINE))
        column = pc.binary_join_element_wise(self.LINE, pc.if_else(whole, "", column), "")
        return pc.split_pattern(column, " "), np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        known, width = self.known, self.dtype.itemsize
        if len(known) > CACHED:
            kept = {k: v for k, v in known.items() if len(k) <= 6}  # short words come back soonest
            known.clear()
            known.update(kept if len(kept) < CACHED // 2 else {})
        lists, whole = self._split(texts)
        numbered = lists.flatten().dictionary_encode()
        units, unit = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy().astype(np.int64)
        data = list(map(known.get, units))
        unknown = [u for u, ids in zip(units, data) if ids is None]
        if unknown:
            self._learn(unknown)
            data = [known[u] if ids is None else ids for u, ids in zip(units, data)]
        first = lists.offsets.to_numpy()[:-1]
        unit[first[whole]] = len(units) + np.arange(len(whole))
        data += [b"\0" * width + ids for ids in self._raw([texts[i] for i in whole])]
        held = np.fromiter(map(len, data), np.int64, len(data)) // width
        start, count = (np.cumsum(held) - held)[unit], held[unit]
        start[first] += 1  # no line feed stands before a text
        count[first] -= 1
        ends = np.cumsum(count)
        place = np.repeat(start - (ends - count), count) + np.arange(int(ends[-1]))
        return np.frombuffer(b"".join(data), dtype=self.dtype)[place], np.add.reduceat(count, first)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes (32-bit little-endian)."""
        if not texts:
            return []
        ids, counts = self.ids_of(texts)
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, block: int = BLOCK) -> None:
    """Encode ``doc_id, text`` and write the blocks below ``path`` in ascending order of ids."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        shard = context.partitionId() if context else 0
        units = UnitEncoder(tokenizer)
        parts, size, names, counts = [], 0, [], []
        number = start = 0

        def block_row() -> pa.RecordBatch:
            many = pa.list_(pa.int64())
            columns = (shard, pa.int32()), (number, pa.int32()), (start, pa.int64()), (size, pa.int64()), (encode(np.concatenate(parts)), pa.binary()), (names, many), (counts, many)
            return pa.RecordBatch.from_arrays([pa.array([value], kind) for value, kind in columns], ["shard", "block", "start", "n_ids", "words", "doc_ids", "doc_counts"])

        for batch in batches:
            docs_of, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            group = np.cumsum([len(t) for t in texts]) // CHARS
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
            for low, high in pairwise(edges if texts else []):
                ids, each = units.ids_of(texts[low:high])
                ids, done, here = np.insert(ids.astype("<u4"), np.cumsum(each), end_id), 0, 0
                for doc, count in zip(docs_of[low:high], (each + 1).tolist()):
                    names.append(doc)
                    counts.append(count)
                    size, here = size + count, here + count
                    if size >= block:
                        parts.append(ids[done:here])
                        yield block_row()
                        number, start, done = number + 1, start + size, here
                        parts, size, names, counts = [], 0, [], []
                parts.append(ids[done:])
        if size:
            yield block_row()

    ordered = docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files."""
    blocks = spark.read.parquet(path)
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            start, n_ids = batch.column("start").to_numpy(), batch.column("n_ids").to_numpy()
            counts = batch.column("doc_counts").flatten().to_numpy()
            of_block = np.repeat(np.arange(batch.num_rows), batch.column("doc_ids").value_lengths().to_numpy())
            ends = np.cumsum(counts)
            ids = [decode(words, n) for words, n in zip(batch.column("words").to_pylist(), n_ids.tolist())]
            data = memoryview(np.concatenate(ids).astype("<u4").tobytes())
            crcs = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
            shard = batch.column("shard").to_numpy()[of_block]
            within = (start - (np.cumsum(n_ids) - n_ids))[of_block] + ends - counts
            yield pa.RecordBatch.from_arrays([batch.column("doc_ids").flatten(), pa.array(shard), pa.array(within), pa.array(counts), pa.array(crcs, pa.int64())], ["doc_id", "shard", "within", "n_tokens", "ids_crc32"])

    rows = blocks.mapInArrow(run, "doc_id bigint, shard int, within bigint, n_tokens bigint, ids_crc32 bigint")
    # One row a shard: their number is that of the writing tasks.
    before = F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids")).select("shard", before.alias("before"))
    return rows.join(shards, "shard").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
