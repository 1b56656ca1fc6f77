"""License scan: short notices found with a bounded number of edits.

A notice of ``m`` characters may differ by up to ``m // 10`` edits (one at least). Cut into one piece
more than that, every such occurrence holds a piece unchanged (pigeonhole), so an automaton over
all pieces finds the candidates in one pass over the lower-cased text. Around each, the regex
library's bounded-error matching verifies the notice and reports its span and its edits; windows of
one notice that overlap are searched once.

Base places are exact: phrases whose words stand consecutively. They always count, with score 1.

Defined cases: null text counts as empty (no words, no labels, score 0); texts of any length are
searched whole; repeated rows are searched each; null ids stay null; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelane.llm.common import bounded_batches, text_of

#: Exact phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices searched with edits, and their labels.
NOTICES = (
    ("licensed under the apache license", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ("licensed under the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("licensed under cc by", "cc-by"),
    ("redistribution and use in source and binary forms, with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("all rights reserved", "reserved"),
    ("this is free and unencumbered software released into the public domain", "public-domain"),
)
#: Words of the notices above that name the licence.
NAMES = ("apache", "mit", "gnu", "lesser", "general", "public", "creative", "commons", "attribution", "cc", "by", "mozilla", "unencumbered", "domain")
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_IN = rb"0-9a-z\x80-\xff"


def edits_of(notice: str) -> int:
    return max(1, len(notice) // 10)


def pieces_of(notice: str) -> list[tuple[int, str]]:
    """The notice cut into ``edits + 1`` pieces of nearly one length, with their offsets."""
    n = edits_of(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Finder:
    def __init__(self, notices: Sequence[tuple[str, str]] = NOTICES, phrases: Sequence[tuple[str, str]] = PHRASES, names: Sequence[str] = NAMES):
        import ahocorasick
        import regex

        def near(text: str, edits: int) -> str:
            return f"(?:{regex.escape(text, special_only=True, literal_spaces=True)}){{e<={edits}}}"

        def names_in(notice: str) -> list:
            return [regex.compile(f"(?<![a-z]){near(w, len(w) // 5)}(?![a-z])") for w in notice.split() if w in names]

        self.notices = [(n, label, edits_of(n), regex.compile("(?e)" + near(n, edits_of(n))), names_in(n)) for n, label in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (notice, _) in enumerate(notices):
            for offset, piece in pieces_of(notice):
                seeds.setdefault(piece, []).append((k, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()
        edge, gap = rb"(?<![" + _IN + rb"])", rb"[^" + _IN + rb"]+"
        self.phrases = [(p.split()[0].encode(), re.compile(edge + gap.join(w.encode() for w in p.split()) + rb"(?![" + _IN + rb"])"), label) for p, label in phrases]

    def places(self, lowered: bytes) -> list[tuple[int, str]]:
        """(byte, label) of every exact phrase."""
        return sorted((m.start(), label) for first, pattern, label in self.phrases if first in lowered for m in pattern.finditer(lowered))

    def _verified(self, k: int, lowered: str, low: int, high: int) -> Iterator[tuple[int, int, str, int, int]]:
        notice, label, _, pattern, names = self.notices[k]
        while match := pattern.search(lowered, low, high):
            if all(name.search(match.group()) for name in names):
                yield match.start(), match.end(), label, sum(match.fuzzy_counts), len(notice)
                low = match.end()
            else:  # another licence's name: a right one may still begin inside
                low = match.start() + 1

    def matches(self, lowered: str) -> list[tuple[int, int, str, int, int]]:
        """(start, end, label, edits, length of the notice) of every notice within its edits, in code points."""
        windows: dict[int, list[list[int]]] = {}
        for last, (length, places) in self.seeds.iter(lowered):
            for k, offset in places:
                notice, _, edits, *_ = self.notices[k]
                low = max(0, last + 1 - length - offset - edits)
                windows.setdefault(k, []).append([low, min(len(lowered), low + len(notice) + 2 * edits)])
        found = []
        for k, spans in windows.items():
            spans.sort()
            joined = [spans[0]]
            for low, high in spans[1:]:
                if low <= joined[-1][1]:
                    joined[-1][1] = max(high, joined[-1][1])
                else:
                    joined.append([low, high])
            for low, high in joined:
                found += self._verified(k, lowered, low, high)
        return sorted(found)


def scan(docs: DataFrame, notices: Sequence[tuple[str, str]] = NOTICES, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``: one row for each row of ``docs``.

    ``spans`` lists ``label:start:end:edits`` of the notices, in code points.
    """
    bounded_batches(docs.sparkSession)
    notices, phrases = tuple(notices), tuple(phrases)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(notices, phrases)
        for frame in frames:
            out = []
            for text in frame["text"]:
                lowered = text.encode().lower()
                inside = np.zeros(len(lowered) + 1, dtype=bool)
                inside[1:] = _WORD[np.frombuffer(lowered, dtype=np.uint8)]
                starts = np.flatnonzero(inside[1:] & ~inside[:-1])
                places = finder.places(lowered)
                words = np.searchsorted(starts, [b for b, _ in places]).tolist()
                found = finder.matches(lowered.decode())
                base = {label for _, label in places}
                score = 1.0 if places else max((1 - e / size for *_, e, size in found), default=0.0)
                out.append((len(starts), len(places), words[0] if words else None, words[-1] if words else None, ",".join(sorted(base)), ",".join(sorted(base | {m[2] for m in found})), max(0.0, score), ",".join(f"{label}:{a}:{b}:{e}" for a, b, label, e, _ in found)))
            rows = pd.DataFrame(out, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            yield rows.assign(doc_id=frame["doc_id"].to_numpy(), first_word=rows["first_word"].astype("Int64"), last_word=rows["last_word"].astype("Int64"))

    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans string"
    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInPandas(run, schema)
