"""Licence notices: exact phrases and a fuzzy search for short notices.

A text becomes words of a-z, 0-9 and everything beyond ASCII, lower-cased and joined by single
spaces. Exact phrases are found word by word. For the fuzzy notices, pigeonhole: a notice that
occurs with at most k edits, cut into k + 1 pieces, holds one piece unchanged. Each piece that is
found is a candidate; the ``regex`` library finds the best match of the whole notice with at most k
edits in the window around it. The best of all are kept first, and what a window holds beside the
kept ones is searched again, so every occurrence within k edits is kept or overlaps one that is.

Defined results: a null text counts as empty; no words give null first and last word, empty labels
and score 0; equal rows give equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType

from .common import fields, map_texts

#: Exact phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Fuzzy notices: label, words of the notice, edits allowed.
NOTICES = (
    ("apache", "licensed under the apache license", 3),
    ("mit", "permission is hereby granted free of charge", 4),
    ("mit", "released under the mit license", 2),
    ("bsd", "redistribution and use in source and binary forms", 4),
    ("gpl", "gnu general public license", 2),
    ("lgpl", "lesser general public license", 2),
    ("mpl", "mozilla public license", 2),
    ("cc-by", "creative commons attribution", 2),
    ("warranty", "without warranty of any kind", 2),
    ("reserved", "all rights reserved", 1),
)
SCHEMA = fields(
    n_words=LongType(), n_base=LongType(), first_word=LongType(), last_word=LongType(), base_labels=StringType(), labels=StringType(), score=DoubleType(), spans=StringType(),
)

#: Every byte that is no part of a word becomes a space, A to Z become a to z.
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice cut into ``edits + 1`` pieces of nearly equal length, with their offsets."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def searcher():
    """A function from the joined words of a text to its fuzzy matches (label, start, end, edits)."""
    import ahocorasick
    import regex

    auto, seeds = ahocorasick.Automaton(), {}
    for i, (_, notice, edits) in enumerate(NOTICES):
        for offset, piece in pieces(notice, edits):
            seeds.setdefault(piece, []).append((i, offset))
    for piece, places in seeds.items():
        auto.add_word(piece, (len(piece), places))
    auto.make_automaton()
    fuzzy = [regex.compile(f"(?b)(?:{regex.escape(notice, special_only=True)}){{e<={edits}}}") for _, notice, edits in NOTICES]

    def search(words: str) -> list[tuple[str, int, int, int]]:
        windows: dict[int, list[list[int]]] = {}
        for end, (length, places) in auto.iter(words):
            for i, offset in places:
                edits = NOTICES[i][2]
                a = end + 1 - length - offset - edits
                b = a + len(NOTICES[i][1]) + 2 * edits
                own = windows.setdefault(i, [])
                own.append([max(0, a), b])
        found = []
        for i, own in windows.items():
            label, notice, edits = NOTICES[i]
            own.sort()
            # candidates of one place; a longer window would be searched whole for each of its places
            joined = own[:1]
            first = own[0][0]
            for a, b in own[1:]:
                if a <= first + 2 * edits:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
                    first = a
            best, kept = [], []

            def look(a, b):
                if b - a >= len(notice) - edits and (m := fuzzy[i].search(words, a, b)):  # noqa: B023
                    heapq.heappush(best, (sum(m.fuzzy_counts), *m.span(), a, b))  # noqa: B023

            for a, b in joined:
                look(a, min(b, len(words)))
            while best:
                e, start, end, a, b = heapq.heappop(best)
                k = bisect_left(kept, (start, start))
                near = [x for x in kept[max(0, k - 1) : k + 1] if x[0] < end and start < x[1]]
                if not near:
                    insort(kept, (start, end))
                    found.append((label, start, end, e))
                    near = [(start, end)]
                x, y = near[0]
                look(a, min(x, b))
                look(max(y, a), b)
        return sorted(set(found), key=lambda f: (f[1], f[2], f[0]))

    return search


def find_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: words, exact phrases, fuzzy notices (``spans`` as label:start:end:edits in
    the joined words), and the best match's likeness as ``score`` (1 for an exact phrase)."""

    def make():
        search = searcher()
        exact = [(f" {p} ", label) for p, label in PHRASES.items()]

        def one(value):
            words = (value or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
            joined = f" {b' '.join(words).decode('utf-8', 'replace')} "
            places, base = [], set()
            for phrase, label in exact:
                last, n, at = 0, 0, joined.find(phrase)
                while at >= 0:
                    # words before a place: those before the last one, and those between
                    n += joined.count(" ", last, at)
                    places.append(n)
                    base.add(label)
                    last, at = at, joined.find(phrase, at + 1)
            fuzzy = search(joined)
            likeness = [1 - e / (b - a) if b > a else 0.0 for _, a, b, e in fuzzy]
            return (
                len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                ",".join(sorted(base | {f[0] for f in fuzzy})), 1.0 if base else max([0.0, *likeness]), ",".join(f"{k}:{a - 1}:{b - 1}:{e}" for k, a, b, e in fuzzy),
            )

        return lambda texts: dict(zip(SCHEMA.names, zip(*map(one, texts), strict=True), strict=True))

    return map_texts(docs, make, SCHEMA, key, text)
