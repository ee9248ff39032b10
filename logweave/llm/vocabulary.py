"""A fixed set of pieces, looked up for many words of equal length at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def codes(words: list[str], n: int) -> np.ndarray:
    """A row of letters for each word, all of n letters."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n).astype(np.uint64) + np.uint64(1)


def by_length(found: list[str]):
    groups: dict[int, list[str]] = {}
    for w in found:
        groups.setdefault(len(w), []).append(w)
    return groups.items()


class Vocabulary:
    """Pieces, found by a hash of their letters for many words at once.

    ``ids`` numbers them from 0; ``size`` stands for no piece, ``size + 1`` for a letter that is none.
    """

    BITS = 20
    #: Letters that are looked up at once.
    BLOCK = 1 << 16

    def __init__(self, pieces: list[str]) -> None:
        self.longest = longest = max(map(len, pieces))
        self.size = len(pieces)
        self.ids = {x: i for i, x in enumerate(pieces)}
        self.keys = np.zeros(self.size + 1, np.uint64)
        for n in range(1, longest + 1):
            own = [x for x in pieces if len(x) == n]
            if own:
                h = np.zeros(len(own), np.uint64)
                for column in codes(own, n).T:
                    h = h * _BASE + column
                self.keys[[self.ids[x] for x in own]] = h
        if len(np.unique(self.keys[:-1])) < self.size:
            raise ValueError("two pieces share a hash")
        # pieces that share a slot go to the next table
        self.tables, rest = [], np.arange(self.size)
        while len(rest):
            table = np.full(1 << self.BITS, self.size, np.int32)
            slots = self.slot(self.keys[rest], len(self.tables))
            table[slots[::-1]] = rest[::-1]
            self.tables.append(table)
            rest = rest[table[slots] != rest]

    def slot(self, h, k: int):
        return ((h ^ (h >> np.uint64(29 + k))) * _MIX >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, h):
        """Numbers of the pieces with the hashes ``h``, or ``size``."""
        out = np.full(h.shape, self.size, np.int32)
        for k, table in enumerate(self.tables):
            got = table[self.slot(h, k)]
            np.copyto(out, got, where=(self.keys[got] == h) & (got < self.size))
        return out

    def starting(self, words: list[str], n: int, backwards: bool = False) -> Iterator[tuple[int, list[tuple[int, np.ndarray]]]]:
        """For each letter i of ``words`` (all of n letters), in order or from the last: the lengths
        of pieces that start there in any word, shortest first, with their numbers in every word."""
        letters, block = codes(words, n).T, max(1, self.BLOCK // len(words))
        firsts = range(0, n, block)
        for at in reversed(firsts) if backwards else firsts:
            many = min(block, n - at)
            h, rows = np.zeros((many, len(words)), np.uint64), []
            for size in range(1, min(n - at, self.longest) + 1):
                own = min(many, n - at - size + 1)  # letters from which so many are left
                h = h[:own] * _BASE + letters[at + size - 1 : at + size - 1 + own]
                found = self.find(h)
                if size == 1:
                    found[found == self.size] = self.size + 1
                rows.append((found, (found < self.size).any(axis=1).tolist() if size > 1 else [True] * own))
            for k in range(many - 1, -1, -1) if backwards else range(many):
                yield at + k, [(size, found[k]) for size, (found, there) in enumerate(rows, 1) if k < len(there) and there[k]]

    def edges(self, words: list[str], n: int) -> dict[tuple[int, int], np.ndarray]:
        """The same for all letters i at once, by (i, end)."""
        return {(i, i + size): ids for i, spans in self.starting(words, n) for size, ids in spans}
