"""Suffix order and common prefixes of a shard of fragments by induced sorting with queues on disk.

Suffixes are sorted by induction: those that start a rising run after a falling one are sorted by
recursion on the names of the substrings between them; from these the falling suffixes are
induced in rising order, and from these the rising ones in falling order. The priority queue
of both passes holds (suffix, common prefix with the one queued before it for the same letter). Letters
leave it in order, and what was queued for a letter leaves in the order in which it came, so it is a row of first-in,
first-out queues; when they hold more than ``LIMIT`` entries, all but the next are moved to a file.
"""

from __future__ import annotations

import tempfile
from array import array
from bisect import bisect_left

import numpy as np

#: Queue entries kept in memory, and names of starts that are sorted in memory.
LIMIT, BASE = 250_000, 2_000_000
_TOP = b"\xff" * 4


class Queues:
    """A queue of number pairs for each letter; ``take`` gives and empties one."""

    def __init__(self, limit: int = LIMIT) -> None:
        self.limit, self.held, self.rows, self.file, self.parts = limit, 0, {}, None, {}

    def put(self, letter: int, a: int, b: int) -> None:
        row = self.rows.get(letter)
        if row is None:
            row = self.rows[letter] = array("q")
        row.append(a)
        row.append(b)
        self.held += 2
        if self.held > self.limit:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115  gone when closed
        self.file.seek(0, 2)
        for letter, row in self.rows.items():
            self.parts.setdefault(letter, []).append((self.file.tell(), len(row)))
            self.file.write(row.tobytes())
        self.rows, self.held = {}, 0

    def take(self, letter: int):
        """Pairs in the order in which they came; more may be put for the same letter meanwhile."""
        while letter in self.parts or letter in self.rows:
            for at, n in self.parts.pop(letter, []):
                self.file.seek(at)
                part = array("q")
                part.frombytes(self.file.read(8 * n))
                for k in range(0, n, 2):
                    yield part[k], part[k + 1]
            # what was moved to the file meanwhile came before what is in memory
            row = None if letter in self.parts else self.rows.pop(letter, None)
            if row is not None:
                self.held -= len(row)
                for k in range(0, len(row), 2):
                    yield row[k], row[k + 1]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Least:
    """The least of the values added since any earlier time."""

    def __init__(self) -> None:
        self.at, self.values, self.now = [], [], 0

    def add(self, value: int) -> None:
        while self.values and self.values[-1] >= value:
            self.values.pop()
            self.at.pop()
        self.values.append(value)
        self.at.append(self.now)
        self.now += 1

    def since(self, time: int) -> int:
        """Of the values added at ``time`` or later; there must be one."""
        return self.values[bisect_left(self.at, time)]


def packed(letters: np.ndarray) -> bytes:
    """Letters of four bytes each, whose order as bytes is that of the numbers; below 2**32 - 1."""
    return letters.astype(">u4").tobytes()


def common(s: bytes, a: int, b: int) -> int:
    """Letters in the common prefix of two different suffixes of packed letters."""
    a, b = 4 * a, 4 * b
    n, step, most = 0, 128, len(s) - max(a, b)
    while n < most:
        if s[a + n : a + n + step] == s[b + n : b + n + step] and n + step <= most:
            n += step
            step = min(16_384, step * 2)
        elif step > 1:
            step //= 2
        else:
            break
    return n // 4


def common_prefixes(codes: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 16) -> np.ndarray:
    """The same for many pairs at once; they differ before the end, whose letter is found once."""
    padded = np.concatenate([codes, np.zeros(step, codes.dtype)])
    out, left, at = np.zeros(len(a), np.int64), np.arange(len(a)), np.arange(step)
    while len(left):
        apart = padded[(a[left] + out[left])[:, None] + at] != padded[(b[left] + out[left])[:, None] + at]
        done = apart.any(axis=1)
        out[left] += np.where(done, apart.argmax(axis=1), step)
        left = left[~done]
    return out


def rising(codes: np.ndarray) -> np.ndarray:
    """Whether each suffix is less than the next one; the last, of a letter below all, counts as such."""
    n = len(codes)
    sign = np.sign(np.diff(codes.astype(np.int64)))
    out = np.ones(n, bool)
    moving = np.flatnonzero(sign)
    after = np.searchsorted(moving, np.arange(n - 1))
    out[:-1] = sign[moving[np.minimum(after, len(moving) - 1)]] > 0 if len(moving) else True
    return out


def suffixes(text: str | np.ndarray, limit: int = LIMIT) -> tuple[array, array]:
    """Suffix order of ``text`` (a str, or numbers from 0), whose last letter is below all others and
    found once, and the common prefix of each suffix with the one before it."""
    n = len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") if isinstance(text, str) else text
    s = packed(codes)
    if n == 1:
        return array("q", [0]), array("q", [0])
    up = rising(codes)
    starts = (np.flatnonzero(up[1:] & ~up[:-1]) + 1).tolist()
    if not starts:  # falls from end to end
        order = array("q", range(n - 1, -1, -1))
        return order, array("q", [0] + [common(s, a, b) for a, b in zip(order, order[1:], strict=False)])

    # substrings between starts, with a top letter, so that of a substring and its prefix the longer is less
    ends = [*starts[1:], n - 1]
    subs = [s[4 * a : 4 * b + 4] + _TOP for a, b in zip(starts, ends, strict=True)]
    names = {x: k for k, x in enumerate(sorted(set(subs)))}
    if len(names) == len(subs):
        seeds = sorted(range(len(subs)), key=lambda k: names[subs[k]])
        shared = [0] * len(seeds)
    else:
        seeds, shared = suffixes(np.array([names[x] for x in subs], np.int64), limit)
    del subs, names
    seed_lcp = [0]
    for prev, own, skip in zip(seeds, seeds[1:] if isinstance(seeds, list) else seeds[1:], shared[1:], strict=False):
        # ``skip`` whole substrings are common, then part of one
        a, b = starts[prev], starts[own]
        jump = (starts[prev + skip] if prev + skip < len(starts) else n - 1) - a if skip else 0
        seed_lcp.append(jump + common(s, a + jump, b + jump))
    letters, is_up = codes.tolist(), up.tolist()

    # falling suffixes, in rising order
    by_letter: dict[int, list[int]] = {}
    for k, x in enumerate(seeds):
        by_letter.setdefault(letters[starts[x]], []).append(k)
    alphabet = sorted(set(letters))
    queues, least, last, fallen = Queues(limit), Least(), {}, {}

    def follow(i: int, lcp: int, want_up: bool) -> None:
        least.add(lcp)
        j = i - 1
        if j >= 0 and is_up[j] is want_up:
            c = letters[j]
            if not want_up or c <= letters[i]:
                time = last.get(c)
                queues.put(c, j, 0 if time is None else 1 + least.since(time))
                last[c] = least.now

    for c in alphabet:
        own, prev = array("q"), None
        for i, lcp in queues.take(c):
            own.append(i)
            own.append(lcp if prev is not None else 0)
            follow(i, lcp if prev is not None else 0, False)
            prev = i
        if own:
            fallen[c] = own
        for k in by_letter.get(c, ()):
            i = starts[seeds[k]]
            lcp = 0 if prev is None else seed_lcp[k] if letters[starts[seeds[k - 1]]] == c and prev == starts[seeds[k - 1]] else common(s, prev, i)
            follow(i, lcp, False)
            prev = i
    queues.close()

    # rising suffixes, in falling order
    queues, least, last, risen = Queues(limit), Least(), {}, {}
    for c in reversed(alphabet):
        own, prev = array("q"), None
        for i, lcp in queues.take(c):
            own.append(i)
            own.append(lcp if prev is not None else 0)
            follow(i, lcp if prev is not None else 0, True)
            prev = i
        if own:
            risen[c] = own
        row = fallen.get(c, ())
        for k in range(len(row) - 2, -1, -2):
            i = row[k]
            lcp = 0 if prev is None else common(s, prev, i) if k == len(row) - 2 else row[k + 3]
            follow(i, lcp, True)
            prev = i
    queues.close()

    order, lcps = array("q"), array("q")
    for c in alphabet:
        prev = None
        row = fallen.get(c, ())
        for k in range(0, len(row), 2):
            order.append(row[k])
            lcps.append(row[k + 1] if k else 0)
            prev = row[k]
        row = risen.get(c, ())
        for k in range(len(row) - 2, -1, -2):
            i = row[k]
            order.append(i)
            lcps.append(0 if prev is None else common(s, prev, i) if k == len(row) - 2 else row[k + 3])
            prev = i
        if c == letters[-1]:  # the last letter of all, which nothing induces
            order.append(n - 1)
            lcps.append(0)
    return order, lcps


class Runs:
    """Queues of a pass over letters below 257: arrays of suffixes and common prefixes, first in, first
    out. When more than ``limit`` entries wait, those in memory are moved to a file."""

    def __init__(self, limit: int) -> None:
        self.limit, self.held, self.rows, self.file = limit, 0, [[] for _ in range(257)], None

    def put(self, letter: int, i: np.ndarray, lcp: np.ndarray) -> None:
        self.rows[letter].append((i, lcp))
        self.held += len(i)
        if self.held > self.limit:
            if self.file is None:
                self.file = tempfile.TemporaryFile()  # noqa: SIM115  gone when closed
            for row in self.rows:
                for k, part in enumerate(row):
                    if not isinstance(part[0], int):
                        self.file.seek(0, 2)
                        row[k] = (self.file.tell(), len(part[0]))
                        self.file.write(np.stack(part).tobytes())
            self.held = 0

    def take(self, letter: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All that waits for a letter now."""
        row, self.rows[letter] = self.rows[letter], []
        if not row:
            return None
        parts = []
        for a, b in row:
            if isinstance(a, int):
                self.file.seek(a)
                a, b = np.frombuffer(self.file.read(16 * b), np.int64).reshape(2, b)
            else:
                self.held -= len(a)
            parts.append((a, b))
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(p) for p in zip(*parts, strict=True))


class Pass:
    """One induction: suffixes leave in order, and queue the suffix before them if it is of the wanted kind."""

    def __init__(self, letters: np.ndarray, up: np.ndarray, want_up: bool, limit: int) -> None:
        self.letters, self.up, self.want, self.queues = letters, up, want_up, Runs(limit)
        self.since = np.full(257, -1, np.int64)  # least common prefix since the last one queued; -1: none yet

    def leave(self, i: np.ndarray, lcp: np.ndarray) -> None:
        least = np.minimum.accumulate(lcp)
        j = i - 1
        at = np.flatnonzero((j >= 0) & (self.up[j] == self.want) & (self.letters[j] > 0))
        to = self.letters[j[at]]
        order = np.argsort(to, kind="stable")
        at, to = at[order], to[order]
        first = np.r_[True, to[1:] != to[:-1]][: len(to)]
        ends = np.append(lcp, np.iinfo(np.int64).max)
        between = np.empty(len(at), np.int64)
        if len(at) > 1:
            pairs = np.stack([at[:-1] + 1, at[1:] + 1], axis=1).ravel()
            between[1:] = np.minimum.reduceat(ends, pairs)[::2]
        begun = self.since[to[first]]
        between[first] = np.where(begun < 0, -1, np.minimum(begun, least[at[first]]))
        # letters that queue nothing now have seen this batch too
        self.since = np.where(self.since < 0, -1, np.minimum(self.since, least[-1]))
        bounds = np.r_[np.flatnonzero(first), len(at)]
        behind = np.minimum.accumulate(ends[::-1])[::-1]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            c = int(to[a])
            self.queues.put(c, j[at[a:b]], between[a:b] + 1)
            self.since[c] = behind[at[b - 1] + 1]


def doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of a row of names that fits in memory, by doubling."""
    rank, span = names.astype(np.int64), 1
    while True:
        key = rank * (len(names) + 2)
        key[:-span] += rank[span:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        rank = np.empty_like(rank)
        rank[order] = new
        if new[-1] == len(names) - 1:
            return order
        span *= 2


def fragment_order(fragments: list[bytes], limit: int = LIMIT, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and common prefixes of fragments that each end with a letter of their own; those
    letters are below all bytes, the last one below all.

    The same induction as in ``suffixes``, a letter's queue at a time. The sort of the starts is
    recursive while more than ``base`` names are left, and in memory from there on.
    """
    n = len(fragments)
    codes = np.frombuffer(b"\0".join([*fragments, b""]), np.uint8).astype(np.int64) + n
    codes[np.cumsum([len(f) + 1 for f in fragments]) - 1] = np.arange(n - 1, -1, -1)
    s = packed(codes)
    letters = np.where(codes >= n, codes - n + 1, 0)
    up = rising(codes)
    starts = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    places = starts.tolist()
    stops = [*places[1:], len(codes) - 1][: len(places)]
    subs = [s[4 * a : 4 * b + 4] + _TOP for a, b in zip(places, stops, strict=True)]
    names = {x: k for k, x in enumerate(sorted(set(subs)))}
    row = np.array([names[x] for x in subs], np.int64)
    if len(row) and len(names) < len(row) and len(row) > base:
        seeds = np.array(suffixes(row, limit)[0], np.int64)
    elif len(row):
        seeds = doubled(row)
    else:
        seeds = row
    del subs, names
    seeds = starts[seeds]
    seed_lcp = np.zeros(len(seeds), np.int64)
    if len(seeds):
        same = np.flatnonzero((letters[seeds[1:]] == letters[seeds[:-1]]) & (letters[seeds[1:]] > 0)) + 1
        seed_lcp[same] = common_prefixes(codes, seeds[same - 1], seeds[same])
    cut = np.searchsorted(letters[seeds], np.arange(258))  # seeds are in order of their letters

    down, fallen = Pass(letters, up, False, limit), []
    ends = np.flatnonzero(letters == 0)[::-1]
    starting = ends[np.argsort(codes[ends], kind="stable")]
    # separators differ in their letters: they leave first, in order, with nothing in common
    down.leave(starting, np.zeros(n, np.int64))
    for c in range(1, 257):
        rounds, last = [], None
        while (got := down.queues.take(c)) is not None:
            i, lcp = got
            if last is None:
                lcp = np.r_[0, lcp[1:]]
            down.leave(i, lcp)
            rounds.append((i, lcp))
            last = i[-1]
        fallen.append(tuple(np.concatenate(x) for x in zip(*rounds, strict=True)) if rounds else None)
        a, b = cut[c], cut[c + 1]
        if a < b:
            lcp = seed_lcp[a:b].copy()
            lcp[0] = 0 if last is None else common(s, int(last), int(seeds[a]))
            down.leave(seeds[a:b], lcp)
    rise, risen = Pass(letters, up, True, limit), [None] * 256
    for c in range(256, 0, -1):
        rounds, last = [], None
        while (got := rise.queues.take(c)) is not None:
            i, lcp = got
            if last is None:
                lcp = np.r_[0, lcp[1:]]
            rise.leave(i, lcp)
            rounds.append((i, lcp))
            last = i[-1]
        if rounds:
            risen[c - 1] = tuple(np.concatenate(x) for x in zip(*rounds, strict=True))
        if fallen[c - 1] is not None:
            i, lcp = (x[::-1] for x in fallen[c - 1])
            lcp = np.r_[0 if last is None else common(s, int(last), int(i[0])), lcp[:-1]]
            rise.leave(i, lcp)
    order, lcps = [starting], [np.zeros(n, np.int64)]
    for f, r in zip(fallen, risen, strict=True):
        if f is not None:
            order.append(f[0])
            lcps.append(f[1])
        if r is not None:
            order.append(r[0][::-1])
            seam = 0 if f is None else common(s, int(f[0][-1]), int(r[0][-1]))
            lcps.append(np.r_[seam, r[1][::-1][:-1]])
    return np.concatenate(order), np.concatenate(lcps)


def repeated_starts(fragments: list[bytes], many: list[bool], length: int, limit: int = LIMIT, base: int = BASE) -> list[np.ndarray]:
    """For each fragment, whether the string of ``length`` bytes at each of its places is also at
    another place of the shard; all are if ``many`` says that the fragment itself occurs again."""
    order, lcps = fragment_order(fragments, limit, base)
    near = lcps >= length
    near[:-1] |= near[1:]
    where = np.zeros(len(order), bool)
    where[order[near]] = True
    out, at = [], 0
    for f, again in zip(fragments, many, strict=True):
        windows = max(0, len(f) - length + 1)
        out.append(np.ones(windows, bool) if again else where[at : at + windows])
        at += len(f) + 1
    return out
