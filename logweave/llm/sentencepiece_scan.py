"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is cut into the pieces of a public vocabulary whose scores add up to the most; ties go to
fewer pieces, then to the longest first piece in which they differ. Giant texts are split into chunks. Between
two chunks the state is how many letters of the second the piece that crosses them takes. A chunk
gives a transfer matrix: for each state before and after it, the best weight in between. Matrices
combine associatively in (max, +): neighbours are multiplied in groups of ``FAN``, level by level, until a text
has one; going down again, every chunk learns the weight of all that follows it for each state behind it. With
that, a chunk knows the state it leaves in for each state it is entered in; these maps are composed by the
same groups and levels, which gives the states on the best path, and each chunk traces its own pieces
back, knowing only its two states. Chunk size changes no id.

No piece holds a space after another letter, so a space that follows a letter always starts a piece:
between two such places a chunk is a row of independent words, each solved once a task, and only
the ends of a chunk need the matrix in full.

Spaces stand as U+2581 in the vocabulary; a letter without a piece, and U+2581 itself, goes as its
UTF-8 bytes, each a byte piece. So decoding gives back every text exactly. No space is added in front.

Defined results: a null text counts as empty; an empty text has no piece; equal texts have equal
ids; an empty table gives an empty result; a null id is kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import configure, fields, map_rows, sha, stored
from .vocabulary import Vocabulary, by_length

SPACE = "▁"
#: Letters of a chunk; texts up to this length are one chunk.
CHUNK = 20_000
#: Matrices, or maps, of one group of the scan.
FAN = 64
#: Words up to this length are solved many at once.
PART = 48
#: Words kept by a task with their pieces; then it starts anew, which changes no result.
CACHE = 1_000_000
_WORDS = re.compile(r" *[^ ]+| +")
#: A weight is a score in 64ths times COUNT, less one for each piece; weights add up in 64 bits for
#: chunks of a million letters, and matrices are scaled to a largest entry of 0.
COUNT = 1 << 20
NEVER = -(1 << 61)


class Pieces:
    """The pieces of a model, their ids and integer weights."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        self.weights: dict[str, tuple[int, int]] = {}
        self.bytes, self.text = {}, {}
        # scores that only mark a piece as never merged count as just below all others
        worst = min(x for i in range(p.get_piece_size()) if (x := p.get_score(i)) > -1e8) - 1
        worst = round(worst * 64)
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                self.weights[piece.replace(SPACE, " ")] = (max(worst, round(p.get_score(i) * 64)) * COUNT - 1, i)
                self.text[i] = piece.replace(SPACE, " ").encode()
        self.longest = max(map(len, self.weights))
        self.unknown = (worst - 640) * COUNT - 1  # for each byte
        assert not any(" " in x.lstrip(" ") for x in self.weights), "a piece holds a space after another letter"

    def unit(self, letter: str) -> tuple[int, list[int]]:
        data = letter.encode("utf-8", "surrogatepass")
        return len(data) * self.unknown, [self.bytes[b] for b in data]

    def ids(self, piece: str) -> list[int]:
        found = self.weights.get(piece)
        return [found[1]] if found else self.unit(piece)[1]

    def ahead(self, text: str, size: int, ends: list) -> tuple[list, list[int]]:
        """From each of the first ``size`` letters on, the best weight to the end and the length of the
        first piece. ``ends`` has the weight (a number, or a row of numbers) of each place from ``size`` on."""
        best, step = [None] * size + ends, [0] * size
        for i in range(size - 1, -1, -1):
            for n in range(1, min(len(best) - 1 - i, self.longest) + 1):
                if found := self.weights.get(text[i : i + n]):
                    x = best[i + n] + found[0]
                elif n == 1:
                    x = best[i + 1] + self.unit(text[i])[0]
                else:
                    continue
                if isinstance(x, np.ndarray):
                    best[i] = x if best[i] is None else np.maximum(best[i], x)
                elif best[i] is None or x >= best[i]:  # of equal ones the longest
                    best[i], step[i] = x, n
        return best, step

    def trace(self, text: str, step: list[int], at: int = 0) -> tuple[list[int], int]:
        """Ids of the pieces from ``at`` on, and the place behind the last of them."""
        out = []
        while at < len(step):
            out += self.ids(text[at : at + step[at]])
            at += step[at]
        return out, at


@lru_cache(4)
def pieces(model: str) -> Pieces:
    return Pieces(model)


class Words(dict):
    """Ids of words, as 32-bit little-endian bytes; each is solved once a task."""

    def __init__(self, p: Pieces) -> None:
        self.p, order = p, sorted(p.weights)
        self.voc = Vocabulary(order)
        self.weight = np.array([p.weights[x][0] for x in order] + [NEVER, NEVER], np.int64)
        self.ids = np.array([p.weights[x][1] for x in order] + [0, 0], "<u4")

    def solve(self, split: list[list[str]]) -> None:
        new = [w for w in set().union(*split) if w not in self]
        if len(self) + len(new) > CACHE:
            self.clear()
            new = list(set().union(*split))
        plain = [w for w in new if len(w) <= PART and all(c in self.p.weights for c in w)]
        for n, found in by_length(plain):
            for k in range(0, len(found), 50_000):
                self.together(found[k : k + 50_000], n)
        for w in new:
            if w not in self:
                self[w] = packed(self.p.trace(w, self.p.ahead(w, len(w), [0])[1])[0])

    def together(self, found: list[str], n: int) -> None:
        """Best pieces of words of n letters, each letter a piece."""
        m = len(found)
        best = np.full((n + 1, m), NEVER)
        best[n] = 0
        step, piece = np.zeros((n, m), np.int8), np.zeros((n, m), np.int32)
        for i, spans in self.voc.starting(found, n, backwards=True):
            for size, ids in spans:
                x = np.maximum(best[i + size] + self.weight[ids], NEVER)
                better = (x >= best[i]) & (ids < self.voc.size)
                np.copyto(best[i], x, where=better)
                np.copyto(step[i], np.int8(size), where=better)
                np.copyto(piece[i], ids, where=better)
        out, at, count, going = np.zeros((m, n), "<u4"), np.zeros(m, np.int64), np.zeros(m, np.int64), np.arange(m)
        while going.size:
            out[going, count[going]] = self.ids[piece[at[going], going]]
            at[going] += step[at[going], going]
            count[going] += 1
            going = going[at[going] < n]
        # a word's ids are the first ``count`` of its row
        data = out.tobytes()
        for row, (w, c) in enumerate(zip(found, count.tolist(), strict=True)):
            self[w] = data[4 * row * n : 4 * (row * n + c)]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [_WORDS.findall(t) for t in texts]
        self.solve(split)
        return [b"".join(map(self.__getitem__, own)) for own in split]


def packed(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


def cut_places(text: str, size: int, longest: int) -> tuple[int, int] | None:
    """The first and last place within ``text[:size]`` where a piece is sure to start, the first of
    them past every state before the chunk; None if there are no two such places."""
    first = next((m.end() - 1 for m in re.compile(r"[^ ] ").finditer(text, max(0, longest - 1), size)), None)
    last = text.rfind(" ", 0, size)
    while last > 0 and text[last - 1] == " ":
        last -= 1
    return (first, last) if first is not None and last > first else None


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two matrices, or a matrix and a column, in (max, +), scaled to a largest entry of 0."""
    c = (a[:, :, None] + b[None, :, :]).max(axis=1)
    return np.where(c <= NEVER // 2, NEVER, c - c.max())


def matrix(p: Pieces, text: str, size: int, last: bool) -> tuple[np.ndarray, str]:
    """The transfer matrix of a chunk of ``size`` letters, whose ``text`` goes on for longest - 1 more,
    and what of the text decides on the state it leaves in."""
    states = p.longest
    rows = np.full((states, states), NEVER)
    np.fill_diagonal(rows, 0)
    ends = list(rows[:1] if last else rows)[: len(text) - size + 1]
    found = cut_places(text, size, p.longest)
    if found is None:
        best = p.ahead(text, size, ends)[0]
        m = np.array([best[s] if s < len(best) else np.full(states, NEVER) for s in range(states)])
        tail = text
    else:
        a, b = found
        # what lies between a and b is on every path: it adds the same to each entry and is left out
        after = p.ahead(text[b:], size - b, ends)[0][0]
        m = np.array(p.ahead(text[:a], a, [0])[0][:states])[:, None] + after
        tail = text[b:]
    return np.where(m <= NEVER // 2, NEVER, m - m.max()), tail


def leaves(p: Pieces, tail: str, size: int, longest_text: bool, behind: np.ndarray) -> np.ndarray:
    """The state that a chunk leaves in, for each state it is entered in. ``tail`` are the last
    letters of the chunk, ``size`` of them its own, and ``behind`` the weights of what follows."""
    ends = behind.tolist()[: len(tail) - size + 1]
    step = p.ahead(tail, size, ends)[1]
    if not longest_text:  # from a sure place on
        return np.full(p.longest, p.trace(tail, step)[1] - size, np.int32)
    return np.array([max(0, p.trace(tail, step, s)[1] - size) for s in range(p.longest)], np.int32)


def traced(p: Pieces, text: str, size: int, enter: int, leave: int) -> tuple[bytes, str, bytes]:
    """Pieces of a chunk that start in it, between two known states: ids up to the first sure place,
    the whole words up to the last one, and ids after it."""
    if enter >= size + leave:
        return b"", "", b""
    ends = [NEVER] * leave + [0]
    found = cut_places(text, size, p.longest)
    if found is None:
        return packed(p.trace(text, p.ahead(text, size, ends)[1], enter)[0]), "", b""
    a, b = found
    head = packed(p.trace(text, p.ahead(text[:a], a, [0])[1], enter)[0])
    return head, text[a:b], packed(p.trace(text[b:], p.ahead(text[b:], size - b, ends)[1])[0])


def _array(data: bytes, kind, *shape: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(shape)


def scan(parts: DataFrame, combine: Callable, begin: bytes, onward: Callable, reverse: bool, levels: int, name: str) -> DataFrame:
    """(uid, chunk, part, state) for rows (uid, chunk, part): the state that all parts before a chunk (or behind
    it, in ``reverse``) give.

    ``combine`` makes one part of a list of neighbours, ``onward`` a state of a state and a part. Groups of FAN
    neighbours become one part, ``levels`` times; then the states go down by the same groups.
    """
    up = [parts]
    for level in range(levels):
        own = fields(uid=BinaryType(), chunk=LongType(), part=BinaryType())
        listed = up[-1].groupBy("uid", F.floor(F.col("chunk") / FAN).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("chunk", "part"))).alias("own"))

        def make():
            return lambda uids, chunks, lists: {"uid": uids, "chunk": chunks, "part": [combine([c["part"] for c in own]) for own in lists]}

        up.append(stored(map_rows(listed, make, own), f"{name}_up{level}"))
    states = up[-1].select("uid", "chunk", F.lit(begin).alias("state"))
    step = fields(uid=BinaryType(), chunk=LongType(), state=BinaryType())

    def down():
        def work(uids, states, lists):
            out = {k: [] for k in step.names}
            for uid, state, own in zip(uids, states, lists, strict=True):
                for c in reversed(own) if reverse else own:
                    for k, v in zip(step.names, (uid, c["chunk"], state), strict=True):
                        out[k].append(v)
                    state = onward(state, c["part"])
            return out

        return work

    for level in range(levels - 1, -1, -1):
        # FAN parts at most
        listed = up[level].withColumn("over", F.floor(F.col("chunk") / FAN)).groupBy("uid", "over").agg(F.array_sort(F.collect_list(F.struct("chunk", "part"))).alias("own"))
        met = listed.join(states.withColumnRenamed("chunk", "over"), ["uid", "over"]).select("uid", "state", "own")
        states = stored(map_rows(met, down, step), f"{name}_down{level}")
    return states


CODED = fields(uid=BinaryType(), chunk=LongType(), ids=BinaryType())


def encode_giants(giant: DataFrame, model: str, chunk: int) -> DataFrame:
    """Rows of CODED: a row for each chunk of each text of ``giant(uid, text)``, whose uids differ."""
    if not pieces(model).longest <= chunk <= 100_000:
        raise ValueError("a chunk has 100,000 letters at most, and as many as the longest piece at least")
    width = pieces(model).longest
    fan = fields(uid=BinaryType(), n=LongType(), chunk=LongType(), text=StringType())

    def split():
        def work(uids, texts):
            out = {k: [] for k in fan.names}
            for uid, t in zip(uids, texts, strict=True):
                for k in range(0, len(t), chunk):
                    for name, v in zip(fan.names, (uid, -(-len(t) // chunk), k // chunk, t[k : k + chunk + width - 1]), strict=True):
                        out[name].append(v)
            return out

        return work

    chunks = stored(map_rows(giant.select("uid", "text"), split, fan), "giants")
    levels, most = 1, chunks.agg(F.max("n")).first()[0] or 1
    while FAN**levels < most:
        levels += 1
    first = fields(uid=BinaryType(), chunk=LongType(), part=BinaryType(), tail=StringType(), size=IntegerType(), whole=StringType())

    def matrices():
        p = pieces(model)

        def work(uids, ns, ks, texts):
            out = {k: [] for k in first.names}
            for uid, n, k, t in zip(uids, ns, ks, texts, strict=True):
                size = min(chunk, len(t))
                m, tail = matrix(p, t, size, k == n - 1)
                for name, v in zip(first.names, (uid, k, m.tobytes(), tail, size - len(t) + len(tail), "y" if tail is t else None), strict=True):
                    out[name].append(v)
            return out

        return work

    made = stored(map_rows(chunks.select("uid", "n", "chunk", "text"), matrices, first), "matrices")
    vector = np.full((width, 1), NEVER)
    vector[0] = 0

    def multiplied(parts: list[bytes]) -> bytes:
        out = _array(parts[0], np.int64, width, width)
        for m in parts[1:]:
            out = product(out, _array(m, np.int64, width, width))
        return out.tobytes()

    def times(state: bytes, part: bytes) -> bytes:
        return product(_array(part, np.int64, width, width), _array(state, np.int64, width, 1)).tobytes()

    behind = scan(made.select("uid", "chunk", "part"), multiplied, vector.tobytes(), times, True, levels, "behind")
    leaving = fields(uid=BinaryType(), chunk=LongType(), part=BinaryType())

    def leave():
        p = pieces(model)

        def work(uids, ks, tails, sizes, wholes, states):
            return {"uid": uids, "chunk": ks, "part": [leaves(p, t, n, w is not None, np.frombuffer(v, np.int64)).tobytes() for t, n, w, v in zip(tails, sizes, wholes, states, strict=True)]}

        return work

    maps = stored(map_rows(made.drop("part").join(behind, ["uid", "chunk"]).select("uid", "chunk", "tail", "size", "whole", "state"), leave, leaving), "maps")

    def composed(parts: list[bytes]) -> bytes:
        out = np.arange(width, dtype=np.int32)
        for f in parts:
            out = np.frombuffer(f, np.int32)[out]
        return out.tobytes()

    def applied(state: bytes, part: bytes) -> bytes:
        return np.frombuffer(part, np.int32)[np.frombuffer(state, np.int32)].tobytes()

    enters = scan(maps, composed, np.zeros(1, np.int32).tobytes(), applied, False, levels, "enters")
    path = enters.join(maps, ["uid", "chunk"])

    def tracing():
        p = pieces(model)
        words = Words(p)

        def work(uids, ks, texts, states, parts):
            ends = []
            for t, s, f in zip(texts, states, parts, strict=True):
                enter = int(np.frombuffer(s, np.int32)[0])
                ends.append(traced(p, t, min(chunk, len(t)), enter, int(np.frombuffer(f, np.int32)[enter])))
            # the words of all chunks of a batch are solved together
            heads, middles, tails = zip(*ends, strict=True)
            return {"uid": uids, "chunk": ks, "ids": [a + m + b for a, m, b in zip(heads, words.encode(list(middles)), tails, strict=True)]}

        return work

    return map_rows(chunks.select("uid", "chunk", "text").join(path, ["uid", "chunk"]).select("uid", "chunk", "text", "state", "part"), tracing, CODED)


def _split(docs: DataFrame, key: str, text: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Short rows, and giant ones with the SHA-256 of their text as ``uid``."""
    configure(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    giant = rows.where(F.length("text") > chunk).withColumn("uid", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    return rows.where(F.length("text") <= chunk), giant


def _shorts(short: DataFrame, model: str, extra: StructType, make: Callable) -> DataFrame:
    """(doc_id, and what ``make()`` gives for ids) for texts of one chunk."""
    schema = StructType([short.schema["doc_id"], *extra.fields])

    def both():
        words, more = Words(pieces(model)), make()
        return lambda ids, texts: {"doc_id": ids} | more(words.encode(texts))

    return map_rows(short, both, schema)


def encode_texts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, uid, chunk, ids): a row for each chunk of each text, its ids 32-bit and little-endian. ``uid`` is
    the SHA-256 of a text of several chunks, else null; equal rows have equal rows."""
    short, giant = _split(docs, key, text, chunk)
    one = _shorts(short, model, fields(ids=BinaryType()), lambda: lambda ids: {"ids": ids})
    many = giant.select("doc_id", "uid").join(encode_giants(giant.select("uid", "text").dropDuplicates(["uid"]), model, chunk), "uid")
    return one.select("doc_id", F.lit(None).cast("binary").alias("uid"), F.lit(0).cast("long").alias("chunk"), "ids").unionByName(many.select("doc_id", "uid", "chunk", "ids"))


def decode(model: str, data: bytes) -> bytes:
    """The UTF-8 text of ids."""
    text = pieces(model).text
    return b"".join([text[int.from_bytes(data[k : k + 4], "little")] for k in range(0, len(data), 4)])


def decoder(model: str):
    """The same, by a table: ids become pieces in one pass."""
    text = pieces(model).text
    table = [text.get(i, b"") for i in range(max(text) + 1)]
    return lambda data: b"".join([table[i] for i in np.frombuffer(data, "<u4").tolist()])


RESULT = fields(n_pieces=LongType(), ids_crc32=LongType(), n_bytes=LongType(), text_sha256=StringType())


def encode_and_decode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """For each row: number and CRC-32 of its ids, and size and SHA-256 of the text decoded from them."""
    short, giant = _split(docs, key, text, chunk)

    def digests():
        back = decoder(model)

        def work(ids):
            texts = [back(x) for x in ids]
            return {"n_pieces": [len(x) // 4 for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids], "n_bytes": [len(t) for t in texts], "text_sha256": [sha(t) for t in texts]}

        return work

    one = _shorts(short, model, RESULT, digests)
    # the chunks of one text; texts that are equal are coded once
    coded = encode_giants(giant.select("uid", "text").dropDuplicates(["uid"]), model, chunk)
    listed = coded.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("own"))

    def joined():
        work = digests()
        return lambda uids, lists: {"uid": uids} | work([b"".join([c["ids"] for c in own]) for own in lists])

    many = map_rows(listed, joined, StructType([StructField("uid", BinaryType()), *RESULT.fields]))
    return one.unionByName(giant.select("doc_id", "uid").join(many, "uid").select("doc_id", *RESULT.names))
