"""Best-fit packing with a grouping genetic algorithm on islands.

Documents become tokens, an end token, and pieces of at most ``capacity`` tokens: only longer
documents are cut, into full pieces after a first piece that holds the remainder. Full pieces
are sequences of their own; the others are dealt to lands, each a bounded set of pieces. A land has
``ISLES`` islands, each with a population of its own, and an island is a task. A chromosome is a grouping of the
land's pieces into bins. Crossover injects whole well-filled bins of one parent into the other, drops the bins that
hold a piece twice, and places the displaced pieces by best fit. After an epoch each island's best chromosome
migrates to the next island of its land, where crossover injects its bins. In the end the bins of a
land's best chromosome that are not full enough are opened, and their pieces evolve once more on lands of their own.

Token ids never leave the task that makes them: only lengths and checksums are shuffled.

Defined results: a null or empty text is the end token alone; equal rows are packed each on its
own; an empty table gives an empty result; a null id is packed like any other.
"""

from __future__ import annotations

import os
import random
import zlib
from array import array
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import configure, fields, map_rows, stored

CAPACITY, END_ID = 1024, 2
#: Pieces of one land, below 2 ** 16, so that lands follow the number of pieces; and islands of a land.
LAND, ISLES = 20_000, 3
#: Pieces times generations that an island spends in an epoch at least, and its largest population: a small land costs as
#: much as a full one, and evolves for longer.
EFFORT, CROWD = 160_000, 20
PIECES = dict(piece=IntegerType(), start=LongType(), length=LongType(), ids_crc32=LongType())


def encoder(tokenizer: str):
    """A function from a text to its ids as little-endian 32-bit bytes.

    The tokenizer's file decides. Where the rank file of the same vocabulary lies beside it,
    texts of everyday characters take that faster way, whose ids are the same; all others,
    and any text with the special token, take the tokenizer itself.
    """
    import numpy as np
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    whole = Tokenizer.from_file(tokenizer)

    def slow(text):
        return np.asarray(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    ranks_file = os.path.splitext(tokenizer)[0] + ".tiktoken"
    if not os.path.exists(ranks_file):
        return slow
    import base64
    import re

    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\u017f]*")

    def encode(text):
        if plain.fullmatch(text) and "<|" not in text:
            return np.asarray(fast.encode_ordinary(text), "<u4").tobytes()
        return slow(text)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))] if n > capacity else [(0, n)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece of each document; ``serial`` numbers the pieces of a task."""
    end = int(end_id).to_bytes(4, "little")
    chosen = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = StructType([StructField("doc_id", chosen.schema["doc_id"].dataType), *fields(serial=LongType(), **PIECES).fields])

    def make():
        encode, seen = encoder(tokenizer), [0]

        def work(ids, texts):
            out = {n: [] for n in schema.names}
            for i, t in zip(ids, texts, strict=True):
                data = encode(t) + end
                for k, (s, n) in enumerate(cut(len(data) // 4, capacity)):
                    seen[0] += 1
                    for name, v in zip(schema.names, (i, seen[0], k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)])), strict=True):
                        out[name].append(v)
            return out

        return work

    return map_rows(chosen, make, schema)


class Island:
    """Pieces of given sizes and groupings of them into bins, each bin a tuple of positions."""

    def __init__(self, sizes: list[int], capacity: int, seed: int) -> None:
        self.sizes, self.capacity, self.rng = sizes, capacity, random.Random(seed)

    def fill(self, group) -> int:
        return sum(self.sizes[i] for i in group)

    def best_fit(self, groups: list[list[int]], loose: list[int]) -> list[list[int]]:
        """Puts each loose piece, largest first, into the fullest bin that still takes it."""
        room = sorted((self.capacity - self.fill(g), k) for k, g in enumerate(groups))
        for i in sorted(loose, key=lambda i: (-self.sizes[i], i)):
            at = bisect_left(room, (self.sizes[i], -1))
            if at < len(room):
                left, k = room.pop(at)
            else:
                left, k = self.capacity, len(groups)
                groups.append([])
            groups[k].append(i)
            insort(room, (left - self.sizes[i], k))
        return groups

    def worth(self, groups) -> tuple[int, float]:
        """Fewer bins first; among as many, those with fuller bins."""
        return len(groups), -sum((self.fill(g) / self.capacity) ** 2 for g in groups)

    def first(self, jitter: float) -> list[list[int]]:
        order = {i: s * (1 - jitter * self.rng.random()) for i, s in enumerate(self.sizes)}
        groups: list[list[int]] = []
        room: list[tuple[int, int]] = []
        for i in sorted(order, key=lambda i: (-order[i], i)):
            at = bisect_left(room, (self.sizes[i], -1))
            left, k = room.pop(at) if at < len(room) else (self.capacity, len(groups))
            if k == len(groups):
                groups.append([])
            groups[k].append(i)
            insort(room, (left - self.sizes[i], k))
        return groups

    def cross(self, one, other) -> list[list[int]]:
        """``one`` with a run of ``other``'s fullest bins injected."""
        full = sorted((g for g in other if len(g) > 1), key=lambda g: (-self.fill(g), g[0]))[: max(1, len(other) // 2)]
        taken = self.rng.sample(full, max(1, len(full) // 4)) if full else []
        held = {i for g in taken for i in g}
        kept, loose = [], []
        for g in one:
            if held.isdisjoint(g):
                kept.append(list(g))
            else:
                loose += [i for i in g if i not in held]
        return self.best_fit(kept + [list(g) for g in taken], loose)

    def mutate(self, groups) -> list[list[int]]:
        """Opens the emptiest bins and some others, and places their pieces anew."""
        order = sorted(range(len(groups)), key=lambda k: self.fill(groups[k]))
        opened = set(order[: max(1, len(order) // 50)]) | set(self.rng.sample(order, max(1, len(order) // 100)))
        return self.best_fit([list(g) for k, g in enumerate(groups) if k not in opened], [i for k in opened for i in groups[k]])

    def evolve(self, herd: list, guest, population: int, generations: int) -> list[list[list[int]]]:
        """The population, best first, after some generations; it ends early at the lower bound, which
        nothing can beat. A ``guest`` takes the place of the last one, crossed with the best."""
        least = -(-sum(self.sizes) // self.capacity)
        herd = herd or [self.first(0.0)]
        if not self.sizes or len(herd[0]) <= least:
            return herd
        generations = max(generations, EFFORT // len(self.sizes))
        population = max(population, min(CROWD, generations // 10))
        herd += [self.first(0.2 * (k + 1) / population) for k in range(len(herd) - 1, population - 1)]
        ranked = sorted(((self.worth(h), h) for h in herd), key=lambda x: x[0])
        if guest is not None:
            ranked[-1] = min(((self.worth(h), h) for h in (guest, self.cross(ranked[0][1], guest))), key=lambda x: x[0])
        for _ in range(generations):
            ranked.sort(key=lambda x: x[0])
            if len(ranked[0][1]) <= least:
                break
            mother, father = self.rng.choice(ranked[: max(2, population // 2)])[1], self.rng.choice(ranked)[1]
            child = self.mutate(self.cross(mother, father))
            ranked[-1] = self.worth(child), child
        return [h for _, h in sorted(ranked, key=lambda x: x[0])]


def written(groups: list[list[int]]) -> bytes:
    """A chromosome as the bin of each piece."""
    out = array("i", [0]) * sum(map(len, groups))
    for k, g in enumerate(groups):
        for i in g:
            out[i] = k
    return out.tobytes()


def read(data: bytes) -> list[list[int]]:
    bins = array("i")
    bins.frombytes(data)
    out: list[list[int]] = [[] for _ in range(max(bins, default=-1) + 1)]
    for i, k in enumerate(bins):
        out[k].append(i)
    return out


ISLE = StructType([*fields(land=LongType(), isle=IntegerType(), items=BinaryType(), sizes=BinaryType()).fields, StructField("herd", ArrayType(BinaryType())), *fields(guest=BinaryType(), n_bins=LongType(), fullness=DoubleType()).fields])


def _landed(todo: DataFrame, lands: int, salt: int) -> DataFrame:
    """A row for each land of todo(item, size), about LAND pieces each."""
    schema = fields(land=LongType(), items=BinaryType(), sizes=BinaryType())

    def one(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("item").to_pylist(), table.column("size").to_pylist(), strict=True))
        items, sizes = array("q", [i for i, _ in rows]), array("i", [s for _, s in rows])
        return pa.table({"land": table.column("land").slice(0, 1), "items": [items.tobytes()], "sizes": [sizes.tobytes()]}, schema=to_arrow_schema(schema))

    return todo.withColumn("land", F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(max(1, lands)))).select("land", "item", "size").groupBy("land").applyInArrow(one, schema)


def evolved(todo: DataFrame, n: int, salt: int, capacity: int, land: int, isles: int, epochs: int, population: int, generations: int) -> DataFrame:
    """The best grouping that the islands find for todo(item, size) of ``n`` rows: (item, bin, filled)."""
    lands = max(1, -(-n // land))
    tasks = min(lands * isles, 20_000)
    now = _landed(todo, lands, salt).select("land", F.explode(F.sequence(F.lit(0), F.lit(isles - 1))).alias("isle"), "items", "sizes", F.array().cast("array<binary>").alias("herd"), F.lit(None).cast("binary").alias("guest"))
    for epoch in range(epochs):

        def make(epoch=epoch):
            def work(lands, isles, items, sizes, herds, guests):
                out = {n: [] for n in ISLE.names}
                for at, isle, i, s, herd, guest in zip(lands, isles, items, sizes, herds, guests, strict=True):
                    own = array("i")
                    own.frombytes(s)
                    world = Island(own.tolist(), capacity, ((salt * 8 + epoch) << 48) + at * 64 + isle)
                    found = world.evolve([read(h) for h in herd], read(guest) if guest is not None else None, population, generations)
                    n_bins, fullness = world.worth(found[0])
                    for name, v in zip(ISLE.names, (at, isle, i, s, [written(h) for h in found], None, n_bins, fullness), strict=True):
                        out[name].append(v)
                return out

            return work

        spread = now.select(*ISLE.names[:6]).repartition(tasks, "land", "isle")
        now = stored(map_rows(spread, make, ISLE), f"epoch{salt}_{epoch}")
        if epoch < epochs - 1:
            # the best of each island goes to the next one of its land
            elites = now.select("land", F.pmod(F.col("isle") + 1, F.lit(isles)).cast("int").alias("isle"), F.col("herd")[0].alias("guest"))
            now = now.drop("guest", "n_bins", "fullness").join(elites, ["land", "isle"])
    best = now.groupBy("land").agg(F.min_by(F.struct("items", "sizes", F.col("herd")[0].alias("groups")), F.struct("n_bins", "fullness", "isle")).alias("b"))
    schema = fields(item=LongType(), size=LongType(), bin=LongType(), filled=LongType())

    def opened():
        def work(lands, items, sizes, groups):
            out = {n: [] for n in schema.names}
            for at, i, s, g in zip(lands, items, sizes, groups, strict=True):
                ids, own = array("q"), array("i")
                ids.frombytes(i)
                own.frombytes(s)
                for k, group in enumerate(read(g)):
                    filled = sum(own[x] for x in group)
                    for x in group:
                        for n, v in zip(schema.names, (ids[x], own[x], ((salt << 40 | at) << 16) + k, filled), strict=True):
                            out[n].append(v)
            return out

        return work

    return map_rows(best.select("land", "b.items", "b.sizes", "b.groups"), opened, schema)


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text",
    land: int = LAND, isles: int = ISLES, epochs: int = 2, population: int = 3, generations: int = 8, full: float = 0.99,
) -> DataFrame:
    """A row for each piece: its document, number, start, length, checksum, sequence and offset.

    Elites migrate ``epochs - 1`` times. Bins filled to at least ``full`` then stay as they are; the pieces of
    all others evolve once more, so that lands leave no half-empty bins of their own.
    """
    spark = configure(docs.sparkSession)
    found = stored(pieces(docs, tokenizer, capacity, end_id, key, text).withColumn("item", F.shiftleft(F.spark_partition_id().cast("long"), 40) + F.col("serial")).drop("serial"), "pieces")
    partial = found.where(F.col("length") < capacity).select("item", F.col("length").alias("size"))
    first = stored(evolved(partial, partial.count(), 0, capacity, land, isles, epochs, population, generations), "bins")
    rest = first.where(F.col("filled") < full * capacity).select("item", "size")
    again = evolved(rest, rest.count(), 1, capacity, land, isles, epochs, population, generations)
    done = first.where(F.col("filled") >= full * capacity).unionByName(again)
    bins = found.join(done.select("item", "bin"), "item", "left").withColumn("bin", F.coalesce("bin", -F.col("item")))  # full pieces: numbers below 0
    member = F.struct(F.col("length"), F.col("item"), *(F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")))
    # a bin holds at most ``capacity`` pieces
    listed = bins.groupBy("bin").agg(F.sort_array(F.collect_list(member)).alias("members"))
    offsets = F.expr("transform(members, (m, i) -> named_struct('m', m, 'offset', aggregate(slice(members, 1, i), 0L, (a, x) -> a + x.length)))")
    out = listed.select(F.col("bin").alias("sequence_id"), F.explode(offsets).alias("e"))
    return out.select(*(F.col(f"e.m.{c}").alias(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), "sequence_id", F.col("e.offset").alias("offset"))
