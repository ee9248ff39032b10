"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on whole shingle sets.

Equal sets are one from the start. Every set enters ``TREES`` trees. A tree has its own sequence of
minima, and a row's key is their ordered values, a byte each; a tree's rows are sorted by key, and what
two neighbours have in common is the longest common prefix of their keys. Rows whose prefix is at least
``DEPTH`` values long are a region; two sets of similarity 0.8 miss each other in all trees with
probability under 1e-5. A region is read row by row: a set that no leader covers becomes a leader, and
every set is tied to the leaders it is like enough to, by ``BITS`` further bits of the signature. Two similar
sets are both near enough to the leader that covers the first of them to be tied to it (the distance is a
metric). While a region holds more than ``MANY`` leaders, its depth grows by a value, and its leaders last as
long as the longer prefix does; so regions that very many unlike sets share fall apart, and regions of true copies, which
need few leaders, stay whole. At ``DEEPEST`` values two sets of similarity 0.8 that are in such regions in all trees
miss each other with probability 6e-4.

Areas, the components of these ties, hold every possible link. First each set is compared exactly (shingles by 64-bit
hashes of their words) with the one leader it looks most like in the first ``EARLY`` trees: a row for each set, and a leader of very many is copied
to as many groups as they fill. What these links connect are clusters; an area of one cluster is done, and sets of one cluster are
never compared again. Of the other areas the sets of unlike clusters meet in blocks of bounded size: a cluster that fills blocks of its own
meets the other blocks only, so a large group of copies costs its size times the number of blocks of strangers that were tied to it.
Every pair of sets not yet known to be connected is compared there. Only links that connect are
returned, one less than sets at most, never all pairs.

Defined results: a null text, or one without words, has no shingle and links with nothing; fewer
words than a shingle's are one shingle; equal texts link; rows that share an id are one document; a
row without id, or whose id is no whole number, is its own component, with null as its number; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType

from .common import configure, fields, map_rows, stored
from .components import components

#: Trees, values a region shares at least and at most, and bits of a sketch.
TREES, DEPTH, DEEPEST, BITS = 40, 6, 8, 256
#: Leaders of a region from which it is deepened.
MANY = 256
#: Sets and bytes of one block, about; two blocks meet in a task.
BLOCK, BLOCK_BYTES = 2048, 32_000_000
#: Estimated similarity from which a leader covers a set, and from which it is tied to it:
#: 0.25 and 0.27 (more than four standard errors) beyond what the metric needs.
COVERS, TIES = 0.80, 0.30
#: Trees whose leaders are compared with early, and the estimated similarity from which they are.
EARLY, CLOSE = 12, 0.70
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.random.default_rng(20_240_601).integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


class Hashes(dict):
    """64-bit hashes of words; forgets them all when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 2_000_000:
            self.clear()
        own = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return own


def shingles(text: str | None, width: int, hashes: Hashes) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), np.uint64)
    for k in range(min(width, len(h))):
        out = mix(out * _A + h[k : k + n])
    return np.unique(out)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (DEEPEST bytes for each tree) and sketches (BITS bits) of sets, none of them empty.

    A tree's sequence is its own DEPTH minima, then the first ones of the next tree.
    """
    starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]].astype(np.int64)
    every = np.concatenate(sets)
    least = np.empty((len(sets), TREES * DEPTH), np.uint64)
    for k, odd in enumerate(_ODD):
        least[:, k] = np.minimum.reduceat(every * odd, starts)
    least = mix(least)
    values = (least >> np.uint64(8)).astype(np.uint8)
    order = (np.arange(TREES)[:, None] * DEPTH + np.arange(DEEPEST)) % (TREES * DEPTH)
    bits = (least & np.uint64(1)).astype(bool)
    more = (least[:, : BITS - bits.shape[1]] >> np.uint64(1) & np.uint64(1)).astype(bool) if bits.shape[1] < BITS else bits[:, :0]
    return values[:, order], np.packbits(np.hstack([bits[:, :BITS], more]), axis=1)


def likeness(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarity of a sketch with each of many."""
    apart = np.bitwise_count(np.bitwise_xor(many, one)).sum(axis=1, dtype=np.int64)
    return 1 - 2 * apart / BITS


class Region:
    """Leaders of a region, and ties to them; ``give`` takes two ids. ``close`` takes ids, the leaders that they look most
    like, and how much, of those that look like one enough.

    Areas only ask what ties connect, so ties between sets that are connected already are
    left out: a region of n sets gives n - 1 at most. Held are the leaders, never the region.
    """

    def __init__(self, give, many: int, close=None) -> None:
        self.give, self.many, self.depth, self.close = give, many, DEPTH, close
        self.start()

    def start(self) -> None:
        self.ids, self.sketches, self.label, self.prefix = [], [], [], None

    def add(self, keys: np.ndarray, ids: np.ndarray, sketches: np.ndarray) -> None:
        """Rows in order; all share the first DEPTH values."""
        at = 0
        while at < len(ids):
            if (own := keys[at, : self.depth].tobytes()) != self.prefix:
                self.start()
                self.prefix = own
            other = np.any(keys[at : at + 2048, : self.depth] != keys[at, : self.depth], axis=1)
            end = at + int(other.argmax() if other.any() else len(other))
            self.tie(ids[at:end], sketches[at:end])
            if len(self.ids) > self.many and self.depth < DEEPEST:
                self.depth += 1
                self.prefix = keys[end - 1, : self.depth].tobytes()
            at = end

    def tie(self, ids: np.ndarray, sketches: np.ndarray) -> None:
        left, first = np.ones(len(ids), bool), np.full(len(ids), -1)
        most, like = np.full(len(ids), CLOSE), np.full(len(ids), -1)

        def meet(leader: int, since: int) -> None:
            near = likeness(self.sketches[leader], sketches[since:])
            left[since:] &= near < COVERS
            more = np.flatnonzero((near >= most[since:]) & (ids[since:] != self.ids[leader])) + since
            most[more], like[more] = near[more - since], leader
            tied = np.flatnonzero((near >= TIES) & (ids[since:] != self.ids[leader])) + since
            new = tied[first[tied] < 0]
            for k in new.tolist():
                self.give(int(ids[k]), self.ids[leader])
            first[new] = leader
            # a set tied to two leaders connects them
            for other in set(first[tied].tolist()):
                if self.label[other] != self.label[leader]:
                    self.give(self.ids[other], self.ids[leader])
                    old = self.label[other]
                    self.label = [self.label[leader] if x == old else x for x in self.label]

        for leader in range(len(self.ids)):
            meet(leader, 0)
        for k in range(len(ids)):
            if left[k]:
                mine = len(self.ids)
                self.ids.append(int(ids[k]))
                self.sketches.append(sketches[k])
                self.label.append(mine)
                if first[k] >= 0:  # tied to an earlier one
                    self.label[mine] = self.label[first[k]]
                first[k] = mine
                meet(mine, k)
        if self.close is not None and len(own := np.flatnonzero(like >= 0)):
            self.close(ids[own], np.array(self.ids, np.int64)[like[own]], most[own])


def regions(batches: Iterator[pa.RecordBatch], many: int = MANY, looks: bool = False) -> Iterator[pa.RecordBatch]:
    """Ties (u, v), which say what an area is, from rows (tree, key, id, sketch) that come sorted by tree and key. With ``looks``,
    rows (u, v, near): ``near`` is null for ties, else the estimated similarity of a set, ``u``, and a leader."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("near", pa.float32())])
    us, vs, likes = [], [], []

    def give(u: int, v: int) -> None:
        us.append(u)
        vs.append(v)

    def taken() -> pa.RecordBatch:
        ties = [pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.nulls(len(us), pa.float32())]
        for columns in likes:
            ties = [pa.concat_arrays([t, pa.array(c, f.type)]) for t, c, f in zip(ties, columns, schema, strict=True)]
        for x in (us, vs, likes):
            x.clear()
        found = pa.RecordBatch.from_arrays(ties, schema=schema)
        return found if looks else found.select(["u", "v"])

    going, last = None, None  # the region at the end of the batch before, and its first values
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, DEEPEST)
        trees = b.column(0).to_numpy(zero_copy_only=False)
        ids = b.column(2).to_numpy(zero_copy_only=False)
        sketches = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, BITS // 8)
        cuts = np.flatnonzero(np.any(keys[1:, :DEPTH] != keys[:-1, :DEPTH], axis=1) | (trees[1:] != trees[:-1])) + 1
        bounds = np.r_[0, cuts, len(ids)]
        sizes = np.diff(bounds)
        # single rows are no region, but for the first and the last, which may go on
        for r in sorted({0, len(sizes) - 1, *np.flatnonzero(sizes > 1).tolist()}):
            x, y = int(bounds[r]), int(bounds[r + 1])
            own = (int(trees[x]), keys[x, :DEPTH].tobytes())
            if own != last:
                going, last = Region(give, many, (lambda *x: likes.append(x)) if looks and own[0] < EARLY else None), own
            going.add(keys[x:y], ids[x:y], sketches[x:y])
        yield taken()


def linked(ids: list[int], sets: list[np.ndarray], side: list[int], percent: int, clusters: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what all pairs with ``100 * both >= percent * either`` connect.

    ``side`` is 0 or 1 for the two blocks that meet, or 2 for a block with itself; sets of one of ``clusters`` are
    connected already.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    label = np.arange(n) if clusters is None else np.unique(clusters, return_inverse=True)[1]
    sides = np.array(side)
    starts = np.r_[0, np.cumsum(sizes)]
    words, every = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.zeros(len(words), bool)
    out = []
    for k in range(n):
        # pairs with earlier sets are done
        rest = np.arange(k + 1, n)
        rest = rest[(label[rest] != label[k]) & ((sides[rest] != sides[k]) | (sides[k] == 2))]
        rest = rest[(100 * np.minimum(sizes[rest], sizes[k]) >= percent * np.maximum(sizes[rest], sizes[k]))]
        if not len(rest):
            continue
        own[every[starts[k] : starts[k + 1]]] = True
        where = np.concatenate([every[starts[r] : starts[r + 1]] for r in rest])
        both = np.add.reduceat(own[where].astype(np.int64), np.r_[0, np.cumsum(sizes[rest])[:-1]])
        own[every[starts[k] : starts[k + 1]]] = False
        for r in rest[100 * both >= percent * (sizes[rest] + sizes[k] - both)]:
            if label[r] != label[k]:
                label[label == label[r]] = label[k]
                out.append((ids[k], ids[r]))
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row."""
    spark = configure(docs.sparkSession)
    rows = docs.select(F.col(key).try_cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    first = fields(doc_id=LongType(), n_shingles=LongType(), set=BinaryType(), keys=BinaryType(), sketch=BinaryType())

    def make():
        hashes = Hashes()

        def work(ids, texts):
            sets = [shingles(t, width, hashes) for t in texts]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            # equal sets of a batch need one signature
            at = {d: k for k, d in reversed(list(enumerate(digests))) if d and ids[k] is not None}
            chosen = sorted(at.values())
            keys, sketches = signatures([sets[k] for k in chosen]) if chosen else ([], [])
            by = {k: (a.tobytes(), b.tobytes()) for k, a, b in zip(chosen, keys, sketches, strict=True)}
            return {"doc_id": ids, "n_shingles": list(map(len, sets)), "set": digests, "keys": [by.get(k, (None, None))[0] for k in range(len(ids))], "sketch": [by.get(k, (None, None))[1] for k in range(len(ids))]}

        return work

    signed = stored(map_rows(rows, make, first), "signatures")
    reps = stored(signed.where("set is not null and doc_id is not null").groupBy("set").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")), "sets")
    # one signature for each set: rows of other batches repeat it
    one = signed.where("keys is not null").select("set", "keys", "sketch").join(reps.drop("n"), "set").dropDuplicates(["rep", "set"])
    tree = fields(tree=IntegerType(), key=BinaryType(), id=LongType(), sketch=BinaryType())

    def spread():
        def work(ids, keys, sketches):
            own = [k[t : t + DEEPEST] for k in keys for t in range(0, TREES * DEEPEST, DEEPEST)]
            return {"tree": np.tile(np.arange(TREES, dtype=np.int32), len(ids)), "key": own, "id": np.repeat(np.array(ids, np.int64), TREES), "sketch": [s for s in sketches for _ in range(TREES)]}

        return work

    forest = map_rows(one.select("rep", "keys", "sketch"), spread, tree)
    # a region's rows meet in one task, in order
    ordered = forest.repartition("tree", F.substring("key", 1, DEPTH)).sortWithinPartitions("tree", "key")
    ties = stored(ordered.mapInArrow(partial(regions, many=MANY, looks=True), "u long, v long, near float").groupBy("u", "v").agg(F.max("near").alias("near")), "ties")
    areas = stored(components(ties.select("u", "v"), "areas"), "area_members").withColumnRenamed("node", "rep").withColumnRenamed("component", "area")
    links = fields(u=LongType(), v=LongType())

    # a document's own text stands for its set: of rows that share an id, all do
    whole = rows.where("doc_id is not null").join(areas.select("rep"), rows["doc_id"] == F.col("rep")).select("rep", "text")
    packed = fields(rep=LongType(), members=BinaryType())

    def sets_of():
        hashes = Hashes()
        return lambda ids, texts: {"rep": ids, "members": [shingles(t, width, hashes).tobytes() for t in texts]}

    sizes = reps.groupBy("rep").agg(F.sum("n").alias("n"))
    filled = lambda count, n: F.greatest(F.ceil(count / block), F.ceil(n * 8 / BLOCK_BYTES), F.lit(1)).cast("int")

    # early links: each set and the leader it looks most like; a leader goes to every group of its sets
    like = ties.where("near is not null").groupBy(F.col("u").alias("rep")).agg(F.max_by("v", F.struct("near", -F.col("v"))).alias("leader"))
    like = stored(like, "most_like")
    groups_of = like.join(sizes, "rep").groupBy("leader").agg(F.count("*").alias("count"), F.sum("n").alias("n")).select("leader", filled(F.col("count"), F.col("n")).alias("groups"))
    led = like.join(groups_of, "leader").select("rep", "leader", F.pmod(F.xxhash64("rep"), F.col("groups")).cast("int").alias("part"), F.lit(0).alias("side"))
    leaders = groups_of.select(F.col("leader").alias("rep"), "leader", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(1).alias("side"))

    def compare(table: pa.Table) -> pa.Table:
        ids, data, side = (table.column(c).to_pylist() for c in ("rep", "members", "side"))
        of = [np.frombuffer(d, np.uint64) for k, d in enumerate(data) if side[k] == 1 and d]
        found = []
        for i, d, e in zip(ids, data, side, strict=True):
            if e == 0 and d:
                own = np.frombuffer(d, np.uint64)
                for lead in of:
                    both = len(np.intersect1d(own, lead, assume_unique=True)) if 100 * min(len(own), len(lead)) >= percent * max(len(own), len(lead)) else 0
                    if both and 100 * both >= percent * (len(own) + len(lead) - both):
                        found.append(i)
                        break
        return pa.table({"u": found, "v": [table.column("leader")[0].as_py()] * len(found)}, schema=to_arrow_schema(links))

    early = map_rows(whole, sets_of, packed).join(led.unionByName(leaders), "rep").groupBy("leader", "part").applyInArrow(compare, links)
    early = stored(early, "early_links")
    clusters = components(early, "clusters").select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    placed = areas.join(clusters, "rep", "left").select("rep", "area", F.coalesce("cluster", "rep").alias("cluster"))
    # areas of one cluster are done
    placed = stored(placed.join(placed.groupBy("area").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).where("lo < hi").select("area"), "area"), "unlike")

    # clusters that fill half a block or more have blocks of their own, the others of an area share blocks (of cluster -1)
    weighed = placed.join(sizes, "rep").groupBy("area", "cluster").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    large = (F.col("count") * 2 > block) | (F.col("n") * 16 > BLOCK_BYTES)
    weighed = weighed.withColumn("home", F.when(large, F.col("cluster")).otherwise(F.lit(-1)))
    homes = stored(weighed.groupBy("area", "home").agg(F.sum("count").alias("count"), F.sum("n").alias("n")).select("area", "home", filled(F.col("count"), F.col("n")).alias("blocks")), "homes")
    # a name for each block; there are as many as an area fills
    every = homes.groupBy("area").agg(F.collect_list(F.struct("home", "blocks")).alias("homes"))
    own_home = placed.join(weighed.where(large).select("area", "cluster", F.col("cluster").alias("home")), ["area", "cluster"], "left").withColumn("home", F.coalesce("home", F.lit(-1)))
    spots = own_home.join(homes, ["area", "home"]).withColumn("j", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("blocks").join(every, "area")
    meets = F.filter("homes", lambda h: (h["home"] != F.col("home")) | (h["home"] == -1))
    names = F.flatten(F.transform(meets, lambda h: F.transform(F.sequence(F.lit(0), h["blocks"] - 1), lambda j: F.concat_ws(":", h["home"], j))))
    spots = spots.withColumn("own", F.concat_ws(":", "home", "j")).withColumn("other", F.explode(names))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    spots = spots.select("rep", "area", "cluster", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), side.alias("side"))
    meeting = map_rows(whole.join(placed.select("rep").distinct(), "rep", "left_semi"), sets_of, packed).join(spots, "rep")

    def meet(table: pa.Table) -> pa.Table:
        ids, data, sides, own = (table.column(c).to_pylist() for c in ("rep", "members", "side", "cluster"))
        sound = [k for k in sorted(range(len(ids)), key=lambda k: (ids[k], data[k])) if data[k]]
        pick = lambda values: [values[k] for k in sound]
        found = linked(pick(ids), [np.frombuffer(data[k], np.uint64) for k in sound], pick(sides), percent, pick(own)) if len(sound) > 1 else []
        return pa.table({"u": [u for u, _ in found], "v": [v for _, v in found]}, schema=to_arrow_schema(links))

    confirmed = early.unionByName(meeting.groupBy("area", "a", "b").applyInArrow(meet, links))
    known = components(confirmed, "links").withColumnRenamed("node", "rep")
    # rows that share an id, and sets that share their first id, are tied by that id
    out = signed.select("doc_id", "n_shingles", "set").join(reps.drop("n"), "set", "left").join(known, "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))
