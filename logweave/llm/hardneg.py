"""Hard negatives by coordinate pruning in buckets of vectors of like length.

Rows are sorted by length and dealt to buckets; a bucket holds its vectors, its largest length, and for each coordinate
the order of its rows by that coordinate. A query that needs a score of t or more passes a bucket over if even its largest length,
pointing the query's way, stays below t. Else its FOCUS largest coordinates say where each of a row's coordinates must lie: with the
rest of the row pointing the best way, q_f a + |q without f| sqrt(L^2 - a^2) >= t bounds a from both sides. The rows in
each range are one run of a sorted list; those in all runs are scored exactly. Where the narrowest run holds
most of the bucket, all its rows are scored in one product with the other such queries.

t is a query's k-th best score so far. A task goes through its buckets by falling length and takes the bounds along; the
index is searched in three rounds, of a 64th, an eighth and the rest of its buckets, and each starts with the best
scores of those before. So what is shuffled is at most k rows for each query and task, mostly far fewer. The first
search finds each anchor's positives; the second, for all of its positives at once, the best rows of another label in the window that each
positive's score opens. Anchors are broadcast in rounds of ROUND bytes at most.

Defined results: rows with a null id, label or vector, an empty vector, or a component that is null, not finite or 2^54 or more take
no part; labels are whole numbers; vectors meet those of their own length; rows with the anchor's id are its own and no positives; ties go to the
smaller id; repeated rows count each, and a repeated anchor row is an anchor of its own; a positive of negative score opens no window; an
empty table gives an empty result. Scores beyond 2^52 are added up in Python's integers; beyond 63 bits is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType

from .common import configure, fields, stored

SCALE = 256
#: Components of a bucket, and rows at most.
CELLS, ROWS = 2**19, 2**15
#: Coordinates of a query whose ranges are intersected, and the share of a bucket above which all of it is scored, as
#: the runs' shares together let expect.
FOCUS, WHOLE = 5, 0.2
#: Bytes of anchors that are broadcast at a time, and buckets of a task.
ROUND, BUCKETS = 16 * 2**20, 16
#: Parts of the index by 64ths of its buckets, in the order in which they are searched.
PARTS = ((0, 1), (1, 8), (8, 64))
SAFE = 2.0**52


def whole_numbers(vectors: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(vec_id, label, dims, size, v): components floor(256 x) and lengths of the rows that take part."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**54)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("e"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", sound))
    rows = rows.select("vec_id", "label", F.size("e").alias("dims"), F.transform("e", lambda x: F.floor(x * SCALE).cast("double")).alias("v"))
    return rows.withColumn("size", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


INDEX = fields(part=IntegerType(), dims=IntegerType(), size=DoubleType(), ids=BinaryType(), labels=BinaryType(), width=IntegerType(), vectors=BinaryType(), orders=BinaryType())


def build_index(rows: DataFrame) -> DataFrame:
    """A row for each bucket: up to CELLS components of vectors of one number of dimensions, longest first."""
    n = rows.agg(F.sum("dims").alias("n")).first().n or 0
    buckets = max(1, -(-n // CELLS))
    # rows of one length are told apart by their hash, so none of them is too many for a range
    order = (F.col("dims"), F.desc("size"), F.xxhash64("vec_id", "v"))
    dealt = rows.repartitionByRange(buckets, *order).sortWithinPartitions(*order).select("dims", "size", "vec_id", "label", "v", F.spark_partition_id().alias("at"))

    def one(dims: int, parts: list[tuple], number: int) -> dict:
        sizes, ids, labels, v = (np.concatenate(c) for c in zip(*parts, strict=True))
        width = next(w for w in (2, 4, 8) if np.abs(v).max() < 2.0 ** (8 * w - 1))
        orders = np.argsort(v, axis=0, kind="stable").T.astype("<u2")
        part = int(np.random.default_rng(number).integers(64))
        return {"part": part, "dims": dims, "size": float(sizes.max()), "ids": ids.tobytes(), "labels": labels.tobytes(), "width": width, "vectors": v.astype(f"<i{width}").tobytes(), "orders": orders.tobytes()}

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_dims, count, number = [], 0, 0, 0
        give = lambda: pa.RecordBatch.from_pylist([one(held_dims, held, number)], schema=ARROW)
        for b in batches:
            if not b.num_rows:
                continue
            number = number or (b.column("at")[0].as_py() + 1) * 1_000_003
            all_dims = b.column("dims").to_numpy()
            starts = np.flatnonzero(np.r_[True, all_dims[1:] != all_dims[:-1]])
            for start, end in zip(starts, np.r_[starts[1:], len(all_dims)], strict=True):
                dims, at = int(all_dims[start]), int(start)
                most = max(1, min(ROWS, CELLS // dims))
                while at < end:
                    if held and (dims != held_dims or count >= most):
                        yield give()
                        held, count, number = [], 0, number + 1
                    upto = int(min(end, at + most - count))
                    part = b.slice(at, upto - at)
                    v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                    held.append((part.column("size").to_numpy(), part.column("vec_id").to_numpy(), part.column("label").to_numpy(), v))
                    held_dims, count, at = dims, count + upto - at, upto
        if held:
            yield give()

    return dealt.mapInArrow(bucketed, INDEX)


ARROW = pa.schema([("part", pa.int32()), ("dims", pa.int32()), ("size", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("width", pa.int32()), ("vectors", pa.binary()), ("orders", pa.binary())])


class Bucket:
    def __init__(self, dims: int, size: float, ids: bytes, labels: bytes, width: int, vectors: bytes, orders: bytes):
        self.size, self.ids, self.labels = size, np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.v = np.frombuffer(vectors, f"<i{width}").reshape(-1, dims).astype(float)
        self.orders = np.frombuffer(orders, "<u2").reshape(dims, -1)

    def beyond(self, size: float, least: float) -> bool:
        """Whether no row can score ``least`` with a query of this length."""
        return least > size * self.size * (1 + 1e-9)

    def candidates(self, q: np.ndarray, size: float, least: float) -> np.ndarray | None:
        """Rows that may score ``least`` or more; None if ranges leave too many to tell them apart."""
        if least <= 0:
            return None
        runs = []
        for f in np.argsort(-np.abs(q), kind="stable")[:FOCUS]:
            low, high = feasible(q[f], size, self.size, least)
            order = self.orders[f]
            values = self.v[order, f]
            a, b = np.searchsorted(values, low), np.searchsorted(values, high, side="right")
            runs.append(order[a:b])
        if np.prod([len(run) / len(self.ids) for run in runs]) > WHOLE:
            return None
        hits = np.zeros(len(self.ids), np.uint8)
        for run in runs:
            hits[run] += 1
        return np.flatnonzero(hits == len(runs))

    def scores(self, q: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Exact inner products of queries, one or several, and rows."""
        v = self.v[rows]
        if np.sqrt((q * q).sum(axis=-1).max(initial=0)) * self.size < SAFE:
            return (q @ v.T).astype(np.int64)
        whole = [[int(x) for x in r] for r in v]
        out = [[sum(int(a) * b for a, b in zip(one, r, strict=True)) for r in whole] for one in np.atleast_2d(q)]
        if any(abs(x) >= 2**63 for one in out for x in one):
            raise ValueError("scores beyond 64-bit integers")
        return np.array(out, np.int64).reshape((*q.shape[:-1], len(whole)))


def feasible(x: float, size: float, most: float, least: float) -> tuple[float, float]:
    """Where the coordinate of a row of length ``most`` or less lies that scores ``least`` with a query of length ``size``
    whose own coordinate is ``x``."""
    rest = np.sqrt(max(size * size - x * x, 0.0) * max(size * size * most * most - least * least, 0.0))
    low, high = (x * least - rest) / (size * size), (x * least + rest) / (size * size)
    # an end of the whole range is feasible where that coordinate alone suffices
    if -x * most >= least:
        low = -most
    if x * most >= least:
        high = most
    slack = 1 + 1e-9 * most
    return low - slack, high + slack


class Best:
    """The best k (score, id) of a query, by falling score and rising id, in a window of scores."""

    __slots__ = ("floor", "high", "ids", "k", "scores")

    def __init__(self, k: int, floor: int | None, high: int | None = None):
        self.k, self.floor, self.high = k, floor, high
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = np.ones(len(scores), bool) if self.floor is None else scores >= self.floor
        if self.high is not None:
            fit &= scores <= self.high
        if not fit.any():
            return
        scores, ids = scores[fit], ids[fit]
        if len(scores) > 4 * self.k:
            near = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[near], ids[near]
        scores, ids = np.r_[self.scores, scores], np.r_[self.ids, ids]
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[best], ids[best]
        if len(best) == self.k:
            self.floor = max(int(self.scores[-1]), self.floor if self.floor is not None else int(self.scores[-1]))


def search_bucket(bucket: Bucket, asked: list[tuple], same: bool) -> tuple[int, int]:
    """Adds a bucket's rows to the ``Best`` lists of queries (id, label, size, v, lists), rows of the query's own label or of
    others. Returns how many rows were scored, and how many pairs there are."""
    whole, scored = [], 0

    def take(query: tuple, rows, scores: np.ndarray) -> None:
        own, label, _, _, lists = query
        ids, labels = bucket.ids[rows], bucket.labels[rows]
        fit = (labels == label) & (ids != own) if same else labels != label
        floors = [b.floor for b in lists]
        if None not in floors:
            fit &= scores >= min(floors)
        scores, ids = scores[fit], ids[fit]
        for b in lists:
            b.add(scores, ids)

    for query in asked:
        _, _, size, v, lists = query
        floors = [b.floor for b in lists]
        least = None if None in floors else min(floors, default=None)
        if not lists or (least is not None and bucket.beyond(size, least)):
            continue
        rows = None if least is None else bucket.candidates(v, size, least)
        if rows is None:
            whole.append(query)
        elif len(rows):
            scored += len(rows)
            take(query, rows, bucket.scores(v, rows))
    for at in range(0, len(whole), 64):
        some = whole[at : at + 64]
        for query, scores in zip(some, bucket.scores(np.array([q[3] for q in some])), strict=True):
            take(query, slice(None), scores)
        scored += len(some) * len(bucket.ids)
    return scored, len(asked) * len(bucket.ids)


FOUND = fields(q=LongType(), place=IntegerType(), score=LongType(), vec_id=LongType())


def search(index: DataFrame, buckets: int, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """(q, place, score, vec_id, rank): the k best rows for each window of each query. ``queries`` has q, vec_id, label, dims, size, v and
    ``windows``, an array of (place, low, high), where low and high bound scores or are null; ``block`` deals them to rounds."""
    spark = configure(index.sparkSession)
    best = stored(spark.createDataFrame([], FOUND), "best")
    tasks = min(buckets, max(spark.sparkContext.defaultParallelism, buckets // BUCKETS))
    last = Window.partitionBy("q", "place").orderBy(F.desc("score"), "vec_id")
    rounds = (queries.agg(F.max("block").alias("n")).first().n or 0) + 1
    present = {r.part for r in index.select("part").distinct().collect()}  # 64 at most
    for start, end in PARTS:
        if present.isdisjoint(range(start, end)):
            continue
        here = index.where(F.col("part").between(start, end - 1)).repartition(tasks).sortWithinPartitions("dims", F.desc("size"))
        floors = best.groupBy("q", "place").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k)
        floors = floors.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("place", "floor"))).alias("floors"))  # windows of a query
        known = stored(queries.join(floors, "q", "left"), "asking")
        found = []
        for block in range(rounds):
            # at most ROUND bytes
            asked = [tuple(r) for r in known.where(F.col("block") == block).select("q", "vec_id", "label", "dims", "size", "v", "windows", "floors").toLocalIterator()]
            if asked:
                found.append(stored(here.mapInArrow(searcher(spark.sparkContext.broadcast(asked), same, k), FOUND), "found"))
        for part in found:
            best = best.unionByName(part)
        best = stored(best.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).drop("rank"), "best")
    return best.withColumn("rank", F.row_number().over(last))


def searcher(known, same: bool, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dims: dict[int, list[tuple]] = {}
        queries = []
        for q, own, label, dims, size, v, windows, floors in known.value:
            lists = {}
            for place, low, high in windows:
                floor = (floors or {}).get(place)
                lists[place] = Best(k, low if floor is None else floor if low is None else max(floor, low), high)
            queries.append((q, lists))
            by_dims.setdefault(dims, []).append((own, label, size, np.array(v), list(lists.values())))
        for b in batches:
            for r in b.to_pylist():
                if asked := by_dims.get(r["dims"]):
                    search_bucket(Bucket(r["dims"], r["size"], r["ids"], r["labels"], r["width"], r["vectors"], r["orders"]), asked, same)
        out = [(q, place, s, i) for q, lists in queries for place, x in lists.items() for s, i in zip(x.scores.tolist(), x.ids.tolist(), strict=True)]
        for at in range(0, len(out), 100_000):
            columns = list(zip(*out[at : at + 100_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=FOUND.names)

    return run


def mine(vectors: DataFrame, anchors: Column, label: Column, key: str = "vec_id", vector: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for the rows of ``vectors`` that ``anchors``
    holds for, each of their first ``positives`` rows of the same label, and the first ``negatives`` rows of another whose scores are ``low`` to ``high`` percent of the
    positive's."""
    spark = configure(vectors.sparkSession)
    rows = whole_numbers(vectors, key, vector, label)
    index = stored(build_index(rows), "length_buckets")
    buckets = max(1, index.count())
    own = whole_numbers(vectors.where(anchors), key, vector, label)
    asked = stored(own.withColumn("q", F.monotonically_increasing_id()), "anchors")
    size = asked.agg(F.count("*").alias("n"), F.max("dims").alias("dims")).first()
    # a hundred bytes and the windows beside the components
    rounds = max(1, -(-size.n * (8 * (size.dims or 1) + 100 + 50 * positives) // ROUND))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(rounds)))
    nothing = F.lit(None).cast("long")
    open_window = F.array(F.struct(F.lit(0).alias("place"), nothing.alias("low"), nothing.alias("high")))
    found = stored(search(index, buckets, asked.withColumn("windows", open_window), True, positives), "positives")
    # 100 s >= low p and 100 s <= high p, in whole numbers
    p = F.col("score").cast("decimal(38,0)")
    window = F.struct(F.col("rank").alias("place"), F.ceil(p * low / 100).cast("long").alias("low"), F.floor(p * high / 100).cast("long").alias("high"))
    windows = found.where("score >= 0").groupBy("q").agg(F.collect_list(window).alias("windows"))  # one for each positive
    bad = search(index, buckets, asked.join(windows, "q"), False, negatives)
    pairs = found.select("q", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = bad.join(pairs, ["q", "place"]).join(asked.select("q", F.col("vec_id").alias("anchor_id")), "q")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
