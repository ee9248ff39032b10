"""Exact top-k inner products from an impact-ordered index, score at a time.

Rows are dealt to blocks of bounded size. A block's components, less the block's least one, are
whole numbers of 0 or more; their binary digits are its posting segments: the segment of a digit and
a dimension lists the rows that have the digit, and each has the same quantised impact, a power of
two. What a segment can add to a score is its impact times the query's weight in that dimension. For a group of queries
at once, segments are processed by descending weighted impact, those without weight never. After
each step it is known exactly what the segments left can still add to or take from any score. A row whose upper
bound is below the k-th lower bound is out; rows that are out for all queries of the group are read no
further. Processing stops when few rows are left for each query, or no segment with weight. Rows that
remain are rescored with their whole components.

A task goes through its blocks one after the other and takes each query's k-th best score along: a block starts with that proof, so
a row that cannot reach it is out with its first segments, and a block without such a row is left. The
index is searched in three rounds, of a 64th, an eighth and the rest of its blocks, each with the k-th best scores of those
before. Blocks of queries, a bounded number at a time, are broadcast; a task gives k rows for each query at
most, and those of a later round only if they reach the k-th best of the earlier ones.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; a query meets
the vectors of its own length; a query has no row for itself (rows of
the same id are its own); ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType

from .common import configure, fields, stored

#: Rows of an index block, queries of a query block, and bytes of the query blocks that are broadcast at a time.
BLOCK, QUERIES, ROUND = 8192, 2048, 64_000_000
#: Queries that share the order of the segments, blocks of a task, and parts of the index by 64ths of its blocks.
GROUP, BLOCKS, PARTS = 64, 16, ((0, 1), (1, 8), (8, 64))
SCALE = 256
#: Scores beyond this are added up in exact integers of Python.
SAFE = 2.0**52


def whole_numbers(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): components floor(256 x) of the vectors that take part."""
    sound = F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("e")).where(sound & F.col("vec_id").isNotNull())
    return rows.select("vec_id", F.transform("e", lambda x: F.floor(x * SCALE).cast("double")).alias("v"))


def build_index(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, dims, least, digits, ids, segments): the posting segments of each block as bitmaps, the digit of
    the highest impact first. Each block holds about ``block`` rows at most, of one length."""
    n = rows.count()
    dealt = rows.withColumn("dims", F.size("v")).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, -(-n // block)))))
    schema = fields(block=LongType(), dims=IntegerType(), least=LongType(), digits=IntegerType(), ids=BinaryType(), segments=BinaryType())

    def one(table: pa.Table) -> pa.Table:
        ids = np.array(table.column("vec_id").to_pylist(), "<i8")
        v = np.array(table.column("v").to_pylist(), float)
        order = np.lexsort((*v.T[::-1], ids))
        ids, v = ids[order], v[order]
        least = int(v.min())
        shifted = v - least
        if shifted.max() >= 2.0**62 or abs(least) >= 2**62:
            raise ValueError("components beyond 64-bit integers")
        digits = max(1, int(shifted.max()).bit_length())
        levels = shifted.astype("<i8").T
        bits = b"".join(np.packbits((levels >> d & 1).astype(bool), axis=1).tobytes() for d in range(digits - 1, -1, -1))
        out = dict(block=[table.column("block")[0].as_py()], dims=[v.shape[1]], least=[least], digits=[digits], ids=[ids.tobytes()], segments=[bits])
        return pa.table(out, schema=pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("least", pa.int64()), ("digits", pa.int32()), ("ids", pa.binary()), ("segments", pa.binary())]))

    return dealt.select("block", "dims", "vec_id", "v").groupBy("block", "dims").applyInArrow(one, schema)


def weighted_order(q: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """(digit, dimension) of the segments that have weight for a group of queries, by descending impact."""
    weight = np.abs(q).max(axis=0, initial=0)
    impact = weight * 2.0 ** np.arange(digits)[:, None]
    order = np.argsort(-impact, axis=None, kind="stable")
    order = order[impact.ravel()[order] > 0]
    return order // q.shape[1], order % q.shape[1]


def candidates(q: np.ndarray, own: np.ndarray, ids: np.ndarray, digits: int, planes: np.ndarray, k: int, seen: list | None = None, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the rows that may be among the k best and reach ``floor``. ``planes`` holds a bitmap for each digit, the
    highest first, and dimension; ``seen`` takes how many segments were processed, and how many have weight."""
    n, dims = len(ids), q.shape[1]
    ds, js = weighted_order(q, digits)
    rows = np.arange(n)  # those read on
    barred = ids[None, :] == own[:, None]
    acc, alive = np.zeros((len(q), n)), ~barred
    read, floor = 0, np.full(len(q), -np.inf) if floor is None else floor
    # what all segments together can add
    best = np.maximum(q[:, js] * 2.0**ds, 0).sum(axis=1)
    alive &= (best >= floor)[:, None]
    if not alive.any():
        rows, acc, alive = rows[:0], acc[:, :0], alive[:, :0]
    for at in range(0, len(ds) if len(rows) else 0, dims):
        d, j = ds[at : at + dims], js[at : at + dims]
        bits = np.unpackbits(planes[digits - 1 - d, j], axis=1, count=n)
        acc += (q[:, j] * 2.0**d) @ (bits if len(rows) == n else bits[:, rows]).astype(float)
        left = q[:, js[at + dims :]] * 2.0 ** ds[at + dims :]
        more, less = np.maximum(left, 0).sum(axis=1), np.maximum(-left, 0).sum(axis=1)
        low = np.where(alive, acc - less[:, None], -np.inf)
        kth = np.partition(low, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) > k else np.full(len(q), -np.inf)
        read = min(len(ds), at + dims)
        alive &= acc + more[:, None] >= np.maximum(kth, floor)[:, None]
        if alive.sum() <= 8 * k * len(q):
            break
        if (some := alive.any(axis=0)).mean() < 0.5:
            rows, acc, alive = rows[some], acc[:, some], alive[:, some]
    if seen is not None:
        seen.append((read, len(ds)))
    qs, places = np.nonzero(alive)
    return qs, rows[places]


def search_block(q: np.ndarray, own: np.ndarray, ids: np.ndarray, least: int, digits: int, segments: bytes, k: int, seen: list | None = None, floor: np.ndarray | None = None):
    """(query, row, score) of the k best rows of a block for each row of ``q``, of those that reach ``floor``."""
    n, dims = len(ids), q.shape[1]
    planes = np.frombuffer(segments, np.uint8).reshape(digits, dims, -(-n // 8))
    size = np.abs(q).sum(axis=1).max(initial=0)
    exact = size * 2.0**digits + size * abs(least) < SAFE
    if exact:
        # a score is that of the digits and the least component times the query's sum; half a point for rounding
        reach = None if floor is None else floor - q.sum(axis=1) * least - 0.5
        qs, rows = candidates(q, own, ids, digits, planes, k, seen, reach)
    else:
        qs, rows = np.nonzero(ids[None, :] != own[:, None])
    # whole components of the rows that may be members
    weights = (1 << np.arange(digits - 1, -1, -1, dtype=np.int64))[:, None]
    members, place = np.unique(rows, return_inverse=True)
    vectors = np.zeros((len(members), dims), np.int64)
    for d in range(digits):
        vectors += np.unpackbits(planes[d], axis=1, count=n)[:, members].T.astype(np.int64) * weights[d]
    if exact:
        scores = np.einsum("ij,ij->i", q[qs], vectors[place].astype(float)) + (q.sum(axis=1) * least)[qs]
        scores = scores.astype(np.int64)
    else:
        scores = [sum(int(a) * (int(b) + least) for a, b in zip(q[i], vectors[p], strict=True)) for i, p in zip(qs, place, strict=True)]
        if any(abs(s) >= 2**63 for s in scores):
            raise ValueError("scores beyond 64-bit integers")
        scores = np.array(scores, np.int64)
    order = np.lexsort((ids[rows], -scores, qs))
    qs, rows, scores = qs[order], rows[order], scores[order]
    first = np.searchsorted(qs, qs)
    best = np.arange(len(qs)) - first < k
    return qs[best], ids[rows[best]], scores[best]


class Running:
    """The k best (score, id) of each query of a block of queries so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray):
        self.own, self.q, self.k, self.floor = ids, q, k, floor
        self.found = [np.zeros(0, np.int64) for _ in range(3)]  # query, id, score

    def add(self, at: int, qs: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Adds what a block of the index gives for the queries from ``at`` on."""
        if not len(qs):
            return
        qs, ids, scores = (np.r_[a, b] for a, b in zip(self.found, (qs + at, ids, scores), strict=True))
        order = np.lexsort((ids, -scores, qs))
        qs, ids, scores = qs[order], ids[order], scores[order]
        place = np.arange(len(qs)) - np.searchsorted(qs, qs)
        full = place == self.k - 1
        self.floor[qs[full]] = np.maximum(self.floor[qs[full]], scores[full])
        self.found = [x[place < self.k] for x in (qs, ids, scores)]


FOUND = fields(query_id=LongType(), vec_id=LongType(), score=LongType())


def searcher(known, k: int):
    """mapInArrow over blocks of the index. The last row of a task has no query: it says how many segments were read, as id, of how
    many with weight, as score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, floors = known.value
        asked: dict[int, list[Running]] = {}
        for dims, ids, q in packs:
            own = np.frombuffer(ids, "<i8")
            floor = np.array([floors.get(i, -np.inf) for i in own.tolist()], float)
            asked.setdefault(dims, []).append(Running(own, np.frombuffer(q, "<f8").reshape(-1, dims), k, floor))
        seen: list[tuple[int, int]] = []
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], "<i8")
                for one in asked.get(r["dims"], ()):
                    for at in range(0, len(one.own), GROUP):
                        part = slice(at, at + GROUP)
                        one.add(at, *search_block(one.q[part], one.own[part], ids, r["least"], r["digits"], r["segments"], k, seen, one.floor[part]))
        for one in (x for xs in asked.values() for x in xs):
            qs, ids, scores = one.found
            yield pa.RecordBatch.from_arrays([pa.array(one.own[qs]), pa.array(ids), pa.array(scores)], names=FOUND.names)
        read, weighted = (sum(x) for x in zip(*seen, strict=True)) if seen else (0, 0)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([read], pa.int64()), pa.array([weighted], pa.int64())], names=FOUND.names)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, query_block: int = QUERIES, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of ``vectors`` for each row of ``queries``. ``report`` takes how
    many segments were read, of how many that have weight, and how many rows were shuffled."""
    spark = configure(vectors.sparkSession)
    index = stored(build_index(whole_numbers(vectors, key, vector), block).withColumn("part", F.pmod(F.xxhash64("block", "dims"), F.lit(64))), "impact_index")
    asked = whole_numbers(queries, key, vector)
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    many = max(1, -(-size.n // query_block))
    # a block is a little larger than query_block by chance of the hash
    at_once = max(1, ROUND // (16 * query_block * (size.dims or 1)))
    schema_q = fields(qblock=LongType(), dims=IntegerType(), qids=BinaryType(), q=BinaryType())

    def packed(table: pa.Table) -> pa.Table:
        q = np.array(table.column("v").to_pylist(), "<f8")
        out = dict(qblock=[table.column("qblock")[0].as_py()], dims=[q.shape[1]], qids=[np.array(table.column("vec_id").to_pylist(), "<i8").tobytes()], q=[q.tobytes()])
        return pa.table(out, schema=pa.schema([("qblock", pa.int64()), ("dims", pa.int32()), ("qids", pa.binary()), ("q", pa.binary())]))

    own_block = lambda c: F.pmod(F.xxhash64(c), F.lit(many))
    sets = asked.withColumn("dims", F.size("v")).withColumn("qblock", own_block("vec_id")).select("qblock", "dims", "vec_id", "v").groupBy("qblock", "dims").applyInArrow(packed, schema_q)
    blocks = stored(sets, "query_blocks")
    present = {r.part for r in index.select("part").distinct().collect()}  # 64 at most
    n = max(1, index.count())
    tasks = min(n, max(spark.sparkContext.defaultParallelism, n // BLOCKS))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, told = stored(spark.createDataFrame([], FOUND), "best"), {"read": 0, "segments": 0, "shuffled": 0}
    for first, end in PARTS:
        if present.isdisjoint(range(first, end)):
            continue
        here = index.where(F.col("part").between(first, end - 1)).repartition(tasks)
        floors = best.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k)
        found = []
        for at in range(0, many, at_once):
            # bounded by ROUND, and a number for each query of these
            packs = [(r.dims, bytes(r.qids), bytes(r.q)) for r in blocks.where(F.col("qblock").between(at, at + at_once - 1)).toLocalIterator()]
            least = {r.query_id: r.floor for r in floors.where(own_block("query_id").between(at, at + at_once - 1)).toLocalIterator()}
            if packs:
                known = spark.sparkContext.broadcast((packs, least))
                found.append(stored(here.select("dims", "least", "digits", "ids", "segments").mapInArrow(searcher(known, k), FOUND), "round"))
                known.destroy()
        if not found:
            continue
        rows = reduce(DataFrame.unionByName, found)
        if report is not None:
            r = rows.where("query_id is null").agg(F.sum("vec_id").alias("read"), F.sum("score").alias("segments")).first()
            told = {"read": told["read"] + (r.read or 0), "segments": told["segments"] + (r.segments or 0), "shuffled": told["shuffled"] + rows.where("query_id is not null").count()}
        best = best.unionByName(rows.where("query_id is not null"))
        best = stored(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "best")
    if report is not None:
        report.update(told)
    return best.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")
