"""Exact duplicates by two passes over Bloom filters: only rows whose hash may be repeated are shuffled.

Each text becomes a SHA-256 of its letters, A to Z in lower case; texts move no further. The digest names a
segment of a filter and a place of 32 bits in it, and the place gives HASHES bits of the segment. A row may be
repeated only if each of its bits was set at least twice.

First pass: a task gathers the places of its rows by segment, one that it meets again is sent twice at most, and
each segment counts its bits up to two. What stays is one bitmap for each segment, of the bits that were set twice.
Second pass: the bitmaps are tried by the rows where they lie. A row that misses a bit is alone with its text and
passes straight through. The others are grouped by their whole digest, so a false alarm of the filter changes no
result.

Scale: a bitmap has SEGMENT bits for about SEGMENT / BITS rows. Bitmaps of ROUND bytes at most are broadcast at a time,
so about ROUND * 8 / BITS rows (134 million) are tried in a round; rows are stored sorted by digest inside each task,
and a round reads the pages of its own range only. Digests under which more than a 20,000th of all rows
stand (at most 20,000 digests) are broadcast with their groups; the other groups meet their rows in a shuffle in which no key is larger.

Defined results: null counts as empty, and all empty texts are equal; of equal texts the row with the largest id stays, a null
id is less than any other; of rows with the same text and id one stays, whichever; an empty table gives an empty result.
Columns of other names are not read by ``mark`` and are kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from .common import configure, fields, new_path, stored

#: Bits of a segment's bitmap, bits for each row, bits that a row sets, and bytes of bitmaps broadcast at a time.
SEGMENT, BITS, HASHES, ROUND = 2**22, 8, 3, 128 * 2**20
#: A digest is hot if it has more than this share of all rows.
HOT = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    """SHA-256 of a text with A to Z in lower case, as 32 bytes."""
    return F.unhex(F.sha2(F.encode(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), "UTF-8"), 256))


def places(digests: pa.Array, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and place within it of each digest. Segments are ranges of digests, in order."""
    words = np.frombuffer(b"".join(digests.to_pylist()), ">u4").reshape(-1, 8)
    return (words[:, 0].astype(np.uint64) * np.uint64(segments) >> np.uint64(32)).astype(np.int32), words[:, 1].astype(np.uint32)


def bits_of(place: np.ndarray, size: int) -> np.ndarray:
    """(row, hash): the bits that each place sets in a bitmap of ``size`` bits, a power of two."""
    mixed = place.astype(np.uint64)[:, None] * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)[:HASHES]
    return (mixed >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def add_bits(seen: np.ndarray, place: np.ndarray) -> None:
    """Counts, up to two, the bits of ``seen`` that places set."""
    for column in bits_of(place, len(seen)).T:
        at, n = np.unique(column, return_counts=True)
        seen[at] = np.minimum(seen[at] + np.minimum(n, 2), 2)


def bitmaps(rows: DataFrame, segments: int, size: int) -> DataFrame:
    """First pass. (segment, bits) of ``rows(sha)``; what is shuffled is four bytes for each row, at most twice for each task and digest."""
    schema = fields(segment=IntegerType(), places=BinaryType())

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def sent() -> pa.RecordBatch:
            keys = np.concatenate(held)
            held.clear()
            keys, n = np.unique(keys, return_counts=True)
            keys = np.repeat(keys, np.minimum(n, 2))
            segment, place = (keys >> np.uint64(32)).astype(np.int32), keys.astype(np.uint32)
            first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            ends = np.r_[first[1:], len(keys)]
            data = [place[a:b].tobytes() for a, b in zip(first, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(segment[first]), pa.array(data, pa.binary())], names=["segment", "places"])

        for b in batches:
            if b.num_rows:
                segment, place = places(b.column(0), segments)
                held.append(segment.astype(np.uint64) << np.uint64(32) | place)
                if sum(map(len, held)) >= 2_000_000:  # 16 MB
                    yield sent()
        if held:
            yield sent()

    def merged(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.uint8)
        for b in parts:
            for data in b.column("places"):
                add_bits(seen, np.frombuffer(data.as_buffer(), np.uint32))
        bits = np.packbits(seen > 1).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bits], pa.binary())], names=["segment", "bits"])

    sent = rows.select("sha").mapInArrow(gathered, schema)
    return sent.groupBy("segment").applyInArrow(merged, fields(segment=IntegerType(), bits=BinaryType()))


def suspects(rows: DataFrame, name: str = "sha") -> DataFrame:
    """Second pass. ``rows`` with ``maybe``: whether a row's digest may be repeated, stored a round at a time. Never false
    for one that is."""
    spark = configure(rows.sparkSession)
    n = rows.count()
    segments = max(1, -(-n * BITS // SEGMENT))
    # a table below one segment has a smaller one: from its number of rows, up to a power of two
    size = SEGMENT if segments > 1 else 1 << max(10, (max(n, 1) * BITS - 1).bit_length())
    filters = stored(bitmaps(rows, segments, size), "bloom")
    at_once = max(1, ROUND * 8 // size)
    path, at = new_path(spark, "tried"), rows.schema.names.index(name)
    schema = StructType([*rows.schema.fields, StructField("maybe", BooleanType())])
    for start in range(0, segments, at_once):
        end = min(segments, start + at_once)
        # at most ROUND bytes
        known = spark.sparkContext.broadcast({r.segment: r.bits for r in filters.where(F.col("segment").between(start, end - 1)).toLocalIterator()})

        def tried(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            own = {k: np.frombuffer(v, np.uint8) for k, v in known.value.items()}
            for b in batches:
                if not b.num_rows:
                    continue
                segment, place = places(b.column(at), segments)
                maybe = np.ones(len(place), bool)
                for s in np.unique(segment):
                    here = segment == s
                    if s not in own:
                        maybe[here] = False
                        continue
                    bits = bits_of(place[here], size)
                    maybe[here] = (own[s][bits >> 3] >> (7 - (bits & 7)) & 1).all(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(maybe)], names=[*b.schema.names, "maybe"])

        low, high = (F.unhex(F.lit(f"{-(-(s << 32) // segments):08x}")) for s in (start, min(end, segments)))
        own = rows if start == 0 else rows.where(F.col(name) >= low)
        own = own if end == segments else own.where(F.col(name) < high)
        own.mapInArrow(tried, schema).write.mode("append").parquet(path)
        known.destroy()
    return spark.read.schema(schema).parquet(path)


def groups(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, sha, rid)`` with ``keep_id``, ``group_size`` and ``kept``: groups by whole digests."""
    n = rows.count()
    last = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "rid")).alias("_last")
    found = stored(rows.groupBy("sha").agg(last, F.count("*").alias("group_size")), "copies")
    hot = F.col("group_size") > F.lit(max(1, n // HOT))
    # a bounded number of digests, and rows of these
    few = F.broadcast(found.where(hot))
    common = rows.join(few, "sha")
    others = rows.join(F.broadcast(found.where(hot).select("sha")), "sha", "left_anti").join(found.where(~hot), "sha")
    both = common.unionByName(others)
    return both.select("doc_id", F.col("_last.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("_last.rid")).alias("kept"), "sha", "rid")


def _digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, sha, rid) of all rows, stored, sorted by digest inside each task."""
    own = docs.select(F.col(key).alias("doc_id"), digest(F.col(text)).alias("sha"), F.monotonically_increasing_id().alias("rid"))
    return stored(own.sortWithinPartitions("sha"), "digests")


def mark(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``."""
    tried = suspects(_digests(docs, key, text))
    whole = (F.col("doc_id").alias("keep_id"), F.lit(1).cast(LongType()).alias("group_size"), F.lit(True).alias("kept"))
    alone = tried.where(~F.col("maybe")).select("doc_id", *whole, "sha", "rid")
    found = alone.unionByName(groups(tried.where("maybe").select("doc_id", "sha", "rid")))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows that cannot be repeated move nowhere; only the
    others are shuffled."""
    names = [f"c{k}" for k in range(len(docs.columns))]  # columns of any name, under names that cannot clash
    plain = docs.toDF(*names)
    of = lambda name: F.col(names[docs.columns.index(name)])
    own = plain.select(*names, digest(of(text)).alias("sha"), of(key).alias("doc_id"), F.monotonically_increasing_id().alias("rid"))
    tried = suspects(stored(own.sortWithinPartitions("sha"), "rows"))
    again = tried.where("maybe")
    gone = groups(again.select("doc_id", "sha", "rid")).where(~F.col("kept")).select("rid")
    left = tried.where(~F.col("maybe")).unionByName(again.join(gone, "rid", "left_anti"))
    return left.select(*names).toDF(*docs.columns)
