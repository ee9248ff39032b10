"""Payload columns as media in a store of content-defined chunks.

A payload is stored losslessly as 8-bit samples (a WAV file of one channel) and cut where a rolling gear
hash of its last letters says so, so that equal stretches give equal chunks wherever they stand. Rows are
gathered in packs; a pack keeps each of its chunks once, and for each row the ordered list of its chunks.
Digests of all packs' chunks are joined: the first place of a digest is the chunk's home, and the store is
written again with the bytes of homes only. Reading joins the bytes of chunks at home elsewhere to the
packs that list them, puts the lists together, verifies every chunk by its digest, and only
then computes checksums and features from the samples.

Packs are bucketed tables, so that these joins move digests and shared chunks, never whole packs. The bytes of a
chunk that very many packs ask for are dealt over several keys. The staged table is dropped; the store stays
in the catalog, as it is what this module makes.

Defined results: a null text counts as empty; an empty payload is one block of spaces; equal texts
have equal results; an empty table gives an empty result; a null id is kept.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import configure, fields, map_rows, new_path

UNIT, FILL, TAIL = 192, 32, 16
#: Chunks: least and most bytes, and bits of the hash that must be 0 for a cut (a mean of 2 ** bits more).
LEAST, MOST, MASK_BITS = 256, 8192, 10
#: Payload bytes of a pack.
PACK = 1_000_000
#: Packs that ask for one chunk under one key, about.
ASKED = 1000
_GEAR = np.random.default_rng(9_091).integers(0, 2**32, 256, dtype=np.uint32)


def payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(UNIT, -(-len(data) // UNIT) * UNIT)
    return len(data), data.ljust(n, bytes([FILL]))


def header(n: int) -> bytes:
    """Of a WAV file of ``n`` 8-bit samples, one channel, 8,000 a second. A Spark string, and so ``n``, stays
    below the 4 GiB that the format can state."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: where the gear hash of the last 32 bytes has MASK_BITS zeros on top."""
    n = len(data)
    h = _GEAR[np.frombuffer(data, np.uint8)]
    # h[i] = sum of gear[i - k] << k for k < 32, by doubling
    span = 1
    while span < 32:
        more = h.copy()
        more[span:] += h[:-span] << np.uint32(span) if span < n else 0
        h, span = more, span * 2
    out, at = [], 0
    for c in (np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist():
        while c - at > MOST:
            at += MOST
            out.append(at)
        if c - at >= LEAST:
            out.append(c)
            at = c
    while n - at > MOST:
        at += MOST
        out.append(at)
    if at < n:
        out.append(n)
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def feature(samples: np.ndarray) -> str:
    """Sum, energy and crossings of the middle level of the samples, and the most frequent one."""
    x = samples.astype(np.int64) - 128
    return f"sum:{x.sum()};energy:{(x * x).sum()};crossings:{int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())};mode:{int(np.bincount(samples, minlength=256).argmax())}"


def pack_schema(id_type) -> StructType:
    row = StructType([StructField("doc_id", id_type), StructField("n_bytes", LongType()), StructField("chunks", ArrayType(IntegerType()))])
    return StructType([*fields(pack=LongType()).fields, StructField("rows", ArrayType(row)), StructField("digests", ArrayType(BinaryType())), StructField("sizes", ArrayType(IntegerType())), *fields(data=BinaryType()).fields])


def packs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Self-contained packs, numbered by partition and place."""
    import zstandard

    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = pack_schema(chosen.schema["doc_id"].dataType)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=6)
        first = TaskContext.get().partitionId() << 16
        number, size, rows, known, parts = 0, 0, [], {}, []

        def close():
            nonlocal number, size, rows, known, parts
            out = pa.RecordBatch.from_pylist([{"pack": first + number, "rows": rows, "digests": list(known), "sizes": list(map(len, parts)), "data": squeeze.compress(b"".join(parts))}], schema=arrow)
            number, size, rows, known, parts = number + 1, 0, [], {}, []
            return out

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, data = payload(t)
                own, at = [], 0
                for end in cuts(data):
                    d = digest(part := data[at:end])
                    if d not in known:
                        known[d] = len(parts)
                        parts.append(part)
                    own.append(known[d])
                    at = end
                rows.append({"doc_id": i, "n_bytes": n, "chunks": own})
                size += len(data)
                if size >= PACK:
                    yield close()
        if rows:
            yield close()

    return chosen.mapInArrow(run, schema)


def bucketed(df: DataFrame, name: str, buckets: int) -> tuple[DataFrame, str]:
    """``df`` as a table bucketed by pack, in the shared folder, and the table's name."""
    spark = df.sparkSession
    table = f"logweave_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "pack").option("path", new_path(spark, name)).option("compression", "zstd").saveAsTable(table)
    return spark.table(table), table


def inflate(data: bytes, sizes: list[int]) -> list[bytes]:
    import zstandard

    whole, out, at = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, sum(sizes))), [], 0
    for n in sizes:
        out.append(whole[at : at + n])
        at += n
    return out


def build_store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The store: packs with the bytes of the chunks at home in them. ``home`` says for each chunk
    whether it is, and ``asked`` over how many keys its bytes are dealt when other packs ask for it (0: none does)."""
    spark = configure(docs.sparkSession)
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    staged, name = bucketed(packs(docs, key, text), "staged", buckets)
    refs = staged.select("pack", F.posexplode("digests").alias("pos", "digest")).withColumn("place", F.shiftleft("pack", 22) + F.col("pos"))
    homes = refs.groupBy("digest").agg(F.min("place").alias("home_place"), F.count("*").alias("n"))
    flags = refs.join(homes, "digest").select("pack", F.struct("pos", (F.col("place") == F.col("home_place")).alias("home"), F.when(F.col("n") > 1, F.ceil(F.col("n") / ASKED)).otherwise(0).cast("int").alias("asked")).alias("f"))
    # as many flags as the pack has chunks
    flags = flags.groupBy("pack").agg(F.array_sort(F.collect_list("f")).alias("flags"))
    schema = StructType([*staged.schema.fields, StructField("home", ArrayType(BooleanType())), StructField("asked", ArrayType(IntegerType()))])

    def make():
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=6)

        def work(numbers, rows, digests, sizes, data, flags):
            home = [[f["home"] for f in own] for own in flags]
            kept = [d if all(h) else squeeze.compress(b"".join([p for p, k in zip(inflate(d, s), h, strict=True) if k])) for d, s, h in zip(data, sizes, home, strict=True)]
            return {"pack": numbers, "rows": rows, "digests": digests, "sizes": sizes, "data": kept, "home": home, "asked": [[f["asked"] for f in own] for own in flags]}

        return work

    store, _ = bucketed(map_rows(staged.join(flags, "pack").select(*staged.columns, "flags"), make, schema), "store", buckets)
    drop(staged, name)
    return store


def drop(table: DataFrame, name: str) -> None:
    """Removes a table that this module wrote, and its files."""
    spark = table.sparkSession
    files = table.inputFiles()
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


RESULT = fields(n_bytes=LongType(), payload_bytes=LongType(), payload_sha256=StringType(), tail_crc32=LongType(), media_bytes=LongType(), media_sha256=StringType(), feature=StringType(), n_chunks=LongType())


def read_store(store: DataFrame) -> DataFrame:
    """A row for each stored payload, put together from its chunks and verified."""
    shared = fields(digest=BinaryType(), deal=IntegerType(), bytes=BinaryType())

    def give():
        def work(digests, sizes, data, home, flags):
            out = {k: [] for k in shared.names}
            for ds, ns, z, h, f in zip(digests, sizes, data, home, flags, strict=True):
                if any(a and b for a, b in zip(h, f, strict=True)):  # a home that is asked
                    own = inflate(z, [n for n, k in zip(ns, h, strict=True) if k])
                    at = [k for k, here in enumerate(h) if here]
                    for k, part in zip(at, own, strict=True):
                        for deal in range(f[k]):
                            for name, v in zip(shared.names, (ds[k], deal, part), strict=True):
                                out[name].append(v)
            return out

        return work

    lent = map_rows(store.select("digests", "sizes", "data", "home", "asked"), give, shared)
    asked = store.select("pack", F.posexplode(F.arrays_zip("digests", "home", "asked")).alias("pos", "c")).where("not c.home")
    asked = asked.select("pack", "pos", F.col("c.digests").alias("digest"), F.pmod("pack", F.col("c.asked")).cast("int").alias("deal"))
    # as many as the pack has chunks
    got = asked.join(lent, ["digest", "deal"]).groupBy("pack").agg(F.collect_list(F.struct("pos", "bytes")).alias("got"))
    id_field = store.schema["rows"].dataType.elementType["doc_id"]
    schema = StructType([StructField("doc_id", id_field.dataType), *RESULT.fields])

    def make():
        def work(rows, digests, sizes, data, home, got):
            out = {n: [] for n in schema.names}
            for own, ds, ns, z, h, more in zip(rows, digests, sizes, data, home, got, strict=True):
                parts: list = [None] * len(ds)
                for k, p in zip([k for k, here in enumerate(h) if here], inflate(z, [n for n, k in zip(ns, h, strict=True) if k]), strict=True):
                    parts[k] = p
                for m in more or ():
                    parts[m["pos"]] = m["bytes"]
                for d, p in zip(ds, parts, strict=True):
                    if p is None or digest(p) != d:
                        raise ValueError("a chunk is missing or damaged")
                for r in own:
                    samples = b"".join([parts[k] for k in r["chunks"]])
                    media = header(len(samples)) + samples
                    found = (
                        r["doc_id"], r["n_bytes"], len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(),
                        feature(np.frombuffer(samples, np.uint8)), len(r["chunks"]),
                    )
                    for n, v in zip(schema.names, found, strict=True):
                        out[n].append(v)
            return out

        return work

    # a pack at a time: a pack's rows leave as one batch
    return map_rows(store.join(got, "pack", "left").select("rows", "digests", "sizes", "data", "home", "got"), make, schema)


def store_and_read(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return read_store(build_store(docs, key, text))
