"""A tamper-evident ledger: Merkle trees over blocks of events, blocks chained by their hashes."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.schema import GENESIS
from logweave.storage import new_path, stored

#: The fields a seal covers, sorted, and the ledger's version.
SEALED = ("hostname", "id", "matched_format", "message", "process", "raw_message", "severity", "source_type", "timestamp")
VERSION, BLOCK = "1.0", 500


def _hash(prefix: str, data: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit(prefix)), data), 256)


def node_hash(left: Column, right: Column) -> Column:
    return _hash("01", F.concat(F.unhex(left), F.unhex(right)))


def canonical(log: DataFrame) -> Column:
    """Sorted keys, no spaces, nulls kept, escapes in lower case."""
    text = F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in SEALED)), {"ignoreNullFields": "false"})
    # to_json escapes control letters as \\u001B; JSON writers in use elsewhere as \\u001b. An escape stands after an
    # even number of backslashes: after an odd one it is text of the event. Few events have one.
    lower = text
    for n in range(32):
        if f"{n:04x}" != f"{n:04X}":
            lower = F.regexp_replace(lower, rf"(?<!\\)((?:\\\\)*)\\u{n:04X}", rf"$1\\u{n:04x}")
    return F.when(text.contains("\\u00"), lower).otherwise(text)


def leaves(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """(height, idx, event_id, hash): leaves in order of time and id, dealt to blocks.

    Hashes are stored before they are ordered, as ranges are found by sampling. The order is a range partitioning,
    stored with the number of each range, so that a lost executor changes nothing. Positions are a count for each range, whose running sums are as many numbers as there are
    ranges, plus a row number inside the range.
    """
    rows = log.select("timestamp", F.col("id").alias("event_id"), _hash("00", F.encode(canonical(log), "UTF-8")).alias("hash"))
    spread = stored(stored(rows, "hashed").repartitionByRange(F.col("timestamp"), F.col("event_id")).withColumn("_p", F.spark_partition_id()), "leaves")
    counts = spread.groupBy("_p").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("_p").orderBy("timestamp", "event_id")) - 1
    at = spread.withColumn("_i", own).join(F.broadcast(before.select("_p", F.coalesce("before", F.lit(0)).alias("before"))), "_p").withColumn("at", F.col("_i") + F.col("before"))
    return at.select(F.floor(F.col("at") / block).cast("long").alias("height"), (F.col("at") % block).cast("long").alias("idx"), "event_id", "hash")


def _halved(nodes: Column) -> Column:
    pair = lambda i: F.when(2 * i + 1 < F.size(nodes), node_hash(F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1))).otherwise(F.get(nodes, 2 * i))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) + 1) / 2).cast("int") - 1), pair)


def levels(tree: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every level of every block's tree as (height, level, idx, hash); an odd last node is promoted.

    A block is an array of at most ``block`` hashes, folded level by level in one expression each.
    """
    one = tree.groupBy("height").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda s: s["hash"]).alias("l0"))
    depth = max(1, (block - 1).bit_length())
    for k in range(depth):
        below = F.col(f"l{k}")
        one = one.withColumn(f"l{k + 1}", F.when(F.size(below) > 1, _halved(below)))
    every = F.array(*(F.struct(F.lit(k).alias("level"), F.col(f"l{k}").alias("nodes")) for k in range(depth + 1)))
    out = one.select("height", F.explode(F.filter(every, lambda e: e["nodes"].isNotNull())).alias("e"))
    return out.select("height", F.col("e.level").alias("level"), F.posexplode("e.nodes").alias("idx", "hash"))


def roots(tree: DataFrame, block: int = BLOCK) -> DataFrame:
    """Root, leaves and depth of each block."""
    ends = levels(tree, block).groupBy("height").agg(F.max_by("hash", "level").alias("merkle_root"), F.max("level").alias("depth"))
    return ends.join(tree.groupBy("height").agg(F.count("*").alias("event_count")), "height")


def header_hash(header: dict) -> str:
    names = ("version", "height", "prev_hash", "merkle_root", "event_count", "sealed_at")
    return hashlib.sha256(json.dumps({n: header[n] for n in names}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def header_column() -> Column:
    q = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    text = F.concat(F.lit('{"event_count":'), F.col("event_count").cast("string"), F.lit(',"height":'), F.col("height").cast("string"), F.lit(',"merkle_root":'), q("merkle_root"), F.lit(',"prev_hash":'), q("prev_hash"), F.lit(',"sealed_at":'), q("sealed_at"), F.lit(',"version":'), q("version"), F.lit("}"))
    return F.sha2(F.encode(text, "UTF-8"), 256)


def seal(log: DataFrame, sealed_at: str, block: int = BLOCK, batch: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(blocks, leaves), both stored. The fold over headers is serial by its nature: one short row for
    each block streams through the driver, which writes them out ``batch`` at a time; the trees are made on the
    executors. Refuses to seal nothing."""
    spark = log.sparkSession
    tree = stored(leaves(log, block), "tree")
    path, schema = new_path(spark, "blocks"), "version string, height long, prev_hash string, merkle_root string, event_count long, sealed_at string, hash string"
    rows, prev = [], GENESIS

    def write() -> None:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        rows.clear()

    for r in stored(roots(tree, block), "roots").orderBy("height").toLocalIterator():
        header = {"version": VERSION, "height": r.height, "prev_hash": prev, "merkle_root": r.merkle_root, "event_count": r.event_count, "sealed_at": sealed_at}
        prev = header_hash(header)
        rows.append((*header.values(), prev))
        if len(rows) == batch:
            write()
    if prev == GENESIS:
        raise ValueError("nothing to seal")
    if rows:
        write()
    return spark.read.schema(schema).parquet(path), tree


def verify(blocks: DataFrame, tree: DataFrame, block: int = BLOCK, head: str | None = None) -> DataFrame:
    """I4: problems as (height, kind): all of them at once, from recomputed roots and header hashes."""
    own = blocks.join(roots(tree, block).withColumnsRenamed({"merkle_root": "_root", "event_count": "_n"}).drop("depth"), "height", "left")
    # the block before is found by its height, and the last one by the largest height: no order over all blocks
    before = blocks.select((F.col("height") + 1).alias("height"), F.col("hash").alias("_prev"))
    own = own.join(before, "height", "left").withColumn("_prev", F.coalesce("_prev", F.when(F.col("height") == 0, F.lit(GENESIS)), F.lit("")))
    own = own.join(F.broadcast(blocks.agg(F.max("height").alias("_top")))).withColumn("_last", F.col("height") == F.col("_top"))  # one row
    kinds = F.array_compact(F.array(
        F.when(F.col("prev_hash") != F.col("_prev"), F.lit("broken_link")), F.when(~F.col("_root").eqNullSafe(F.col("merkle_root")), F.lit("merkle_mismatch")),
        F.when(header_column() != F.col("hash"), F.lit("header_altered")), F.when(F.coalesce("_n", F.lit(0)) != F.col("event_count"), F.lit("count_mismatch")),
        F.when(F.col("_last") & F.lit(head is not None) & (F.col("hash") != F.lit(head or "")), F.lit("head_mismatch")),
    ))
    return own.select("height", F.explode(kinds).alias("kind")).orderBy("height", "kind")


PATH = "array<struct<side:string,hash:string>>"


def paths(tree: DataFrame, by: tuple[str, ...], block: int) -> DataFrame:
    """(by, event_id, leaf, proof) of the rows of ``tree(by, idx, event_id, hash, asked)`` that are asked for: siblings with their sides, from
    the leaf up; levels without one are left out.

    A block's levels are arrays of one row, as long as the block, and its events take their paths from them: no row for a step of a path moves."""
    one = tree.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("idx", "hash", "event_id", "asked"))).alias("own"))
    one = one.where(F.exists("own", lambda s: s["asked"])).withColumn("l0", F.transform("own", lambda s: s["hash"]))
    depth = max(1, (block - 1).bit_length())
    for k in range(depth - 1):
        below = F.col(f"l{k}")
        one = one.withColumn(f"l{k + 1}", F.when(F.size(below) > 1, _halved(below)))

    def path(own: Column) -> Column:
        steps = []
        for k in range(depth):
            at = F.shiftright(own, k)
            other = F.get(F.col(f"l{k}"), at.bitwiseXOR(F.lit(1)))
            steps.append(F.when(other.isNotNull(), F.struct(F.when(at % 2 == 0, "right").otherwise("left").alias("side"), other.alias("hash"))))
        return F.array_compact(F.array(*steps)).cast(PATH)

    each = F.transform("own", lambda s, i: F.when(s["asked"], F.struct(s["event_id"].alias("event_id"), s["hash"].alias("leaf"), path(i).alias("proof"))))
    return one.select(*by, F.explode(F.array_compact(each)).alias("e")).select(*by, "e.event_id", "e.leaf", "e.proof")


def asked_for(tree: DataFrame, events: DataFrame) -> DataFrame:
    """``tree`` with ``asked``: whether a leaf is one of ``events(event_id)``."""
    own = events.select("event_id").distinct().withColumn("_asked", F.lit(True))
    return tree.join(own, "event_id", "left").withColumn("asked", F.coalesce("_asked", F.lit(False))).drop("_asked")


def proofs(tree: DataFrame, events: DataFrame, block: int = BLOCK) -> DataFrame:
    """(event_id, height, leaf, proof) for all of ``events(event_id)``: siblings with their sides, from the leaf up."""
    return paths(asked_for(tree, events), ("height",), block).select("event_id", "height", "leaf", "proof")


def check_proofs(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Whether each proof leads from its leaf to its block's root."""
    up = F.aggregate("proof", F.col("leaf"), lambda acc, s: F.when(s["side"] == "right", node_hash(acc, s["hash"])).otherwise(node_hash(s["hash"], acc)))
    return found.join(blocks.select("height", "merkle_root"), "height").withColumn("valid", up == F.col("merkle_root"))


def status(blocks: DataFrame) -> DataFrame:
    """I7."""
    return blocks.agg(F.count("*").alias("blocks"), F.sum("event_count").alias("events"), F.max_by("hash", "height").alias("head"))


def match_raw(raw: DataFrame, log: DataFrame) -> DataFrame:
    """I8: which stored event each original line ``raw(source_file, source_record, raw)`` became."""
    own = raw.withColumn("raw_hash", F.sha2(F.encode("raw", "UTF-8"), 256)).drop("raw")
    return own.join(log.select("raw_hash", "id"), "raw_hash", "left").select("source_file", "source_record", "raw_hash", F.col("id").alias("event_id"))
