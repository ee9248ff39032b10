"""I2, I3, I5, growing: a ledger of sealed batches under a Merkle mountain range.

A batch of events is ordered and dealt to blocks as before; block roots are folded level by level on the executors to one root, by the rule
by which a block folds its leaves, so a batch's root is that of the plain tree over its blocks. Headers of batches form a chain,
and their hashes are the leaves of a mountain range: perfect trees of falling size, one for each binary digit of
their number. Sealing reads the new events and the last header and touches nothing else; the driver sees a row for each batch. The
range's root commits to all batches, and a short proof shows that one range is the beginning of another.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.schema import GENESIS
from logweave.storage import stored

from .ledger import BLOCK, PATH, VERSION, _halved, asked_for, leaves, node_hash, paths

#: Nodes that are folded as one array: 2 to the power of this.
FOLD = 9
SCHEMA = "batch long, version string, prev_hash string, merkle_root string, block_count long, event_count long, sealed_at string, hash string, peaks array<string>"


def join(left: str, right: str) -> str:
    return hashlib.sha256(b"\x01" + bytes.fromhex(left) + bytes.fromhex(right)).hexdigest()


def header_hash(header: dict) -> str:
    names = ("version", "batch", "prev_hash", "merkle_root", "block_count", "event_count", "sealed_at")
    return hashlib.sha256(json.dumps({n: header[n] for n in names}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


# --- the mountain range over hashes of headers, which are few
def sizes(n: int) -> list[int]:
    """Sizes of the perfect trees over n leaves, falling."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def add_leaf(peaks: list[str], n: int, leaf: str) -> list[str]:
    """Peaks over n + 1 leaves from those over n."""
    out = [*peaks, leaf]
    while n & 1:
        right, left = out.pop(), out.pop()
        out.append(join(left, right))
        n >>= 1
    return out


def bagged(peaks: list[str]) -> str:
    """The root of a range: its peaks joined from the smallest on."""
    if not peaks:
        return GENESIS
    root = peaks[-1]
    for p in reversed(peaks[:-1]):
        root = join(p, root)
    return root


def tree(leaf: list[str]) -> str:
    """The root of a perfect tree."""
    while len(leaf) > 1:
        leaf = [join(a, b) for a, b in zip(leaf[::2], leaf[1::2], strict=True)]
    return leaf[0]


def consistency(hashes: list[str], n: int) -> tuple[list[str], list[str]]:
    """Proof that the range over the first n of ``hashes`` is the beginning of that over all: the peaks over n, and the roots of
    the perfect trees that are added to them, from left to right."""
    if not 0 <= n <= len(hashes):
        raise ValueError("no such range")
    peaks, at = [], 0
    for size in sizes(n):
        peaks.append(tree(hashes[at : at + size]))
        at += size
    added = []
    while at < len(hashes):
        # the largest perfect tree that may stand here
        size = at & -at if at else 1 << (len(hashes).bit_length() - 1)
        while at + size > len(hashes):
            size >>= 1
        added.append(tree(hashes[at : at + size]))
        at += size
    return peaks, added


def consistent(old_root: str, n: int, new_root: str, total: int, proof: tuple[list[str], list[str]]) -> bool:
    """Whether ``proof`` leads from the root over n leaves to that over ``total``."""
    peaks, added = proof
    if len(peaks) != len(sizes(n)) or bagged(peaks) != old_root:
        return False
    stack, at, rest = list(zip(peaks, sizes(n), strict=True)), n, list(added)
    while at < total:
        if not rest:
            return False
        size = at & -at if at else 1 << (total.bit_length() - 1)
        while at + size > total:
            size >>= 1
        stack.append((rest.pop(0), size))
        at += size
        while len(stack) > 1 and stack[-1][1] == stack[-2][1]:
            (right, k), (left, _) = stack.pop(), stack.pop()
            stack.append((join(left, right), 2 * k))
    return not rest and [s for _, s in stack] == sizes(total) and bagged([h for h, _ in stack]) == new_root


# --- folding on the executors
def fold(nodes: DataFrame, by: tuple[str, ...], largest: int) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (by, hash) of the trees over ``nodes(by, idx, hash)``, an odd last node promoted, none with more than ``largest``
    leaves; and the nodes (by, level, idx, hash) of all levels. FOLD levels at a time: 2^FOLD nodes at most are one array."""
    now, level, parts = nodes.select(*by, "idx", "hash"), 0, []
    while True:
        ordered = F.array_sort(F.collect_list(F.struct("idx", "hash")))  # 2^FOLD at most
        arrays = now.groupBy(*by, F.shiftright("idx", FOLD).alias("_g")).agg(F.transform(ordered, lambda s: s["hash"]).alias("_l0"))
        for k in range(FOLD):
            below = F.col(f"_l{k}")
            arrays = arrays.withColumn(f"_l{k + 1}", F.when(F.size(below) > 1, _halved(below)).otherwise(below))
        every = F.array(*(F.struct(F.lit(level + k).alias("level"), F.lit(FOLD - k).alias("shift"), F.col(f"_l{k}").alias("nodes")) for k in range(FOLD)))
        each = arrays.select(*by, "_g", F.explode(every).alias("_e")).select(*by, "_g", "_e.level", "_e.shift", F.posexplode("_e.nodes").alias("_i", "hash"))
        parts.append(each.select(*by, "level", (F.expr("shiftleft(_g, shift)") + F.col("_i")).alias("idx"), "hash"))
        now, level = arrays.select(*by, F.col("_g").alias("idx"), F.col(f"_l{FOLD}")[0].alias("hash")), level + FOLD
        largest = -(-largest // (1 << FOLD))
        if largest <= 1:
            return now.select(*by, "hash"), parts


def block_roots(tree_of: DataFrame, block: int) -> DataFrame:
    return fold(tree_of, ("batch", "height"), block)[0].withColumnsRenamed({"height": "idx"})


@dataclass
class Ledger:
    spark: SparkSession
    path: str
    block: int = BLOCK

    def headers(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", True).json(f"{self.path}/headers")

    def _last(self):
        """The last header, or None: headers are the last thing that sealing writes."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/headers")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.headers().orderBy(F.desc("batch")).limit(1).first()

    def leaves(self) -> DataFrame:
        """(batch, height, idx, event_id, hash)."""
        return self.spark.read.parquet(f"{self.path}/leaves")

    def blocks(self) -> DataFrame:
        """(batch, idx, hash)."""
        return self.spark.read.parquet(f"{self.path}/blocks")

    def seal(self, log: DataFrame, sealed_at: str) -> dict:
        """Seals ``log`` as the next batch. A batch that was not finished is written again."""
        last = self._last()
        n = 0 if last is None else last.batch + 1
        place = f"batch={n}"
        leaves(log, self.block).write.mode("overwrite").parquet(f"{self.path}/leaves/{place}")
        own = self.spark.read.parquet(f"{self.path}/leaves/{place}").withColumn("batch", F.lit(n).cast("long"))
        block_roots(own, self.block).drop("batch").write.mode("overwrite").parquet(f"{self.path}/blocks/{place}")
        blocks = self.spark.read.parquet(f"{self.path}/blocks/{place}").withColumn("batch", F.lit(n).cast("long"))
        events, count = own.count(), blocks.count()
        if not count:
            raise ValueError("nothing to seal")
        root = fold(blocks, ("batch",), count)[0].first().hash
        header = {
            "batch": n, "version": VERSION, "prev_hash": GENESIS if last is None else last.hash, "merkle_root": root,
            "block_count": count, "event_count": events, "sealed_at": sealed_at,
        }
        header["hash"] = header_hash(header)
        header["peaks"] = add_leaf([] if last is None else list(last.peaks), n, header["hash"])
        self.spark.createDataFrame([header], SCHEMA).coalesce(1).write.mode("overwrite").json(f"{self.path}/headers/batch={n}")
        return header

    def root(self, n: int | None = None) -> str:
        """The range's root over all batches, or over the first n."""
        rows = self.headers()
        last = (rows if n is None else rows.where(F.col("batch") == n - 1)).orderBy(F.desc("batch")).limit(1).first()
        return GENESIS if last is None else bagged(list(last.peaks))

    def proof_of_beginning(self, n: int) -> tuple[list[str], list[str]]:
        return consistency([r.hash for r in self.headers().orderBy("batch").select("hash").collect()], n)  # a row for each batch

    def verify(self) -> DataFrame:
        """(batch, kind) of all that is wrong: roots from the leaves on, counts, links, headers and peaks. Roots of all
        batches are made in one go; the chain is read header by header."""
        most = self.headers().agg(F.max("block_count")).first()[0] or 1
        all_leaves = self.leaves().withColumn("batch", F.col("batch").cast("long"))
        made = fold(block_roots(all_leaves, self.block), ("batch",), most)[0].join(all_leaves.groupBy("batch").agg(F.count("*").alias("n")), "batch")
        heads = self.headers().join(made.select("batch", F.col("hash").alias("_root"), "n"), "batch", "left").orderBy("batch").collect()  # a row for each batch
        found, prev, peaks = [], GENESIS, []
        for r in heads:
            peaks = add_leaf(peaks, r.batch, r.hash)
            wrong = {
                "merkle_mismatch": r._root != r.merkle_root, "count_mismatch": (r.n or 0) != r.event_count, "broken_link": r.prev_hash != prev,
                "header_altered": header_hash(r.asDict()) != r.hash, "range_mismatch": list(r.peaks) != peaks,
            }
            found += [(r.batch, kind) for kind, is_so in wrong.items() if is_so]
            prev = r.hash
        return self.spark.createDataFrame(found, "batch long, kind string")

    def proofs(self, events: DataFrame) -> DataFrame:
        """(event_id, batch, leaf, proof, merkle_root): from each event's leaf through its block to its batch's root. Paths within a block are
        taken from its arrays; those from a block up are found once for all of its events."""
        all_leaves, blocks = (x.withColumn("batch", F.col("batch").cast("long")) for x in (self.leaves(), self.blocks()))
        found = stored(paths(asked_for(all_leaves, events), ("batch", "height"), self.block), "paths")
        heads = self.headers().select("batch", "merkle_root", "block_count")  # a row for each batch
        most = heads.agg(F.max("block_count")).first()[0] or 1
        wanted = found.select("batch", "height").distinct()
        upper = fold(blocks.join(wanted.select("batch").distinct(), "batch", "left_semi"), ("batch",), most)[1]
        every = reduce(DataFrame.unionByName, upper)
        depth = max(1, (most - 1).bit_length())
        at = wanted.select("batch", "height", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level"))
        at = at.withColumn("_at", F.expr("shiftright(height, level)")).withColumn("idx", F.col("_at").bitwiseXOR(F.lit(1)))
        side = F.when(F.col("_at") % 2 == 0, "right").otherwise("left").alias("side")
        steps = at.join(every.select("batch", "level", "idx", "hash"), ["batch", "level", "idx"]).select("batch", "height", "level", side, "hash")
        path = F.transform(F.array_sort(F.collect_list(F.struct("level", "side", "hash"))), lambda s: F.struct(s["side"].alias("side"), s["hash"].alias("hash")))
        above = steps.groupBy("batch", "height").agg(path.alias("_above"))
        both = found.join(above, ["batch", "height"], "left").join(F.broadcast(heads.drop("block_count")), "batch")
        return both.select("event_id", "batch", "leaf", F.concat("proof", F.coalesce("_above", F.array().cast(PATH))).alias("proof"), "merkle_root")


def check(proofs: DataFrame) -> DataFrame:
    """Whether each proof leads from its leaf to its batch's root."""
    up = F.aggregate("proof", F.col("leaf"), lambda acc, s: F.when(s["side"] == "right", node_hash(acc, s["hash"])).otherwise(node_hash(s["hash"], acc)))
    return proofs.withColumn("valid", up == F.col("merkle_root"))
