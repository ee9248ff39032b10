"""Edges stored once, both ways, by node, and searched from there.

A node's edges lie in the folder of its hash, sorted by node; rows are dealt by ranges that go on with the neighbour, so a hub's edges are
many row groups of several files and a step from it many tasks. A step opens the folders of its frontier's nodes alone. A
frontier of up to FEW nodes is broadcast, a larger one is joined by shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.storage import stored

from .graph import both_ways

BUCKETS, FEW = 64, 100_000
NODE = ("label", "value")


def bucket_of(label, value, buckets: int):
    return F.pmod(F.xxhash64(label, value), F.lit(buckets)).cast("int")


@dataclass
class EdgeStore:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    @classmethod
    def build(cls, edges: DataFrame, path: str, buckets: int = BUCKETS) -> EdgeStore:
        """Stores ``edges(src_label, src, rel, dst_label, dst)``, each once."""
        steps = both_ways(edges).distinct().withColumn("bucket", bucket_of("a_label", "a", buckets))
        order = ("bucket", "a_label", "a", "b_label", "b")
        steps.repartitionByRange(*order).sortWithinPartitions(*order, "rel").write.partitionBy("bucket").parquet(path)
        return cls(edges.sparkSession, path, buckets)

    def _nodes(self, rows: list[tuple[str, str]]) -> DataFrame:
        return self.spark.createDataFrame(rows, "label string, value string")

    def step(self, frontier: DataFrame) -> DataFrame:
        """The edges (a_label, a, rel, b_label, b) of the nodes of ``frontier(label, value)``, which is stored."""
        few = frontier.limit(FEW + 1).count() <= FEW
        own = frontier.select(F.col("label").alias("a_label"), F.col("value").alias("a"), bucket_of("label", "value", self.buckets).alias("bucket"))
        steps = self.spark.read.parquet(self.path)
        if not few:
            return steps.join(own, ["bucket", "a_label", "a"]).drop("bucket")
        folders = [r.bucket for r in own.select("bucket").distinct().collect()]  # as many as there are folders
        return steps.where(F.col("bucket").isin(folders)).join(F.broadcast(own), ["bucket", "a_label", "a"]).drop("bucket")

    def _ahead(self, frontier: DataFrame, seen: DataFrame) -> DataFrame:
        near = self.step(frontier).select(F.col("b_label").alias("label"), F.col("b").alias("value")).distinct()
        return stored(near.join(seen, list(NODE), "left_anti"), "frontier")

    def neighbours(self, label: str, value: str, hops: int = 2) -> DataFrame:
        """Nodes within ``hops`` (1 to 3) undirected steps and the least number of them."""
        frontier = self._nodes([(label, value)])
        reached = frontier.withColumn("hop", F.lit(0))
        for hop in range(1, max(1, min(hops, 3)) + 1):
            frontier = self._ahead(frontier, reached.select(*NODE))
            reached = reached.unionByName(frontier.withColumn("hop", F.lit(hop)))
        return reached.where("hop > 0")

    def shortest_path(self, start: tuple[str, str], end: tuple[str, str], max_hops: int = 6) -> DataFrame:
        """The shortest undirected path, the first in order of its nodes, as nodes and relationships.

        Layers of nodes are taken from both ends, always on the side whose last layer is smaller, until they meet: a hub in the
        middle is met from both sides and not walked through. Nodes between the ends that no shortest path has are then left out from
        the meeting on, and the first path is read from its start, one node at a time.
        """
        schema = "nodes array<string>, rels array<string>, hops int"
        if start == end:
            return self.spark.createDataFrame([([":".join(start)], [], 0)], schema)
        sides = [[self._nodes([start])], [self._nodes([end])]]
        sizes, meeting = [1, 1], None
        while len(sides[0]) + len(sides[1]) - 2 < max_hops and meeting is None:
            k = 0 if sizes[0] <= sizes[1] else 1
            seen = sides[k][0]
            for layer in sides[k][1:]:
                seen = seen.unionByName(layer)
            ahead = self._ahead(sides[k][-1], seen)
            sizes[k] = ahead.count()
            if not sizes[k]:
                break
            sides[k].append(ahead)
            both = ahead.join(sides[1 - k][-1], list(NODE), "left_semi")
            meeting = None if both.isEmpty() else stored(both, "meeting")
        if meeting is None:
            return self.spark.createDataFrame([], schema)
        # layers of the shortest paths, from the start to the end
        layers = [meeting]
        for k, add in ((0, lambda x: layers.insert(0, x)), (1, layers.append)):
            now = meeting
            for layer in reversed(sides[k][:-1]):
                near = self.step(now).select(F.col("b_label").alias("label"), F.col("b").alias("value")).distinct()
                now = stored(near.join(layer, list(NODE), "left_semi"), "layer")
                add(now)
        at, nodes, rels = start, [":".join(start)], []
        for layer in layers[1:]:
            ahead = self.step(self._nodes([at])).join(layer, (F.col("b_label") == layer["label"]) & (F.col("b") == layer["value"]), "left_semi")
            r = ahead.select("b_label", "b", "rel").orderBy(F.concat_ws(":", "b_label", "b"), "rel").limit(1).first()
            at = (r.b_label, r.b)
            nodes.append(":".join(at))
            rels.append(r.rel)
        return self.spark.createDataFrame([(nodes, rels, len(rels))], schema)

    def blast_radius(self, names, name: str, hops: int = 2) -> DataFrame:
        """What lies around the first node of a name in ``names``, an index of nodes."""
        from .textindex import resolve

        first = resolve(names, name, 1).first()
        return self.neighbours(first["label"], first["value"], hops) if first else self._nodes([]).withColumn("hop", F.lit(0))
