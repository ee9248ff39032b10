"""Stored inverted indexes, of words with frequencies or of n-grams, appended by batch and merged.

``<path>/postings/generation=<id>`` has a row for each term and text that holds it, under a bucket of the term's hash and sorted by term, so
a query opens the folders of its terms' buckets and, by the statistics of files, the row groups of its terms. A term
with very many texts is spread over files, as the order they are dealt by goes on with the key. Of n-grams, which nearly every text shares, a row holds all
texts of a segment of SEGMENT texts: their numbers in two bytes each, or a bit for each text; ``texts`` has the key of each number. ``terms`` has the number of texts of each term, and
``stats`` the number of texts and of words of the batch. Which generations are read is a small file that is replaced as a whole:
a batch that is indexed again under its name replaces itself, and merging changes nothing for readers.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.storage import read_text, replace_text, stored

from .retrieval import tokens

#: Folders of terms, and n-grams by which a substring is looked up, the rarest.
BUCKETS, RAREST = 64, 3


#: Texts of a segment, as a power of two, letters taken at a time, and texts of a segment from which bits take no more room than numbers.
BITS, TAKEN = 16, 1 << 22
SEGMENT, DENSE = 1 << BITS, 1 << BITS - 4
#: Rows of a batch given to Spark.
BATCH = 2_000


def grams(texts: list[str], numbers: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Different strings of one to three letters of the texts, each with the numbers, below SEGMENT, of the texts that hold it."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    letters, coded = np.unique(points, return_inverse=True)
    if len(letters) >= SEGMENT:  # a string and a number would not go into eight bytes
        if len(texts) == 1:
            own = {texts[0][i : i + n] for n in (1, 2, 3) for i in range(len(texts[0]) - n + 1)}
            yield from ((t, numbers) for t in own)
        else:
            half = len(texts) // 2
            yield from grams(texts[:half], numbers[:half])
            yield from grams(texts[half:], numbers[half:])
        return
    lengths = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(numbers.astype(np.uint64), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))
    for n in (1, 2, 3):
        at = np.flatnonzero(left >= n)
        key = np.zeros(len(at), np.uint64)
        for k in range(n):
            key = key * np.uint64(len(letters)) + coded[at + k].astype(np.uint64)
        both = np.unique(key * np.uint64(SEGMENT) + owner[at])
        key, held = both // np.uint64(SEGMENT), (both % np.uint64(SEGMENT)).astype(np.uint16)
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)) if len(key) else []
        start = 0
        for end in ends:
            code, term = int(key[start]), ""
            for _ in range(n):
                code, letter = divmod(code, len(letters))
                term = chr(letters[letter]) + term
            yield term, held[start:end]
            start = end


def packed(numbers: np.ndarray) -> bytes:
    """Different numbers below SEGMENT, in order."""
    if len(numbers) < DENSE:
        return numbers.astype("<u2").tobytes()
    return np.packbits(np.bincount(numbers, minlength=SEGMENT).astype(bool)).tobytes()


def bits(held: bytes) -> np.ndarray:
    if len(held) == SEGMENT // 8:
        return np.unpackbits(np.frombuffer(held, np.uint8)).astype(bool)
    out = np.zeros(SEGMENT, bool)
    out[np.frombuffer(held, "<u2")] = True
    return out


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, segment, texts, held) of rows (_row, text); a segment may be given in parts."""
    texts, rows, size = [], [], 0

    def give() -> Iterator[pa.RecordBatch]:
        found = grams(texts, np.array(rows, np.int64) % SEGMENT)
        while part := [x for _, x in zip(range(BATCH), found)]:
            yield pa.RecordBatch.from_pydict({"term": [t for t, _ in part], "segment": pa.array([rows[0] // SEGMENT] * len(part), pa.int64()), "texts": pa.array([len(n) for _, n in part], pa.int64()), "held": pa.array([packed(n) for _, n in part], pa.binary())})

    for b in batches:
        for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if rows and (row // SEGMENT != rows[0] // SEGMENT or size > TAKEN):
                yield from give()
                texts, rows, size = [], [], 0
            texts.append(text)
            rows.append(row)
            size += len(text)
    if rows:
        yield from give()


def shared(asked: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (source, segment, number) of the texts that hold all ``asked`` terms, of rows (source, segment, parts), parts of (term, held)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, segment, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                each: dict[str, np.ndarray] = {}
                for p in parts:
                    each[p["term"]] = each.get(p["term"], False) | bits(p["held"])
                if len(each) == asked:
                    found = np.flatnonzero(np.logical_and.reduce(list(each.values())))
                    yield pa.RecordBatch.from_pydict({"source": [source] * len(found), "segment": pa.array([segment] * len(found), pa.int64()), "number": pa.array(found, pa.int64())})

    return run


KINDS: dict[str, Callable[[Column], Column] | None] = {"words": tokens, "grams": None}


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass
class TextIndex:
    """An index at ``path`` of texts known by the columns ``key``; ``held`` are further columns that postings carry."""

    spark: SparkSession
    path: str
    kind: str
    key: tuple[str, ...]
    held: tuple[str, ...] = ()
    buckets: int = BUCKETS

    def _live(self) -> dict[str, str]:
        """The generation of each batch."""
        return json.loads(read_text(self.spark, f"{self.path}/live.json") or "{}")

    def _commit(self, live: dict[str, str]) -> None:
        replace_text(self.spark, f"{self.path}/live.json", json.dumps(live, sort_keys=True))

    def _read(self, what: str) -> DataFrame:
        live = sorted(set(self._live().values()))
        if not live:
            raise ValueError(f"{self.path} holds no batch")
        top = f"{self.path}/{what}"
        return self.spark.read.option("basePath", top).parquet(*(f"{top}/generation={g}" for g in live))

    def _place(self, what: str, generation: str) -> str:
        return f"{self.path}/{what}/generation={generation}"

    def append(self, rows: DataFrame, text: str, batch: str) -> None:
        """Adds the texts of a batch; a batch of this name that is there already is replaced."""
        new = uuid.uuid4().hex
        if self.kind == "grams":
            self._append_grams(rows, text, new)
            self._commit({**self._live(), batch: new})
            return
        own = rows.select(*self.key, *self.held, F.monotonically_increasing_id().alias("_row"), KINDS[self.kind](F.coalesce(F.col(text), F.lit(""))).alias("t"))
        flat = own.select("_row", *self.key, *self.held, F.size("t").alias("length"), F.explode("t").alias("term"))
        # a text's own words meet in its task before they move
        postings = flat.groupBy("_row", "term", "length", *self.key, *self.held).agg(F.count("*").cast("int").alias("tf")).drop("_row")
        self._write(postings, new)
        own.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("words")).write.parquet(self._place("stats", new))
        self._commit({**self._live(), batch: new})

    def _append_grams(self, rows: DataFrame, text: str, new: str) -> None:
        # numbered once and stored, as postings and keys must agree
        own = rows.select(*self.key, *self.held, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"), F.monotonically_increasing_id().alias("_row"))
        own = stored(own, "numbered")
        keys = own.select(F.lit(new).alias("source"), F.shiftright("_row", BITS).alias("segment"), (F.col("_row") % SEGMENT).alias("number"), *self.key, *self.held)
        keys.write.parquet(self._place("texts", new))
        found = own.select("_row", "text").mapInArrow(segments, "term string, segment long, texts long, held binary")
        self._write_grams(found.withColumn("source", F.lit(new)), new)

    def _write_grams(self, postings: DataFrame, new: str) -> None:
        bucket = bucket_of(F.col("term"), self.buckets)
        dealt = postings.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "term")
        dealt.write.partitionBy("bucket").parquet(self._place("postings", new))
        counts = self.spark.read.parquet(self._place("postings", new)).groupBy("bucket", "term").agg(F.sum("texts").alias("texts"))
        counts.repartition("bucket").sortWithinPartitions("term").write.partitionBy("bucket").parquet(self._place("terms", new))

    def _write(self, postings: DataFrame, new: str) -> None:
        bucket = bucket_of(F.col("term"), self.buckets)
        # by range, so that a term of very many texts is not one task's
        dealt = postings.withColumn("bucket", bucket).repartitionByRange("bucket", "term", *self.key).sortWithinPartitions("bucket", "term", *self.key)
        dealt.write.partitionBy("bucket").parquet(self._place("postings", new))
        counts = self.spark.read.parquet(self._place("postings", new)).groupBy("term").agg(F.count("*").alias("texts")).withColumn("bucket", bucket)
        counts.repartition("bucket").sortWithinPartitions("term").write.partitionBy("bucket").parquet(self._place("terms", new))

    def merge(self, name: str = "merged") -> None:
        """All batches as one generation, under the name ``name``."""
        new = uuid.uuid4().hex
        if self.kind == "grams":
            self._read("texts").drop("generation").write.parquet(self._place("texts", new))
            self._write_grams(self._read("postings").drop("bucket", "generation"), new)
            self._commit({name: new})
            return
        self._write(self._read("postings").drop("bucket", "generation"), new)
        self._read("stats").agg(F.sum("texts").alias("texts"), F.sum("words").alias("words")).coalesce(1).write.parquet(self._place("stats", new))
        self._commit({name: new})

    def _of(self, what: str, terms: list[str]) -> DataFrame:
        """Rows of some terms: folders by bucket, row groups by term."""
        buckets = sorted({r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t"), self.buckets)).collect()})  # terms of a query
        return self._read(what).where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def postings(self, terms: list[str]) -> DataFrame:
        return self._of("postings", terms)

    def keywords(self, query: str, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """R2: BM25 over the words of ``query`` longer than two letters, from their postings alone."""
        asked = sorted(set(re.findall(r"[a-z0-9]{3,}", query.lower())))
        stats = self._read("stats").agg(F.sum("texts").alias("docs"), (F.sum("words") / F.sum("texts")).alias("mean"))
        found = self.postings(asked) if asked else self._read("postings").limit(0)
        df = (self._of("terms", asked) if asked else self._read("terms").limit(0)).groupBy("term").agg(F.sum("texts").alias("df"))  # words of the query
        idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
        scored = found.join(F.broadcast(df), "term").join(F.broadcast(stats)).groupBy(*self.key).agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("words"))
        return scored.orderBy(F.desc("score"), *self.key).limit(k)

    def holding(self, part: str) -> DataFrame:
        """Keys of the texts that may hold ``part`` in any case: those that hold its rarest n-grams. What is left
        to compare is for the caller, who has the texts."""
        low = part.lower()
        n = min(3, len(low))
        asked = sorted({low[i : i + n] for i in range(len(low) - n + 1)})
        if not asked:
            raise ValueError("nothing to look for")
        counts = {r.term: r.n for r in self._of("terms", asked).groupBy("term").agg(F.sum("texts").alias("n")).collect()}  # n-grams of a query
        rarest = sorted(asked, key=lambda t: (counts.get(t, 0), t))[:RAREST]
        # a row for each segment, with a part for each of these n-grams, 8 KB at most
        parts = self.postings(rarest).groupBy("source", "segment").agg(F.collect_list(F.struct("term", "held")).alias("parts"))
        found = parts.mapInArrow(shared(len(rarest)), "source string, segment long, number long")
        return self._read("texts").join(found, ["source", "segment", "number"], "left_semi").select(*self.key, *self.held)


def search_messages(index: TextIndex, log: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """As ``retrieval.substring_search``, of the events that the index names alone."""
    from .retrieval import longest_word

    word = longest_word(query)
    near = log.join(index.holding(word), list(index.key), "left_semi").where(F.lower("message").contains(word))
    return near.select("id", "timestamp", "hostname", "severity", "severity_score", "message").orderBy("severity_score", "timestamp", "id").limit(limit)


def index_nodes(nodes: DataFrame, path: str, batch: str = "all") -> TextIndex:
    """An n-gram index of nodes by their names; postings carry the node itself."""
    out = TextIndex(nodes.sparkSession, path, "grams", ("label", "value"))
    out.append(nodes.select("label", "value").distinct(), "value", batch)
    return out


def resolve(index: TextIndex, name: str, limit: int = 5) -> DataFrame:
    """Nodes of a name: exact ones, or those that hold it in any case if there are none, from the postings of the
    name's rarest n-grams."""
    near = index.holding(name).distinct()
    def first(rows: DataFrame, exact: bool) -> DataFrame:
        return rows.select("label", "value", F.lit(exact).alias("exact")).orderBy("label", "value").limit(limit)

    same = first(near.where(F.col("value") == name), True)
    alike = first(near.where(F.instr(F.lower("value"), name.lower()) > 0), False)
    none = same.agg((F.count("*") == 0).alias("none"))
    return same.unionByName(alike.join(F.broadcast(none)).where("none").drop("none")).orderBy("label", "value")
