"""Exact removal of long strings that are found more than once, by sorted suffixes.

A string of ``LENGTH`` bytes is repeated if it starts at two places of the input. Every byte that a
repeated string covers is removed, judged on the input as it is.

1. Anchors. Of the ``GRAM``-byte strings in each window of LENGTH bytes, the one with the least
   hash is its anchor. Equal windows have equal anchors at equal offsets, so repeated strings meet
   under their anchors, and windows whose anchor is found once are out.
2. Fragments. A run of windows with one anchor, and the text they cover, is a fragment. Equal
   fragments are collapsed into one before they move; an anchor with a single fragment that occurs
   twice or more is repeated throughout.
3. Suffixes. The fragments of the other anchors go to shards, where external induced sorting
   (see ``induced``) gives suffix order and common prefixes; a start whose common prefix with a
   neighbour is at least LENGTH is repeated. A fragment that shares no context of its anchor
   with another is left out before.
4. Repeated starts become byte ranges of their texts, and these are cut out.

Texts are shuffled only to meet what was found in them, and only those that a filter of the keys found lets through:
a text without repeated anchors stays where it lies, and so does a row without a range to cut.

Anchors are sorted by hash to find those of two places and more, but for the few that stand at very many: their places are
counted before anything moves, and told apart by text and place, so that no task reads all places of one anchor.
An anchor under which very many fragments meet is dealt by its contexts instead: windows whose
anchor stands at ``lo`` to ``hi`` bytes from their start all hold the same LENGTH - (hi - lo) bytes
around it, and meet under these. A context with more than HOT different fragments is dealt again
by fewer offsets and more bytes, down to one offset, where the context is the window itself; so no
group that is sorted is larger than that. A fragment that a task meets again is repeated and needs no more:
its place is given at once, and only a task's first place of each fragment is shuffled. What is decided on a
fragment is joined to these places, one row for each.
Equal texts are counted by their SHA-256 and count as repeated where they are at least LENGTH long.

Defined results: a null text counts as empty and has nothing to remove; shorter texts have nothing
to remove; rows are documents of their own, so that a repeated row repeats its text; a null id is
kept; an empty table gives an empty result. Matches never cross rows.
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
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import configure, fields, map_rows, sha, stored
from .induced import repeated_starts

LENGTH, GRAM = 200, 64
#: Places under one anchor, and different fragments of one context, from which they are dealt by contexts.
HOT = 4096
#: Anchors with more than this share of all places (and than HOT) are kept out of the sorted stream.
COMMON = 20_000
#: Bytes from which a shard is sorted; it is larger by one group (of HOT fragments) at most.
SHARD = 1_500_000
_SIDE = (LENGTH - GRAM) // 2
_TABLE = np.random.default_rng(7_001).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each string of GRAM bytes (a power of two)."""
    h, power, span = _TABLE[data], _A, 1
    while span < GRAM:
        h = h[:-span] * power + h[span:]
        power, span = power * power, span * 2
    h = (h ^ (h >> np.uint64(31))) * _B
    return h ^ (h >> np.uint64(29))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    pad = np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([x, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(text: bytes, step: int = 1 << 20) -> list[tuple[int, int, int, int]]:
    """(hash, place, first window, last window) of each anchor, windows by their starts."""
    out = []
    for at in range(0, len(text) - LENGTH + 1, step):
        part = np.frombuffer(text, np.uint8, min(step + LENGTH - 1, len(text) - at), at)
        with np.errstate(over="ignore"):
            h = gram_hashes(part)
        # the least by the upper half of the hash, the leftmost of equal ones
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        place = (sliding_least(key, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.r_[0, np.flatnonzero(np.diff(place)) + 1]
        last = np.r_[first[1:] - 1, len(place) - 1]
        own = place[first]
        out += zip(h[own].astype(np.int64).tolist(), (own + at).tolist(), (first + at).tolist(), (last + at).tolist(), strict=True)
    return out


ANCHOR = fields(h=LongType(), t1=LongType(), t2=LongType(), place=LongType())
REPEATED = fields(t1=LongType(), t2=LongType(), h=LongType(), place=LongType(), hot=BooleanType())


def repeated(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of anchors sorted by hash, text and place, those found at two or more places.

    What is held of a group are ``most`` rows; from then on its rows are passed on as hot.
    """
    schema = to_arrow_schema(REPEATED)
    held = np.zeros((0, 4), np.int64)
    hot = None

    def give(rows, flag):
        return pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 0, 3)] + [pa.array(np.broadcast_to(flag, len(rows)))], schema=schema)

    def settle(rows):
        """Groups that are complete."""
        if len(rows):
            first = np.r_[True, rows[1:, 0] != rows[:-1, 0]]
            group = np.cumsum(first) - 1
            size = np.bincount(group)[group]
            keep = size > 1
            return give(rows[keep], size[keep] > most)
        return None

    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
        rows = np.concatenate([held, rows])
        rows = rows[np.r_[True, np.any(rows[1:] != rows[:-1], axis=1)]]
        if hot is not None:
            more = rows[:, 0] == hot
            if more.any():
                yield give(rows[more], True)
            rows = rows[~more]
            if len(rows):
                hot = None
        if not len(rows):
            held = rows
            continue
        last = rows[:, 0] == rows[-1, 0]
        if (done := settle(rows[~last])) is not None:
            yield done
        held = rows[last]
        if len(held) > most:
            yield give(held, True)
            hot, held = held[0, 0], held[:0]
    if (done := settle(held)) is not None:
        yield done


#: A fragment of a hot anchor: the least offset of its windows (the greatest is ``hi``), their context, and the fragment.
KEY = ("h", "lo", "context", "digest")
PIECE = fields(h=LongType(), lo=IntegerType(), context=LongType(), digest=LongType(), hi=IntegerType(), place=IntegerType(), data=BinaryType())
#: A place of a fragment, without context if its anchor is not hot; without place, that its task met the fragment
#: again; without fragment, a range of bytes to remove.
FRAGMENT = StructType([*PIECE.fields, *fields(t1=LongType(), t2=LongType(), start=LongType(), end=LongType(), again=BooleanType()).fields])
LINK = StructType([*FRAGMENT.fields[:7], *fields(lo0=IntegerType(), context0=LongType(), digest0=LongType(), shift=IntegerType(), many=BooleanType()).fields])


def short_hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def digest_of(data: bytes, place: int) -> int:
    return short_hash(data, str(place).encode())


def by_context(data: bytes, place: int, lo: int, hi: int, parts: int) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(lo, hi, context, start, anchor's place, bytes) of the fragments of a fragment whose anchor is
    ``lo`` to ``hi`` bytes from the starts of its windows, with these offsets in ``parts`` parts."""
    cuts = [lo + (hi - lo + 1) * k // parts for k in range(parts + 1)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        first, last = max(0, place - b + 1), min(len(data) - LENGTH, place - a)
        if a < b and first <= last:
            yield a, b - 1, short_hash(data[place - a : place - b + 1 + LENGTH]), first, place - first, data[first : last + LENGTH]


def fragments():
    """Rows of FRAGMENT for texts with their repeated anchors; equal texts and the bytes of a fragment come
    once a task."""
    sent: set[tuple[int, ...]] = set()
    seen: set[tuple[int, int]] = set()
    met: dict[tuple[int, ...], bool] = {}

    def once(held, key):
        if key in held:
            return False
        if len(held) > 1_000_000:
            held.clear()
        held.add(key)
        return True

    def work(t1s, t2s, texts, lists):
        out = []
        for t1, t2, text, own in zip(t1s, t2s, texts, lists, strict=True):
            if not once(seen, (t1, t2)):
                continue
            wanted = {a["place"]: a["hot"] for a in own}
            for h, place, first, last in anchors(text):
                hot = wanted.get(place)
                if hot is None:
                    continue
                data, at = text[first : last + LENGTH], place - first
                if not hot:
                    digest = digest_of(data, at)
                    out.append((h, None, None, digest, None, at, data if once(sent, (h, digest)) else None, t1, t2, first, None, None))
                    continue
                for lo, hi, context, start, near, part in by_context(data, at, 0, LENGTH - GRAM, 2):
                    digest, from_ = digest_of(part, near), first + start
                    key = (h, lo, context, digest)
                    if key not in met:
                        if len(met) > 1_000_000:
                            met.clear()
                        met[key] = False
                        out.append((*key, hi, near, part, t1, t2, from_, None, False))
                        continue
                    out.append((*[None] * 7, t1, t2, from_, from_ + len(part), None))
                    if not met[key]:
                        met[key] = True
                        out.append((*key, hi, near, None, None, None, None, None, True))
        return dict(zip(FRAGMENT.names, zip(*out, strict=True), strict=True)) if out else None

    return work


def deeper():
    """Rows of LINK: the fragments, under longer contexts, of rows of PIECE with ``many``."""

    def work(hs, los, contexts, digests, his, places, datas, manys):
        out = []
        for h, lo, context, digest, hi, place, data, many in zip(hs, los, contexts, digests, his, places, datas, manys, strict=True):
            for a, b, longer, start, near, part in by_context(data, place, lo, hi, 4):
                out.append((h, a, longer, digest_of(part, near), b, near, part, lo, context, digest, start, many))
        return dict(zip(LINK.names, zip(*out, strict=True), strict=True)) if out else None

    return work


#: Ranges of bytes of a text.
RANGES = ArrayType(StructType(fields(start=LongType(), end=LongType()).fields))
RANGE = StructType([*fields(t1=LongType(), t2=LongType()).fields, StructField("ranges", RANGES)])
#: Bits of a filter for each key, bits of a part of it, and parts at most (16 MB).
BITS, PART, PARTS = 32, 32_768, 4096


def ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges that LENGTH bytes from each marked start cover, merged where starts adjoin."""
    at = np.flatnonzero(starts)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    return [(int(a), int(b) + LENGTH) for a, b in zip(at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]], strict=True)]


class Groups:
    """Decides groups of different fragments (bytes, anchor's place, whether it is found again, what
    it is); ``give`` takes what a fragment is and its ranges. Small groups are sorted together."""

    def __init__(self, give, most: int) -> None:
        self.give, self.most, self.shard, self.size = give, most, [], 0

    def add(self, own: list[tuple[bytes, int, bool, object]]) -> None:
        # contexts of the anchor that two different fragments share
        sides = [(("R", f[p + GRAM : p + GRAM + _SIDE]), ("L", f[max(0, p - _SIDE) : p])) for f, p, _, _ in own]
        seen: dict[tuple[str, bytes], int] = {}
        for both in sides:
            for c in both:
                seen[c] = seen.get(c, 0) + 1
        for (f, _, many, what), both in zip(own, sides, strict=True):
            if any(seen[c] > 1 for c in both):
                self.shard.append((f, many, what))
                self.size += len(f)
            elif many:
                self.give(what, [(0, len(f))])
        if self.size > self.most:
            self.close()

    def close(self) -> None:
        if self.shard:
            marks = repeated_starts([f for f, _, _ in self.shard], [many for _, many, _ in self.shard], LENGTH)
            for (_, _, what), mark in zip(self.shard, marks, strict=True):
                self.give(what, ranges(mark))
            self.shard, self.size = [], 0


def _given(out: list[tuple], schema: StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    done = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)
    out.clear()
    return done


def decided(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Ranges to remove, from fragments sorted by anchor and digest, equal ones with bytes first."""
    out: list[tuple] = []
    groups = Groups(lambda places, own: out.extend((t1, t2, [{"start": s + a, "end": s + b} for a, b in own]) for t1, t2, s in places if own), most)
    held: dict[int, tuple] = {}
    key = None

    def close_group():
        if sum(len(places) for _, _, places in held.values()) > 1:
            groups.add([(data, place, len(places) > 1, places) for data, place, places in held.values()])
        held.clear()

    for b in batches:
        for h, digest, t1, t2, start, place, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if h != key:
                close_group()
                key = h
            if digest not in held:
                held[digest] = (data, place, set())
            held[digest][2].add((t1, t2, start))
        if len(out) > 20_000:
            yield _given(out, RANGE)
    close_group()
    groups.close()
    yield _given(out, RANGE)


VERDICT = StructType([*fields(h=LongType(), lo=IntegerType(), context=LongType(), digest=LongType()).fields, StructField("within", RANGES)])


def judged(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of VERDICT: a row for each fragment with ranges, from different ones sorted by anchor, offsets and context."""
    out: list[tuple] = []
    groups = Groups(lambda what, own: out.extend([(*what, [{"start": a, "end": b} for a, b in own])] if own else []), most)
    own: list[tuple] = []
    key = None
    for batch in batches:
        for h, lo, context, digest, place, data, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (h, lo, context) != key:
                groups.add(own)
                own, key = [], (h, lo, context)
            own.append((data, place, many, (h, lo, context, digest)))
        if len(out) > 20_000:
            yield _given(out, VERDICT)
    groups.add(own)
    groups.close()
    yield _given(out, VERDICT)


def hot_ranges(found: DataFrame) -> DataFrame:
    """Rows of RANGE for the fragments of hot anchors."""
    group = list(KEY[:3])
    found = found.where("context is not null or h is null")
    places = found.where("h is not null and t1 is not null").select(*KEY, "t1", "t2", "start")
    many = F.max("again") | (F.min("t1") < F.max("t1")) | (F.min("t2") < F.max("t2")) | (F.min("start") < F.max("start"))
    pieces = found.where("h is not null").groupBy(*KEY, "hi", "place").agg(F.max("data").alias("data"), many.alias("many"))
    out = found.where("h is null").select("t1", "t2", F.array(F.struct("start", "end")).alias("ranges"))
    while True:
        pieces = stored(pieces.select(*PIECE.names, "many"), "pieces")
        large = stored(pieces.groupBy(*group).count().where(F.col("count") > HOT).select(*group), "large")
        rest = pieces.join(large, group, "left_anti").select(*KEY, "place", "data", "many")
        verdicts = rest.repartition(*group).sortWithinPartitions(*group).mapInArrow(partial(judged, most=SHARD), VERDICT)
        moved = F.transform("within", lambda r: F.struct((F.col("start") + r["start"]).alias("start"), (F.col("start") + r["end"]).alias("end")))
        out = out.unionByName(verdicts.join(places, list(KEY)).select("t1", "t2", moved.alias("ranges")))
        if large.isEmpty():
            return out
        links = stored(map_rows(pieces.join(large, group, "left_semi").select(*PIECE.names, "many"), deeper, LINK), "links")
        # different fragments have different places
        pieces = links.groupBy(*KEY, "hi", "place").agg(F.max("data").alias("data"), (F.max("many") | (F.count("*") > 1)).alias("many"))
        own = links.select("h", *(F.col(f"{k}0").alias(k) for k in KEY[1:]), *(F.col(k).alias(f"{k}1") for k in KEY[1:]), "shift")
        places = places.join(own, list(KEY)).select("h", *(F.col(f"{k}1").alias(k) for k in KEY[1:]), "t1", "t2", (F.col("start") + F.col("shift")).alias("start"))
        places = stored(places, "places")


def text_key(digest: str) -> list[F.Column]:
    """120 bits of a SHA-256 as two numbers."""
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(name) for name, at in (("t1", 1), ("t2", 16))]


def likely(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: whether their text key may be among ``keys``, which are stored. Never false for one
    that is; true for few others (one in BITS, more where PARTS are too few)."""
    parts = min(PARTS, max(1, -(-keys.count() * BITS // PART)))
    # a key is 60 bits of a SHA-256
    slot = F.pmod("t1", F.lit(parts * PART)) + 1
    part, at = F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)
    bits = keys.select(part.alias("part"), at.alias("at")).repartition("part").groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    tried = rows.withColumns({"part": part, "at": at}).join(F.broadcast(bits), "part", "left")
    return tried.select(*rows.columns, F.coalesce(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1, F.lit(False)).alias("maybe"))


def cut_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, spans): every row's id, text key (t1, t2), size, digest and copies; key and bytes of every row
    of LENGTH bytes or more; and, for each text with repeated strings, its key, the list of ranges, and whether it is
    ``copied``, found in several rows and so repeated as a whole. Rows of equal texts share one key."""
    configure(docs.sparkSession)
    content = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    keyed = docs.select(F.col(key).alias("doc_id"), content.alias("text")).withColumn("digest", F.sha2("text", 256)).select("doc_id", "text", "digest", *text_key("digest"))
    rows = stored(keyed.select("doc_id", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "texts")

    def make():
        seen: set[tuple[int, int]] = set()

        def work(t1s, t2s, texts):
            out = {n: [] for n in ANCHOR.names}
            for t1, t2, data in zip(t1s, t2s, texts, strict=True):
                if (t1, t2) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add((t1, t2))
                for h, place, _, _ in anchors(data):
                    for n, v in zip(ANCHOR.names, (h, t1, t2, place), strict=True):
                        out[n].append(v)
            return out

        return work

    long_ones = keyed.where(F.octet_length("text") >= LENGTH).select("t1", "t2", "text")
    found = stored(map_rows(long_ones, make, ANCHOR), "anchors")
    # anchors of very many places are counted where they stand, and meet nowhere: COMMON at most
    counts = found.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > max(HOT, found.count() // COMMON))
    common = F.col("h").isin([r.h for r in counts.select("h").collect()])
    others = found.where(~common).repartition("h").sortWithinPartitions("h", "t1", "t2", "place").mapInArrow(partial(repeated, most=HOT), REPEATED)
    places = stored(found.where(common).distinct(), "common_places")
    # those that one text gave to many tasks stand at fewer
    fewer = [(r.h, r.n) for r in places.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") <= HOT).collect()]
    hot = ~F.col("h").isin([h for h, _ in fewer])
    places = places.where(~F.col("h").isin([h for h, n in fewer if n == 1])).withColumn("hot", hot).select(*REPEATED.names)
    lists = others.unionByName(places).groupBy("t1", "t2").agg(F.collect_list(F.struct("place", "hot")).alias("own"))
    lists = stored(lists, "lists")
    touched = likely(long_ones, lists).where("maybe").join(lists, ["t1", "t2"])
    found = stored(map_rows(touched.select("t1", "t2", "text", "own"), fragments, FRAGMENT), "fragments")
    plain = found.where("h is not null and context is null").select("h", "digest", "t1", "t2", "start", "place", "data")
    sorted_frags = plain.repartition("h").sortWithinPartitions("h", "digest", F.col("data").isNull())
    spans = sorted_frags.mapInArrow(partial(decided, most=SHARD), RANGE).unionByName(hot_ranges(found)).withColumn("copied", F.lit(False))
    # one row stands for equal texts
    first = rows.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.max("n_bytes").alias("size"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end")))
    spans = spans.unionByName(first.where((F.col("copies") > 1) & (F.col("size") >= LENGTH)).select("t1", "t2", whole.alias("ranges"), F.lit(True).alias("copied")))
    spans = spans.groupBy("t1", "t2").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.max("copied").alias("copied"))
    return rows.join(first.drop("size"), ["t1", "t2"]), long_ones, stored(spans, "spans")


def merged(own) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in own):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


RESULT = fields(n_removed=LongType(), n_spans=LongType(), kept_sha256=StringType())


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: bytes, bytes removed, removed runs, and the SHA-256 of what is left."""
    rows, texts, spans = cut_ranges(docs, key, text)
    own = spans.where(~F.col("copied"))
    cuts = likely(texts, own).where("maybe").join(own, ["t1", "t2"])
    schema = StructType([*fields(t1=LongType(), t2=LongType()).fields, *RESULT.fields])

    def make():
        def work(t1s, t2s, texts, lists):
            out = {n: [] for n in schema.names}
            for t1, t2, data, own in zip(t1s, t2s, texts, lists, strict=True):
                spans = merged(own)
                left = b"".join(data[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(data)], strict=True))
                for n, v in zip(schema.names, (t1, t2, len(data) - len(left), len(spans), sha(left)), strict=True):
                    out[n].append(v)
            return out

        return work

    cut = map_rows(cuts.select("t1", "t2", "text", "ranges"), make, schema)
    out = rows.join(cut, ["t1", "t2"], "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return out.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(sha(""))).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
    )


def strip_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``; null stays null.

    A cut is narrowed to whole characters, so what is left is sound UTF-8.
    """
    _, _, spans = cut_ranges(docs.select(F.lit(0).alias("id"), F.col(text).alias("text")), "id")

    def one(data, own):
        kept, at = [], 0
        for a, b in merged(own):
            while a < b and data[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                b -= 1
            kept.append(data[at:a])
            at = b
        return b"".join([*kept, data[at:]]).decode("utf-8", "replace")

    @F.arrow_udf(StringType())
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        both = zip(texts.to_pylist(), lists.to_pylist(), strict=True)
        return pa.array([None if own is None else one(data, own) for data, own in both], pa.string())

    # the caller's columns stay apart in one
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256).alias("digest"))
    tried = likely(keyed.select("row", *text_key("digest")), spans)
    content = F.encode(F.col(f"row.`{text}`").cast("string"), "UTF-8")
    changed = tried.where("maybe").join(spans, ["t1", "t2"], "left").select("row", cut(content, "ranges").alias("left"))
    out = tried.where(~F.col("maybe")).select("row", F.lit(None).cast("string").alias("left")).unionByName(changed)
    return out.select(*(F.coalesce("left", f"row.`{c}`").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
