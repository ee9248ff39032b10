"""Exact duplicates, hard negatives and whitening against brute force."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from logweave.llm import exactdedup, hardneg, neardup, packing, whitening


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    known = lambda i: (i is not None, i or 0)
    return {t: (max(ids, key=known), len(ids)) for t, ids in groups.items()}


def copied(seed=3):
    rng = random.Random(seed)
    texts = [f"Text {rng.randrange(400)} \u00c4{'x' * rng.randrange(3)}" for _ in range(600)] + ["HOT line"] * 300 + ["hot LINE"] * 50
    texts += ["\u00c4", "\u00e4", "\u0130", "i\u0307", None, "", None, "a" * 300_000, "A" * 300_000, "\x00", "\n"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, (3, "twice"), (3, "twice"), (None, "twice"), (None, "no id"), (None, "no id")]


@pytest.mark.parametrize("settings", [{}, {"SEGMENT": 1024, "ROUND": 256, "HOT": 20}, {"BITS": 1, "HASHES": 1}])
def test_exact_duplicates(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(exactdedup, k, v)
    rows = copied()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 as sha", "'y' as rid", "0 as maybe", "2 as c0")
    got = exactdedup.mark(df).collect()
    want = brute_copies(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    for r in got:
        assert (r.keep_id, r.group_size) == by_sha[r.text_sha256]
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(want) and {r.text_sha256 for r in got if r.kept} == set(by_sha)
    left = exactdedup.deduplicate(df)
    assert left.columns == df.columns
    left = left.collect()
    assert sorted(lower(r.text) for r in left) == sorted(want)
    assert all(want[lower(r.text)][0] == r.doc_id and (r.sha, r.rid, r.maybe, r.c0) == (1, "y", 0, 2) for r in left)


def test_exact_duplicates_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exactdedup.mark(empty).count() == exactdedup.deduplicate(empty).count() == 0
    assert exactdedup.mark(empty).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_bloom_misses_nothing(spark):
    """Few rows that are alone are tried further, and none that is repeated is passed over."""
    df = spark.range(20_000).selectExpr("id as doc_id", "cast(if(id % 10 = 0, id % 100, id) as string) as text")
    tried = exactdedup.suspects(exactdedup._digests(df, "doc_id", "text")).join(df, "doc_id").toPandas()
    copies = tried.groupby("text").doc_id.transform("size") > 1
    assert tried.maybe[copies].all()
    assert tried.maybe[~copies].mean() < 0.06


def test_bits():
    seen = np.zeros(1024, np.uint8)
    place = np.arange(50, dtype=np.uint32)
    exactdedup.add_bits(seen, place)
    exactdedup.add_bits(seen, place[:5])
    assert (seen[exactdedup.bits_of(place[:5], 1024)] == 2).all() and seen.max() == 2
    segment, where = exactdedup.places(pa.array([bytes(32), b"\xff" * 32]), 7)
    assert segment.tolist() == [0, 6] and where.tolist() == [0, 2**32 - 1]


def leverrier(a):
    """The characteristic polynomial, constant first, by traces of powers."""
    d = len(a)
    c, m = [1], [[0] * d for _ in range(d)]
    for k in range(1, d + 1):
        m = [[sum(a[i][x] * m[x][j] for x in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        c.append(-sum(a[i][x] * m[x][i] for i in range(d) for x in range(d)) // k)
    return c[::-1]


def gram(rng, d, rank, size):
    g = [[rng.randrange(-size, size) for _ in range(d)] for _ in range(rank)]
    return [[sum(r[i] * r[j] for r in g) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize(("d", "rank", "size"), [(1, 1, 5), (2, 1, 9), (5, 5, 10**6), (7, 3, 100), (9, 12, 10**12)])
def test_characteristic_polynomial(spark, d, rank, size):
    a = gram(random.Random(d), d, rank, size)
    p = whitening.characteristic(spark, a)
    assert p == leverrier(a)
    assert d - whitening.Roots(p, 0).zeros == min(d, rank)


def test_roots_and_null_vectors(spark):
    """Roots known beforehand, some repeated, some 2^-150 of the others apart."""
    big = 1 << 170
    values = [7 * big, 5 * big + 1, 5 * big, 5 * big, 3, 0]
    # a rotation by whole numbers: the reflection 3 I - v v' of v = (1, 1, 1, 1, 1, 1) is 3 times an orthogonal matrix
    q = [[(3 if i == j else 0) - 1 for j in range(6)] for i in range(6)]
    a = [[sum(q[i][x] * values[x] * q[j][x] for x in range(6)) for j in range(6)] for i in range(6)]
    p = whitening.characteristic(spark, a)
    roots = whitening.Roots(p, 30)
    assert [roots.largest(k)[1] for k in (1, 2, 5)] == [v * 9 << 30 for v in (7 * big, 5 * big + 1, 3)]
    assert roots.largest(3) == roots.largest(4) == ((45 * big << 30) - 1, 45 * big << 30, 2)
    found = whitening.components(spark, a)
    assert len(found) == 5
    for (x, bits, v), value in zip(found, values, strict=False):
        assert abs(x / (9 * value << bits) - 1) < 1e-12
    vectors = np.array([v for _, _, v in found])
    assert np.abs(vectors @ vectors.T - np.eye(5)).max() < 1e-15
    for k in (0, 1, 4):
        assert np.abs(np.abs(vectors[k]) - np.abs(np.array(q[k]) / 3)).max() < 1e-15


def brute_whitened(vectors, most=16):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n = len(fit)
    mid = fit.sum(axis=0) / n
    values, axes = np.linalg.eigh((fit - mid).T @ (fit - mid) / n)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    deviations = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(r, fit.sum(axis=0), strict=True)) for r in x]
    return n, deviations, (x - mid) @ axes / np.sqrt(values), values / np.trace((fit - mid).T @ (fit - mid) / n)


@pytest.mark.parametrize("scale", [1.0, 1e6, 3e14])
def test_whitening(spark, scale):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(400, 20)) @ rng.normal(size=(20, 20)) * scale
    v = np.r_[v, np.repeat(v[:1], 200, axis=0)]
    rows = [(i, [float(c) for c in r], "x") for i, r in enumerate(v)]
    out = [(None, None, "y"), (900, [], "y"), (901, [1.0] * 19 + [float("nan")], "y"), (902, [1.0] * 19 + [None], "y"), (903, [1.0] * 3, "y"), (904, [1.0] * 19 + [float("inf")], "y")]
    df = spark.createDataFrame(rows + out, "vec_id long, embedding array<double>, u string").repartition(5)
    got = whitening.whiten(df).collect()
    n, deviations, white, explained = brute_whitened(v)
    assert len(got) == 600 * 16 and n == 400 and {r.n for r in got} == {400}
    flat = {(r.vec_id, r.component): r for r in got}
    own = np.array([[flat[i, k + 1].whitened for k in range(16)] for i in range(600)])
    own *= np.sign((own * white).sum(axis=0))
    assert np.abs(own - white).max() < 1e-6
    assert all(flat[i, 1].deviation == (d if d < 2**63 else None) for i, d in enumerate(deviations))
    assert all(abs(flat[0, k + 1].explained / e - 1) < 1e-9 for k, e in enumerate(explained))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_degenerate(spark):
    """No rows, one vector, and fewer directions than components."""
    schema = "vec_id string, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0])], schema)).count() == 0
    line = whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0, 0.0]), ("a", [1.0, 2.0, 0.0]), (None, [3.0, 4.0, 0.0])], schema)).collect()
    assert sorted((r.vec_id or "", r.component, r.n, round(abs(r.whitened), 12)) for r in line) == [("", 1, 2, 1.0), ("a", 1, 2, 1.0), ("a", 1, 2, 1.0)]
    square = whitening.whiten(spark.createDataFrame([(str(i), [float(i % 2), float(i // 2)]) for i in range(4)], schema)).collect()
    assert len(square) == 8 and square[0].explained == 0.5 and square[0].identity_error < 1e-12


def whole(v):
    if v is None or not len(v) or any(c is None or not math.isfinite(c) for c in v):
        return None
    return [math.floor(256 * c) for c in v]


def brute_negatives(rows, is_anchor, positives=5, negatives=10):
    rows = [(i, y, w) for i, v, y in rows if i is not None and y is not None and (w := whole(v)) is not None]
    out = []
    dot = lambda a, b: sum(x * z for x, z in zip(a, b, strict=True))
    for i, y, w in rows:
        if not is_anchor(i):
            continue
        like = [r for r in rows if len(r[2]) == len(w)]
        own = sorted((-dot(w, x), j) for j, z, x in like if z == y and j != i)[:positives]
        other = sorted((-dot(w, x), j) for j, z, x in like if z != y)
        for p, j in own:
            fit = [(s, n) for s, n in other if 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(fit)]
    return sorted(out)


def labelled_vectors(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    y = rng.integers(0, 6, n)
    v = (centres[y] + rng.normal(size=(n, dims)) * spread) * rng.lognormal(0, 0.7, size=(n, 1))
    rows = [(i, [float(np.float32(c)) for c in r], int(z)) for i, (r, z) in enumerate(zip(v, y, strict=True))]
    rows += [(n + i, rows[7][1], 1) for i in range(n // 3)]  # one vector under many ids
    rows += [(n + 900, [0.0] * dims, 1), (n + 901, [1.0] * (dims - 1), 1), (n + 903, [1.5] * (dims - 1), 2), (n + 904, [2.0] * (dims - 1), 1)]
    rows += [(None, rows[1][1], 1), (n + 905, None, 1), (n + 906, rows[2][1], None), (n + 907, [], 2), (n + 908, [float("nan")] * dims, 2), (n + 909, [1.0, None] + [0.0] * (dims - 2), 2)]
    return [*rows, rows[3], rows[3], rows[20], (40, rows[41][1], 5)]  # repeated rows, anchors among them


@pytest.mark.parametrize(("cells", "spread"), [(2**19, 0.4), (700, 0.4), (700, 3.0)])
def test_hard_negatives(spark, monkeypatch, cells, spread):
    monkeypatch.setattr(hardneg, "CELLS", cells)
    monkeypatch.setattr(hardneg, "ROUND", 16 * 2**20 if cells > 1000 else 8000)
    rows = labelled_vectors(5, 500, 7, spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).selectExpr("*", "1 as q", "2 as rank", "3 as place")
    got = hardneg.mine(df, F.col("vec_id") % 20 == 0, F.col("label")).collect()
    assert sorted(tuple(r) for r in got) == brute_negatives(rows, lambda i: i % 20 == 0)


def test_hard_negatives_empty_and_large(spark):
    schema = "vec_id long, embedding array<double>, label int"
    every = F.lit(True)
    assert hardneg.mine(spark.createDataFrame([], schema), every, F.col("label")).count() == 0
    assert hardneg.mine(spark.createDataFrame([(1, [1.0], 1)], schema), every, F.col("label")).count() == 0
    rows = [(i, [2.0**20 * (1 + i % 5), 2.0**21 + i, -3.0], i % 2) for i in range(20)]  # scores beyond 2^52
    got = hardneg.mine(spark.createDataFrame(rows, schema), every, F.col("label")).collect()
    assert max(r.positive_score for r in got) > 2**52
    assert sorted(tuple(r) for r in got) == brute_negatives(rows, lambda i: True)


def bucket_of(v):
    orders = np.argsort(v, axis=0, kind="stable").T.astype("<u2")
    size = float(np.sqrt((v * v).sum(axis=1)).max())
    ids = np.arange(len(v)).astype("<i8")
    return hardneg.Bucket(v.shape[1], size, ids.tobytes(), np.zeros(len(v), "<i8").tobytes(), 4, v.astype("<i4").tobytes(), orders.tobytes())


def test_pruning_is_sound_and_prunes():
    """No row at or over a bound is missed, and most rows far from the query are passed over."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(4000, 6)) * rng.lognormal(0, 0.5, size=(4000, 1))
    v = np.floor(v[np.argsort(-np.sqrt((v * v).sum(axis=1)))] * 256)
    buckets = [(at, bucket_of(v[at : at + 400])) for at in range(0, 4000, 400)]
    scored = 0
    for q in np.floor(rng.normal(size=(40, 6)) * 256):
        scores, length = v @ q, float(np.sqrt(q @ q))
        for least in (scores.max(), np.partition(scores, -10)[-10], 1.0):
            for at, b in buckets:
                rows = b.candidates(q, length, least)
                want = np.flatnonzero(scores[at : at + 400] >= least)
                assert rows is None or set(want) <= set(rows.tolist())
                assert not (len(want) and b.beyond(length, least))
                if least == scores.max() and not b.beyond(length, least):
                    scored += 400 if rows is None else len(rows)
    assert scored / (40 * 4000) < 0.3


def triplets(seed, n=40, capacity=1024):
    """Pieces of which three fill a bin, each more than a quarter of it."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        a = rng.randrange(390, 500)
        b = rng.randrange(257, capacity - a - 256)
        out += [a, b, capacity - a - b]
    rng.shuffle(out)
    return out


def test_islands_beat_best_fit(spark):
    """Three pieces a bin: best fit wastes a sixth; crossover, migration and the rest save some of it."""
    for seed in (0, 1):
        sizes = triplets(seed)
        alone = len(packing.Island(sizes, 1024, seed).first(0.0))
        todo = spark.createDataFrame(list(enumerate(sizes)), "item long, size long")
        got = packing.evolved(todo, len(sizes), 0, 1024, packing.LAND, 3, 2, 3, 8).collect()
        filled = defaultdict(int)
        for r in got:
            filled[r.bin] += r.size
        assert sorted(r.item for r in got) == list(range(len(sizes))) and max(filled.values()) <= 1024
        assert 40 <= len(filled) < alone


def test_ids_that_are_no_numbers(spark):
    df = spark.createDataFrame([("a", "x y z"), ("7", "x y z"), ("8", "x y z"), (None, "x y z")], "doc_id string, text string")
    got = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df, width=2).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, None, True), (7, 7, True), (8, 7, False), (None, None, True)]))


def test_clusters_are_not_compared_again(spark, monkeypatch):
    """A large group of copies among strangers: the same components in blocks of any size, and no pair within the group."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(60)]
    near = lambda: " ".join(w if rng.random() > 0.02 else word() for w in base)
    far = lambda: " ".join(w if rng.random() > 0.12 else word() for w in base)
    texts = [near() for _ in range(150)] + [far() for _ in range(60)] + [" ".join(word() for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 2]) for i in range(len(t.split()) - 1)} for t in texts]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    for block in (2048, 8):
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, width=2, block=block).collect()}
        assert [got[i] for i in range(len(sets))] == label
    sets_of = [np.array([1, 2, 3], np.uint64)] * 3
    assert neardup.linked([1, 2, 3], sets_of, [2, 2, 2], 80, [5, 5, 9]) == [(1, 3)]
