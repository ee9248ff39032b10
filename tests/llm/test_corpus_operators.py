"""Operators on whole tables against brute force."""

import hashlib
import random

import numpy as np
import pytest

from logweave.llm import induced, media, neardup, suffixdedup, topk
from logweave.llm.components import components


def lcp(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("limit", [4, 50, 10**6])
def test_induced_order(limit):
    rng = random.Random(limit)
    for _ in range(400):
        letters = rng.choice([1, 2, 3, 26])
        s = "".join(chr(97 + rng.randrange(letters)) for _ in range(rng.randrange(50)))
        s += s[: rng.randrange(len(s) + 1)] * rng.randrange(3) + "\0"
        want = sorted(range(len(s)), key=lambda i: s[i:])
        order, common = induced.suffixes(s, limit)
        assert list(order) == want
        assert list(common) == [0] + [lcp(s[a:], s[b:]) for a, b in zip(want, want[1:], strict=False)]


@pytest.mark.parametrize(("limit", "base"), [(3, 0), (40, 5), (10**6, 10**6)])
def test_fragment_order(limit, base):
    rng = random.Random(limit)
    for _ in range(300):
        letters, own = rng.choice([1, 2, 3, 26]), []
        for _ in range(rng.randrange(1, 6)):
            f = bytes(97 + rng.randrange(letters) for _ in range(rng.randrange(25)))
            own.append(rng.choice([f, f + f, (own[-1] if own else b"") + f]))
        n = len(own)
        s = "".join("".join(chr(b + n) for b in f) + chr(n - 1 - k) for k, f in enumerate(own))
        want = sorted(range(len(s)), key=lambda i: s[i:])
        order, common = induced.fragment_order(own, limit, base)
        assert order.tolist() == want
        assert common.tolist() == [0] + [lcp(s[a:], s[b:]) for a, b in zip(want, want[1:], strict=False)]


def test_more_names_than_characters():
    """Over 1.2 million different names of starts, and letters beyond those of a str."""
    n = 1_250_000
    letters = np.random.default_rng(5).permutation(2 * n)[: n - 1] + 1
    order, common = induced.suffixes(np.r_[letters, letters[:9], 0])
    first = np.r_[letters, letters[:9], 0][np.array(order)]
    assert (np.diff(first) >= 0).all() and sorted(order) == list(range(n + 9))
    assert sum(common) == sum(range(1, 10))


def brute_removed(texts):
    places = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 199):
            places.setdefault(t[k : k + 200], []).append((i, k))
    gone = [np.zeros(len(t), bool) for t in texts]
    for where in places.values():
        if len(where) > 1:
            for i, k in where:
                gone[i][k : k + 200] = True
    return gone


def passages(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, line = [prose(60) for _ in range(6)], prose(20)[:90]
    out = [f"{prose(rng.randrange(60))} {rng.choice(shared)}{prose(rng.randrange(40))}\n{line}\n{prose(rng.randrange(40))}" for _ in range(60)]
    out += [shared[0], shared[1][:150], shared[2] + shared[2], "a" * 199, "a" * 200, "b" * 201, "b" * 900, "ab" * 150, "", out[3], out[3], out[5][5:], out[6] + out[7], prose(80)]
    return out


def test_suffix_dedup(spark, monkeypatch):
    texts = passages() + [None, None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, left string").selectExpr("*", "1 as t1", "'y' as _row", "0 as `a.b`")
    data = [(t or "").encode() for t in texts]
    gone = brute_removed(data)
    for hot in (suffixdedup.HOT, 3):
        monkeypatch.setattr(suffixdedup, "HOT", hot)
        monkeypatch.setattr(suffixdedup, "SHARD", 5000)
        got = {r.doc_id: r for r in suffixdedup.remove_repeats(df).collect()}
        assert len(got) == len(texts)
        for i, (d, g) in enumerate(zip(data, gone, strict=True)):
            left = bytes(np.frombuffer(d, np.uint8)[~g])
            spans = int((np.diff(np.r_[0, g.astype(int)]) == 1).sum())
            assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(d), int(g.sum()), spans), i
            assert got[i].kept_sha256 == hashlib.sha256(left).hexdigest()
    assert suffixdedup.strip_repeats(df).columns == df.columns and suffixdedup.strip_repeats(df).where("left = 'x' and t1 = 1").count() == len(texts)
    left = {r.doc_id: r.text for r in suffixdedup.strip_repeats(df).collect()}
    assert left[len(texts) - 1] is None and left[3] == "" and left[63] == "a" * 199
    assert all(left[i] == texts[i] for i, g in enumerate(gone) if not g.any() and texts[i])


def test_suffix_dedup_common_line(spark, monkeypatch):
    """A line of 132 to 199 bytes with other text around it: no group that is sorted grows with its number."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    line, ends = word(190), [word(30) for _ in range(4)]
    texts = [f"{word(150)}{rng.choice(ends) if i % 5 == 0 else word(30)}{line}{rng.choice(ends) if i % 3 == 0 else word(30)}{word(150)}" for i in range(120)]
    texts += [texts[0], word(400)]
    sizes, sort = [], suffixdedup.repeated_starts

    def counted(fragments, *more):
        sizes.append(len(fragments))
        return sort(fragments, *more)

    monkeypatch.setattr(suffixdedup, "HOT", 8)
    monkeypatch.setattr(suffixdedup, "SHARD", 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in suffixdedup.remove_repeats(df).collect()}
    data = [t.encode() for t in texts]
    for i, (d, g) in enumerate(zip(data, brute_removed(data), strict=True)):
        assert (got[i].n_removed, got[i].kept_sha256) == (int(g.sum()), hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~g])).hexdigest()), i
    assert sum(r.n_removed > 0 for r in got.values()) > 40

    # what a sorting task gets, in this process
    kept = []
    mapped = type(df).mapInArrow

    def watched(self, work, schema):
        if getattr(work, "func", work).__name__ in ("judged", "decided"):
            kept.append((work, self.toArrow().to_batches()))
        return mapped(self, work, schema)

    monkeypatch.setattr(type(df), "mapInArrow", watched)
    suffixdedup.remove_repeats(df)
    monkeypatch.setattr(suffixdedup, "repeated_starts", counted)
    for work, batches in kept:
        list(work(iter(batches)))
    assert sizes and max(sizes) <= 8


def shuffled_bytes(spark):
    """Bytes that all stages up to now have shuffled."""
    context, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_suffix_dedup_moves_few_texts(spark):
    """Texts without a repeated string are not shuffled: less than their bytes is, for anchors and all (more than twice before)."""
    rng = np.random.default_rng(5)
    prose = lambda n: bytes(rng.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", np.uint8), n)).decode()
    passage = prose(300)
    texts = [prose(10_000) for _ in range(300)] + [prose(5_000) + passage + prose(5_000) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = shuffled_bytes(spark)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as on tables that are not small
    try:
        left = {r.doc_id: r.text for r in suffixdedup.strip_repeats(df).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert shuffled_bytes(spark) - before < sum(map(len, texts))
    assert all(left[i] == t for i, t in enumerate(texts[:300])) and all(left[i] == texts[i].replace(passage, "") for i in range(300, 306))


def test_likely(spark):
    """The filter keeps every key that is there, and few others; without keys it keeps none."""
    key = lambda n, m: spark.range(n).selectExpr("sha2(cast(id as string), 256) as digest", f"id % {m} = 0 as own").select(*suffixdedup.text_key("digest"), "own")
    rows = suffixdedup.stored(key(20_000, 5), "keys")
    for keys, most in ((rows.where("own"), 1_000), (rows.where("false"), 0)):
        got = suffixdedup.likely(rows, keys.select("t1", "t2"))
        assert got.columns == ["t1", "t2", "own", "maybe"] and got.count() == 20_000 and got.where("maybe is null").isEmpty()
        assert got.where("not own and maybe").count() <= most
        assert got.where("own and not maybe").count() == (0 if most else 4_000)


def shingle_set(text, width):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").replace("\n", " ").replace("\t", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(ids, sets, percent=80):
    comp = {i: i for i in ids}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)) or ids[a] == ids[b]:
                x, y = find(ids[a]), find(ids[b])
                comp[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("width", "block"), [(2, 2048), (5, 2048), (2, 7)])
def test_near_duplicates(spark, width, block):
    rng = random.Random(width)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.randrange(20, 120))] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(10):
            w = list(b)
            for _ in range(rng.randrange(0, 8)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    texts += ["One Two", "one two", "one", "ONE", "", None, " ", "É é", "é É", "word " * 9, "word word word word word word"] + texts[:3]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(5, "an id again", "x")]
    df = spark.createDataFrame([*rows, (None, texts[0], "x")], "doc_id long, text string, kept string")
    got = neardup.near_duplicates(df, width, 80, block=block).collect()
    assert len(got) == len(rows) + 1
    want = brute_components([r[0] for r in rows], [shingle_set(r[1], width) for r in rows])
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id), r
    sizes = sorted(r.n_shingles for r in got if r.doc_id is not None)
    assert sizes == sorted(len(shingle_set(r[1], width)) for r in rows)


def planted_sets(rng, n, size=200):
    """Sets of one common passage, a third of them near copies of a few."""
    common = rng.integers(0, 2**63, size, dtype=np.uint64)
    heads = [np.r_[common, rng.integers(0, 2**63, size // 2, dtype=np.uint64)] for _ in range(5)]
    out = []
    for k in range(n):
        own = heads[k % 5].copy() if k % 3 == 0 else np.r_[common, rng.integers(0, 2**63, size // 2, dtype=np.uint64)]
        gone = rng.integers(0, len(own), size // 20)
        own[gone] = rng.integers(0, 2**63, len(gone), dtype=np.uint64)
        out.append(np.unique(own))
    return out


@pytest.mark.parametrize(("many", "batch"), [(256, 7), (256, 10_000), (8, 50)])
def test_forest(many, batch):
    """What the ties of all trees connect holds every pair of similarity 0.8, whatever the batches are."""
    import pyarrow as pa

    sets = planted_sets(np.random.default_rng(3), 150)
    keys, sketches = neardup.signatures(sets)
    assert keys.shape == (150, neardup.TREES, neardup.DEEPEST)
    rows = sorted((t, keys[k, t].tobytes(), k, sketches[k].tobytes()) for k in range(150) for t in range(neardup.TREES))
    schema = pa.schema([("tree", pa.int32()), ("key", pa.binary()), ("id", pa.int64()), ("sketch", pa.binary())])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + batch], strict=True), schema, strict=True)], schema=schema) for a in range(0, len(rows), batch)]
    group = list(range(150))
    n = 0
    for b in neardup.regions(iter(batches), many):
        for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n += 1
            x, y = group[u], group[v]
            group = [x if g == y else g for g in group]
    assert n <= 149 * neardup.TREES
    for i in range(150):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert group[i] == group[j]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    want = {i: i for e in edges for i in e}
    for _ in range(len(want)):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: c for i, c in want.items() if any(a != b and i in (a, b) for a, b in edges)}


def brute_top(rows, queries, k=5):
    out = set()
    for q, v in queries:
        scored = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def test_impact_order():
    """Segments without weight are not read, and a few heavy ones can be proof enough."""
    rng = np.random.default_rng(5)
    q = np.zeros((3, 16))
    q[:, 4] = [900, -800, 700]
    q[:, 7] = 1
    ds, js = topk.weighted_order(q, 8)
    assert len(ds) == 16 and (np.diff(np.abs(q).max(axis=0)[js] * 2.0**ds) <= 0).all() and set(js) == {4, 7}
    v = rng.integers(0, 256, (500, 16))
    planes = np.stack([np.packbits((v.T >> d & 1).astype(bool), axis=1) for d in range(7, -1, -1)])
    seen = []
    qs, ids, scores = topk.search_block(q, np.array([1, 2, -1]), np.arange(500), 0, 8, planes.tobytes(), 5, seen)
    want = brute_top([(i, x) for i, x in enumerate(v)], [(1, q[0]), (2, q[1]), (-1, q[2])])
    assert {((1, 2, -1)[a], b, c) for a, b, c in zip(qs, ids, scores, strict=True)} == {(a, b, c) for a, _, b, c in want} and seen[0][0] <= 16
    q = rng.integers(-200, 200, (8, 16)).astype(float)
    q[:, 0] = 100_000
    topk.search_block(q, np.arange(8), np.arange(500), 0, 8, planes.tobytes(), 5, seen)
    assert seen[1][0] < 128


def test_bounds_carry_over():
    """A block without a row that reaches the bound is left after few segments, or at once; none that reaches it is missed."""
    rng = np.random.default_rng(6)
    q = rng.integers(-50, 50, (4, 12)).astype(float)
    v = rng.integers(0, 64, (300, 12))
    planes = np.stack([np.packbits((v.T >> d & 1).astype(bool), axis=1) for d in range(5, -1, -1)]).tobytes()
    scores = v @ q.astype(int).T
    for floor in (scores.max(axis=0), np.partition(scores, -3, axis=0)[-3], scores.max(axis=0) + 1):
        seen = []
        qs, ids, got = topk.search_block(q, np.full(4, -1), np.arange(300), 0, 6, planes, 5, seen, floor.astype(float))
        want = {(a, i, scores[i, a]) for a in range(4) for i in np.flatnonzero(scores[:, a] >= floor[a]).tolist()}
        assert want <= set(zip(qs.tolist(), ids.tolist(), got.tolist(), strict=True))
        assert seen[0][0] <= seen[0][1] == 72
    seen = []
    assert not len(topk.search_block(q, np.full(4, -1), np.arange(300), 0, 6, planes, 5, seen, np.full(4, 1e9))[0]) and seen == [(0, 72)]


def test_top_k_reads_fewer_segments_and_shuffles_few_rows(spark):
    """Few rows are large: blocks after the first are left early, and give less than k rows for each query."""
    rng = np.random.default_rng(8)
    v = np.abs(rng.normal(size=(6000, 10))) * np.where(rng.random((6000, 1)) < 0.02, 8.0, 0.2)
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    report = {}
    got = topk.top_k(df, df.where("vec_id % 200 = 0"), 5, block=60, report=report)
    w = np.floor(256 * v).astype(np.int64)
    whole = list(enumerate(w))
    assert {tuple(r) for r in got.collect()} == brute_top(whole, [(i, x) for i, x in whole if i % 200 == 0])
    assert report["read"] < 0.6 * report["segments"] and report["shuffled"] < 30 * 5 * 100 / 4


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).round(2)
    v[20:40] = v[0]
    data = [(i, [float(x) for x in w], "x") for i, w in enumerate(v)]
    odd = [(1000, None, "x"), (1001, [1.0, None] + [0.0] * 6, "x"), (1002, [float("nan")] * 8, "x"), (1003, [float("inf")] * 8, "x"), (1004, [], "x")]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, score string")
    whole = [(i, np.floor(256 * np.array(w)).astype(np.int64)) for i, w, _ in data]
    for block, queries in ((64, 3), (8192, 2048)):
        got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, block=block, query_block=queries)
        assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute_top(whole, [w for w in whole if w[0] % 50 == 0])
    monkeypatch.setattr(topk, "ROUND", 1)
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, block=64, query_block=2)
    assert {tuple(r) for r in got.collect()} == brute_top(whole, [w for w in whole if w[0] % 50 == 0])
    few = topk.top_k(df.where("vec_id < 3"), df.where("vec_id = 0"))
    assert few.count() == 2
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_near_duplicates_recall(spark):
    """Documents of the given table: components as by brute force over all sets that share a shingle."""
    import duckdb

    from logweave.llm.queries import near_duplicate_sql

    path = "/root/testdata/sf0.01/documents.parquet"
    for width in (2, 5):
        got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(spark.read.parquet(path), width, 80).collect()}
        want = {(r[0], r[2]) for r in duckdb.sql(near_duplicate_sql(width, 80, f"'{path}'")).fetchall()}
        moved = {d for d, c in want if d != c}
        assert len(moved) > 50 and got == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == suffixdedup.remove_repeats(empty).count() == suffixdedup.strip_repeats(empty).count() == 0


def test_media(spark, monkeypatch):
    monkeypatch.setattr(media, "PACK", 20_000)
    rng = random.Random(6)
    big = ["".join(rng.choice("abc é") for _ in range(rng.randrange(100, 9000))) for _ in range(12)]
    texts = big + [t[500:] for t in big] + big[:4] + ["", None, "x" * 192, "x" * 193, "é" * 50_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, n_bytes string").repartition(3)
    monkeypatch.setattr(media, "ASKED", 2)
    tables = {t.name for t in spark.catalog.listTables()}
    store = media.build_store(df)
    assert len({t.name for t in spark.catalog.listTables()} - tables) == 1
    got = media.read_store(store).collect()
    assert len(got) == len(texts) + 1
    assert any(not h for r in store.collect() for h in r.home) and max(a for r in store.collect() for a in r.asked) > 1
    for r in got:
        x = np.frombuffer((lambda d: d + b" " * ((-len(d) % 192) or (192 if not d else 0)))((texts[r.doc_id] or "").encode()), np.uint8)
        plus = [int(v) - 128 for v in x]
        cross = sum((a >= 0) != (b >= 0) for a, b in zip(plus, plus[1:], strict=False))
        mode = min(set(x.tolist()), key=lambda v, n=np.bincount(x, minlength=256): (-n[v], v))
        assert r.feature == f"sum:{sum(plus)};energy:{sum(v * v for v in plus)};crossings:{cross};mode:{mode}"
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        want = data + b" " * ((-len(data) % 192) or (192 if not data else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(want), hashlib.sha256(want).hexdigest())
        assert r.tail_crc32 == __import__("zlib").crc32(want[-16:]) and r.media_bytes == len(want) + 44
    assert media.store_and_read(df.limit(0)).count() == 0
    assert len({(r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})


def test_media_chunks_follow_content():
    rng = random.Random(8)
    a = bytes(rng.randrange(97, 110) for _ in range(60_000))
    one = {a[x:y] for x, y in zip([0, *media.cuts(a)], media.cuts(a), strict=False)}
    b = b"some letters in front" + a
    two = {b[x:y] for x, y in zip([0, *media.cuts(b)], media.cuts(b), strict=False)}
    assert len(one & two) >= len(one) - 3 and all(len(c) <= media.MOST for c in one) and b"".join(b[x:y] for x, y in zip([0, *media.cuts(b)], media.cuts(b), strict=False)) == b


def test_damage_is_noticed(spark):
    store = media.build_store(spark.createDataFrame([(1, "abc")], "doc_id long, text string"))
    from pyspark.sql import functions as F

    broken = store.withColumn("digests", F.transform("digests", lambda d: F.unhex(F.md5(d))))
    with pytest.raises(Exception, match="damaged"):
        media.read_store(broken).collect()
