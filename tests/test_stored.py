"""What jobs leave behind: indexes, edges, roll-ups and sealed batches give what the plain forms give, and grow by batch."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import aggregates, batches, edgestore, graph, insights, retrieval, rollup, textindex
from logweave.plans import logview

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()] if columns else [tuple(r) for r in df.collect()]


def texts(seed=1, n=120):
    rng = random.Random(seed)
    words = [f"w{i:02d}" + "xyz"[i % 3] for i in range(30)] + ["the"] * 20
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) if i % 17 else None) for i in range(n)]


def test_word_index_grows_by_batch(spark, tmp_path):
    data = texts()
    df = spark.createDataFrame(data, "doc_id long, text string")
    index = textindex.TextIndex(spark, f"file://{tmp_path}/i", "words", ("doc_id",), buckets=8)
    with pytest.raises(ValueError):
        index.keywords("the")
    index.append(df.where("doc_id < 50"), "text", "a")
    index.append(df.where("doc_id >= 40 and doc_id < 100"), "text", "b")  # a batch that was wrong
    index.append(df.where("doc_id >= 50"), "text", "b")
    for query in ("the w01y w07y", "w03x none", "zz", ""):
        want = rows(retrieval.keyword_search(df, query, 15)) if query else []
        assert rows(index.keywords(query, 15)) == want, query
    plan = index.postings(["the"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "IsNotNull(term), EqualTo(term,the)" in plan.replace("In(term, [the])", "EqualTo(term,the)")
    before = rows(index.keywords("the w01y", 15))
    index.merge()
    assert rows(index.keywords("the w01y", 15)) == before and len(index._live()) == 1
    index.append(spark.createDataFrame([(900, "w01y only")], "doc_id long, text string"), "text", "c")
    assert 900 in [r[0] for r in rows(index.keywords("w01y", 200))]


def test_gram_index(spark, tmp_path):
    log = logview.events(spark, SF)
    index = textindex.TextIndex(spark, f"file://{tmp_path}/m", "grams", ("id",), buckets=8)
    index.append(log, "message", "all")
    for query in ("any error Purchase?", "click", "no such thing anywhere", "k=1"):
        assert rows(textindex.search_messages(index, log, query)) == rows(retrieval.substring_search(log, query)), query
    nodes = spark.createDataFrame([("Host", "node-01"), ("Host", "Node-012"), ("User", "node"), ("User", "é"), ("File", "x"), ("Host", "node-01")], "label string, value string")
    names = textindex.index_nodes(nodes, f"file://{tmp_path}/n")
    for name in ("node", "NODE-0", "node-01", "n", "x", "É", "zzz", "-0"):
        assert rows(textindex.resolve(names, name)) == rows(graph.resolve(nodes.distinct(), name)), name


def test_grams_of_segments(spark, tmp_path, monkeypatch):
    """A row holds all texts of a segment, and batches that replace each other, merge and come in parts lose none."""
    data = [(i, None if i % 19 == 0 else f"text {i % 500} \U0001f600É" + "abc"[i % 3] * (i % 4)) for i in range(9000)]
    df = spark.createDataFrame(data, "n long, text string").coalesce(1)
    index = textindex.TextIndex(spark, f"file://{tmp_path}/s", "grams", ("n",), buckets=4)
    for name, part in (("a", "n < 8000"), ("b", "n < 10"), ("b", "n >= 8000")):
        index.append(df.where(part), "text", name)
    for _ in range(2):
        for part in ("text 49", "t", "\U0001f600ÉA", "cc", "nowhere"):
            near = {r.n for r in index.holding(part).collect()}
            want = {i for i, t in data if t and part.lower() in t.lower()}
            assert want <= near and len(near) == index.holding(part).count(), part
            if len(part) <= 3:
                assert near == want, part
        index.merge()
    assert index.postings(["tex"]).count() == 2 and index.postings(["tex"]).agg(F.sum("texts")).first()[0] == sum(t is not None for _, t in data)
    import numpy as np

    wide = ["".join(map(chr, range(0x10000, 0x21000))), "ab"]
    monkeypatch.setattr(textindex, "TAKEN", 1)
    assert {t: n.tolist() for t, n in textindex.grams(wide, np.array([5, 7]))}["ab"] == [7]
    for n in (1, textindex.DENSE - 1, textindex.DENSE, textindex.SEGMENT):
        assert np.flatnonzero(textindex.bits(textindex.packed(np.arange(n)))).tolist() == list(range(n))


def test_edge_store_finds_what_edges_give(spark, tmp_path):
    rng = random.Random(3)
    edges = {("N", f"n{rng.randrange(40)}", rng.choice("rs"), "M" if rng.random() < 0.2 else "N", f"n{rng.randrange(40)}") for _ in range(45)}
    edges |= {("N", "hub", "r", "N", f"n{i}") for i in range(0, 40, 9)} | {("Z", "alone", "r", "Z", "other")}
    e = spark.createDataFrame(sorted(edges), "src_label string, src string, rel string, dst_label string, dst string")
    store = edgestore.EdgeStore.build(e, f"file://{tmp_path}/e", buckets=4)
    for start in (("N", "n1"), ("N", "hub"), ("N", "none")):
        assert sorted(rows(store.neighbours(*start, 3))) == sorted(rows(graph.neighbours(e, *start, 3)))
    for a, b in ((("N", "n1"), ("N", "n8")), (("N", "n3"), ("N", "n30")), (("N", "n1"), ("Z", "alone")), (("N", "hub"), ("N", "hub")), (("N", "n2"), ("N", "hub"))):
        assert rows(store.shortest_path(a, b)) == rows(graph.shortest_path(e, a, b)), (a, b)
    assert store.shortest_path(("N", "n1"), ("N", "n8"), 1).count() == graph.shortest_path(e, ("N", "n1"), ("N", "n8"), 1).count()


def test_large_frontiers_are_shuffled(spark, tmp_path, monkeypatch):
    e = spark.createDataFrame([("N", "hub", "r", "N", f"n{i}") for i in range(30)] + [("N", f"n{i}", "r", "N", f"m{i}") for i in range(30)], "src_label string, src string, rel string, dst_label string, dst string")
    store = edgestore.EdgeStore.build(e, f"file://{tmp_path}/e", buckets=4)
    want = sorted(rows(store.neighbours("N", "hub", 2)))
    monkeypatch.setattr(edgestore, "FEW", 3)
    assert sorted(rows(store.neighbours("N", "hub", 2))) == want and len(want) == 60


def test_roll_up(spark, tmp_path):
    log = logview.events(spark, SF)
    m = logview.mentions(log)
    rolled = rollup.RollUp(spark, f"file://{tmp_path}/r")
    for name, part in (("a", "event_id % 2 = 0"), ("b", "event_id % 5 = 0"), ("b", "event_id % 2 = 1")):
        own = log.where(part)
        rolled.append(own, m.join(own.select("id"), m["log_id"] == own["id"], "left_semi"), name)
    assert sorted(rows(rolled.insights())) == sorted(rows(insights.build(log, m)))
    panels, plain = rolled.dashboard(), aggregates.dashboard(log)
    for name, panel in plain.items():
        assert sorted(map(str, rows(panels[name], *panel.columns))) == sorted(map(str, rows(panel))), name
    for r in rolled.distinct().collect():
        n = m.where(F.col("type") == r.type).select("value").distinct().count()
        assert abs(r.values - n) <= max(1, 0.05 * n)
    empty = rollup.RollUp(spark, f"file://{tmp_path}/none")
    empty.append(log.limit(0), m.limit(0), "a")
    assert [r[0] for r in rows(empty.insights())] == ["empty"]


def plain_root(nodes):
    while len(nodes) > 1:
        nodes = [batches.join(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0]


def test_mountain_range():
    leaf = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(40)]
    peaks, ranges = [], [batches.GENESIS]
    for n, h in enumerate(leaf):
        peaks = batches.add_leaf(peaks, n, h)
        assert len(peaks) == len(batches.sizes(n + 1))
        ranges.append(batches.bagged(peaks))
    for total in range(1, 41):
        for n in range(total + 1):
            proof = batches.consistency(leaf[:total], n)
            assert batches.consistent(ranges[n], n, ranges[total], total, proof)
            if proof[1]:
                assert not batches.consistent(ranges[n], n, ranges[total], total, (proof[0], [leaf[0], *proof[1][1:]]) if proof[1][0] != leaf[0] else (proof[0], proof[1][1:]))
            assert not batches.consistent(batches.join(ranges[n], leaf[0]), n, ranges[total], total, proof)
    with pytest.raises(ValueError):
        batches.consistency(leaf, 41)


def test_fold_is_the_plain_tree(spark, monkeypatch):
    monkeypatch.setattr(batches, "FOLD", 2)
    for n in (1, 2, 3, 4, 5, 16, 17, 37):
        leaf = [hashlib.sha256(f"{n} {i}".encode()).hexdigest() for i in range(n)]
        nodes = spark.createDataFrame([(b, i, h) for b in (0, 1) for i, h in enumerate(leaf)], "b int, idx long, hash string")
        assert rows(batches.fold(nodes, ("b",), n)[0].orderBy("b")) == [(0, plain_root(leaf)), (1, plain_root(leaf))]


def test_ledger_of_batches(spark, tmp_path):
    log = logview.events(spark, SF)
    ledger_of = batches.Ledger(spark, f"file://{tmp_path}/l", block=16)
    parts = [log.where(f"event_id between {a} and {b}") for a, b in ((0, 99), (100, 100), (101, 500))]
    headers = [ledger_of.seal(p, f"2026-09-0{n + 1}T00:00:00Z") for n, p in enumerate(parts)]
    assert [h["batch"] for h in headers] == [0, 1, 2] and [h["block_count"] for h in headers] == [7, 1, 25]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "l").rglob("*.parquet")}
    roots_then = [ledger_of.root(n) for n in (1, 2, 3)]
    ledger_of.seal(log.where("event_id > 500 and event_id <= 540"), "2026-09-04T00:00:00Z")
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())  # nothing old is touched
    for n in (1, 2, 3):
        assert batches.consistent(roots_then[n - 1], n, ledger_of.root(), 4, ledger_of.proof_of_beginning(n))
    assert ledger_of.verify().count() == 0
    hashes = [r.hash for r in ledger_of.leaves().where("batch = 2").orderBy("height", "idx").collect()]
    assert headers[2]["merkle_root"] == plain_root([plain_root(hashes[i : i + 16]) for i in range(0, len(hashes), 16)])
    assert len(hashes) == parts[2].count() == headers[2]["event_count"]
    some = log.where("event_id % 20 = 0 or event_id = 100").select(F.col("id").alias("event_id"))
    found = batches.check(ledger_of.proofs(some)).collect()
    assert len(found) == some.join(ledger_of.leaves(), "event_id").count() and all(r.valid for r in found) and {r.batch for r in found} == {0, 1, 2, 3}
    altered = ledger_of.leaves().where("batch = 1").withColumn("hash", F.sha2("hash", 256)).drop("batch").toPandas()
    spark.createDataFrame(altered).write.mode("overwrite").parquet(f"file://{tmp_path}/l/leaves/batch=1")
    assert rows(ledger_of.verify()) == [(1, "merkle_mismatch")]
    with pytest.raises(ValueError):
        ledger_of.seal(log.limit(0), "2026")
