"""Steps that many queries share: events dealt over all cores, read once, and counted before they are tested."""

import random

from pyspark.sql import functions as F

from logweave.operators import entities, graph, insights, ledger, mining, rollup, textindex
from logweave.plans import catalog, logview, stores

SF = "/root/testdata/sf0.001"


def test_heavy_queries_use_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    plain = logview.events(spark, SF)
    assert plain.rdd.getNumPartitions() < cores
    for name in ("p2_formats", "p24_preview", "g1_keys", "g3_forms", "m3_slots", "m5_drafts", "g4_mentions"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert f"RepartitionByExpression [event_id" in plan or name == "m5_drafts", name
    dealt = logview.events(spark, SF, heavy=True)
    assert dealt.rdd.getNumPartitions() == 4 * cores
    assert dealt.exceptAll(plain).count() == plain.exceptAll(dealt).count() == 0


def test_observations_read_events_once(spark, tmp_path):
    path = str(tmp_path / "log")
    logview.events(spark, SF).write.parquet(path)
    log = spark.read.parquet(path)
    assert path not in insights.build(log)._jdf.queryExecution().toString()
    bare = log.drop("component")  # facts need all columns; without them the rules read the events
    assert sorted(map(str, insights.build(bare).collect())) == sorted(map(str, insights.build(log).collect()))


def test_roll_up_of_queries_reads_mentions_of_its_own_batch(spark, monkeypatch):
    seen = []
    append = rollup.RollUp.append
    monkeypatch.setattr(rollup.RollUp, "append", lambda self, log, m, batch: (seen.append(m._jdf.queryExecution().toString()), append(self, log, m, batch))[1])
    monkeypatch.setattr(stores, "_BUILT", {})
    stores.rolled(spark, SF)
    assert len(seen) == 2 and all("Join" not in plan for plan in seen)


def test_tokens_are_told_apart_as_by_the_list(spark):
    """Types are those of the first pattern that takes a token; values are counted without a row for each line and kind of count."""
    lines = spark.createDataFrame([(x,) for x in ("INFO a-b 12 0x1f 1.5 10.0.0.1:80 <13> \"q\" [b] _x deadbeef-0000-1111-2222-333344445555 WARN: Jan  2 03:04:05", "a\tb\n: ! é 2024-01-02T03:04:05Z 00:1a:2b:3c:4d:5e", "ERROR")], "raw string")
    tokens = lines.select(F.explode(mining.tokenise(F.col("raw"))).alias("t")).select("t.*").collect()
    import re

    for t in tokens:
        want = next(name for name, p in mining.TOKENS if re.fullmatch(p, t.text, re.ASCII))
        assert t.type == want, t
    assert "Expand" not in mining.slots(lines)._jdf.queryExecution().executedPlan().toString()


def test_proofs_move_no_row_for_a_step(spark):
    log = logview.events(spark, SF)
    blocks, tree = ledger.seal(log, "2026-09-01T00:00:00Z", 16)
    found = ledger.proofs(tree, tree.where("idx % 3 = 0 or height = 2").select("event_id"), 16)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Generate") == 1
    assert found.count() == tree.where("idx % 3 = 0 or height = 2").count() == ledger.check_proofs(found, blocks).where("valid").count()


def test_edges_come_from_each_event_alone(spark):
    """No event is joined with its mentions: two events of one id keep their own users, and the result is that of mentions."""
    log = logview.events(spark, SF)
    found = logview.edges(log)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in graph.both_ways(found)._jdf.queryExecution().optimizedPlan().toString()
    want = graph.edges(log, logview.mentions(log))
    assert sorted(found.collect()) == sorted(want.collect())
    core = logview.edges(log, ("RUNS_ON",))
    assert sorted(core.collect()) == sorted(want.where("rel = 'RUNS_ON'").collect())
    twice = log.limit(2).withColumn("id", F.lit("one")).withColumn("user_name", F.concat(F.lit("u"), F.monotonically_increasing_id().cast("string")))
    assert {r.src for r in logview.edges(twice).where("rel = 'ACCESSED'").collect()} == {"u0", "u1"}
    both = graph.both_ways(spark.createDataFrame([("A", "x", "R", "B", "y")], "src_label string, src string, rel string, dst_label string, dst string"))
    assert both.columns == ["a_label", "a", "rel", "b_label", "b"] and sorted(map(tuple, both.collect())) == [("A", "x", "R", "B", "y"), ("B", "y", "R", "A", "x")]


def test_edges_of_odd_entities(spark):
    """The first of each type counts; an event without entities has its core edges; a node has no edge to itself."""
    schema = "id string, hostname string, process string, component string, source_type string, severity string, day string, entities array<struct<type:string,value:string>>"
    data = [("1", "h", "p", "c", "s", "INFO", "d", [("pod", "a"), ("user", "u"), ("pod", "b"), ("namespace", "n"), ("odd", "x")]), ("2", "h2", None, "c", None, None, None, None), (None, "h3", None, None, None, None, None, [("user", "v"), ("domain", "w")])]
    got = {tuple(r) for r in graph.edges(spark.createDataFrame(data, schema)).collect()}
    assert got == {
        ("Process", "p", "RUNS_ON", "Host", "h"), ("Host", "h", "IS_TYPE", "SourceType", "s"), ("Component", "c", "PART_OF", "Process", "p"), ("User", "u", "ACCESSED", "Host", "h"),
        ("Pod", "a", "IN_NAMESPACE", "Namespace", "n"), ("User", "v", "ACCESSED", "Host", "h3"), ("User", "v", "MEMBER_OF", "Domain", "w"),
    }


def test_names_come_from_each_event_alone(spark, monkeypatch):
    """The index of names takes nodes without joining events with their mentions, and has those of the graph."""
    log = logview.events(spark, SF).withColumn("id", F.when(F.col("event_id") > 5, F.col("id")))
    found = logview.named(log)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = logview.nodes(log, logview.mentions(log)).select("label", "value")
    assert sorted(found.collect()) == sorted(want.collect())
    seen = []
    monkeypatch.setattr(textindex, "index_nodes", lambda nodes, path: seen.append(nodes._jdf.queryExecution().optimizedPlan().toString()))
    monkeypatch.setattr(stores, "_BUILT", {})
    stores.names(spark, SF)
    assert "Join" not in seen[0]


def test_marks_hide_no_entity(spark, monkeypatch):
    """Texts that hold no mark of a type hold nothing of it, and no pattern is run on them."""
    bits = ["naa.600508b1", "eui.00a098", "t10.ATA_x", "mpx.vmhba0:C0", "haTask-1-vim.x-22", "Task-9", "TaskQueue-3", "vm-12", "vm-a7", "host-11", "dvportgroup-3", "resgroup-8", "vim.VirtualMachine.on", "vpxapi.Some", "S-1-5-18",
        "0a1b2c3d-0000-1111-2222-333344445555", "vmnic7", "eth0", "ens192", "eno1", "bond12", "00:1a:2b:3c:4d:5e", "00-1A-2B-3C-4D-5E", "ssh.service", "a@b.slice", "x.path", "Esx_bootbank_lib_7", "Esx_locker_t", "containerd://0123456789ab",
        "GC(12)", "ABC1234", "com.vmware.q-1", "my-qq", "a-exchange", "b-queue", "https://e.org/x.", "bolt://h", "/vmfs/volumes/ds1x", "[ds one] a/b.vmx", "/var/log/x.log,", "C:\\\\a\\b", "C:\\tmp", "api.ns.svc.cluster.local", "10.1.2.3:80", "none", "É"]
    rng = random.Random(5)
    data = [(t,) for t in bits + [" ".join(rng.sample(bits, 3)) for _ in range(60)] + ["", None]]
    lines = spark.createDataFrame(data, "t string")
    with_marks = lines.select(entities.from_text(F.col("t")).alias("e")).collect()
    assert set(entities.MARKS) - {"cluster", "address"} == {k for k, _ in entities.SWEEPS} - {"error_code"}
    monkeypatch.setattr(entities, "MARKS", {})
    assert with_marks == lines.select(entities.from_text(F.col("t")).alias("e")).collect()
    assert {e.type for r in with_marks for e in r.e} == {k for k, _ in entities.SWEEPS} | {"dns_name", "namespace", "k8s_service", "ip"}
