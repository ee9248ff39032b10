"""Operators over events against values worked out by hand or by another engine."""

import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from logweave.operators import aggregates, entities, exports, filters, graph, ledger, mining, quality, retrieval
from logweave.plans import catalog, logview
from logweave.sources import readers

SF = "/root/testdata/sf0.001"
#: One query of each family; the driver compares them all.
CHECKED = ["g1_keys", "g3_forms", "p3_lost", "p5_composed", "p14_cleaned", "p22_flattened", "p23_blocks", "s4_formats", "s8_any_files", "m6_unmatched", "f4_listing", "a1_overview", "a2_by_day", "a9_heat_map", "a10_error_rate", "a11_top_messages", "a17_facts", "a23_shares", "q23_users_of_hosts", "q36_logs_with_files", "q42_hosts_sharing_users", "q47_share_of_host", "w3_findings", "g4_mentions", "g9_edges", "g10_neighbours", "j5_related", "r1_vectors", "x3_ocsf", "x5_cef", "x13_upsert", "i1_leaves", "d1_completeness", "d9_backfill_by_raw", "p1_normalised", "s3_reassembled"]


def rows(frame, columns):
    def text(v):
        return "None" if v is None or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(text(r[c]) for c in columns) for r in frame)


@pytest.mark.parametrize("name", CHECKED)
def test_against_duckdb(spark, name):
    got = catalog.QUERIES[name](spark, SF)
    other = duckdb.connect()
    for t in ("events", "embeddings", "documents"):
        other.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = other.sql(catalog.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows([r.asDict() for r in got.collect()], columns) == rows([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filter():
    with pytest.raises(ValueError):
        filters.LogFilter(start="2024-02-01", end="2024-01-01")
    with pytest.raises(ValueError):
        filters.LogFilter(start="yesterday")
    f = filters.LogFilter(severity="error", search="x")
    assert f.active and f.describe() == {"severity": "error", "search": "x"} and not filters.ALL.active


def test_empty_log(spark):
    log = logview.events(spark, SF).limit(0)
    assert aggregates.overview(log).first().total_logs == 0
    assert aggregates.top_messages(log).count() == aggregates.heat_map(log).count() == 0
    with pytest.raises(ValueError):
        ledger.seal(log, "2024")


def fixture_events(spark, n):
    rows_ = [(f"log-{i:04d}", f"2026-09-04T10:{i % 60:02d}:00+00:00", f"fw-edge-{i % 4:02d}", "Firewall", "policy-engine", "INFO" if i % 3 == 0 else "WARNING", f"connection {i} denied by rule DMZ-DENY-07", "pri_syslog", f"raw \u001b é \" {i}") for i in range(n)]
    return spark.createDataFrame(rows_, "id string, timestamp string, hostname string, source_type string, process string, severity string, message string, matched_format string, raw_message string")


def plain_root(leaves):
    h = lambda a, b: hashlib.sha256(b"\x01" + bytes.fromhex(a) + bytes.fromhex(b)).hexdigest()
    while len(leaves) > 1:
        leaves = [h(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 17, 33])
def test_ledger(spark, n):
    log = fixture_events(spark, n)
    blocks, tree = ledger.seal(log, "2026-09-05T00:00:00Z", block=16)
    events = sorted((r.asDict() for r in log.collect()), key=lambda e: (e["timestamp"], e["id"]))
    leaves = [hashlib.sha256(b"\x00" + json.dumps({k: e[k] for k in ledger.SEALED}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for e in events]
    got = sorted(blocks.collect(), key=lambda b: b.height)
    assert [b.merkle_root for b in got] == [plain_root(leaves[i : i + 16]) for i in range(0, n, 16)]
    assert ledger.verify(blocks, tree, 16).count() == 0
    assert ledger.verify(blocks, tree, 16, head="0").first().kind == "head_mismatch"
    proofs = ledger.check_proofs(ledger.proofs(tree, tree.select("event_id"), 16), blocks)
    assert proofs.count() == n and proofs.where("valid").count() == n


def test_ledger_escapes(spark):
    """Control letters, and texts that look like escapes, as other JSON writers give them."""
    texts = ["\x1b[0m", "\\u001B", "\\\\u001B", "a\\\x1f", 'q"\u001f\\']
    log = fixture_events(spark, len(texts)).withColumn("message", F.get(F.array(*map(F.lit, texts)), F.regexp_extract("id", r"(\d+)$", 1).cast("int")))
    for r in log.select(*ledger.SEALED, ledger.canonical(log).alias("c")).collect():
        assert r.c == json.dumps({k: r[k] for k in ledger.SEALED}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_ledger_attacks(spark):
    blocks, tree = ledger.seal(fixture_events(spark, 33), "2026-09-05T00:00:00Z", block=16)
    kinds = lambda b, t: {(r.height, r.kind) for r in ledger.verify(b, t, 16).collect()}
    edited = tree.withColumn("hash", F.when((F.col("height") == 1) & (F.col("idx") == 3), F.sha2("hash", 256)).otherwise(F.col("hash")))
    assert kinds(blocks, edited) == {(1, "merkle_mismatch")}
    deleted = tree.where("not (height = 2 and idx = 0)")
    assert (2, "count_mismatch") in kinds(blocks, deleted)
    header = blocks.withColumn("sealed_at", F.when(F.col("height") == 0, "x").otherwise(F.col("sealed_at")))
    assert kinds(header, tree) == {(0, "header_altered")}
    resealed = blocks.withColumn("hash", F.when(F.col("height") == 0, F.sha2("hash", 256)).otherwise(F.col("hash")))
    assert {(0, "header_altered"), (1, "broken_link")} == kinds(resealed, tree)


def test_entities(spark):
    df = spark.createDataFrame([("1", "ebs-app-6f577dd6c-ttv86", {"user": "CORP\\alice", "opID": "a-1", "addr": "?", "none": "x"}, "disk naa.60014380343f89ed on vmnic0 at 10.0.0.1 and 127.0.0.1, /var/log/a.log; redis.ns1.svc.cluster.local MPA11004 host 10.0.0.1")], "id string, hostname string, attributes map<string,string>, message string")
    got = {(r.type, r.value) for r in entities.mentions(df).collect()}
    assert {("user", "alice"), ("domain", "CORP"), ("operation", "a-1"), ("pod", "ebs-app-6f577dd6c-ttv86"), ("device", "naa.60014380343f89ed"), ("network_interface", "vmnic0"), ("ip", "10.0.0.1"), ("file", "/var/log/a.log"), ("k8s_service", "redis"), ("namespace", "ns1"), ("error_code", "MPA11004")} <= got
    assert ("ip", "127.0.0.1") not in got and not any(v == "?" for _, v in got)
    many = spark.createDataFrame([("1", "h", {}, " ".join(f"10.0.0.{i}" for i in range(20)))], df.schema)
    assert entities.mentions(many).count() == entities.PER_TYPE


def test_path_and_resolution(spark):
    e = spark.createDataFrame([("User", "u", "ACCESSED", "Host", "h1"), ("Process", "p", "RUNS_ON", "Host", "h1"), ("Process", "p", "RUNS_ON", "Host", "h2")], "src_label string, src string, rel string, dst_label string, dst string")
    r = graph.shortest_path(e, ("User", "u"), ("Host", "h2")).first()
    assert r.nodes == ["User:u", "Host:h1", "Process:p", "Host:h2"] and r.hops == 3
    assert graph.shortest_path(e, ("User", "u"), ("Host", "none")).count() == 0
    assert {(x.value, x.hop) for x in graph.neighbours(e, "User", "u", 3).collect()} == {("h1", 1), ("p", 2), ("h2", 3)}


def test_exports(spark, tmp_path):
    log = spark.createDataFrame([("1", "2026-09-03T09:00:00Z", "h", "sshd", "auth", "Linux", "ERROR", 3, "Failed password a|b=c\nd", {"user": "bob"}, "rfc3164_wrapper", "raw")], "id string, timestamp string, hostname string, process string, component string, source_type string, severity string, severity_score int, message string, attributes map<string,string>, matched_format string, raw_message string")
    cef = exports.cef(log).first().value
    assert cef.startswith("CEF:0|logweave|Event export|1.0|rfc3164_wrapper|Failed password a\\|b=c d|7|") and "msg=Failed password a|b\\=c d" in cef
    doc = json.loads(exports.ocsf(log).first().value)
    assert doc["class_uid"] == 3002 and doc["type_uid"] == 300201 and doc["status_id"] == 2 and doc["user"] == {"name": "bob"} and doc["raw_data"] == "raw"
    frame = exports.syslog_frame(log).first().value
    n, body = frame.split(" ", 1)
    assert int(n) == len(body.encode()) and body.startswith("<131>1 2026-09-03T09:00:00Z h sshd - - - CEF:0|")
    assert json.loads(exports.ecs(log).first().value)["host"]["name"] == "h"
    for shape in ("ndjson", "csv"):
        exports.export(log, shape, f"{tmp_path}/{shape}")
    assert spark.read.json(f"{tmp_path}/ndjson").first().hostname == "h" and spark.read.option("header", True).option("multiLine", True).csv(f"{tmp_path}/csv").count() == 1

    def post(lines):
        if any("bad" in x for x in lines):
            raise OSError

    sent = exports.send(spark.createDataFrame([("ok",)] * 5 + [("bad",)], "value string").coalesce(1), post, batch=2, retries=2, backoff=0).first()
    assert (sent.sent, sent.dead) == (4, 2)


def test_upsert_days(spark, tmp_path):
    new = lambda v, *ids: spark.createDataFrame([(i, f"2024-01-0{i}", v) for i in ids], "id int, day string, created_at int")
    exports.upsert_days(spark, f"{tmp_path}/t", new(1, 1, 2, 3))
    exports.upsert_days(spark, f"{tmp_path}/t", new(2, 2))
    assert {(r.id, r.created_at) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {(1, 1), (2, 2), (3, 1)}
    # a key that moves to another day leaves the day it stood on
    exports.upsert_days(spark, f"{tmp_path}/t", spark.createDataFrame([(3, "2024-01-09", 3)], "id int, day string, created_at int"))
    assert {(r.id, str(r.day), r.created_at) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {(1, "2024-01-01", 1), (2, "2024-01-02", 2), (3, "2024-01-09", 3)}


def test_quality(spark):
    original = spark.createDataFrame([("f", "a"), ("f", "a"), ("g", "b")], "source_file string, raw string")
    stored = spark.createDataFrame([("f", "a"), ("g", "b"), ("g", "c")], "source_file string, raw string")
    got = {r.file: (r.missing, r.extra, r.exact) for r in quality.completeness(original, stored).collect()}
    assert got == {"f": (1, 0, False), "g": (0, 1, False)}


def test_mining(spark):
    lines = spark.createDataFrame([(f"2026-09-03 10:00:0{i} app{i}: user=bob{i} took {i} ms",) for i in range(5)] + [("other",)], "raw string")
    first = mining.drafts(lines).first()
    assert first.over_fit is False and first.coverage == 83.3 and first.fields == "timestamp,hostname,user,?"
    assert mining.drafts(lines.limit(0)).count() == 0
    assert first.lines == 5 and lines.where(F.col("raw").rlike(f"^{first.pattern}$")).count() == 5


def test_retrieval(spark):
    logs = spark.createDataFrame([("1", "a host was isolated"), ("2", "snapshot failed"), ("3", "fine")], "id string, message string")
    assert retrieval.pattern_match(logs, "snapshot_failure").first().id == "2"
    rows_ = spark.createDataFrame([("1", "x", None), ("2", "yy", [1.0])], "id string, message string, embedding array<float>")
    got = retrieval.embed_missing(rows_, lambda t: [[float(len(x))] for x in t], dimension=3).collect()
    assert [(r.id, r.embedding) for r in got] == [("1", [1.0, 0.0, 0.0])]
    name, found = retrieval.retrieve([("none", logs.limit(0)), ("some", logs)])
    assert name == "some" and found.count() == 3


def test_csv_headers_and_surplus_cells(spark, tmp_path):
    """Files of one tree with other headers, and rows longer and shorter than theirs."""
    (tmp_path / "a b.csv").write_text('host,user,code\nh1,bob,1,more,"x, ""y""\nz"\nh2,eve,2\nh3,ann\n')
    (tmp_path / "c.csv").write_text("code,host,user,note\n7,h4,joe,long note\n")
    (tmp_path / "d.csv").write_text("host,user,code\nh5,kim,3\n")
    got = {(r.source_file.replace("%20", " "), r.source_record): json.loads(r.raw) for r in readers.read_any(spark, str(tmp_path)).collect()}
    assert got == {
        ("a b.csv", 1): {"host": "h1", "user": "bob", "code": "1", "_extra_columns": ["more", 'x, "y"\nz']},
        ("a b.csv", 2): {"host": "h2", "user": "eve", "code": "2"},
        ("a b.csv", 3): {"host": "h3", "user": "ann"},
        ("c.csv", 1): {"code": "7", "host": "h4", "user": "joe", "note": "long note"},
        ("d.csv", 1): {"host": "h5", "user": "kim", "code": "3"},
    }


def test_reparse_compares_entities(spark, tmp_path):
    """The report of the query is on the entities that the new parse finds: an event for each of the first 24 shapes."""
    import datetime

    start = datetime.datetime(2024, 1, 2, 3, 4, 5, 678901)
    events = [(i, start, 100 + i, "error", 1.0, f'{{"k": {10 + i}}}') for i in range(24)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["d10_reparsed"](spark, str(tmp_path)).collect()
    # shapes 0 (user, event id), 18 (user, executable, file), 22 (thread, operation, address, path) and 23 (thread, operation, path) have more than one; 1, 4, 11, 12, 17 and 20 have one
    assert {(r.all_records, r.files, r.old_entities, r.new_entities, r.gained, r.lost) for r in got} == {(24, 4, 24, 18, 4, 14)}
    assert sorted((r.part, r.records) for r in got) == [(f"dir_file-{n}", 6) for n in range(4)]
    other = duckdb.connect()
    other.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = other.sql(catalog.ORACLE["d10_reparsed"])
    assert sorted(want.columns) == sorted(got[0].asDict())
    assert rows([r.asDict() for r in got], want.columns) == rows([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], want.columns)


def entities_of(spark, attributes, message, host="h", process="p"):
    schema = "id string, hostname string, process string, attributes map<string,string>, message string"
    return {(r.type, r.value) for r in entities.mentions(spark.createDataFrame([("1", host, process, attributes, message)], schema)).collect()}


def test_entities_of_keys(spark):
    """Addresses with ports, keys of Windows blocks, users with domains, and keys that are none."""
    assert entities_of(spark, {"client": "10.1.2.3:55658"}, "") == {("ip", "10.1.2.3"), ("port", "55658")}
    assert entities_of(spark, {"src": "pc.example.org", "dst": "0.0.0.0", "operation": "open", "file": "f", "profile": "unconfined_t"}, "") == set()
    assert entities_of(spark, {"Subject.Account Name": "ann", "Account Domain": "CORP", "Logon ID": "0x3e7", "New Logon.Security ID": "S-1-5-18", "Process Name": "C:\\a.exe", "Object Server": "x", "Workstation Name": "WS1"}, "") == {
        ("user", "ann"), ("domain", "CORP"), ("session", "0x3e7"), ("security_id", "S-1-5-18"), ("executable", "C:\\a.exe"), ("user", "WS1")}
    users = {"vpxuser:VSPHERE.LOCAL\\vpxd": {("user", "vpxuser"), ("domain", "VSPHERE.LOCAL"), ("user", "vpxd")}, "a\\b\\c": {("domain", "a\\b"), ("user", "c")}, "u@d": {("user", "u"), ("domain", "d")}, "u@d@e": {("user", "u@d@e")}, "a:b": {("user", "a:b")}}
    for raw, want in users.items():
        assert entities_of(spark, {"Acct": f'"{raw}"'}, "") == want


def test_entities_of_text(spark):
    text = "host-74 and vm-12 00:1A:2B:3C:4D:5E FF-FF-FF-FF-FF-FF at https://x.example/a. in /var/log/a.log., redis-1.redis-headless.ns.svc.cluster.local 10.0.0.1:80 127.0.0.1"
    assert entities_of(spark, {"tail": "more of vmnic7"}, text) == {
        ("managed_object", "host-74"), ("vm", "vm-12"), ("mac_address", "00:1a:2b:3c:4d:5e"), ("url", "https://x.example/a"), ("file", "/var/log/a.log"), ("k8s_service", "redis-headless"),
        ("namespace", "ns"), ("dns_name", "redis-1.redis-headless.ns.svc.cluster.local"), ("ip", "10.0.0.1"), ("network_interface", "vmnic7")}
    assert entities_of(spark, {}, "", "web-6f577dd6c-ttv86", "nginx") == {("pod", "web-6f577dd6c-ttv86"), ("k8s_service", "nginx")}
