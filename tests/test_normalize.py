"""Lines, files and streams."""

import pytest

from logweave.functions.normalize import parse, preview
from logweave.sources import readers
from logweave.streaming import pipeline

LINES = [
    ("pri_syslog", "<189>Sep  3 09:18:44 sw-core-02 %LINK-3-UPDOWN: Interface GigabitEthernet0/24, changed state to down", "sw-core-02", "ERROR", "2026-09-03T09:18:44"),
    ("pri_syslog", "<33>Sep  3 09:17:02 ids-sensor-01 snort[2841]: [1:2013028:5] ET POLICY", "ids-sensor-01", "ALERT", "2026-09-03T09:17:02"),
    ("rfc5424", "<165>1 2026-09-03T09:17:02.003Z mail.example.com evntslog 44 ID47 [a b=\"c\"] started", "mail.example.com", "NOTICE", "2026-09-03T09:17:02"),
    ("fortinet_kv", 'date=2026-09-03 time=09:22:03 devname="FGT-EDGE-01" level="warning" srcip=10.20.30.41 action="blocked" msg="Denied by policy"', "FGT-EDGE-01", "WARNING", "2026-09-03T09:22:03"),
    ("cef", "CEF:0|Palo Alto Networks|PAN-OS|10.2|threat|url|5|rt=Sep 03 2026 09:23:22 src=10.20.30.40 act=deny cs1=Block Malware dvchost=fw-1", "fw-1", "WARNING", "2026-09-03T09:23:22"),
    ("leef", "LEEF:2.0|Check Point|Firewall|R81|Drop|devTime=1788412522000|src=10.20.30.42|dst=172.217.16.14|host=cp-1", "cp-1", "INFO", "2026-09-03T05:15:22"),
    ("squid_access", "1788412875.123    142 10.20.30.50 TCP_DENIED/403 4213 GET http://malware.example/payload.exe - HIER_NONE/- text/html", "unknown-host", "WARNING", "2026-09-03T05:21:15"),
    ("rfc3164_wrapper", "Sep  3 09:25:10 web-srv-07 sshd[4412]: Failed password for invalid user admin", "web-srv-07", "ERROR", "2026-09-03T09:25:10"),
    ("nsx_manager", '2026-09-03T09:28:00.114Z nsx-mgr-03 NSX 3320 - [nsx@6876 comp="nsx-manager" subcomp="manager" level="ERROR"] Transport node connection lost', "nsx-mgr-03", "ERROR", "2026-09-03T09:28:00"),
    ("esxi_originator", "2026-09-03T09:27:11.482Z esx-host-11.corp.example Hostd: info hostd[2098633] [Originator@6876 sub=Vimsvc] Event 1451", "esx-host-11.corp.example", "INFO", "2026-09-03T09:27:11"),
    ("postgres_native_log", '2026-09-03 09:30:02.910 UTC [4415] app@billing FATAL:  password authentication failed', "unknown-host", "FATAL", "2026-09-03T09:30:02"),
    ("kubelet_glog", 'I0903 09:37:12.442100    1823 kubelet.go:2183] "SyncLoop DELETE"', "unknown-host", "INFO", "2026-09-03T09:37:12"),
    ("jvm_gc", "[2026-09-03T09:32:10.442+0000][gc] GC(881) Pause Young 512M->128M", "unknown-host", "DEBUG", "2026-09-03T09:32:10"),
    ("envoy_upstream_access", '[2026-09-03T09:38:44.201Z] "POST /api/checkout HTTP/1.1" 503 UF 0 91', "unknown-host", "ERROR", "2026-09-03T09:38:44"),
    ("aws_cloudtrail", '{"eventTime":"2026-09-03T09:33:00Z","eventSource":"s3.amazonaws.com","eventName":"DeleteBucket","errorCode":"AccessDenied"}', "unknown-host", "WARNING", "2026-09-03T09:33:00"),
    ("okta_system_log", '{"published":"2026-09-03T09:41:30.000Z","eventType":"user.account.lock","displayMessage":"locked","outcome":{"result":"DENY"}}', "unknown-host", "ERROR", "2026-09-03T09:41:30"),
    ("json", '{"time":"2026-09-03T09:41:30Z","host":"x1","level":"warn","msg":"hello"}', "x1", "WARNING", "2026-09-03T09:41:30"),
    ("logfmt", 'ts=2026-09-03T09:41:30Z level=error host=x2 msg="it broke"', "x2", "ERROR", "2026-09-03T09:41:30"),
    ("generic_fallback", "nothing known about this", "unknown-host", "INFO", "2026-09-05T00:00:00"),
]


def test_lines(spark):
    df = spark.createDataFrame([(i, x[1]) for i, x in enumerate(LINES)] + [(100, None), (101, "")], "n int, raw string")
    got = {r.n: r for r in parse(df, "2026-09-05").collect()}
    assert len(got) == len(LINES) + 2
    for i, (form, line, host, severity, time) in enumerate(LINES):
        r = got[i]
        assert (r.matched_format, r.hostname, r.severity, r.timestamp[:19], r.raw_message) == (form, host, severity, time, line), line
    assert got[4].attributes["cs1"] == "Block Malware" and got[5].attributes["dst"] == "172.217.16.14" and got[13].http_status == 503
    assert got[100].matched_format == got[101].matched_format == "generic_fallback"
    again = {r.n: r.id for r in parse(df, "2026-09-05").collect()}
    assert all(again[i] == got[i].id for i in got)
    assert preview(parse(df, "2026-09-05")).where("matched_format = 'cef'").first().with_host == 100.0


def test_sub_formats(spark):
    """Blocks of a Windows event, tags of a wrapped record, a sudo command, binary text, and nested JSON."""
    lines = {
        "win": "2026-09-03T09:00:00Z pc1 Microsoft-Windows-Security-Auditing - 4624 [liagent@1 keywords=\"Audit Success\" task=Logon] Logged on.\n\nSubject:\n\tSecurity ID:\t\tS-1-5-18\n\tAccount Name:\tbob\n\nNetwork Information:\n\tSource Port:\t0\n",
        "sudo": "Sep  3 09:25:44 web sudo:    alice : TTY=pts/0 ; PWD=/home/alice ; USER=root ; COMMAND=/usr/bin/systemctl restart nginx",
        "hms": "Sep  3 09:25:44 h hms[1]: 2026-09-03 09:00:00.123 INFO com.x [t-1] (ctx) [operationID=op-9; user=a] | synced",
        "binary": "\x80\x9d\xff\x1b\x93E.mu.example\x8f\xd2\x11\xa7\xfe\x03",
        "json": '{"eventTime":"2026-09-03T09:33:00Z","eventSource":"s3.amazonaws.com","eventName":"Put","a":{"b":{"c":"x","d":{"e":1}}},"ips":["1","2"],"objs":[{"z":1}],"n":null,"long":"' + "y" * 400 + '"}',
        "zeek": "1788412875.123 CHhAvVGS1DHFjwGM9 10.4.0.1 5511 10.4.0.2 443 tcp ssl 0.4 10 20 S0 - -",
        "pri": "<999>Sep  3 09:16:11 h x: y",
    }
    got = {r.n: r for r in parse(spark.createDataFrame(list(lines.items()), "n string, raw string"), "2026-09-05").collect()}
    assert got["win"].attributes["Subject.Account Name"] == "bob" and got["win"].attributes["Network Information.Source Port"] == "0" and got["win"].attributes["event_id"] == "4624"
    assert got["sudo"].attributes["exe"] == "/usr/bin/systemctl" and got["sudo"].attributes["target_user"] == "root" and got["sudo"].attributes["acct"] == "alice" and got["sudo"].attributes["command"].endswith("restart nginx")
    assert got["hms"].attributes["operationID"] == "op-9" and got["hms"].message == "synced"
    b = got["binary"]
    assert (b.hostname, b.severity, b.attributes) == ("unknown-host", "INFO", {"binary_content": "true"}) and b.message and b.raw_message == lines["binary"]
    j = got["json"].attributes
    assert j["a.b.c"] == "x" and "a.b.d.e" not in j and j["ips"] == "1, 2" and "objs" not in j and "n" not in j and len(j["long"]) == 300
    assert got["zeek"].message == "ssl 10.4.0.1:5511 -> 10.4.0.2:443 S0" and got["zeek"].attributes["conn_state"] == "S0"
    assert got["pri"].matched_format == "generic_fallback"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_sources(spark, tmp_path):
    write(tmp_path / "a/one.txt", "2026-09-03T09:00:00Z h start\n  at line 2\n\n2026-09-03T09:00:01Z h next\n")
    write(tmp_path / "a/orphan.txt", "no start here\n2026-09-03T09:00:01Z h next\n")
    write(tmp_path / "b/rows.csv", 'timestamp,hostname,message\n2026-09-03T09:00:00Z,h1,"a, b"\n2026-09-03T09:00:01Z,h2,c\n')
    write(tmp_path / "b/x.xml", "<Events><Event><System><Provider Name='p'/><EventID>4624</EventID><Computer>pc1</Computer></System><EventData><Data Name='User'>bob</Data><Data Name='Ip'>10.0.0.1</Data></EventData></Event><Event><System><EventID>1</EventID></System></Event></Events>")
    write(tmp_path / "c/doc.json", '{"events":[{"a":1},\n{"a":2},\n{"a":3}]}')
    write(tmp_path / "c/lines.jsonl", '{"a":1}\n\n{"a":2}\n')
    got = {}
    for r in readers.read_any(spark, str(tmp_path)).collect():
        got.setdefault(r.source_file, {})[r.source_record] = r.raw
    assert got["a/one.txt"] == {1: "2026-09-03T09:00:00Z h start\n  at line 2", 2: "2026-09-03T09:00:01Z h next"}
    assert got["a/orphan.txt"][1] == "no start here" and len(got["a/orphan.txt"]) == 2
    assert len(got["b/rows.csv"]) == 2 and '"a, b"' in got["b/rows.csv"][1]
    assert '"User":"bob"' in got["b/x.xml"][1] and '"EventID":"4624"' in got["b/x.xml"][1] and len(got["b/x.xml"]) == 2
    assert len(got["c/doc.json"]) == 3 and len(got["c/lines.jsonl"]) == 2
    lines = readers.scan(spark, str(tmp_path))
    assert {r.source_folder for r in lines.collect()} == {"a"}


def test_blocks_of_one_file(spark):
    text = [("f", b, n, x) for n, (b, x) in enumerate([(0, "2026-09-03T09:00:00Z h a"), (0, " 1"), (1, " 2"), (1, "2026-09-03T09:00:01Z h b"), (2, " 3"), (3, " 4"), (3, "2026-09-03T09:00:02Z h c")])]
    got = readers.reassemble(spark.createDataFrame(text, "source_file string, block long, line_no long, line string"))
    assert {r.source_record: r.raw for r in got.collect()} == {1: "2026-09-03T09:00:00Z h a\n 1\n 2", 2: "2026-09-03T09:00:01Z h b\n 3\n 4", 3: "2026-09-03T09:00:02Z h c"}


@pytest.mark.parametrize("name, head, want", [("x.csv", "a", "csv"), ("x.log", "<13>Sep 3", "text"), ("x.log", "<Events><Event/>", "xml"), ("x.log", '{"a":1}\n{"a":2}', "jsonl"), ("x", "CEF:0|a|b", "text"), ("x", "a,b,c\n1,2,3", "csv"), ("x", "plain, text here", "text")])
def test_sniffing(spark, name, head, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(readers.sniff(F.lit(name), F.lit(head))).first()[0] == want


def test_stream_equals_batch(spark, tmp_path):
    write(tmp_path / "in/a.txt", "\n".join(x[1] for x in LINES[:8] + LINES[:2]))
    query = pipeline.to_table(pipeline.events(pipeline.landing(spark, str(tmp_path / "in")), "2026-09-05"), str(tmp_path / "out"), str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    got = {r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.id for r in parse(spark.createDataFrame([(x[1],) for x in LINES[:8]], "raw string"), "2026-09-05").collect()}
    assert got == want
    assert sum(p["numInputRows"] for p in query.recentProgress) == 10


@pytest.mark.parametrize(
    ("text", "host", "process", "pid", "time"),
    [
        ("rotated archive app.log.2024.gz", None, None, None, None), ("exception in com.acme.web.Filter", None, None, None, None), ("<13>2024/01/02 10:00:00 fw01 paloalto: denied", "fw01", "paloalto", None, "2024-01-02T10:00:00"),
        ("01/02/2024 10:00:00 fw01 paloalto: denied", "fw01", "paloalto", None, "2024-02-01T10:00:00"), ("Thu Sep  3 10:00:00 2026 esx-2 vmkd[77]: up", "esx-2", "vmkd", 77, "2026-09-03T10:00:00"),
        ("03/Sep/2026:10:00:00 web-srv-07 proxy: up", "web-srv-07", "proxy", None, "03/Sep/2026:10:00:0"), ("at web-srv-07.corp.example something", "web-srv-07.corp.example", None, None, None), ("E.mu W.z 10.0.0.1 1.2", None, None, None, None),
        ("Computer=PC-1 appname=thing 12:", "PC-1", "thing", None, None), ("much later than thirty-two letters 2024/01/02 10:00:00 fw01 x: y", None, None, None, "2024-01-02T10:00:00"),
        ("see mail.corp.example and db.site.local", "db.site.local", None, None, None), ("word: rest", None, "word", None, None), ("123: rest", None, None, None, None),
    ],
)
def test_lines_of_no_known_format(spark, text, host, process, pid, time):
    r = parse(spark.createDataFrame([(text,)], "raw string"), "2026-09-05").first()
    assert r.matched_format == "generic_fallback"
    assert (r.hostname, r.process, r.pid) == (host or "unknown-host", process or "unknown-process", pid)
    assert (r.timestamp[:19] if r.timestamp_source == "event" else None) == time
