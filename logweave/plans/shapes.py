"""A line of every format for events, and what normalisation must make of it, as a query with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Line with its slots, format, source type, whether the host is in it, process, severity, component or message's first word.
#: Slots: {iso} 2024-01-02T03:04:05.678901Z, {z} with a space and no zone, {comma} with a comma, {off} with an offset, {sys}
#: Jan  2 03:04:05, {web} 02/Jan/2024:03:04:05 +0000, {host}, {k} and {id} numbers.
SHAPES = (
    ("{iso} {host} Microsoft-Windows-Security-Auditing - 4624 [liagent@1 keywords=\"Audit Success\" task=Logon] An account was logged on.\n\nSubject:\n\tAccount Name:\tuser-{k}\n", "windows_security_event", "WindowsSecurityAudit", True, "Microsoft-Windows-Security-Auditing", "NOTICE", "Logon"),
    ("{iso} {host} Service-Control-Manager - 7036 [liagent@1 task=None] The service {k} entered the stopped state.", "windows_security_event", "WindowsEventLog", True, "Service-Control-Manager", "WARNING", "None"),
    ("CEF:0|acme|wall|1|c{k}|blocked|9|rt={iso} dvchost={host} act=deny", "cef", "CEF", True, "wall", "CRITICAL", None),
    ("LEEF:1.0|acme|gate|1|dropped|devTime={iso}\thost={host}\tsev=6", "leef", "LEEF", True, "gate", "INFO", "gate"),
    ("{sys} {host} vmware-dr: {iso} warning vmware-dr[{k}] [SRM@6876 sub=Group.x opID=4e{k}] Skipping device {k}", "vmacore_appliance", "SRM", True, "vmware-dr", "WARNING", "Group.x"),
    ("{iso} verbose vpxd[{k}] [Vpxd@6876 sub=vpx] tick {k}", "vmacore_appliance", "vCenter", False, "vpxd", "DEBUG", "vpx"),
    ("{iso} {host} NSX {k} manager [nsx@6876 comp=\"nsx\" level=\"WARN\"] node {k} gone", "nsx_manager", "NSX", True, "unknown-process", "WARNING", "manager"),
    ("{iso} {host} nsx-opsagent[{k}]: NSX {k} - [nsx@6876 comp=\"nsx-esx\" level=\"INFO\"] opened {k}", "nsx_esx_agent", "NSX", True, "nsx-opsagent", "INFO", "nsx-esx"),
    ("{iso} {host} Hostd: info hostd[{k}] [Originator@6876 sub=Vimsvc] Event {k}", "esxi_originator", "ESXi", True, "Hostd", "INFO", "Vimsvc"),
    ("{iso} {host} Rhttpproxy: --> more of it", "esxi_dump_continuation", "ESXi", True, "Rhttpproxy", "DEBUG", "Rhttpproxy"),
    ("{iso} {host} healthdPlugins: storage ERROR path {k} lost", "healthd_plugin_status", "ESXi", True, "storage", "ERROR", "storage"),
    ("{iso} {host} vmkernel: cpu4:{k})NMP: path claimed", "vmkernel", "ESXi", True, "vmkernel", "INFO", "vmkernel"),
    ("{iso} {host} envoy-access[{k}]: GET /sdk 503 via_upstream", "envoy_access", "ESXi", True, "envoy-access", "ERROR", "envoy-access"),
    ("{z} {host} vcenter-server: task {k} queued", "vcenter_server", "vCenter", True, "vcenter-server", "INFO", "vcenter-server"),
    ("{iso} {host} esxupdate: {k}: vmware.runcommand: INFO: ran {k}", "esxupdate", "ESXi", True, "esxupdate", "INFO", "vmware.runcommand"),
    ("{iso} {host} sshd[{k}]: [WARNING] slow answer", "esxi_generic_proc", "ESXi", True, "sshd", "WARNING", "sshd"),
    ("{iso} {host} vrops-bridge[{k}]: [ERROR] adapter {k} gave nothing", "esxi_generic_proc", "ESXi", True, "vrops-bridge", "ERROR", "vrops-bridge"),
    ("{iso} {host} Horizon: AUDIT_SUCCESS user=u{k} action=CONNECT", "esxi_bare_proc_message", "ESXi", True, "Horizon", "INFO", "Horizon"),
    ("{iso} {host} audispd {k} - - type=SYSCALL msg=audit(1700000000.123:{k}): acct=\"root\" exe=\"/bin/su\" res=no", "appliance_placeholder_syslog", "LinuxAudit", True, "audispd", "WARNING", "audispd"),
    ("{iso} {host} crond - - - job {k} done", "appliance_placeholder_syslog", "Syslog", True, "crond", "INFO", "crond"),
    ("{off} WARN [pool-{k}] com.x.Bridge - queue grows", "vrops_bridge", "vROps", False, "vrops-bridge", "WARNING", "com.x.Bridge"),
    ("com.x.Rollup(a) - {sys}:678 - {k} ms", "vrops_profiling", "vROps", False, "vrops", "DEBUG", "com.x.Rollup(a)"),
    ("{off} INFO [ajp-{k}] [req-1] (12) com.x.Filter:44 - In * [{k}] [tag] 10.0.0.{k} GET /casa/node", "casa_ajp", "CASA", False, "casa", "INFO", "com.x.Filter"),
    ("{off} ERROR [ajp-{k}] (12) com.x.Filter:44 - Out [{k}] POST /casa/node : 500", "casa_ajp", "CASA", False, "casa", "ERROR", "com.x.Filter"),
    ("{off} INFO [ajp-{k}] [req-1] com.x.Filter:44 - plain {k}", "casa_ajp", "CASA", False, "casa", "INFO", "com.x.Filter"),
    ("{off} - UserId : admin-{k} login", "vrops_session_audit", "vROps", False, "vrops", "INFO", "vrops"),
    ("{iso} {host} View - 88 [View@6876 Severity=\"AUDIT_FAILURE\" Module=\"Broker\"] user {k} refused", "horizon_view_audit", "Horizon", True, "View", "ERROR", "Broker"),
    ("{zs} GMT GET /actuator/health HTTP/1.1 404 thread=t{k} bytes=12", "spring_actuator_access", "AriaAutomation", False, "actuator", "WARNING", "http-access"),
    ("{iso} INFO abx-service [host='{host}' thread='t{k}'] - 10.1.1.1 - - [{web}] \"GET /abx HTTP/1.1\" 502 12 {k} ms", "aria_automation_springboot", "AriaAutomation", True, "abx-service", "ERROR", "http-access"),
    ("{iso} WARN vco [host='{host}' thread='t{k}'] [run.py:12 - retry()] again {k}", "aria_automation_springboot", "AriaAutomation", True, "vco", "WARNING", "retry"),
    ("{iso} ERROR ebs [host='{host}' thread='t{k}'] com.x.Broker:7 - gone {k}", "aria_automation_springboot", "AriaAutomation", True, "ebs", "ERROR", "com.x.Broker"),
    ("{iso} INFO catalog [host='{host}' thread='t{k}'] item {k} listed", "aria_automation_springboot", "AriaAutomation", True, "catalog", "INFO", "general"),
    ("{iso} INFO {host} --- [main-{k}] com.x.Flow [run] : step {k}", "vrlcm_classic_logback", "AriaAutomation", True, "vrlcm", "INFO", "com.x.Flow"),
    ("{iso} ERROR vrlcm[{k}] [main] [com.x.Task] -- broke {k}", "vrlcm_classic_logback", "AriaAutomation", False, "vrlcm", "ERROR", "com.x.Task"),
    ("{ts} WARNING - root - vcops-watchdog - disk - nearly full {k}", "vcops_watchdog", "vROps", False, "vcops-watchdog", "WARNING", "disk"),
    ("[INFO][{zs}][{host}] configured {k}", "aria_appliance_bracket", "AriaAutomation", True, "appliance", "INFO", "appliance-config"),
    ("{z}+00:00 [warning] <0.{k}.0> closing connection", "rabbitmq_log", "AriaAutomation", False, "rabbitmq", "WARNING", "ebs-pub-sub"),
    ("{comma} backup.sh [ERROR] no space {k}", "appliance_py_script_log", "AriaAutomation", False, "appliance-script", "ERROR", "backup.sh"),
    ("[vracli] [DEBUG] status {k}", "vracli", "AriaAutomation", False, "vracli", "DEBUG", "vracli"),
    ("[{iso}] \"POST /api/{k} HTTP/1.1\" 503 UF 0 91 12", "envoy_upstream_access", "Envoy", False, "envoy", "ERROR", "envoy"),
    ("[{off3}][{k}.5s][warning][gc,heap] Pause Young {k}M", "jvm_gc", "JVM_GC", False, "jvm", "WARNING", "gc,heap"),
    ("[{off3}][safepoint] Total time {k} ms", "jvm_gc", "JVM_GC", False, "jvm", "DEBUG", "safepoint"),
    ("{z} 0x00007f{k} <warn> CFApiTransport:88 | retry {k}", "cfapi_trace", "LogForwarder", False, "liagent", "WARNING", "CFApiTransport"),
    ("{z} 0x00007f{k} <trace>", "cfapi_trace", "LogForwarder", False, "liagent", "DEBUG", "core"),
    ("[INFO] 10.2.0.{k}:5353 - {k} \"A IN db.local. udp 41 false 512\" NXDOMAIN qr,rd 41 0.0001s", "coredns", "CoreDNS", False, "coredns", "WARNING", "dns"),
    ("W{mmdd} {clock}    {k} kubelet.go:77] pod {k} slow", "kubelet_glog", "Kubernetes", False, "kubelet", "WARNING", "kubelet.go:77"),
    ("{epoch} {k} 10.2.0.1 TCP_DENIED/403 12 GET http://x.example/{k} - HIER_NONE/- text/html", "squid_access", "Squid", False, "squid", "WARNING", "proxy"),
    ("10.3.0.1 - - [{web}] \"GET /ready/{k} HTTP/1.1\" 200 2 \"-\" \"kube-probe/1.29\"", "k8s_access", "Kubernetes", False, "ingress", "INFO", "http-access"),
    ("10.3.0.1 - - [{web}] \"GET /ready/{k} HTTP/1.1\" 404 2", "k8s_access", "Kubernetes", False, "ingress", "WARNING", "http-access"),
    ("[{zs}] [NOTICE] node {k} promoted", "postgres_log", "PostgreSQL", False, "postgres", "NOTICE", "repmgr"),
    ("[{zs}] [DEBUG]looking at {k}", "postgres_log", "PostgreSQL", False, "postgres", "DEBUG", "repmgr"),
    ("{z} UTC [{k}] app@billing FATAL:  no access for {k}", "postgres_native_log", "PostgreSQL", False, "postgres", "FATAL", "server"),
    ("10.3.0.1 - u{k} [{web}] \"POST /form HTTP/1.1\" 500 2 \"-\" \"curl\" 0.2", "web_access", "WebAccess", False, "httpd", "ERROR", "access"),
    ("{iso} {k} [Warning] [MY-010068] [Server] CA certificate {k} is self signed.", "mysql_error", "MySQL", False, "mysqld", "WARNING", "Server"),
    ("{k}:M {redis} * ready to accept connections", "redis", "Redis", False, "redis-server", "NOTICE", "master"),
    ("{epoch} CHhAvVGS1DHFjwGM9 10.4.0.1 55{k} 10.4.0.2 443 tcp ssl 0.4 10 20 REJ - -", "zeek_conn", "Zeek", False, "zeek", "WARNING", "conn"),
    ("[{web}] 10.5.0.1 - admin \"GET /admin/{k} HTTP/1.1\" 200 15 3", "apache_combined_bracket_first", "CASA", False, "casa-admin", "INFO", "http-access"),
    ("{iso} WARNING metrics.collector.disk disk {k} nearly full", "bare_level_logger_log", "Kubernetes", False, "metrics", "WARNING", "metrics.collector.disk"),
    ("{iso} ERROR [worker-{k}] c.x.Order - order {k} refused", "app_logger", "Application", False, "application", "ERROR", "c.x.Order"),
    ("{z} [Warning] backup {k} skipped", "bracket_level_app", "Application", False, "application", "WARNING", "application"),
    ("{comma} - service - ERROR - replicas {k} of 9", "deployment_health_log", "Kubernetes", False, "deployment-health", "ERROR", "service"),
    ("{sys} {host} minio-logs[{k}]: {'api': {'name': 'GetObject', 'bucket': 'b', 'object': 'o{k}', 'status': 'OK', 'statusCode': 404}, 'trigger': None}", "rfc3164_wrapper", "MinIO", True, "minio", "WARNING", "S3-API"),
    ("{sys} {host} kernel: [{k}.5] audit: type=1400 audit(1700000000.1:{k}): apparmor=\"DENIED\" operation=\"open\"", "rfc3164_wrapper", "LinuxAudit", True, "kernel", "WARNING", "apparmor"),
    ("{sys} {host} kernel: [{k}.5] TCP: syn flood on {k}", "rfc3164_wrapper", "LinuxKernel", True, "kernel", "INFO", "kernel"),
    ("{sys} {host} sshd[{k}]: pam_unix(sshd:session): session opened for user u{k}(uid=0) by (uid=0)", "rfc3164_wrapper", "LinuxAudit", True, "sshd", "NOTICE", "pam-session"),
    ("{sys} {host} sudo:    u{k} : TTY=pts/0 ; PWD=/home ; USER=root ; COMMAND=/bin/ls -l", "rfc3164_wrapper", "LinuxAudit", True, "sudo", "NOTICE", "sudo-command"),
    ("{sys} {host} Configurator: {ts},678 WARN (main-{k}) [ctx] com.x.Conf - slow {k}", "rfc3164_wrapper", "Horizon", True, "Configurator", "WARNING", "com.x.Conf"),
    ("{sys} {host} hms[{k}]: {z} INFO com.x.Hms [t-{k}] (ctx) [operationID=op-{k}; user=a] | synced", "rfc3164_wrapper", "HMS", True, "hms", "INFO", "com.x.Hms"),
    ("{sys} {host} cupsd[{k}]: job {k} done", "rfc3164_wrapper", "Syslog", True, "cupsd", "INFO", "cupsd"),
    ("<165>1 {iso} {host} app {k} ID47 [a b=\"c]d\"] started {k}", "rfc5424", "Syslog", True, "app", "NOTICE", "ID47"),
    ("device=\"XG\" date=2024-01-02 time=03:04:05 device_name=\"{host}\" log_id={k} log_type=\"Firewall\" log_component=\"Rule\" log_subtype=\"Denied\" status=\"Deny\"", "sophos_kv", "XG", True, "Rule", "WARNING", "Denied"),
    ("date=2024-01-02 time=03:04:05 devname=\"{host}\" type=\"traffic\" subtype=\"forward\" level=\"warning\" action=\"blocked\" msg=\"no {k}\"", "fortinet_kv", "Fortinet", True, "traffic", "WARNING", "forward"),
    ("time=\"{iso}\" level=error msg=\"loop {k}\" namespace=moby path=/run", "logfmt", "logfmt", False, "moby", "ERROR", "logfmt"),
    ("<166>{sys} {host} %ASA-6-302013: Built connection {k}", "pri_syslog", "Cisco", True, "ASA", "INFO", "ASA"),
    ("<33>{sys} {host} snort[{k}]: [1:2013028:5] policy", "pri_syslog", "Snort", True, "snort", "ALERT", "snort"),
    ("<134>{sys} {host} filterlog: 5,,,{k},igb0,match,block", "pri_syslog", "pfSense", True, "filterlog", "INFO", "filterlog"),
    ("<134>{sys} {host} charon[{k}]: peer {k} up", "pri_syslog", "IPsec", True, "charon", "INFO", "charon"),
    ("<134>{sys} {host} modbus[{k}]: value={k}", "pri_syslog", "NetworkDevice", True, "modbus", "INFO", "modbus"),
    ("{\"eventTime\":\"{iso}\",\"eventSource\":\"s3.amazonaws.com\",\"eventName\":\"DeleteBucket\",\"errorCode\":\"AccessDenied\",\"userIdentity\":{\"userName\":\"u{k}\"}}", "aws_cloudtrail", "AWS-CloudTrail", False, "unknown-process", "WARNING", "s3.amazonaws.com"),
    ("{\"time\":\"{iso}\",\"resourceId\":\"/SUBSCRIPTIONS/{k}\",\"operationName\":\"write\",\"category\":\"Administrative\",\"resultType\":\"Failed\",\"level\":\"Warning\"}", "azure_activity", "Azure", False, "unknown-process", "WARNING", "Administrative"),
    ("{\"timestamp\":\"{iso}\",\"severity\":\"NOTICE\",\"protoPayload\":{\"serviceName\":\"compute\",\"methodName\":\"delete{k}\"}}", "gcp_audit", "GCP-Audit", False, "unknown-process", "NOTICE", "compute"),
    ("{\"kind\":\"Event\",\"verb\":\"delete\",\"requestURI\":\"/api/{k}\",\"requestReceivedTimestamp\":\"{iso}\",\"responseStatus\":{\"code\":403}}", "k8s_audit", "Kubernetes-Audit", False, "unknown-process", "WARNING", None),
    ("{\"published\":\"{iso}\",\"eventType\":\"user.lock\",\"displayMessage\":\"locked {k}\",\"outcome\":{\"result\":\"DENY\"}}", "okta_system_log", "Okta", False, "unknown-process", "ERROR", "user.lock"),
    ("{\"isotimestamp\":\"{iso}\",\"factor\":\"push\",\"integration\":\"VPN\",\"result\":\"denied\",\"reason\":\"r{k}\"}", "duo_auth", "Duo", False, "unknown-process", "ERROR", "VPN"),
    ("{\"metadata\":{\"eventType\":\"D\",\"eventCreationTime\":\"{iso}\"},\"event\":{\"ComputerName\":\"{host}\",\"SeverityName\":\"CRITICAL\",\"DetectName\":\"dump\"}}", "crowdstrike_falcon", "CrowdStrike", True, "unknown-process", "CRITICAL", "dump"),
    ("{\"AlertId\":\"a{k}\",\"Severity\":\"High\",\"Title\":\"shell\",\"Category\":\"Execution\",\"DeviceName\":\"{host}\",\"AlertTime\":\"{iso}\"}", "defender_alert", "MicrosoftDefender", True, "unknown-process", "ERROR", "Execution"),
    ("nothing known about {k}", "generic_fallback", "Unknown", False, "unknown-process", "INFO", "unknown-process"),
)


def _slots() -> dict[str, Column]:
    ts = lambda form: F.date_format("ts", form)
    day = F.lpad(F.date_format("ts", "d"), 2, " ")
    return {
        "iso": F.concat("timestamp", F.lit("Z")), "z": ts("yyyy-MM-dd HH:mm:ss.SSS"), "zs": ts("yyyy-MM-dd HH:mm:ss"), "ts": ts("yyyy-MM-dd'T'HH:mm:ss"), "comma": ts("yyyy-MM-dd HH:mm:ss,SSS"),
        "off": F.concat(ts("yyyy-MM-dd'T'HH:mm:ss,SSS"), F.lit("+0000")), "off3": F.concat(ts("yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+0000")), "sys": F.concat(ts("MMM"), F.lit(" "), day, F.lit(" "), ts("HH:mm:ss")),
        "web": F.concat(ts("dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000")), "mmdd": ts("MMdd"), "clock": ts("HH:mm:ss.SSSSSS"), "redis": ts("dd MMM yyyy HH:mm:ss.SSS"),
        "epoch": F.concat(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.lit(".123")), "host": F.col("hostname"), "k": F.col("k").cast("string"), "id": F.col("event_id").cast("string"),
    }


def lines(log: DataFrame) -> DataFrame:
    """(event_id, raw): a line for each event, in the shape of its number."""
    slots, n = _slots(), F.pmod("event_id", F.lit(len(SHAPES)))
    filled = F.get(F.array(*(F.lit(s[0]) for s in SHAPES)), n.cast("int"))
    for name, value in slots.items():
        filled = F.replace(filled, F.lit(f"{{{name}}}"), value)
    return log.select("event_id", filled.alias("raw"))


def expected_sql() -> str:
    text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {text(f)}, {text(source)}, {str(host).lower()}, {text(process)}, {text(severity)}, {text(component)})" for k, (_, f, source, host, process, severity, component) in enumerate(SHAPES))
    odd = reduce(lambda acc, k: f"{acc} WHEN {k} THEN 'c' || k", (k for k, s in enumerate(SHAPES) if s[1] == "cef"), "CASE n") + " ELSE coalesce(f.component, f.process) END"
    return f"""SELECT event_id, f.format AS matched_format, f.source AS source_type, CASE WHEN f.host THEN hostname ELSE 'unknown-host' END AS hostname, f.process, f.severity, {odd} AS component
FROM log JOIN (VALUES {rows}) f(n, format, source, host, process, severity, component) ON event_id % {len(SHAPES)} = n"""
