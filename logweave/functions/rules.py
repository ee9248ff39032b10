"""The catalogue of line formats: claims in priority order, and where their fields stand.

A rule is a name, a source type, the text a line must hold (a cheap test before the pattern), a
pattern with plain groups, and the names of the groups. The first rule that matches a line claims it. A
format that wraps others has a rule for each, all under its name; the plain one is the last of them.
Groups whose names the event schema does not have become attributes.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    name: str
    source: str
    holds: str
    pattern: str
    groups: str
    severity: str = ""  # where nothing in the line tells it
    process: str | None = None
    component: str | None = None
    says: str = ""  # the message, made of groups in braces


ISO = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?)"
ZONED = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2}))"
OFFSET_ISO = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[,.]\d+[+-]\d{4})"
SYS = r"([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
NO_SYS = r"(?:[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
WRAPPED = "^" + SYS + r"\s+(\S+)\s+"
APACHE = r"\[(\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}\s[+-]\d{4})\]"
LEVEL = r"(DEBUG|INFO|NOTICE|WARNING|WARN|ERROR|CRITICAL|FATAL|TRACE)"
ADDRESS = r"(\d{1,3}(?:\.\d{1,3}){3})"
REST = r"\s*([\s\S]*)$"
REQUEST = "{http_method} {http_path} {http_status}"
SPRING = "^" + ISO + r"\s+(DEBUG|INFO|WARNING|WARN|ERROR|TRACE)\s+([\w-]+)\s+\[(host=.*?)\]\s+"
PRI = r"^<(\d{1,3})>\s*(?:" + SYS + r"\s+)?([\w.\-]+)\s+"
STRICT_PRI = r"^<(\d{1,2}|1[0-8]\d|19[01])>\s*(?:" + SYS + r"\s+)?([\w.\-]+)\s+"

#: The line formats of products, in order.
RULES = (
    Rule("windows_security_event", "WindowsSecurityAudit", "Microsoft-Windows-Security-Auditing",
         "^" + ISO + r"\s+(\S+)\s+(Microsoft-Windows-Security-Auditing)\s+-\s+(\d+)\s+\[liagent@\d+\s+([^\]]*)\]" + REST, "timestamp,host,process,event_id,kv,message"),
    Rule("windows_security_event", "WindowsEventLog", "[liagent@",
         "^" + ISO + r"\s+(\S+)\s+([\w\-]+)\s+-\s+(\d+)\s+\[liagent@\d+\s+([^\]]*)\]" + REST, "timestamp,host,process,event_id,kv,message"),
    Rule("cef", "CEF", "CEF:", r"^.*?CEF:\d+\|((?:[^|\\]++|\\.)*+)\|((?:[^|\\]++|\\.)*+)\|(?:[^|\\]++|\\.)*+\|((?:[^|\\]++|\\.)*+)\|((?:[^|\\]++|\\.)*+)\|([^|]*)\|([\s\S]*)$", "vendor,process,component,message,cef_severity,extension"),
    Rule("leef", "LEEF", "LEEF:", r"^.*?LEEF:([\d.]+)\|([^|]*)\|([^|]*)\|[^|]*\|([^|]*)\|([\s\S]*)$", "leef_version,vendor,process,message,extension"),
    Rule("vmacore_appliance", "VMwareAppliance", "@",
         "^(?:" + NO_SYS + r"\s+(\S+)\s+[\w\-.]+:\s+)?" + ZONED + r"\s+(verbose|trivia|info|warning|error|panic|debug|notice|critical)\s+([\w\-.]+)\[(\d+)\]\s+\[(\w+)@\d+\s+([^\]]*)\]" + REST,
         "host,timestamp,level,process,pid,sdid,kv,message"),
    Rule("nsx_manager", "NSX", "[nsx@", "^" + ISO + r"\s+(\S+)\s+NSX\s+(\d+)\s+([\w-]+)?\s*\[nsx@\d+\s+([^\]]*)\]" + REST, "timestamp,host,pid,component,kv,message"),
    Rule("nsx_esx_agent", "NSX", "[nsx@", "^" + ISO + r"\s+(\S+)\s+([\w.\-]+)(?:\[(\d+)\])?:\s+(?:\[vmsyslogd@\d+[^\]]*\]\s*)?NSX\s+\d+\s+-\s+\[nsx@\d+\s+([^\]]*)\]" + REST, "timestamp,host,process,pid,kv,message"),
    Rule("esxi_originator", "ESXi", "[Originator@",
         "^" + ISO + r"\s+(\S+)\s+([\w\-]+)(?:\[(\d+)\])?:\s+(?:(\w+)\s+[\w\-]+\[\d+\]\s+)?\[Originator@\d+\s+([^\]]*)\]" + REST, "timestamp,host,process,pid,level,kv,message"),
    Rule("esxi_dump_continuation", "ESXi", ": -->", "^" + ISO + r"\s+(\S+)\s+([\w\-]+):\s+-->" + REST, "timestamp,host,process,message", "DEBUG"),
    Rule("healthd_plugin_status", "ESXi", "healthdPlugins:", "^" + ISO + r"\s+(\S+)\s+healthdPlugins:\s+(\S+)\s+(ERROR|WARNING|WARN|INFO|DEBUG)\s+([\s\S]*)$", "timestamp,host,process,level,message"),
    Rule("vmkernel", "ESXi", "vmk", "^" + ISO + r"\s+(\S+)\s+(vmkernel|vmkwarning):\s*(?:cpu\d+:(\d+)\))?" + REST, "timestamp,host,process,thread,message"),
    Rule("envoy_access", "ESXi", "envoy-access[", "^" + ISO + r"\s+(\S+)\s+envoy-access\[(\d+)\]:\s+(\S+)\s+(\S+)\s+(\d+|-)\s+([\s\S]*)$", "timestamp,host,pid,http_method,http_path,http_status,message", process="envoy-access"),
    Rule("vcenter_server", "vCenter", "vcenter-server:", r"^(\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+(\S+)\s+vcenter-server:" + REST, "timestamp,host,message", process="vcenter-server"),
    Rule("esxupdate", "ESXi", "esxupdate:", "^" + ISO + r"\s+(\S+)\s+(esxupdate):\s+(\d+):\s+([\w.]+):\s+(\w+):" + REST, "timestamp,host,process,pid,component,level,message"),
    Rule("esxi_generic_proc", "ESXi", "]:", "^" + ISO + r"\s+(\S+)\s+([\w./\-]+)\[(\d+)\]:\s*(?:\[?" + LEVEL + r"\]?\b\s*(?:::\s*)?)?([\s\S]*)$", "timestamp,host,process,pid,level,message"),
    Rule("esxi_bare_proc_message", "ESXi", ": ", "^" + ISO + r"\s+([\w.\-]*[a-zA-Z][\w.\-]*)\s+([\w.\-]+):\s+([\s\S]*)$", "timestamp,host,process,message"),
    Rule("appliance_placeholder_syslog", "LinuxAudit", "audispd",
         "^" + ISO + r"\s+(\S+)\s+(audispd)\s+(\d+|-)\s+-\s+-\s*type=(\w+)\s+msg=audit\(([\d.]+):(\d+)\):" + REST, "timestamp,host,process,pid,audit_type,audit_epoch,audit_seq,message"),
    Rule("appliance_placeholder_syslog", "Syslog", " - ", "^" + ISO + r"\s+(\S+)\s+([\w.\-]+)\s+(\d+|-)\s+-\s+-" + REST, "timestamp,host,process,pid,message"),
    Rule("vrops_bridge", "vROps", "] ", "^" + OFFSET_ISO + r"\s+(\w+)\s*\[([^\]]*)\]\s+([\w.$]+)\s*-" + REST, "timestamp,level,thread,logger,message", process="vrops-bridge"),
    Rule("vrops_profiling", "vROps", " ms", r"^\s*([\w.$]+(?:\([^)]*\))?)\s*-\s*([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}):\d+\s*-\s*(\d+)\s*ms\.?$", "logger,timestamp,duration_ms", "DEBUG", process="vrops"),
    Rule("casa_ajp", "CASA", "- In",
         "^" + OFFSET_ISO + r"\s+(\w+)\s*\[([^\]]*)\]\s*(?:\[[^\]]*\]\s*)?(?:\(\d+\)\s*)?([\w.$]*)(?::\d+)?\s*-\s*((In)\s*\*?\s*\[(\d+)\]\s*(?:\[[^\]]*\]\s*)?(?:(\S+)\s+)?(GET|POST|PUT|DELETE|PATCH|HEAD)\s+(\S+)(?:\s*:\s*(.*))?)$",
         "timestamp,level,thread,logger,message,direction,request_id,client,http_method,http_path,outcome", process="casa", component="ajp"),
    Rule("casa_ajp", "CASA", "- Out",
         "^" + OFFSET_ISO + r"\s+(\w+)\s*\[([^\]]*)\]\s*(?:\[[^\]]*\]\s*)?(?:\(\d+\)\s*)?([\w.$]*)(?::\d+)?\s*-\s*((Out)\s*\*?\s*\[(\d+)\]\s*(?:\[[^\]]*\]\s*)?(?:(\S+)\s+)?(GET|POST|PUT|DELETE|PATCH|HEAD)\s+(\S+)(?:\s*:\s*(.*))?)$",
         "timestamp,level,thread,logger,message,direction,request_id,client,http_method,http_path,outcome", process="casa", component="ajp"),
    Rule("casa_ajp", "CASA", "[", "^" + OFFSET_ISO + r"\s+(\w+)\s*\[([^\]]*)\]\s*(?:\[[^\]]*\]\s*)?(?:\(\d+\)\s*)?([\w.$]*)(?::\d+)?\s*-" + REST, "timestamp,level,thread,logger,message", process="casa", component="ajp"),
    Rule("vrops_session_audit", "vROps", "UserId", "^" + OFFSET_ISO + r"\s*-\s*(UserId\s*:[\s\S]*)$", "timestamp,message", "INFO", process="vrops"),
    Rule("horizon_view_audit", "Horizon", "[View@", "^" + ISO + r"\s+(\S+)\s+(View)\s+-\s+(\d+)\s+\[View@\d+\s+([^\]]*)\]" + REST, "timestamp,host,process,event_id,kv,message"),
    Rule("spring_actuator_access", "AriaAutomation", " GMT ", r"^(\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2})\s+GMT\s+(\S+)\s+(\S+)\s+\S+\s+(\d+)\s+([\s\S]*)$",
         "timestamp,http_method,http_path,http_status,kv", process="actuator", component="http-access", says=REQUEST),
    Rule("aria_automation_springboot", "AriaAutomation", " ms",
         SPRING + r"-?\s*(\S+)\s+-\s+-\s+\[[^\]]+\]\s+\"(\S+)\s+(\S+)\s+[^\"]*\"\s+(\d+)\s+\S+\s+(?:\d+\s+)?(\d+)\s*ms\s*$",
         "timestamp,level_only,process,kv,client_ip,http_method,http_path,http_status,duration_ms", component="http-access", says=REQUEST),
    Rule("aria_automation_springboot", "AriaAutomation", "()]", SPRING + r"\[([\w.]+:\d+)\s*-\s*(\w+)\(\)\]" + REST, "timestamp,level,process,kv,source_line,component,message"),
    Rule("aria_automation_springboot", "AriaAutomation", "[host=", SPRING + r"(?:\{\}\s+)?(?![\d.]+(?::\d+)?\s*-)([\w.$]+)(?::\d+)?\s*-" + REST, "timestamp,level,process,kv,logger,message"),
    Rule("aria_automation_springboot", "AriaAutomation", "[host=", SPRING + r"([\s\S]*)$", "timestamp,level,process,kv,message", component="general"),
    Rule("vrlcm_classic_logback", "AriaAutomation", " ---", r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z)\s+(\w+)\s+(\S+)\s+---\s+\[([^\]]*)\]\s+(\S+)\s+\[([^\]]*)\]\s*:" + REST, "timestamp,level,host,thread,logger,method,message", process="vrlcm"),
    Rule("vrlcm_classic_logback", "AriaAutomation", "vrlcm[", r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z)\s+(\w+)\s+(vrlcm)\[(\d+)\]\s+\[([^\]]*)\]\s+\[([^\]]*)\]\s+--" + REST, "timestamp,level,process,pid,thread,logger,message"),
    Rule("vcops_watchdog", "vROps", " - ", r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})\s+(\w+)\s+-\s+(\S+)\s+-\s+([\w\-]+)\s+-\s+(\w+)\s+-\s+([\s\S]*)$", "timestamp,level,user,process,component,message"),
    Rule("aria_appliance_bracket", "AriaAutomation", "][", r"^\[(\w+)\]\[(\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2})\]\[([^\]]+)\]" + REST, "level,timestamp,host,message", process="appliance", component="appliance-config"),
    Rule("rabbitmq_log", "AriaAutomation", "] <", r"^(\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}\.\d+[+-]\d{2}:\d{2})\s+\[(\w+)\]\s+(<[\d.]+>)\s+([\s\S]*)$", "timestamp,level,erlang_pid,message", process="rabbitmq", component="ebs-pub-sub"),
    Rule("appliance_py_script_log", "AriaAutomation", "[", r"^(\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2},\d+)\s+(?:([\w.]+)\s+)?\[(\w+)\]" + REST, "timestamp,logger,level,message", process="appliance-script", component="general"),
    Rule("vracli", "AriaAutomation", "[vracli]", r"^\[(vracli)\]\s+\[(\w+)\]" + REST, "process,level,message", component="vracli"),
    Rule("envoy_upstream_access", "Envoy", "HTTP/", r"^\[(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z)\]\s+\"(\S+)\s+(\S+)\s+HTTP/[\d.]+\"\s+(\d+)\s+([\s\S]*)$", "timestamp,http_method,http_path,http_status,message", process="envoy"),
    Rule("jvm_gc", "JVM_GC", "[", r"^\[(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+[+-]\d{4})\](?:\[([\d.]+)s\])?(?:\[(debug|info|warning|error|trace)\s*\])?(?:\[([^\]]*)\])?" + REST, "timestamp,uptime_s,level,component,message", "DEBUG", "jvm", "gc"),
    Rule("cfapi_trace", "LogForwarder", " 0x", r"^(\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}\.\d+)\s+(0x[0-9a-fA-F]+)\s+<(\w+)>\s*(?:([\w.$]+):\d+\s*\|\s*(.*))?$", "timestamp,thread_id,level,logger,message", "DEBUG", "liagent", "core"),
    Rule("coredns", "CoreDNS", " IN ", r"^\[INFO\]\s+(\S+)\s+-\s+\d+\s+\"(\S+)\s+IN\s+(\S+)\.\s+\w+\s+\d+\s+\w+\s+\d+\"\s+(\w+)\s+\S+\s+\d+\s+([\d.]+)s$", "client,qtype,qname,rcode,duration_s", process="coredns", component="dns", says="{qtype} {qname} -> {rcode}"),
    Rule("kubelet_glog", "Kubernetes", ".go:", r"^([EWIF])(\d{4}\s+\d{2}:\d{2}:\d{2}\.\d+)\s+(\d+)\s+(\S+\.go:\d+)\]" + REST, "level,timestamp,pid,component,message", process="kubelet"),
    Rule("squid_access", "Squid", "/", r"^(\d{9,10}\.\d+)\s+(\d+)\s+(\S+)\s+(\w+)/(\d+)\s+(\d+)\s+(\S+)\s+(\S+)\s+\S+\s+\S+/\S+\s+\S+$",
         "timestamp,duration_ms,client,status,http_status,bytes,http_method,http_path", process="squid", component="proxy", says="{http_method} {http_path} {status}/{http_status}"),
    Rule("k8s_access", "Kubernetes", " - - [", "^" + ADDRESS + r"\s+-\s+-\s+\[([^\]]+)\]\s+\"(\S+)\s+(\S+)\s+[^\"]*\"\s+(\d+)\s+(\S+)(?:\s+\"[^\"]*\"\s+\"([^\"]*)\")?",
         "client_ip,timestamp,http_method,http_path,http_status,bytes,user_agent", process="ingress", component="http-access", says=REQUEST),
    Rule("postgres_log", "PostgreSQL", "] [", r"^\[(\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2})\]\s+\[(\w+)\]" + REST, "timestamp,level,message", "DEBUG", "postgres", "repmgr"),
    Rule("postgres_native_log", "PostgreSQL", " UTC [", r"^(\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}\.\d+)\s+UTC\s+\[(\d+)\]\s+(?:([^\s@]+)@(\S+)\s+)?([A-Z]+):" + REST, "timestamp,pid,db_user,db_name,level,message", "INFO", "postgres", "server"),
    Rule("web_access", "WebAccess", "\"", r"^(\S+)\s+\S+\s+(\S+)\s+" + APACHE + r"\s+\"([A-Z]+)\s+(\S*)\s*[^\"]*\"\s+(\d{3})\s+(\d+|-)(?:\s+\"([^\"]*)\"\s+\"([^\"]*)\")?(?:\s+([\d.]+))?\s*$",
         "client_ip,user,timestamp,http_method,http_path,http_status,bytes,referer,user_agent,duration_s", process="httpd", component="access", says=REQUEST),
    Rule("mysql_error", "MySQL", "[", r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z)\s+(\d+)\s+\[(\w+)\]\s*(?:\[([\w\-]+)\]\s*)?(?:\[(\w+)\]\s*)?([\s\S]*)$", "timestamp,thread_id,level,error_code,component,message", "INFO", "mysqld", "server"),
    Rule("redis", "Redis", ":", r"^(\d+):([XCSM])\s+(\d{2}\s+[A-Za-z]{3}\s+\d{4}\s+\d{2}:\d{2}:\d{2}\.\d+)\s+([.\-*#])\s+([\s\S]*)$", "pid,redis_role,timestamp,redis_mark,message", process="redis-server"),
    Rule("zeek_conn", "Zeek", ".",
         r"^(\d{9,10}\.\d+)\s+([A-Za-z0-9]{15,20})\s+" + ADDRESS + r"\s+(\d{1,5})\s+" + ADDRESS + r"\s+(\d{1,5})\s+(tcp|udp|icmp)\s+(\S+)\s+([\d.\-]+)\s+([\d\-]+)\s+([\d\-]+)\s+([A-Z0-9]{2,4})\b.*$",
         "timestamp,uid,src_ip,src_port,dst_ip,dst_port,proto,service,duration_s,orig_bytes,resp_bytes,conn_state", "INFO", "zeek", "conn", "{service} {src_ip}:{src_port} -> {dst_ip}:{dst_port} {conn_state}"),
    Rule("apache_combined_bracket_first", "CASA", "HTTP/", "^" + APACHE + r"\s+(\S+)\s+\S+\s+\S+\s+\"(\S+)\s+(\S+)\s+[^\"]*\"\s+(\d+)\s+(\d+|-)\s+(\d+)$",
         "timestamp,client_ip,http_method,http_path,http_status,bytes,duration_ms", process="casa-admin", component="http-access", says=REQUEST),
    Rule("bare_level_logger_log", "Kubernetes", "Z ", r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z)\s+(DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL)\s+((\w+)(?:\.\w+)+)\s+([\s\S]*)$", "timestamp,level,logger,process,message"),
    Rule("app_logger", "Application", "[", "^" + ISO + r"\s+" + LEVEL + r"\s+\[([^\]]*)\]\s+(\S+)\s+-\s+([\s\S]*)$", "timestamp,level,thread,logger,message", process="application"),
    Rule("bracket_level_app", "Application", "[", r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)\s+\[((?i:Trace|Debug|Info|Information|Notice|Warn|Warning|Error|Fatal|Critical))\]\s+([\s\S]*)$", "timestamp,level,message", process="application", component="application"),
    Rule("deployment_health_log", "Kubernetes", " - service - ", r"^(\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2},\d+)\s+-\s+(service)\s+-\s+(DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL)\s+-\s+([\s\S]*)$", "timestamp,component,level,message", process="deployment-health"),
    Rule("rfc3164_wrapper", "MinIO", "minio-logs", WRAPPED + r"minio-logs(?:\[(\d+)\])?:?\s?\s*(\{[\s\S]*\})\s*$", "timestamp,host,pid,minio", process="minio", component="S3-API"),
    Rule("rfc3164_wrapper", "LinuxAudit", "audit: type=", WRAPPED + r"(kernel)(?:\[\d+\])?:?\s?\[([\d.]+)\]\s+audit:\s+type=(\d+)\s+audit\(([\d.]+):(\d+)\):" + REST,
         "timestamp,host,process,kernel_uptime_s,audit_type_id,audit_epoch,audit_seq,message", component="audit"),
    Rule("rfc3164_wrapper", "LinuxKernel", "kernel", WRAPPED + r"(kernel)(?:\[\d+\])?:?\s?\[([\d.]+)\]" + REST, "timestamp,host,process,kernel_uptime_s,message", component="kernel"),
    Rule("rfc3164_wrapper", "LinuxAudit", "pam_unix(",
         WRAPPED + r"\(?([\w.\-]+)\)?(?:\[(\d+)\])?:?\s?(pam_unix\(([\w\-]+):(\w+)\):\s+session\s+(opened|closed)\s+for\s+user\s+([\w.\-$\\]+)(?:\(uid=(\d+)\))?(?:\s+by\s+([\w.\-$\\]+)(?:\(uid=(\d+)\))?)?.*)$",
         "timestamp,host,process,pid,message,pam_service,pam_type,action,acct,uid,by_user,by_uid", "NOTICE", component="pam-session"),
    Rule("rfc3164_wrapper", "LinuxAudit", "COMMAND=", WRAPPED + r"\(?(sudo|su)\)?(?:\[(\d+)\])?:?\s?(\s*([\w.\-$\\]+)\s*:\s*((?:\w+=[^;]*;\s*)*\w+=.*))$",
         "timestamp,host,process,pid,message,acct,parts", "NOTICE", component="sudo-command"),
    Rule("rfc3164_wrapper", "Horizon", "Configurator", "^" + NO_SYS + r"\s+(\S+)\s+(Configurator)(?:\[\d+\])?:?\s?(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2},\d+)\s+(\w+)\s+\(([^)]*)\)\s+\[[^\]]*\]\s+([\w.$]+)\s*-" + REST,
         "host,process,timestamp,level,thread,logger,message", "INFO"),
    Rule("rfc3164_wrapper", "HMS", "|", "^" + NO_SYS + r"\s+(\S+)\s+\(?([\w.\-]+)\)?(?:\[\d+\])?:?\s?(\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}\.\d+)\s+(\w+)\s+(\S+)\s+\[([^\]]*)\]\s+\(([^)]*)\)\s+\[([^\]]*)\]\s*\|" + REST,
         "host,process,timestamp,level,logger,thread,context,tags,message"),
    Rule("rfc3164_wrapper", "Syslog", " ", WRAPPED + r"\(?([\w.\-]+)\)?(?:\[(\d+)\])?:?\s?([\s\S]*)$", "timestamp,host,process,pid,message"),
    Rule("rfc5424", "Syslog", ">", r"^<(\d{1,2}|1[0-8]\d|19[01])>\d{1,2}\s+(-|\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2}))\s+(\S{1,255})\s+(\S{1,48})\s+(\S{1,128})\s+(\S{1,32})\s+(-(?=\s|$)|(?:\[(?:[^\]\"]++|\"(?:[^\"\\]++|\\.)*+\")*+\])+|)" + REST,
         "pri,timestamp,host,process,pid,component,kv,message", process="syslog"),
    Rule("sophos_kv", "Appliance", "log_", r"^((?=[\s\S]*device=)(?=[\s\S]*log_(?:type|component)=)[\s\S]*|(?=[\s\S]*log_type=)(?=[\s\S]*log_component=)[\s\S]*)$", "kv", process="appliance", component="firewall"),
    Rule("fortinet_kv", "Fortinet", "=", r"^((?=(?i:date=\d{4}-\d{2}-\d{2}\s+time=\d{2}:\d{2}:\d{2})\b|.*\b(?i:devname=)\"?[\w.\-])[\s\S]*)$", "kv", process="firewall", component="firewall"),
    Rule("logfmt", "logfmt", "=", r"^((?=.*\b(?i:msg|message|event)=)(?=(?:.*?[A-Za-z_][\w.\-]*=){3})[\s\S]*)$", "kv", process="logfmt", component="logfmt"),
    Rule("pri_syslog", "Cisco", "%", STRICT_PRI + r"%([A-Z0-9_]+)-(\d)-([A-Z0-9_]+):" + REST, "pri,timestamp,host,process,cisco_severity,cisco_mnemonic,message"),
    Rule("pri_syslog", "Cisco", "%", STRICT_PRI + r"[^\s:\[]{1,48}(?:\[\d+\])?:?\s*%([A-Z0-9_]+)-(\d)-([A-Z0-9_]+):" + REST, "pri,timestamp,host,process,cisco_severity,cisco_mnemonic,message"),
    Rule("pri_syslog", "NetworkDevice", ">", STRICT_PRI + r"([^\s:\[]{1,48})(?:\[(\d+)\])?:?" + REST, "pri,timestamp,host,process,pid,message"),
)

#: Groups that have a place in the event schema, or tell one; all others are attributes.
FIELDS = {
    "timestamp", "host", "process", "pid", "component", "logger", "level", "level_only", "message", "kv", "extension", "pri", "cef_severity", "sdid", "redis_mark", "cisco_severity", "minio", "tags", "parts",
}
#: Products by the tag of a line with a priority.
TAGS = (("^snort", "Snort"), ("^suricata", "Suricata"), ("^openvpn", "OpenVPN"), ("^filterlog", "pfSense"), ("^ASM|^bigip", "F5-BIGIP"), ("^charon|^ipsec|^strongswan", "IPsec"), ("^sshd", "SSH"), ("^haproxy", "HAProxy"), ("^nginx", "NGINX"))
#: Sources by the name of a structured element, roles and marks of Redis, bad ends of connections, facilities.
SD_SOURCES = {"SRM": "SRM", "Originator": "ESXi", "Vpxd": "vCenter", "Hms": "vSphereReplication"}
REDIS_ROLES = {"X": "sentinel", "C": "child", "S": "replica", "M": "master"}
REDIS_MARKS = {".": "DEBUG", "-": "INFO", "*": "NOTICE", "#": "WARNING"}
BAD_STATES = ("REJ", "RSTO", "RSTR", "RSTOS0", "RSTRH", "S0", "SH", "SHR")
FACILITIES = (
    "kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "12", "13", "14", "15", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
)

#: Formats of JSON records: name, source type, paths that must be there, paths of fields.
JSON_RULES = (
    ("aws_cloudtrail", "AWS-CloudTrail", ("eventSource", "eventName"), {"timestamp": "eventTime", "component": "eventSource", "message": "eventName", "error_code": "errorCode", "user": "userIdentity.userName", "src": "sourceIPAddress"}),
    ("azure_activity", "Azure", ("operationName", "resourceId"), {"timestamp": "time", "level": "level", "message": "operationName", "component": "category", "result": "resultType"}),
    ("gcp_audit", "GCP-Audit", ("protoPayload",), {"timestamp": "timestamp", "level": "severity", "message": "protoPayload.methodName", "component": "protoPayload.serviceName", "user": "protoPayload.authenticationInfo.principalEmail"}),
    ("k8s_audit", "Kubernetes-Audit", ("verb", "requestURI"), {"timestamp": "requestReceivedTimestamp", "http_method": "verb", "http_path": "requestURI", "message": "requestURI", "http_status": "responseStatus.code", "user": "user.username"}),
    ("okta_system_log", "Okta", ("eventType", "published"), {"timestamp": "published", "message": "displayMessage", "component": "eventType", "result": "outcome.result", "user": "actor.alternateId", "client": "client.ipAddress"}),
    ("duo_auth", "Duo", ("isotimestamp", "factor"), {"timestamp": "isotimestamp", "message": "reason", "component": "integration", "result": "result", "user": "username", "client": "ip"}),
    ("crowdstrike_falcon", "CrowdStrike", ("metadata.eventType", "event"), {"timestamp": "metadata.eventCreationTime", "host": "event.ComputerName", "level": "event.SeverityName", "message": "event.DetectDescription", "component": "event.DetectName"}),
    ("defender_alert", "MicrosoftDefender", ("AlertId", "Title"), {"timestamp": "AlertTime", "host": "DeviceName", "level": "Severity", "message": "Title", "component": "Category"}),
)
#: Names under which structured records carry a field.
ALIASES = {
    "timestamp": ("timestamp", "@timestamp", "datetime", "time", "ts", "date", "event_time", "eventtime", "log_time", "created_at", "received_at", "timecreated"),
    "host": ("hostname", "host", "computer", "computername", "device", "device_name", "devicename", "devname", "machine", "server", "node"),
    "source_type": ("source_type", "source", "sourcetype", "vendor", "product", "log_source", "type"), "process": ("process", "process_name", "app", "application", "program", "service", "daemon", "appname", "provider"),
    "component": ("component", "module", "subsystem", "logger", "facility"), "level": ("severity", "level", "log_level", "loglevel", "priority", "lvl", "criticality", "sev"),
    "message": ("message", "msg", "text", "description", "log", "event", "body", "details", "raw", "summary"), "pid": ("pid", "process_id", "processid"),
}
#: Words of a severity.
LEVELS = {
    "EMERGENCY": "EMERGENCY", "PANIC": "EMERGENCY", "FATAL": "FATAL", "F": "FATAL", "ALERT": "ALERT", "CRITICAL": "CRITICAL", "CRIT": "CRITICAL", "MAJOR": "CRITICAL", "ERROR": "ERROR", "ERR": "ERROR", "E": "ERROR", "HIGH": "ERROR",
    "WARNING": "WARNING", "WARN": "WARNING", "W": "WARNING", "MEDIUM": "WARNING", "NOTICE": "NOTICE", "INFO": "INFO", "INFORMATION": "INFO", "INFORMATIONAL": "INFO", "I": "INFO", "NORMAL": "INFO", "SUCCESS": "INFO", "LOG": "INFO", "LOW": "INFO",
    "DEBUG": "DEBUG", "TRACE": "DEBUG", "VERBOSE": "DEBUG", "TRIVIA": "DEBUG",
}
#: Where a record of several lines starts.
RECORD_START = "|".join((
    r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:?\d{2})?\b", r"^\[\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?([+-]\d{4}|Z)\]", r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s",
    r"^[EWIF]\d{4}\s+\d{2}:\d{2}:\d{2}\.\d+\s+\d+\s", r"^\d{9,10}\.\d+\s+\d+\s", r'^\[INFO\]\s+\d{1,3}(?:\.\d{1,3}){3}:\d+\s+-\s+\d+\s+"', r"^\d{1,3}(?:\.\d{1,3}){3}\s+-\s+-\s+\[\d{1,2}/[A-Za-z]{3}/\d{4}",
    r"^\[\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}\s[+-]\d{4}\]", r"^\[\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}\]\s+\[\w+\]", r"^<\d{1,3}>", r"^(?:CEF|LEEF):\d", r"^\{", r"^(?:date|time|devname|devid|itime)=\S", r"^[A-Z][a-z]{2}\s+[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\d{4}\b",
))
