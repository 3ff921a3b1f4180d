"""For each query of ``checks`` the same result in plain SQL for DuckDB."""

from tidewatch.plans.checks import DOMAINS, MALICIOUS, TOR
from tidewatch.plans.testflows import FLOWS_SQL

# Fixed values, written here once more, so that a wrong table of the operators shows.
AUTH_PORTS = [21, 22, 23, 25, 80, 110, 143, 443, 3389, 8080, 8443]
EXPECTED_PORTS = {
    "HTTP": [80, 8080], "HTTPS": [443, 8443], "DNS": [53], "SSH": [22], "FTP": [20, 21], "SMTP": [25],
}
LOGIN_SERVICES = {21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 80: "HTTP", 443: "HTTPS", 3389: "RDP"}
PORT_SERVICES = {
    20: "FTP-Data", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 80: "HTTP", 110: "POP3", 143: "IMAP",
    443: "HTTPS", 445: "SMB", 993: "IMAPS", 995: "POP3S", 3306: "MySQL", 3389: "RDP", 5432: "PostgreSQL", 5900: "VNC",
    6379: "Redis", 8080: "HTTP-Proxy", 8443: "HTTPS-Alt", 27017: "MongoDB",
}
TIE_ORDER = "detector_no, event_id, role_no, dst_port"
CATEGORY_ADVICE = [
    ("threat_intel", "CRITICAL: Block all communication with known malicious IPs immediately. Isolate affected hosts and conduct forensic investigation."),
    ("c2", "CRITICAL: C2 beaconing detected - isolate the affected host from the network. Run full malware scan and check for lateral movement."),
    ("brute_force", "HIGH: Implement account lockout policies and multi-factor authentication. Block attacking IPs at the perimeter firewall."),
    ("reconnaissance", "HIGH: Port scanning detected - review firewall rules and minimize exposed services. Ensure all exposed services are patched and hardened."),
    ("ddos", "HIGH: Deploy DDoS mitigation (rate limiting, traffic scrubbing). Consider CDN/WAF services for critical applications."),
    ("exfiltration", "HIGH: Investigate large outbound data transfers. Implement Data Loss Prevention (DLP) policies and monitor for unauthorized data movement."),
    ("insider_threat", "MEDIUM: Review after-hours network activity. Verify if scheduled tasks or legitimate maintenance was occurring. Enhance monitoring."),
    ("anomaly", "MEDIUM: Investigate traffic anomalies. Establish network baselines and tune detection thresholds to reduce false positives."),
]
NO_ADVICE = "No significant threats detected. Continue regular monitoring and keep detection signatures updated."
# By rule: advice and technique; a service stands in the brute-force advice twice.
RULE_TEXTS = """CASE rule_name
 WHEN 'Known Malicious IP Contact' THEN 'T1071|Immediately investigate the host communicating with this IP. Block the IP at the firewall and check for compromise indicators.'
 WHEN 'TOR Exit Node Communication' THEN 'T1090.003|Investigate why TOR is being used. May indicate data exfiltration or access to dark web services.'
 WHEN 'Known Malicious Domain Contact' THEN 'T1071.001|Block the domain immediately. Investigate the source host for malware.'
 WHEN 'DDoS Attack Detected' THEN 'T1498|Activate DDoS mitigation. Enable rate limiting and geo-blocking. Contact upstream ISP for traffic scrubbing if needed. Consider CDN/WAF deployment.'
 WHEN 'Potential Data Exfiltration' THEN 'T1048|Investigate the source host for malware. Check what data was transferred and to which destinations. Review DLP policies.'
 WHEN 'C2 Beaconing Pattern Detected' THEN 'T1071|PRIORITY: Investigate the destination IP immediately for C2 infrastructure. Isolate the source host. Capture network traffic for forensic analysis. Check for malware on the infected host.'
 WHEN 'After-Hours Network Activity' THEN 'T1078|Verify if this activity is expected (e.g., scheduled jobs, maintenance). If not, investigate for potential insider threat or compromised account.'
 WHEN 'Statistical Traffic Anomaly' THEN '|Investigate the source for automated scanning, malware activity, or misconfigured applications generating excessive traffic.'
 ELSE CASE WHEN rule_id = 'RULE-001' THEN 'T1046|Block the scanning IP at the firewall. Review if any scanned ports have known vulnerabilities. Monitor for follow-up exploitation.'
 WHEN rule_id = 'RULE-003' THEN concat('T1110|Block ', src_ip, ' immediately. Enable account lockout policies. Consider implementing MFA for ', replace(rule_name, ' Brute Force Attack', ''), ' access. Check if any credentials were compromised.') END END"""

FLOWS = f"WITH RECURSIVE f AS ({FLOWS_SQL})"
BYTES = "bytes_sent + bytes_received"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def _case(column: str, names: dict, default: str) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items())
    return f"CASE {column} {whens} ELSE {default} END"


def _even(x: str) -> str:
    """One decimal, ties to even, as the C library prints a number."""
    return f"printf('%.1f', {x})"


def _human(size: str) -> str:
    whens = " ".join(
        f"WHEN abs({size} / 1024.0 ** {p}) < 1024 THEN {_even(f'{size} / 1024.0 ** {p}')} || ' {u}'"
        for p, u in enumerate(["B", "KB", "MB", "GB", "TB"])
    )
    return f"CASE {whens} ELSE {_even(f'{size} / 1024.0 ** 5')} || ' PB' END"


# ---- ingest: the flows themselves -----------------------------------------------------

_PLAIN = (
    "src_ip, dst_ip, src_port, dst_port, protocol, bytes_sent, bytes_received, packets, duration, flags, action,"
    " {status} AS status_code, direction, domain"
)
CSV_FLOWS = "ts, " + _PLAIN.format(status="CAST(NULL AS INT)")
JSON_FLOWS = "ts, " + _PLAIN.format(status="status_code")
SYSLOG_FLOWS = (
    "date_trunc('second', ts) AS ts, src_ip, dst_ip, src_port, dst_port, protocol, bytes_sent,"
    " CAST(0 AS BIGINT) AS bytes_received, packets, CAST(0.0 AS DOUBLE) AS duration, '' AS flags, action,"
    " CAST(NULL AS INT) AS status_code, 'unknown' AS direction, '' AS domain"
)
MIXED = f"""{FLOWS}
SELECT {CSV_FLOWS} FROM f WHERE protocol IN ('UDP', 'HTTP')
UNION ALL SELECT {JSON_FLOWS} FROM f WHERE protocol NOT IN ('UDP', 'HTTP', 'ICMP')
UNION ALL SELECT {SYSLOG_FLOWS} FROM f WHERE protocol = 'ICMP'"""

# ---- sliding windows --------------------------------------------------------------------


def _scan(hours: int, ports: int, where: str = "TRUE") -> str:
    """Bodies after WITH: r rows, hit per source, result."""
    return f"""
, r AS (SELECT * FROM f WHERE {where})
, w AS (SELECT *, count(DISTINCT dst_port) OVER (PARTITION BY src_ip ORDER BY ts
        RANGE BETWEEN INTERVAL {hours} HOURS PRECEDING AND CURRENT ROW) AS d FROM r)
, hit AS (SELECT src_ip, min(ts) AS hit_ts FROM w WHERE d >= {ports} GROUP BY src_ip)
, scan AS (SELECT min(r.ts) AS ts, r.src_ip,
       CASE WHEN count(DISTINCT r.dst_ip) = 1 THEN min(r.dst_ip)
            ELSE concat(CAST(count(DISTINCT r.dst_ip) AS VARCHAR), ' targets') END AS dst_ip,
       count(DISTINCT r.dst_port) AS unique_ports, count(DISTINCT r.dst_ip) AS target_count,
       CASE WHEN count(DISTINCT r.dst_ip) > 3 THEN 'horizontal' ELSE 'vertical' END AS scan_type,
       count(*) AS event_count, max(r.ts) AS last_ts,
       array_to_string(list_sort(list(DISTINCT r.dst_port))[1:20], ',') AS sample_ports
  FROM r JOIN hit ON r.src_ip = hit.src_ip AND r.ts BETWEEN hit.hit_ts - INTERVAL {hours} HOURS AND hit.hit_ts
  GROUP BY r.src_ip)"""


def _repeated(name: str, keys: str, where: str, count: int, hours: int) -> str:
    """First row per key with ``count`` rows in the window, by looking back count - 1 rows."""
    return f"""
, {name}_l AS (SELECT {keys}, ts AS last_ts, lag(ts, {count - 1}) OVER (PARTITION BY {keys} ORDER BY ts) AS start_ts
        FROM f WHERE {where})
, {name} AS (SELECT {keys}, min(start_ts) AS ts, min(last_ts) AS last_ts FROM {name}_l
        WHERE last_ts - start_ts <= INTERVAL {hours} HOURS GROUP BY {keys})"""


SPAN = "(epoch_us(last_ts) - epoch_us(ts)) / 1000000.0 AS span_seconds"
LOGIN = f"action IN ('failed', 'denied', 'reject', 'drop') AND (dst_port IN {_in(AUTH_PORTS)} OR action = 'failed')"
SERVICE = _case("dst_port", LOGIN_SERVICES, "concat('Port ', CAST(dst_port AS VARCHAR))")
PORT_SCAN = _scan(48, 8)
BRUTE_FORCE = _repeated("bf", "src_ip, dst_ip, dst_port", LOGIN, 3, 120)

DDOS = """
, dw AS (SELECT *, count(*) OVER o AS n, count(DISTINCT src_ip) OVER o AS d, min(ts) OVER o AS start_ts FROM f
         WINDOW o AS (PARTITION BY dst_ip ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW))
, df AS (SELECT *, n / greatest((epoch_us(ts) - epoch_us(start_ts)) / 1000000.0, 1.0) AS rate,
                greatest((epoch_us(ts) - epoch_us(start_ts)) / 1000000.0, 1.0) AS seconds FROM dw)
, dh AS (SELECT * FROM df WHERE rate >= 0.0005 AND d >= 5 QUALIFY row_number() OVER (PARTITION BY dst_ip ORDER BY ts) = 1)
, dr AS (SELECT h.dst_ip, r.src_ip, r.bytes_sent + r.bytes_received AS b FROM f r JOIN dh h
         ON r.dst_ip = h.dst_ip AND r.ts BETWEEN h.start_ts AND h.ts)
, dt AS (SELECT dst_ip, src_ip, count(*) AS c FROM dr GROUP BY dst_ip, src_ip
         QUALIFY row_number() OVER (PARTITION BY dst_ip ORDER BY count(*) DESC, src_ip) <= 10)
, ds AS (SELECT dst_ip, string_agg(concat(src_ip, ':', CAST(c AS VARCHAR)), ',' ORDER BY c DESC, src_ip) AS top_sources
         FROM dt GROUP BY dst_ip)
, db AS (SELECT dst_ip, CAST(sum(b) AS BIGINT) AS total_bytes FROM dr GROUP BY dst_ip)"""

EXFIL = """
, ew AS (SELECT src_ip, ts, CAST(sum(bytes_sent) OVER o AS BIGINT) AS total_bytes, count(*) OVER o AS transfer_count,
                min(ts) OVER o AS start_ts
         FROM f WHERE direction IN ('outbound', 'unknown') AND bytes_sent > 0
         WINDOW o AS (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW))
, ex AS (SELECT start_ts AS ts, src_ip, total_bytes, transfer_count, ts AS last_ts FROM ew WHERE total_bytes >= 500000
         QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY ts) = 1)"""

BEACON = """
, bg AS (SELECT src_ip, dst_ip, ts,
                (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts))) / 1000000.0 AS gap FROM f)
, bs AS (SELECT min(ts) AS ts, src_ip, dst_ip, count(*) AS connection_count, avg(gap) AS mean_interval,
                stddev_pop(gap) AS std_interval, max(ts) AS last_ts FROM bg GROUP BY src_ip, dst_ip)
, bc AS (SELECT *, std_interval / mean_interval * 100 AS cv_percent FROM bs
         WHERE connection_count >= 5 AND mean_interval > 1)
, be AS (SELECT * FROM bc WHERE cv_percent <= 40)"""

NIGHT = f"""
, ah AS (SELECT src_ip, min(ts) AS ts, count(*) AS event_count, count(DISTINCT dst_ip) AS unique_destinations,
                CAST(sum({BYTES}) AS BIGINT) AS total_bytes
         FROM f WHERE hour(ts) >= 0 AND hour(ts) < 5 GROUP BY src_ip HAVING count(*) >= 18)"""

ANOMALY = f"""
, ac AS (SELECT src_ip, count(*) AS event_count, CAST(sum({BYTES}) AS BIGINT) AS total_bytes FROM f GROUP BY src_ip)
, ao AS (SELECT avg(event_count) AS mean, stddev_pop(event_count) AS std, count(*) AS n FROM ac)
, an AS (SELECT (SELECT min(ts) FROM f) AS ts, src_ip, event_count, total_bytes,
                (event_count - mean) / std AS z, mean, std
         FROM ac, ao WHERE n >= 3 AND std > 0 AND (SELECT count(*) FROM f) >= 10 AND (event_count - mean) / std > 2.0)"""


def _first_seen(name: str, listed: list[str]) -> str:
    return f"""
, {name}_e AS (SELECT ts, event_id, src_ip, dst_ip, dst_port, src_ip AS ip, 0 AS role_no FROM f
         UNION ALL SELECT ts, event_id, src_ip, dst_ip, dst_port, dst_ip, 1 FROM f)
, {name} AS (SELECT ts, ip, CASE role_no WHEN 0 THEN 'source' ELSE 'destination' END AS direction, src_ip, dst_ip,
                dst_port, event_id, role_no FROM {name}_e WHERE lower(ip) IN {_in(listed)}
         QUALIFY row_number() OVER (PARTITION BY ip ORDER BY ts, event_id, role_no) = 1)"""


DOMAIN = f"""
, do_ AS (SELECT ts, domain, src_ip, dst_ip, dst_port, event_id FROM f
          WHERE domain <> '' AND lower(domain) IN {_in(DOMAINS)})"""
IP, TOR_SQL = _first_seen("ip", MALICIOUS), _first_seen("tor", TOR)

# ---- alerts -----------------------------------------------------------------------------

_DOMAIN_ALERTS = """SELECT ts, 'RULE-008' AS rule_id, 'Known Malicious Domain Contact' AS rule_name,
  'threat_intel' AS category, 'CRITICAL' AS severity, src_ip, dst_ip, dst_port, 1 AS detector_no, event_id, 2 AS role_no
  FROM do_"""

RAW_ALERTS = f"""
, raw AS (
  SELECT ts, 'RULE-008' AS rule_id, 'Known Malicious IP Contact' AS rule_name, 'threat_intel' AS category,
         'CRITICAL' AS severity, src_ip, dst_ip, dst_port, 1 AS detector_no, event_id, role_no FROM ip
  UNION ALL SELECT ts, 'RULE-014', 'TOR Exit Node Communication', 'anonymization', 'HIGH', src_ip, dst_ip, dst_port,
         1, event_id, role_no FROM tor
  UNION ALL {_DOMAIN_ALERTS}
  UNION ALL SELECT ts, 'RULE-001', concat('Port Scan Detected (', scan_type, ')'), 'reconnaissance', 'HIGH',
         src_ip, dst_ip, 0, 2, 0, 0 FROM scan
  UNION ALL SELECT ts, 'RULE-003', concat({SERVICE}, ' Brute Force Attack'), 'brute_force', 'HIGH', src_ip, dst_ip,
         dst_port, 3, 0, 0 FROM bf
  UNION ALL SELECT start_ts, 'RULE-006', 'DDoS Attack Detected', 'ddos', 'CRITICAL',
         concat(CAST(d AS VARCHAR), ' sources'), dst_ip, 0, 4, 0, 0 FROM dh
  UNION ALL SELECT ts, 'RULE-010', 'Potential Data Exfiltration', 'exfiltration', 'HIGH', src_ip, '', 0, 5, 0, 0 FROM ex
  UNION ALL SELECT ts, 'RULE-011', 'C2 Beaconing Pattern Detected', 'c2', 'CRITICAL', src_ip, dst_ip, 0, 6, 0, 0 FROM be
  UNION ALL SELECT ts, 'RULE-013', 'After-Hours Network Activity', 'insider_threat', 'MEDIUM', src_ip, '', 0, 7, 0, 0
         FROM ah
  UNION ALL SELECT ts, 'ANOMALY-001', 'Statistical Traffic Anomaly', 'anomaly',
         CASE WHEN z < 4 THEN 'MEDIUM' ELSE 'HIGH' END, src_ip, '', 0, 8, 0, 0 FROM an)"""


def _dedup(days: int) -> str:
    """Last-kept deduplication: walk each key from its first alert."""
    return f"""
, head AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY rule_id, src_ip, dst_ip, ts
           ORDER BY {TIE_ORDER}) = 1)
, nxt AS (SELECT a.rule_id, a.src_ip, a.dst_ip, a.ts, min(b.ts) AS next_ts FROM head a JOIN head b
          ON a.rule_id = b.rule_id AND a.src_ip = b.src_ip AND a.dst_ip = b.dst_ip AND b.ts > a.ts + INTERVAL {days} DAYS
          GROUP BY ALL)
, kept AS (SELECT rule_id, src_ip, dst_ip, min(ts) AS ts FROM head GROUP BY rule_id, src_ip, dst_ip
           UNION ALL SELECT k.rule_id, k.src_ip, k.dst_ip, n.next_ts FROM kept k JOIN nxt n
           ON k.rule_id = n.rule_id AND k.src_ip = n.src_ip AND k.dst_ip = n.dst_ip AND k.ts = n.ts)
, a AS (SELECT h.* FROM head h SEMI JOIN kept k
        ON h.rule_id = k.rule_id AND h.src_ip = k.src_ip AND h.dst_ip = k.dst_ip AND h.ts = k.ts)"""


ALERTS = FLOWS + IP + TOR_SQL + DOMAIN + PORT_SCAN + BRUTE_FORCE + DDOS + EXFIL + BEACON + NIGHT + ANOMALY
ALERTS += RAW_ALERTS + _dedup(10)
ALERT_KEYS = "ts, rule_id, rule_name, category, severity, src_ip, dst_ip, CAST(dst_port AS INT) AS dst_port"
SCORE = """CAST(least(coalesce(sum(CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 15 WHEN 'MEDIUM' THEN 8
  WHEN 'LOW' THEN 3 ELSE 1 END), 0), 100) AS DOUBLE)"""
LEVEL = """CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 40
  THEN 'MEDIUM' ELSE 'LOW' END"""
_ADVICE = ", ".join(f"({i}, '{c}', '{t}')" for i, (c, t) in enumerate(CATEGORY_ADVICE, 1))

WRONG_PORT = " OR ".join(f"(protocol = '{p}' AND dst_port NOT IN {_in(ports)})" for p, ports in EXPECTED_PORTS.items())
SCAN_COLUMNS = "ts, src_ip, dst_ip, unique_ports, target_count, scan_type, event_count, last_ts, sample_ports"

ORACLES: dict[str, str] = {
    "ingest_csv": f"{FLOWS} SELECT {CSV_FLOWS} FROM f",
    "ingest_json": f"{FLOWS} SELECT {JSON_FLOWS} FROM f",
    "ingest_json_array": f"{FLOWS} SELECT {JSON_FLOWS} FROM f",
    "ingest_syslog": f"{FLOWS} SELECT {SYSLOG_FLOWS} FROM f",
    "ingest_union": MIXED,
    "ingest_auto": MIXED,
    "ingest_numbered": f"""{FLOWS} SELECT row_number() OVER (ORDER BY event_id) - 1 AS event_id, ts, src_ip, dst_ip,
        src_port, bytes_sent FROM f""",
    "ingest_csv_multiline": f"""{FLOWS} SELECT {CSV_FLOWS.removesuffix(', domain')},
        CASE WHEN domain <> '' THEN concat('a "b"', chr(10), domain) ELSE '' END AS domain FROM f""",
    "watch_csv": f"{FLOWS} SELECT {CSV_FLOWS} FROM f",
    "ingest_stats": f"""{FLOWS}, c AS (
        SELECT count(*) FILTER (bytes_sent % 11 <> 0 AND bytes_sent % 7 <> 0) AS total_parsed,
               count(*) FILTER (bytes_sent % 11 <> 0 AND bytes_sent % 7 = 0) AS parse_errors FROM f)
        SELECT *, printf('%.1f%%', total_parsed / (total_parsed + parse_errors) * 100) AS success_rate FROM c""",
    "parse_ts": f"""{FLOWS} SELECT event_id, CAST(layout AS INT) AS layout,
        CASE WHEN layout IN (3, 4, 8) THEN ts ELSE date_trunc('second', ts) END AS ts
        FROM f, range(9) AS l(layout)""",
    "parse_ts_iso": f"""{FLOWS} SELECT event_id, CAST(layout AS INT) AS layout, CASE layout
        WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOURS
        WHEN 3 THEN date_trunc('millisecond', ts) + INTERVAL 90 MINUTES
        WHEN 4 THEN date_trunc('second', ts) ELSE ts END AS ts FROM f, range(6) AS l(layout)""",
    "feeds": f"""{FLOWS} SELECT DISTINCT 'malicious_domain' AS kind, lower(domain) AS indicator FROM f
        WHERE domain <> ''""",
    "watch_totals": f"""{FLOWS} SELECT date_trunc('hour', ts) AS window_start, protocol, count(*) AS events,
        CAST(sum({BYTES}) AS BIGINT) AS bytes FROM f GROUP BY ALL""",
    "watch_domains": f"{FLOWS}{DOMAIN} SELECT ts, domain, src_ip, dst_ip, dst_port FROM do_",
    "traffic_stats": f"""{FLOWS}, t AS (SELECT count(*) AS total_events, CAST(sum({BYTES}) AS BIGINT) AS total_bytes,
        count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips,
        count(DISTINCT dst_port) FILTER (dst_port > 0) AS unique_dst_ports, min(ts) AS first_ts, max(ts) AS last_ts,
        CAST(coalesce(sum(bytes_received) FILTER (direction = 'inbound'), 0) AS BIGINT) AS inbound_bytes,
        CAST(coalesce(sum(bytes_sent) FILTER (direction = 'outbound'), 0) AS BIGINT) AS outbound_bytes,
        count(*) FILTER (action IN ('deny', 'drop', 'blocked', 'reject')) AS denied_connections,
        count(*) FILTER (action IN ('failed', 'error')) AS failed_actions FROM f),
        u AS (SELECT *, greatest((epoch_us(last_ts) - epoch_us(first_ts)) / 1000000.0, 1.0) AS duration_seconds FROM t)
        SELECT *, round(total_events / duration_seconds, 9) AS events_per_second,
        round(total_bytes / duration_seconds, 6) AS bytes_per_second FROM u""",
    "protocol_dist": f"""{FLOWS} SELECT CASE WHEN protocol = '' THEN 'UNKNOWN' ELSE protocol END AS protocol,
        count(*) AS events FROM f GROUP BY 1""",
    "top_talkers": f"""{FLOWS}, c AS (SELECT src_ip AS ip, count(*) AS events, CAST(sum({BYTES}) AS BIGINT) AS bytes
        FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) SELECT *, {_human('bytes')} AS bytes_human FROM c""",
    "top_destinations": f"""{FLOWS}, c AS (SELECT dst_ip AS ip, count(*) AS events,
        CAST(sum({BYTES}) AS BIGINT) AS bytes, count(DISTINCT src_ip) AS unique_sources
        FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) SELECT *, {_human('bytes')} AS bytes_human FROM c""",
    "top_ports": f"""{FLOWS} SELECT dst_port AS port, {_case('dst_port', PORT_SERVICES, "'Unknown'")} AS service,
        count(*) AS events FROM f WHERE dst_port > 0 GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 20""",
    "hourly_dist": f"{FLOWS} SELECT strftime(ts, '%H:00') AS hour, count(*) AS events FROM f GROUP BY 1",
    "protocol_bytes": f"{FLOWS} SELECT protocol, CAST(sum({BYTES}) AS BIGINT) AS bytes FROM f GROUP BY 1",
    "connection_pairs": f"""{FLOWS} SELECT src_ip, dst_ip, count(*) AS connections FROM f GROUP BY 1, 2
        ORDER BY 3 DESC, 1, 2 LIMIT 10""",
    "geo_summary": f"""{FLOWS}, i AS (SELECT src_ip AS ip FROM f UNION SELECT dst_ip FROM f),
        c AS (SELECT count(*) FILTER (p) AS internal_ips, count(*) FILTER (NOT p) AS external_ips FROM
        (SELECT regexp_matches(ip, '^(10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|192\\.168\\.|127\\.)') AS p FROM i))
        SELECT *, CASE WHEN external_ips = 0 THEN 'All internal'
        ELSE concat(CAST(internal_ips AS VARCHAR), ':', CAST(external_ips AS VARCHAR)) END
        AS internal_to_external_ratio FROM c""",
    "human_bytes": f"""{FLOWS}, s AS (SELECT event_id, CAST(bytes_sent * pow(37.0, event_id % 6) AS BIGINT) AS b FROM f)
        SELECT event_id, {_human('b')} AS size_text FROM s""",
    "ti_ip": f"{FLOWS}{IP} SELECT * FROM ip",
    "ti_tor": f"{FLOWS}{TOR_SQL} SELECT * FROM tor",
    "ti_domain": f"{FLOWS}{DOMAIN} SELECT * FROM do_",
    "port_scan": f"{FLOWS}{PORT_SCAN} SELECT {SCAN_COLUMNS} FROM scan",
    "udp_scan": f"""{FLOWS}{_scan(120, 3, "protocol = 'UDP'")} SELECT {SCAN_COLUMNS} FROM scan""",
    "syn_scan": f"""{FLOWS}{_scan(48, 5, "protocol = 'TCP' AND flags = 'SYN'")} SELECT {SCAN_COLUMNS} FROM scan""",
    "brute_force": f"""{FLOWS}{BRUTE_FORCE} SELECT ts, src_ip, dst_ip, dst_port, CAST(3 AS BIGINT) AS attempts, last_ts,
        {SPAN}, {SERVICE} AS service FROM bf""",
    "ddos": f"""{FLOWS}{DDOS} SELECT start_ts AS ts, dst_ip, n AS total_events, d AS unique_sources,
        round(rate, 9) AS requests_per_second, seconds AS duration_seconds, total_bytes, top_sources, ts AS last_ts
        FROM dh JOIN ds USING (dst_ip) JOIN db USING (dst_ip)""",
    "exfiltration": f"{FLOWS}{EXFIL} SELECT * FROM ex",
    "beaconing": f"""{FLOWS}{BEACON} SELECT ts, src_ip, dst_ip, connection_count, round(mean_interval, 4) AS mean_interval,
        round(std_interval, 4) AS std_interval, round(cv_percent, 4) AS cv_percent, last_ts FROM be""",
    "after_hours": f"{FLOWS}{NIGHT} SELECT * FROM ah",
    "anomaly": f"""{FLOWS}{ANOMALY} SELECT ts, src_ip, event_count, round(z, 6) AS z_score,
        CASE WHEN z < 4 THEN 'MEDIUM' ELSE 'HIGH' END AS severity, round(mean, 6) AS mean_events,
        round(std, 6) AS std_events, total_bytes FROM an""",
    "http_bruteforce": FLOWS + _repeated(
        "h", "src_ip, dst_ip, dst_port",
        "protocol = 'TCP' AND dst_port IN (80, 443, 8080, 8443) AND status_code IN (401, 403)", 3, 168,
    ) + f" SELECT ts, src_ip, dst_ip, dst_port, CAST(3 AS BIGINT) AS attempts, last_ts, {SPAN} FROM h",
    "syn_flood": f"""{FLOWS}, w AS (SELECT dst_ip, ts, count(*) FILTER (flags = 'SYN') OVER o AS syn_count,
        count(*) FILTER (flags = 'SYN,ACK') OVER o AS synack_count, min(ts) OVER o AS start_ts
        FROM f WHERE protocol = 'TCP' AND flags IN ('SYN', 'SYN,ACK')
        WINDOW o AS (PARTITION BY dst_ip ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW))
        SELECT start_ts AS ts, dst_ip, syn_count, synack_count, ts AS last_ts FROM w
        WHERE syn_count >= 10 AND syn_count / greatest(synack_count, 1) >= 5
        QUALIFY row_number() OVER (PARTITION BY dst_ip ORDER BY ts) = 1""",
    "dns_tunnel": FLOWS + _repeated(
        "h", "src_ip", "protocol = 'UDP' AND dst_port = 53 AND length(domain) >= 50", 2, 120,
    ) + f" SELECT ts, src_ip, CAST(2 AS BIGINT) AS attempts, last_ts, {SPAN} FROM h",
    "proto_mismatch": f"""{FLOWS} SELECT src_ip, dst_ip, dst_port, protocol, min(ts) AS ts, count(*) AS events FROM f
        WHERE {WRONG_PORT} GROUP BY ALL""",
    "icmp_flood": f"""{FLOWS}, w AS (SELECT dst_ip, ts, CAST(sum(packets) OVER o AS BIGINT) AS packets,
        count(*) OVER o AS events, min(ts) OVER o AS start_ts FROM f WHERE protocol = 'ICMP'
        WINDOW o AS (PARTITION BY dst_ip ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW))
        SELECT start_ts AS ts, dst_ip, packets, events, ts AS last_ts FROM w WHERE packets >= 50
        QUALIFY row_number() OVER (PARTITION BY dst_ip ORDER BY ts) = 1""",
    "custom_rules": FLOWS + _repeated(
        "h", "src_ip, dst_ip, dst_port", "dst_port IN (443, 8080) AND action = 'failed'", 3, 168,
    ) + _repeated(
        "g", "src_ip, dst_ip, dst_port", "protocol = 'HTTP' AND action IN ('deny', 'drop')", 2, 168,
    ) + _repeated(
        "p", "src_ip, dst_ip, dst_port", "flags = 'SYN' AND direction = 'internal'", 2, 48,
    ) + """ SELECT 'RULE-CUSTOM-001' AS rule_id, 'Large upload' AS rule_name, 'exfiltration' AS category,
        'HIGH' AS severity, ts, src_ip, dst_ip, dst_port, CAST(1 AS BIGINT) AS events, bytes_sent FROM f
        WHERE protocol = 'TCP' AND dst_port = 8443 AND bytes_sent >= 200000
        UNION ALL SELECT 'RULE-CUSTOM-002', 'Repeated web failures', 'brute_force', 'LOW', ts, src_ip, dst_ip, dst_port,
        3, NULL FROM h
        UNION ALL SELECT 'RULE-CUSTOM-004', 'Repeated sign-ups refused', 'unknown', 'MEDIUM', ts, src_ip, dst_ip, dst_port,
        2, NULL FROM g
        UNION ALL SELECT 'RULE-CUSTOM-005', 'Probes', 'reconnaissance', 'LOW', ts, src_ip, dst_ip, dst_port, 2, NULL FROM p
        UNION ALL SELECT 'RULE-CUSTOM-006', 'Odd port', 'evasion', 'LOW', ts, src_ip, dst_ip, dst_port, 1, bytes_sent FROM f
        WHERE dst_port IN (8081, 0)
        UNION ALL SELECT 'RULE-CUSTOM-007', 'Answer 500', 'unknown', 'LOW', ts, src_ip, dst_ip, dst_port, 1, bytes_sent FROM f
        WHERE status_code = 500 AND src_port BETWEEN 40000 AND 40049""",
    "alert_dedup": f"{FLOWS}{DOMAIN}, raw AS ({_DOMAIN_ALERTS}){_dedup(10)} SELECT {ALERT_KEYS} FROM a",
    "all_alerts": f"""{ALERTS}, x AS (SELECT {ALERT_KEYS}, {RULE_TEXTS} AS texts FROM a)
        SELECT {ALERT_KEYS}, substr(texts, strpos(texts, '|') + 1) AS recommendation, 'unknown' AS false_positive_likelihood,
        substr(texts, 1, strpos(texts, '|') - 1) AS mitre_attack_id FROM x""",
    "raw_alerts": f"{ALERTS} SELECT {ALERT_KEYS} FROM raw",
    "domain_alerts": f"""{FLOWS}{DOMAIN} SELECT 'ALERT-' || upper(substr(sha256(concat_ws('|', 'RULE-008', src_ip, dst_ip, dst_port,
        CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0') END,
        event_id, '2')), 1, 16)) AS alert_id, ts, src_ip, dst_ip, dst_port,
        'DNS query or connection to known malicious domain: ' || domain AS description,
        '{{"malicious_domain":"' || domain || '","src_ip":"' || src_ip || '"}}' AS evidence,
        'Block the domain immediately. Investigate the source host for malware.' AS recommendation,
        'unknown' AS false_positive_likelihood, 'T1071.001' AS mitre_attack_id FROM do_""",
    "report": f"""{ALERTS}, t AS (SELECT src_ip AS name, count(*) AS n, CAST(sum({BYTES}) AS BIGINT) AS amount FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
        SELECT 'alerts' AS part, severity AS name, count(*) AS amount FROM a GROUP BY 2
        UNION ALL SELECT 'talkers', name, amount FROM t
        UNION ALL SELECT 'protocols', CASE WHEN protocol = '' THEN 'UNKNOWN' ELSE protocol END, count(*) FROM f GROUP BY 2
        UNION ALL SELECT 'severities', s.severity, count(a.rule_id)
        FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) s(severity) LEFT JOIN a USING (severity) GROUP BY 2""",
    "alerts_min_severity": f"{ALERTS} SELECT {ALERT_KEYS} FROM a WHERE severity IN ('HIGH', 'CRITICAL')",
    "alerts_by_severity": f"""{ALERTS} SELECT s.severity, count(a.rule_id) AS alerts
        FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) s(severity) LEFT JOIN a USING (severity) GROUP BY 1""",
    "alerts_by_category": f"{ALERTS} SELECT category, count(*) AS alerts FROM a GROUP BY 1",
    "alerts_top_sources": f"""{ALERTS} SELECT src_ip AS ip, count(*) AS alert_count FROM a GROUP BY 1
        ORDER BY 2 DESC, 1 LIMIT 10""",
    "alerts_timeline": f"{ALERTS} SELECT strftime(ts, '%Y-%m-%d %H:00') AS hour, count(*) AS alerts FROM a GROUP BY 1",
    "sink_alerts": f"""{ALERTS} SELECT CAST(ts AS DATE) AS date, rule_id, severity, count(*) AS alerts, min(ts) AS first_ts
        FROM a GROUP BY ALL""",
    "flow_records": f"""{FLOWS} SELECT CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
        ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp, {_PLAIN.format(status="status_code")},
        {BYTES} AS total_bytes FROM f""",
    "risk_score": f"""{ALERTS}, s AS (SELECT {SCORE} AS risk_score FROM a)
        SELECT risk_score, {LEVEL} AS risk_level FROM s""",
    "recommendations": f"""{ALERTS}, rec AS (SELECT * FROM (VALUES {_ADVICE}) v(place, category, recommendation)
        WHERE category IN (SELECT category FROM a))
        SELECT CAST(place AS INT) AS place, category, recommendation FROM rec
        UNION ALL SELECT 1, NULL, '{NO_ADVICE}' WHERE NOT EXISTS (SELECT 1 FROM rec)""",
    "exec_summary": f"""{ALERTS}, s AS (SELECT count(*) AS alerts, count(*) FILTER (severity = 'CRITICAL') AS critical,
        count(*) FILTER (severity = 'HIGH') AS high, count(DISTINCT category) AS categories,
        coalesce(array_to_string(list_sort(list(DISTINCT category) FILTER (severity = 'CRITICAL')), ', '), '')
        AS critical_names, {SCORE} AS risk_score FROM a),
        e AS (SELECT count(*) AS total_events, min(ts) AS first_ts, max(ts) AS last_ts FROM f),
        es AS (SELECT *, {LEVEL} AS risk_level, (epoch_us(last_ts) - epoch_us(first_ts)) / 3600000000.0 AS h FROM e, s)
        SELECT es.* EXCLUDE (h), round(h, 6) AS hours, concat(CASE WHEN critical > 0 THEN concat('URGENT ACTION REQUIRED: ', critical,
        ' critical security alert(s) detected. Evidence of active threats including ', critical_names, '. ')
        WHEN high > 0 THEN concat('Elevated threat level: ', high, ' high-severity alert(s) require investigation. ')
        ELSE 'Network security posture appears stable. ' END, 'Analysis processed ', format('{{:,}}', total_events),
        ' network events from 1 log file(s) over a period of ', printf('%.1f', h), ' hours. Total of ', alerts,
        ' security alerts generated across ', categories, ' attack categories. Overall risk score: ', printf('%.0f', risk_score),
        '/100 (', risk_level, ').') AS summary FROM es""",
}
# The stream's alerts are the batch's.
ORACLES["watch_brute_force"] = ORACLES["brute_force"]
ORACLES["sink_alert_fields"] = f"SELECT *, true AS whole FROM ({ORACLES['all_alerts']})"


def _iso_sql(column: str) -> str:
    return f"CASE WHEN epoch_us({column}) % 1000000 = 0 THEN strftime({column}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({column}, '%Y-%m-%dT%H:%M:%S.%f') END"


ORACLES["alert_texts"] = f"""{FLOWS}{IP}, tor AS (SELECT * FROM ({FLOWS}{TOR_SQL} SELECT * FROM tor)),
    scan AS (SELECT * FROM ({FLOWS}{PORT_SCAN} SELECT * FROM scan)), bf AS (SELECT * FROM ({FLOWS}{BRUTE_FORCE} SELECT *, {SERVICE} AS service FROM bf))
    SELECT 'RULE-008' AS rule_id, ts, src_ip, dst_ip, dst_port, concat('Communication detected with known malicious IP ', ip, ' as ', direction,
        '. This IP is listed in threat intelligence feeds.') AS description,
        concat('{{"malicious_ip":"', ip, '","direction":"', direction, '","event_time":"', {_iso_sql("ts")}, '"}}') AS evidence FROM ip
    UNION ALL SELECT 'RULE-014', ts, src_ip, dst_ip, dst_port, concat('Traffic detected to/from known TOR exit node: ', ip,
        '. This may indicate anonymized communication.'), concat('{{"tor_node_ip":"', ip, '","direction":"', direction, '"}}') FROM tor
    UNION ALL SELECT 'RULE-001', ts, src_ip, dst_ip, 0, concat('Port scan detected from ', src_ip, ': ', unique_ports, ' unique ports probed across ',
        target_count, ' destination(s) within 172800s window.'), concat('{{"unique_ports":', unique_ports, ',"sample_ports":[', sample_ports,
        '],"target_count":', target_count, ',"scan_type":"', scan_type, '","event_count":', event_count, '}}') FROM scan
    UNION ALL SELECT 'RULE-003', ts, src_ip, dst_ip, dst_port, concat('Brute force attack detected: 3 failed ', service, ' login attempts from ', src_ip,
        ' to ', dst_ip, ':', dst_port, ' within 7200 minutes.'), concat_ws('|', 3, service, {_iso_sql("ts")}, {_iso_sql("last_ts")}) FROM bf"""
# Other ways to the same rows.
ORACLES |= {
    "ingest_incremental": ORACLES["ingest_numbered"], "alert_dedup_runs": ORACLES["alert_dedup"],
    **{f"{name}_bounded": ORACLES[name] for name in ("top_talkers", "top_destinations", "top_ports", "connection_pairs")},
}
