"""Detector results as one alert table: unify, deduplicate, rank, filter and count."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.durable import broadcast_if_small, by_key, durable
from tidewatch.functions import network as net
from tidewatch.functions.clock import iso_text, micros, window_micros
from tidewatch.operators.declared import DeclaredRule
from tidewatch.operators.scan import chunked_if_large, running
from tidewatch.schema import ALERT_COLUMNS, SEVERITIES, severity_rank

# The advice that goes with each kind of alert.
ADVICE = {
    "malicious_ip": "Immediately investigate the host communicating with this IP. "
    "Block the IP at the firewall and check for compromise indicators.",
    "tor_node": "Investigate why TOR is being used. May indicate data exfiltration "
    "or access to dark web services.",
    "malicious_domain": "Block the domain immediately. Investigate the source host for malware.",
    "port_scan": "Block the scanning IP at the firewall. Review if any scanned "
    "ports have known vulnerabilities. Monitor for follow-up exploitation.",
    "brute_force": "Block %s immediately. Enable account lockout policies. "
    "Consider implementing MFA for %s access. Check if any credentials were compromised.",
    "ddos": "Activate DDoS mitigation. Enable rate limiting and geo-blocking. "
    "Contact upstream ISP for traffic scrubbing if needed. Consider CDN/WAF deployment.",
    "exfiltration": "Investigate the source host for malware. Check what data was "
    "transferred and to which destinations. Review DLP policies.",
    "beaconing": "PRIORITY: Investigate the destination IP immediately for C2 infrastructure. "
    "Isolate the source host. Capture network traffic for forensic analysis. "
    "Check for malware on the infected host.",
    "after_hours": "Verify if this activity is expected (e.g., scheduled jobs, maintenance). "
    "If not, investigate for potential insider threat or compromised account.",
    "anomaly": "Investigate the source for automated scanning, malware activity, "
    "or misconfigured applications generating excessive traffic.",
}

DEDUP_TIE_ORDER = ["detector_no", "event_id", "role_no", "dst_port"]


def as_alerts(
    found: DataFrame, detector_no: int, rule_id: str, rule_name: Column, category: str,
    severity: Column, mitre: str, description: Column, evidence: list[Column], advice: Column,
    src_ip: Column | None = None,
) -> DataFrame:
    """Alert rows with a reproducible id; columns a detector lacks get the usual defaults."""
    def own(name: str, default: Column) -> Column:
        return F.col(name) if name in found.columns else default

    rows = found.select(
        "ts", F.lit(rule_id).alias("rule_id"), rule_name.alias("rule_name"), F.lit(category).alias("category"),
        severity.alias("severity"), (F.col("src_ip") if src_ip is None else src_ip).alias("src_ip"),
        own("dst_ip", F.lit("")).alias("dst_ip"), own("dst_port", F.lit(0)).cast("int").alias("dst_port"),
        description.alias("description"), F.to_json(F.struct(*evidence)).alias("evidence"),
        advice.alias("recommendation"), F.lit("unknown").alias("false_positive_likelihood"),
        F.lit(mitre).alias("mitre_attack_id"), F.lit(detector_no).alias("detector_no"),
        own("event_id", F.lit(None)).cast("bigint").alias("event_id"),
        own("role_no", F.lit(0)).cast("int").alias("role_no"),
    )
    identity = F.concat_ws("|", "rule_id", "src_ip", "dst_ip", "dst_port", "ts", "event_id", "role_no")
    digest = F.upper(F.substring(F.sha2(identity, 256), 1, 16))
    return rows.withColumn("alert_id", F.concat(F.lit("ALERT-"), digest)).withColumn(
        "severity_rank", severity_rank(F.col("severity"))
    ).select(ALERT_COLUMNS)


def _iso(column: str) -> Column:
    return iso_text(F.col(column))


def malicious_ip_alerts(found: DataFrame) -> DataFrame:
    return as_alerts(
        found, 1, "RULE-008", F.lit("Known Malicious IP Contact"), "threat_intel", F.lit("CRITICAL"), "T1071",
        F.format_string("Communication detected with known malicious IP %s as %s. "
                        "This IP is listed in threat intelligence feeds.", "ip", "direction"),
        [F.col("ip").alias("malicious_ip"), F.col("direction"), _iso("ts").alias("event_time")],
        F.lit(ADVICE["malicious_ip"]),
    )


def tor_alerts(found: DataFrame) -> DataFrame:
    return as_alerts(
        found, 1, "RULE-014", F.lit("TOR Exit Node Communication"), "anonymization", F.lit("HIGH"), "T1090.003",
        F.format_string("Traffic detected to/from known TOR exit node: %s. "
                        "This may indicate anonymized communication.", "ip"),
        [F.col("ip").alias("tor_node_ip"), F.col("direction")], F.lit(ADVICE["tor_node"]),
    )


def domain_alerts(found: DataFrame) -> DataFrame:
    return as_alerts(
        found.withColumn("role_no", F.lit(2)), 1, "RULE-008", F.lit("Known Malicious Domain Contact"),
        "threat_intel", F.lit("CRITICAL"), "T1071.001",
        F.format_string("DNS query or connection to known malicious domain: %s", "domain"),
        [F.col("domain").alias("malicious_domain"), F.col("src_ip")], F.lit(ADVICE["malicious_domain"]),
    )


def port_scan_alerts(found: DataFrame, window_s: float) -> DataFrame:
    return as_alerts(
        found, 2, "RULE-001", F.format_string("Port Scan Detected (%s)", "scan_type"), "reconnaissance",
        F.lit("HIGH"), "T1046",
        F.format_string("Port scan detected from %s: %d unique ports probed across %d destination(s) "
                        f"within {window_s:.0f}s window.", "src_ip", "unique_ports", "target_count"),
        [F.col(c) for c in ("unique_ports", "sample_ports", "target_count", "scan_type", "event_count")],
        F.lit(ADVICE["port_scan"]),
    )


def brute_force_alerts(found: DataFrame, window_s: float) -> DataFrame:
    return as_alerts(
        found, 3, "RULE-003", F.format_string("%s Brute Force Attack", "service"), "brute_force", F.lit("HIGH"),
        "T1110",
        F.format_string("Brute force attack detected: %d failed %s login attempts from %s to %s:%d "
                        f"within {int(window_s // 60)} minutes.", "attempts", "service", "src_ip", "dst_ip", "dst_port"),
        [F.col("attempts").alias("failed_attempts"), F.col("service"), F.col("span_seconds").alias("time_span_seconds"),
         _iso("ts").alias("first_attempt"), _iso("last_ts").alias("last_attempt")],
        F.format_string(ADVICE["brute_force"], "src_ip", "service"),
    )


def ddos_alerts(found: DataFrame) -> DataFrame:
    mb = net.megabytes(F.col("total_bytes"))
    return as_alerts(
        found, 4, "RULE-006", F.lit("DDoS Attack Detected"), "ddos", F.lit("CRITICAL"), "T1498",
        F.format_string("Potential DDoS attack against %s: %.0f requests/sec from %d unique sources. "
                        "Total volume: %.1f MB.", "dst_ip", F.bround("requests_per_second", 0), "unique_sources", F.bround(mb, 1)),
        [F.bround("requests_per_second", 1).alias("requests_per_second"), F.col("unique_sources"),
         F.col("total_events"), F.bround(mb, 2).alias("total_bytes_mb"), F.col("duration_seconds"),
         F.col("top_sources")],
        F.lit(ADVICE["ddos"]),
        src_ip=F.concat(F.col("unique_sources").cast("string"), F.lit(" sources")),
    )


def exfiltration_alerts(found: DataFrame, window_s: float) -> DataFrame:
    mb = net.megabytes(F.col("total_bytes"))
    return as_alerts(
        found, 5, "RULE-010", F.lit("Potential Data Exfiltration"), "exfiltration", F.lit("HIGH"), "T1048",
        F.format_string("Large outbound data transfer detected from %s: %.1f MB transferred within "
                        f"{int(window_s // 3600)} hour(s).", "src_ip", F.bround(mb, 1)),
        [F.col("total_bytes"), F.bround(mb, 2).alias("total_mb"), F.col("transfer_count"),
         F.lit(window_s / 3600).alias("time_window_hours")],
        F.lit(ADVICE["exfiltration"]),
    )


def beaconing_alerts(found: DataFrame) -> DataFrame:
    regularity = 100 - F.col("cv_percent")
    return as_alerts(
        found, 6, "RULE-011", F.lit("C2 Beaconing Pattern Detected"), "c2", F.lit("CRITICAL"), "T1071",
        F.format_string("Regular beaconing pattern detected: %s -> %s. %d connections at ~%.1fs intervals "
                        "(regularity: %.1f%%).", "src_ip", "dst_ip", "connection_count", "mean_interval", regularity),
        [F.col("connection_count"), F.bround("mean_interval", 2).alias("mean_interval_seconds"),
         F.bround("std_interval", 2).alias("std_deviation"), F.bround(regularity, 1).alias("regularity_percent"),
         _iso("ts").alias("first_seen"), _iso("last_ts").alias("last_seen")],
        F.lit(ADVICE["beaconing"]),
    )


def after_hours_alerts(found: DataFrame, start_hour: int, end_hour: int) -> DataFrame:
    span = f"{start_hour:02d}:00{{}}{end_hour:02d}:00"
    return as_alerts(
        found, 7, "RULE-013", F.lit("After-Hours Network Activity"), "insider_threat", F.lit("MEDIUM"), "T1078",
        F.format_string(f"Unusual after-hours activity from %s: %d events between {span.format('-')}, "
                        "contacting %d unique destinations.", "src_ip", "event_count", "unique_destinations"),
        [F.col("event_count"), F.col("unique_destinations"), F.col("total_bytes"),
         F.lit(span.format(" - ")).alias("time_range")],
        F.lit(ADVICE["after_hours"]),
    )


def anomaly_alerts(found: DataFrame) -> DataFrame:
    return as_alerts(
        found, 8, "ANOMALY-001", F.lit("Statistical Traffic Anomaly"), "anomaly", F.col("severity"), "",
        F.format_string("Anomalous traffic volume from %s: %d events (z-score: %.2f, mean: %.0f). "
                        "This is %.1f standard deviations above normal.",
                        "src_ip", "event_count", "z_score", "mean_events", "z_score"),
        [F.col("event_count"), F.bround("z_score", 2).alias("z_score"), F.bround("mean_events", 1).alias("mean_events"),
         F.bround("std_events", 1).alias("std_deviation"), F.col("total_bytes")],
        F.lit(ADVICE["anomaly"]),
    )


def declared_alerts(found: DataFrame, rule: DeclaredRule) -> DataFrame:
    """Alerts of a declared rule; its evidence is every column that is not an alert column."""
    own = {"ts", "src_ip", "dst_ip", "dst_port", "event_id"}
    return as_alerts(
        found, 9, rule.rule_id, F.lit(rule.name), rule.category, F.lit(rule.severity), rule.mitre,
        F.lit(rule.description), [F.col(c) for c in found.columns if c not in own], F.lit(""),
        None if "src_ip" in found.columns else F.lit(""),
    )


def custom_rule_alerts(found: DataFrame, detector_no: int = 10) -> DataFrame:
    """Alerts of ``threshold_rules``: the rule's own id, name, category and severity."""
    rows = as_alerts(
        found, detector_no, "", F.col("rule_name"), "", F.col("severity"), "", F.col("about"),
        [F.col("events"), F.col("bytes_sent"), F.struct("rule_id", "category").alias("rule")], F.lit(""),
    )
    identity = F.concat_ws("|", "rule_id", "src_ip", "dst_ip", "dst_port", "ts", "event_id", "role_no")
    digest = F.upper(F.substring(F.sha2(identity, 256), 1, 16))
    rule = "evidence", "$.rule."
    return rows.withColumn("rule_id", F.get_json_object(rule[0], rule[1] + "rule_id")).withColumn(
        "category", F.get_json_object(rule[0], rule[1] + "category")
    ).withColumn("alert_id", F.concat(F.lit("ALERT-"), digest)).select(ALERT_COLUMNS)


def union_alerts(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def dedupe(alerts: DataFrame, window_s: float = 300, chunks: int | None = None) -> DataFrame:
    """Keep an alert if none with its (rule, source, target) was kept in the window before it.

    What is kept depends on what was kept before, so a plain look at the previous row is
    wrong. Every alert points to the first one more than a window later; the kept ones are
    those reachable from a root, an alert with nothing in the window before it. Reachability
    doubles its reach each round (a chain of a million kept alerts takes 20), and all joins
    are on (key, time), which is unique, so a key with most of the alerts is spread evenly.
    """
    window_us = window_micros(window_s)
    keyed = alerts.withColumn("_key", F.concat_ws(":", "rule_id", "src_ip", "dst_ip")).withColumn(
        "_t", micros(F.col("ts"))
    )
    # Alerts of one key at one moment: only the first can be kept. Texts stay behind.
    heads = durable(
        keyed.groupBy("_key", "_t").agg(F.min(F.struct(*DEDUP_TIE_ORDER, "alert_id")).alias("_first"), F.count("*").alias("_n")).select(
            "_key", "_t", F.col("_first.alert_id").alias("alert_id"), "_n"),
        "alert-heads",
    )
    steps = heads.select(
        "_key",
        F.explode(F.expr(
            f"array(struct(_t AS t, 0 AS phase, 1L AS step), struct(_t + {window_us}L AS t, 1 AS phase, -1L AS step))"
        )).alias("_c"),
    ).select("_key", "_c.*").withColumn("arrives", F.when(F.col("phase") == 0, F.col("t")))
    order = ["t", "phase"]
    steps = chunked_if_large(steps, heads.count(), ["_key"], order, chunks)
    swept = running(steps, ["_key"], order, {"active": "step"}, {"next_t": "arrives"})
    roots = swept.where("phase = 0 AND active = 1").select("_key", F.col("t").alias("_t"))
    links = swept.where("phase = 1 AND next_t IS NOT NULL").select(
        "_key", (F.col("t") - window_us).alias("_t"), "next_t"
    )
    reached = roots
    links = durable(
        links.join(by_key(roots.withColumnRenamed("_t", "next_t")), ["_key", "next_t"], "left_anti"), "alert-links"
    )
    while not links.isEmpty():
        stepped = reached.join(by_key(links), ["_key", "_t"]).select("_key", F.col("next_t").alias("_t"))
        reached = durable(reached.unionByName(stepped), "alert-reached")
        further = links.select("_key", F.col("_t").alias("next_t"), F.col("next_t").alias("after_t"))
        links = durable(
            links.join(by_key(further), ["_key", "next_t"]).select("_key", "_t", F.col("after_t").alias("next_t")),
            "alert-links",
        )
    kept = durable(heads.join(by_key(reached), ["_key", "_t"], "left_semi"), "alert-kept")
    found = keyed.join(broadcast_if_small(kept), ["_key", "_t", "alert_id"])
    # Alerts that agree even in their id are one alert; only those with company are moved to see.
    doubtful = found.where("_n > 1").dropDuplicates(["_key", "_t", "alert_id"])
    return found.where("_n = 1").unionByName(doubtful).select(alerts.columns)


def at_least(alerts: DataFrame, severity: str) -> DataFrame:
    return alerts.where(F.col("severity_rank") >= SEVERITIES.index(severity) + 1)


def ranked(alerts: DataFrame) -> DataFrame:
    """Highest severity first, then in the order of detection."""
    return alerts.orderBy(F.desc("severity_rank"), "ts", *DEDUP_TIE_ORDER, "alert_id")


def by_severity(alerts: DataFrame) -> DataFrame:
    """Counts for all four severities, zeros included."""
    levels = alerts.sparkSession.createDataFrame(list(enumerate(SEVERITIES, 1)), "severity_rank INT, severity STRING")
    counts = alerts.groupBy("severity").agg(F.count("*").alias("alerts"))
    return levels.join(counts, "severity", "left").select(
        "severity", F.coalesce("alerts", F.lit(0)).cast("bigint").alias("alerts")
    )


def by_category(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("category").agg(F.count("*").alias("alerts"))


def top_sources(alerts: DataFrame, n: int = 10) -> DataFrame:
    return alerts.groupBy(F.col("src_ip").alias("ip")).agg(F.count("*").alias("alert_count")).orderBy(
        F.desc("alert_count"), "ip"
    ).limit(n)


def timeline(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.date_format("ts", "yyyy-MM-dd HH:00").alias("hour")).agg(
        F.count("*").alias("alerts")
    ).orderBy("hour")


def summary(alerts: DataFrame) -> dict[str, DataFrame]:
    return {
        "severity_breakdown": by_severity(alerts), "category_breakdown": by_category(alerts),
        "top_source_ips": top_sources(alerts), "timeline": timeline(alerts),
    }
