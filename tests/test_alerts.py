"""Alert handling, results, sinks and the whole pipeline on small tables."""

import json

from pyspark.sql import functions as F

from tests.flowrows import at, by, flows, row
from tidewatch import sinks
from tidewatch.operators import alerts as al
from tidewatch.operators import detectors, results, stats, threat
from tidewatch.plans import pipeline
from tidewatch.schema import ALERT_COLUMNS


def graded(spark, severities, categories=()):
    fl = flows(spark, [row(i, src_ip=f"s{i}") for i in range(len(severities))])
    base = al.domain_alerts(fl.select("ts", "domain", "src_ip", "dst_ip", "dst_port", "event_id"))
    pick = F.element_at(F.array(*[F.lit(s) for s in severities]), F.col("event_id").cast("int") + 1)
    named = base.withColumn("severity", pick).withColumn("severity_rank", al.severity_rank(F.col("severity")))
    if categories:
        pick = F.element_at(F.array(*[F.lit(c) for c in categories]), F.col("event_id").cast("int") + 1)
        named = named.withColumn("category", pick)
    return named


def test_risk_score(spark):
    def score(*severities):
        alerts = graded(spark, severities) if severities else graded(spark, ["LOW"]).where("false")
        return tuple(results.risk_score(alerts).collect()[0])

    assert score("HIGH", "MEDIUM", "LOW") == (26.0, "LOW")
    assert score(*["CRITICAL"] * 4) == (100.0, "CRITICAL")
    assert score(*["CRITICAL"] * 5) == (100.0, "CRITICAL")
    assert score("CRITICAL", "HIGH") == (40.0, "MEDIUM")
    assert score("CRITICAL", "CRITICAL", "HIGH") == (65.0, "HIGH")
    assert score("ODD") == (1.0, "LOW")
    assert score() == (0.0, "LOW")


def test_recommendations(spark):
    none = results.recommendations(graded(spark, ["HIGH"], ["anonymization"])).collect()
    assert [(r.place, r.category, r.recommendation) for r in none] == [(1, None, results.NO_ADVICE)]
    some = results.recommendations(graded(spark, ["HIGH"] * 4, ["anomaly", "c2", "c2", "evasion"])).collect()
    assert [r.category for r in some] == ["c2", "anomaly"]


def test_counts_and_ranking(spark):
    alerts = graded(spark, ["LOW", "CRITICAL", "HIGH", "CRITICAL"])
    assert {r.severity: r.alerts for r in al.by_severity(alerts).collect()} == {
        "LOW": 1, "MEDIUM": 0, "HIGH": 1, "CRITICAL": 2}
    assert [r.src_ip for r in al.ranked(alerts).collect()] == ["s1", "s3", "s2", "s0"]
    assert sorted(r.src_ip for r in al.at_least(alerts, "HIGH").collect()) == ["s1", "s2", "s3"]
    assert [tuple(r) for r in al.timeline(alerts).collect()] == [("2024-01-01 00:00", 4)]
    assert al.top_sources(alerts, 2).count() == 2


def test_dedup_traps(spark):
    feed = spark.createDataFrame(
        [("malicious_ip", "6.6.6.6"), ("malicious_ip", "7.7.7.7"), ("malicious_domain", "evil.com")],
        "kind STRING, indicator STRING")
    fl = flows(spark, [
        row(0, src_ip="6.6.6.6", dst_ip="7.7.7.7"), row(100, src_ip="6.6.6.6", dst_ip="7.7.7.7", domain="evil.com"),
        *[row(1000 + i, dst_port=22, action="failed") for i in range(5)],
        *[row(1010 + i, dst_port=3389, action="failed") for i in range(5)],
    ])
    raw = al.union_alerts([
        al.malicious_ip_alerts(threat.ip_first_seen(fl, feed, threat.MALICIOUS_IP)),
        al.domain_alerts(threat.domain_contacts(fl, feed)),
        al.brute_force_alerts(detectors.brute_force(fl), 300),
    ])
    assert raw.count() == 5
    kept = al.dedupe(raw).orderBy("ts").collect()
    assert [(r.rule_id, r.dst_port) for r in kept] == [("RULE-008", 0), ("RULE-003", 22)]
    # Both ends are listed: the source's alert comes first and stays.
    assert json.loads(kept[0].evidence)["direction"] == "source"
    assert kept[0].alert_id.startswith("ALERT-")
    assert json.loads(kept[1].evidence)["failed_attempts"] == 5
    assert kept[1].description == (
        "Brute force attack detected: 5 failed SSH login attempts from 10.0.0.1 to 192.168.0.1:22 within 5 minutes.")


def attack_flows(spark):
    return flows(spark, [
        *[row(86400 / 2 + i, src_ip="scan", dst_port=i) for i in range(20)],
        *[row(90000 + i, src_ip="login", dst_port=22, action="failed") for i in range(6)],
        *[row(129600, src_ip=f"bot{i % 50}", dst_ip="victim", bytes_sent=1) for i in range(1000)],
        *[row(99000 + 60 * i, src_ip="thief", bytes_sent=30_000_000, direction="outbound") for i in range(4)],
        *[row(300 * i, src_ip="beacon", dst_ip="c2") for i in range(12)],
        *[row(i, src_ip="night", dst_ip=f"n{i}") for i in range(25)],
        *[row(100000 + i, src_ip=f"calm{i}") for i in range(30)],
        row(100, src_ip="infected", domain="Evil.com"), row(101, src_ip="tor", dst_ip="9.9.9.9"),
    ])


def test_pipeline(spark, tmp_path):
    feed = spark.createDataFrame([("malicious_domain", "evil.com"), ("tor_exit_node", "9.9.9.9")],
                                 "kind STRING, indicator STRING")
    rules = [{"id": "RULE-X", "name": "Telnet", "category": "evasion", "severity": "LOW", "conditions": {"dst_port": 19}}]
    settings = pipeline.Settings(rules=rules, min_severity="MEDIUM")
    fl = attack_flows(spark)
    alerts = pipeline.final_alerts(fl, feed, settings)
    assert alerts.columns == ALERT_COLUMNS
    got = {(r.rule_id, r.src_ip, r.category) for r in alerts.collect()}
    assert {r for r in got if r[0] != "ANOMALY-001"} == {
        ("RULE-001", "scan", "reconnaissance"), ("RULE-003", "login", "brute_force"),
        ("RULE-006", "50 sources", "ddos"), ("RULE-010", "thief", "exfiltration"), ("RULE-011", "beacon", "c2"),
        ("RULE-013", "night", "insider_threat"), ("RULE-008", "infected", "threat_intel"),
        ("RULE-014", "tor", "anonymization"), ("RULE-X", "scan", "evasion")}
    assert pipeline.raw_alerts(fl, None, pipeline.Settings(anomaly=None)).where("category = 'threat_intel'").count() == 0

    tables = pipeline.report(fl, alerts, settings, files=3)
    sinks.write_report(tables, str(tmp_path / "report"))
    sinks.write_alerts(alerts, str(tmp_path / "alerts"))
    read = lambda name: spark.read.json(str(tmp_path / name))
    assert read("report/alerts").where("severity = 'LOW'").count() == 0
    summary = read("report/executive_summary").collect()[0]
    assert summary.risk_score == 100.0 and summary.risk_level == "CRITICAL"
    assert summary.summary.startswith("URGENT ACTION REQUIRED: 3 critical security alert(s) detected. "
                                      "Evidence of active threats including c2, ddos, threat_intel. "
                                      "Analysis processed 1,099 network events from 3 log file(s) over a period of 36.0 hours.")
    written = read("alerts/alerts")
    assert written.count() == alerts.count()
    assert set(written.columns) == {*sinks.ALERT_FIELDS, "date"}
    scan = written.where("rule_id = 'RULE-001'").collect()[0]
    assert (scan.evidence.unique_ports, scan.timestamp) == (15, "2024-01-01T12:00:00")
    declared_too = pipeline.raw_alerts(fl, None, pipeline.Settings(declared_rules=True))
    assert declared_too.where("detector_no = 9").count() == 0
    assert {r.severity: r.alerts for r in read("alerts/metadata").collect()}["LOW"] == 1


def test_traffic_statistics(spark):
    one = stats.traffic_stats(flows(spark, [row(0, bytes_sent=3, dst_port=0)])).collect()[0]
    assert (one.duration_seconds, one.events_per_second, one.unique_dst_ports, one.total_bytes) == (1.0, 1.0, 0, 3)
    none = stats.traffic_stats(flows(spark, [row(0)]).where("false")).collect()[0]
    assert (none.total_events, none.total_bytes, none.events_per_second) == (0, 0, 0.0)
    fl = flows(spark, [
        row(0, src_ip="172.16.0.1", dst_ip="172.32.0.1", protocol="", action="deny"),
        row(1, src_ip="10.1.1.1", dst_ip="::1", action="denied"), row(7, src_ip="10.1.1.1", dst_ip="100.1.1.1", action="error"),
    ])
    geo = stats.geo_summary(fl).collect()[0]
    assert tuple(geo) == (2, 3, "2:3")
    assert stats.geo_summary(fl.select("*").withColumn("dst_ip", F.lit("127.0.0.1"))).collect()[0][2] == "All internal"
    assert [tuple(r) for r in stats.protocol_dist(fl).collect()] == [("TCP", 2), ("UNKNOWN", 1)]
    assert {r.protocol for r in stats.protocol_bytes(fl).collect()} == {"", "TCP"}
    total = stats.traffic_stats(fl).collect()[0]
    assert (total.denied_connections, total.failed_actions, total.duration_seconds) == (1, 1, 7.0)
    assert [r.ip for r in stats.top_talkers(fl, 1).collect()] == ["10.1.1.1"]
    assert by(stats.top_ports(flows(spark, [row(0, dst_port=5432), row(0, dst_port=7)])), "port")[5432]["service"] == "PostgreSQL"
    assert at(0) == total.first_ts
