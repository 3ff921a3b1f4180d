"""The whole analysis: flows and feeds in, alert, statistics and report tables out."""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from tidewatch.durable import durable
from tidewatch.operators import alerts as al
from tidewatch.operators import declared, detectors, results, stats, threat


@dataclass(frozen=True)
class Settings:
    """Thresholds; the defaults are the ones the detectors document."""

    threat_intel: bool = True
    port_scan: dict[str, Any] = field(default_factory=lambda: {"unique_ports": 15, "window_s": 60})
    brute_force: dict[str, Any] = field(default_factory=lambda: {"failed_attempts": 5, "window_s": 300})
    ddos: dict[str, Any] = field(
        default_factory=lambda: {"requests_per_second": 1000, "unique_sources": 50, "window_s": 10})
    exfiltration: dict[str, Any] = field(default_factory=lambda: {"outbound_bytes": 104_857_600, "window_s": 3600})
    beaconing: dict[str, Any] = field(default_factory=lambda: {"min_connections": 10, "tolerance_percent": 15})
    after_hours: dict[str, Any] = field(
        default_factory=lambda: {"start_hour": 0, "end_hour": 5, "min_events": 20})
    anomaly: dict[str, Any] | None = field(default_factory=lambda: {"sensitivity": "medium"})
    rules: list[dict[str, Any]] = field(default_factory=list)
    declared_rules: bool = False
    dedup_window_s: float = 300
    min_severity: str = "LOW"
    top_n: int = stats.TOP_N


def raw_alerts(flows: DataFrame, feeds: DataFrame | None, settings: Settings = Settings()) -> DataFrame:
    """All detectors in their fixed order, before deduplication.

    Detectors do not depend on each other, so their jobs are submitted side by side and
    share the cluster, and each writes its few alerts as a table of its own.
    """
    steps: list[Callable[[], DataFrame]] = []
    if feeds is not None and settings.threat_intel:
        steps += [
            lambda: al.malicious_ip_alerts(threat.ip_first_seen(flows, feeds, threat.MALICIOUS_IP)),
            lambda: al.tor_alerts(threat.ip_first_seen(flows, feeds, threat.TOR_NODE)),
            lambda: al.domain_alerts(threat.domain_contacts(flows, feeds)),
        ]
    scan, brute, exfil, night = settings.port_scan, settings.brute_force, settings.exfiltration, settings.after_hours
    steps += [
        lambda: al.port_scan_alerts(detectors.port_scan(flows, **scan), scan["window_s"]),
        lambda: al.brute_force_alerts(detectors.brute_force(flows, **brute), brute["window_s"]),
        lambda: al.ddos_alerts(detectors.ddos(flows, **settings.ddos)),
        lambda: al.exfiltration_alerts(detectors.exfiltration(flows, **exfil), exfil["window_s"]),
        lambda: al.beaconing_alerts(detectors.beaconing(flows, **settings.beaconing)),
        lambda: al.after_hours_alerts(detectors.after_hours(flows, **night), night["start_hour"], night["end_hour"]),
    ]
    if settings.anomaly is not None:
        steps.append(lambda: al.anomaly_alerts(detectors.anomaly(flows, **settings.anomaly)))
    if settings.declared_rules:
        steps += [
            lambda rule=rule: al.declared_alerts(rule.detect(flows), rule) for rule in declared.DECLARED_RULES
        ]
    if settings.rules:
        steps.append(lambda: al.custom_rule_alerts(declared.threshold_rules(flows, settings.rules)))
    with ThreadPoolExecutor(len(steps)) as pool:
        return al.union_alerts(list(pool.map(lambda step: durable(step(), "found"), steps)))


def final_alerts(flows: DataFrame, feeds: DataFrame | None, settings: Settings = Settings()) -> DataFrame:
    """Deduplicated alerts, written once because several reports read them."""
    return durable(al.dedupe(raw_alerts(flows, feeds, settings), settings.dedup_window_s), "alerts")


def report(flows: DataFrame, alerts: DataFrame, settings: Settings = Settings(), files: int = 1) -> dict[str, DataFrame]:
    """The report as separate tables; none of them passes through the driver."""
    return {
        "executive_summary": results.exec_summary(flows, alerts, files),
        "alerts": al.ranked(al.at_least(alerts, settings.min_severity)),
        "recommendations": results.recommendations(alerts),
        **al.summary(alerts),
        "traffic_statistics": stats.traffic_stats(flows),
        "protocol_distribution": stats.protocol_dist(flows),
        "top_talkers": stats.top_talkers(flows, settings.top_n),
        "top_destinations": stats.top_destinations(flows, settings.top_n),
        "top_ports": stats.top_ports(flows, settings.top_n),
    }
