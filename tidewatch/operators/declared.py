"""Rules that are declared with thresholds only, and rules given as data."""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.durable import durable
from tidewatch.functions import network as net
from tidewatch.functions.clock import from_micros
from tidewatch.operators.detectors import port_scan, repeated_attempts
from tidewatch.operators.sliding import first_hits


def udp_scan(flows: DataFrame, unique_ports: int = 20, window_s: float = 60, chunks: int | None = None) -> DataFrame:
    return port_scan(flows, unique_ports, window_s, where=F.col("protocol") == "UDP", chunks=chunks)


def syn_scan(flows: DataFrame, unique_ports: int = 15, window_s: float = 60, chunks: int | None = None) -> DataFrame:
    tcp_syn = (F.col("protocol") == "TCP") & (F.col("flags") == "SYN")
    return port_scan(flows, unique_ports, window_s, where=tcp_syn, chunks=chunks)


def http_bruteforce(flows: DataFrame, count_min: int = 10, window_s: float = 600,
                    chunks: int | None = None) -> DataFrame:
    """Repeated 401/403 answers on web ports."""
    rows = flows.where(
        (F.col("protocol") == "TCP") & F.col("dst_port").isin(80, 443, 8080, 8443)
        & F.col("status_code").isin(401, 403)
    )
    return repeated_attempts(rows, ["src_ip", "dst_ip", "dst_port"], count_min, window_s, chunks)


def syn_flood(flows: DataFrame, ratio: float = 5.0, min_syn: int = 1, window_s: float = 30,
              chunks: int | None = None) -> DataFrame:
    """Targets that get ``ratio`` times more SYN than SYN,ACK (at least one is assumed)."""
    handshake = flows.where((F.col("protocol") == "TCP") & F.col("flags").isin("SYN", "SYN,ACK"))
    answers = F.col("s")
    opened = F.col("n") - F.col("s")
    hits, _ = first_hits(
        handshake, ["dst_ip"], window_s,
        fires=lambda: (opened >= min_syn) & (opened / F.greatest(answers, F.lit(1)) >= ratio),
        possible=lambda: (opened >= min_syn) & (opened >= ratio),
        value=(F.col("flags") == "SYN,ACK").cast("bigint"), chunks=chunks,
    )
    return hits.select(
        from_micros("start").alias("ts"), "dst_ip", opened.alias("syn_count"), answers.alias("synack_count"),
        from_micros("t").alias("last_ts"), F.col("eid").alias("event_id"),
    )


def dns_tunnel(flows: DataFrame, query_length: int = 50, count_min: int = 30, window_s: float = 60,
               chunks: int | None = None) -> DataFrame:
    """Sources with many long DNS names per window."""
    rows = flows.where(
        (F.col("protocol") == "UDP") & (F.col("dst_port") == 53) & (F.length("domain") >= query_length)
    )
    return repeated_attempts(rows, ["src_ip"], count_min, window_s, chunks)


def proto_mismatch(flows: DataFrame) -> DataFrame:
    """Named protocols seen on ports where they are not expected."""
    wrong = reduce(
        lambda a, b: a | b,
        [(F.col("protocol") == name) & ~F.col("dst_port").isin(ports) for name, ports in net.EXPECTED_PORTS.items()],
    )
    return flows.where(wrong).groupBy("src_ip", "dst_ip", "dst_port", "protocol").agg(
        F.min("ts").alias("ts"), F.count("*").alias("events")
    )


def icmp_flood(flows: DataFrame, packets_per_second: float = 500, window_s: float = 10,
               chunks: int | None = None) -> DataFrame:
    """Targets whose ICMP packets within the window average at least the given rate."""
    enough = lambda: F.col("s") >= packets_per_second * window_s
    hits, _ = first_hits(
        flows.where((F.col("protocol") == "ICMP") & (F.col("packets") > 0)), ["dst_ip"], window_s,
        enough, enough, enough, value=F.col("packets"), chunks=chunks,
    )
    return hits.select(
        from_micros("start").alias("ts"), "dst_ip", F.col("s").alias("packets"), F.col("n").alias("events"),
        from_micros("t").alias("last_ts"), F.col("eid").alias("event_id"),
    )


@dataclass(frozen=True)
class DeclaredRule:
    rule_id: str
    name: str
    description: str
    category: str
    severity: str
    mitre: str
    detect: Callable[[DataFrame], DataFrame]


# The declared rules, run with their declared thresholds.
DECLARED_RULES = [
    DeclaredRule("RULE-002", "UDP Port Scan", "Detects UDP port scanning activity",
                 "reconnaissance", "MEDIUM", "T1046", udp_scan),
    DeclaredRule("RULE-005", "HTTP Login Brute Force", "Multiple failed HTTP login attempts (401/403 responses)",
                 "brute_force", "MEDIUM", "T1110", http_bruteforce),
    DeclaredRule("RULE-007", "SYN Flood", "Excessive SYN packets without completing handshake",
                 "ddos", "CRITICAL", "T1498", syn_flood),
    DeclaredRule("RULE-009", "DNS Tunneling Suspected", "Unusually long DNS queries suggesting DNS tunneling",
                 "exfiltration", "HIGH", "T1071.004", dns_tunnel),
    DeclaredRule("RULE-012", "Unusual Port Usage", "Standard protocol on non-standard port (protocol mismatch)",
                 "evasion", "MEDIUM", "T1571", proto_mismatch),
    DeclaredRule("RULE-015", "ICMP Flood", "Excessive ICMP traffic indicating potential ping flood",
                 "ddos", "HIGH", "T1498", icmp_flood),
]

# Conditions of a data rule that compare one field with a value or a list of values.
RULE_FIELDS = [
    "protocol", "flags", "action", "direction", "domain", "src_ip", "dst_ip", "src_port", "dst_port", "status_code",
]
RULE_OTHERS = ["count_min", "bytes_sent_min", "time_window_seconds"]


def _meets(conditions: dict[str, Any]) -> Column:
    tests = [F.lit(True)]
    for field in RULE_FIELDS:
        if field in conditions:
            wanted = conditions[field]
            tests.append(F.col(field).isin(wanted if isinstance(wanted, list) else [wanted]))
    if "bytes_sent_min" in conditions:
        tests.append(F.col("bytes_sent") >= conditions["bytes_sent_min"])
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def threshold_rules(flows: DataFrame, rules: list[dict[str, Any]], chunks: int | None = None) -> DataFrame:
    """Rules given as dicts with id, name, category, severity, enabled and conditions.

    With ``count_min`` and ``time_window_seconds`` a rule fires once per (source, target,
    port); otherwise on every flow that meets its conditions. One scan tags each flow with the
    rules it meets, and what is tagged is written; rules that count over equal windows are
    followed together, with the rule as part of the key.
    """
    active = [rule for rule in rules if rule.get("enabled", True)]
    if not active:
        raise ValueError("no enabled rule")
    for rule in active:
        unknown = set(rule.get("conditions", {})) - set(RULE_FIELDS) - set(RULE_OTHERS)
        if unknown:
            raise ValueError(f"rule {rule['id']}: unknown conditions {sorted(unknown)}")
    met = F.array_compact(F.array(*[F.when(_meets(rule.get("conditions", {})), i) for i, rule in enumerate(active)]))
    columns = ["ts", "src_ip", "dst_ip", "dst_port", "bytes_sent", "event_id"]
    tagged = durable(flows.select(*columns, F.explode(met).alias("rule_no")), "rule-matches")

    windows: dict[float, list[int]] = {}
    for i, rule in enumerate(active):
        if "count_min" in rule.get("conditions", {}):
            windows.setdefault(rule["conditions"]["time_window_seconds"], []).append(i)
    counting = [i for numbers in windows.values() for i in numbers]
    parts = [tagged.where(~F.col("rule_no").isin(counting)).withColumn("events", F.lit(1).cast("bigint"))]
    for window_s, numbers in windows.items():
        least = F.element_at(F.create_map(*[F.lit(x) for i in numbers for x in (i, active[i]["conditions"]["count_min"])]), F.col("rule_no"))
        hits = repeated_attempts(tagged.where(F.col("rule_no").isin(numbers)), ["rule_no", "src_ip", "dst_ip", "dst_port"], least, window_s, chunks)
        parts.append(hits.withColumnRenamed("attempts", "events").withColumn("bytes_sent", F.lit(None).cast("bigint")).select(*columns, "rule_no", "events"))

    def of_rule(name: str, default: str) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for i, rule in enumerate(active) for x in (i, rule.get(name, default))]), F.col("rule_no"))

    return reduce(DataFrame.unionByName, parts).select(
        of_rule("id", "").alias("rule_id"), of_rule("name", "").alias("rule_name"), of_rule("category", "unknown").alias("category"),
        of_rule("severity", "LOW").alias("severity"), of_rule("description", "").alias("about"),
        "ts", "src_ip", "dst_ip", "dst_port", "events", "bytes_sent", "event_id",
    )
