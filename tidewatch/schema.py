"""Table layouts and the fixed values every module shares."""

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOWS_DDL = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, "
    "protocol STRING, bytes_sent BIGINT, bytes_received BIGINT, packets BIGINT, duration DOUBLE, "
    "flags STRING, action STRING, status_code INT, direction STRING, domain STRING"
)

# Columns of the unified alert table, in order. detector_no, event_id and role_no
# only settle the order of alerts that carry the same time stamp.
ALERT_COLUMNS = [
    "alert_id", "ts", "rule_id", "rule_name", "category", "severity", "severity_rank",
    "src_ip", "dst_ip", "dst_port", "description", "evidence", "recommendation",
    "false_positive_likelihood", "mitre_attack_id", "detector_no", "event_id", "role_no",
]

# Severities from lowest to highest, and their risk weights.
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
RISK_WEIGHTS = {"CRITICAL": 25, "HIGH": 15, "MEDIUM": 8, "LOW": 3}
OTHER_RISK_WEIGHT = 1

# Alert categories.
CATEGORIES = [
    "reconnaissance", "brute_force", "ddos", "exfiltration", "c2", "threat_intel",
    "evasion", "insider_threat", "anonymization", "anomaly", "unknown",
]


def severity_rank(severity: Column) -> Column:
    """1 for LOW up to 4 for CRITICAL; 0 for anything else."""
    rank = F.lit(0)
    for position, name in enumerate(SEVERITIES, start=1):
        rank = F.when(severity == name, position).otherwise(rank)
    return rank
