"""Writing alerts, flows and reports as datasets."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.clock import iso_text
from tidewatch.functions.network import total_bytes
from tidewatch.operators.alerts import by_severity

# The fields of an exported flow and of an exported alert.
FLOW_FIELDS = [
    "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes_sent", "bytes_received", "packets",
    "duration", "flags", "action", "status_code", "direction", "domain", "total_bytes",
]
ALERT_FIELDS = [
    "alert_id", "timestamp", "rule_id", "rule_name", "category", "severity", "src_ip", "dst_ip", "dst_port",
    "description", "evidence", "recommendation", "false_positive_likelihood", "mitre_attack_id",
]

# Text formats keep whole microseconds.
EXACT_TIME = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def flow_records(flows: DataFrame) -> DataFrame:
    """Flows with the fields and time text of an export."""
    return flows.withColumn("timestamp", iso_text(F.col("ts"))).withColumn("total_bytes", total_bytes()).select(FLOW_FIELDS)


def alert_records(alerts: DataFrame) -> DataFrame:
    """Alerts with the fields and time text of an export; evidence is an object, not text."""
    return alerts.withColumn("timestamp", iso_text(F.col("ts"))).withColumn(
        "evidence", F.parse_json("evidence")).select(ALERT_FIELDS)


def write_alerts(alerts: DataFrame, path: str, format: str = "json", mode: str = "errorifexists") -> None:
    """Alerts by day below ``alerts``, and their counts below ``metadata``."""
    dated = alert_records(alerts).withColumn("date", F.substring("timestamp", 1, 10))
    dated.write.mode(mode).partitionBy("date").format(format).save(f"{path}/alerts")
    by_severity(alerts).write.mode(mode).format("json").save(f"{path}/metadata")


def write_report(tables: dict[str, DataFrame], path: str, format: str = "json", mode: str = "errorifexists") -> None:
    """Each report table as a dataset of its own."""
    for name, table in tables.items():
        records = alert_records(table) if name == "alerts" else table
        records.write.mode(mode).format(format).options(**EXACT_TIME).save(f"{path}/{name}")
