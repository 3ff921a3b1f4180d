"""Risk score and level, recommendations and the executive summary."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.clock import MICROS, micros
from tidewatch.schema import OTHER_RISK_WEIGHT, RISK_WEIGHTS

# Advice per alert category, in report order, and the line for none of them.
CATEGORY_ADVICE = [
    ("threat_intel", "CRITICAL: Block all communication with known malicious IPs immediately. "
     "Isolate affected hosts and conduct forensic investigation."),
    ("c2", "CRITICAL: C2 beaconing detected - isolate the affected host from the network. "
     "Run full malware scan and check for lateral movement."),
    ("brute_force", "HIGH: Implement account lockout policies and multi-factor authentication. "
     "Block attacking IPs at the perimeter firewall."),
    ("reconnaissance", "HIGH: Port scanning detected - review firewall rules and minimize exposed services. "
     "Ensure all exposed services are patched and hardened."),
    ("ddos", "HIGH: Deploy DDoS mitigation (rate limiting, traffic scrubbing). "
     "Consider CDN/WAF services for critical applications."),
    ("exfiltration", "HIGH: Investigate large outbound data transfers. Implement Data Loss Prevention "
     "(DLP) policies and monitor for unauthorized data movement."),
    ("insider_threat", "MEDIUM: Review after-hours network activity. Verify if scheduled tasks or "
     "legitimate maintenance was occurring. Enhance monitoring."),
    ("anomaly", "MEDIUM: Investigate traffic anomalies. Establish network baselines and "
     "tune detection thresholds to reduce false positives."),
]
# The parts of the summary sentence.
URGENT = (
    "URGENT ACTION REQUIRED: %d critical security alert(s) detected. "
    "Evidence of active threats including %s. "
)
ELEVATED = "Elevated threat level: %d high-severity alert(s) require investigation. "
STABLE = "Network security posture appears stable. "
TOTALS = (
    "Analysis processed %s network events from %d log file(s) over a period of %.1f hours. "
    "Total of %d security alerts generated across %d attack categories. "
    "Overall risk score: %.0f/100 (%s)."
)
NO_ADVICE = (
    "No significant threats detected. Continue regular monitoring and keep "
    "detection signatures updated."
)


def risk_level(score: Column) -> Column:
    return F.when(score >= 80, "CRITICAL").when(score >= 60, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW")


def _score() -> Column:
    weight = F.lit(OTHER_RISK_WEIGHT)
    for severity, value in RISK_WEIGHTS.items():
        weight = F.when(F.col("severity") == severity, value).otherwise(weight)
    return F.least(F.coalesce(F.sum(weight), F.lit(0)), F.lit(100)).cast("double")


def risk_score(alerts: DataFrame) -> DataFrame:
    return alerts.agg(_score().alias("risk_score")).withColumn("risk_level", risk_level(F.col("risk_score")))


def recommendations(alerts: DataFrame) -> DataFrame:
    spark = alerts.sparkSession
    advice = spark.createDataFrame(
        [(place, category, text) for place, (category, text) in enumerate(CATEGORY_ADVICE, 1)],
        "place INT, category STRING, recommendation STRING",
    )
    # At most one row per category on both sides.
    found = advice.join(alerts.select("category").distinct(), "category", "left_semi").select(
        "place", "category", "recommendation"
    )
    fallback = spark.createDataFrame([(1, None, NO_ADVICE)], found.schema)
    none_found = found.agg(F.count("*").alias("n")).scalar() == 0
    return found.unionByName(fallback.where(none_found)).orderBy("place")


def exec_summary(flows: DataFrame, alerts: DataFrame, files: int = 1) -> DataFrame:
    """One row: totals, score, level and the summary sentence."""
    critical = F.col("severity") == "CRITICAL"
    # Categories are a short fixed list, so the sets below are bounded.
    found = alerts.agg(F.struct(
        F.count("*").alias("alerts"),
        F.count_if(critical).alias("critical"),
        F.count_if(F.col("severity") == "HIGH").alias("high"),
        F.count_distinct("category").alias("categories"),
        F.concat_ws(", ", F.array_sort(F.collect_set(F.when(critical, F.col("category"))))).alias("critical_names"),
        _score().alias("risk_score"),
    ).alias("_a"))
    seen = flows.agg(F.count("*").alias("total_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    row = seen.withColumn("_a", found.scalar()).select("total_events", "first_ts", "last_ts", "_a.*")
    row = row.withColumn("risk_level", risk_level(F.col("risk_score"))).withColumn(
        "hours", (micros(F.col("last_ts")) - micros(F.col("first_ts"))) / (3600 * MICROS)
    )
    urgency = (
        F.when(F.col("critical") > 0, F.format_string(URGENT, "critical", "critical_names"))
        .when(F.col("high") > 0, F.format_string(ELEVATED, "high")).otherwise(STABLE)
    )
    text = F.concat(urgency, F.format_string(
        TOTALS, F.format_number("total_events", 0), F.lit(files), F.bround("hours", 1), "alerts", "categories", "risk_score", "risk_level",
    ))
    return row.withColumn("summary", text)
