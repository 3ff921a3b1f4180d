"""Predicates, lookups and small text helpers over flow columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ports watched for failed logins, and the actions that count as failed,
# denied (traffic totals) and failed (traffic totals).
AUTH_PORTS = [21, 22, 23, 25, 80, 110, 143, 443, 3389, 8080, 8443]
LOGIN_FAILURE_ACTIONS = ["failed", "denied", "reject", "drop"]
DENIED_ACTIONS = ["deny", "drop", "blocked", "reject"]
FAILED_ACTIONS = ["failed", "error"]

# Service names shown in the port ranking.
PORT_SERVICES = {
    20: "FTP-Data", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 80: "HTTP",
    110: "POP3", 143: "IMAP", 443: "HTTPS", 445: "SMB", 993: "IMAPS", 995: "POP3S",
    3306: "MySQL", 3389: "RDP", 5432: "PostgreSQL", 5900: "VNC", 6379: "Redis",
    8080: "HTTP-Proxy", 8443: "HTTPS-Alt", 27017: "MongoDB",
}

# Service names shown in brute-force alerts.
LOGIN_SERVICES = {
    21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 80: "HTTP", 443: "HTTPS", 3389: "RDP",
}

# Ports on which each named protocol is expected.
EXPECTED_PORTS = {
    "HTTP": [80, 8080], "HTTPS": [443, 8443], "DNS": [53], "SSH": [22],
    "FTP": [20, 21], "SMTP": [25],
}

PRIVATE_ADDRESS = r"^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|127\.)"


def _lookup(port: Column, names: dict[int, str], default: Column) -> Column:
    pairs = [F.lit(item) for entry in names.items() for item in entry]
    return F.coalesce(F.element_at(F.create_map(*pairs), port), default)


def port_service(port: Column) -> Column:
    return _lookup(port, PORT_SERVICES, F.lit("Unknown"))


def login_service(port: Column) -> Column:
    return _lookup(port, LOGIN_SERVICES, F.concat(F.lit("Port "), port.cast("string")))


def total_bytes() -> Column:
    return F.col("bytes_sent") + F.col("bytes_received")


def is_login_failure() -> Column:
    return F.col("action").isin(LOGIN_FAILURE_ACTIONS) & (
        F.col("dst_port").isin(AUTH_PORTS) | (F.col("action") == "failed")
    )


def is_outbound_transfer() -> Column:
    return F.col("direction").isin("outbound", "unknown") & (F.col("bytes_sent") > 0)


def in_hours(ts: Column, start: int, end: int, wrap: bool = False) -> Column:
    """start <= hour < end. ``wrap`` also accepts ranges over midnight such as 22 to 5."""
    hour = F.hour(ts)
    if wrap and start > end:
        return (hour >= start) | (hour < end)
    return (hour >= start) & (hour < end)


def is_internal(ip: Column) -> Column:
    return ip.rlike(PRIVATE_ADDRESS)


def human_bytes(amount: Column) -> Column:
    """1024-step size text with one decimal (ties to even), from B to PB."""
    size = amount.cast("double")
    text = F.format_string("%.1f PB", F.bround(size / 1024.0**5, 1))
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        scaled = size / 1024.0**power
        text = F.when(F.abs(scaled) < 1024.0, F.format_string(f"%.1f {unit}", F.bround(scaled, 1))).otherwise(text)
    return text


def megabytes(amount: Column) -> Column:
    return amount / F.lit(1024 * 1024)
