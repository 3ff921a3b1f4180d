"""Syslog lines: firewall messages, or any message that names two addresses."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources import layout as lo

# The line shapes.
PREFIX = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+"
FIREWALL = (
    r"(?i)src=([\d.]+)(?::(\d+))?\s+dst=([\d.]+)(?::(\d+))?\s+proto=(\w+)\s*"
    r"(?:action=(\w+))?\s*(?:bytes=(\d+))?\s*(?:packets=(\d+))?"
)
WHOLE_FIREWALL = r"(?is)^.*?" + FIREWALL.removeprefix("(?i)") + r".*$"
SEPARATOR = "\u0001"
ALL_PARTS = SEPARATOR.join(f"${i}" for i in range(1, 9))
ADDRESS = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"


def read_syslog(spark: SparkSession, paths: list[str], default_year: int) -> DataFrame:
    """All lines of the given files with their status."""
    return lines(spark.read.text(paths).select("value", *lo.place_columns()), default_year)


def lines(text: DataFrame, default_year: int) -> DataFrame:
    """Parsed columns of rows with ``value`` and the place columns; also usable on a stream."""
    line = lo.strip(F.col("value"))
    rows = text.withColumn("line", line).where((line != "") & ~line.startswith("#"))

    firewall = F.col("line").rlike(FIREWALL)
    # One pass of the pattern gives all eight parts.
    parts = F.split(F.regexp_replace("line", WHOLE_FIREWALL, ALL_PARTS), SEPARATOR)
    found = rows.select(
        "line", "source_file", "source_block", "source_row", firewall.alias("is_firewall"),
        F.when(firewall, parts).alias("parts"), lo.plain_stamp(F.regexp_extract("line", PREFIX, 1)).alias("stamp"),
        F.when(~firewall, F.regexp_extract("line", PREFIX, 3)).alias("program"),
        F.when(~firewall, F.regexp_extract_all("line", F.lit(ADDRESS), 1)).alias("ips"),
    )
    found = lo.computed_once(found, ["*", lo.parse_timestamp(F.col("stamp"), default_year).alias("ts")])
    firewall = F.col("is_firewall")
    two_ips = (F.col("stamp") != "") & (F.size("ips") >= 2)
    ts = F.col("ts")

    def part(number: int) -> Column:
        return F.get("parts", F.lit(number - 1))

    def number(place: int, kind: str, default: int) -> Column:
        text = part(place)
        return F.when(firewall & (text != ""), text.try_cast(kind)).otherwise(F.lit(default).cast(kind))

    numbers = {
        "src_port": number(2, "int", 0), "dst_port": number(4, "int", 0),
        "bytes_sent": number(7, "bigint", 0), "packets": number(8, "bigint", 1),
    }
    bad_number = F.lit(False)
    for value in numbers.values():
        bad_number = bad_number | value.isNull()
    return found.where(firewall | two_ips).select(
        "ts",
        F.when(firewall, part(1)).otherwise(F.get("ips", F.lit(0))).alias("src_ip"),
        F.when(firewall, part(3)).otherwise(F.get("ips", F.lit(1))).alias("dst_ip"),
        *[value.alias(name) for name, value in numbers.items()],
        F.when(firewall, F.upper(part(5))).otherwise("UNKNOWN").alias("protocol"),
        F.lit(0).cast("bigint").alias("bytes_received"), F.lit(0.0).alias("duration"), F.lit("").alias("flags"),
        F.when(firewall, F.lower(part(6))).otherwise("").alias("action"), F.lit(None).cast("int").alias("status_code"),
        F.lit("unknown").alias("direction"), F.lit("").alias("domain"), F.col("line").alias("raw_log"),
        F.when(firewall, F.create_map().cast("map<string,string>"))
        .otherwise(F.create_map(F.lit("program"), F.col("program"))).alias("metadata"),
        # A line without a usable time is rejected rather than dated to the day of the run.
        F.when(ts.isNull() | bad_number, lo.REJECTED).otherwise(lo.ACCEPTED).alias("status"),
        "source_file", "source_block", "source_row",
    ).select(lo.PARSED_COLUMNS)
