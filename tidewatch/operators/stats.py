"""Traffic statistics. Every grouping is combined before the shuffle; rankings are top-k heaps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import network as net
from tidewatch.functions.clock import MICROS, micros

TOP_N = 20


def traffic_stats(flows: DataFrame, approximate: bool = False) -> DataFrame:
    """One row of totals. ``approximate`` swaps the exact distinct counts for sketches."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    zero = F.lit(0).cast("bigint")
    totals = flows.agg(
        F.count("*").alias("total_events"),
        F.coalesce(F.sum(net.total_bytes()), zero).alias("total_bytes"),
        distinct("src_ip").alias("unique_src_ips"),
        distinct("dst_ip").alias("unique_dst_ips"),
        distinct(F.when(F.col("dst_port") > 0, F.col("dst_port"))).alias("unique_dst_ports"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.coalesce(F.sum(F.when(F.col("direction") == "inbound", F.col("bytes_received"))), zero).alias("inbound_bytes"),
        F.coalesce(F.sum(F.when(F.col("direction") == "outbound", F.col("bytes_sent"))), zero).alias("outbound_bytes"),
        F.count_if(F.col("action").isin(net.DENIED_ACTIONS)).alias("denied_connections"),
        F.count_if(F.col("action").isin(net.FAILED_ACTIONS)).alias("failed_actions"),
    )
    span = (micros(F.col("last_ts")) - micros(F.col("first_ts"))) / MICROS
    seconds = F.coalesce(F.greatest(span, F.lit(1.0)), F.lit(1.0))
    return totals.withColumn("duration_seconds", seconds).withColumn(
        "events_per_second", F.col("total_events") / F.col("duration_seconds")
    ).withColumn("bytes_per_second", F.col("total_bytes") / F.col("duration_seconds"))


def protocol_dist(flows: DataFrame) -> DataFrame:
    name = F.when(F.col("protocol") == "", "UNKNOWN").otherwise(F.coalesce("protocol", F.lit("UNKNOWN")))
    return flows.groupBy(name.alias("protocol")).agg(F.count("*").alias("events")).orderBy(
        F.desc("events"), "protocol"
    )


def top_talkers(flows: DataFrame, n: int = TOP_N) -> DataFrame:
    counts = flows.groupBy(F.col("src_ip").alias("ip")).agg(
        F.count("*").alias("events"), F.sum(net.total_bytes()).alias("bytes")
    )
    top = counts.orderBy(F.desc("events"), "ip").limit(n)
    return top.withColumn("bytes_human", net.human_bytes(F.col("bytes")))


def top_destinations(flows: DataFrame, n: int = TOP_N) -> DataFrame:
    # Two aggregation levels: a busy target is first split by source.
    pairs = flows.groupBy("dst_ip", "src_ip").agg(
        F.count("*").alias("events"), F.sum(net.total_bytes()).alias("bytes")
    )
    counts = pairs.groupBy(F.col("dst_ip").alias("ip")).agg(
        F.sum("events").alias("events"), F.sum("bytes").alias("bytes"), F.count("*").alias("unique_sources")
    )
    top = counts.orderBy(F.desc("events"), "ip").limit(n)
    return top.withColumn("bytes_human", net.human_bytes(F.col("bytes")))


def top_ports(flows: DataFrame, n: int = TOP_N) -> DataFrame:
    counts = flows.where(F.col("dst_port") > 0).groupBy(F.col("dst_port").alias("port")).agg(
        F.count("*").alias("events")
    )
    top = counts.orderBy(F.desc("events"), "port").limit(n)
    return top.withColumn("service", net.port_service(F.col("port")))


def hourly_dist(flows: DataFrame) -> DataFrame:
    return flows.groupBy(F.date_format("ts", "HH:00").alias("hour")).agg(F.count("*").alias("events")).orderBy("hour")


def protocol_bytes(flows: DataFrame) -> DataFrame:
    return flows.groupBy("protocol").agg(F.sum(net.total_bytes()).alias("bytes")).orderBy(F.desc("bytes"), "protocol")


def connection_pairs(flows: DataFrame, n: int = 10) -> DataFrame:
    counts = flows.groupBy("src_ip", "dst_ip").agg(F.count("*").alias("connections"))
    return counts.orderBy(F.desc("connections"), "src_ip", "dst_ip").limit(n)


def geo_summary(flows: DataFrame) -> DataFrame:
    """Distinct internal and external addresses over both ends."""
    ips = flows.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()
    counts = ips.agg(
        F.count_if(net.is_internal(F.col("ip"))).alias("internal_ips"),
        F.count_if(~net.is_internal(F.col("ip"))).alias("external_ips"),
    )
    ratio = F.when(F.col("external_ips") == 0, "All internal").otherwise(
        F.concat_ws(":", F.col("internal_ips").cast("string"), F.col("external_ips").cast("string"))
    )
    return counts.withColumn("internal_to_external_ratio", ratio)
