"""Matches of flows against threat feeds, given as a table (kind, indicator)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.durable import BROADCAST_BYTES, bytes_of

MALICIOUS_IP, TOR_NODE, MALICIOUS_DOMAIN = "malicious_ip", "tor_exit_node", "malicious_domain"


def _listed(feeds: DataFrame, kind: str) -> DataFrame:
    return feeds.where(F.col("kind") == kind).select("indicator").distinct()


def ip_first_seen(flows: DataFrame, feeds: DataFrame, kind: str) -> DataFrame:
    """The first flow of every listed address; a flow's source is looked at before its target."""
    listed = _listed(feeds, kind)

    def role(name: str, number: int) -> Column:
        return F.struct(F.col(name).alias("ip"), F.lit(number).alias("role_no"))

    ends = flows.select(
        "ts", "event_id", "src_ip", "dst_ip", "dst_port",
        F.explode(F.array(role("src_ip", 0), role("dst_ip", 1))).alias("_end"),
    ).select("ts", "event_id", "src_ip", "dst_ip", "dst_port", "_end.*")
    sighting = F.min(F.struct("ts", "event_id", "role_no", "src_ip", "dst_ip", "dst_port")).alias("_f")
    is_listed = F.lower("ip") == F.col("indicator")
    if bytes_of(listed) <= BROADCAST_BYTES:
        first = ends.join(F.broadcast(listed), is_listed, "left_semi").groupBy("ip").agg(sighting)
    else:
        # A large feed meets one row per address, so no busy address is shuffled row by row.
        first = ends.groupBy("ip").agg(sighting).join(listed, is_listed, "left_semi")
    return first.select(
        "_f.ts", "ip", F.when(F.col("_f.role_no") == 0, "source").otherwise("destination").alias("direction"),
        "_f.src_ip", "_f.dst_ip", "_f.dst_port", "_f.event_id", "_f.role_no",
    )


def domain_contacts(flows: DataFrame, feeds: DataFrame) -> DataFrame:
    """Every flow whose domain is listed (exact match, ignoring case)."""
    listed = _listed(feeds, MALICIOUS_DOMAIN)
    if bytes_of(listed) <= BROADCAST_BYTES:
        listed = F.broadcast(listed)
    # For a large feed the busy domains are split by the adaptive skew join.
    named = flows.where(F.col("domain") != "")
    return named.join(listed, F.lower("domain") == F.col("indicator"), "left_semi").select(
        "ts", "domain", "src_ip", "dst_ip", "dst_port", "event_id"
    )
