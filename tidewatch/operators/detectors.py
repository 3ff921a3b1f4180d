"""The keyed detectors. Each returns typed evidence columns; ``alerts`` turns them into alerts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.durable import broadcast_if_small, durable
from tidewatch.functions import network as net
from tidewatch.functions.clock import MICROS, from_micros, micros
from tidewatch.operators.scan import CHUNK, chunked_if_large
from tidewatch.operators.sliding import first_hits, rows_in_window

# Z-score thresholds per sensitivity.
SENSITIVITY = {"low": 3.5, "medium": 3.0, "high": 2.0}


def port_scan(flows: DataFrame, unique_ports: int = 15, window_s: float = 60,
              where: Column | None = None, chunks: int | None = None) -> DataFrame:
    """Sources that touch ``unique_ports`` distinct destination ports within the window."""
    rows = flows if where is None else flows.where(where)
    enough = lambda: F.col("d") >= unique_ports
    hits, picked = first_hits(
        rows, ["src_ip"], window_s, enough, enough, enough,
        distinct="dst_port", count_rows=False, extra=("dst_ip",), chunks=chunks,
    )
    hits = durable(hits, "hits")
    # A window ends at the row that brings the last port, so it holds exactly unique_ports ports.
    seen = rows_in_window(hits, picked, ["src_ip"], window_s).groupBy("src_ip").agg(
        F.min("t").alias("start"), F.max("hit_t").alias("hit_t"), F.max("hit_eid").alias("event_id"),
        F.count("*").alias("event_count"), F.count_distinct("dst_ip").alias("target_count"),
        F.min("dst_ip").alias("one_target"), F.collect_set("x").alias("ports"),
    )
    return seen.select(
        from_micros("start").alias("ts"), "src_ip",
        F.when(F.col("target_count") == 1, F.col("one_target"))
        .otherwise(F.concat(F.col("target_count").cast("string"), F.lit(" targets"))).alias("dst_ip"),
        F.size("ports").cast("bigint").alias("unique_ports"),
        F.slice(F.array_sort("ports"), 1, 20).alias("sample_ports"),
        "target_count",
        F.when(F.col("target_count") > 3, "horizontal").otherwise("vertical").alias("scan_type"),
        "event_count", from_micros("hit_t").alias("last_ts"), "event_id",
    )


def repeated_attempts(rows: DataFrame, keys: list[str], count_min: int | Column, window_s: float,
                      chunks: int | None = None) -> DataFrame:
    """First time ``count_min`` rows of one key fall into the window: keys, ts, last_ts, attempts.

    ``count_min`` may depend on the keys.
    """
    enough = lambda: F.col("n") >= count_min
    hits, _ = first_hits(rows, keys, window_s, enough, enough, enough, chunks=chunks)
    return hits.select(
        from_micros("start").alias("ts"), *keys, F.col("n").alias("attempts"),
        from_micros("t").alias("last_ts"), ((F.col("t") - F.col("start")) / MICROS).alias("span_seconds"),
        F.col("eid").alias("event_id"),
    )


def brute_force(flows: DataFrame, failed_attempts: int = 5, window_s: float = 300,
                chunks: int | None = None) -> DataFrame:
    """Failed logins per (source, target, port)."""
    hits = repeated_attempts(
        flows.where(net.is_login_failure()), ["src_ip", "dst_ip", "dst_port"], failed_attempts, window_s, chunks
    )
    return hits.withColumn("service", net.login_service(F.col("dst_port")))


def ddos(flows: DataFrame, requests_per_second: float = 1000, unique_sources: int = 50,
         window_s: float = 10, chunks: int | None = None) -> DataFrame:
    """Targets with a high event rate from many distinct sources."""
    seconds = F.greatest((F.col("t") - F.col("start")) / MICROS, F.lit(1.0))
    # The rate divides by at least one second and at most by the whole window.
    peak = requests_per_second * max(window_s, 1)
    hits, picked = first_hits(
        flows, ["dst_ip"], window_s,
        fires=lambda: (F.col("n") / seconds >= requests_per_second) & (F.col("d") >= unique_sources),
        possible=lambda: (F.col("n") >= requests_per_second) & (F.col("d") >= unique_sources),
        certain=lambda: (F.col("n") >= peak) & (F.col("d") >= unique_sources),
        value=net.total_bytes(), distinct="src_ip", chunks=chunks,
    )
    hits = durable(hits, "hits")
    per_source = rows_in_window(hits, picked, ["dst_ip"], window_s).groupBy("dst_ip", "x").agg(
        F.count("*").alias("events")
    )
    rank = Window.partitionBy("dst_ip").orderBy(F.desc("events"), "x")
    top = (
        per_source.withColumn("place", F.row_number().over(rank)).where("place <= 10")
        .groupBy("dst_ip").agg(F.array_sort(F.collect_list(F.struct("place", "x", "events"))).alias("top"))
        .select("dst_ip", F.transform(
            "top", lambda e: F.struct(e["x"].alias("ip"), e["events"].alias("events"))).alias("top_sources"))
    )
    return broadcast_if_small(hits).join(top, "dst_ip").select(
        from_micros("start").alias("ts"), "dst_ip",
        F.col("n").alias("total_events"), F.col("d").alias("unique_sources"),
        (F.col("n") / seconds).alias("requests_per_second"), seconds.alias("duration_seconds"),
        F.col("s").alias("total_bytes"), "top_sources",
        from_micros("t").alias("last_ts"), F.col("eid").alias("event_id"),
    )


def exfiltration(flows: DataFrame, outbound_bytes: int = 104_857_600, window_s: float = 3600,
                 chunks: int | None = None) -> DataFrame:
    """Sources whose outbound bytes within the window reach the threshold."""
    enough = lambda: F.col("s") >= outbound_bytes
    hits, _ = first_hits(
        flows.where(net.is_outbound_transfer()), ["src_ip"], window_s, enough, enough, enough,
        value=F.col("bytes_sent"), chunks=chunks,
    )
    return hits.select(
        from_micros("start").alias("ts"), "src_ip", F.col("s").alias("total_bytes"),
        F.col("n").alias("transfer_count"), from_micros("t").alias("last_ts"), F.col("eid").alias("event_id"),
    )


def beaconing(flows: DataFrame, min_connections: int = 10, tolerance_percent: float = 15,
              chunks: int | None = None) -> DataFrame:
    """(source, target) pairs with regular gaps over the whole history.

    The mean gap is (last - first) / (n - 1), known without any ordering, so the squared
    deviations of the gaps add up: within each chunk of a pair's history, and over the borders of
    its chunks. No pair has to fit into one task.
    """
    pair = ["src_ip", "dst_ip"]
    points = flows.select(*pair, micros(F.col("ts")).alias("t"), F.col("event_id").alias("eid"))
    pairs = points.groupBy(*pair).agg(
        F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t")
    )
    mean = F.try_divide(F.col("last_t") - F.col("first_t"), (F.col("n") - 1) * MICROS)
    slow = durable(
        pairs.where(F.col("n") >= max(min_connections, 2)).withColumn("mean", mean).where(F.col("mean") > 1), "pairs"
    )
    rows = slow.agg(F.sum("n")).first()[0] or 0
    chosen = points.join(broadcast_if_small(slow.select(*pair, "mean")), pair)
    chunked = chunked_if_large(chosen, rows, pair, ["t", "eid"], chunks)
    part = [*pair, CHUNK] if CHUNK in chunked.columns else pair
    line = Window.partitionBy(*part).orderBy("t")

    def square(gap_us: Column) -> Column:
        return F.pow(gap_us / MICROS - F.col("mean"), 2)

    parts = chunked.withColumn("off", square(F.col("t") - F.lag("t").over(line))).groupBy(*part, "mean").agg(
        F.coalesce(F.sum("off"), F.lit(0.0)).alias("off"), F.min("t").alias("start"), F.max("t").alias("end")
    )
    if part != pair:
        # One row per pair and chunk.
        chain = Window.partitionBy(*pair).orderBy(CHUNK)
        border = F.coalesce(square(F.col("start") - F.lag("end").over(chain)), F.lit(0.0))
        parts = parts.withColumn("off", F.col("off") + border)
    off = parts.groupBy(*pair).agg(F.sum("off").alias("off"))
    stats = broadcast_if_small(slow).join(off, pair).withColumn("std_interval", F.sqrt(F.col("off") / (F.col("n") - 1)))
    return stats.withColumn("cv_percent", F.col("std_interval") / F.col("mean") * 100).where(
        F.col("cv_percent") <= tolerance_percent
    ).select(
        from_micros("first_t").alias("ts"), *pair, F.col("n").alias("connection_count"), F.col("mean").alias("mean_interval"),
        "std_interval", "cv_percent", from_micros("last_t").alias("last_ts"),
    )


def after_hours(flows: DataFrame, start_hour: int = 0, end_hour: int = 5, min_events: int = 20,
                wrap: bool = False) -> DataFrame:
    """Sources with many events in the given hours of the day."""
    night = flows.where(net.in_hours(F.col("ts"), start_hour, end_hour, wrap))
    return night.groupBy("src_ip").agg(
        F.min("ts").alias("ts"), F.count("*").alias("event_count"),
        F.count_distinct("dst_ip").alias("unique_destinations"), F.sum(net.total_bytes()).alias("total_bytes"),
    ).where(F.col("event_count") >= min_events)


def anomaly(flows: DataFrame, sensitivity: str = "medium", z_score_threshold: float = 3.0) -> DataFrame:
    """Sources whose event count lies far above the mean of all sources."""
    threshold = SENSITIVITY.get(sensitivity, z_score_threshold)
    # One row per source, written so that the flows are scanned once.
    counts = durable(flows.groupBy("src_ip").agg(
        F.count("*").alias("event_count"), F.sum(net.total_bytes()).alias("total_bytes"),
        F.min("ts").alias("_first"),
    ), "source-counts")
    overall = counts.agg(F.struct(
        F.avg("event_count").alias("mean"), F.stddev_pop("event_count").alias("std"),
        F.count("*").alias("sources"), F.sum("event_count").alias("events"), F.min("_first").alias("first_ts"),
    ).alias("_o"))
    scored = counts.withColumn("_o", overall.scalar()).where(
        "_o.events >= 10 AND _o.sources >= 3 AND _o.std > 0"
    ).withColumn("z_score", (F.col("event_count") - F.col("_o.mean")) / F.col("_o.std"))
    return scored.where(F.col("z_score") > threshold).select(
        F.col("_o.first_ts").alias("ts"), "src_ip", "event_count", "z_score",
        F.when(F.col("z_score") < 4, "MEDIUM").otherwise("HIGH").alias("severity"),
        F.col("_o.mean").alias("mean_events"), F.col("_o.std").alias("std_events"), "total_bytes",
    )
