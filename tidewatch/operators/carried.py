"""Deduplication that goes on from run to run: the last kept time of each key is a table beside the runs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import runs
from tidewatch.durable import broadcast_if_small, durable
from tidewatch.functions.clock import micros, window_micros
from tidewatch.operators import alerts as al


def dedupe_run(alerts: DataFrame, root: str, run: int, window_s: float = 300) -> DataFrame:
    """What ``alerts.dedupe`` over all runs so far keeps of the alerts of this one.

    Runs have growing numbers and follow each other in time (rows of one moment may be parted, ties
    then go by run); an alert older than what an earlier run kept for its key counts as within the
    window. A repeated run starts from the run before it and keeps the same. Times that no later
    alert can be within the window of are let go, so the table holds the keys of one window only.
    """
    spark, window_us = alerts.sparkSession, window_micros(window_s)
    key, t = F.concat_ws(":", "rule_id", "src_ip", "dst_ip"), micros(F.col("ts"))
    before = [number for number in runs.finished(spark, root) if number < run]
    fresh, last = alerts, None
    if before:
        last = spark.read.schema("_key STRING, _last BIGINT").parquet(runs.part(root, before[-1]))
        joined = alerts.withColumn("_key", key).join(broadcast_if_small(last), "_key", "left")
        # Written, as the deduplication reads its input more than once.
        fresh = durable(joined.where(F.col("_last").isNull() | (t > F.col("_last") + window_us)).select(alerts.columns), "alerts-past-window")
    kept = durable(al.dedupe(fresh, window_s), "alerts-kept")
    times = kept.select(key.alias("_key"), t.alias("_last"))
    times = (times.unionByName(last) if last else times).groupBy("_key").agg(F.max("_last").alias("_last"))
    newest = alerts.agg(F.max(t)).first()[0]
    if newest is not None:
        times = times.where(F.col("_last") >= newest - window_us)
    runs.finish(times, root, run)
    return kept
