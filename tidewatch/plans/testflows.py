"""A view that turns the ``events`` test table into flows.

The text is plain SQL that Spark and DuckDB read alike, so that both sides of a
comparison start from the same rows.
"""

from pyspark.sql import DataFrame, SparkSession

from tidewatch.durable import fresh_path
from tidewatch.schema import FLOWS_DDL

FLOWS_SQL = """
SELECT event_id, ts,
 concat('10.0.', CAST(CAST(floor(user_id / 250) AS INT) AS STRING), '.', CAST(CAST(user_id % 250 + 1 AS INT) AS STRING)) AS src_ip,
 CASE WHEN event_type IN ('click','view') THEN concat('192.168.1.', CAST(k % 5 + 1 AS STRING))
      WHEN event_type = 'error' THEN concat('192.168.2.', CAST(k % 2 + 1 AS STRING))
      ELSE concat('203.0.113.', CAST(k % 20 + 1 AS STRING)) END AS dst_ip,
 40000 + k AS src_port,
 CASE event_type WHEN 'error' THEN CASE k % 4 WHEN 0 THEN 22 WHEN 1 THEN 3389 WHEN 2 THEN 443 ELSE 8080 END
      WHEN 'click' THEN 1000 + k WHEN 'view' THEN CASE WHEN k % 3 = 0 THEN 53 ELSE 443 END
      WHEN 'signup' THEN CASE WHEN k % 3 = 0 THEN 8081 ELSE 80 END ELSE k % 2 * 8443 END AS dst_port,
 CASE WHEN event_type = 'view' AND k % 3 = 0 THEN 'UDP' WHEN event_type = 'click' AND k % 4 = 1 THEN 'UDP'
      WHEN event_type = 'purchase' AND k % 10 = 0 THEN 'ICMP' WHEN event_type = 'signup' THEN 'HTTP' ELSE 'TCP' END AS protocol,
 CAST(floor(value * 1024) AS BIGINT) AS bytes_sent, CAST(floor(value * 10) AS BIGINT) AS bytes_received,
 CAST(1 + k % 50 AS BIGINT) AS packets, value / 10 AS duration,
 CASE WHEN event_type = 'click' AND k % 4 = 1 THEN '' WHEN event_type = 'click' AND k % 7 = 0 THEN 'SYN,ACK'
      WHEN event_type IN ('error','click') THEN 'SYN' WHEN event_type = 'purchase' THEN 'SYN,ACK' ELSE 'ACK' END AS flags,
 CASE event_type WHEN 'error' THEN 'failed'
      WHEN 'signup' THEN CASE k % 4 WHEN 0 THEN 'deny' WHEN 1 THEN 'denied' WHEN 2 THEN 'drop' ELSE 'blocked' END ELSE 'allow' END AS action,
 CASE WHEN event_type = 'error' THEN CASE k % 3 WHEN 0 THEN 401 WHEN 1 THEN 403 ELSE 500 END END AS status_code,
 CASE event_type WHEN 'purchase' THEN 'outbound' WHEN 'view' THEN 'inbound' WHEN 'click' THEN 'internal' ELSE 'unknown' END AS direction,
 CASE WHEN event_type = 'signup' THEN concat('Host', CAST(k % 10 AS STRING), '.example.com')
      WHEN event_type = 'view' AND k % 3 = 0 THEN concat(repeat('a', k % 60), '.example.net') ELSE '' END AS domain
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) x
"""


_tables: dict[tuple[str, str], str] = {}


def flows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flows table of a test set, written once per session as the ingest job would do.

    A single small input file is read by one task, so its rows are spread over all cores.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tables:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        flows = spark.sql(FLOWS_SQL.replace("FROM events)", "FROM {events})"), events=events)
        cores = spark.sparkContext.defaultParallelism
        if len(events.inputFiles()) < cores:
            flows = flows.repartition(cores)
        path = fresh_path(spark, "test-flows")
        flows.write.parquet(path)
        _tables[key] = path
    return spark.read.schema(FLOWS_DDL).parquet(_tables[key])
