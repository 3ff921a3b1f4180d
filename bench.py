"""Times every query at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs once to warm up and is then timed; the value is the sum of the times.
The flows table of the test set is written before (as an ingest job would), and so is
the alert table that the alert reports read; making that table is timed as "final_alerts".
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from tidewatch.plans.checks import QUERIES, SETTINGS, alert_table, feed_table  # noqa: E402
from tidewatch.plans.pipeline import final_alerts  # noqa: E402
from tidewatch.plans.testflows import flows_of  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        # Many different plans run in one session; the default of 100 makes Spark compile them again and again.
        .config("spark.sql.codegen.cache.maxEntries", "5000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    runs = {
        name: lambda query=query: query(spark, folder).write.format("noop").mode("overwrite").save()
        for name, query in QUERIES.items()
    }
    runs["final_alerts"] = lambda: final_alerts(flows_of(spark, folder), feed_table(spark), SETTINGS).count()
    chosen = sys.argv[1:] or list(runs)
    seconds = {}
    flows_of(spark, folder)
    alert_table(spark, folder)
    for name in chosen:
        for _ in range(2):
            start = time.perf_counter()
            runs[name]()
            seconds[name] = round(time.perf_counter() - start, 3)
    rows = flows_of(spark, folder).count()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"), "flows": rows,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
