"""What the physical plans must look like."""

import json
import re
from pathlib import Path

from pyspark.sql import functions as F

from tests.flowrows import flows, row
from tidewatch.durable import broadcast_if_small, durable
from tidewatch.operators import declared, detectors, sliding, stats, threat
from tidewatch.plans.checks import QUERIES, array_parts
from tidewatch.plans.oracles import ORACLES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, tmp_path):
    path = str(tmp_path / "flows")
    flows(spark, [row(i, src_ip=f"s{i}", dst_port=i) for i in range(40)]).write.parquet(path)
    return spark.read.parquet(path)


def test_rankings_are_top_k(spark, tmp_path):
    fl = stored(spark, tmp_path)
    for ranking in (stats.top_talkers, stats.top_destinations, stats.top_ports, stats.connection_pairs):
        assert "TakeOrderedAndProject" in plan(ranking(fl))


def test_feeds_are_broadcast_and_columns_pruned(spark, tmp_path):
    fl = stored(spark, tmp_path)
    feed = spark.createDataFrame([("malicious_domain", "x")], "kind STRING, indicator STRING")
    text = plan(threat.domain_contacts(fl, feed))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert "duration" not in re.search(r"ReadSchema: (.*)", text).group(1)
    assert "Not(EqualTo(domain,))" in text


def test_filters_reach_the_scan(spark, tmp_path):
    fl = stored(spark, tmp_path)
    text = plan(detectors.after_hours(fl))
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,src_ip:string,dst_ip:string,bytes_sent:bigint,bytes_received:bigint>", text)
    text = plan(stats.top_ports(fl))
    assert "GreaterThan(dst_port,0)" in text and "ReadSchema: struct<dst_port:int>" in text


def test_no_python_workers_and_no_cross_joins(spark, tmp_path):
    fl = stored(spark, tmp_path)
    for df in (detectors.anomaly(fl), detectors.beaconing(fl), detectors.port_scan(fl), detectors.ddos(fl, 1, 1),
               stats.traffic_stats(fl), stats.geo_summary(fl)):
        text = plan(df)
        assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)


def test_distinct_windows_move_bits_only(spark, tmp_path):
    fl = stored(spark, tmp_path)
    points = sliding.prepare(fl, ["src_ip"], 60_000_000, distinct="dst_port")
    text = plan(sliding.cell_totals(points, ["src_ip"], True))
    # Partial sums of bits by key, cell and 64 numbers; the values stay where they are.
    first = text[text.rindex("Exchange"):]
    assert "partial_bit_or" in first and "keys=[src_ip" in first and text.count("FileScan") == 1
    points = sliding.prepare(fl, ["dst_ip"], 60_000_000, distinct="src_ip")
    text = plan(sliding.cell_totals(points, ["dst_ip"], True))
    assert text.count("Exchange") == 1 and "partial_bit_or" in text


def test_rows_of_other_cells_go_before_they_are_moved(spark, tmp_path):
    path = str(tmp_path / "many")
    flows(spark, [row(i, src_ip=f"s{i}", dst_port=i) for i in range(400)]).write.parquet(path)
    points = sliding.prepare(spark.read.parquet(path), ["src_ip"], 60_000_000, distinct="dst_port")
    cells = points.select("src_ip", "cell").where("src_ip < 's2'").distinct().withColumn("fire", F.lit(True))
    needed = durable(cells, "cells")
    got = sliding.rows_of_cells(points, needed, ["src_ip", "cell"], most=0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(sliding.rows_of_cells(points, needed, ["src_ip", "cell"], most=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The bitmap's join is below the exchange of the rows.
    side = text[text.index("SortMergeJoin"):]
    assert side.index("Exchange hashpartitioning(src_ip") < side.index("BroadcastHashJoin")
    want = points.join(needed, ["src_ip", "cell"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    assert got.count() == needed.count()


def test_rules_share_one_scan(spark, tmp_path, monkeypatch):
    fl = stored(spark, tmp_path)
    written = []
    monkeypatch.setattr(declared, "durable", lambda df, name: written.append(plan(df)) or durable(df, name))
    single = [{"id": f"R{i}", "name": "n", "conditions": {"dst_port": i}} for i in range(40)]
    counted = [{"id": f"C{i}", "name": "n", "conditions": {"dst_port": i, "count_min": 1, "time_window_seconds": 60}} for i in range(5)]
    assert declared.threshold_rules(fl, single + counted).count() == 45
    assert len(written) == 1 and written[0].count("FileScan") == 1


def test_array_files_are_written_without_gathering(spark, tmp_path):
    # The last of four partitions is empty, one has more records than an Arrow batch.
    rows = spark.range(0, 12_000, 1, 4).where("id < 9000 AND (id < 3000 OR id % 2 = 0)").selectExpr("id", "IF(id % 3 = 0, NULL, 'a\"}]') AS name")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        parts = array_parts(rows)
        assert not re.search("Exchange|Aggregate|Sort|collect", plan(parts))
        parts.write.text(str(tmp_path / "arrays"), lineSep=" ")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    texts = [file.read_text() for file in sorted(Path(tmp_path / "arrays").glob("part-*"))]
    arrays = [json.loads(text) for text in texts if text]
    assert [len(array) for array in arrays] == [3000, 1500, 1500] and not any("\n" in text for text in texts)
    want = [{"id": r.id} | ({"name": r.name} if r.name else {}) for r in rows.collect()]
    assert [record for array in arrays for record in array] == want


def test_no_side_is_broadcast_by_the_size_of_its_files(spark):
    # Files of a few kilobytes that are 16 MB in memory.
    rows = durable(spark.range(100_000).selectExpr("'s' AS src_ip", "0L AS cell", "id AS t", "id AS eid", "repeat('x', 100) AS x"), "thin")
    hits = durable(spark.range(1).selectExpr("'s' AS src_ip", "5L AS t", "9L AS eid"), "hits")
    text = plan(sliding.rows_in_window(hits, rows, ["src_ip"], 60))
    assert "BuildRight" in text and "BuildLeft" not in text
    assert "Broadcast" not in plan(hits.join(broadcast_if_small(rows), "src_ip"))
    assert "BroadcastHashJoin" in plan(rows.join(broadcast_if_small(hits.select("src_ip")), "src_ip"))
