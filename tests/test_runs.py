"""Top-k from bounded cells, and tables that go on from run to run."""

import random

import pytest
from pyspark.sql import functions as F

from tests.flowrows import at, flows, row
from tidewatch import runs
from tidewatch.functions.clock import MICROS, micros
from tidewatch.operators import alerts as al
from tidewatch.operators import carried, stats
from tidewatch.operators.contenders import contenders
from tidewatch.sources import ledger


def crowd(spark):
    """40,000 keys of one row, one with a third of all, twenty with 300 to 310 rows and ties, a null key."""
    single = spark.range(40_000).select(F.concat(F.lit("s"), "id").alias("a"), F.lit("x").alias("b"))
    hot = spark.range(25_000).select(F.lit("hot").alias("a"), F.lit("x").alias("b"))
    busy = spark.range(20).select(F.concat(F.lit("b"), F.col("id") % 10).alias("a"), F.concat(F.lit("y"), "id").alias("b"), F.explode(F.expr("sequence(1, 300 + id % 3 * 5)"))).drop("col")
    null = spark.range(306).select(F.lit(None).cast("string").alias("a"), F.lit("x").alias("b"))
    return single.unionByName(hot).unionByName(busy).unionByName(null).repartition(8)


def top(rows, keys, n):
    return [tuple(r) for r in rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(n).collect()]


@pytest.mark.parametrize("cells", [64, 1 << 16])
def test_contenders_rank_as_all_rows(spark, cells):
    rows = crowd(spark).cache()
    for keys, n in ((["a"], 5), (["a", "b"], 5), (["a", "b"], 9), (["b"], 3), (["b"], 1000)):
        few = contenders(rows, keys, n, cells)
        assert few.columns == rows.columns and top(few, keys, n) == top(rows, keys, n), (keys, n)
    assert contenders(rows.where("false"), ["a"], 5).count() == 0


def test_contenders_leave_other_keys_out(spark):
    rows = crowd(spark)
    few = contenders(rows, ["a", "b"], 5)
    assert few.count() < 40_000 and few.select("a", "b").distinct().count() < 1_000
    # Nothing is moved before the filter: its joins are broadcasts.
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_clashing_names_and_statistics(spark):
    fl = flows(spark, [row(i, src_ip=f"10.0.0.{i % 7 % 5}", dst_ip=f"d{i % 3}") for i in range(100)])
    assert stats.top_talkers(contenders(fl, ["src_ip"], 2), 2).collect() == stats.top_talkers(fl, 2).collect()
    other = fl.withColumn("n", F.lit(1)).withColumn("cell", F.lit(2)).withColumn("hash", F.lit(0))
    assert stats.connection_pairs(contenders(other, ["src_ip", "dst_ip"], 4), 4).collect() == stats.connection_pairs(fl, 4).collect()


def test_deduplication_goes_on_from_run_to_run(spark, tmp_path):
    rng = random.Random(5)
    times = sorted(rng.randrange(0, 6000) for _ in range(400))
    hits = flows(spark, [row(t, src_ip=f"s{rng.randrange(4)}", domain="d") for t in times]).select("ts", "domain", "src_ip", "dst_ip", "dst_port", "event_id")
    alerts = al.domain_alerts(hits).cache()
    whole = {r.alert_id for r in al.dedupe(alerts, 300).collect()}
    root, bounds, kept = str(tmp_path / "kept"), [0, 1100, 1200, 4000, 5000, 6001], []
    for run in range(5):
        own = alerts.where((F.col("ts") >= F.lit(at(bounds[run]))) & (F.col("ts") < F.lit(at(bounds[run + 1])))) if run != 3 else alerts.where("false")
        if run == 4:
            own = alerts.where(F.col("ts") >= F.lit(at(4000)))
        kept.append({r.alert_id for r in carried.dedupe_run(own, root, run, 300).collect()})
        if run == 2:  # Once more, as after a failure.
            assert {r.alert_id for r in carried.dedupe_run(own, root, run, 300).collect()} == kept[-1]
    assert kept[3] == set() and set.union(*kept) == whole and sum(map(len, kept)) == len(whole)
    last = spark.read.parquet(runs.part(root, 4))
    newest = alerts.agg(F.max(micros(F.col("ts")))).first()[0]
    assert last.count() <= 4 and all(newest - 300 * MICROS <= r._last <= newest for r in last.collect())


def write_log(folder, name, seconds):
    lines = [f"{at(s)},10.0.0.{s % 9},1.1.1.1,{s},80,tcp" for s in seconds]
    (folder / name).write_text("\n".join(["timestamp,src_ip,dst_ip,src_port,dst_port,protocol", *lines]) + "\n")


def test_each_file_is_read_once(spark, tmp_path):
    folder, root = tmp_path / "logs", str(tmp_path / "flows")
    folder.mkdir()
    with pytest.raises(ValueError):
        ledger.flows(spark, root)
    assert ledger.add_new(spark, str(folder), root, 2024) == 0
    write_log(folder, "a.csv", range(10))
    write_log(folder, "_b.csv", range(10, 15))
    (folder / "notes.md").write_text("no log")
    assert ledger.add_new(spark, str(folder), root, 2024) == 2 and ledger.add_new(spark, str(folder), root, 2024) == 0
    write_log(folder, "c.csv", [])
    assert ledger.add_new(spark, str(folder), root, 2024) == 1
    write_log(folder, "d e.csv", range(86_400 * 3, 86_400 * 3 + 5))
    assert ledger.add_new(spark, str(folder), root, 2024) == 1
    rows = ledger.flows(spark, root).orderBy("event_id").collect()
    assert len(rows) == len({r.event_id for r in rows}) == 20
    assert [r.src_port for r in rows][-5:] == list(range(86_400 * 3, 86_400 * 3 + 5))
    write_log(folder, "a.csv", range(30))
    with pytest.raises(ValueError, match="a.csv"):
        ledger.add_new(spark, str(folder), root, 2024)
    assert ledger.flows(spark, root).count() == 20


def test_a_failed_run_leaves_nothing(spark, tmp_path, monkeypatch):
    folder, root = tmp_path / "logs", str(tmp_path / "flows")
    folder.mkdir()
    write_log(folder, "a.csv", range(10))
    ledger.add_new(spark, str(folder), root, 2024)
    write_log(folder, "b.csv", range(10, 20))
    whole, calls = runs.finish, []

    def fails_at_the_list(df, path, run, *more):
        calls.append(path)
        if path.endswith("/files"):
            raise RuntimeError("lost")
        return whole(df, path, run, *more)

    monkeypatch.setattr(runs, "finish", fails_at_the_list)
    with pytest.raises(RuntimeError):
        ledger.add_new(spark, str(folder), root, 2024)
    assert len(calls) == 2 and ledger.flows(spark, root).count() == 10
    monkeypatch.setattr(runs, "finish", whole)
    assert ledger.add_new(spark, str(folder), root, 2024) == 1
    assert sorted(r.event_id for r in ledger.flows(spark, root).collect()) == list(range(20))
