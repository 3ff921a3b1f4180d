"""Directory watching with several batches and a restart."""

import os
import random

from pyspark.sql import functions as F

from tidewatch.operators import detectors, threat
from tidewatch.sources import ingest
from tidewatch.streaming import detect, watch

YEAR = 2024


def test_syslog_totals_over_batches(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()

    def line(minute, proto):
        return f"Feb  4 10:{minute:02d}:01 fw k: src=1.1.1.1 dst=2.2.2.2 proto={proto} bytes=10\n"

    (folder / "a.log").write_text(line(1, "tcp") + line(2, "tcp") + "# note\ngarbage\n")
    (folder / "b.log").write_text(line(3, "tcp") + line(4, "udp"))
    output, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        flows = watch.watch_flows(spark, str(folder), "syslog", YEAR, max_files=1)
        watch.run_totals(flows, output, checkpoint=state)
        return {r.protocol: (r.events, r.bytes) for r in watch.latest_totals(spark, output).collect()}

    assert run() == {"TCP": (3, 30), "UDP": (1, 10)}
    (folder / "c.log").write_text(line(5, "udp"))
    assert run() == {"TCP": (3, 30), "UDP": (2, 20)}


def test_json_matches(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.json").write_text('{"time": "2024-02-04", "domain": "Evil.com"}\n{bad\n{"time": "2024-02-04"}\n')
    feed = spark.createDataFrame([("malicious_domain", "evil.com")], "kind STRING, indicator STRING")
    flows = watch.watch_flows(spark, str(folder), "json", YEAR).withColumn("event_id", F.lit(None).cast("bigint"))
    watch.run_available(threat.domain_contacts(flows, feed), str(tmp_path / "out"))
    assert [r.domain for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["Evil.com"]


def test_rows_of_any_age_count_in_any_zone(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for name, hour in (("a", 20), ("b", 10), ("c", 5)):
        (folder / f"{name}.json").write_text("".join(f'{{"time": "2024-02-04 {hour:02d}:15:{i:02d}"}}\n' for i in range(10)))
    (folder / "other.txt").write_text('{"time": "2024-02-04 01:00:00"}\n')
    zone = spark.conf.get("spark.sql.session.timeZone")
    for number, (own, width) in enumerate((("Asia/Kolkata", 3600), ("America/New_York", 86_400))):
        spark.conf.set("spark.sql.session.timeZone", own)
        try:
            output = str(tmp_path / f"out{number}")
            watch.run_totals(watch.watch_flows(spark, str(folder), "json", YEAR, max_files=1), output, width)
            got = {str(r.window_start): r.events for r in watch.latest_totals(spark, output).collect()}
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)
        hours = {f"2024-02-04 {h:02d}:00:00": 10 for h in (5, 10, 20)}
        assert got == (hours if width == 3600 else {"2024-02-04 00:00:00": 30})


def test_csv_stream_keeps_line_breaks_and_rejected_records(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text('Time,src,dst,proto,in_bytes,domain\n2024-02-04 10:00:00,1.1.1.1,2.2.2.2,tcp,5,"a.b\nc"\n2024-02-04 10:30:00,1.1.1.1,2.2.2.2,tcp,many,x\n2024-02-04 11:00:00,1.1.1.3,2.2.2.2,udp,5,y\n')
    header = ["Time", "src", "dst", "proto", "in_bytes", "domain"]
    records = watch.watch_records(spark, str(folder), "csv", YEAR, header=header)
    watch.run_available(records, str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.domain for r in ingest.accepted(written).collect()) == ["a.b\nc", "y"]
    assert ingest.rejected(written).count() == 1
    watch.run_available(watch.watch_flows(spark, str(folder), "csv", YEAR, header=header), str(tmp_path / "flows"), checkpoint=str(tmp_path / "cp2"))
    assert sorted(r.domain for r in spark.read.parquet(str(tmp_path / "flows")).collect()) == ["a.b\nc", "y"]


def test_csv_stream(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.csv").write_text("Time,src,dst,proto,in_bytes\n2024-02-04 10:00:00,1.1.1.1,2.2.2.2,tcp,5\nsoon,1.1.1.1,2.2.2.2,tcp,5\n")
    (folder / "b.csv").write_text("Time,src,dst,proto,in_bytes\n2024-02-04T11:00:00,1.1.1.3,2.2.2.2,udp,\t7 \n")
    (folder / "c.log").write_text("Time,src\n")
    flows = watch.watch_flows(spark, str(folder), "csv", YEAR, max_files=1, header=["Time", "src", "dst", "proto", "in_bytes"])
    watch.run_available(flows, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.src_ip, r.protocol, r.bytes_received) for r in got) == [("1.1.1.1", "TCP", 5), ("1.1.1.3", "UDP", 7)]


def login(i, second, src="1.1.1.1", port=22, action="failed"):
    return f'{{"time": "2024-02-04 {second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}.{i % 1000:03d}", "src": "{src}", "dst": "2.2.2.2", "dst_port": {port}, "proto": "tcp", "action": "{action}"}}\n'


def test_stream_and_batch_find_the_same_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [login(i, rng.randrange(20_000), f"s{rng.randrange(12)}", rng.choice([22, 22, 3389, 80]), rng.choice(["failed", "failed", "allow"])) for i in range(900)]
    rows += [login(i, 700, "tie") for i in range(3)] + [login(0, 1000 + 100 * i, "edge") for i in range(3)]
    rng.shuffle(rows)
    folder, output, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        stream = detect.brute_force(watch.watch_flows(spark, str(folder), "json", YEAR, max_files=1), 3, 200, delay_s=40_000)
        watch.run_available(stream, output, checkpoint=state)

    for k in range(3):
        (folder / f"f{k}.json").write_text("".join(rows[k::3]))
        if k != 1:
            run()  # the second file comes with a restart from the checkpoint
    assert spark.read.parquet(output).count() == 0
    (folder / "z.json").write_text('{"time": "2024-03-01"}\n')
    run()
    got = spark.read.parquet(output).drop("batch")
    batch = ingest.accepted(ingest.read_files(spark, [str(folder)], YEAR, "json")).withColumn("event_id", F.monotonically_increasing_id())
    want = detectors.brute_force(batch, 3, 200).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 5
    assert {"tie", "edge"} <= {r.src_ip for r in got.collect()}


def test_few_shards_follow_many_keys(spark, tmp_path):
    # Keys of one shard fire in different batches, once; others only wait, or keep their last row over a restart.
    folder, output, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        stream = detect.brute_force(watch.watch_flows(spark, str(folder), "json", YEAR, max_files=1), 3, 200, delay_s=60, shards=2)
        return watch.run_available(stream, output, checkpoint=state)

    many = [f"k{i} ü" for i in range(300)]
    files = [
        "".join(login(0, 100 + s, src) for s in (0, 10) for src in many) + "".join(login(0, 100 + s, "early") for s in (1, 2, 3)),
        "".join(login(0, 290, src) for src in many[::3]) + login(0, 301, many[1]) + login(0, 400, "early") + login(0, 400),
        login(0, 1000, "end"),
    ]
    for i, text in enumerate(files):
        (folder / f"f{i}.json").write_text(text)
        os.utime(folder / f"f{i}.json", (i * 100, i * 100))
        query = run()
    # Two shards' states, whatever the number of keys.
    assert 0 < query.lastProgress.stateOperators[0].numRowsTotal <= 2
    got = spark.read.parquet(output).collect()
    assert sorted(r.src_ip for r in got) == sorted([*many[::3], "early"])
    assert {(str(r.ts)[11:], str(r.last_ts)[11:], r.attempts, r.dst_port) for r in got if r.src_ip != "early"} == {("00:01:40", "00:04:50", 3, 22)}


def test_old_state_goes_and_late_rows_are_set_aside(spark, tmp_path):
    folder, output = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    # Two attempts, an hour later another key, then a third attempt of the first key that is too late to count.
    for name, text in (("a", login(0, 100) + login(0, 110)), ("b", login(0, 4000, "other")), ("c", login(0, 120) + login(0, 4010, "other")), ("d", login(0, 9000, "last"))):
        (folder / f"{name}.json").write_text(text)
        os.utime(folder / f"{name}.json", (ord(name) * 100, ord(name) * 100))
    stream = watch.watch_flows(spark, str(folder), "json", YEAR, max_files=1)
    query = watch.run_available(detect.brute_force(stream, 3, 200, delay_s=60), output)
    assert spark.read.parquet(output).count() == 0
    # Only the last key's row waits; keys whose windows have passed are gone.
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 1
    aside = str(tmp_path / "aside")
    writer = stream.writeStream.foreachBatch(detect.late_rows(aside, 60)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    writer.awaitTermination()
    assert [str(r.ts) for r in spark.read.parquet(f"{aside}/late").collect()] == ["2024-02-04 00:02:00"]
