"""Boundary fixtures of the ingest jobs; the session zone is not UTC on purpose."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from tidewatch.sources import feeds, files, ingest, layout
from tidewatch.sources.csv_logs import read_csv
from tidewatch.sources.json_logs import read_json
from tidewatch.sources.syslog import read_syslog

YEAR = 2024


def write(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def statuses(parsed):
    return [row.status for row in parsed.orderBy("source_file", "source_block", "source_row").collect()]


MOMENT = dt.datetime(2024, 2, 4, 10, 15, 1)
STAMPS = {
    "2024-02-04 10:15:01": MOMENT, "2024-02-04T10:15:01": MOMENT, "2024-02-04T10:15:01Z": MOMENT,
    "2024-02-04T10:15:01.5": MOMENT.replace(microsecond=500000),
    "2024-02-04T10:15:01.000001Z": MOMENT.replace(microsecond=1),
    "2024/02/04 10:15:01": MOMENT, "Feb  4 10:15:01": MOMENT, "feb 04 10:15:01": MOMENT,
    "04/Feb/2024:10:15:01": MOMENT, "2024-02-04 10:15:01.25": MOMENT.replace(microsecond=250000),
    "2024-2-4 10:15:1": MOMENT, "2024-02-04": dt.datetime(2024, 2, 4), "2024-02-04 10:15": MOMENT.replace(second=0),
    "2024-02-04T10": MOMENT.replace(minute=0, second=0), "2024-02-04T10:15:01+00:00": MOMENT,
    "2024-02-04T12:15:01+02:00": MOMENT, "2024-02-04T04:45:01-05:30": MOMENT,
    "Feb 29 00:00:00": dt.datetime(2024, 2, 29), "2024-03-10 02:30:00": dt.datetime(2024, 3, 10, 2, 30),
    "anF 4 10:15:01": None, "2024-13-01 00:00:00": None, "2024-02-30": None, "yesterday": None, "": None,
    "2024-02-04 10:15:60": None,
}


def test_timestamps(spark):
    rows = spark.createDataFrame([(s,) for s in STAMPS], "s STRING")
    got = {r.s: r.ts for r in rows.select("s", layout.parse_timestamp(layout.plain_stamp(F.col("s")), YEAR).alias("ts")).collect()}
    assert got == STAMPS


def test_csv_records(spark, tmp_path):
    path = write(tmp_path, "a.csv", "﻿ Time ,SRC,dst,sport,dst_port,Proto,bytes_sent,host\n"
                 "2024-02-04 10:15:01,1.1.1.1,2.2.2.2,12,80,tcp,7,Evil.com\n"
                 "2024-02-04 10:15:01,1.1.1.1\n"  # short
                 "2024-02-04 10:15:01,1.1.1.1,2.2.2.2,12,12.5,tcp,7,x\n"  # bad number
                 ",1.1.1.1,2.2.2.2,12,80,tcp,7,x\n"  # no time stamp
                 "2024-02-04 10:15:01,1.1.1.1,2.2.2.2,12,80,tcp,7,x,extra,more\n"  # long
                 "2024-02-04 10:15:01,,, , 443 ,,,\n"  # blanks
                 '2024-02-04 10:15:01,"1.1.1.1","2,2",12,80,tcp,7,"say ""hi"""\n'
                 "soon,1.1.1.1,2.2.2.2,12,80,tcp,7,x\n")
    parsed = read_csv(spark, [path], YEAR)
    assert statuses(parsed) == [
        "accepted", "rejected", "rejected", "skipped", "accepted", "accepted", "accepted", "skipped"]
    rows = ingest.accepted(parsed).orderBy("source_row").collect()
    first = rows[0]
    assert (first.ts, first.src_ip, first.dst_ip, first.src_port, first.dst_port) == (
        MOMENT, "1.1.1.1", "2.2.2.2", 12, 80)
    assert (first.protocol, first.bytes_sent, first.bytes_received, first.packets, first.domain) == (
        "TCP", 7, 0, 1, "Evil.com")
    blank = rows[2]
    assert (blank.src_ip, blank.dst_port, blank.protocol, blank.direction, blank.action) == (
        "0.0.0.0", 443, "UNKNOWN", "unknown", "")
    assert (rows[3].dst_ip, rows[3].domain) == ("2,2", 'say "hi"')
    assert ingest.quality(parsed).collect()[0].asDict() == {
        "total_parsed": 4, "parse_errors": 2, "success_rate": "66.7%"}
    assert ingest.rejected(parsed).count() == 2


def test_csv_short_row_is_fine_if_the_missing_column_is_not_looked_up(spark, tmp_path):
    # dest_ip is an alias behind dst_ip, which has text; the note is no field at all.
    path = write(tmp_path, "a.csv", "time,dst_ip,dest_ip,note\n2024-02-04,9.9.9.9\n2024-02-04,\n")
    assert statuses(read_csv(spark, [path], YEAR)) == ["accepted", "rejected"]


def test_csv_header_groups(spark, tmp_path):
    paths = [
        write(tmp_path, "a.csv", "timestamp,src_ip,dst_port\n2024-02-04 10:15:01,1.1.1.1,1\n"),
        write(tmp_path, "b.csv", "dport,source,event_time\n2,3.3.3.3,2024-02-04 10:15:01\n"),
        write(tmp_path, "c d.csv", "dport,source,event_time\n3,4.4.4.4,2024-02-04 10:15:01\n"),
    ]
    got = {(r.src_ip, r.dst_port) for r in read_csv(spark, paths, YEAR).collect()}
    assert got == {("1.1.1.1", 1), ("3.3.3.3", 2), ("4.4.4.4", 3)}
    broken = write(tmp_path, "e.csv", 'timestamp,domain\n2024-02-04,"a\nb"\n2024-02-05,c\n')
    assert [r.domain for r in read_csv(spark, [broken], YEAR, multiline=True).orderBy("ts").collect()] == ["a\nb", "c"]
    known = read_csv(spark, paths[:1], YEAR, header=["timestamp", "src_ip", "dst_port"])
    assert known.count() == 1


def test_json_lines(spark, tmp_path):
    path = write(tmp_path, "a.json", "\n".join([
        '{"Timestamp": "2024-02-04T10:15:01Z", "source_ip": "1.1.1.1", "DST": "2.2.2.2", "dst_port": 80, "proto": "udp",'
        ' "out_bytes": "12", "duration": 1.5, "action": "DENY", "http_status": 404, "src_port": 12.9}',
        "{bad",
        '{"timestamp": "2024-02-04", "dst_port": null}',
        '{"timestamp": "2024-02-04"}',
        '{"time": "", "datetime": "2024-02-04", "src_ip": null, "packets": "x"}',
        '{"note": "no time"}',
        "[1]", "3", "",
        '{"timestamp": "2024-02-04", "src_ip": "", "source_ip": "5.5.5.5"}',
        '{"timestamp": "2024-02-04", "bytes_sent": "12.5"}',
        '{"timestamp": "2024-02-04", "A": 1, "a": 2, "src_ip": null}',
        '{"timestamp": "2024-02-04"} x', '{"timestamp": "2024-02-04"}{"a": 1}', "{'timestamp': '2024-02-04'}",
        '{"TIMESTAMP": "2024-02-04", "SRC_IP": "7.7.7.7", "src_ip": "8.8.8.8", "note": "}{"}', '{"BAD',
    ]))
    parsed = read_json(spark, [path], YEAR)
    assert statuses(parsed) == [
        "accepted", "rejected", "rejected", "accepted", "rejected", "skipped", "rejected", "rejected",
        "accepted", "rejected", "accepted", "rejected", "rejected", "rejected", "accepted", "rejected"]
    first, plain, empty_ip, null_ip, twice = ingest.accepted(parsed).orderBy("source_row").collect()
    assert (first.ts, first.src_ip, first.dst_ip, first.src_port, first.dst_port) == (
        MOMENT, "1.1.1.1", "2.2.2.2", 12, 80)
    assert (first.protocol, first.bytes_sent, first.duration, first.action, first.status_code) == (
        "UDP", 12, 1.5, "deny", 404)
    assert (plain.dst_port, plain.packets, plain.src_ip) == (0, 1, "0.0.0.0")
    assert empty_ip.src_ip == ""  # the second name counts only if the first is absent
    assert null_ip.src_ip == "0.0.0.0"
    assert twice.src_ip == "8.8.8.8"


def test_json_array_files(spark, tmp_path):
    good = write(tmp_path, "a.json", '\n [ {"timestamp": "2024-02-04", "src": "1.1.1.1"},\n {"src": "2.2.2.2"}, 7,'
                 ' {"timestamp": "2024-02-05"}]')
    lost = write(tmp_path, "b.json", '[{"timestamp": "2024-02-04"}, ')
    lines = write(tmp_path, "c.json", '{"timestamp": "2024-02-04"}')
    parsed = read_json(spark, [good, lost, lines], YEAR)
    assert statuses(parsed) == ["accepted", "skipped", "rejected", "accepted", "rejected", "accepted"]


def test_syslog(spark, tmp_path):
    path = write(tmp_path, "a.log", "\n".join([
        "Feb  4 10:15:01 fw01 kernel[12]: src=1.2.3.4:5555 dst=10.0.0.1:22 proto=tcp action=DENY bytes=120 packets=3",
        "Feb  4 10:15:01 host sshd[9]: Failed from 1.2.3.4 to 5.6.7.8",
        "# comment", "", "garbage", "Feb  4 10:15:01 host app: only 1.2.3.4",
        "SRC=1.1.1.1 DST=2.2.2.2 PROTO=udp", "Foo 99 10:15:01 fw k: src=1.1.1.1 dst=2.2.2.2 proto=udp",
        "Feb  4 10:15:01 fw k: src=1.1.1.1 dst=2.2.2.2 proto=icmp",
    ]))
    parsed = read_syslog(spark, [path], YEAR)
    assert statuses(parsed) == ["accepted", "accepted", "rejected", "rejected", "accepted"]
    fw, ssh, bare = ingest.accepted(parsed).orderBy("source_row").collect()
    assert (fw.ts, fw.src_ip, fw.src_port, fw.dst_ip, fw.dst_port, fw.protocol) == (
        MOMENT, "1.2.3.4", 5555, "10.0.0.1", 22, "TCP")
    assert (fw.bytes_sent, fw.packets, fw.action, fw.metadata) == (120, 3, "deny", {})
    assert (ssh.src_ip, ssh.dst_ip, ssh.dst_port, ssh.protocol, ssh.metadata) == (
        "1.2.3.4", "5.6.7.8", 0, "UNKNOWN", {"program": "sshd"})
    assert (bare.src_port, bare.packets, bare.protocol) == (0, 1, "ICMP")


@pytest.fixture
def mixed(tmp_path):
    write(tmp_path, "b.csv", "timestamp,src_ip\n2024-02-04 10:15:01,1.1.1.2\n2024-02-04 10:15:01,1.1.1.3\n")
    write(tmp_path, "a.JSON", '{"timestamp": "2024-02-04 10:15:01", "src_ip": "1.1.1.1"}')
    write(tmp_path, "c.txt", "Feb  4 10:15:01 fw k: src=1.1.1.4 dst=2.2.2.2 proto=icmp")
    write(tmp_path, "d.dat", "time,src\n2024-02-04 10:15:01,1.1.1.5\n")
    (tmp_path / "deeper").mkdir()
    write(tmp_path / "deeper", "e.csv", "timestamp,src_ip\n2024-02-04 10:15:01,9.9.9.9\n")
    return tmp_path


def test_directory_and_numbering(spark, mixed):
    parsed = ingest.read_directory(spark, str(mixed), YEAR)
    rows = ingest.to_flows(parsed).orderBy("event_id").collect()
    assert [r.src_ip for r in rows] == ["1.1.1.1", "1.1.1.2", "1.1.1.3", "1.1.1.4"]
    assert len({r.event_id for r in rows}) == 4


def test_format_detection(spark, mixed):
    paths = [str(mixed / n) for n in ("b.csv", "c.txt", "d.dat")]
    for format in (None, "auto"):
        got = {r.src_ip for r in ingest.accepted(ingest.read_files(spark, paths, YEAR, format)).collect()}
        assert got == {"1.1.1.2", "1.1.1.3", "1.1.1.4", "1.1.1.5"}


def test_formats_by_first_line(spark, tmp_path):
    wanted = {}
    for i, (line, kind) in enumerate([("{", "json"), (" [", "json_array"), ("a,b", "csv"), ("<a,b", "syslog"), ("x", "syslog"), ("\ufeff{", "json")]):
        (tmp_path / f"f{i}").write_text(f"\n\t\n{line}\n[\n" if i else line)
        wanted[f"f{i}"] = kind
    (tmp_path / "blank").write_text(" \n")
    got = files.formats(spark, [str(tmp_path)])
    assert {path.rsplit("/", 1)[-1]: kind for path, kind in got.items()} == wanted


def test_line_order_across_splits(spark, tmp_path):
    lines = "".join(f"2024-02-04 10:15:01,{i}\n" for i in range(2000))
    path = write(tmp_path, "big.csv", "timestamp,dst_port\n" + lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        flows = ingest.to_flows(read_csv(spark, [path], YEAR))
        assert [r.dst_port for r in flows.orderBy("event_id").collect()] == list(range(2000))
        assert flows.select("event_id").distinct().count() == 2000
        assert flows.rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_feeds(spark, tmp_path):
    path = write(tmp_path, "f.txt", " # x\n#y\n Evil.com \n\nevil.com\n")
    got = {(r.kind, r.indicator) for r in feeds.read_feeds(spark, {"malicious_domain": path}).collect()}
    assert got == {("malicious_domain", "# x"), ("malicious_domain", "evil.com")}
    assert feeds.read_feeds(spark, {}).count() == 0


def test_odd_names_and_white_space(spark, tmp_path):
    line = "\tFeb  4 10:00:0{} fw k: src=1.1.1.{} dst=2.2.2.2 proto=tcp \n\t# note\n \t\n"
    for i, name in enumerate(("_x.log", ".y.log", "fw[1].log", "a{b}.log", "q?.log", "plain.log")):
        (tmp_path / name).write_text(line.format(i, i))
    (tmp_path / ".x.csv").write_text("time,src,bytes_sent\n\t2024-02-04 10:15:01\u00a0,\t1.1.1.9 ,\t5\n")
    (tmp_path / "lines.json").write_text('\t\n\t{"time": "\\t2024-02-04 10:00:00", "src": "1.1.1.10"}\t\n')
    parsed = ingest.read_directory(spark, str(tmp_path), YEAR)
    assert sorted(r.src_ip for r in ingest.accepted(parsed).collect()) == sorted(f"1.1.1.{i}" for i in (*range(6), 9, 10))
    assert ingest.quality(parsed).first().parse_errors == 0
    # Rows tell the files' own names, also of those that were copied, and ids follow them.
    shown = {r.src_ip: r.source_file.rsplit("/", 1)[-1] for r in parsed.where("status = 'accepted'").collect()}
    assert (shown["1.1.1.0"], shown["1.1.1.1"], shown["1.1.1.9"], shown["1.1.1.5"]) == ("_x.log", ".y.log", ".x.csv", "plain.log")
    assert parsed.where("source_file LIKE '%hidden%'").count() == 0
    ids = ingest.to_flows(parsed).orderBy("event_id").collect()
    assert [r.src_ip for r in ids] == [r.src_ip for r in sorted(parsed.where("status = 'accepted'").collect(), key=lambda r: r.source_file)]


def test_heads_are_read_whatever_the_size(spark, tmp_path, monkeypatch):
    read = []
    monkeypatch.setattr(files, "_head", lambda spark, file, whole=files._head: read.append(file) or whole(spark, file))
    for i, text in enumerate(("time,src\n" + "2024-02-04 10:15:01,1.1.1.1\n" * 200_000, "\r\n \n" * 40_000 + "{}", "\ufeff\n[" + "1," * 100_000, "", "\n" * 70_000)):
        (tmp_path / f"f{i}").write_text(text, newline="")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    got = {name.rsplit("/", 1)[-1]: kind for name, kind in files.formats(spark, [str(tmp_path)]).items()}
    assert got == {"f0": "csv", "f1": "json", "f2": "json_array"} and len(read) == 5
    # Not one Spark job, so no scan of the files.
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert list(files.headers(spark, [str(tmp_path / "f0")]).values()) == ["time,src"]
    with pytest.raises(ValueError, match="header"):
        files.headers(spark, [str(tmp_path / "f2")])
    import gzip

    with gzip.open(tmp_path / "g.csv.gz", "wt") as out:
        out.write("time,src\n2024-02-04 10:15:01,1.1.1.1\n")
    assert ingest.read_files(spark, [str(tmp_path / "g.csv.gz")], YEAR).where("status = 'accepted'").count() == 1


def test_line_breaks_in_csv_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text('time,domain\n2024-02-04 10:00:00,"a\nb"\n2024-02-04 10:00:01,c\n')
    (tmp_path / "b.csv").write_text("time,domain\n2024-02-04 10:00:02,d\n")
    for multiline in (None, True):
        got = ingest.accepted(ingest.read_directory(spark, str(tmp_path), YEAR, multiline)).collect()
        assert sorted(r.domain for r in got) == ["a\nb", "c", "d"]


def test_more_iso_stamps(spark):
    expected = {
        "2024-02-04T10:15:01.123456789": "2024-02-04 10:15:01.123456", "2024-02-04T10:15:01+0000": "2024-02-04 10:15:01",
        "2024-02-04T10:15:01+02": "2024-02-04 08:15:01", "2024-02-04 10:15:01.5-0130": "2024-02-04 11:45:01.500000",
        "20240204T101501": "2024-02-04 10:15:01", "20240204": "2024-02-04 00:00:00", "20240204T10": "2024-02-04 10:00:00",
        "20240204T101501.25Z": "2024-02-04 10:15:01.250000", "2024-02-04T10:15:01,5": "2024-02-04 10:15:01.500000",
        "2024-02-04T10:15+05:30": "2024-02-04 04:45:00", "2024-0204": None, "2024-02-30": None, "2024-02-04T10:15:01+25": None,
        "2024-02-04T25:00:00": None,
    }
    rows = spark.createDataFrame([(t,) for t in expected], "text STRING")
    got = rows.select("text", layout.parse_timestamp(layout.plain_stamp(F.col("text")), YEAR).cast("string").alias("ts")).collect()
    assert {r.text: r.ts for r in got} == {t: v and v.rstrip("0").rstrip(".") if v and "." in v else v for t, v in expected.items()}


def test_long_array_is_read_whole(spark, tmp_path):
    # 20 MiB in one line (the build machine's disk and time set the size); nothing of it reaches the driver.
    n = 60_000
    filler = "x" * 300
    with open(tmp_path / "big.json", "w") as out:
        out.write("[" + ",".join(f'{{"time": "2024-02-04 10:00:00", "src": "s{i}", "note": "{filler}"}}' for i in range(n)) + "]")
    (tmp_path / "broken.json").write_text('[{"time": "2024-02-04 10:00:00"}, {"ti')
    parsed = ingest.read_files(spark, [str(tmp_path)], YEAR, format="auto")
    assert ingest.quality(parsed).first()[:2] == (n, 1)


def test_flows_are_one_table(spark, tmp_path):
    for name in ("b.log", "a.log"):
        (tmp_path / name).write_text("".join(f"Feb  4 10:00:{i:02d} fw k: src=1.1.1.{i} dst=2.2.2.2 proto={name[0]} \n" for i in range(30)))
    flows = ingest.to_flows(ingest.read_directory(spark, str(tmp_path), YEAR))
    plan = flows.where("src_ip = '1.1.1.1'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Window" not in plan
    got = flows.orderBy("event_id").collect()
    assert [(r.protocol, r.src_ip) for r in got] == [(p, f"1.1.1.{i}") for p in "AB" for i in range(30)]
