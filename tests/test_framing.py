"""Records over line ends, in files that are cut into many splits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import csv_logs, framing, json_logs
from tidewatch.sources import layout as lo

YEAR = 2024


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "400"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def csv_text(seed, rows, end="\n"):
    rng = random.Random(seed)
    out = ["timestamp,src_ip,dst_ip,bytes_sent,domain"]
    for i in range(rows):
        domain = rng.choice(["plain", "", 'in 5" disk', '"a, b"', '"two\nlines"', '"say ""yes""\n\n and,\nmore"', '"\n"', '"ends with ""q"""', '"' + "long\n" * rng.choice([1, 3, 400]) + '"'])
        out.append(f"2024-01-15 10:{i // 60 % 60:02}:{i % 60:02},10.0.0.{i % 250},8.8.8.8,{i},{domain}")
        if rng.random() < 0.05:
            out.append(rng.choice(["", "too,short", '"2024-01-15 10:00:00"']))
    return end.join(x.replace("\n", end) for x in out) + rng.choice(["", end])


def shown(df):
    rows = df.select("ts", "src_ip", "bytes_sent", "domain", "status", "raw_log").collect()
    return sorted(map(str, rows))


def whole(spark, path, names):
    raw = spark.read.schema(csv_logs.text_schema(names)).options(**csv_logs.OPTIONS, multiLine=True).csv(path)
    return csv_logs.rows(raw.select("*", F.lit(False).alias("too_long"), *lo.place_columns()), names, YEAR)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_files_give_the_rows_of_whole_ones(spark, tmp_path, small_splits, end):
    for k in range(3):
        (tmp_path / f"log{k}.csv").write_bytes(csv_text(k, 150, end).encode())
    names = ["timestamp", "src_ip", "dst_ip", "bytes_sent", "domain"]
    got = csv_logs.read_csv(spark, [str(tmp_path / f"log{k}.csv") for k in range(3)], YEAR)
    assert got.select("source_file", "source_block").distinct().count() > 20
    assert shown(got) == shown(whole(spark, str(tmp_path), names))
    # In order, and each record where it begins.
    order = [r.bytes_sent for r in got.where("status = 'accepted' AND source_file LIKE '%log1.csv'").orderBy("source_block", "source_row").collect()]
    assert order == sorted(order) and len(order) == 150


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    path = tmp_path / "one.csv"
    path.write_text(csv_text(5, 400))
    lines = spark.read.option("lineSep", "\n").text(str(path))
    assert lines.rdd.getNumPartitions() > 30
    assert csv_logs.read_csv(spark, [str(path)], YEAR, multiline=True).where("status = 'accepted'").count() == 400


def test_an_open_quote_does_not_gather_the_file(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(framing, "MOST_BYTES", 3_000)
    path = tmp_path / "open.csv"
    good = "".join(f"2024-01-15 10:00:0{i},a,b,1,x\n" for i in range(9))
    path.write_text("timestamp,src_ip,dst_ip,bytes_sent,domain\n" + good + '2024-01-15 11:00:00,a,b,1,"open\n' + good * 200)
    rows = csv_logs.read_csv(spark, [str(path)], YEAR).collect()
    assert [r.status for r in rows].count("accepted") == 9 and len(rows) == 10
    late = next(r for r in rows if r.status == "rejected")
    assert len(late.raw_log) < 8_000


def array_text(seed, items, indent):
    rng = random.Random(seed)
    made = []
    for i in range(items):
        domain = rng.choice(["a", "b}c", 'q"}', "{[", "\\", '\\"}', "", "x" * rng.choice([1, 900])])
        item = {"timestamp": f"2024-01-15 10:{i // 60:02}:{i % 60:02}", "src_ip": "a", "bytes_sent": i, "domain": domain, "more": rng.choice([{}, {"deep": [{"er": 1}, "}"]}, [], [[{}]], None])}
        made.append(rng.choice([item, item, item, item, 5, "text }", None, [{"x": 1}]]) if i % 7 else item)
    return json.dumps(made, indent=indent), made


@pytest.mark.parametrize("indent", [None, 2])
def test_array_files_stay_split(spark, tmp_path, small_splits, indent):
    wanted = []
    for k in range(2):
        text, made = array_text(k, 120, indent)
        (tmp_path / f"a{k}.json").write_text("﻿" * k + text + "\n" * k)
        wanted += made
    got = json_logs.read_json(spark, [str(tmp_path / f"a{k}.json") for k in range(2)], YEAR, arrays=True)
    rows = got.collect()
    assert len({r.source_block for r in rows}) > 10 and len(rows) == len(wanted)
    flows = sorted((str(r.ts), r.bytes_sent, r.domain) for r in rows if r.status == "accepted")
    assert flows == sorted((w["timestamp"], w["bytes_sent"], w["domain"]) for w in wanted if isinstance(w, dict))
    assert len({(r.source_file, r.source_block, r.source_row) for r in rows if r.status == "accepted"}) == len(flows)


@pytest.mark.parametrize("text, good, bad", [
    ("[]", 0, 0), (" [ ] \n", 0, 0), ("", 0, 0), ('[{"time": "2024-01-15"}]', 1, 0), ('[{"time": "2024-01-15"}', 0, 1), ('[{"time": "2024-01-15"},]', 0, 1),
    ('[{"time": "2024-01-15"} {"time": "2024-01-15"}]', 0, 1), ('[{"time": "2024-01-15"}, {"time": broken}]', 1, 1), ("[1, 2]", 0, 2), ('[{"a": "]', 0, 1), ("[", 0, 1),
    ('[{"time": "2024-01-15"}, 7]', 1, 1), ('[{"time": "2024-01-15"}]]', 0, 1),
])
def test_documents_that_are_no_arrays(spark, tmp_path, text, good, bad):
    (tmp_path / "a.json").write_text(text)
    found = [r.status for r in json_logs.read_json(spark, [str(tmp_path / "a.json")], YEAR, arrays=True).collect()]
    assert (found.count("accepted"), found.count("rejected")) == (good, bad)
