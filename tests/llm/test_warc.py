import gzip
import hashlib
import io

from tidewatch.durable import fresh_path
from tidewatch.llm import warc

LONG = "x" * 150
ROWS = [
    (5, "http://a/5", LONG), (2, "http://a/2", LONG), (9, "http://b/\r\nEvil: 1", LONG), (1, "u", "short"), (3, "u", "short"), (4, None, None), (6, "u", ""),
    (7, "u", f"WARC/1.1\r\n\r\n\r\n{LONG}\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n"), (None, "u", LONG), (8, "ü", "é" * 60), (10, "ü", "é" * 60), (11, "big", "<p>wide</p>" * 200_000),
]


def run(spark, rows):
    path = fresh_path(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string"), path, records=4)
    return path


def expected(rows):
    firsts = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            firsts[data] = min(page, firsts.get(data, page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = firsts.get(data)
        revisit = first is not None and page != first
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    path = run(spark, [(*r, "own") for r in ROWS])
    captures = warc.assemble(warc.read(spark, path))
    got = warc.digest_report(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(ROWS)
    whole = {r.page_id: r for r in warc.page_of(captures).collect()}
    assert whole[7].response.payload.decode() == ROWS[7][2] and len(whole[7].request) == len(whole[7].metadata) == 1
    assert whole[5].response.payload == b"" and whole[5].refers_to_id == whole[2].capture_id
    assert whole[2].declared_digest == f"sha256:{whole[2].payload_digest}"
    assert "%0D%0A" in whole[9].target_uri


def test_files_are_plain_archives(spark):
    path = run(spark, [(*r, "own") for r in ROWS])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).collect()
    records = [h for f in files for h, _ in warc.parse(io.BytesIO(gzip.decompress(f.content)))]
    assert len(records) == 3 * len(ROWS) and {r["warc-type"] for r in records} == {"response", "revisit", "request", "metadata"}
    assert all(r["warc-concurrent-to"] for r in records if r["warc-type"] in ("request", "metadata"))


def test_repeated_rows_and_an_empty_table(spark):
    rows = [(1, "u", LONG, "d")] * 2 + [(2, "u", LONG, "d")] * 2
    got = warc.digest_report(warc.assemble(warc.read(spark, run(spark, rows)))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "response", None)] * 2 + [(2, "revisit", 1)] * 2
    assert all(r.n_requests == r.n_metadata == 2 for r in got)
    assert warc.digest_report(warc.assemble(warc.read(spark, run(spark, [])))).count() == 0


def test_records_without_partners(spark):
    kinds = ", ".join(f"{f.name} {'bigint' if str(f.type) == 'int64' else 'binary' if str(f.type) == 'binary' else 'string'}" for f in warc.RECORD)
    base = {f.name: None for f in warc.RECORD}
    rows = [base | {"record_id": "a", "record_type": "response", "payload_bytes": 1}, base | {"record_id": "b", "record_type": "revisit", "refers_to": "gone"}, base | {"record_id": "c", "record_type": "request", "concurrent_to": "nobody"}, base | {"record_id": "d", "record_type": "metadata", "concurrent_to": "b"}, base | {"record_id": "e", "record_type": "request"}]
    got = {r.capture_id: r for r in warc.assemble(spark.createDataFrame(rows, kinds)).collect()}
    assert [len(got[x][kind]) for x in "ab" for kind in ("request", "metadata")] == [0, 0, 0, 1]
    assert set(got) == {"a", "b"} and got["a"].request == [] and got["a"].payload_bytes == 1 and got["b"].payload_bytes is None
