"""WARC archives: write captures, read them back, assemble the transactions.

Each capture is three records: the response (or a revisit, if an earlier capture has the same
payload), its request and its metadata; the latter two name the first by WARC-Concurrent-To.
Records are built as column expressions and written by Spark's text writer: its line separator is
the blank line that ends a record. Archives are read as whole files (``records`` bounds their
length) and framed by Content-Length, so payloads may hold anything.
"""

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.durable import broadcast_if_small, durable

# Fixed values of the file format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()),
    ("target_uri", pa.string()), ("date", pa.string()), ("declared_digest", pa.string()), ("http", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])


def _urn(*parts: Column) -> Column:
    """A record id: the digest of ``parts`` written as a UUID."""
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("|", *parts).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: Column | str, record_id: Column, uri: Column, date: str, media: str, block: Column, *more: Column) -> Column:
    """One record without its end. ``more``: header lines, each with its line end, null where absent."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(
        F.lit(f"{VERSION}\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", record_id), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri), *(F.coalesce(x, F.lit("")) for x in more), line("Content-Type", F.lit(media)),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
    )


def with_decisions(pages: DataFrame, least: int) -> DataFrame:
    """Adds payload_bytes, digest and ``first_id``: the smallest page_id that has this payload, where
    the payload has at least ``least`` bytes and more than one page has it; else null.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload.cast("binary"), 256).alias("digest"),
    )
    firsts = base.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    return base.join(broadcast_if_small(durable(firsts, "payloads")), "digest", "left")


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = 100, records: int = 10_000) -> None:
    """Writes ``pages`` (page_id, url, html) as gzip-compressed archives of at most ``records`` captures each.

    Of pages with equal payloads of at least ``least`` bytes, that with the smallest page_id is the
    response and the others revisit it. A null html is an empty payload; a null url is empty; pages
    without page_id come last. Repeated rows with the response's own id are responses too.
    ``date`` stands for the capture time, which the table doesn't have.
    """
    uri = F.col("url")
    for char, code in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20"), ("\t", "%09")):
        uri = F.replace(uri, F.lit(char), F.lit(code))
    has_first = F.col("first_id").isNotNull()
    revisit = has_first & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    capture = _urn(F.lit("capture"), page, F.col("digest"))
    target = _urn(F.lit("capture"), F.col("first_id").cast("string"), F.col("digest"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"))
    refers = F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), target, F.lit(f"\r\nWARC-Profile: {PROFILE}\r\n")))
    together = F.concat(F.lit("WARC-Concurrent-To: "), capture, F.lit("\r\n"))
    request = F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{END}"))
    fields = F.concat(F.lit("page_id: "), page, F.lit("\r\n"))
    response = _record(F.when(revisit, "revisit").otherwise("response"), capture, uri, date, "application/http; msgtype=response", F.concat(head, F.when(revisit, "").otherwise(F.col("payload"))), digest, refers)
    asked = _record("request", _urn(F.lit("request"), page, F.col("digest")), uri, date, "application/http; msgtype=request", request, together)
    about = _record("metadata", _urn(F.lit("metadata"), page, F.col("digest")), uri, date, "application/warc-fields", fields, together)
    whole = with_decisions(pages, least).select(F.concat_ws(END, response, asked, about).alias("value"))
    whole.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record, framed by Content-Length."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(size := int(headers["content-length"]))
        if len(block) < size:
            raise ValueError("a record is cut off")
        yield headers, block


def _parse_files(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as stream:
                for headers, block in parse(stream):
                    kind = headers["warc-type"]
                    http, payload = "", block
                    if kind != "metadata":
                        head, _, payload = block.partition(b"\r\n\r\n")
                        http = head.decode("utf-8", "replace")
                    rows.append((
                        headers["warc-record-id"], kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), headers.get("warc-date"),
                        headers.get("warc-payload-digest"), http, len(payload), hashlib.sha256(payload).hexdigest(), payload if payloads or kind == "metadata" else None,
                    ))
                    size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), RECORD, strict=True)], schema=RECORD)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), RECORD, strict=True)], schema=RECORD)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``; without ``payloads``, only their length and digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    kinds = ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'binary' if f.type == pa.binary() else 'string'}" for f in RECORD)
    return files.mapInArrow(lambda batches: _parse_files(batches, payloads), kinds)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, and the requests and metadata that name it.

    A capture without request or metadata has empty arrays. ``payload_bytes`` and
    ``payload_digest`` are those of the full payload: of the response that a revisit refers to
    (null if that is missing), else of the record itself. Request and metadata arrays hold what
    names the capture, by record id.
    """
    part = F.struct("record_id", "target_uri", "date", "http", "payload")
    kinds = ("request", "metadata")
    # What names a capture is gathered in one pass for both kinds; the captures themselves aren't, so a payload is in no list.
    parts = records.where(F.col("record_type").isin(*kinds) & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("capture_id")).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("record_type") == kind, part))).alias(kind) for kind in kinds]
    )

    main = records.where(F.col("record_type").isin("response", "revisit"))
    full = records.where(F.col("record_type") == "response").groupBy(F.col("record_id").alias("refers_to")).agg(F.min(F.struct(F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest"))).alias("full"))
    own = main.select(
        F.col("record_id").alias("capture_id"), "record_type", "refers_to", "target_uri", "date", "declared_digest",
        F.when(F.col("record_type") == "response", F.struct(F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest"))).alias("own"),
        F.struct("http", "payload").alias("response"),
    )
    joined = own.join(parts, "capture_id", "left")
    revisits = joined.where("record_type = 'revisit'").join(full, "refers_to", "left").select(*joined.columns, "full")
    responses = joined.where("record_type = 'response'").withColumn("full", F.col("own"))
    none = F.array().cast(joined.schema["request"].dataType)
    return responses.unionByName(revisits).select(
        "capture_id", "record_type", F.col("refers_to").alias("refers_to_id"), "target_uri", "date", "declared_digest",
        F.col("full.bytes").alias("payload_bytes"), F.col("full.digest").alias("payload_digest"),
        "response", F.coalesce("request", none).alias("request"), F.coalesce("metadata", none).alias("metadata"),
    )


def page_of(captures: DataFrame) -> DataFrame:
    """Adds ``page_id``, read from the first metadata record."""
    field = F.regexp_extract(F.col("metadata")[0]["payload"].cast("string"), r"page_id: (-?\d+)", 1)
    return captures.withColumn("page_id", F.when(field != "", field.cast("long")))


def digest_report(captures: DataFrame) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, the response's page_id for revisits, and how many
    requests and metadata records name the capture.
    """
    # Thin and read three times, hence written: refers_to is resolved against it.
    thin = durable(page_of(captures).select("capture_id", "refers_to_id", "page_id", "payload_bytes", "payload_digest", "record_type", F.size("request").cast("long").alias("n_requests"), F.size("metadata").cast("long").alias("n_metadata")), "captures")
    target = thin.where("record_type = 'response'").groupBy(F.col("capture_id").alias("refers_to_id")).agg(F.min("page_id").alias("refers_to"))
    revisits = thin.where("record_type = 'revisit'").join(target, "refers_to_id", "left")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_requests", "n_metadata")
    return thin.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(revisits.select(*columns))
