"""Every operator as a query over the test tables (thresholds scaled to that sparse traffic)."""

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import sinks
from tidewatch.durable import fresh_path
from tidewatch.functions import network as net
from tidewatch.operators import alerts as al
from tidewatch.operators import carried, declared, detectors, results, stats, threat
from tidewatch.operators.contenders import contenders
from tidewatch.plans.pipeline import Settings, final_alerts, raw_alerts
from tidewatch.plans.testflows import flows_of
from tidewatch.sources import ingest, layout, ledger
from tidewatch.sources.feeds import read_feeds
from tidewatch.streaming import detect, watch

HOUR, DAY, YEAR = 3600, 86400, 2024

MALICIOUS = ["203.0.113.5", "203.0.113.12", "10.0.0.4"]
TOR = ["203.0.113.7", "203.0.113.12", "10.0.0.9"]
DOMAINS = ["host3.example.com", "host7.example.com"]

SETTINGS = Settings(
    port_scan={"unique_ports": 8, "window_s": 48 * HOUR},
    brute_force={"failed_attempts": 3, "window_s": 5 * DAY},
    ddos={"requests_per_second": 0.0005, "unique_sources": 5, "window_s": 6 * HOUR},
    exfiltration={"outbound_bytes": 500_000, "window_s": DAY},
    beaconing={"min_connections": 5, "tolerance_percent": 40},
    after_hours={"start_hour": 0, "end_hour": 5, "min_events": 18},
    anomaly={"sensitivity": "high"},
    dedup_window_s=10 * DAY,
)

RULES = [
    {"id": "RULE-CUSTOM-001", "name": "Large upload", "category": "exfiltration", "severity": "HIGH",
     "conditions": {"protocol": "TCP", "dst_port": 8443, "bytes_sent_min": 200_000}},
    {"id": "RULE-CUSTOM-002", "name": "Repeated web failures", "category": "brute_force", "severity": "LOW",
     "conditions": {"dst_port": [443, 8080], "action": "failed", "count_min": 3, "time_window_seconds": 7 * DAY}},
    {"id": "RULE-CUSTOM-003", "name": "Switched off", "enabled": False, "conditions": {}},
    {"id": "RULE-CUSTOM-004", "name": "Repeated sign-ups refused", "severity": "MEDIUM",
     "conditions": {"protocol": "HTTP", "action": ["deny", "drop"], "count_min": 2, "time_window_seconds": 7 * DAY}},
    {"id": "RULE-CUSTOM-005", "name": "Probes", "category": "reconnaissance", "severity": "LOW",
     "conditions": {"flags": ["SYN"], "direction": "internal", "count_min": 2, "time_window_seconds": 2 * DAY}},
    {"id": "RULE-CUSTOM-006", "name": "Odd port", "category": "evasion", "conditions": {"dst_port": [8081, 0]}},
    {"id": "RULE-CUSTOM-007", "name": "Answer 500", "conditions": {"status_code": [500], "src_port": list(range(40000, 40050))}},
]

FLOW_COLUMNS = [
    "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes_sent", "bytes_received", "packets",
    "duration", "flags", "action", "status_code", "direction", "domain",
]
ALERT_TEXTS = ["recommendation", "false_positive_likelihood", "mitre_attack_id"]
ALERT_KEYS = ["ts", "rule_id", "rule_name", "category", "severity", "src_ip", "dst_ip", "dst_port"]

Query = Callable[[SparkSession, str], DataFrame]


def feed_table(spark: SparkSession) -> DataFrame:
    rows = [(threat.MALICIOUS_IP, x) for x in MALICIOUS] + [(threat.TOR_NODE, x) for x in TOR]
    rows += [(threat.MALICIOUS_DOMAIN, x) for x in DOMAINS]
    return spark.createDataFrame(rows, "kind STRING, indicator STRING")


_alert_tables: dict[tuple[str, str], str] = {}


def alert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final alerts of a test set: written once per session, read by all alert reports."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _alert_tables:
        path = fresh_path(spark, "final-alerts")
        final_alerts(flows_of(spark, sf_dir), feed_table(spark), SETTINGS).write.parquet(path)
        _alert_tables[key] = path
    return spark.read.parquet(_alert_tables[key])


# ---- flows as log files --------------------------------------------------------------

def _stamp(column: str = "ts") -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _csv_rows(flows: DataFrame) -> DataFrame:
    """Flows as text under names that need the alias lists."""
    return flows.select(
        _stamp().alias(" Event_Time"), F.col("src_ip").alias("source"), F.col("dst_ip").alias("dest"),
        F.col("src_port").alias("sport"), F.col("dst_port").alias("DPort"), F.lower("protocol").alias("proto"),
        F.col("bytes_sent").alias("out_bytes"), F.col("bytes_received").alias("in_bytes"),
        F.col("packets").alias("pkt_count"), F.col("duration").alias("conn_duration"),
        F.col("flags").alias("tcp_flags"), F.upper("action").alias("result"), F.col("direction").alias("dir"),
        F.col("domain").alias("host"),
    )


def _json_rows(flows: DataFrame) -> DataFrame:
    return flows.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"),
        F.col("src_ip").alias("source_ip"), F.col("dst_ip").alias("dst"), "src_port",
        F.col("dst_port").cast("string").alias("dest_port"), F.lower("protocol").alias("proto"),
        F.col("bytes_sent").alias("out_bytes"), "bytes_received", F.col("packets").alias("packet_count"),
        F.col("duration").alias("flow_duration"), F.col("flags").alias("tcp_flags"),
        F.upper("action").alias("disposition"), F.col("status_code").alias("http_status"), "direction",
        F.col("domain").alias("hostname"),
    )


def _loud_json_rows(flows: DataFrame) -> DataFrame:
    rows = _json_rows(flows)
    return rows.select([F.col(c).alias(c.upper()) for c in rows.columns])


def _syslog_rows(flows: DataFrame) -> DataFrame:
    return flows.select(F.format_string(
        "%s fw01 kernel[12]: src=%s:%d dst=%s:%d proto=%s action=%s bytes=%d packets=%d",
        F.date_format("ts", "MMM d HH:mm:ss"), "src_ip", "src_port", "dst_ip", "dst_port", F.lower("protocol"),
        F.upper("action"), "bytes_sent", "packets").alias("value"))


def _write_logs(spark: SparkSession, name: str, csv: DataFrame | None = None, json: DataFrame | None = None,
                syslog: DataFrame | None = None) -> str:
    folder = fresh_path(spark, name)
    if csv is not None:
        csv.write.mode("append").csv(folder, header=True, emptyValue="", ignoreLeadingWhiteSpace=False)
    if json is not None:
        json.write.mode("append").json(folder)
    if syslog is not None:
        syslog.write.mode("append").text(folder)
    return folder


def _read_back(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.accepted(ingest.read_directory(spark, folder, YEAR)).select(FLOW_COLUMNS)


def ingest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(spark, _write_logs(spark, "csv", csv=_csv_rows(flows_of(spark, sf_dir))))


def ingest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(spark, _write_logs(spark, "json", json=_json_rows(flows_of(spark, sf_dir))))


def ingest_csv_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains with line breaks and quotes inside; the files that have them are found by the reader."""
    broken = F.when(F.col("domain") != "", F.concat(F.lit('a "b"\n'), "domain")).otherwise("")
    csv = _csv_rows(flows_of(spark, sf_dir).withColumn("domain", broken))
    folder = fresh_path(spark, "csv-lines")
    csv.write.csv(folder, header=True, emptyValue="", ignoreLeadingWhiteSpace=False, escape='"')
    return _read_back(spark, folder)


def array_parts(records: DataFrame) -> DataFrame:
    """Texts that, written one after the other, make one JSON array of each partition's records.

    They pass batch by batch, so an array may have any length; a partition without records gives none.
    """
    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for texts in (batch.column(0).to_pylist() for batch in batches if batch.num_rows):
            yield pa.RecordBatch.from_arrays([pa.array([mark + texts[0], *("," + text for text in texts[1:])])], ["value"])
            mark = ","
        if mark == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])

    return records.select(F.to_json(F.struct(*records.columns)).alias("value")).mapInArrow(framed, "value STRING")


def ingest_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array file for each input partition, however long."""
    folder = fresh_path(spark, "json-array")
    # A task writes one file, and its array is one line.
    array_parts(_json_rows(flows_of(spark, sf_dir))).write.option("maxRecordsPerFile", 0).text(folder, lineSep=" ")
    parsed = ingest.read_files(spark, [folder], YEAR, format="auto")
    return ingest.accepted(parsed).select(FLOW_COLUMNS)


def ingest_syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(spark, _write_logs(spark, "syslog", syslog=_syslog_rows(flows_of(spark, sf_dir))))


def _three_formats(spark: SparkSession, sf_dir: str) -> str:
    """Every flow once, in one of three formats by its protocol."""
    flows = flows_of(spark, sf_dir)
    return _write_logs(
        spark, "mixed", csv=_csv_rows(flows.where("protocol IN ('UDP', 'HTTP')")),
        json=_loud_json_rows(flows.where("protocol NOT IN ('UDP', 'HTTP', 'ICMP')")),
        syslog=_syslog_rows(flows.where("protocol = 'ICMP'")),
    )


def ingest_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(spark, _three_formats(spark, sf_dir))


def ingest_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files, but told apart by their first lines only."""
    parsed = ingest.read_files(spark, [_three_formats(spark, sf_dir)], YEAR, format="auto")
    return ingest.accepted(parsed).select(FLOW_COLUMNS)


def ingest_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flows table proper: lines are written in order of the events' own numbers, so the ids must follow them."""
    ordered = flows_of(spark, sf_dir).repartitionByRange(5, "event_id").sortWithinPartitions("event_id")
    folder = _write_logs(spark, "numbered", json=_json_rows(ordered))
    flows = ingest.to_flows(ingest.read_directory(spark, folder, YEAR))
    return flows.select("event_id", "ts", "src_ip", "dst_ip", "src_port", "bytes_sent")


def ingest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``ingest_numbered``, but the files come in two goes; the second run reads the new ones only."""
    flows, root = flows_of(spark, sf_dir), fresh_path(spark, "incremental")
    middle = flows.agg(F.percentile("event_id", 0.5)).first()[0]
    folder = fresh_path(spark, "arriving")
    for half in (F.col("event_id") <= middle, F.col("event_id") > middle):
        ordered = flows.where(half).repartitionByRange(3, "event_id").sortWithinPartitions("event_id")
        _json_rows(ordered).write.mode("append").json(folder)
        ledger.add_new(spark, folder, root, YEAR)
    return ledger.flows(spark, root).select("event_id", "ts", "src_ip", "dst_ip", "src_port", "bytes_sent")


def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh byte count spoils the port, every eleventh the time stamp."""
    flows = flows_of(spark, sf_dir)
    spoilt = flows.select(
        F.when(F.col("bytes_sent") % 11 == 0, "soon").otherwise(_stamp()).alias("timestamp"), "src_ip",
        F.when(F.col("bytes_sent") % 7 == 0, "12.5").otherwise(F.col("dst_port").cast("string")).alias("dst_port"),
    )
    folder = _write_logs(spark, "stats", csv=spoilt)
    return ingest.quality(ingest.read_directory(spark, folder, YEAR))


LAYOUTS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy/MM/dd HH:mm:ss", "MMM d HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
]


def parse_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each flow's time written in all nine layouts and read again."""
    texts = F.array(*[
        F.struct(F.lit(i).alias("layout"), F.date_format("ts", form).alias("text")) for i, form in enumerate(LAYOUTS)
    ])
    rows = flows_of(spark, sf_dir).select("event_id", F.explode(texts).alias("entry")).select("event_id", "entry.*")
    return rows.select("event_id", "layout", layout.parse_timestamp(layout.plain_stamp(F.col("text")), YEAR).alias("ts"))


def parse_ts_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nanoseconds, short offsets and the basic form."""
    form = lambda pattern, tail="": F.concat(F.date_format("ts", pattern), F.lit(tail))
    texts = F.array(*[F.struct(F.lit(i).alias("layout"), text.alias("text")) for i, text in enumerate([
        form("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "789"), form("yyyy-MM-dd HH:mm:ss.SSSSSS", "+0000"), form("yyyy-MM-dd'T'HH:mm:ss", "+02"),
        form("yyyy-MM-dd'T'HH:mm:ss.SSS", "-0130"), form("yyyyMMdd'T'HHmmss"), form("yyyyMMdd HHmmss.SSSSSS", "Z"),
    ])])
    rows = flows_of(spark, sf_dir).select("event_id", F.explode(texts).alias("entry")).select("event_id", "entry.*")
    return rows.select("event_id", "layout", layout.parse_timestamp(layout.plain_stamp(F.col("text")), YEAR).alias("ts"))


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = flows_of(spark, sf_dir).where("domain <> ''").select(F.explode(F.array(
        F.concat(F.lit(" \t"), F.col("domain"), F.lit("\t ")), F.concat(F.lit("# "), F.col("domain")), F.lit(""), F.lit("\t"),
    )).alias("value"))
    path = fresh_path(spark, "feed")
    lines.write.text(path)
    return read_feeds(spark, {threat.MALICIOUS_DOMAIN: path})


# ---- streams ---------------------------------------------------------------------------

def watch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a batch; the files hold rows of all times, so most are late."""
    folder = _write_logs(spark, "watched", json=_json_rows(flows_of(spark, sf_dir).repartition(4)))
    output = fresh_path(spark, "watch-totals")
    watch.run_totals(watch.watch_flows(spark, folder, "json", YEAR, max_files=1), output)
    return watch.latest_totals(spark, output)


def watch_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _csv_rows(flows_of(spark, sf_dir))
    folder = _write_logs(spark, "watched", csv=rows)
    output = fresh_path(spark, "watch-csv")
    watch.run_available(watch.watch_flows(spark, folder, "csv", YEAR, header=rows.columns), output)
    return spark.read.parquet(output).select(FLOW_COLUMNS)


def watch_brute_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that each hold rows of the whole time, in no order; a last row far ahead lets the watermark pass them all."""
    flows = flows_of(spark, sf_dir)
    files = max(3, len(flows.inputFiles()))
    folder = _write_logs(spark, "watched", json=_json_rows(flows.repartition(files)))
    _write_logs_to(folder, spark.range(1).select(F.lit("2199-01-01 00:00:00").alias("time")))
    output = fresh_path(spark, "watch-brute-force")
    stream = watch.watch_flows(spark, folder, "json", YEAR, max_files=2 * files // 3)
    watch.run_available(detect.brute_force(stream, **SETTINGS.brute_force, delay_s=365 * 24 * HOUR), output)
    return spark.read.parquet(output).drop("batch")


def _write_logs_to(folder: str, json: DataFrame) -> None:
    json.coalesce(1).write.mode("append").json(folder)


def watch_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _write_logs(spark, "watched", json=_json_rows(flows_of(spark, sf_dir)))
    output = fresh_path(spark, "watch-domains")
    stream = watch.watch_flows(spark, folder, "json", YEAR).withColumn("event_id", F.lit(None).cast("bigint"))
    watch.run_available(threat.domain_contacts(stream, feed_table(spark)), output)
    return spark.read.parquet(output).select("ts", "domain", "src_ip", "dst_ip", "dst_port")


# ---- detectors ---------------------------------------------------------------------------

def port_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan_columns(detectors.port_scan(flows_of(spark, sf_dir), **SETTINGS.port_scan))


def _scan_columns(found: DataFrame) -> DataFrame:
    ports = F.array_join(F.transform("sample_ports", lambda p: p.cast("string")), ",")
    return found.select("ts", "src_ip", "dst_ip", "unique_ports", "target_count", "scan_type", "event_count",
                        "last_ts", ports.alias("sample_ports"))


def udp_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan_columns(declared.udp_scan(flows_of(spark, sf_dir), 3, 120 * HOUR))


def syn_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan_columns(declared.syn_scan(flows_of(spark, sf_dir), 5, 48 * HOUR))


def brute_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.brute_force(flows_of(spark, sf_dir), **SETTINGS.brute_force).drop("event_id")


def ddos(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detectors.ddos(flows_of(spark, sf_dir), **SETTINGS.ddos)
    top = F.array_join(F.transform("top_sources", lambda s: F.concat_ws(":", s["ip"], s["events"].cast("string"))), ",")
    return found.withColumn("top_sources", top).withColumn(
        "requests_per_second", F.round("requests_per_second", 9)).drop("event_id")


def exfiltration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.exfiltration(flows_of(spark, sf_dir), **SETTINGS.exfiltration).drop("event_id")


def beaconing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detectors.beaconing(flows_of(spark, sf_dir), **SETTINGS.beaconing)
    for name in ("mean_interval", "std_interval", "cv_percent"):
        found = found.withColumn(name, F.round(name, 4))
    return found


def after_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.after_hours(flows_of(spark, sf_dir), **SETTINGS.after_hours)


def anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detectors.anomaly(flows_of(spark, sf_dir), **SETTINGS.anomaly)
    for name in ("z_score", "mean_events", "std_events"):
        found = found.withColumn(name, F.round(name, 6))
    return found


def ti_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threat.ip_first_seen(flows_of(spark, sf_dir), feed_table(spark), threat.MALICIOUS_IP)


def ti_tor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threat.ip_first_seen(flows_of(spark, sf_dir), feed_table(spark), threat.TOR_NODE)


def ti_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threat.domain_contacts(flows_of(spark, sf_dir), feed_table(spark))


def http_bruteforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declared.http_bruteforce(flows_of(spark, sf_dir), 3, 7 * DAY).drop("event_id")


def syn_flood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declared.syn_flood(flows_of(spark, sf_dir), 5, 10, DAY).drop("event_id")


def dns_tunnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declared.dns_tunnel(flows_of(spark, sf_dir), 50, 2, 5 * DAY).drop("event_id")


def proto_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declared.proto_mismatch(flows_of(spark, sf_dir))


def icmp_flood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declared.icmp_flood(flows_of(spark, sf_dir), 50 / DAY, DAY).drop("event_id")


def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declared.threshold_rules(flows_of(spark, sf_dir), RULES).drop("about", "event_id")


# ---- alerts and results ------------------------------------------------------------------

def alert_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = al.domain_alerts(threat.domain_contacts(flows_of(spark, sf_dir), feed_table(spark)))
    return al.dedupe(hits, 10 * DAY).select(ALERT_KEYS)


def alert_dedup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``alert_dedup``, in three runs that each know what the one before kept."""
    hits = al.domain_alerts(threat.domain_contacts(flows_of(spark, sf_dir), feed_table(spark)))
    first, last = hits.agg(F.min("ts"), F.max("ts")).first()
    root, third = fresh_path(spark, "dedup-runs"), (last - first) / 3
    bounds = [first, first + third, first + 2 * third]
    run = sum((F.col("ts") > F.lit(bound)).cast("int") for bound in bounds[1:])
    kept = [carried.dedupe_run(hits.where(run == number), root, number, 10 * DAY) for number in range(3)]
    return reduce(DataFrame.unionByName, kept).select(ALERT_KEYS)


def top_talkers_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_talkers(contenders(flows_of(spark, sf_dir), ["src_ip"], stats.TOP_N))


def top_destinations_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_destinations(contenders(flows_of(spark, sf_dir), ["dst_ip"], stats.TOP_N))


def top_ports_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_ports(contenders(flows_of(spark, sf_dir).where("dst_port > 0"), ["dst_port"], stats.TOP_N))


def connection_pairs_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.connection_pairs(contenders(flows_of(spark, sf_dir), ["src_ip", "dst_ip"], 10))


def all_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.ranked(alert_table(spark, sf_dir)).select(*ALERT_KEYS, *ALERT_TEXTS)


def raw_alerts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the detectors found, before deduplication."""
    return raw_alerts(flows_of(spark, sf_dir), feed_table(spark), SETTINGS).select(ALERT_KEYS)


def domain_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, texts and evidence of one kind of alert."""
    found = al.domain_alerts(threat.domain_contacts(flows_of(spark, sf_dir), feed_table(spark)))
    return found.select("alert_id", "ts", "src_ip", "dst_ip", "dst_port", "description", "evidence", *ALERT_TEXTS)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's tables, written and read again: one row per line of the short ones, a count of the alerts."""
    flows, alerts, path = flows_of(spark, sf_dir), alert_table(spark, sf_dir), fresh_path(spark, "report")
    sinks.write_report({
        "alerts": alerts, "top_talkers": stats.top_talkers(flows), "protocols": stats.protocol_dist(flows),
        "severities": al.by_severity(alerts),
    }, path)
    read = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}")
    parts = [
        read("alerts", "severity STRING").groupBy(F.col("severity").alias("name")).agg(F.count("*").alias("amount")).withColumn("part", F.lit("alerts")),
        read("top_talkers", "ip STRING, bytes BIGINT").select(F.col("ip").alias("name"), F.col("bytes").alias("amount"), F.lit("talkers").alias("part")),
        read("protocols", "protocol STRING, events BIGINT").select(F.col("protocol").alias("name"), F.col("events").alias("amount"), F.lit("protocols").alias("part")),
        read("severities", "severity STRING, alerts BIGINT").select(F.col("severity").alias("name"), F.col("alerts").alias("amount"), F.lit("severities").alias("part")),
    ]
    return reduce(DataFrame.unionByName, parts)


def alert_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Description and evidence of four kinds of alerts; of the numbers with fractions only their neighbours."""
    flows, listed, scan, brute = flows_of(spark, sf_dir), feed_table(spark), SETTINGS.port_scan, SETTINGS.brute_force
    found = [
        al.malicious_ip_alerts(threat.ip_first_seen(flows, listed, threat.MALICIOUS_IP)),
        al.tor_alerts(threat.ip_first_seen(flows, listed, threat.TOR_NODE)),
        al.port_scan_alerts(detectors.port_scan(flows, **scan), scan["window_s"]),
        al.brute_force_alerts(detectors.brute_force(flows, **brute), brute["window_s"]),
    ]
    part = lambda name: F.get_json_object("evidence", f"$.{name}")
    short = F.when(F.col("rule_id") == "RULE-003", F.concat_ws("|", part("failed_attempts"), part("service"), part("first_attempt"), part("last_attempt")))
    rows = reduce(DataFrame.unionByName, [alerts.select("rule_id", "ts", "src_ip", "dst_ip", "dst_port", "description", "evidence") for alerts in found])
    return rows.withColumn("evidence", F.coalesce(short, F.col("evidence")))


def sink_alert_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of the written alerts, read back: those of ``all_alerts``, and whether the other three are whole."""
    path = fresh_path(spark, "alert-fields")
    sinks.write_alerts(alert_table(spark, sf_dir), path)
    text = ", ".join(f"{name} {'INT' if name == 'dst_port' else 'VARIANT' if name == 'evidence' else 'STRING'}" for name in sinks.ALERT_FIELDS)
    back = spark.read.schema(text).json(f"{path}/alerts")
    whole = F.col("alert_id").rlike("^ALERT-[0-9A-F]{16}$") & (F.length("description") > 20) & F.schema_of_variant("evidence").startswith("OBJECT")
    return back.select(F.col("timestamp").cast("timestamp_ntz").alias("ts"), *ALERT_KEYS[1:], *ALERT_TEXTS, whole.alias("whole"))


def alerts_min_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.at_least(alert_table(spark, sf_dir), "HIGH").select(ALERT_KEYS)


def sink_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "sink")
    sinks.write_alerts(alert_table(spark, sf_dir), path)
    back = spark.read.schema("timestamp STRING, rule_id STRING, severity STRING, date DATE").json(f"{path}/alerts")
    return back.groupBy("date", "rule_id", "severity").agg(
        F.count("*").alias("alerts"), F.min(F.col("timestamp").cast("timestamp_ntz")).alias("first_ts"))


def flow_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.flow_records(flows_of(spark, sf_dir))


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.recommendations(alert_table(spark, sf_dir)).select("place", "category", "recommendation")


def exec_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = results.exec_summary(flows_of(spark, sf_dir), alert_table(spark, sf_dir))
    return row.withColumn("hours", F.round("hours", 6))


def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes from bytes to terabytes."""
    size = (F.col("bytes_sent") * F.pow(F.lit(37.0), (F.col("event_id") % 6))).cast("bigint")
    return flows_of(spark, sf_dir).select("event_id", net.human_bytes(size).alias("size_text"))


def traffic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.traffic_stats(flows_of(spark, sf_dir))
    return found.withColumn("events_per_second", F.round("events_per_second", 9)).withColumn(
        "bytes_per_second", F.round("bytes_per_second", 6))


def _on_flows(function: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: function(flows_of(spark, sf_dir))


def _on_alerts(function: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: function(alert_table(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "ingest_csv": ingest_csv, "ingest_json": ingest_json, "ingest_json_array": ingest_json_array,
    "ingest_syslog": ingest_syslog, "ingest_union": ingest_union, "ingest_auto": ingest_auto,
    "ingest_csv_multiline": ingest_csv_multiline, "parse_ts_iso": parse_ts_iso, "watch_csv": watch_csv,
    "ingest_numbered": ingest_numbered, "ingest_stats": ingest_stats, "parse_ts": parse_ts, "feeds": feeds,
    "ingest_incremental": ingest_incremental, "alert_dedup_runs": alert_dedup_runs,
    "top_talkers_bounded": top_talkers_bounded, "top_destinations_bounded": top_destinations_bounded,
    "top_ports_bounded": top_ports_bounded, "connection_pairs_bounded": connection_pairs_bounded,
    "watch_totals": watch_totals, "watch_domains": watch_domains,
    "watch_brute_force": watch_brute_force,
    "traffic_stats": traffic_stats,
    "protocol_dist": _on_flows(stats.protocol_dist),
    "top_talkers": _on_flows(stats.top_talkers),
    "top_destinations": _on_flows(stats.top_destinations),
    "top_ports": _on_flows(stats.top_ports),
    "hourly_dist": _on_flows(stats.hourly_dist),
    "protocol_bytes": _on_flows(stats.protocol_bytes),
    "connection_pairs": _on_flows(stats.connection_pairs),
    "geo_summary": _on_flows(stats.geo_summary),
    "human_bytes": human_bytes,
    "ti_ip": ti_ip, "ti_tor": ti_tor, "ti_domain": ti_domain,
    "port_scan": port_scan, "brute_force": brute_force, "ddos": ddos, "exfiltration": exfiltration,
    "beaconing": beaconing, "after_hours": after_hours, "anomaly": anomaly,
    "udp_scan": udp_scan, "syn_scan": syn_scan, "http_bruteforce": http_bruteforce, "syn_flood": syn_flood,
    "dns_tunnel": dns_tunnel, "proto_mismatch": proto_mismatch, "icmp_flood": icmp_flood,
    "custom_rules": custom_rules,
    "alert_dedup": alert_dedup, "all_alerts": all_alerts, "alerts_min_severity": alerts_min_severity,
    "alerts_by_severity": _on_alerts(al.by_severity),
    "alerts_by_category": _on_alerts(al.by_category),
    "alerts_top_sources": _on_alerts(al.top_sources),
    "alerts_timeline": _on_alerts(al.timeline),
    "raw_alerts": raw_alerts_query, "domain_alerts": domain_alerts, "report": report,
    "sink_alerts": sink_alerts, "sink_alert_fields": sink_alert_fields, "alert_texts": alert_texts, "flow_records": flow_records,
    "risk_score": _on_alerts(results.risk_score),
    "recommendations": recommendations, "exec_summary": exec_summary,
}
