"""Which names a field may have in the input, and how text becomes typed columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of each field in CSV headers, by priority.
CSV_NAMES = {
    "timestamp": ["timestamp", "time", "date", "datetime", "event_time", "log_time"],
    "src_ip": ["src_ip", "source_ip", "src", "source", "srcip", "src_addr"],
    "dst_ip": ["dst_ip", "dest_ip", "dst", "destination", "dstip", "dst_addr", "dest"],
    "src_port": ["src_port", "source_port", "sport", "srcport"],
    "dst_port": ["dst_port", "dest_port", "dport", "dstport", "destination_port"],
    "protocol": ["protocol", "proto", "ip_protocol"],
    "bytes_sent": ["bytes_sent", "sent_bytes", "upload_bytes", "out_bytes", "bytes_out"],
    "bytes_received": ["bytes_received", "recv_bytes", "download_bytes", "in_bytes", "bytes_in"],
    "packets": ["packets", "packet_count", "num_packets", "pkt_count"],
    "duration": ["duration", "session_duration", "flow_duration", "conn_duration"],
    "flags": ["flags", "tcp_flags", "flag"],
    "action": ["action", "event_action", "disposition", "result", "status"],
    "direction": ["direction", "flow_direction", "dir"],
    "domain": ["domain", "hostname", "host", "dns_query", "url"],
}

# Names of each field in JSON records, by priority.
JSON_NAMES = {
    "timestamp": ["timestamp", "time", "datetime", "event_time"],
    "src_ip": ["src_ip", "source_ip", "src"],
    "dst_ip": ["dst_ip", "dest_ip", "dst"],
    "src_port": ["src_port", "source_port"],
    "dst_port": ["dst_port", "dest_port"],
    "protocol": ["protocol", "proto"],
    "bytes_sent": ["bytes_sent", "out_bytes"],
    "bytes_received": ["bytes_received", "in_bytes"],
    "packets": ["packets", "packet_count"],
    "duration": ["duration", "flow_duration"],
    "flags": ["flags", "tcp_flags"],
    "action": ["action", "disposition"],
    "status_code": ["status_code", "http_status"],
    "direction": ["direction"],
    "domain": ["domain", "hostname"],
}

TEXT_DEFAULTS = {
    "src_ip": "0.0.0.0", "dst_ip": "0.0.0.0", "protocol": "UNKNOWN", "flags": "", "action": "",
    "direction": "unknown", "domain": "",
}
NUMBER_DEFAULTS = {
    "src_port": ("int", 0), "dst_port": ("int", 0), "bytes_sent": ("bigint", 0), "bytes_received": ("bigint", 0),
    "packets": ("bigint", 1), "duration": ("double", 0.0),
}
UPPER, LOWER = {"protocol"}, {"action", "direction"}

# What became of an input record. Skipped records are neither flows nor errors.
ACCEPTED, REJECTED, SKIPPED = "accepted", "rejected", "skipped"

PARSED_COLUMNS = [
    "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes_sent", "bytes_received", "packets",
    "duration", "flags", "action", "status_code", "direction", "domain", "raw_log", "metadata",
    "status", "source_file", "source_block", "source_row",
]

# Month abbreviations in order.
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"

CLOCK = r"\d{1,2}:\d{1,2}:\d{1,2}"
DAY_TIME = rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}( {CLOCK}(\.\d{{1,6}})?|T{CLOCK}(\.\d{{1,6}})?Z?)$"
SLASH_DAY_TIME = rf"^\d{{4}}/\d{{1,2}}/\d{{1,2}} {CLOCK}$"
YEARLESS = rf"^([A-Za-z]{{3}}) (\d{{1,2}}) ({CLOCK})$"
NAMED_MONTH = rf"^(\d{{1,2}})/([A-Za-z]{{3}})/(\d{{4}}):({CLOCK})$"
# ISO 8601 day, time and offset, with or without separators; more than six digits of a second are cut.
ISO = r"^(\d{4})(-?)(\d{2})\2(\d{2})(?:[T ](\d{2})(?:(:?)(\d{2})(?:\6(\d{2})(?:[.,](\d{1,6})\d*)?)?)?)?(Z|[+-]\d{2}(?::?\d{2})?)?$"


# The characters that count as white space around a value.
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.btrim(text, F.lit(WHITE))


def plain_stamp(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def parse_timestamp(stamp: Column, default_year: int) -> Column:
    """TIMESTAMP_NTZ of a ``plain_stamp`` in any accepted layout, else null.

    Every layout is brought into ISO form as text and cast once, so the session time zone
    plays no part. A stamp without a year gets ``default_year``; an offset other than UTC
    is converted to UTC.
    """

    def part(pattern: str, number: int) -> Column:
        return F.regexp_extract(stamp, pattern, number)

    def month(name: Column) -> Column:
        place = F.position(F.initcap(name), F.lit(MONTHS))
        return F.when(place % 3 == 1, F.floor((place + 2) / 3).cast("string"))

    iso = (
        F.when(stamp.rlike(DAY_TIME), F.rtrim(stamp, F.lit("Z")))
        .when(stamp.rlike(SLASH_DAY_TIME), F.replace(stamp, F.lit("/"), F.lit("-")))
        .when(stamp.rlike(YEARLESS), F.concat(
            F.lit(f"{default_year}-"), month(part(YEARLESS, 1)), F.lit("-"), part(YEARLESS, 2), F.lit(" "),
            part(YEARLESS, 3)))
        .when(stamp.rlike(NAMED_MONTH), F.concat(
            part(NAMED_MONTH, 3), F.lit("-"), month(part(NAMED_MONTH, 2)), F.lit("-"), part(NAMED_MONTH, 1),
            F.lit(" "), part(NAMED_MONTH, 4)))
    )
    # One pass of the pattern gives the ten parts; they are bound once.
    parts = F.split(F.regexp_replace(stamp, ISO, "\u0001".join(f"${i}" for i in range(1, 11))), "\u0001")
    to_utc = F.get(F.transform(F.array(parts), _utc), F.lit(0))
    return F.coalesce(iso.try_cast("timestamp_ntz"), F.when(stamp.rlike(ISO), to_utc))


def _utc(parts: Column) -> Column:
    """The moment that the groups of ISO tell."""

    def piece(number: int, missing: str = "") -> Column:
        value = F.get(parts, F.lit(number - 1))
        return F.when(value == "", missing).otherwise(value) if missing else value

    local = F.concat(
        piece(1), F.lit("-"), piece(3), F.lit("-"), piece(4), F.lit(" "), piece(5, "00"), F.lit(":"), piece(7, "00"),
        F.lit(":"), piece(8, "00"), F.lit("."), piece(9, "0"),
    ).try_cast("timestamp_ntz")
    offset = F.replace(F.substring(piece(10), 2, 5), F.lit(":"), F.lit(""))
    hours, minutes = F.substring(offset, 1, 2).try_cast("int"), F.coalesce(F.substring(offset, 3, 2).try_cast("int"), F.lit(0))
    east = F.when(piece(10).startswith("-"), -1).otherwise(1)
    zero = F.lit(0)
    shift = F.when(offset == "", zero).when((hours < 24) & (minutes < 60), (hours * 60 + minutes) * east)
    return local - F.make_dt_interval(zero, zero, shift, zero.cast("decimal(18,6)"))


def text_fields() -> list[Column]:
    """f_ columns as text fields, with case rules and defaults."""
    columns = []
    for field, default in TEXT_DEFAULTS.items():
        text = F.coalesce(f"f_{field}", F.lit(default))
        text = F.upper(text) if field in UPPER else F.lower(text) if field in LOWER else text
        columns.append(text.alias(field))
    return columns


def number_fields() -> list[Column]:
    """n_ columns as number fields, with defaults."""
    return [
        F.coalesce(f"n_{field}", F.lit(default).cast(kind)).alias(field)
        for field, (kind, default) in NUMBER_DEFAULTS.items()
    ]


def computed_once(rows: DataFrame, columns: list[Column | str]) -> DataFrame:
    """Select ``columns`` so that later filters and projections do not repeat their work.

    The optimizer copies expressions into every filter above them; it does not do so
    across a generator.
    """
    return rows.select(F.explode(F.array(F.struct(*columns))).alias("_r")).select("_r.*")


def place_columns() -> list[Column]:
    """Where a record stands: file, block start and a number that grows within the block."""
    return [
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("source_block"),
        F.monotonically_increasing_id().alias("source_row"),
    ]
