"""From files to the flows table, with rejected records kept aside."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.durable import broadcast_if_small, durable
from tidewatch.schema import FLOWS_DDL
from tidewatch.sources import layout as lo
from tidewatch.sources.csv_logs import read_csv
from tidewatch.sources.files import SUFFIX_FORMATS, formats, list_files, readable, suffix_of
from tidewatch.sources.json_logs import read_json
from tidewatch.sources.syslog import read_syslog

PARSED_DDL = (
    FLOWS_DDL.removeprefix("event_id BIGINT, ")
    + ", raw_log STRING, metadata MAP<STRING,STRING>, status STRING,"
    " source_file STRING, source_block BIGINT, source_row BIGINT"
)
SOURCE_ORDER = ["source_file", "source_block", "source_row"]


def read_files(spark: SparkSession, paths: list[str], default_year: int, format: str | None = None,
               multiline: bool | None = None) -> DataFrame:
    """All records of the files.

    Without ``format`` it follows the suffix, and for other suffixes the first line.
    "auto" looks at the first line of every file. ``multiline`` is for CSV (see ``read_csv``).
    """
    groups: dict[str, list[str]] = {}
    unknown = []
    for path in paths:
        kind = format or SUFFIX_FORMATS.get(suffix_of(path), "auto")
        if kind == "auto":
            unknown.append(path)
        else:
            groups.setdefault(kind, []).append(path)
    arrays = {"json": None, "json_lines": False, "json_array": True}
    for path, kind in formats(spark, unknown).items():
        groups.setdefault("json_lines" if kind == "json" else kind, []).append(path)
    if not groups:
        return spark.createDataFrame([], PARSED_DDL)
    parts = []
    for kind, files in groups.items():
        if kind in arrays:
            parts.append(read_json(spark, files, default_year, arrays[kind]))
        elif kind == "csv":
            parts.append(read_csv(spark, files, default_year, multiline=multiline))
        else:
            parts.append(read_syslog(spark, files, default_year))
    return reduce(DataFrame.unionByName, parts)


def read_directory(spark: SparkSession, directory: str, default_year: int, multiline: bool | None = None) -> DataFrame:
    """All records of the log files directly inside a directory; other suffixes are left out.

    Names may hold any characters, also those of patterns, and start with _ or a dot.
    """
    return read_listed(spark, [path for path in list_files(spark, directory) if suffix_of(path) in SUFFIX_FORMATS], default_year, multiline)


def read_listed(spark: SparkSession, paths: list[str], default_year: int, multiline: bool | None = None) -> DataFrame:
    """All records of the files given, whose names are only names."""
    copies: dict[str, str] = {}
    parsed = read_files(spark, [readable(spark, path, copies) for path in paths], default_year, multiline=multiline)
    if not copies:
        return parsed
    own = F.create_map(*[F.lit(name) for pair in copies.items() for name in pair])
    return parsed.withColumn("source_file", F.coalesce(F.try_element_at(own, F.col("source_file")), F.col("source_file")))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("status") == lo.ACCEPTED)


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("status") == lo.REJECTED).select("raw_log", *SOURCE_ORDER)


def to_flows(parsed: DataFrame) -> DataFrame:
    """Accepted records as a written table by ``date``, with ``event_id`` growing by file name and line.

    Records are parsed and written once, without ids. They keep the order they have within their
    block; blocks are counted up, files first and then the blocks of each, and the ids are added
    as the table is written for good. Numbers of rejected records stay unused. What reads the
    result scans one table.
    """
    table = durable(accepted(parsed), "parsed")
    block = ["source_file", "source_block"]
    spans = table.groupBy(*block).agg(F.min("source_row").alias("_first"), F.max("source_row").alias("_last"))
    spans = durable(spans.withColumn("_length", F.col("_last") - F.col("_first") + 1), "blocks")
    # One row per file, as in Spark's own file index; the blocks of a file are counted up on their own.
    running = lambda *keys: (Window.partitionBy(*keys) if keys else Window).orderBy("source_block" if keys else "source_file").rowsBetween(Window.unboundedPreceding, -1)
    files = spans.groupBy("source_file").agg(F.sum("_length").alias("_total"))
    files = files.select("source_file", F.coalesce(F.sum("_total").over(running()), F.lit(0)).alias("_before"))
    within = spans.withColumn("_within", F.coalesce(F.sum("_length").over(running("source_file")), F.lit(0)))
    bases = within.join(files, "source_file").select(*block, (F.col("_before") + F.col("_within") - F.col("_first")).alias("_base"))
    numbered = table.join(broadcast_if_small(durable(bases, "bases")), block).select(
        (F.col("_base") + F.col("source_row")).alias("event_id"),
        *[c for c in parsed.columns if c not in ("status", *SOURCE_ORDER)], F.to_date("ts").alias("date"),
    )
    return durable(numbered, "flows", "date")


def quality(parsed: DataFrame) -> DataFrame:
    """One row: accepted and rejected records and their ratio as text."""
    counts = parsed.agg(
        F.count_if(F.col("status") == lo.ACCEPTED).alias("total_parsed"),
        F.count_if(F.col("status") == lo.REJECTED).alias("parse_errors"),
    )
    seen = F.col("total_parsed") + F.col("parse_errors")
    rate = F.when(seen > 0, F.format_string("%.1f%%", F.col("total_parsed") / seen * 100)).otherwise("N/A")
    return counts.withColumn("success_rate", rate)
