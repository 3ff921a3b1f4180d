"""Watching a directory: the same parsing and matching as a stream of files."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.durable import fresh_path
from tidewatch.functions import network as net
from tidewatch.functions.clock import from_micros, micros, window_micros
from tidewatch.sources import csv_logs, json_logs, syslog
from tidewatch.sources.ingest import accepted
from tidewatch.sources.layout import strip

# The file names that belong to each format.
NAMES = {"csv": "*.csv", "json": "*.json", "syslog": "*.{log,syslog,txt}"}


def watch_records(spark: SparkSession, directory: str, format: str, default_year: int,
                  max_files: int | None = None, header: list[str] | None = None, multiline: bool = True) -> DataFrame:
    """A stream of parsed records from new files: syslog lines, one JSON object per line, or CSV.

    Rejected records stay beside the accepted ones; ``ingest.accepted`` and ``ingest.rejected`` tell them
    apart. Only files with a suffix of the format are taken. CSV files must all have the column names
    ``header``. Their quoted values may hold line breaks, so a file is one task; without
    ``multiline`` large files are split, and a line break ends a record.
    """
    reader = spark.readStream.option("pathGlobFilter", NAMES[format])
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    place = [
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("source_block"),
        F.lit(None).cast("bigint").alias("source_row"),
    ]
    if format == "csv":
        if not header:
            raise ValueError("a stream of CSV files needs their header")
        names = csv_logs.normal(header)
        raw = reader.schema(csv_logs.text_schema(names)).options(**csv_logs.OPTIONS, multiLine=multiline).csv(directory)
        return csv_logs.rows(raw.select("*", F.lit(False).alias("too_long"), *place), names, default_year)
    text = reader.format("text").load(directory).select("value", *place)
    if format == "json":
        return json_logs.records(text.where(strip(F.col("value")) != ""), default_year)
    return syslog.lines(text, default_year)


def watch_flows(spark: SparkSession, directory: str, format: str, default_year: int,
                max_files: int | None = None, header: list[str] | None = None, multiline: bool = True) -> DataFrame:
    """The accepted records of ``watch_records``, as a stream of flows."""
    return accepted(watch_records(spark, directory, format, default_year, max_files, header, multiline)).drop("status")


def tumbling_totals(flows: DataFrame, width_s: float = 3600) -> DataFrame:
    """Events and bytes per time window (counted from 1970-01-01 00:00, in no time zone) and protocol."""
    width = window_micros(width_s)
    t = micros(F.col("ts"))
    stamped = flows.withColumn("_start", t - F.pmod(t, F.lit(width)))
    totals = stamped.groupBy("_start", "protocol").agg(F.count("*").alias("events"), F.sum(net.total_bytes()).alias("bytes"))
    return totals.select(from_micros("_start").alias("window_start"), "protocol", "events", "bytes")


def run_available(stream: DataFrame, output: str, mode: str = "append", checkpoint: str | None = None,
                  each: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Process what is there and stop. ``each`` is applied to every batch; a repeated batch overwrites its own folder only."""
    def write_batch(batch: DataFrame, number: int) -> None:
        (batch if each is None else each(batch)).write.mode("overwrite").parquet(f"{output}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint or fresh_path(stream.sparkSession, "stream"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def run_totals(flows: DataFrame, output: str, width_s: float = 3600, checkpoint: str | None = None) -> StreamingQuery:
    """Totals of each batch on its own. They add up, so no row is too late and no state is kept."""
    return run_available(flows, output, checkpoint=checkpoint, each=lambda batch: tumbling_totals(batch, width_s))


def latest_totals(spark: SparkSession, output: str) -> DataFrame:
    """The sums over all batches that ``run_totals`` has written."""
    return spark.read.parquet(output).groupBy("window_start", "protocol").agg(
        F.sum("bytes").alias("bytes"), F.sum("events").alias("events")
    )
