"""CSV flow logs with varying headers."""

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.durable import broadcast_if_small, durable
from tidewatch.sources import framing
from tidewatch.sources import layout as lo
from tidewatch.sources.files import broken_files, headers, odd_quotes, plain, readable

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, paths: list[str], default_year: int,
             header: list[str] | None = None, multiline: bool | None = None) -> DataFrame:
    """All records of the given files with their status.

    Files are grouped by header, and each group is one native scan. Pass ``header`` if
    all files share a known one; else the first line of each file is looked up.
    ``multiline`` tells whether quoted values may contain line breaks; such files stay split, their
    records are put together by ``framing``. If None, a pass over the lines finds the files that
    have such values.
    """
    if not paths:
        return _empty(spark)
    if multiline is None:
        lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value")
        broken = set(broken_files(lines))
    if header is not None:
        # Paths may be folders or patterns, so their files are looked up if they have to be told apart.
        files = [readable(spark, f) for f in map(plain, spark.read.text(paths).inputFiles())] if multiline is None and broken else paths
        named = dict.fromkeys(files, tuple(normal(header)))
    else:
        named = {path: tuple(normal(next(csv.reader([line.rstrip("\r")])))) for path, line in headers(spark, paths).items()}
    groups: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for path, names in named.items():
        groups.setdefault((names, path in broken if multiline is None else multiline), []).append(path)
    if not groups:
        return _empty(spark)
    return reduce(DataFrame.unionByName, [
        _read_group(spark, files, list(names), default_year, whole) for (names, whole), files in sorted(groups.items())
    ])


def normal(names: list[str]) -> list[str]:
    return [name.strip().lower() for name in names]


def _empty(spark: SparkSession) -> DataFrame:
    from tidewatch.sources.ingest import PARSED_DDL

    return spark.createDataFrame([], PARSED_DDL)


def text_schema(names: list[str]) -> str:
    """Every column as text, by number, and Spark's mark of odd records."""
    return ", ".join([*(f"c{i} STRING" for i in range(len(names))), f"{CORRUPT} STRING"])


OPTIONS = {
    "header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": '"', "enforceSchema": True,
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": "", "maxCharsPerColumn": -1,
}


def _read_group(spark: SparkSession, files: list[str], names: list[str], default_year: int,
                multiline: bool) -> DataFrame:
    if multiline:
        return rows(_framed(spark, files, names), names, default_year)
    raw = spark.read.schema(text_schema(names)).options(**OPTIONS).csv(files)
    return rows(raw.select("*", F.lit(False).alias("too_long"), *lo.place_columns()), names, default_year)


# A line that, beginning outside quotes, ends inside: complete values, then one whose quote stays open.
OPENS = r'^(?:(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+)?,)*+"(?:[^"]|"")*+$'


def _framed(spark: SparkSession, files: list[str], names: list[str]) -> DataFrame:
    """Rows as Spark's own reader gives them, of files whose quoted values may hold line breaks."""
    lines = spark.read.option("lineSep", "\n").text(files).select("value", *lo.place_columns())
    odd = odd_quotes(F.col("value"))
    opens = F.col("value").rlike(OPENS)
    # A stray quote in a value that is not quoted opens nothing, but it may close.
    marked = lines.select("*", (odd & opens).alias("swaps"), (odd & ~opens).alias("resets"))
    found = framing.records(framing.with_inside(marked).withColumn("begins", F.col("inside") == 0), "\n")
    text = F.regexp_replace(F.replace("value", F.lit("\r\n"), F.lit("\n")), "\r$", "")
    found = found.withColumn("value", text).where(lo.strip(F.col("value")) != "")
    # A file's first record is its header.
    heads = durable(found.groupBy("source_file").agg(F.min(F.struct("source_block", "source_row")).alias("place")), "header_places")
    heads = heads.select("source_file", "place.*")
    body = found.join(broadcast_if_small(heads), ["source_file", "source_block", "source_row"], "left_anti")
    options = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in OPTIONS.items() if k not in ("header", "enforceSchema")}
    return body.select(F.from_csv("value", text_schema(names), options).alias("r"), "source_file", "source_block", "source_row", "too_long").select(
        "r.*", "source_file", "source_block", "source_row", "too_long"
    )


def rows(raw: DataFrame, names: list[str], default_year: int) -> DataFrame:
    """Parsed columns of rows read with ``text_schema`` that have ``too_long`` and the place columns; also usable on a stream."""
    # With repeated names the last column counts.
    position = {name: i for i, name in enumerate(names)}
    fields = {
        field: [position[name] for name in aliases if name in position] for field, aliases in lo.CSV_NAMES.items()
    }
    found = raw.select(
        *[_first_text(places).alias(f"f_{field}") for field, places in fields.items()],
        lo.plain_stamp(_first_text(fields["timestamp"])).alias("stamp"),
        _misses_a_column(fields).alias("too_short"),
        F.to_json(F.struct(*[F.col(f"c{i}").alias(name) for name, i in position.items()])).alias("raw_log"),
        "source_file", "source_block", "source_row", "too_long",
    )
    number_types = lo.NUMBER_DEFAULTS.items()
    parsed = lo.computed_once(found, [
        "*", lo.parse_timestamp(F.col("stamp"), default_year).alias("ts"),
        *[lo.strip(F.col(f"f_{field}")).try_cast(kind).alias(f"n_{field}") for field, (kind, _) in number_types],
    ])
    bad_number = reduce(
        lambda a, b: a | b,
        [F.col(f"f_{field}").isNotNull() & F.col(f"n_{field}").isNull() for field in lo.NUMBER_DEFAULTS],
    )
    return parsed.select(
        "ts", *lo.text_fields(), *lo.number_fields(), F.lit(None).cast("int").alias("status_code"), "raw_log",
        F.create_map().cast("map<string,string>").alias("metadata"),
        # A record that ends before a column it needs is an error, even without a time stamp.
        F.when(F.col("too_short.ts") | F.col("too_long"), lo.REJECTED).when(F.col("ts").isNull(), lo.SKIPPED)
        .when(F.col("too_short.any") | bad_number, lo.REJECTED).otherwise(lo.ACCEPTED).alias("status"),
        "source_file", "source_block", "source_row",
    ).select(lo.PARSED_COLUMNS)


def _text(place: int) -> Column:
    value = lo.strip(F.col(f"c{place}"))
    return F.when(value != "", value)


def _first_text(places: list[int]) -> Column:
    return F.coalesce(*[_text(p) for p in places]) if places else F.lit(None).cast("string")


def _misses_a_column(fields: dict[str, list[int]]) -> Column:
    """Whether a looked-up column lies behind the end of a short record.

    Aliases are looked up until one has text. Only records that Spark marks (too short or
    too long) are examined, by counting the separators outside quotes.
    """
    plain = F.regexp_replace(CORRUPT, '"[^"]*"', "")
    width = F.length(plain) - F.length(F.replace(plain, F.lit(","), F.lit(""))) + 1

    def misses(places: list[int]) -> Column:
        result = F.lit(False)
        for place in reversed(places):
            result = F.when(width <= place, True).when(_text(place).isNotNull(), False).otherwise(result)
        return result

    marked = F.col(CORRUPT).isNotNull()
    anywhere = reduce(lambda a, b: a | b, [misses(p) for p in fields.values()])
    return F.struct(
        (marked & misses(fields["timestamp"])).alias("ts"), (marked & anywhere).alias("any")
    )
