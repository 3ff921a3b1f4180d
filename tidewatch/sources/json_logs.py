"""JSON logs: one object per line, or one array per file.

An array file is cut at closing braces, whatever its lines, and stays split: running sums over its
segments tell which begin inside a string and how deep, and an item ends where the depth is one again.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.durable import broadcast_if_small, durable
from tidewatch.sources import framing
from tidewatch.sources import layout as lo
from tidewatch.sources.files import escaped, formats, plain


def read_json(spark: SparkSession, paths: list[str], default_year: int, arrays: bool | None = None) -> DataFrame:
    """All records of the given files with their status.

    ``arrays`` tells whether the files hold one array each; if None, the first line of
    each file is looked at. Files of either kind are split freely. A document that is no array
    (not closed, or with something else than one comma between items) is one rejected record; an
    item that is no JSON is one, too.
    """
    if arrays is None:
        kinds = formats(spark, paths) if paths else {}
        whole = [path for path, kind in kinds.items() if kind == "json_array"]
        lines = [path for path in kinds if path not in set(whole)]
    else:
        whole, lines = (list(paths), []) if arrays else ([], list(paths))
    parts = []
    if lines:
        text = spark.read.text(lines).select("value", *lo.place_columns())
        text = text.withColumn("value", _clean("value"))
        parts.append(records(text.where("value <> ''"), default_year))
    if whole:
        items, broken = _items(spark, whole)
        parts.append(records(items, default_year))
        if broken:
            text = spark.read.text(broken, wholetext=True).select(_clean("value").alias("value"), *lo.place_columns())
            parts.append(records(text.where("value <> ''"), default_year))
    if not parts:
        from tidewatch.sources.ingest import PARSED_DDL

        return spark.createDataFrame([], PARSED_DDL)
    return reduce(DataFrame.unionByName, parts)


# Within or after a text without escapes: a whole string, or one that is not closed.
STRING = r'(?s)"(?:[^"\\]|\\.)*+(?:"|$)'


def _items(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """The items of array files (``value`` and the place columns), and the files that hold no array."""
    segments = spark.read.option("lineSep", "}").text(paths).select("value", *lo.place_columns())
    quotes = F.regexp_replace("value", r"(?s)[^\\\"]|\\.", "")
    marked = framing.with_inside(segments.select("*", (F.length(quotes) % 2 == 1).alias("swaps"), F.lit(False).alias("resets")))
    bare = F.regexp_replace(F.concat(F.when(F.col("inside") == 1, '"').otherwise(""), "value"), STRING, "")
    count = lambda characters: F.length(F.regexp_replace(bare, f"[^{characters}]", ""))
    closes = ((F.col("inside") + F.col("swaps").cast("int")) % 2 == 0).cast("int")
    stored = durable(marked.select(*framing.BLOCK, "source_row", "value", "inside", (count(r"{\[") - count(r"}\]") - closes).alias("deeper"), closes.alias("closes")), "segments")

    file, inner = Window.partitionBy("source_file").orderBy("source_block"), Window.partitionBy(*framing.BLOCK).orderBy("source_row")
    before = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    blocks = stored.groupBy(*framing.BLOCK).agg(F.sum("deeper").alias("deeper"))
    starts = durable(blocks.select(*framing.BLOCK, F.coalesce(F.sum("deeper").over(before(file)), F.lit(0)).alias("depth")), "depths")
    deep = stored.join(broadcast_if_small(starts), framing.BLOCK)
    depth = F.col("depth") + F.coalesce(F.sum("deeper").over(before(inner)), F.lit(0))
    begins = (F.col("inside") == 0) & (depth <= 1)
    found = durable(framing.records(deep.withColumn("begins", begins), "}"), "items")

    # What follows the last brace of a file is no item; a file's other records end with a brace.
    place = F.struct("source_block", "source_row")
    ends = found.groupBy("source_file").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    sums = stored.groupBy("source_file").agg(F.sum("deeper").alias("deeper"), F.max_by("closes", place).alias("closes"))
    files = durable(ends.join(sums, "source_file"), "array_files")
    told = found.join(broadcast_if_small(files), "source_file").select(*framing.BLOCK, "source_row", "value", "deeper", "closes", "too_long", (place == F.col("first")).alias("is_first"), (place == F.col("last")).alias("is_last"))
    text = _clean("value")
    ended = F.when(F.col("is_last"), F.when(text.endswith("]"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)).otherwise(F.concat(text, F.lit("}")))
    body = F.trim(F.substring(ended, F.lit(2), F.length(ended)))
    opened = F.when(F.col("is_first"), ended.startswith("[")).otherwise(ended.startswith(",") | (F.col("is_last") & (ended == "")))
    bad = ~opened | (F.col("is_last") & (~text.endswith("]") | (F.col("deeper") + F.col("closes") != 0) | (F.col("closes") == 0) | (ended.startswith(",") & (lo.strip(body) == ""))))
    told = durable(told.select(*framing.BLOCK, "source_row", body.alias("body"), (lo.strip(text) == "").alias("blank"), bad.alias("bad")), "item_texts")
    broken = durable(told.where("bad").select("source_file").distinct(), "broken_arrays")
    good = told.join(broadcast_if_small(broken), "source_file", "left_anti").where(lo.strip(F.col("body")) != "")
    # Items that are no objects have no brace and stand before the next one that is.
    listed = F.from_json(F.concat(F.lit("["), "body", F.lit("]")), "array<string>")
    items = good.select(*framing.BLOCK, "source_row", F.explode(F.coalesce(listed, F.array("body"))).alias("item"))
    return items.select(*framing.BLOCK, "source_row", F.coalesce("item", F.lit("null")).alias("value")), [escaped(plain(r.source_file)) for r in broken.collect()]


def _clean(column: str) -> Column:
    return lo.strip(F.regexp_replace(column, "^\ufeff", ""))


# An upper-case letter (or an escape) inside a key.
UPPER_KEY = r'[\p{Lu}\\][^"]*"\s*:'


# Something other than a separator after a closing brace: perhaps more than one document.
MORE_AFTER_BRACE = r"\}\s*[^\s,\}\]]"

RECORD_DDL = ", ".join(
    [f"{name} VARIANT" for names in lo.JSON_NAMES.values() for name in names] + ["_corrupt_record STRING"]
)


def _lower_keys(record: Column) -> Column:
    """The text of an object with lower-case keys; of keys that become equal the last one counts."""
    entries = F.map_entries(record.cast("map<string,variant>"))
    lowered = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    keys = F.transform(lowered, lambda e: e["key"])
    last = F.filter(lowered, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    unique = F.when(F.size(F.array_distinct(keys)) == F.size(keys), lowered).otherwise(last)
    return F.to_json(F.map_from_entries(unique))


def records(rows: DataFrame, default_year: int) -> DataFrame:
    """Parsed columns of rows that carry one record each as text in ``value``."""
    text = F.when(
        F.col("value").rlike(UPPER_KEY) & F.ltrim("value").startswith("{"),
        _lower_keys(F.try_parse_json("value")),
    ).otherwise(F.col("value"))
    rows = rows.select(
        "value", "source_file", "source_block", F.col("source_row").cast("bigint").alias("source_row"),
        text.alias("text"),
    )
    # All names in one pass over the text. Absent names are null, JSON nulls are not.
    rows = lo.computed_once(rows, [
        "value", "source_file", "source_block", "source_row",
        F.from_json("text", RECORD_DDL, {"allowSingleQuotes": "false"}).alias("record"),
        (F.col("text").rlike(MORE_AFTER_BRACE) & F.try_parse_json(F.concat(F.lit("["), "text", F.lit("]"))).isNull())
        .alias("has_more"),
    ])

    def path(name: str, kind: str) -> Column:
        return F.try_variant_get(f"record.{name}", "$", kind)

    def pick(field: str) -> Column:
        # The first name that is present counts, even if its value is null.
        return F.coalesce(*[F.col(f"record.{name}") for name in lo.JSON_NAMES[field]])

    def truthy(name: str) -> Column:
        value = path(name, "string")
        return F.when(~value.isin("", "0", "false"), value)

    picked = rows.select(
        "value", "source_file", "source_block", "source_row",
        (F.col("record").isNotNull() & F.col("record._corrupt_record").isNull() & ~F.col("has_more")).alias("is_record"),
        lo.plain_stamp(F.coalesce(*[truthy(name) for name in lo.JSON_NAMES["timestamp"]])).alias("stamp"),
        *[F.try_variant_get(pick(field), "$", "string").alias(f"f_{field}") for field in lo.TEXT_DEFAULTS],
        *[pick(field).alias(f"v_{field}") for field in lo.NUMBER_DEFAULTS],
        F.coalesce(*[truthy(n) for n in lo.JSON_NAMES["status_code"]]).try_cast("int").alias("status_code"),
    )
    number_types = lo.NUMBER_DEFAULTS.items()
    parsed = lo.computed_once(picked, [
        "value", "source_file", "source_block", "source_row", "is_record", "status_code",
        *[f"f_{field}" for field in lo.TEXT_DEFAULTS],
        *[f"v_{field}" for field in lo.NUMBER_DEFAULTS],
        *[F.try_variant_get(f"v_{field}", "$", kind).alias(f"n_{field}") for field, (kind, _) in number_types],
        lo.parse_timestamp(F.col("stamp"), default_year).alias("ts"),
    ])
    bad_number = reduce(lambda a, b: a | b, [
        F.col(f"v_{field}").isNotNull() & F.col(f"n_{field}").isNull() for field in lo.NUMBER_DEFAULTS
    ])
    return parsed.select(
        "ts", *lo.text_fields(), *lo.number_fields(), "status_code", F.col("value").alias("raw_log"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        F.when(~F.col("is_record"), lo.REJECTED).when(F.col("ts").isNull(), lo.SKIPPED)
        .when(bad_number, lo.REJECTED).otherwise(lo.ACCEPTED).alias("status"),
        "source_file", "source_block", "source_row",
    ).select(lo.PARSED_COLUMNS)
