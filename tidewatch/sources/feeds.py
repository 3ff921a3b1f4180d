"""Threat feed files as one table (kind, indicator)."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.layout import strip


def read_feed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One indicator per line; blank lines and lines that start with # are left out."""
    lines = spark.read.text(path)
    entry = F.lower(strip(F.col("value")))
    return lines.where((entry != "") & ~F.col("value").startswith("#")).select(
        F.lit(kind).alias("kind"), entry.alias("indicator")
    ).distinct()


def read_feeds(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``paths`` maps each kind to its file; kinds without one simply have no entries."""
    if not paths:
        return spark.createDataFrame([], "kind STRING, indicator STRING")
    return reduce(DataFrame.unionByName, [read_feed(spark, path, kind) for kind, path in paths.items()])
