"""Running totals that stay balanced when one key holds most of the rows.

``Window.partitionBy(key)`` sends all rows of a key to one task. Here the rows are
range partitioned by (key, order) instead, so a heavy key is cut into as many chunks
as it needs and even rows with equal time stamps can be split. Running totals are
computed inside each chunk; what earlier chunks of the same key add up to is a table
with at most two rows per chunk, which is broadcast back.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.durable import durable

CHUNK = "chunk"

# A table with at most this many rows needs no chunks: not even one key that holds all of
# them is too much for a task.
ONE_TASK_ROWS = 1_000_000

# The range bounds of more chunks than this would burden the driver; chunks grow instead.
MOST_CHUNKS = 20_000


def chunked_if_large(df: DataFrame, source_rows: int, keys: list[str], order: list[str],
                     chunks: int | None = None) -> DataFrame:
    """``cut_into_chunks`` unless the table ``df`` comes from is small (or ``chunks`` is given)."""
    if chunks is None:
        if source_rows <= ONE_TASK_ROWS:
            return df
        chunks = min(-(-source_rows // ONE_TASK_ROWS), MOST_CHUNKS)
    return cut_into_chunks(df, keys, order, chunks)


def cut_into_chunks(df: DataFrame, keys: list[str], order: list[str], chunks: int) -> DataFrame:
    """Tag each row with the chunk it falls into; chunks are contiguous in (keys, order).

    ``order`` must make rows unique, or equal rows would not be split.
    """
    ranged = df.repartitionByRange(chunks, *[F.col(c) for c in (*keys, *order)])
    return durable(ranged.withColumn(CHUNK, F.spark_partition_id()), "chunks")


def running(
    chunked: DataFrame,
    keys: list[str],
    order: list[str],
    totals: dict[str, str],
    upcoming: dict[str, str] | None = None,
) -> DataFrame:
    """Add running sums and look-ahead minima to the result of ``chunked_if_large``.

    ``totals`` maps a new column to the column whose sum up to and including the row it
    holds. ``upcoming`` maps a new column to the column whose minimum over the rows
    strictly after this one it holds (nulls are ignored).
    """
    upcoming = upcoming or {}
    one_chunk = CHUNK not in chunked.columns
    group = list(keys) if one_chunk else [CHUNK, *keys]
    forward = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    backward = (
        Window.partitionBy(*group)
        .orderBy(*[F.col(c).desc() for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = chunked.select(
        "*",
        *[F.sum(column).over(forward).alias(name) for name, column in totals.items()],
        *[F.min(column).over(backward).alias(name) for name, column in upcoming.items()],
    )
    if one_chunk:
        return local

    # One row per (chunk, key); a key spans many chunks only if it is large, and then
    # all chunks between its first and its last hold nothing else.
    parts = chunked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(column).alias(f"_part_{name}") for name, column in totals.items()],
        *[F.min(column).alias(f"_part_{name}") for name, column in upcoming.items()],
    )
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    later = (
        Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        parts.select(
            *group,
            F.count("*").over(Window.partitionBy(*keys)).alias("_spans"),
            *[F.sum(f"_part_{name}").over(earlier).alias(f"_carry_{name}") for name in totals],
            *[F.min(f"_part_{name}").over(later).alias(f"_carry_{name}") for name in upcoming],
        )
        .where("_spans > 1")
        .drop("_spans")
    )
    joined = local.join(F.broadcast(carried), group, "left")
    kept = [F.col(c) for c in chunked.columns]
    return joined.select(
        *kept,
        *[(F.col(n) + F.coalesce(F.col(f"_carry_{n}"), F.lit(0))).alias(n) for n in totals],
        *[F.least(F.col(n), F.col(f"_carry_{n}")).alias(n) for n in upcoming],
    )
