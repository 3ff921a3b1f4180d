"""Records that go on over line ends, put together in files that stay split.

Whether a line begins inside a quoted value depends on all lines before it. A line either leaves
that as it is, turns it round, or ends in any case outside. Each block of a file reports what its
lines do to either beginning; a running composition over the blocks (one row each) tells how each
block begins, and running sums within a block how each of its lines does. Lines are moved once, by
block; only records that cross a block's end meet the next block.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.durable import broadcast_if_small, durable

BLOCK = ["source_file", "source_block"]
# A record of more bytes is marked as too long, and only its beginning is kept: an open quote must not gather a file.
MOST_BYTES = 16 << 20


def block_beginnings(segments: DataFrame) -> DataFrame:
    """(source_file, source_block, begins_inside) from segments with ``source_row``, ``swaps`` and ``resets``."""
    event = F.when(F.col("swaps") | F.col("resets"), F.struct("source_row", "resets"))
    listed = segments.groupBy(*BLOCK).agg(F.sort_array(F.collect_list(event)).alias("events"))
    # What becomes of a beginning outside (o) and inside (i).
    step = lambda s, e: F.when(e["resets"], F.struct(F.lit(0).alias("o"), F.lit(0).alias("i"))).otherwise(F.struct((1 - s["o"]).alias("o"), (1 - s["i"]).alias("i")))
    done = listed.select(*BLOCK, F.aggregate("events", F.struct(F.lit(0).alias("o"), F.lit(1).alias("i")), step).alias("f"))
    fixed = F.col("f.o") == F.col("f.i")
    file = Window.partitionBy("source_file").orderBy("source_block")
    blocks = done.withColumn("era", F.sum(fixed.cast("int")).over(file))
    # In an era, its first block's end (or the file's beginning) and the turns since.
    own = F.when(fixed, F.col("f.o")).otherwise((F.col("f.o") == 1).cast("int"))
    blocks = blocks.withColumn("after", F.sum(own).over(Window.partitionBy("source_file", "era").orderBy("source_block")) % 2)
    return durable(blocks.select(*BLOCK, F.coalesce(F.lag("after").over(file), F.lit(0)).alias("begins_inside")), "block_beginnings")


def with_inside(segments: DataFrame) -> DataFrame:
    """``segments`` with ``inside``: 1 where a segment begins inside a quoted value, else 0."""
    whole = Window.partitionBy(*BLOCK).orderBy("source_row")
    upto, before = whole.rowsBetween(Window.unboundedPreceding, 0), whole.rowsBetween(Window.unboundedPreceding, -1)
    joined = segments.join(broadcast_if_small(block_beginnings(segments)), BLOCK)
    swaps = F.col("swaps").cast("int")
    counted = joined.withColumn("_upto", F.sum(swaps).over(upto)).withColumn("_last", F.max(F.when(F.col("resets"), F.col("_upto"))).over(before))
    so_far = F.col("_upto") - swaps
    return counted.withColumn("inside", F.pmod(F.coalesce(so_far - F.col("_last"), so_far + F.col("begins_inside")), F.lit(2))).drop("_upto", "_last", "begins_inside")


def records(segments: DataFrame, separator: str) -> DataFrame:
    """(source_file, source_block, source_row, value, too_long): records of segments with ``value`` and ``begins``
    (whether a record begins with the segment), joined by ``separator``; a record is where it begins.
    """
    order = Window.partitionBy(*BLOCK).orderBy("source_row").rowsBetween(Window.unboundedPreceding, 0)
    size = F.octet_length("value") + len(separator)
    counted = segments.withColumn("_record", F.sum(F.col("begins").cast("int")).over(order)).withColumn("_end", F.sum(size.cast("long")).over(order))
    counted = counted.withColumn("_length", F.col("_end") - F.coalesce(F.max(F.when(F.col("begins"), F.col("_end") - size)).over(order), F.lit(0)))
    kept = F.when((F.col("_length") <= MOST_BYTES) | F.col("begins"), F.struct("source_row", "value"))
    parts = counted.groupBy(*BLOCK, "_record").agg(F.sort_array(F.collect_list(kept)).alias("lines"), F.max("_length").alias("length"), F.min("source_row").alias("source_row"))
    parts = durable(parts.select(*BLOCK, "source_row", "_record", "length", F.array_join(F.col("lines.value"), separator).alias("value")), "record_parts")
    # Part 0 of a block belongs to the last record of the blocks before.
    file = Window.partitionBy("source_file").orderBy("source_block").rowsBetween(Window.unboundedPreceding, -1)
    last = parts.groupBy(*BLOCK).agg(F.max("_record").alias("last"))
    owner = F.last(F.when(F.col("last") > 0, F.struct(F.col("source_block").alias("block"), F.col("last").alias("record"))), ignorenulls=True).over(file)
    owners = durable(last.select(*BLOCK, owner.alias("owner")), "owners")
    heads = parts.where("_record = 0").join(broadcast_if_small(owners), BLOCK).where("owner IS NOT NULL")
    heads = durable(heads.select("source_file", F.col("owner.block").alias("_block"), F.col("owner.record").alias("_record"), "source_block", "length", "value"), "heads")
    split = durable(heads.select("source_file", F.col("_block").alias("source_block"), "_record").distinct(), "split_records")
    alone = parts.where("_record > 0").join(broadcast_if_small(split), [*BLOCK, "_record"], "left_anti")
    tails = parts.join(broadcast_if_small(split), [*BLOCK, "_record"], "left_semi").select("source_file", F.col("source_block").alias("_block"), "_record", "source_block", "length", "value", "source_row")
    pieces = heads.withColumn("source_row", F.lit(None).cast("bigint")).unionByName(tails)
    text = F.when(F.sum("length").over(Window.partitionBy("source_file", "_block", "_record").orderBy("source_block")) <= MOST_BYTES, F.col("value"))
    pieces = pieces.withColumn("value", F.when(F.col("source_row").isNotNull(), F.col("value")).otherwise(text))
    joined = pieces.groupBy("source_file", "_block", "_record").agg(
        F.max("source_row").alias("source_row"), F.sum("length").alias("length"),
        F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("source_block", "value")))).alias("lines"),
    ).select("source_file", F.col("_block").alias("source_block"), "source_row", F.array_join(F.col("lines.value"), separator).alias("value"), "length")
    found = alone.select(*BLOCK, "source_row", "value", "length").unionByName(joined)
    return found.select(*BLOCK, "source_row", "value", (F.col("length") > MOST_BYTES + len(separator)).alias("too_long"))

