"""First moment at which a keyed sliding window meets a condition.

The window of a row reaches back ``window_s`` seconds, both ends included, and holds
only rows up to that row in (ts, event_id) order. Three steps:

1. A cheap pre-aggregate per (key, time cell as wide as the window) is combined before
   the shuffle: rows, sums, and distinct values as bits of longs, so that no value is moved.
   Whole numbers are counted exactly, a long for each 64 of them; of other values the row count
   bounds them from above, and the bits that their hashes set from below. A window lies within two
   neighbouring cells, so their totals bound it from above; a cell that is full on its own must
   fire by its last row, so no later cell of that key matters. Everything else is dropped before
   rows are moved: by a broadcast of the cells, or of a bitmap of their hashes where they are many.
2. Each remaining row adds its value at ts and takes it away again after ts + window.
   A distinct value counts from its first sighting until the window has passed since
   its last one.
3. Skew-proof running totals (``scan``) over these changes give count, sum and distinct
   count at every row, and the time at which the next row leaves gives the window start.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.durable import BROADCAST_BYTES, broadcast_if_small, by_key, bytes_of, durable
from tidewatch.functions.clock import cell_of, micros, window_micros
from tidewatch.operators.scan import chunked_if_large, running

Condition = Callable[[], Column]

# Columns the conditions may use: n rows, s sum of the value, d distinct values,
# t and start (microseconds of this row and of the first row in its window).
MEASURES = ["n", "s", "d"]
# Longs of bits for the values of a cell that are no whole numbers; bits of the filter over cells (half a million longs).
LONGS, FILTER_BITS = 4, 1 << 25
STEP_ORDER = ["t", "phase", "eid", "sub"]


def prepare(rows: DataFrame, keys: list[str], window_us: int, value: Column | None = None,
            distinct: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Key columns plus t, eid, v, x and cell."""
    value = F.lit(0).cast("bigint") if value is None else value
    x = F.lit(None).cast("string") if distinct is None else F.col(distinct)
    picked = rows.select(
        *keys, micros(F.col("ts")).alias("t"), F.col("event_id").alias("eid"),
        value.alias("v"), x.alias("x"), *[c for c in extra if c not in keys],
    )
    return picked.withColumn("cell", cell_of("t", window_us))


def cell_totals(points: DataFrame, keys: list[str], distinct: bool) -> DataFrame:
    """(keys, cell, n, s, d, least_d): rows, sum, and bounds of the distinct values of each cell, by one exchange of partial sums."""
    group = [*keys, "cell"]
    counts = (F.count("*").alias("n"), F.sum("v").alias("s"))
    if not distinct:
        return points.groupBy(*group).agg(*counts, F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("least_d"))
    one = F.lit(1).cast("bigint")
    if isinstance(points.schema["x"].dataType, T.IntegralType):
        # The bits of 64 neighbouring numbers; null is a value of its own.
        word, place = F.floor(F.col("x") / 64), F.pmod("x", F.lit(64)).cast("int")
        words = points.groupBy(*group, word.alias("_word")).agg(*counts, F.bit_or(F.coalesce(F.call_function("shiftleft", one, place), one)).alias("_bits"))
        exact = F.sum(F.bit_count("_bits").cast("bigint"))
        return words.groupBy(*group).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), exact.alias("d"), exact.alias("least_d"))
    place = F.pmod(F.xxhash64("x"), F.lit(64 * LONGS)).cast("int")
    bits = [F.bit_or(F.when(F.floor(place / 64) == i, F.call_function("shiftleft", one, place % 64)).otherwise(0)).alias(f"_b{i}") for i in range(LONGS)]
    cells = points.groupBy(*group).agg(*counts, *bits)
    least = sum((F.bit_count(f"_b{i}").cast("bigint") for i in range(LONGS)), F.lit(0).cast("bigint"))
    return cells.select(*group, "n", "s", F.col("n").alias("d"), least.alias("least_d"))


def cells_to_read(points: DataFrame, keys: list[str], distinct: bool, possible: Condition,
                  certain: Condition | None) -> DataFrame:
    """(keys, cell, fire): the cells whose rows are needed; ``fire`` marks those that may fire."""
    group = [*keys, "cell"]
    cells = cell_totals(points, keys, distinct)
    # At most one row per cell, so a key's group is bounded by the time span, not by its rows.
    line = Window.partitionBy(*keys).orderBy("cell")
    adjacent = F.lag("cell").over(line) == F.col("cell") - 1
    lower = cells.select(*group, "n", "s", F.col("least_d").alias("d"), F.col("d").alias("_most"))
    full = lower.withColumn("_full", F.lit(False) if certain is None else certain()).withColumn("d", F.col("_most"))
    marked = full.select(
        *group,
        F.min(F.when(F.col("_full"), F.col("cell"))).over(Window.partitionBy(*keys)).alias("stop"),
        *[(F.col(m) + F.when(adjacent, F.lag(m).over(line)).otherwise(0)).alias(m) for m in MEASURES],
    )
    firing = marked.select(
        *group,
        (possible() & (F.col("stop").isNull() | (F.col("cell") <= F.col("stop")))).alias("fire"),
    )
    before_firing = (F.lead("cell").over(line) == F.col("cell") + 1) & F.lead("fire").over(line)
    needed = firing.withColumn("_before", F.coalesce(before_firing, F.lit(False)))
    return needed.where("fire OR _before").drop("_before")


def rows_of_cells(points: DataFrame, needed: DataFrame, on: list[str], most: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``points`` in the (stored) cells of ``needed``, with its columns.

    Few cells are broadcast. Of many, a bitmap of their hashes is, at most FILTER_BITS of it: rows whose bit is
    not set go before anything is moved, and what is left meets the cells by key.
    """
    if bytes_of(needed) <= most:
        return points.join(F.broadcast(needed), on)
    place = F.pmod(F.xxhash64(*on), F.lit(FILTER_BITS))
    word, bit = F.expr("_place div 64"), F.expr("CAST(_place % 64 AS INT)")
    placed = needed.select(place.alias("_place"))
    words = durable(placed.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("_bits")), "cell-bits")
    near = points.withColumn("_place", place).withColumn("_word", word).join(F.broadcast(words), "_word")
    return near.where(F.getbit("_bits", bit) == 1).drop("_place", "_word", "_bits").join(by_key(needed), on)


def _row_steps(picked: DataFrame, keys: list[str], window_us: int) -> DataFrame:
    step = "struct({t} AS t, {phase} AS phase, {fire} AS fire, {dn}L AS dn, {ds} AS ds)"
    add = step.format(t="t", phase=0, fire="fire", dn=1, ds="v")
    remove = step.format(t=f"t + {window_us}L", phase=1, fire="false", dn=-1, ds="-v")
    return picked.select(*keys, "eid", F.expr(f"explode(array({add}, {remove}))").alias("_c")).select(
        *keys, "_c.t", "_c.phase", "eid", F.lit(1).alias("sub"), "_c.fire", "_c.dn", "_c.ds",
        F.lit(0).cast("bigint").alias("dd"),
    )


def _distinct_steps(picked: DataFrame, keys: list[str], window_us: int) -> DataFrame:
    seen = picked.groupBy(*keys, "x", "cell").agg(
        F.min(F.struct("t", "eid")).alias("first"), F.max("t").alias("last"), F.max("fire").alias("fire")
    )
    # Rows of one cell are less than a window apart, so (first, last) says it all; at most
    # one row per cell and value.
    line = Window.partitionBy(*keys, "x").orderBy("cell")
    edges = seen.select(
        *keys, "first", "last", "fire",
        F.lag("last").over(line).alias("earlier"), F.lead("first.t").over(line).alias("later"),
    )
    starts = F.col("earlier").isNull() | (F.col("first.t") - F.col("earlier") > window_us)
    ends = F.col("later").isNull() | (F.col("later") - F.col("last") > window_us)
    none = F.lit(None).cast("struct<t:bigint,phase:int,fire:boolean,dd:bigint>")
    steps = F.array(
        F.when(starts, F.struct(F.col("first.t").alias("t"), F.lit(0).alias("phase"),
                                F.col("fire").alias("fire"), F.lit(1).cast("bigint").alias("dd"))).otherwise(none),
        F.when(ends, F.struct((F.col("last") + window_us).alias("t"), F.lit(1).alias("phase"),
                              F.lit(False).alias("fire"), F.lit(-1).cast("bigint").alias("dd"))).otherwise(none),
    )
    zero = F.lit(0).cast("bigint")
    return edges.select(*keys, F.col("first.eid").alias("eid"), F.explode(steps).alias("_c")).where(
        "_c IS NOT NULL"
    ).select(
        *keys, "_c.t", "_c.phase", "eid", F.lit(0).alias("sub"), "_c.fire",
        zero.alias("dn"), zero.alias("ds"), F.col("_c.dd").alias("dd"),
    )


def first_hits(
    rows: DataFrame,
    keys: list[str],
    window_s: float,
    fires: Condition,
    possible: Condition,
    certain: Condition | None = None,
    *,
    value: Column | None = None,
    distinct: str | None = None,
    count_rows: bool = True,
    extra: tuple[str, ...] = (),
    chunks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """One row per key that fires: keys, t, eid, n, s, d, start; and the rows it was found in.

    ``possible`` sees the totals of two neighbouring cells, ``certain`` those of one cell and
    ``fires`` the exact window. With ``count_rows=False`` only the distinct count is followed.
    """
    window_us = window_micros(window_s)
    points = prepare(rows, keys, window_us, value, distinct, extra)
    # Stored before the join: if it were part of it, the whole input would be shuffled by key
    # before Spark could see how small this side is.
    needed = durable(cells_to_read(points, keys, distinct is not None, possible, certain), "cells")
    # Written once: the input is scanned twice in all, whatever happens below.
    picked = durable(rows_of_cells(points, needed, [*keys, "cell"]), "picked")
    if distinct is not None:
        steps = _distinct_steps(picked, keys, window_us)
        if count_rows:
            steps = steps.unionByName(_row_steps(picked, keys, window_us))
    else:
        steps = _row_steps(picked, keys, window_us)
    totals = {"n": "dn", "s": "ds", "d": "dd"}
    upcoming = {}
    if count_rows:
        steps = steps.withColumn("leaves", F.when((F.col("phase") == 1) & (F.col("sub") == 1), F.col("t")))
        upcoming = {"next_leaves": "leaves"}
    steps = chunked_if_large(steps, picked.count(), keys, STEP_ORDER, chunks)
    swept = running(steps, keys, STEP_ORDER, totals, upcoming)
    reading = swept.where(
        (F.col("phase") == 0) & F.col("fire") & (F.col("sub") == (1 if count_rows else 0))
    )
    start = (F.col("next_leaves") - window_us) if count_rows else F.lit(None).cast("bigint")
    hits = (
        reading.withColumn("start", start).where(fires())
        .groupBy(*keys).agg(F.min(F.struct("t", "eid", "n", "s", "d", "start")).alias("_h"))
        .select(*keys, "_h.*")
    )
    return hits, picked


def rows_in_window(hits: DataFrame, picked: DataFrame, keys: list[str], window_s: float) -> DataFrame:
    """The rows of each (stored) hit's window (joined by time cell, so one busy key is split up)."""
    window_us = window_micros(window_s)
    end = broadcast_if_small(hits).select(*keys, F.col("t").alias("hit_t"), F.col("eid").alias("hit_eid"))
    end = end.withColumn("_own", cell_of("hit_t", window_us))
    end = end.withColumn("cell", F.explode(F.array(F.col("_own"), F.col("_own") - 1))).drop("_own")
    inside = (F.col("t") >= F.col("hit_t") - window_us) & (
        F.struct("t", "eid") <= F.struct(F.col("hit_t").alias("t"), F.col("hit_eid").alias("eid"))
    )
    # The rows are the larger side and are never broadcast.
    return by_key(picked).join(end, [*keys, "cell"]).where(inside)
