"""Exact top-k over keys of any number, without a shuffle of the keys.

Rows are counted in cells of hashed keys, which no number of keys makes larger; a key has at most
as many rows as each of its cells. The fullest cells are counted key by key, and the n-th count among
them is a bound that the top n can't fall below. Rows of keys that have a cell below it can't be
among them and are left out before anything is moved.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.durable import durable

# The cells of all hashes take about a megabyte, so they are broadcast whatever the input is.
CELLS, HASHES = 1 << 16, 2


def contenders(rows: DataFrame, keys: list[str], n: int, cells: int = CELLS, hashes: int = HASHES) -> DataFrame:
    """All rows of the keys that can be among the ``n`` with the most rows, and few others.

    Keys that tie with the n-th are kept, so an exact ranking of the result is that of ``rows`` for
    any order of ties. A key may hold nulls; with fewer than n keys all rows stay. Reads ``rows``
    twice (a third time where the result is read).
    """
    names = [f"_cell_{i}" for i in range(hashes)]
    placed = rows.select("*", *[F.pmod(F.xxhash64(*keys, F.lit(i)), F.lit(cells)).cast("int").alias(name) for i, name in enumerate(names)])
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("hash"), F.col(name).alias("cell")) for i, name in enumerate(names)])).alias("c")
    filled = durable(placed.select(pairs).groupBy("c.hash", "c.cell").agg(F.count("*").alias("n")), "cells")

    fullest = filled.where("hash = 0").orderBy(F.desc("n"), "cell").limit(n).select(F.col("cell").alias(names[0]))
    known = placed.join(F.broadcast(fullest), names[0], "left_semi").groupBy(*keys).agg(F.count("*").alias("_n"))
    found = known.select("_n").orderBy(F.desc("_n")).limit(n).agg(F.count("*"), F.min("_n")).first()
    least = found[1] if found[0] == n else 0

    def able(so_far: DataFrame, i: int) -> DataFrame:
        cell = filled.where((F.col("hash") == i) & (F.col("n") >= least)).select(F.col("cell").alias(names[i]))
        return so_far.join(F.broadcast(cell), names[i], "left_semi")

    return reduce(able, range(hashes), placed).select(*[placed[name] for name in rows.columns])
