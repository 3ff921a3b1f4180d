"""Exact duplicates by deterministic block naming, in DataFrame operations only.

Texts are cut into blocks of a fixed number of bytes. The distinct blocks are sorted and numbered;
a block's number is its name. Neighbouring names of a document are paired, the distinct pairs are
sorted and numbered in turn, and so on until each document has one name. Two documents have the same
name on the same level if and only if their texts are equal: names are numbers of whole values, not
digests, so nothing can collide.

Blocks meet their names again by a hash, so that texts are moved once, as distinct blocks, and not a
second time to look their names up. Blocks that share a hash without being equal are found from the
names and looked up by their bytes. Copies of a block or pair are combined before each exchange.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.durable import broadcast_if_small, durable
from tidewatch.llm.common import keyed, packed, unpacked

# Bytes of a block.
BLOCK = 4_096
# Stands for the partner of a last name without one; no name is that small.
_NONE = -(1 << 62)


def unchanged(text: Column) -> Column:
    return text


def _fingerprint(block: Column) -> Column:
    return F.xxhash64(block)


def _named(values: DataFrame, *columns: str) -> DataFrame:
    """The distinct ``values`` in sorted order within their partitions, each with a number of its own."""
    return values.select(*columns).distinct().sortWithinPartitions(*reversed(columns)).withColumn("name", F.monotonically_increasing_id())


def _blocks(texts: DataFrame, size: int) -> DataFrame:
    """(row, at, n, block, h): the n blocks of each text; an empty text is one empty block."""
    data = texts.select("row", F.col("text").cast("binary").alias("data"))
    n = F.floor(F.greatest(F.octet_length("data") - 1, F.lit(0)) / size).cast("int") + 1
    # The bytes are bound once, so that cutting takes time in proportion to them.
    cut = F.transform(F.array("data"), lambda b: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(b, i * size + 1, F.lit(size))))
    blocks = data.select("row", n.alias("n"), F.posexplode(F.get(cut, F.lit(0))).alias("at", "block"))
    return blocks.select("row", "at", "n", "block", _fingerprint(F.col("block")).alias("h"))


def identities(texts: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """(row, level, name) of texts (row, text without nulls); equal on level and name just where texts are equal."""
    blocks = _blocks(texts, block_bytes)
    first = durable(_named(blocks, "h", "block").select("h", "name"), "block_names")
    clashing = durable(first.groupBy("h").count().where("count > 1").select("h"), "clashing")
    placed = blocks.select("row", "at", "n", "h")
    if clashing.isEmpty():
        names = placed.join(broadcast_if_small(first), "h").select("row", "at", "n", "name")
    else:
        clear = durable(first.join(broadcast_if_small(clashing), "h", "left_anti"), "clear_names")
        unclear = durable(blocks.join(broadcast_if_small(clashing), "h", "left_semi").select("row", "at", "n", "block"), "unclear")
        second = durable(_named(unclear, "block").select("block", (-F.col("name") - 1).alias("name")), "unclear_names")
        names = placed.join(broadcast_if_small(clear), "h").select("row", "at", "n", "name").unionByName(
            unclear.join(broadcast_if_small(second), "block").select("row", "at", "n", "name")
        )
    names = durable(names, "names")
    ready, level = [], 0
    while True:
        ready.append(names.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        several = names.where("n > 1")
        if several.isEmpty():
            return reduce(DataFrame.unionByName, ready)
        left, right = (F.max(F.when(F.col("at") % 2 == side, F.col("name"))) for side in (0, 1))
        paired = several.groupBy("row", F.expr("at div 2").cast("int").alias("at"), F.expr("(n + 1) div 2").cast("int").alias("n"))
        pairs = durable(paired.agg(left.alias("left"), F.coalesce(right, F.lit(_NONE)).alias("right")), "pairs")
        numbered = durable(_named(pairs, "left", "right"), "pair_names")
        names = durable(pairs.join(broadcast_if_small(numbered), ["left", "right"]).select("row", "at", "n", "name"), "names")
        level += 1


def _grouped(texts: DataFrame, block_bytes: int) -> DataFrame:
    """(row, keep_row, keep_id, group_size) of the rows whose text another row has too."""
    named = durable(identities(texts, block_bytes), "identities")
    counts = named.groupBy("level", "name").agg(F.count("*").alias("group_size")).where("group_size > 1")
    shared = durable(named.join(broadcast_if_small(durable(counts, "group_sizes")), ["level", "name"]), "shared")
    ids = durable(shared.join(texts.select("row", "doc_id"), "row"), "shared_ids")
    # Rows without an id come last in the order of rows, and stay only among themselves.
    keep_row = F.coalesce(F.max(F.when(F.col("doc_id").isNotNull(), F.col("row"))), F.max("row"))
    kept = durable(ids.groupBy("level", "name").agg(keep_row.alias("keep_row"), F.max("doc_id").alias("keep_id")), "kept")
    return durable(ids.join(broadcast_if_small(kept), ["level", "name"]).select("row", "keep_row", "keep_id", "group_size"), "groups")


def _normalised(texts: DataFrame, normalise: Callable[[Column], Column]) -> DataFrame:
    return texts.withColumn("text", normalise(F.coalesce("text", F.lit(""))))


def exact_copies(docs: DataFrame, normalise: Callable[[Column], Column] = unchanged, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row of ``docs`` (doc_id, text).

    Texts are equal if ``normalise`` makes the same of them; a null text is an empty one. Of equal
    texts the row with the largest doc_id stays, one row where several have it; rows without an id
    stay only if all rows of their group have none (keep_id is null then). Other columns of
    ``docs`` are not read, whatever their names. An empty table gives an empty result.
    """
    texts = _normalised(keyed(docs), normalise)
    groups = _grouped(texts, block_bytes)
    digests = texts.select("row", "doc_id", F.sha2("text", 256).alias("text_sha256"))
    alone = F.col("group_size").isNull()
    return digests.join(broadcast_if_small(groups), "row", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256",
    )


def deduplicated(docs: DataFrame, normalise: Callable[[Column], Column] = unchanged, block_bytes: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay (see ``exact_copies``), unchanged and with all their columns."""
    whole = packed(docs)
    gone = durable(_grouped(_normalised(whole.select("row", "doc_id", "text"), normalise), block_bytes).where("row <> keep_row").select("row"), "gone")
    return unpacked(whole.join(broadcast_if_small(gone), "row", "left_anti"), docs)
