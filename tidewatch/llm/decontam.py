"""Benchmark decontamination with spaced seeds, in DataFrame operations only.

An overlap is a window of 12 tokens of a benchmark item that a document repeats with at most two
substitutions. Cut such a window into four blocks of three: two of them are untouched, and they lie
next to each other, one block apart, or two. Three fixed masks (below) therefore find every
overlap: each looks at two blocks and ignores what lies between. Positions whose block the
benchmark does not have are dropped first; the hashes of the masked windows of the rest are joined
with those of the benchmark. Hits that put an item at the same place of a document are one
candidate, and its tokens are compared one by one.

Items of 6 to 11 tokens may have one substitution: then one of their first two blocks is untouched,
and these blocks are looked up alone. Items of three to five tokens must be repeated unchanged, items
of one or two make up the whole document.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.durable import broadcast_if_small, durable
from tidewatch.llm.common import keyed, packed, unpacked

# The tokens that a mask looks at (1) and ignores (0).
MASKS = ("111111", "111000111", "111000000111")
WINDOW, BLOCK, SUBSTITUTIONS = 12, 3, 2
# Letters of scripts that are written without blanks (Thai, Lao, Myanmar, Khmer, kana, Han), each a token.
UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"

# Where the second block of each mask begins.
_SECOND = tuple(mask.rindex("111") if "0" in mask else BLOCK for mask in MASKS)


def tokens_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; letters of scripts without blanks are tokens of their own."""
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    # ASCII texts have none of them.
    spaced = F.when(F.octet_length(low) == F.length(low), low).otherwise(F.regexp_replace(low, f"([{UNSPACED}])", " $1 "))
    return F.array_remove(F.split(spaced, r"[^\p{L}\p{N}]+"), "")


def _blocks(table: DataFrame, *columns: str, step: int = 1) -> DataFrame:
    """(columns, at, block): the hash of the three tokens at each position of ``tokens``, or each ``step``-th."""
    hashed = table.select(*columns, F.transform("tokens", lambda w: F.xxhash64(w)).alias("h"))
    places = F.when(F.size("h") >= BLOCK, F.sequence(F.lit(0), F.size("h") - BLOCK, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return hashed.select(*columns, F.posexplode(F.transform(places, lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2)))).alias("at", "block")).withColumn("at", F.col("at") * step)


def _seeds(blocks: DataFrame, owner: str) -> DataFrame:
    """(owner, at, key): the hash of every mask at every position where both of its blocks are among ``blocks``."""
    ends = F.explode(F.array(*(F.struct(F.lit(m).alias("mask"), F.lit(second).alias("second")) for m, second in enumerate(_SECOND)))).alias("m")
    second = blocks.select(owner, "at", F.col("block").alias("other"), ends).select(owner, "m.mask", (F.col("at") - F.col("m.second")).alias("at"), "other")
    return blocks.join(second, [owner, "at"]).select(owner, "at", F.xxhash64("mask", "block", "other").alias("key"))


def aligned(texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per keyed text, item and alignment that overlap: row, doc_id, item_id, ``doc_start`` (the token
    of the document where the item's first would be), ``n_tokens`` of the item and ``n_equal`` among them.

    ``benchmark`` has item_id and text. An item of 6 to 11 tokens must be repeated whole, with one
    substitution at most, one of 3 to 5 unchanged; one of fewer overlaps with documents that have no
    other tokens. Null and empty texts and items overlap with nothing; repeated rows overlap each. A
    null item_id is an item like others. A text is an array of its tokens in one row, whatever its length.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens_of(F.col("text")).alias("tokens")).distinct()
    items = durable(items.withColumn("item", F.xxhash64("item_id", F.array_join("tokens", " "))).dropDuplicates(["item"]), "items")
    long, short = items.where(F.size("tokens") >= WINDOW), items.where(F.size("tokens").between(BLOCK, WINDOW - 1))
    item_blocks = durable(_blocks(long, "item"), "item_blocks")
    known = durable(_seeds(item_blocks, "item").withColumnRenamed("at", "item_at"), "item_seeds")
    # Of a short item with one substitution, one of the first two blocks is whole.
    alone = durable(_blocks(short, "item", step=BLOCK).where(F.col("at") <= BLOCK).withColumnRenamed("at", "item_at"), "short_seeds")
    # A mask can only hit where both of its blocks are the benchmark's, so other positions go first.
    wanted = durable(item_blocks.select("block").unionByName(alone.select("block")).distinct(), "item_block_hashes")
    tokens = texts.select("row", tokens_of(F.col("text")).alias("tokens"))
    met = durable(_blocks(tokens, "row").join(broadcast_if_small(wanted), "block", "left_semi"), "met_blocks")
    hits = _seeds(met, "row").join(broadcast_if_small(known), "key").select("row", "item", (F.col("at") - F.col("item_at")).alias("doc_start"))
    hits = hits.unionByName(met.join(broadcast_if_small(alone), "block").select("row", "item", (F.col("at") - F.col("item_at")).alias("doc_start")))
    tiny = items.where(F.size("tokens").between(1, BLOCK - 1)).select("item", F.array_join("tokens", " ").alias("all"))
    whole = tokens.where(F.size("tokens").between(1, BLOCK - 1)).select("row", F.array_join("tokens", " ").alias("all"))
    hits = hits.unionByName(whole.join(broadcast_if_small(durable(tiny, "tiny_items")), "all").select("row", "item", F.lit(0).alias("doc_start")))
    placed = durable(hits.distinct(), "alignments")

    found = durable(placed.select("row").distinct(), "hit_rows")
    chosen = texts.join(broadcast_if_small(found), "row", "left_semi").select("row", "doc_id", tokens_of(F.col("text")).alias("doc_tokens"))
    pairs = placed.join(broadcast_if_small(items), "item").withColumnRenamed("tokens", "item_tokens").join(chosen, "row")
    length = F.size("item_tokens")
    # F.get gives null outside of the document, and null is no agreement.
    agree = F.transform("item_tokens", lambda w, j: F.coalesce(F.when(F.col("doc_start") + j >= 0, F.get("doc_tokens", F.col("doc_start") + j)) == w, F.lit(False)).cast("int"))
    compared = pairs.select("row", "doc_id", "item_id", "doc_start", length.alias("n_tokens"), agree.alias("agree"))
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    starts = F.sequence(F.lit(1), F.greatest(F.col("n_tokens") - WINDOW + 1, F.lit(1)))
    # Substitutions that an item of so many tokens may have in a window, or in all if it is shorter.
    allowed = F.when(F.col("n_tokens") >= WINDOW, SUBSTITUTIONS).when(F.col("n_tokens") >= 2 * BLOCK, 1).otherwise(0)
    window = F.exists(starts, lambda s: total(F.slice("agree", s, WINDOW)) >= F.least(F.lit(WINDOW), F.col("n_tokens")) - allowed)
    return compared.where(window).select("row", "doc_id", "item_id", "doc_start", "n_tokens", total(F.col("agree")).alias("n_equal"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, doc_start, n_tokens and n_equal of each document, item and alignment that overlap."""
    return aligned(keyed(docs), benchmark).drop("row")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, with all their columns."""
    texts = packed(docs)
    leaking = durable(aligned(texts, benchmark).select("row").distinct(), "leaking")
    return unpacked(texts.join(broadcast_if_small(leaking), "row", "left_anti"), docs)
