"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source gets a share of the mix; whole copies that its share holds for certain are given to
all of its documents. The rest of the words is a sample with probability proportional to size: a
document has inclusion probability p = c * size, c such that the expected words are the rest, and
documents for which that reaches 1 are taken for certain. The others are ranked by
(u / (1 - u)) / (p / (1 - p)) with u drawn from a digest of the document's key, and taken in that
order until the words are used up. The running sums are cut into about as many buckets of the rank
as a bucket has documents, so that no source has to fit into one task. Where a long document ends
the sample of a source far from its target, the documents behind it are gone through too.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.durable import broadcast_if_small, durable
from tidewatch.llm.common import WORD, keyed, packed, unpacked

# A source that the sample and its closing document leave further from its target than this share of it is filled on.
NEAR = 0.05


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds ``target`` to (source, source_size): ``share`` of all sizes by weight, none above ``most`` times its size.

    Sources by code point, null last, take ``weights`` in turn. A capped source's excess goes to the
    others by weight: the level of a unit of weight is found at the first source, ordered by
    size per weight, that isn't capped. One row per source; the windows have nothing else.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    table = sources.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = table.withColumn("level", left / weights_left).withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    level = F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("rank")))).over(everything)
    return levelled.withColumn("level", level).select("source", "source_size", "n_docs", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on key and seed only."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**12))


def fitting(rows: DataFrame) -> DataFrame:
    """Adds ``fits`` to (source, row, size, rank, bucket, room): whether the sizes of the source's rows up to it, by rank, are at most ``room``.

    False where ``room`` (one value a source) is null.
    """
    same = F.col("source").eqNullSafe(F.col("s"))
    sums = rows.where("room IS NOT NULL").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("room").alias("room"))
    ordered = Window.partitionBy("source").orderBy("bucket")
    before = F.coalesce(F.sum("words").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = sums.withColumn("before", before).where(F.col("before") < F.col("room")).groupBy(F.col("source").alias("s")).agg(F.max("bucket").alias("last"), F.max("before").alias("before"))
    placed = rows.join(broadcast_if_small(durable(last, "last_buckets")), same, "left").drop("s")

    # Only the bucket in which the words run out is looked at row by row.
    edge = placed.where("bucket = last")
    until = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("rank", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = edge.withColumn("fits", F.col("before") + until <= F.col("room"))
    other = placed.where("last IS NULL OR bucket <> last").withColumn("fits", F.coalesce(F.col("bucket") < F.col("last"), F.lit(False)))
    return edge.unionByName(other).drop("last", "before")


def closed(left: DataFrame, gaps: DataFrame) -> DataFrame:
    """Adds ``closing`` and ``off`` to (source, gap, ...): the row among ``left`` whose size is nearest to the
    gap (null if none brings the sum nearer), earlier rank first, and how far the sum then is from the target.
    """
    same = F.col("source").eqNullSafe(F.col("s"))
    named = broadcast_if_small(gaps.select(F.col("source").alias("s"), "gap"))
    nearest = F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "rank", "row")
    best = left.join(named, same).groupBy("s", "gap").agg(F.min(nearest).alias("best")).where("best.off < gap").select("s", "best")
    return gaps.join(broadcast_if_small(durable(best, "best")), same, "left").select(*gaps.columns, F.col("best.row").alias("closing"), F.coalesce("best.off", "gap").alias("off"))


def filled(left: DataFrame, missed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, row, size) of the rows of ``left`` that still fit into the gaps of (source, gap), each row tried once
    in rank order, and (source, gap) of what stays open.

    A round takes the rows up to the first that doesn't fit, which is too long from then on; rounds
    follow until no row is short enough. In each the first row fits, so there is an end.
    """
    same = F.col("source").eqNullSafe(F.col("s"))
    rooms = broadcast_if_small(missed.select(F.col("source").alias("s"), F.col("gap").alias("room")))
    rows = durable(left.select("source", "row", "size", "rank", "bucket").join(rooms, same).drop("s").where("size <= room"), "short_enough")
    taken, gaps = [], missed.select("source", "gap")
    while not rows.isEmpty():
        tried = durable(fitting(rows), "tried")
        taken.append(tried.where("fits").select("source", "row", "size"))
        got = durable(taken[-1].groupBy(F.col("source").alias("s")).agg(F.sum("size").alias("got")), "got")
        got = broadcast_if_small(got)
        gaps = durable(gaps.join(got, same, "left").select("source", (F.col("gap") - F.coalesce("got", F.lit(0))).alias("gap")), "gaps")
        rows = tried.where("NOT fits").drop("fits").join(got, same).withColumn("room", F.col("room") - F.col("got")).drop("s", "got")
        rows = durable(rows.where("size <= room"), "short_enough")
    everything = left.select("source", "row", "size").limit(0)
    for part in taken:
        everything = everything.unionByName(part)
    return durable(everything, "filled"), gaps


def inclusion(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """source, ``least`` (documents of this size or more are taken for certain; null: none), ``open_words`` (what they
    leave of ``rest``) and ``c`` (p of the others by size) of the sources of (source, size, n) with some ``rest``.

    c solves sum(min(1, c * size) * size) = rest. A size is certain if the sum for c = 1 / size is
    within the rest; the sums are of whole numbers, so they don't depend on an order. The windows
    run over the distinct sizes of a source: with W words it has fewer than sqrt(2 W).
    """
    same = F.col("source").eqNullSafe(F.col("s"))
    known = broadcast_if_small(plan.where("rest > 0").select(F.col("source").alias("s"), "rest"))
    words = (F.col("n") * F.col("size")).cast("decimal(38,0)")
    table = sizes.where("size > 0").join(known, same).drop("s").withColumn("words", words).withColumn("squares", (F.col("words") * F.col("size")).cast("decimal(38,0)"))
    at_least = F.sum("words").over(Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    below = F.sum("squares").over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1))
    sum_then = at_least.cast("double") * F.col("size") + F.coalesce(below.cast("double"), F.lit(0.0))
    marked = table.withColumn("certain", sum_then <= F.col("rest") * F.col("size"))
    found = marked.groupBy("source").agg(
        F.first("rest").alias("rest"), F.min(F.when(F.col("certain"), F.col("size"))).alias("least"),
        F.coalesce(F.sum(F.when(F.col("certain"), F.col("words"))).cast("double"), F.lit(0.0)).alias("sure"), F.sum(F.when(~F.col("certain"), F.col("squares"))).cast("double").alias("squares"),
    )
    open_words = F.greatest(F.col("rest") - F.col("sure"), F.lit(0.0))
    return found.select("source", "least", open_words.alias("open_words"), (open_words / F.col("squares")).alias("c"))


def planned(texts: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """row, doc_id, source, size, source_size, target, p, copies and taken (words, repeats counted) of keyed texts with their source.

    ``size`` counts words (null text: 0); ``p`` is the probability of a copy beyond the whole ones.
    A document is taken 0 to ``most`` times, whole. The sample ends at the first document by rank
    that doesn't fit. The document that closes the rest is the one, among those not yet taken, that
    brings the sum nearest to the target, earlier rank first. If that leaves a source off its target
    by more than ``NEAR`` of it, all later documents that still fit are taken in rank order before one
    closes, where this comes nearer. Reruns agree; a null source is a source; documents without words
    have p = 0 and come as whole copies only; ties of rank go by row; repeated rows count each.
    """
    counted = texts.select("row", "doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    sized = durable(counted, "sizes")
    sizes = durable(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "size_counts")
    per_source = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = targets(per_source, weights, share, most).withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = durable(plan, "plan")
    same = F.col("source").eqNullSafe(F.col("s"))
    chances = durable(inclusion(sizes, plan), "chances").withColumnRenamed("source", "s")
    plan = durable(plan.join(broadcast_if_small(chances), same, "left").drop("s"), "plan")

    u = uniform(F.col("row"), seed)
    # The bound keeps rounding from making a document certain.
    p = F.when(F.col("c").isNull() & F.col("least").isNull() | (F.col("size") == 0), 0.0).when(F.col("size") >= F.col("least"), 1.0).otherwise(F.least(F.col("c") * F.col("size"), F.lit(1 - 1e-9)))
    known = broadcast_if_small(plan.withColumnRenamed("source", "s"))
    ranked = sized.join(known, same).drop("s").withColumn("p", p)
    ranked = ranked.withColumn("rank", F.when((F.col("p") > 0) & (F.col("p") < 1), (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))
    # The logarithm of a rank has a density of at most 1/4 whatever p is, so no bucket holds many of a source's documents.
    bucket = F.floor(F.log("rank") * F.ceil(F.sqrt("n_docs"))).cast("int")
    ranked = ranked.withColumn("bucket", bucket).withColumn("room", F.col("open_words"))
    decided = ranked.where("rank IS NULL").withColumn("fits", F.col("p") >= 1)
    sampled = durable(fitting(ranked.where("rank IS NOT NULL")).unionByName(decided), "sampled")

    sampled_sum = sampled.where("fits").groupBy(F.col("source").alias("s")).agg(F.sum("size").alias("got"))
    gaps = plan.where("rest > 0").join(sampled_sum, same, "left").select("source", "target", (F.col("rest") - F.coalesce("got", F.lit(0))).alias("gap"))
    left = sampled.where("NOT fits AND rank IS NOT NULL")
    ends = durable(closed(left, durable(gaps, "gaps")), "ends")
    added = ends.where("closing IS NOT NULL").select(F.col("closing").alias("added"))
    missed = ends.where(F.col("off") > F.col("target") * NEAR)
    if not missed.isEmpty():
        more, open_gaps = filled(left, missed)
        untaken = left.join(broadcast_if_small(more.select("row")), "row", "left_anti")
        second = closed(untaken, open_gaps).select(F.col("source").alias("s"), F.col("closing").alias("last_row"), F.col("off").alias("new_off"))
        ends = durable(ends.join(broadcast_if_small(durable(second, "second")), same, "left").withColumn("nearer", F.coalesce(F.col("new_off") < F.col("off"), F.lit(False))), "ends")
        nearer = broadcast_if_small(ends.where("nearer").select("s"))
        closing = ends.select(F.when(F.col("nearer"), F.col("last_row")).otherwise(F.col("closing")).alias("added")).where("added IS NOT NULL")
        added = closing.unionByName(more.join(nearer, same, "left_semi").select(F.col("row").alias("added")))
    final = sampled.join(broadcast_if_small(durable(added, "added")), F.col("row") == F.col("added"), "left")
    copies = F.col("whole") + (F.col("fits") | F.col("added").isNotNull()).cast("long")
    return final.select("row", "doc_id", "source", "size", "source_size", "target", "p", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row of ``docs`` (see ``planned``)."""
    return planned(keyed(docs, "source")).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns."""
    texts = packed(docs)
    copies = durable(planned(texts.withColumn("source", F.col("rest.source"))).where("copies > 0").select("row", "copies"), "copies")
    taken = texts.join(broadcast_if_small(copies), "row")
    return unpacked(taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), docs)
