from pyspark.sql import functions as F

from tidewatch.llm import mixing


def test_targets(spark):
    sources = [("a", 100, 1), ("b", 1000, 1), ("c", 1000, 1), (None, 400, 1), ("empty", 0, 1)]
    table = spark.createDataFrame(sources, "source string, source_size bigint, n_docs bigint")
    got = {r.source: r.target for r in mixing.targets(table, (5, 2, 1), 1.5, 2.0).collect()}
    # a 5, b 2, c 1, empty 5, null 2; 3750 words; a and empty are capped, then null, then b.
    assert got["a"] == 200 and got["empty"] == 0 and got[None] == 800
    assert abs(got["b"] + got["c"] - 2750) < 1e-6 and abs(got["b"] - 2750 * 2 / 3) < 1e-6
    everything = {r.source: r.target for r in mixing.targets(table, (5, 2, 1), 2.0, 2.0).collect()}
    assert everything == {"a": 200, "b": 2000, "c": 2000, None: 800, "empty": 0}
    alone = spark.createDataFrame([("x", 0, 3)], "source string, source_size bigint, n_docs bigint")
    assert mixing.targets(alone, (5,), 1.5, 2.0).first().target == 0


def corpus(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.expr("array_join(array_repeat('word', cast(1 + id * 7919 % 90 as int)), ' ')").alias("text"),
        F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 100 = 1 THEN NULL ELSE concat('s', id % 10) END").alias("source"), F.lit("x").alias("row"), F.lit(1).alias("copies"),
    )
    odd = spark.createDataFrame([(4000, None, "hot"), (4001, "", None), (4002, " \n", "s1"), (None, "no id here", "s2"), (5, "word again", "s5"), (5, "word again", "s5")], "doc_id bigint, text string, source string")
    return docs.unionByName(odd.withColumn("row", F.lit("y")).withColumn("copies", F.lit(2)))


def test_words_come_near_the_targets(spark):
    docs = corpus(spark)
    planned = mixing.planned(mixing.keyed(docs, "source"))
    rows = planned.collect()
    assert len(rows) == 3006 and all(0 <= r.taken <= 2 * r.size and r.copies in (0, 1, 2) and r.taken == r.copies * r.size for r in rows)
    by = {}
    for r in rows:
        got = by.setdefault(r.source, [0, r.target, r.source_size, 0])
        got[0] += r.taken
        got[3] += r.size
    # The sizes within a source differ by ten, so no document closes a gap better than to that.
    assert all(abs(taken - target) <= 10 for taken, target, _, _ in by.values()), by
    assert all(size == total for _, _, size, total in by.values())
    again = mixing.planned(mixing.keyed(docs, "source"))
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in again.collect()) == sorted((r.doc_id or -1, r.size, r.taken) for r in rows)


def test_a_long_document_blocks_nothing(spark):
    # Each source has 200 documents of 10 words and one of 3,000; where the long one ranks early, those behind it have to fill the gap.
    long = F.col("id") % 201 == 0
    docs = spark.range(30 * 201).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("word "), F.when(long, 3000).otherwise(10)).alias("text"), F.floor(F.col("id") / 201).cast("string").alias("source"),
    )
    for share in (0.1, 0.25):
        by = {}
        for r in mixing.planned(mixing.keyed(docs, "source"), weights=(1,), share=share).collect():
            got = by.setdefault(r.source, [0, r.target])
            got[0] += r.taken
        assert len(by) == 30 and all(target == 5000 * share and abs(taken - target) <= 10 for taken, target in by.values()), by


def chances(sizes, rest):
    """p of each size: proportional to it, the longest taken out while theirs would reach 1."""
    sure, sizes = 0, sorted(sizes, reverse=True)
    while sizes and rest > 0 and sum(s * s for s in sizes) <= (rest - sure) * sizes[0]:
        sure += sizes.pop(0)
    squares = sum(s * s for s in sizes)
    return lambda size: 0 if not size or rest <= 0 else 1 if size not in sizes else (rest - sure) / squares * size


def test_a_source_is_filled_in_rank_order(spark):
    # Sizes of 1 to 2,000 words: the rule of the docstring, document by document.
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.expr("cast(exp(pmod(id * 7919, 77) / 10.0) as int)")).alias("text"), F.expr("concat('s', id % 20)").alias("source"))
    texts = mixing.keyed(docs, "source")
    u = {r.row: r.u for r in texts.select("row", mixing.uniform(F.col("row"), 17).alias("u")).collect()}
    again = certain = 0
    for share in (0.05, 0.3):
        rows = mixing.planned(texts, weights=(1, 3), share=share).collect()
        for source in {r.source for r in rows}:
            own = [r for r in rows if r.source == source]
            target, p = own[0].target, chances([r.size for r in own], own[0].target)
            assert all(abs(r.p - p(r.size)) < 1e-8 for r in own)
            rank = {r.row: u[r.row] / (1 - u[r.row]) / (p(r.size) / (1 - p(r.size))) for r in own if p(r.size) < 1}
            sure = {r.row for r in own if p(r.size) == 1}
            certain += len(sure)
            own, words = sorted((r for r in own if r.row in rank), key=lambda r: rank[r.row]), sum(r.size for r in own if r.row in sure)

            def near(taken, gap, own=own, rank=rank):
                off, _, row = min(((abs(gap - r.size), rank[r.row], r.row) for r in own if r.row not in taken), default=(gap, 0, None))
                return (taken | {row}, off) if off < gap else (taken, gap)

            prefix, gap = set(), target - words
            for r in own:
                if r.size > gap:
                    break
                prefix, gap = prefix | {r.row}, gap - r.size
            wanted, off = near(prefix, gap)
            if off > mixing.NEAR * target:
                filled, gap = set(prefix), gap
                for r in own:
                    if r.row not in filled and r.size <= gap:
                        filled, gap = filled | {r.row}, gap - r.size
                other, new = near(filled, gap)
                if new < off:
                    wanted, again = other, again + 1
            assert {r.row for r in rows if r.source == source and r.copies} == wanted | sure
    assert again and certain


def test_inclusion_follows_the_probabilities(spark):
    # 300 documents of 2 to 30 words and two of 2,000: over many seeds each is taken about as often as its p says.
    docs = spark.range(302).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.expr("CASE WHEN id >= 300 THEN 2000 ELSE 2 + 4 * cast(id % 8 as int) END")).alias("text"), F.lit("b").alias("source"),
    )
    texts = mixing.keyed(docs, "source").persist()
    taken, p, seeds = {}, {}, 10
    for seed in range(seeds):
        for r in mixing.planned(texts, weights=(1,), share=0.75, seed=seed).collect():
            taken[r.size] = taken.get(r.size, 0) + r.copies
            p[r.size] = r.p
    count = {size: 2 if size == 2000 else sum(2 + 4 * (i % 8) == size for i in range(300)) for size in p}
    assert p[2000] == 1 and taken[2000] == 2 * seeds and 0.05 < p[30] < 1 and abs(p[30] / p[2] - 15) < 1e-6
    for size, n in taken.items():
        expected = seeds * count[size] * p[size]
        assert abs(n - expected) <= 5 * (seeds * count[size] * p[size] * (1 - p[size])) ** 0.5 + seeds, (size, n, expected)


def test_mixed_rows_keep_their_columns(spark):
    docs = corpus(spark)
    got = mixing.mixed(docs)
    assert got.columns == docs.columns and dict(got.dtypes) == dict(docs.dtypes)
    wanted = sum(r.copies for r in mixing.planned(mixing.keyed(docs, "source")).collect())
    assert got.count() == wanted


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix(docs).count() == 0 and mixing.mixed(docs).count() == 0
