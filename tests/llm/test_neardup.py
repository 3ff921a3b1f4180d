import random

from pyspark.sql import functions as F

from tests.llm import brute
from tidewatch.llm import neardup
from tidewatch.llm.graph import components

SPEC = neardup.Spec(width=3, percent=85, bands=25, rows=5)


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy))
    # A chain: each text is like the next, the ends are not alike.
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for k in range(12):
        texts.append(" ".join(chain[5 * k : 5 * k + 120]))
    texts += [None, "", " \t", "one", "ONE", "one two", "two one", "One two", "a b c", "a b c d", "é É", "a" * 50_000 + " x y"]
    rng.shuffle(texts)
    return texts


def run(spark, texts, spec=SPEC):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("row", F.lit("own")).withColumn("digest", F.lit(1))
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, spec).collect()}


def test_components_equal_those_of_all_pairs(spark):
    texts = corpus()
    expected = {i: (n, c, c == i) for i, (n, c) in enumerate(brute.components(texts, 3, 85))}
    assert run(spark, texts) == expected


def test_large_buckets_are_finished(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 4)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(300)] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(copy))
    spec = neardup.Spec(width=5, percent=80, bands=30, rows=4)
    expected = {i: (n, c, c == i) for i, (n, c) in enumerate(brute.components(texts, 5, 80))}
    assert run(spark, texts, spec) == expected


def test_near_copies_under_the_threshold_are_left_out_by_their_prefixes(spark, monkeypatch):
    """Each text has words of its own where the base has others: no two are similar enough, most by little."""
    made = []
    monkeypatch.setattr(neardup, "similar", lambda pairs, sets, spec, whole=neardup.similar: made.append(pairs.count()) or whole(pairs, sets, spec))
    base = [f"b{i}" for i in range(300)]
    counts = []
    for size in (250, 500):
        rng = random.Random(size)
        texts = []
        for k in range(size):
            copy = list(base)
            for j, at in enumerate(rng.sample(range(4, 296, 4), 9)):
                copy[at] = f"own{k}x{j}"
            texts.append(" ".join(copy))
        texts += [" ".join(base[:200] + [f"z{k}" for k in range(100)])] * 2
        made.clear()
        got = run(spark, texts, neardup.Spec(width=3, percent=85, bands=25, rows=5))
        assert sum(kept for _, _, kept in got.values()) == size + 1
        counts.append(sum(made))
    assert counts[1] <= 2.5 * counts[0] <= 2.5 * 30 * 250


def test_repeated_ids_nulls_and_copies(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (1, "q r s t"), (None, "z z z z"), (None, None), (0, None), (2, "A B  C D")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, `odd.name` string")
    got = neardup.near_duplicates(docs, SPEC).collect()
    assert len(got) == len(rows)
    same = [r for r in got if r.n_shingles == 2]
    assert {r.component_id for r in same if r.doc_id != 1} == {1} and sum(r.kept for r in same) == 2
    kept = neardup.deduplicated(docs, SPEC)
    assert kept.columns == docs.columns
    assert sorted((r.text or "") for r in kept.collect()) == ["", "", "a b c d", "q r s t", "z z z z"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert neardup.near_duplicates(docs).count() == 0 and neardup.deduplicated(docs).count() == 0


def test_graph(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    links = spark.createDataFrame([*pairs, (None, 3)], "a bigint, b bigint")
    assert {r.node: r.component for r in components(links).collect()} == {x: find(x) for x in root if find(x) != x}
    assert components(links.limit(0)).count() == 0
