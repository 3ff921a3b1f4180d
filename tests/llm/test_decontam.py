import random

from pyspark.sql import functions as F

from tests.llm import brute
from tidewatch.llm import decontam


def data(seed=6):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(250)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, draw(rng.choice([14, 20, 36, 60]))) for i in range(12)] + [(90, draw(9)), (91, draw(6)), (92, draw(5)), (93, []), (94, draw(12))]
    items += [(95, draw(3)), (96, ["w7"]), (97, draw(2)), (98, draw(11)), (99, ["日本語の文章です"]), (100, ["の文章"]), (101, ["ภาษาไทย", "w3"]), (102, draw(7))]
    docs = []
    for i in range(150):
        own = draw(rng.randint(0, 80))
        _, item = rng.choice(items)
        a = rng.randrange(len(item) + 1)
        part = list(item[a : a + rng.randint(8, 60)]) if rng.random() < 0.5 else list(item)
        for _ in range(rng.randint(0, 4)):
            if part:
                part[rng.randrange(len(part))] = rng.choice(vocabulary)
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(own[: len(own) // 2] + part + own[len(own) // 2 :])))
    docs += [(200, None), (201, ""), (202, "?!"), (203, " ".join(draw(20_000) + items[3][1])), (204, " ".join(items[2][1]).upper())]
    docs += [(205, "w7"), (206, " ".join(items[14][1])), (207, "w7 w7"), (208, "これは日本語の文章である。"), (209, "日本語の文意です"), (210, "x ภาษาไทย w3"), (211, items[19][1][1])]
    docs += [(212 + k, " ".join([*items[20][1][:-1], "other"][: 7 - k])) for k in range(3)]
    return docs, [(i, " ".join(w)) for i, w in items] + [(None, None)]


def run(spark, docs, items):
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("row", F.lit("own")).withColumn("item", F.lit(0))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("key", F.lit(0))
    return table, bench


def test_overlaps_equal_those_of_all_alignments(spark):
    docs, items = data()
    got = decontam.overlaps(*run(spark, docs, items)).collect()
    assert {(r.doc_id, r.item_id, r.doc_start): r.n_equal for r in got} == brute.leaks(docs, items)
    assert len(got) == len({(r.doc_id, r.item_id, r.doc_start) for r in got})


def test_same_without_a_broadcast(spark, monkeypatch):
    docs, items = data(7)
    monkeypatch.setattr("tidewatch.llm.decontam.broadcast_if_small", lambda df: df)
    got = decontam.overlaps(*run(spark, docs, items)).collect()
    assert {(r.doc_id, r.item_id, r.doc_start): r.n_equal for r in got} == brute.leaks(docs, items)


def test_clean_rows_stay_with_their_columns(spark):
    docs, items = data()
    docs = [*docs, (None, items[0][1]), (None, "clean"), (5, items[1][1]), (5, "clean too")]
    table, bench = run(spark, docs, items)
    got = decontam.decontaminated(table, bench)
    assert got.columns == table.columns
    bad = {d for d, _, _ in brute.leaks(list(enumerate(t for _, t in docs)), items)}
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == sorted((d or -1, t or "") for i, (d, t) in enumerate(docs) if i not in bad)


def test_empty_tables_and_repeated_rows(spark):
    docs, items = data()
    table, bench = run(spark, docs, items)
    assert decontam.overlaps(table.limit(0), bench).count() == 0
    assert decontam.overlaps(table, bench.limit(0)).count() == 0
    one = table.where("doc_id = 204")
    assert decontam.overlaps(one.union(one), bench).count() == 2 * decontam.overlaps(one, bench).count() > 0


def test_no_python_in_the_plan(spark):
    docs, items = data()
    plan = decontam.overlaps(*run(spark, docs, items))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
