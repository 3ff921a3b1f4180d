import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tidewatch.durable import durable
from tidewatch.llm import decontam, mixing, quality
from tidewatch.llm.common import in_fold, table

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_works_on_what_the_one_before_kept(spark):
    docs = table(spark, FOLDER, "documents")
    rows = {0: docs}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        rows[k] = durable(stage(spark, rows[k - 1], FOLDER), "stage")
        if k < len(corpus_pipeline.STAGES):
            assert rows[k].columns == docs.columns
    ids = {k: [r.doc_id for r in df.select("doc_id").collect()] for k, df in rows.items()}
    # Rejected documents go.
    model = quality.trained(docs, table(spark, FOLDER, "labels"), ~in_fold(F.col("doc_id"), 3, 1))
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.score >= 0.5}
    assert set(ids[1]) == good and 0 < len(good) < len(ids[0])
    # One document of each group stays.
    kept = sorted((r.doc_id, r.text) for r in rows[1].collect())
    firsts = {kept[c][0] for _, c in brute.components([t for _, t in kept], 5, 80)}
    assert set(ids[2]) == firsts
    # Leaks go.
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    leaking = {d for d, _, _ in brute.leaks([(r.doc_id, r.text) for r in rows[2].collect()], items)}
    assert set(ids[3]) == set(ids[2]) - leaking
    # Copies as planned.
    planned = {r.doc_id: r.copies for r in mixing.planned(mixing.keyed(rows[3], "source")).collect()}
    assert {d: ids[4].count(d) for d in planned} == planned
    # Every copy has its ids, one after the other.
    last = rows[5].orderBy("start").collect()
    assert sorted(ids[5]) == sorted(ids[4]) and [r.doc_id for r in last] == sorted(ids[4])
    assert np.array_equal(np.cumsum([0, *[len(r.tokens) for r in last]])[:-1], [r.start for r in last])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, FOLDER).select("doc_id").collect()) == sorted(ids[5])


def test_decontamination_has_no_python(spark):
    docs = table(spark, FOLDER, "documents")
    for df in (decontam.decontaminated(docs, table(spark, FOLDER, "benchmark")), mixing.mixed(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_odd_rows_and_clashing_columns_go_through_every_stage(spark):
    import pyspark.sql.types as T

    names = ["doc_id", "text", "lang", "source", "n_chars", "odd.name", "row", "_score", "quality", "rest", "c0", "tokens", "size"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.StringType()) for n in names[1:])])
    good = table(spark, FOLDER, "labels").where("quality = 1").join(table(spark, FOLDER, "documents"), "doc_id").where("n_chars > 500").orderBy("doc_id").first().text
    texts = [None, "", good, " \n", "the same text " * 30, "the same text " * 30, "one", "é ½ 日本", "word " * 60_000]
    rows = [(i, t, "en", None if i % 2 else "s", "1", *"abcdefgh") for i, t in enumerate(texts)] + [(None, "no id at all", None, None, None, *[None] * 8), (4, texts[4], "en", None, "1", *"abcdefgh")] * 2
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        for table_ in (docs, docs.limit(0)):
            got = durable(stage(spark, table_, FOLDER), "odd")
            count = got.count()
            assert count <= 2 * table_.count() and (count > 0) == (table_ is docs)
            if stage is not corpus_pipeline.write_tokens:
                assert got.columns == docs.columns and got.schema["odd.name"].dataType == T.StringType()
    kept = [r.text for r in corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).collect()]
    assert kept.count(texts[4]) == 1 and kept.count("no id at all") == 1 and kept.count(None) == 1
