import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tidewatch.llm import substring


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=14), max_size=5))
def test_automaton_knows_the_longest_earlier_run(texts):
    automaton = substring.Automaton()
    before = []
    for text in texts:
        got = automaton.stream(text)
        for end in range(1, len(text) + 1):
            earlier = [*before, *[text[:e] for e in range(1, end)]]
            runs = {tuple(t[i:j]) for t in earlier for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
            longest = max((n for n in range(1, end + 1) if tuple(text[end - n : end]) in runs), default=0)
            assert got[end - 1] == longest
        before.append(text)


def run(spark, docs, width=20):
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("row", F.lit("own")).withColumn("spans", F.lit(0)).repartition(5)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text, r.kept_sha256) for r in substring.remove_repeats(table, width).collect()), key=str)


def expected(docs, width=20):
    ordered = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1] is not None, d[1] or ""))
    out = []
    for (doc_id, text), (kept, gone) in zip(ordered, brute.repeats(ordered, width), strict=True):
        out.append((doc_id, len(brute.words(text)), gone, " ".join(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "W1", "w1,"]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [draw(rng.randint(15, 70)) for _ in range(12)]
    docs = []
    for i in range(120):
        own = draw(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            own += p[a : a + rng.randint(5, 70)] + draw(rng.randint(0, 5))
        docs.append((i, rng.choice([" ", "\n", "  \t"]).join(own)))
    line = " ".join(draw(7))
    docs += [(500, " ".join(["ha"] * 25)), (501, "\n".join([line] * 9)), (502, " ".join(["ha"] * 400)), (503, " ".join(draw(3) * 30)), (504, ""), (505, None), (506, " ".join(draw(19))), (507, " ".join(draw(20)))]
    docs += [(600 + i, docs[5][1] + " " + docs[9][1]) for i in range(6)] + [(700, " ".join(draw(30_000))), (701, " ".join(["a", "b"] * 10_000))]
    return docs


@pytest.mark.parametrize("hot", [2_000, 8])
def test_removed_words_equal_those_of_all_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    docs = corpus(hot)
    assert run(spark, docs) == expected(docs)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"t{i}" for i in range(40))
    docs = [(3, text), (3, text), (None, text), (3, text + " more"), (1, "short"), (1, "short"), (None, None)]
    got = run(spark, docs)
    assert got == expected(docs)
    assert sum(r[2] == 0 and r[1] == 40 for r in got) == 1


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "a b")])[0][1] == 0
