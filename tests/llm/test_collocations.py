import random
import re
from collections import Counter

import pytest

from tidewatch.llm import collocations


def expected(rows, least, absorb, most):
    """{lang: [(rank, phrase, a, l, r, n, score, path_words)]} by counting all runs of up to three words."""
    f = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            for n in (1, 2, 3):
                for i in range(len(words) - n + 1):
                    f[lang, *words[i : i + n]] += 1
    often = {k: n for k, n in f.items() if n >= least and len(k) > 2}
    edges = [k for k in often if len(k) == 4]
    leaving, entering = Counter(e[:3] for e in edges), Counter((e[0], *e[2:]) for e in edges)
    after = {e[:3]: (e[0], *e[2:]) for e in edges if leaving[e[:3]] == 1 == entering[e[0], *e[2:]] and len(set(e[1:])) > 1}
    long, inner = {}, {}
    for head in set(after) - set(after.values()):
        path = [head]
        while path[-1] in after:
            path.append(after[path[-1]])
        long |= {node: len(path) + 1 for node in path}
        inner |= {(*x, y[-1]): len(path) + 1 for x, y in zip(path, path[1:], strict=False)}
    out = {}
    for k, a in often.items():
        lang, *words = k
        if any(len(o) > len(k) and o[0] == lang and (o[1:3] == k[1:] or o[2:4] == k[1:]) and 100 * often[o] >= absorb * a for o in often):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, *words[:c]] * f[lang, *words[c:]]), c) for c in range(1, len(words))]
        score, c = min(cuts)
        n = sum(v for key, v in f.items() if len(key) == 2 and key[0] == lang)
        path = long.get(k, 2) if len(words) == 2 else inner.get(k, 3)
        out.setdefault(lang, []).append((" ".join(words), a, f[lang, *words[:c]], f[lang, *words[c:]], n, score, path))
    return {lang: [(i, *x) for i, x in enumerate(sorted(v, key=lambda x: (-x[5], -x[1], x[0].encode()))[:most], 1)] for lang, v in out.items()}


def run(spark, rows, **settings):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "lang string, text string, word string, key bigint, n int")
    got = {}
    for r in collocations.collocations(docs, **settings).orderBy("lang", "rank").collect():
        got.setdefault(r.lang, []).append((r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score, r.path_words))
    return got


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "A", "b", "c", "dé", "e'f", "x-y", "É", "é", "zz"]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", " \n", ". ", "! ", " "]) for _ in range(rng.randint(0, 80)))
        if i % 3 == 0:
            text += " one two three four five six seven. "
        rows.append((rng.choice(["en", "de", "", None]), text))
    return [*rows, ("en", None), (None, ""), ("und", "a b c a b c"), ("en", "loop loop loop loop loop loop"), ("de", "p q r " * 8), ("en", "rare words here"), *[("xx", "same row")] * 12]


def test_phrases_equal_those_of_counting_all_runs(spark):
    rows = corpus(3)
    want = expected(rows, 4, 50, 30)
    assert run(spark, rows, least=4, most=30) == want
    assert any(x[-1] > 5 for v in want.values() for x in v) and any(len(v) == 30 for v in want.values())


@pytest.mark.parametrize("small_keys", [False, True])
def test_keys_instead_of_numbers_and_keys_that_clash(spark, monkeypatch, small_keys):
    monkeypatch.setattr(collocations, "DICTIONARY_BYTES", 0)
    if small_keys:
        vocabulary, tried = collocations._vocabulary, []

        def clashing(batches, seed):
            import pyarrow as pa

            for batch in vocabulary(batches, seed):
                key = pa.array([k % 7 for k in batch.column(1).to_pylist()]) if seed == 0 else batch.column(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), key, *batch.columns[2:]], names=batch.schema.names)

        monkeypatch.setattr(collocations, "_vocabulary", clashing)
        whole = collocations.vocabulary
        monkeypatch.setattr(collocations, "vocabulary", lambda docs: tried.append(whole(docs)) or tried[-1])
    rows = corpus(4)
    assert run(spark, rows, least=3, absorb_percent=80) == expected(rows, 3, 80, 2_000)
    if small_keys:
        assert tried[0][1] == 1


def test_a_word_pair_with_most_of_the_rows_and_a_long_text(spark):
    rows = [("en", "hot pair " * 3 + f"w{i}") for i in range(2_000)] + [("en", "long text here. " * 200_000)]
    got = run(spark, rows, least=10)["en"]
    assert [(p, a) for _, p, a, *_ in got if "hot" in p] == [("pair hot pair", 4_000), ("hot pair hot", 4_000)] or {(p, a) for _, p, a, *_ in got if "hot" in p} == {("pair hot pair", 4_000), ("hot pair hot", 4_000)}
    assert ("long text here", 200_000) in {(p, a) for _, p, a, *_ in got}


def test_empty_table(spark):
    assert run(spark, []) == {} and run(spark, [("en", None), (None, " .\n")]) == {}
