import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import blocknames


def expected(rows):
    """(doc_id, keep_id, group_size, sha) of each row, sorted, and how many rows stay, by a dictionary of texts."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str), len(groups)


def check(spark, rows, block_bytes):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, h string, name int")
    got = blocknames.exact_copies(docs, block_bytes=block_bytes).collect()
    want, stay = expected(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == stay and all(r.doc_id == r.keep_id for r in got if r.kept)


def texts(seed):
    """Texts of blocks that repeat, so that most pairs of names occur in several documents."""
    rng = random.Random(seed)
    parts = ["aaaaaaaa", "bbbbbbbb", "aaaabbbb", "é" * 4]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) + rng.choice(["", "", "a", "bb"]) for _ in range(300)]
    return [*out, "", None, "a" * 7, "a" * 8, "a" * 9, "z" * 5_000, "z" * 5_000, "z" * 4_999]


def test_equal_texts_are_found_by_their_names(spark):
    check(spark, list(enumerate(texts(1))), 8)


def test_blocks_that_share_a_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(blocknames, "_fingerprint", lambda block: F.xxhash64(block) % 2)
    check(spark, list(enumerate(texts(2))), 8)


@pytest.mark.parametrize("block_bytes", [1, blocknames.BLOCK])
def test_null_and_repeated_ids_and_a_long_text(spark, block_bytes):
    long = "long text " * (2 if block_bytes == 1 else 300_000)
    rows = [(1, "a"), (1, "a"), (None, "a"), (2, None), (3, ""), (None, "b"), (None, "b"), (7, long), (9, long), (8, long + "x"), (1, "c")]
    check(spark, rows, block_bytes)


def test_kept_rows_have_all_their_columns(spark):
    rows = [(1, "A b", "p"), (2, "a B", "q"), (None, "a b", "r"), (4, None, "s"), (5, "", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `odd.name` string")
    got = blocknames.deduplicated(docs, F.lower)
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == [(2, "a B", "q"), (5, "", "t")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert blocknames.exact_copies(docs).count() == 0 and blocknames.deduplicated(docs).count() == 0


def test_no_python_runs(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id bigint, text string")
    plan = blocknames.exact_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
