import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.durable import fresh_path
from tidewatch.llm import tokens
from tidewatch.llm.queries import tokenizer_path

ENCODER = tokens.PieceEncoder(tokenizer_path())


def ids_of(text):
    return ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'é.1\x1c\xa0"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_words_one_by_one_give_the_tokenizers_ids(text):
    assert ENCODER.encode(text) == np.asarray(ids_of(text), "<u4").tobytes()


def test_new_words_reach_the_tokenizer_some_at_a_time(monkeypatch):
    encoder, sizes = tokens.PieceEncoder(tokenizer_path()), []
    plain = encoder._plain
    monkeypatch.setattr(encoder, "_plain", lambda text: sizes.append(len(text)) or plain(text))
    text = " ".join(f"w{i}x" for i in range(3 * tokens.LEARN_WORDS + 5))
    assert encoder.encode(text) == np.asarray(ids_of(text), "<u4").tobytes()
    assert max(sizes) < len(text) / 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=" ab\n", max_size=12), st.sampled_from(["", " ", "a ", " a", "é a\xa0 b", "x <|endoftext|> y"])), max_size=8))
def test_texts_encoded_together_give_each_its_own_ids(texts):
    got = ENCODER.encode_all([t.encode() for t in texts])
    assert [x.tolist() for x in got] == [ids_of(t) for t in texts]


def test_words_of_some_steps_before_are_not_learned_again(monkeypatch):
    encoder, sizes = tokens.PieceEncoder(tokenizer_path()), []
    plain = encoder._plain
    texts = [("x " + " ".join(f"{k}q{i:x}" for i in range(100_000))).encode() for k in range(4)]
    first = [encoder.encode_all([t])[0].tobytes() for t in texts]
    monkeypatch.setattr(encoder, "_plain", lambda text: sizes.append(len(text)) or plain(text))
    assert [encoder.encode_all([t])[0].tobytes() for t in texts] == first
    assert sum(sizes) < 100


def test_special_token_strings_and_edges():
    for text in ("", " ", "a ", " a", "a  b", "x <|endoftext|> y", "don't  we'll", "\x1c a\x1c\x1c b", "a\n b", "a \nb"):
        assert ENCODER.encode(text) == np.asarray(ids_of(text), "<u4").tobytes()


def test_files_in_id_order(spark):
    rows = [(7, "seven words are in this very text", "x"), (3, None, "x"), (None, "no id", "x"), (5, "", "x"), (9, "long " * 40_000, "x"), (7, "another seven", "x"), (7, "another seven", "x"), (-2, "<|endoftext|> inside", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tokens string")
    path = fresh_path(spark, "tokens")
    tokens.write(docs, path, tokenizer_path(), page_bytes=4096)
    got = tokens.digests(tokens.read(spark, path)).orderBy("start").collect()
    expected, start = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.asarray([*ids_of(text), 0], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == expected
    assert {"start", "n_tokens", "doc_id"} == set(tokens.read(spark, path, tokens=False).columns)
    # Encodings and page indexes of the file format.
    parts = [pq.ParquetFile(f.removeprefix("file:")) for f in spark.read.parquet(path).inputFiles()]
    group = next(p.metadata.row_group(0) for p in parts if p.metadata.num_rows)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
    assert "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())


def test_empty_table(spark):
    path = fresh_path(spark, "tokens")
    tokens.write(spark.createDataFrame([], "doc_id bigint, text string"), path, tokenizer_path())
    assert tokens.digests(tokens.read(spark, path)).count() == 0


def test_selective_read_leaves_the_lists_alone(spark):
    path = fresh_path(spark, "tokens")
    tokens.write(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id bigint, text string"), path, tokenizer_path())
    plan = tokens.read(spark, path, tokens=False).where("doc_id = 2")._jdf.queryExecution().executedPlan().toString()
    assert "tokens#" not in plan and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,2)" in plan.replace("IsNotNull(part), ", "").replace(", IsNotNull(part)", "") or "EqualTo(doc_id,2)" in plan


@pytest.mark.parametrize("words", [3, 2_000])
def test_forgotten_words_are_learned_again(monkeypatch, words):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 10)
    own = tokens.PieceEncoder(tokenizer_path())
    for k in range(3):
        text = " ".join(f"w{i * (k + 1)}" for i in range(words)) + " end"
        assert own.encode(text) == np.asarray(ids_of(text), "<u4").tobytes()


def test_long_words_do_not_fill_the_memory(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 1 << 18, raising=False)
    own, before = tokens.PieceEncoder(tokenizer_path()), pa.total_allocated_bytes()
    for k in range(20):
        text = "x " + " ".join(f"{k}q{i}" * 200 for i in range(64))
        assert own.encode(text) == np.asarray(ids_of(text), "<u4").tobytes()
    assert pa.total_allocated_bytes() - before < 1 << 19


def test_a_step_does_not_copy_the_words_kept():
    own = tokens.PieceEncoder(tokenizer_path())
    for k in range(4):
        own.encode("x " + " ".join(f"{k}q{i:x}" for i in range(100_000)))
    usual, counted = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(counted)
    try:
        assert own.encode("x 1q5 new") == np.asarray(ids_of("x 1q5 new"), "<u4").tobytes()
    finally:
        pa.set_memory_pool(usual)
    assert counted.max_memory() < 8 << 20


def test_words_met_again_stay_when_many_others_come(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 500)
    monkeypatch.setattr(tokens, "CACHE_ARRAYS", 3, raising=False)
    own, learned = tokens.PieceEncoder(tokenizer_path()), []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda words: learned.extend(words.to_pylist()) or learn(words))
    for k in range(40):
        text = "x often met " + " ".join(f"{k}q{i}" for i in range(100))
        assert own.encode(text) == np.asarray(ids_of(text), "<u4").tobytes()
        assert sum(map(len, own.words)) <= 500 + 102
    assert learned.count("often") == learned.count("met") == 1
