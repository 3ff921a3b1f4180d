"""Token ids in Parquet list columns.

Documents are range partitioned by doc_id before they are encoded, so that files follow each other
in id order and the ids are computed and written once. A row holds its document's ids, their number
and where they start within the file; the start in the whole corpus needs only the file totals,
read from the two thin columns. Token ids are dictionary encoded, counters delta encoded; row
groups and pages are small and have page indexes, so that a few documents or the counters alone can
be read without the rest.
"""

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import steps

# What a process keeps from step to step: words, bytes of them and their ids, Arrow arrays that hold them.
CACHE_WORDS, CACHE_BYTES, CACHE_ARRAYS = 600_000, 32 << 20, 64
# Bytes of text that are encoded at once; what is made of them takes many times as much.
STEP_BYTES = 1 << 20
# Words given to the tokenizer at once: what it builds for a text takes many times the text.
LEARN_WORDS = 256

# Two neighbouring white-space characters (of any kind that Python or the tokenizer knows).
TOUCHING = re.compile(r"\s\s")
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
# How white-space characters beyond ASCII begin in UTF-8; texts with one are looked at by character.
_WIDE_WHITE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")

ROW_SCHEMA = "doc_id bigint, part int, part_start bigint, n_tokens bigint, tokens array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])


class PieceEncoder:
    """Encodes texts with a byte-level BPE tokenizer that starts a new piece at each space.

    Where no two white-space characters touch, the tokenizer's own splitting always cuts in front of
    a space, so a text is the sequence of its space-led words. The distinct words of many texts are
    encoded once, those met before not at all, and ids are put together by number; words and their
    ids stay in Arrow arrays. Other texts, and texts that hold the string of a special token, are
    given to the tokenizer whole. Results equal the tokenizer's own in every case.
    """

    def __init__(self, path: str) -> None:
        # Spark runs a process per core; more threads would only take each other's time.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
        self.leads[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        # Space-led words met lately, their ids as bytes, and which were met again since words were last forgotten.
        self.words, self.ids, self.met = [pa.array([], pa.string())], [pa.array([], pa.large_binary())], np.zeros(0, bool)

    def _plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _learn(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of space-led words, by a call of the tokenizer for some at a time."""
        datas, starts, size = [], [], 0
        for begin in range(0, len(words), LEARN_WORDS):
            part = words.slice(begin, LEARN_WORDS)
            joined = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), " ")
            data = self._plain(" " + joined[0].as_py())
            begins = np.flatnonzero(self.leads[np.frombuffer(data, "<u4")])
            if len(begins) != len(part) or begins[0]:
                raise ValueError("the tokenizer does not start a piece at each space")
            datas.append(data)
            starts.append(size + 4 * begins)
            size += len(data)
        offsets = np.concatenate([*starts, [size]]).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(datas))])

    def _known(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of distinct space-led words; those not kept are learned. When too much is kept, words not met again go."""
        full = len(self.met) > CACHE_WORDS or sum(x.nbytes for x in (*self.words, *self.ids)) > CACHE_BYTES
        if full or len(self.words) > CACHE_ARRAYS:
            keep = pa.array(self.met if full else np.ones(len(self.met), bool))
            self.words, self.ids = ([pa.chunked_array(x).filter(keep).combine_chunks()] for x in (self.words, self.ids))
            self.met = np.zeros(len(self.words[0]), bool) if full else self.met
        # The hash table is made of the step's words, which are fewer.
        found = pa.compute.fill_null(pa.compute.index_in(pa.chunked_array(self.words), value_set=words), -1).to_numpy()
        again, places = np.flatnonzero(found >= 0), np.full(len(words), -1)
        self.met[again] = True
        places[found[again]] = np.arange(len(again))
        begins = np.cumsum([0, *(len(x) for x in self.ids)])
        hits = np.split(again, np.searchsorted(again, begins[1:-1]))
        ids = [x.take(pa.array(hit - begin)) for x, hit, begin in zip(self.ids, hits, begins[:-1], strict=True)]
        new = np.flatnonzero(places < 0)
        if len(new):
            places[new] = len(again) + np.arange(len(new))
            # What a step learns is an array of its own: those of the steps before are not copied.
            self.words.append(words.take(pa.array(new)))
            self.ids.append(self._learn(self.words[-1]))
            self.met = np.concatenate((self.met, np.zeros(len(new), bool)))
            ids.append(self.ids[-1])
        return pa.concat_arrays(ids).take(pa.array(places))

    def _whole(self, texts: list[bytes]) -> list[bool]:
        """Which texts the tokenizer has to see whole."""
        joined = b"\0".join(texts)
        white = _WHITE[np.frombuffer(joined, np.uint8)]
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        whole = np.zeros(len(texts), bool)
        whole[np.searchsorted(begins, np.flatnonzero(white[:-1] & white[1:]), side="right") - 1] = True
        for sign in (s for s in (*_WIDE_WHITE, *self.special) if s in joined):
            for i in np.flatnonzero(~whole).tolist():
                if sign in texts[i]:
                    whole[i] = sign in self.special or TOUCHING.search(texts[i].decode()) is not None
        return whole.tolist()

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        whole = self._whole(texts)
        lists = pa.compute.split_pattern(pa.array([t for t, w in zip(texts, whole, strict=True) if not w], pa.binary()).cast(pa.string()), " ")
        begins = lists.offsets.to_numpy()[:-1]
        encoded = lists.flatten().dictionary_encode()
        words, codes = encoded.dictionary, encoded.indices.to_numpy()
        # A text's first word has no space before it, an empty last one is a space alone.
        empty = pa.compute.index(words, "").as_py()
        led = np.zeros(len(words) + 1, bool)
        led[np.delete(codes, begins)] = True
        led[empty] = False
        led = np.flatnonzero(led)
        heads, own = np.unique(codes[begins], return_inverse=True)
        singles = [self._plain(" "), *(self._plain(words[i].as_py()) for i in heads.tolist())]
        table = pa.concat_arrays([self._known(words.take(pa.array(led))), pa.array(singles, pa.large_binary())])
        slots = np.full(len(words), len(led), np.int32)
        slots[led] = np.arange(len(led))
        slots = slots[codes]
        slots[begins] = len(led) + 1 + own
        joined = table.take(pa.array(slots))
        ends = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1] // 4
        ids = np.frombuffer(joined.buffers()[2] or b"", "<u4")
        cuts = iter(np.split(ids[: ends[-1]], ends[begins[1:]])) if len(begins) else iter(())
        return [np.frombuffer(self._plain(t.decode()), "<u4") if w else next(cuts) for t, w in zip(texts, whole, strict=True)]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text.encode()])[0].tobytes()


@functools.cache
def encoder(path: str) -> PieceEncoder:
    """One for each Python process, so that its words outlive a task."""
    return PieceEncoder(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    start, part = 0, TaskContext.get().partitionId()
    end = np.array([end_id], "<u4")
    for rows, texts in steps(batches, most=STEP_BYTES):
        ids = encoder(path).encode_all([t or b"" for t in texts])
        lengths = np.array([len(x) + 1 for x in ids], np.int64)
        starts = start + np.concatenate(([0], np.cumsum(lengths)[:-1]))
        start += int(lengths.sum())
        flat = np.concatenate([x for own in ids for x in (own, end)]).view(np.int32)
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], schema=_ARROW
        )


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10) -> None:
    """Writes the ids of ``docs`` (doc_id, text) in ascending doc_id order.

    A null text is empty: its row holds the end id alone. Null ids come first; rows that share an
    id are ordered by text. Every row is kept.
    """
    order = (F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = picked.repartitionByRange(order[0]).sortWithinPartitions(*order)
    writer = ranged.mapInArrow(lambda batches: _encode(batches, tokenizer, end_id), ROW_SCHEMA).write
    options = {
        "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#tokens.list.element": "true", "compression": "zstd",
    }
    for name, value in options.items():
        writer = writer.option(name, value)
    writer.parquet(path)


def read(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """The rows of the files with ``start``, the number of ids of all documents before; without
    ``tokens`` the list column is not read.
    """
    files = spark.read.schema(ROW_SCHEMA).parquet(path)
    # One row per file: the list of files is no longer than Spark's own.
    ends = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = ends.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    chosen = ("doc_id", "part", "part_start", "n_tokens", *(("tokens",) if tokens else ()))
    return files.select(*chosen).join(F.broadcast(starts), "part").withColumn("start", F.col("before") + F.col("part_start")).drop("part", "part_start", "before")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)]
        counted = pa.array(np.diff(offsets).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counted, pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens (counted in the list) and the crc32 of the ids as unsigned 32-bit integers."""
    return rows.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(_digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
