"""Phrase collocations by a weighted de Bruijn graph of the corpus's words.

Nodes are pairs of words, an edge joins two pairs that overlap in a word: it is a run of three words,
and its weight is how often it occurs. The ends of pieces are edges to an end mark, so every word
begins exactly one edge. Only these edges are counted over the corpus. A pair's count is the flow out
of its node, end edges included; a word's is the flow out of all pairs that it begins. Paths through
nodes that have one frequent edge in and one out are compacted: they are longer phrases that always
go on alike.

Words that occur too rarely to be part of a candidate are one and the same to the graph, which needs
only the frequent ones apart: these are numbered, so that an edge takes two longs. The numbers are
broadcast as long as they take few bytes; beyond that, an edge carries its words' 64-bit keys, which
are checked to differ for all words of the corpus. Edges are combined within a task before they are
moved, then sorted by node and scanned once; no list of a node's edges is ever built.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.durable import broadcast_if_small, durable
from tidewatch.llm.common import ship, steps
from tidewatch.llm.textwords import U, base_of, mixed, signed, span_hashes

# What may be broadcast of the words' numbers (16 bytes each), and the text of a step.
DICTIONARY_BYTES, STEP_BYTES = 64 << 20, 4 << 20
UNKNOWN = "und"
# Codes below those of words: the end of a piece, and a word too rare to matter.
END, RARE, FIRST = 0, 1, 2

_BETWEEN = np.zeros(256, np.uint8)
_BETWEEN[[9, 32]] = 1
# The characters that end a piece.
_BETWEEN[list(b".,;:!?\n\x0b\x0c\r")] = 2


@dataclass
class _Words:
    """The words of a step: where they are in ``raw``, their text and piece, and a key by language and word."""

    raw: bytes
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    piece: np.ndarray
    keys: np.ndarray


def _keys(hashes: np.ndarray, languages: np.ndarray) -> np.ndarray:
    return mixed(hashes + mixed(languages))


def _split(texts: list[bytes | None], languages: list[str], seed: int) -> _Words:
    raw = b"\n".join([t or b"" for t in texts]) + b"\n"
    kinds = _BETWEEN[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(np.diff(kinds > 0, prepend=True))
    starts, ends = edges[0::2], edges[1::2]
    # Pieces end at separators and between texts.
    breaks = np.flatnonzero(kinds == 2)
    begins = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    text = np.searchsorted(begins, starts, side="right") - 1
    names = [name.encode() for name in languages]
    joined = b" ".join(names)
    at = np.cumsum([0, *(len(n) + 1 for n in names)])[:-1]
    of_text = span_hashes(joined, at, at + np.array([len(n) for n in names]), base=base_of(seed))
    keys = _keys(span_hashes(raw, starts, ends, lower=True, base=base_of(seed)), of_text[text]) if len(starts) else np.zeros(0, U)
    return _Words(raw, starts, ends, text, np.searchsorted(breaks, starts), keys)


def _steps(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[list[str], _Words]]:
    for rows, texts in steps(batches, most=STEP_BYTES):
        languages = rows.column(0).to_pylist()
        yield languages, _split(texts, languages, seed)


def _vocabulary(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for languages, words in _steps(batches, seed):
        keys, first, counts = np.unique(words.keys, return_index=True, return_counts=True)
        found = [words.raw[a:b].lower() for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)]
        of = [languages[i] for i in words.text[first].tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(of, pa.string()), pa.array(signed(keys)), pa.array(found, pa.binary()).cast(pa.string()), pa.array(counts.astype(np.int64))], names=["lang", "key", "word", "n"]
        )


def _languages(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))


def vocabulary(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, key, word, n) of all words of ``docs`` (lang, text), and the seed with which no two have the same key."""
    picked, seed = _languages(docs), 0
    while True:
        counted = picked.mapInArrow(lambda batches, seed=seed: _vocabulary(batches, seed), "lang string, key bigint, word string, n bigint")
        words = durable(counted.groupBy("lang", "key", "word").agg(F.sum("n").alias("n")), "vocabulary")
        if words.groupBy("key").count().where(f"count > 1 OR key IN ({END}, {RARE})").isEmpty():
            return words, seed
        seed += 1


def _numbered(words: DataFrame) -> DataFrame:
    """``words`` with a dense ``code`` from FIRST on."""
    placed = words.repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id())
    placed = durable(placed.withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "coded")
    # A row per partition.
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = durable(sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before")), "code_offsets")
    return durable(placed.join(broadcast_if_small(before), "part").withColumn("code", F.col("before") + F.col("at") + FIRST).drop("part", "at", "before"), "codes")


# Edges


def _edges(batches: Iterator[pa.RecordBatch], seed: int, known: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """The edges of each step with their counts: (ab, cn) packed where words have numbers, else (a, b, c, n)."""
    for _, words in _steps(batches, seed):
        if not len(words.keys):
            continue
        if known is None:
            codes, frequent = signed(words.keys), np.ones(len(words.keys), bool)
        else:
            keys, numbers = known
            at = np.minimum(np.searchsorted(keys, words.keys), max(len(keys) - 1, 0))
            frequent = keys[at] == words.keys if len(keys) else np.zeros(len(words.keys), bool)
            codes = np.where(frequent, numbers[at] if len(keys) else 0, RARE)
        padded = np.concatenate((codes, [END, END]))
        piece = np.concatenate((words.piece, [-1, -1]))
        second = np.where(piece[1:-1] == words.piece, padded[1:-1], END)
        third = np.where(piece[2:] == words.piece, padded[2:], END)
        third = np.where(second == END, END, np.where(second == RARE, RARE, third))
        a, b, c = codes[frequent], second[frequent], third[frequent]
        if not len(a):
            continue
        if known is None:
            order = np.lexsort((c, b, a))
            a, b, c = a[order], b[order], c[order]
            new = np.flatnonzero(np.concatenate(([True], (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(c) != 0))))
            counts = np.diff(np.append(new, len(a)))
            yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (a, b, c)] + [pa.array(counts)], names=["a", "b", "c", "n"])
        else:
            pair = a << 32 | b
            order = np.lexsort((c, pair))
            pair, c = pair[order], c[order]
            new = np.flatnonzero(np.concatenate(([True], (np.diff(pair) != 0) | (np.diff(c) != 0))))
            counts = np.diff(np.append(new, len(pair)))
            yield pa.RecordBatch.from_arrays([pa.array(pair[new]), pa.array(c[new] << 32 | counts)], names=["ab", "cn"])


_GRAPH = "words int, a bigint, b bigint, c bigint, f bigint"


def _rows(words: int, a: np.ndarray, b: np.ndarray, c: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    full = [np.full(len(f), words, np.int32), a, b, c, f]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in full], names=["words", "a", "b", "c", "f"])


def _scan(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Counts from edges sorted by node: runs of three and pairs that occur ``least`` times, and parts of words' counts.

    The last edge of a batch, and the flow of its node so far, wait for the next batch.
    """
    waiting = np.zeros((4, 0), np.int64)
    flow = np.zeros((3, 0), np.int64)

    def told(edges: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal flow
        a, b, c, n = edges
        often = (n >= least) & (c >= FIRST) if packed else (n >= least) & (c != END)
        yield _rows(3, a[often], b[often], c[often], n[often])
        a, b, n = (np.concatenate((x, y)) for x, y in zip(flow, (a, b, n), strict=True))
        new = np.flatnonzero(np.concatenate(([True], (np.diff(a) != 0) | (np.diff(b) != 0)))) if len(a) else np.zeros(0, np.int64)
        flow = np.stack((a[new], b[new], np.add.reduceat(n, new) if len(new) else n))
        kept = 0 if last else 1
        (a, b, n), flow = flow[:, : flow.shape[1] - kept], flow[:, flow.shape[1] - kept :]
        often = (n >= least) & (b >= FIRST) if packed else (n >= least) & (b != END)
        yield _rows(2, a[often], b[often], np.zeros(int(often.sum()), np.int64), n[often])
        if len(a):
            new = np.flatnonzero(np.concatenate(([True], np.diff(a) != 0)))
            none = np.zeros(len(new), np.int64)
            yield _rows(1, a[new], none, none, np.add.reduceat(n, new))

    packed = True
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        packed = len(columns) == 2
        if packed:
            ab, cn = columns
            columns = [ab >> 32, ab & 0xFFFFFFFF, cn >> 32, cn & 0xFFFFFFFF]
        a, b, c, n = np.concatenate((waiting, np.stack(columns)), axis=1)
        if not len(a):
            continue
        new = np.flatnonzero(np.concatenate(([True], (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(c) != 0))))
        edges = np.stack((a[new], b[new], c[new], np.add.reduceat(n, new)))
        waiting = edges[:, -1:]
        yield from told(edges[:, :-1], False)
    yield from told(waiting, True)


def graph(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts (words, a, b, c, f) of runs of 1, 2 and 3 words; (code, lang, word); and (lang, n)."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    words, seed = vocabulary(docs)
    frequent = durable(words.where(F.col("n") >= least).select("lang", "key", "word"), "frequent")
    if frequent.count() * 16 <= DICTIONARY_BYTES:
        coded = _numbered(frequent)
        listed = coded.select("key", "code").toArrow()
        keys = listed["key"].to_numpy().view(U)
        order = np.argsort(keys)
        known = spark.sparkContext.broadcast((keys[order], listed["code"].to_numpy()[order]))
        columns, schema = ("ab", "cn"), "ab bigint, cn bigint"
        edges = _languages(docs).mapInArrow(lambda batches: _edges(batches, seed, known.value), schema)
        dealt = edges.repartition("ab")
    else:
        coded = frequent.withColumn("code", F.col("key"))
        columns, schema = ("a", "b", "c", "n"), "a bigint, b bigint, c bigint, n bigint"
        dealt = _languages(docs).mapInArrow(lambda batches: _edges(batches, seed, None), schema).repartition("a", "b")
    counts = durable(dealt.sortWithinPartitions(*columns).mapInArrow(lambda batches: _scan(batches, least), _GRAPH), "graph")
    totals = durable(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    return counts, coded.select("code", "lang", "word"), totals


def unary_paths(edges: DataFrame) -> DataFrame:
    """(a, b, head_a, head_b, nodes): the nodes of compacted paths of more than one, their first node and how many they are.

    An edge is compacted if no other leaves its first node and no other enters its second. Cycles
    without a beginning are left as they are.
    """
    leaving = edges.groupBy("a", "b").agg(F.count("*").alias("leaving")).where("leaving = 1").select("a", "b")
    entering = edges.groupBy("b", "c").agg(F.count("*").alias("entering")).where("entering = 1").select("b", "c")
    inner = edges.where("NOT (a = b AND b = c)").join(leaving, ["a", "b"], "left_semi").join(entering, ["b", "c"], "left_semi")
    # Each node but the first points to the one before it.
    links = durable(inner.select(F.col("b").alias("x"), F.col("c").alias("y"), F.col("a").alias("up_x"), F.col("b").alias("up_y")), "links")
    known, reached = links.withColumn("found", F.lit(False)), -1
    while True:
        ahead = known.select(F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("up_x").alias("far_x"), F.col("up_y").alias("far_y"), F.col("found").alias("far_found"))
        jumped = known.join(broadcast_if_small(ahead), ["up_x", "up_y"], "left")
        at_end = F.col("far_x").isNull() | F.col("far_found")
        known = durable(jumped.select("x", "y", F.coalesce("far_x", "up_x").alias("up_x"), F.coalesce("far_y", "up_y").alias("up_y"), at_end.alias("found")), "paths")
        now = known.where("found").count()
        if now == reached:
            break
        reached = now
    ended = known.where("found").select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("up_x").alias("head_a"), F.col("up_y").alias("head_b"))
    lengths = durable(ended.groupBy("head_a", "head_b").agg((F.count("*") + 1).alias("nodes")), "lengths")
    firsts = lengths.select(F.col("head_a").alias("a"), F.col("head_b").alias("b"), "head_a", "head_b", "nodes")
    return durable(ended.join(lengths, ["head_a", "head_b"]).select("a", "b", "head_a", "head_b", "nodes").unionByName(firsts), "compacted")


def _score(whole: str, left: str, right: str) -> Column:
    """floor(1,000,000 * a * a / (l * r)), exactly; never above 1,000,000."""
    return F.expr(f"(CAST({whole} AS DECIMAL(14,0)) * CAST({whole} AS DECIMAL(14,0)) * 1000000) div (CAST({left} AS DECIMAL(14,0)) * CAST({right} AS DECIMAL(14,0)))")


def collocations(docs: DataFrame, least: int = 10, absorb_percent: int = 50, most: int = 2_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score and path_words of each language's ``most`` best phrases of two or three words.

    A phrase occurs ``least`` times or more within pieces (a); cut where that scores least, its parts
    occur l and r times; n words occur in the language. A phrase is left out if a longer candidate
    that contains it occurs ``absorb_percent`` as often or more. ``path_words`` is the length of the
    compacted path that the phrase lies on, its own without one. Ties: by a, then in byte order of
    the phrase. A null lang is ``und``, a null text empty; repeated rows count each; an empty table
    gives an empty result; other columns are not read.
    """
    counts, coded, totals = graph(docs, least)
    words = durable(counts.where("words = 1").groupBy("a").agg(F.sum("f").alias("f")), "word_counts")
    pairs = durable(counts.where("words = 2").select("a", "b", "f"), "pairs")
    edges = durable(counts.where("words = 3").select("a", "b", "c", "f"), "edges")

    one = lambda name, f: broadcast_if_small(words.select(F.col("a").alias(name), F.col("f").alias(f)))
    two = lambda x, y, f: broadcast_if_small(pairs.select(F.col("a").alias(x), F.col("b").alias(y), F.col("f").alias(f)))
    longer = edges.withColumnRenamed("f", "whole")
    cut = longer.join(one("a", "f_a"), "a").join(one("c", "f_c"), "c").join(two("a", "b", "f_ab"), ["a", "b"]).join(two("b", "c", "f_bc"), ["b", "c"])
    cut = cut.withColumn("early", _score("whole", "f_a", "f_bc")).withColumn("late", _score("whole", "f_ab", "f_c"))
    first = F.col("early") <= F.col("late")
    threes = durable(cut.select("a", "b", "c", "whole", *(F.when(first, x).otherwise(y).alias(name) for x, y, name in ((F.col("f_a"), F.col("f_ab"), "l"), (F.col("f_bc"), F.col("f_c"), "r"), (F.col("early"), F.col("late"), "score")))), "threes")

    # The most frequent edge at either side of a pair.
    beside = edges.select("a", "b", "f").unionByName(edges.select(F.col("b").alias("a"), F.col("c").alias("b"), "f")).groupBy("a", "b").agg(F.max("f").alias("longest"))
    alone = pairs.withColumnRenamed("f", "whole").join(broadcast_if_small(durable(beside, "beside")), ["a", "b"], "left")
    alone = alone.where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("whole") * absorb_percent))
    twos = alone.join(one("a", "l"), "a").join(one("b", "r"), "b").select("a", "b", F.lit(END).cast("bigint").alias("c"), "whole", "l", "r", _score("whole", "l", "r").alias("score"))

    paths = broadcast_if_small(unary_paths(edges))
    # An edge lies on a path if its second node does and is not where the path begins.
    ends = paths.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("head_a").alias("end_a"), F.col("head_b").alias("end_b"))
    placed = twos.unionByName(threes).join(paths, ["a", "b"], "left").join(broadcast_if_small(durable(ends, "path_ends")), ["b", "c"], "left")
    inner = (F.col("c") == END) | (F.col("end_a").isNotNull() & ((F.col("b") != F.col("end_a")) | (F.col("c") != F.col("end_b"))))
    own = F.when(F.col("c") == END, 2).otherwise(3)
    placed = durable(placed.select("a", "b", "c", "whole", "l", "r", "score", F.when(inner & F.col("nodes").isNotNull(), F.col("nodes") + 1).otherwise(own).alias("path_words")), "candidates")

    named = lambda code, word, *more: broadcast_if_small(coded.select(F.col("code").alias(code), F.col("word").alias(word), *more))
    told = placed.join(named("a", "w1", "lang"), "a").join(named("b", "w2"), "b").join(named("c", "w3"), "c", "left")
    told = durable(told.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("whole").alias("a"), "l", "r", "score", "path_words"), "phrases")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    best = told.withColumn("rank", place).where(F.col("rank") <= most)
    return best.join(broadcast_if_small(totals), "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score", "path_words")
