"""Quality by compression: zstandard dictionaries of good and of bad text.

A text is compressed in blocks with either dictionary; what the bad one needs more than the good
one, as a share of the text's length, tells which kind of text it resembles. Blocks keep the
dictionaries decisive in long texts, where a stream would soon learn from itself. A logistic curve
over this difference, fitted to labelled texts that no dictionary has seen, makes it a probability.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.durable import broadcast_if_small, durable
from tidewatch.llm.common import quoted, ship, steps

# Bytes compressed at a time, and the level.
BLOCK, LEVEL = 1_024, 1


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the curve: logit = weights . features."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]


class _Sizer:
    """Compressed sizes of texts under a dictionary."""

    def __init__(self, dictionary: bytes) -> None:
        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, text: bytes) -> int:
        compress = self.compressor.compress
        return sum(len(compress(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK))


def features(texts: list[bytes | None], good: _Sizer, bad: _Sizer) -> np.ndarray:
    """A line per text: 1, the normalised difference, and the same damped for texts shorter than a block."""
    out = np.zeros((len(texts), 3))
    out[:, 0] = 1
    for i, text in enumerate(texts):
        if text:
            difference = (bad.size(text) - good.size(text)) / len(text)
            out[i, 1:] = difference, difference * min(1.0, len(text) / BLOCK)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 40) -> np.ndarray:
    """Newton's method for logistic regression; the ridge keeps separable data finite."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; the texts' own bytes where they are too few to train on."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(size, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(blocks)[-size:] or b"\n" * 8


def fit(good: list[bytes], bad: list[bytes], dictionary_bytes: int = 32 << 10) -> Model:
    """Dictionaries from every other text, the curve from the rest (from all where a class has but one)."""
    cut = lambda texts, k: texts[k::2] or texts
    model = Model(_dictionary(cut(good, 0), dictionary_bytes), _dictionary(cut(bad, 0), dictionary_bytes), ())
    rest = cut(good, 1) + cut(bad, 1)
    if not rest:
        return Model(model.good, model.bad, (0.0, 0.0, 0.0))
    y = np.array([1.0] * len(cut(good, 1)) + [0.0] * len(cut(bad, 1)))
    x = features(rest, _Sizer(model.good), _Sizer(model.bad))
    return Model(model.good, model.bad, tuple(_logistic(x, y)))


def sample(docs: DataFrame, labels: DataFrame, allowed: Column, most: int, most_chars: int) -> tuple[list[bytes], list[bytes]]:
    """Good and bad texts: at most ``most`` labelled ids of each class, taken by a digest of the id, so
    that the sample is the same on every run, and only texts of up to ``most_chars`` characters.

    Ids labelled both ways, null labels and labels other than 0 and 1 are left out.
    """
    clear = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("q")).where(F.col("quality") == F.col("q")).where(allowed)
    order = F.xxhash64("doc_id")
    picked = [clear.where(F.col("quality") == q).select("doc_id", "quality").orderBy(order, "doc_id").limit(most) for q in (1, 0)]
    ids = durable(picked[0].unionByName(picked[1]), "label_sample")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text").between(1, most_chars))
    # One text per id, so that rows that share an id don't swell the sample.
    found = texts.join(broadcast_if_small(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = found.orderBy("doc_id").collect()  # 2 * most texts of bounded length
    return [r.text.encode() for r in rows if r.quality == 1], [r.text.encode() for r in rows if r.quality == 0]


def _score(batches: Iterator[pa.RecordBatch], model: Model, kept: int, text: str) -> Iterator[pa.RecordBatch]:
    good, bad, weights = _Sizer(model.good), _Sizer(model.bad), np.array(model.weights)
    for rows, texts in steps(batches, text=text):
        logits = features(texts, good, bad) @ weights
        yield pa.RecordBatch.from_arrays([*rows.columns[:kept], pa.array(1 / (1 + np.exp(-np.clip(logits, -30, 30))))], names=[*rows.schema.names[:kept], "_score"])


def score(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``columns`` of ``docs`` and, as ``name``, the probability of label 1.

    Null and empty texts get what the curve gives to no difference. Every row is scored on its whole
    text alone, so repeated rows score alike.
    """
    ship(docs.sparkSession)
    # Columns are numbered on the way, so that none can clash with the score's.
    numbered = docs.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)))
    fields, text = numbered.schema.fields, F.col("text").cast("string")
    if "text" in columns and isinstance(docs.schema["text"].dataType, T.StringType):
        # The text goes to Python once.
        own = f"c{columns.index('text')}"
    else:
        numbered, own = docs.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)), text.alias("_text")), "_text"
    schema = T.StructType([*fields, T.StructField("_score", T.DoubleType())])
    scored = numbered.mapInArrow(lambda batches: _score(batches, model, len(columns), own), schema)
    return scored.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), F.col("_score").alias(name))


def trained(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = 3_000, most_chars: int = 20_000) -> Model:
    """A model from at most ``most`` labelled texts a class among ids for which ``allowed`` holds."""
    return fit(*sample(docs, labels, allowed, most, most_chars))
