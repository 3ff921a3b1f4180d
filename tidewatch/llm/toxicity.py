"""Severity of toxic text by cumulative-link ordinal regression.

Grades 0 (not toxic) to 3 are ordered: P(grade <= g) = sigmoid(threshold_g - w . x), with one weight
vector shared by all thresholds. Features are sparse: the distinct words of a text, lower-case
letters only, of which those that tell toxic from other text are kept. The labels say toxic or
not; a toxic text's grade comes from how many of its words belong to the words that toxic texts
have and others lack, cut at the thirds of the training sample.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.durable import broadcast_if_small, durable
from tidewatch.llm.common import steps

LETTERS = re.compile(r"[^\W\d_]+")
GRADES = 4
# Standard deviations from the mean that tell a word from chance.
CHANCE = 4.5


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]


def words(text: str) -> Counter:
    return Counter(LETTERS.findall(text.lower()))


def _telling(counted: list[Counter], toxic: np.ndarray, most: int, least: int) -> list[str]:
    """Words in at least ``least`` texts whose share of toxic texts is far from the mean, furthest first.

    Distance is a z score of the document frequencies; what chance may give is left out.
    """
    inside, everywhere = Counter(), Counter()
    for counts, bad in zip(counted, toxic, strict=True):
        everywhere.update(counts.keys())
        if bad:
            inside.update(counts.keys())
    share = toxic.mean()
    scored = [(-abs(inside[w] - n * share) / np.sqrt(n * share * (1 - share) + 1e-9), w) for w, n in everywhere.items() if n >= least]
    return [w for z, w in sorted(scored)[:most] if z <= -CHANCE]


def _grades(counted: list[Counter], toxic: np.ndarray, least: int) -> np.ndarray:
    """0 for other texts; 1 to 3 for toxic ones, by their number of words that toxic texts alone have."""
    inside, outside = Counter(), Counter()
    for counts, bad in zip(counted, toxic, strict=True):
        (inside if bad else outside).update(counts.keys())
    n, m = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    marks = {w for w, c in inside.items() if c >= least and c / n > 10 * (outside[w] + 0.5) / m}
    found = np.array([sum(c for w, c in counts.items() if w in marks) for counts in counted])
    grades = np.zeros(len(counted), int)
    if toxic.any():
        low, high = np.quantile(found[toxic], [1 / 3, 2 / 3])
        grades[toxic] = 1 + (found[toxic] > low) + (found[toxic] > high)
    return grades


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit_ordinal(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of greatest likelihood, by Adam on the full sample."""
    n, d = x.shape
    share = np.clip([(y <= g).mean() for g in range(GRADES - 1)], 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    # Thresholds are the first and the logs of the steps between them, so that they stay in order.
    steps_between = np.log(np.maximum(np.diff(start), 1e-2))
    parameters = np.concatenate((np.zeros(d), start[:1], steps_between))
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    for t in range(1, rounds + 1):
        w, raw = parameters[:d], parameters[d:]
        widths = np.exp(raw[1:])
        theta = np.concatenate(([-np.inf], raw[0] + np.concatenate(([0], np.cumsum(widths))), [np.inf]))
        z = x @ w
        upper, lower = _sigmoid(theta[y + 1] - z), _sigmoid(theta[y] - z)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        by_theta = np.zeros(GRADES + 1)
        np.add.at(by_theta, y + 1, -du / n)
        np.add.at(by_theta, y, dl / n)
        inner = by_theta[1:GRADES]
        gradient = np.concatenate((x.T @ (du - dl) / n + ridge * w, [inner.sum()], [inner[g:].sum() * widths[g - 1] for g in range(1, GRADES - 1)]))
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        parameters = parameters - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    raw = parameters[d:]
    return parameters[:d], raw[0] + np.concatenate(([0], np.cumsum(np.exp(raw[1:]))))


def fit(texts: list[str], toxic: list[bool], most_words: int = 400, least: int = 5, ridge: float = 2e-4, rounds: int = 300) -> Model:
    """A model from labelled texts; without any text of one kind, everything gets grade 0 or all of it."""
    bad = np.array(toxic, bool)
    if not len(bad) or bad.all() or not bad.any():
        return Model({}, (30.0, 31.0, 32.0) if not len(bad) or not bad.any() else (-30.0, 30.0, 31.0))
    counted = [words(t) for t in texts]
    kept = _telling(counted, bad, most_words, least)
    place = {w: i for i, w in enumerate(kept)}
    x = np.zeros((len(texts), len(kept)))
    for i, counts in enumerate(counted):
        for w in counts:
            if w in place:
                x[i, place[w]] = 1
    weights, thresholds = _fit_ordinal(x, _grades(counted, bad, least), ridge, rounds)
    return Model({w: float(v) for w, v in zip(kept, weights, strict=True)}, tuple(float(t) for t in thresholds))


def severity(texts: list[bytes | None], model: Model) -> np.ndarray:
    """P(grade = g) for each text, a line each."""
    get = model.weights.get
    z = np.array([sum(filter(None, map(get, set(LETTERS.findall(t.decode("utf-8").lower()))))) if t else 0.0 for t in texts])
    below = np.concatenate((np.zeros((len(texts), 1)), _sigmoid(np.array(model.thresholds)[None, :] - z[:, None]), np.ones((len(texts), 1))), axis=1)
    return np.diff(below, axis=1)


def _grade(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for rows, texts in steps(batches):
        p = severity(texts, model)
        expected = p @ np.arange(GRADES)
        # The grade in the middle of the distribution.
        grade = (np.cumsum(p, axis=1) < 0.5).sum(axis=1)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(expected), pa.array(1 - p[:, 0]), pa.array(grade.astype(np.int32)), pa.array(p[:, 0] < 0.5)],
            names=["doc_id", "expected_severity", "p_toxic", "grade", "toxic"],
        )


def sample(docs: DataFrame, labels: DataFrame, allowed: Column, most: int, most_chars: int) -> tuple[list[str], list[bool]]:
    """Labelled texts: at most ``most`` ids a class, by a digest of the id, texts of up to ``most_chars`` characters."""
    clear = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("t")).where(F.col("toxic") == F.col("t")).where(allowed)
    picked = [clear.where(F.col("toxic") == t).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for t in (0, 1)]
    ids = durable(picked[0].unionByName(picked[1]), "label_sample")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text").between(1, most_chars))
    rows = texts.join(broadcast_if_small(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return [r.text for r in rows], [r.toxic == 1 for r in rows]


def trained(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = 3_000, most_chars: int = 20_000) -> Model:
    """A model from at most ``most`` labelled texts a class among ids for which ``allowed`` holds."""
    return fit(*sample(docs, labels, allowed, most, most_chars))


def graded(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_severity (0 to 3), p_toxic, grade and toxic (grade above 0) of each row of ``docs``.

    Null and empty texts, and texts without known words, get what the thresholds give to nothing.
    Every row is graded on its whole text alone, so repeated rows are graded alike.
    """
    schema = "doc_id bigint, expected_severity double, p_toxic double, grade int, toxic boolean"
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(lambda batches: _grade(batches, model), schema)
