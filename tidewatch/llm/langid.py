"""Language identification of words in code-switched text by a linear-chain conditional random field.

A line of text (long lines are cut) is a sequence of words; the label of a word is its language.
Features of a word are its affixes, its letter n-grams and, for frequent words, the word itself;
learned transitions tell how languages follow each other. Labels are by document, so sequences of
several languages are spliced from documents of one each to learn the transitions. The
forward-backward algorithm gives each word's distribution; a document's is the mean over its words.

Texts are cut on their code points, many at once; features are hashes of letters, and emissions are
computed once per distinct word of a step. Forward and backward run over many lines at once, laid
out by position, so that each position is one slice and no padding is computed.
"""

import functools
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.durable import broadcast_if_small, durable
from tidewatch.llm.common import ship, steps
from tidewatch.llm.textwords import U, mixed, number_hashes

# Words of a sequence at most; letters of a word that is a feature as a whole; numbers of a table of words by
# languages that are worked on at once; characters that are worked on at once.
LINE, WHOLE, CELLS, CHARACTERS = 128, 32, 1 << 24, 3 << 20
# Up to so many languages, steps have their full size.
MANY = 64
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Weights: a line per feature (sorted hashes), a column per language; transitions from line to column."""

    languages: tuple[str, ...]
    features: np.ndarray
    weights: np.ndarray
    start: np.ndarray
    transitions: np.ndarray


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is white space, whether a letter, and its lower-case letter."""
    every = [chr(i) for i in range(0x110000)]
    white = np.array([c.isspace() for c in every])
    letter = np.array([unicodedata.category(c)[0] == "L" for c in every])
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(letter).tolist():
        small = every[i].lower()
        if len(small) == 1:
            lower[i] = ord(small)
    return white, letter, lower


@dataclass
class Cut:
    """Texts cut into words and sequences, in order; of their letters, in lower case, each word has a span."""

    joined: str
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    lengths: np.ndarray
    letters: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray


def cut(texts: list[str]) -> Cut:
    """Sequences are lines, cut after LINE words."""
    white, letter, lower = _characters()
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    edges = np.flatnonzero(np.diff(white[points], prepend=True))
    starts, ends = edges[0::2], edges[1::2]
    text = np.searchsorted(np.cumsum([0, *(len(t) + 1 for t in texts)]), starts, side="right") - 1
    line = np.searchsorted(np.flatnonzero(points == 10), starts)
    at = np.arange(len(starts))
    first = np.maximum.accumulate(np.where(np.diff(line, prepend=-1) != 0, at, 0)) if len(at) else at
    lengths = np.diff(np.append(np.flatnonzero((at - first) % LINE == 0), len(at)))
    known = letter[points]
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum(known)))
    return Cut(joined, starts, ends, text, lengths, lower[points[known]], before[starts], before[ends] - before[starts])


def _features(letters: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of all features of words: affixes of up to four letters, n-grams of two and three, and short words whole."""
    values = mixed(letters.astype(U))
    owners, hashes = [], []

    def add(kind: int, n: int, words: np.ndarray, places: np.ndarray) -> None:
        total = np.full(len(words), 64 * kind + n, U)
        for j in range(n):
            total = mixed(total) + values[places + j]
        owners.append(words)
        hashes.append(mixed(total))

    for n in (1, 2, 3, 4):
        words = np.flatnonzero(sizes >= n)
        add(1, n, words, begins[words])
        add(2, n, words, begins[words] + sizes[words] - n)
    for n in (2, 3):
        counts = np.maximum(sizes - n + 1, 0)
        words = np.repeat(np.arange(len(sizes)), counts)
        add(3, n, words, np.repeat(begins - np.cumsum(counts) + counts, counts) + np.arange(len(words)))
    for n in range(1, WHOLE + 1):
        words = np.flatnonzero(sizes == n)
        add(4, n, words, begins[words])
    return np.concatenate(owners), np.concatenate(hashes)


def _has_letters(word: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in word)


def sequences(text: str) -> list[list[str]]:
    """The lines' words, cut after LINE words."""
    out = []
    for line in text.split("\n"):
        words = line.split()
        out += [words[i : i + LINE] for i in range(0, len(words), LINE)]
    return out


# The field


class _Layout:
    """Sequences side by side, longest first: position t of all that have one is a slice."""

    def __init__(self, lengths: np.ndarray) -> None:
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(lengths))
        longest = int(lengths.max()) if len(lengths) else 0
        self.counts = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
        self.base = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.counts)))
        position = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        # Where each word goes, and which word each place has.
        self.place = self.base[position] + np.repeat(rank, lengths)
        self.word = np.empty_like(self.place)
        self.word[self.place] = np.arange(len(self.place))

    def slices(self) -> Iterator[tuple[int, slice, slice]]:
        """(t, the places of position t, the places before those of the same sequences)."""
        for t, n in enumerate(self.counts.tolist()):
            yield t, slice(self.base[t], self.base[t] + n), slice(self.base[t - 1], self.base[t - 1] + n) if t else slice(0, 0)


def _run(layout: _Layout, local: np.ndarray, start: np.ndarray, transitions: np.ndarray, with_pairs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(label) and the scale at each place, and the expected transitions. Forward values sum to one at each word."""
    step = np.exp(transitions).astype(local.dtype)
    begin = np.exp(start).astype(local.dtype)
    forward, scale = np.empty_like(local), np.empty(len(local), local.dtype)
    for t, own, before in layout.slices():
        value = local[own] * (forward[before] @ step if t else begin)
        scale[own] = value.sum(axis=1)
        forward[own] = value / scale[own][:, None]
    backward = np.ones_like(local)
    pairs = np.zeros_like(step)
    back = step.T.copy()
    for t, own, before in reversed(list(layout.slices())):
        if t:
            ahead = local[own] * backward[own] / scale[own][:, None]
            backward[before] = ahead @ back
            if with_pairs:
                pairs += (forward[before].T @ ahead) * step
    forward *= backward
    return forward, scale, pairs


def marginals(emissions: np.ndarray, lengths: np.ndarray, start: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(label) of each word, log likelihood of each sequence, and the expected transitions.

    ``emissions``: a line per word, sequences one after the other, as logarithms; ``lengths`` of
    the sequences, none of them 0.
    """
    layout = _Layout(lengths)
    top = emissions.max(axis=1, keepdims=True)
    p, scale, pairs = _run(layout, np.exp(emissions - top)[layout.word], start, transitions, True)
    log_scale = np.log(scale)[layout.place] + top[:, 0]
    likelihood = np.add.reduceat(log_scale, np.cumsum(lengths) - lengths) if len(lengths) else np.zeros(0)
    return p[layout.place], likelihood, pairs


def _splice(by_language: list[list[list[str]]], random: np.random.Generator, n: int) -> list[tuple[list[str], list[int]]]:
    """Training sequences: half of one language, half of pieces of two or more."""
    out = []
    ready = [i for i, lines in enumerate(by_language) if lines]
    for k in range(n):
        words: list[str] = []
        labels: list[int] = []
        pieces = 1 if k % 2 else int(random.integers(2, 5))
        for _ in range(pieces):
            language = ready[int(random.integers(len(ready)))]
            line = by_language[language][int(random.integers(len(by_language[language])))]
            size = len(line) if pieces == 1 else int(random.integers(2, 13))
            begin = int(random.integers(max(1, len(line) - size + 1)))
            piece = line[begin : begin + size]
            words += piece
            labels += [language] * len(piece)
        out.append((words[:LINE], labels[:LINE]))
    return out


def fit(texts: list[str], languages: list[str], n_sequences: int = 6_000, least: int = 4, rounds: int = 60, ridge: float = 1e-5, seed: int = 5) -> Model:
    """A field of greatest (penalised) likelihood, by Adam on all sequences.

    Features seen less than ``least`` times are left out. Without any text, the model knows no language.
    """
    names = tuple(sorted(set(languages)))
    if not names:
        return Model((), np.zeros(0, U), np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    by_language: list[list[list[str]]] = [[] for _ in names]
    for text, language in zip(texts, languages, strict=True):
        by_language[names.index(language)] += [s for s in sequences(text) if any(map(_has_letters, s))]
    if not any(by_language):
        return Model(names, np.zeros(0, U), np.zeros((0, len(names))), np.zeros(len(names)), np.zeros((len(names), len(names))))
    random = np.random.default_rng(seed)
    drawn = _splice(by_language, random, n_sequences)
    # With very many languages some are drawn rarely; each has to show its features ``least`` times.
    alone = Counter(labels[0] for words, labels in drawn if len(set(labels)) == 1 and _has_letters(words[0]))
    for language, lines in enumerate(by_language):
        for i in range(least - alone[language] if lines else 0):
            line = lines[i % len(lines)]
            drawn.append((line, [language] * len(line)))
    used = Counter(w for words, _ in drawn for w in words)
    distinct = {w: i for i, w in enumerate(sorted(used))}
    whole = cut([" ".join(distinct)])
    # Words times features as flat lists.
    owner, hashes = _features(whole.letters, whole.begins, whole.sizes)
    known, flat = np.unique(hashes, return_inverse=True)
    seen = np.bincount(flat, np.array([used[w] for w in distinct])[owner], len(known))
    often = (seen >= least)[flat]
    index = known[seen >= least]
    owner, flat = owner[often], np.searchsorted(index, hashes[often])
    n_words = len(distinct)
    tokens = np.array([distinct[w] for words, _ in drawn for w in words])
    gold = np.array([label for _, labels in drawn for label in labels])
    lengths = np.array([len(words) for words, _ in drawn])
    firsts = np.cumsum(lengths) - lengths
    inner = np.ones(len(tokens), bool)
    inner[firsts] = False
    k = len(names)
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    gold_starts = np.bincount(gold[firsts], minlength=k)
    # Whole sequences, so that a table of their words by languages has about CELLS numbers.
    part_of = (firsts * k) // CELLS
    cuts = [0, *(np.flatnonzero(np.diff(part_of)) + 1).tolist(), len(lengths)]

    parameters = [np.zeros((len(index), k)), np.zeros(k), np.zeros((k, k))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    n = len(tokens)
    for t in range(1, rounds + 1):
        weights, start, transitions = parameters
        emissions = np.stack([np.bincount(owner, weights[flat, j], n_words) for j in range(k)], axis=1)
        by_word, pairs, starts = np.zeros((n_words, k)), np.zeros((k, k)), np.zeros(k)
        for first, end in zip(cuts, cuts[1:], strict=False):
            own = slice(firsts[first], firsts[end] if end < len(firsts) else n)
            error, _, own_pairs = marginals(emissions[tokens[own]], lengths[first:end], start, transitions)
            pairs += own_pairs
            starts += error[firsts[first:end] - firsts[first]].sum(axis=0)
            error[np.arange(len(error)), gold[own]] -= 1
            by_word += np.stack([np.bincount(tokens[own], error[:, j], n_words) for j in range(k)], axis=1)
        slope = np.stack([np.bincount(flat, by_word[owner, j], len(index)) for j in range(k)], axis=1)
        gradients = [slope / n + ridge * weights, (starts - gold_starts) / n + ridge * start, (pairs - gold_pairs) / n + ridge * transitions]
        for i, gradient in enumerate(gradients):
            first, second = moments[i]
            first = 0.9 * first + 0.1 * gradient
            second = 0.99 * second + 0.01 * gradient**2
            moments[i] = (first, second)
            parameters[i] = parameters[i] - 0.08 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-7)
    return Model(names, index, parameters[0], parameters[1], parameters[2])


# Labelling


@dataclass
class _Labelled:
    """Words of texts in order: whether they have letters; P(language) in the order of ``layout``."""

    cut: Cut
    layout: _Layout
    letters: np.ndarray
    p: np.ndarray


def _label(model: Model, texts: list[str]) -> _Labelled:
    words = cut(texts)
    keys, first, of = np.unique(number_hashes(words.letters, words.begins, words.begins + words.sizes), return_index=True, return_inverse=True)
    owner, hashes = _features(words.letters, words.begins[first], words.sizes[first])
    emissions = np.zeros((len(keys), len(model.languages)))
    if len(model.features):
        at = np.minimum(np.searchsorted(model.features, hashes), len(model.features) - 1)
        hit = model.features[at] == hashes
        owner, at = owner[hit], at[hit]
        for j in range(len(model.languages)):
            emissions[:, j] = np.bincount(owner, model.weights[at, j], len(keys))
    local = np.exp(emissions - emissions.max(axis=1, keepdims=True)).astype(np.float32)
    layout = _Layout(words.lengths)
    p, _, _ = _run(layout, local[of[layout.word]], model.start, model.transitions, False)
    return _Labelled(words, layout, words.sizes > 0, p)


def _groups(texts: list[str], most: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(indices, parts) of about ``most`` characters; longer texts are cut between lines, else between words."""
    ids: list[int] = []
    parts: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > most:
                blank = max(text.rfind("\n", at, at + most), -1)
                blank = blank if blank > at else text.rfind(" ", at, at + most)
                end = blank + 1 if blank > at else at + most
            if size and size + end - at > most:
                yield np.array(ids), parts
                ids, parts, size = [], [], 0
            ids.append(i)
            parts.append(text[at:end])
            size += end - at
            at = end
    if parts:
        yield np.array(ids), parts


def _characters_at_once(model: Model) -> int:
    """So that a step's table of words by languages doesn't grow with the languages."""
    return max(1, CHARACTERS * MANY // max(MANY, len(model.languages)))


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    names, k = np.array([*model.languages, UNKNOWN]), len(model.languages)
    for rows, raw in steps(batches, most=CHARACTERS):
        sums, own = np.zeros((len(raw), k)), np.zeros(len(raw), np.int64)
        switches, last = np.zeros(len(raw), np.int64), np.full(len(raw), -1)
        for ids, parts in _groups([t.decode("utf-8") if t else "" for t in raw], _characters_at_once(model)) if k else ():
            found = _label(model, parts)
            text, letters = ids[found.cut.text], found.letters
            placed = text[found.layout.word]
            weights = letters[found.layout.word]
            for j in range(k):
                sums[:, j] += np.bincount(placed, found.p[:, j] * weights, len(raw))
            own += np.bincount(text[letters], minlength=len(raw))
            # Changes of language between neighbouring words with letters.
            owner, top = text[letters], found.p.argmax(axis=1)[found.layout.place][letters]
            if len(owner):
                changed = (top[1:] != top[:-1]) & (owner[1:] == owner[:-1])
                switches += np.bincount(owner[1:][changed], minlength=len(raw))
                switches[owner[0]] += last[owner[0]] not in (-1, top[0])
                last[owner[-1]] = top[-1]
        mean = sums / np.maximum(own, 1)[:, None]
        best, score = np.full(len(raw), k), np.zeros(len(raw))
        if k:
            best, score = np.where(own > 0, mean.argmax(axis=1), k), np.where(own > 0, np.clip(mean.max(axis=1), 0, 1), 0)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(switches)], names=["doc_id", "lang_pred", "score", "n_switches"])


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the mean probability of that language over words with letters) and
    n_switches (changes of language from word to word) of each row of ``docs``.

    ``und`` with score 0 for null and empty texts and texts without letters (numerals and marks are
    none), and for all texts if the model knows no language. Repeated rows are labelled alike. Texts
    of more than CHARACTERS characters are labelled in parts. Other columns are not read.
    """
    ship(docs.sparkSession)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(lambda batches: _predict(batches, model), "doc_id bigint, lang_pred string, score double, n_switches bigint")


def _words(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    names = np.array([*model.languages, UNKNOWN])
    for rows, raw in steps(batches, most=1 << 18):
        done = np.zeros(len(raw), np.int64)
        for ids, parts in _groups([t.decode("utf-8") if t else "" for t in raw], min(1 << 18, _characters_at_once(model))) if model.languages else ():
            found = _label(model, parts)
            text, p = ids[found.cut.text], found.p[found.layout.place]
            best = np.where(found.letters, p.argmax(axis=1), len(model.languages))
            # A text's words are counted on from its part before.
            ordinal = np.arange(len(text)) - np.searchsorted(text, text)
            flat = [found.cut.joined[a:b] for a, b in zip(found.cut.starts.tolist(), found.cut.ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(text)), pa.array(ordinal + done[text]), pa.array(flat, pa.string()), pa.array(names[best].tolist(), pa.string()), pa.array(np.where(found.letters, p.max(axis=1), 0).astype(np.float64))],
                names=["doc_id", "position", "word", "lang_pred", "probability"],
            )
            done += np.bincount(text, minlength=len(raw))


def labelled_words(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, position (from 0), word, lang_pred and probability of each word; ``und`` for words without letters."""
    ship(docs.sparkSession)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(lambda batches: _words(batches, model), "doc_id bigint, position bigint, word string, lang_pred string, probability double")


def sample(docs: DataFrame, allowed: Column, most: int, most_chars: int, most_rows: int) -> tuple[list[str], list[str]]:
    """Labelled texts of every language that has one with letters: about ``most`` a language, by a digest of
    the id, and fewer if there are so many languages that this would be above ``most_rows``, but one at least.

    Texts of 20 to ``most_chars`` characters come first; a language with fewer than its number adds
    longer ones, cut to ``most_chars`` from their first letter on, then shorter ones.
    """
    text = F.col("text").cast("string")
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & allowed & text.rlike(r"\p{L}"))
    kind = F.when(F.length(text) < 20, 2).when(F.length(text) > most_chars, 1).otherwise(0)
    digest = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    usable = known.select("lang", "doc_id", text.alias("text"), kind.alias("kind"), digest.alias("d"))
    counts = durable(usable.groupBy("lang", "kind").agg(F.count("*").alias("count"), F.min("d").alias("least")), "language_counts")
    each = max(1, min(most, most_rows // max(1, counts.select("lang").distinct().count())))
    # One row a language and kind; the first kind that a language has gives one text for certain.
    earlier = Window.partitionBy("lang").orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("count").over(earlier), F.lit(0))
    wanted = counts.select("lang", "kind", "count", (each - before).alias("wanted"), F.when(before == 0, F.col("least")).alias("least"))
    wanted = durable(wanted.where("wanted > 0"), "languages")
    # Only as many ids as the sample needs: the least digests, by a threshold that is known from the counts.
    shared = usable.join(broadcast_if_small(wanted), ["lang", "kind"])
    shared = shared.where((F.col("d") / float(1 << 40) * F.col("count") < F.col("wanted")) | F.coalesce(F.col("d") == F.col("least"), F.lit(False)))
    # More than twice the number only if many rows share an id.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("kind", "d", "doc_id", "text"))
    bounded = shared.withColumn("place", place).where(F.col("place") <= 2 * each)
    cut = F.when(F.col("kind") == 1, F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, most_chars)).otherwise(F.col("text"))
    rows = bounded.select("lang", cut.alias("text"), "d", "doc_id").orderBy("d", "doc_id", "text").collect()
    return [r.text for r in rows], [r.lang for r in rows]


def trained(docs: DataFrame, allowed: Column, most: int = 300, most_chars: int = 4_000, most_rows: int = 64 * 300) -> Model:
    """A model from about ``most`` texts of each language among rows for which ``allowed`` holds (see ``sample``)."""
    return fit(*sample(docs, allowed, most, most_chars, most_rows))
