"""Vectorised word hashes of many texts at once (numpy inside Spark tasks).

A word's hash depends on its bytes only; a run's hash on its words' hashes and their order. All are
64 bits wide and the same on every machine.
"""

import functools

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_EXACT = np.arange(1, 257, dtype=U)
_LOWER = _EXACT.copy()
_LOWER[65:91] += U(32)

# Bytes that are hashed at once, whatever the length of texts and words.
CHUNK = 1 << 18


def base_of(seed: int) -> int:
    """An odd number for each seed; words that have the same hash with one have different ones with another."""
    return (_BASE + 2 * seed * 0x632BE59BD9B4E019) % (1 << 64)


@functools.lru_cache(maxsize=4)
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base and its inverse to the powers 0, 1, ... CHUNK modulo 2 ** 64."""
    factors = np.full((2, CHUNK + 1), base, U)
    factors[1] = pow(base, -1, 1 << 64)
    factors[:, 0] = 1
    up, down = np.multiply.accumulate(factors, axis=1)
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _hashed(data: np.ndarray, table: np.ndarray | None, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    up, down = _powers(base)
    values_of = lambda a, b: table[data[a:b]] if table is not None else data[a:b].astype(U) + U(1)
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        begin = int(starts[i])
        j = int(np.searchsorted(ends, begin + CHUNK, side="right"))
        if j <= i:
            # A span longer than a chunk is the sum of its chunks, each by the power of its place.
            total = 0
            for at in range(begin, int(ends[i]), CHUNK):
                part = values_of(at, min(at + CHUNK, int(ends[i])))
                total += int((part * up[: len(part)]).sum(dtype=U)) * pow(base, at - begin, 1 << 64)
            out[i] = total % (1 << 64)
            i += 1
            continue
        values = values_of(begin, int(ends[j - 1]))
        values *= up[: len(values)]
        sums = np.concatenate((np.zeros(1, U), np.cumsum(values, dtype=U)))
        out[i:j] = (sums[ends[i:j] - begin] - sums[starts[i:j] - begin]) * down[starts[i:j] - begin]
        i = j
    return mixed(out)


def span_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray, lower: bool = False, base: int = _BASE) -> np.ndarray:
    """The hash of each span of ``raw`` (in order, not overlapping); ``lower`` takes A-Z as a-z."""
    return _hashed(np.frombuffer(raw, np.uint8), _LOWER if lower else _EXACT, starts, ends, base)


def number_hashes(numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same of spans of unsigned numbers."""
    return _hashed(numbers, None, starts, ends, _BASE)


def word_hashes(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one more entry at the end).

    A word is a run of anything but the six ASCII white-space characters; ``lower`` takes A-Z as a-z.
    """
    lengths = np.array([len(t) if t else 0 for t in texts], np.int64)
    raw = b" ".join([t or b"" for t in texts]) + b" "
    edges = np.flatnonzero(np.diff(_SPACES[np.frombuffer(raw, np.uint8)], prepend=True))
    starts, ends = edges[0::2], edges[1::2]
    begins = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths + 1)))
    return span_hashes(raw, starts, ends, lower), np.searchsorted(starts, begins)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive words, by the first's position."""
    if len(words) < n:
        return np.zeros(0, U)
    total = np.zeros(len(words) - n + 1, U)
    for j in range(n):
        total += words[j : len(words) - n + 1 + j] * U(pow(_BASE, j + 2, 1 << 64))
    return mixed(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    have = 1
    out = values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as a Spark long."""
    return np.ascontiguousarray(x).view(np.int64)
