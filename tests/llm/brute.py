"""Plain loops that say what the corpus operators have to give."""

import re
from collections import defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def repeats(docs, width):
    """Kept words and number removed of [(doc_id, text)], in the given order, which must be document order."""
    first, out = {}, []
    for place, (_, text) in enumerate(docs):
        own = words(text)
        gone = set()
        for i in range(len(own) - width + 1):
            window = tuple(own[i : i + width])
            if first.setdefault(window, (place, i)) != (place, i):
                gone.update(range(i, i + width))
        out.append(([w for i, w in enumerate(own) if i not in gone], len(gone)))
    return out


def shingles(text, width):
    own = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not own:
        return frozenset()
    return frozenset(tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1)))


def components(docs, width, percent):
    """(n_shingles, smallest index reachable) of each text, by comparing all pairs."""
    sets = [shingles(t, width) for t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def top_k(vectors, k, every):
    """{query_id: [(vec_id, score)]} of [(vec_id, integer components)]."""
    out = {}
    for q, query in vectors:
        if q % every == 0:
            scored = [(-sum(a * b for a, b in zip(query, v, strict=True)), i) for i, v in vectors if i != q and len(v) == len(query)]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def leaks(docs, items):
    """{(doc, item, doc_start): n_equal} for windows of 12 tokens with at most two substitutions; shorter items whole."""
    # Letters of scripts without blanks stand alone.
    split = lambda t: re.findall(r"[\u0e00-\u0eff\u3040-\u30ff\u4e00-\u9fff]|(?:(?![\u0e00-\u0eff\u3040-\u30ff\u4e00-\u9fff])[^\W_])+", (t or "").lower())
    found = {}
    for d, text in docs:
        own = split(text)
        for b, item in items:
            other = split(item)
            n = len(other)
            for start in range(-n + 1, len(own)):
                agree = [0 <= start + j < len(own) and own[start + j] == w for j, w in enumerate(other)]
                if n >= 12:
                    met = any(sum(agree[s : s + 12]) >= 10 for s in range(n - 11))
                else:
                    met = n > 0 and sum(agree) >= n - (n >= 6) and (n >= 3 or own == other)
                if met:
                    found[d, b, start] = sum(agree)
    return found


def by_key(rows, *keys):
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[k] for k in keys)].append(r)
    return out
