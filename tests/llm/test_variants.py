import random
import re
import zlib
from collections import Counter

from tidewatch.llm import variants


def expected(rows, least_length, least_count, times, slips):
    """The same by comparing every two words."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            digest = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if slips and digest % slips == 0:
                at = digest % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, {}
    for word, n in words.items():
        close = [w for w in words if w != word and near(w, word)]
        best = min(close, key=lambda w: (-words[w], w), default=None)
        form[word] = best if best and words[best] >= times * n else None
        out[word] = [form[word], None, n, len(close), words[best] if form[word] else None]
    for word in words:
        root = word
        while form[root]:
            root = form[root]
        out[word][1] = root
    return {w: tuple(v) for w, v in out.items()}


def run(spark, rows, **settings):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, word string, n int")
    got = variants.variants(docs, **settings).collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aaabé") for _ in range(rng.randint(3, 6))) for _ in range(60)]
    words += ["ABBa", "aÀa", "aàa", "a×b÷", "ÿÿÿÿ"]
    # A few words are far more frequent than the rest, so that there are forms of forms.
    weights = [rng.choice([1, 1, 1, 3, 40, 500]) for _ in words]
    rows = [(i, "  ".join(rng.choices(words, weights, k=rng.randint(0, 400)))) for i in range(20)]
    return [*rows, (None, "abab baba"), (3, "abab, abab"), (3, "abab, abab"), (5, None), (6, ""), (7, "1 2 3"), (8, "aaab " * 50_000)]


def test_near_words_forms_and_roots_equal_those_of_all_pairs(spark):
    rows = corpus(2)
    for settings in ({"least_length": 3, "least_count": 2, "times": 2, "slips": 5}, {"least_length": 4, "least_count": 1, "times": 10, "slips": None}):
        want = expected(rows, **settings)
        assert run(spark, rows, **settings) == want
        assert any(v[0] and v[1] != v[0] for v in want.values())


def test_equal_counts_take_the_smallest_word(spark):
    rows = [(1, "abcdefg " * 2 + "abcdefh " * 20 + "abcdefé " * 20 + "abcdefgg")]
    got = run(spark, rows, least_count=1)
    assert got["abcdefg"] == ("abcdefh", "abcdefh", 2, 3, 20) and got["abcdefgg"][:2] == (None, "abcdefgg")
    assert got == expected(rows, 7, 1, 10, None)


def test_no_words(spark):
    assert run(spark, []) == {} and run(spark, [(1, None), (2, "short ones")]) == {}
