"""Spelling variants of the corpus's words by permuterm rotations.

A word is marked at its end and rotated to every position. If an edit stands last in the rotation,
what comes before it is a prefix that does not contain the edited character: words that differ by a
replaced character share the prefix of a rotation each, and a word that lacks a character is the
prefix itself. Rotations are sorted by these prefixes, and a scan over the groups gives each word its
neighbours. A group's words differ in one character, so none is larger than the alphabet.

All in DataFrame operations: words are counted before they are moved, words are numbered in sorted
order, and only numbers and prefixes are sorted.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.durable import broadcast_if_small, durable

LETTERS = "A-Za-zÀ-ÿ"
# The end of a word; not a letter.
MARK = "$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What a rotation has to say: the skipped character is the first of its kind in a row, is not, or none is skipped.
_FIRST, _FURTHER, _WHOLE = 0, 1, 2


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2, slips: int | None = None) -> DataFrame:
    """(id, word, n): the words of at least so many letters and occurrences, numbered in code-point order.

    Words are maximal runs of letters, A-Z lower-cased. With ``slips``, words whose crc32 together
    with the document's id it divides lose a letter, as typists make them. Null texts have no words;
    a null doc_id counts as an empty one; repeated rows count each.
    """
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    plain = F.lower("run") == F.col("run")
    words = found.select("doc", F.when(plain, F.col("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("word"))
    if slips:
        digest = F.crc32(F.concat("doc", F.lit(":"), "word").cast("binary"))
        at = (digest % F.length("word")).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.select(F.when(digest % slips == 0, shorter).otherwise(F.col("word")).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= least_length) & (F.col("n") >= least_count))
    counted = durable(counted, "word_counts")
    return durable(counted.repartitionByRange("word").sortWithinPartitions("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, kind, id, n): each word's rotations without their last character, and those that lack none."""
    length = F.length("word")
    turned = words.select("id", "n", "word", F.explode(F.sequence(F.lit(0), 2 * length)).alias("i"))
    skips = F.col("i") < length
    at = F.when(skips, F.col("i")).otherwise(F.col("i") - length)
    prefix = F.concat(F.substring("word", at + F.when(skips, 2).otherwise(1), length), F.lit(MARK), F.substring("word", F.lit(1), at))
    repeats = (at > 0) & (F.substring("word", at, F.lit(1)) == F.substring("word", at + 1, F.lit(1)))
    kind = F.when(~skips, _WHOLE).when(repeats, _FURTHER).otherwise(_FIRST)
    return turned.select(prefix.alias("prefix"), kind.alias("kind"), "id", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best): of each word that has any, the number of near words, and the most frequent of them."""
    group = Window.partitionBy("prefix")
    ranges = rotations(words).withColumn("size", F.count("*").over(group)).where("size > 1")
    members = ranges.groupBy("prefix").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("order"), "id", "kind"))).alias("members"))
    # Two words that skip a character differ by a replacement. One that skips none lacks what the other skips;
    # of several like characters in a row only the first counts, so that no pair is met twice.
    replaced = lambda x, y: (x["kind"] != _WHOLE) & (y["kind"] != _WHOLE) & (x["id"] != y["id"])
    lacking = lambda x, y: (x["kind"] + y["kind"] == _FIRST + _WHOLE) & (x["kind"] != y["kind"])
    others = F.transform("members", lambda x: F.struct(x["id"].alias("id"), F.filter("members", lambda y: replaced(x, y) | lacking(x, y)).alias("near")))
    near = members.select(F.explode(others).alias("m")).where(F.size("m.near") > 0)
    parts = near.select("m.id", F.size("m.near").alias("count"), F.get("m.near", F.lit(0)).alias("first"))
    best = F.min(F.struct("first.order", "first.id"))
    found = parts.groupBy("id").agg(F.sum("count").alias("n_near"), best.alias("best"))
    return found.select("id", "n_near", (-F.col("best.order")).alias("best_n"), F.col("best.id").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root): where following the forms (id, form) from each id ends, by pointer doubling."""
    ends, moved = forms.select("id", F.col("form").alias("root")), True
    while moved:
        ahead = ends.select(F.col("id").alias("root"), F.col("root").alias("next"))
        ends = durable(ends.join(broadcast_if_small(ahead), "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not ends.where("moved").isEmpty()
        ends = ends.select("id", "root")
    return ends


def variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, times: int = 10, slips: int | None = None) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of ``vocabulary``.

    Near words differ by one inserted, deleted or replaced letter. A word's form is its most frequent
    near word (of equally frequent ones the smallest in code-point order) if that occurs ``times`` as
    often or more, else null; the root is where forms lead, the word itself without one. An empty
    table, or one without such words, gives an empty result; other columns are not read.
    """
    words = vocabulary(docs, least_length, least_count, slips)
    near = durable(neighbours(words), "neighbours")
    own = durable(words.join(broadcast_if_small(near), "id", "left").withColumn("form", F.when(F.col("best_n") >= F.col("n") * times, F.col("best"))), "formed")
    ends = roots(durable(own.where("form IS NOT NULL").select("id", "form"), "forms"))
    named = durable(own.where("form IS NOT NULL").select("id", "form", "best_n").join(broadcast_if_small(ends), "id"), "followed")
    form = words.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    root = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    told = durable(named.join(form, "form").join(root, "root").select("id", "form_word", "root_word", F.col("best_n").alias("form_n")), "told")
    return own.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near")).join(broadcast_if_small(told), "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )
