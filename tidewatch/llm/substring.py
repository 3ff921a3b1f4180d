"""Repeated passages, found exactly with suffix automata of reference shards.

The automaton of the whole corpus can't be sent to every task, so the corpus is cut into shards
that no repeat can cross: a window of ``width`` words belongs to its anchor, the least hash among
its ``GRAM``-word runs, and equal windows have equal anchors. A first pass counts anchors; only
around anchors that occur twice is text moved at all. What lies around one anchor (a *segment*:
the words of consecutive windows with this anchor) is streamed, in document order, through a suffix
automaton of the segments before it, and then extends the automaton: each place where the match
reaches ``width`` words ends a window that starts earlier elsewhere.

An anchor with more than ``HOT`` occurrences would be one task's work. Its segments are first
reduced to distinct ones by an aggregation, and windows of these are matched by their text.
"""

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.durable import broadcast_if_small, durable
from tidewatch.llm.common import keyed, steps, words_of
from tidewatch.llm.textwords import run_hashes, signed, sliding_min, word_hashes

# Words of the runs among which a window's anchor is chosen.
GRAM = 5
# Occurrences of an anchor above which its segments are matched without a group.
HOT = 2_000
# Segments of a shard, about.
SHARD_SEGMENTS = 1_500


class Automaton:
    """A suffix automaton of several word sequences that is matched while it grows."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _extend(self, last: int, word: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, word, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: str, q: int) -> int:
        nxt, link = self.next, self.link
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        return clone

    def stream(self, words: list[str]) -> list[int]:
        """For each word the length of the longest run ending there that has occurred before; then the words are known."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = last = 0
        found = []
        for word in words:
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                matched += 1
            found.append(matched)
            last = self._extend(last, word)
            # Extending may have split the state: the match stays in the part with the shorter runs.
            while state and matched <= length[link[state]]:
                state = link[state]
        return found


def spans_of(lengths: list[int], width: int) -> list[tuple[int, int]]:
    """Maximal runs of words covered by matches of at least ``width``."""
    spans: list[tuple[int, int]] = []
    for end, n in enumerate(lengths, 1):
        if n >= width:
            if spans and spans[-1][1] >= end - width:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((end - width, end))
    return spans


def _window_anchors(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word positions' window anchors (over all texts one after the other), the grams, and the texts' begins."""
    words, begins = word_hashes(texts)
    grams = run_hashes(words, GRAM)
    least = sliding_min(grams, width - GRAM + 1) if len(words) >= width else grams[:0]
    return least, grams, begins


def _anchors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Per text and anchor of its windows: how often the anchor's words occur in the text."""
    for rows, texts in steps(batches):
        least, grams, begins = _window_anchors(texts, width)
        index, values, times = [], [], []
        for i, (a, b) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
            if b - a >= width:
                occurring, count = np.unique(grams[a : b - GRAM + 1], return_counts=True)
                own = np.unique(least[a : b - width + 1])
                index.append(np.full(len(own), i))
                values.append(own)
                times.append(count[np.searchsorted(occurring, own)])
        if index:
            at = pa.array(np.concatenate(index))
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(values))), rows.column(0).take(at), pa.array(np.concatenate(times).astype(np.int64))], names=["anchor", "row", "times"])


def _segments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Per run of windows with an anchor that repeats: anchor, hot, row, its first word's position, its words."""
    for rows, texts in steps(batches):
        least, _, begins = _window_anchors(texts, width)
        least = signed(least)
        ids, wanted = rows.column(0).to_pylist(), rows.column(2)
        out: list[list] = [[], [], [], [], []]
        for i, (a, b) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
            if b - a < width:
                continue
            own = least[a : b - width + 1]
            listed = wanted[i].values
            anchors, hot = listed.field(0).to_numpy(), listed.field(1).to_numpy(zero_copy_only=False)
            order = np.argsort(anchors)
            place = np.minimum(np.searchsorted(anchors, own, sorter=order), len(anchors) - 1)
            repeats = anchors[order[place]] == own
            change = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
            words = texts[i].split()
            for s, e in zip(change[:-1], change[1:], strict=True):
                if repeats[s]:
                    out[0].append(int(own[s]))
                    out[1].append(bool(hot[order[place[s]]]))
                    out[2].append(ids[i])
                    out[3].append(int(s))
                    out[4].append(b" ".join(words[s : e - 1 + width]))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary()).cast(pa.string())], names=["anchor", "hot", "row", "start", "words"])


def _match_shard(shard: pa.Table, width: int) -> pa.Table:
    """The spans of one shard's segments that are repeated from earlier ones."""
    shard = shard.sort_by([("row", "ascending"), ("start", "ascending")])
    by_anchor: dict[int, dict[str, list[tuple[int, int]]]] = defaultdict(dict)
    columns = (shard.column(c).to_pylist() for c in ("anchor", "words", "row", "start"))
    for anchor, words, row, start in zip(*columns, strict=True):
        by_anchor[anchor].setdefault(words, []).append((row, start))
    out: list[list[int]] = [[], [], []]
    for contents in by_anchor.values():
        automaton = Automaton()
        for words, places in contents.items():
            split = words.encode().split()
            # Alone with its anchor, a segment can only repeat itself, with as many words twice as a window has.
            alone = len(contents) == 1 and len(set(split)) > len(split) - width
            found = [] if alone else [(places[0], s, e) for s, e in spans_of(automaton.stream(split), width)]
            # Later segments with the same words are repeats as a whole.
            for (row, start), s, e in found + [(p, 0, len(split)) for p in places[1:]]:
                out[0].append(row)
                out[1].append(start + s)
                out[2].append(start + e)
    return pa.table({"row": pa.array(out[0], pa.int64()), "begin": pa.array(out[1], pa.int64()), "stop": pa.array(out[2], pa.int64())})


def _hot_spans(segments: DataFrame, width: int) -> DataFrame:
    """The same for anchors that occur too often for one group, by aggregations that combine before the shuffle."""
    at = F.struct("row", "start")
    firsts = durable(segments.groupBy("words").agg(F.min(at).alias("first")), "hot_segments")
    later = segments.join(broadcast_if_small(firsts), "words").where(at != F.col("first"))
    whole = later.select("row", F.col("start").alias("begin"), (F.col("start") + F.size(words_of(F.col("words")))).alias("stop"))
    listed = firsts.select(F.col("first.row").alias("row"), F.col("first.start").alias("start"), words_of(F.col("words")).alias("w"))
    windows = listed.select("row", "start", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - width + 1), lambda i: F.sha2(F.array_join(F.slice("w", i, width), " ").cast("binary"), 256))).alias("i", "window"))
    placed = durable(windows.select("window", "row", (F.col("start") + F.col("i")).alias("begin")), "hot_windows")
    where = F.struct("row", "begin")
    twice = placed.groupBy("window").agg(F.min(where).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    parts = placed.join(twice, "window").where(where != F.col("first")).select("row", "begin", (F.col("begin") + width).alias("stop"))
    return whole.unionByName(parts)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins touching and overlapping spans of each row."""
    for batch in batches:
        merged = []
        for spans in batch.column(1).to_pylist():
            own: list[dict[str, int]] = []
            for span in sorted(spans, key=lambda s: s["begin"]):
                if own and span["begin"] <= own[-1]["stop"]:
                    own[-1]["stop"] = max(own[-1]["stop"], span["stop"])
                else:
                    own.append(span)
            merged.append(own)
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(merged, kind)], names=["row", "spans"])


def repeated_spans(texts: DataFrame, width: int) -> DataFrame:
    """(row, spans): the word spans [begin, stop) of each row of ``texts`` (row, text) that are
    covered by windows of ``width`` words which also start earlier; rows without any left out.
    """
    plain = texts.select("row", "text")
    anchors = plain.mapInArrow(lambda batches: _anchors(batches, width), "anchor bigint, row bigint, times bigint")
    counts = durable(anchors.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1"), "anchor_counts")
    total = counts.agg(F.sum("n"), F.max("n")).first()
    hits = anchors.join(counts, "anchor").groupBy("row").agg(F.collect_list(F.struct("anchor", (F.col("n") > HOT).alias("hot"))).alias("anchors"))
    hits = durable(hits, "hits")
    chosen = plain.join(broadcast_if_small(hits), "row").select("row", "text", "anchors")
    segments = durable(chosen.mapInArrow(lambda batches: _segments(batches, width), "anchor bigint, hot boolean, row bigint, start bigint, words string"), "segments")
    shards = max(1, (total[0] or 0) // SHARD_SEGMENTS)
    cold = segments.where("NOT hot").withColumn("shard", F.pmod("anchor", F.lit(shards)))
    spans = cold.groupBy("shard").applyInArrow(lambda shard: _match_shard(shard, width), "row bigint, begin bigint, stop bigint")
    if (total[1] or 0) > HOT:
        spans = spans.unionByName(_hot_spans(segments.where("hot"), width))
    listed = spans.groupBy("row").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))
    return listed.mapInArrow(_merge, "row bigint, spans array<struct<begin:bigint,stop:bigint>>")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"]
    for rows, texts in steps(batches):
        totals, removed, kept = [], [], []
        for text, spans in zip(texts, rows.column(2).to_pylist(), strict=True):
            words = (text or b"").split()
            totals.append(len(words))
            for span in reversed(spans or []):
                del words[span["begin"] : span["stop"]]
            removed.append(totals[-1] - len(words))
            kept.append(b" ".join(words))
        digests = [hashlib.sha256(k).hexdigest() for k in kept]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digests)], names=names)


def remove_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the words left, joined by a blank) and kept_sha256 of each row.

    A word goes if a window of ``width`` words over it also starts earlier: in a smaller doc_id, or
    earlier in the same document. Windows are judged on the input. Null texts have no words; texts
    of fewer words keep them all. Rows that share a doc_id, or have none, are documents one after
    the other, by text, ids that are null last; repeated rows are repeats of the first.
    """
    texts = keyed(docs)
    spans = durable(repeated_spans(texts, width), "spans")
    joined = texts.join(broadcast_if_small(spans), "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string")
