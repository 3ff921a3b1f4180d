"""Near-duplicate documents by circulant MinHash.

Two permutations of the 32-bit numbers make all coordinates: the first spreads the shingles (the low
half of their hash), the second, shifted by k, gives coordinate k as the least value over a
document's shingles. Coordinates are cut into bands; documents that agree in a band are candidates
and are compared on their full shingle sets. Documents with equal sets are one class from the
start, and only classes are compared.

Within a band's bucket, classes are first compared with the bucket's smallest. What that leaves in
different components is compared further: all of small buckets, growing samples against the rest in
large ones, until each bucket is one component or fully compared. A large group of copies thus costs
one comparison a member, and no link is lost. For the further pairs, each class lists its shingles
from the rarest on; classes similar enough share one of the first few, and where they first meet
tells how many more they can share at most. Pairs for which that is too few are left out without a
look at their sets: near copies just under the threshold differ in rare shingles of their own.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.durable import broadcast_if_small, durable
from tidewatch.llm.common import keyed, packed, steps, unpacked
from tidewatch.llm.graph import components
from tidewatch.llm.textwords import U, mixed, run_hashes, signed, word_hashes

# Buckets with at most so many classes to compare are compared in one go.
SMALL_BUCKET = 512
# Bytes of text of a step.
STEP_BYTES = 1 << 20


@dataclass(frozen=True)
class Spec:
    """``width`` words a shingle; linked from ``percent`` of common shingles; bands of rows coordinates.

    A pair at the threshold shares no band with probability (1 - s ** rows) ** bands: 4e-7 at 0.85
    with 25 x 5, 1.4e-7 at 0.8 with 30 x 4.
    """

    width: int = 5
    percent: int = 80
    bands: int = 30
    rows: int = 4

    def enough(self, common: Column, n: Column, m: Column) -> Column:
        """Whether sets of n and m shingles with so many in common are similar enough."""
        return common * (100 + self.percent) >= (n + m) * self.percent


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, an empty text none."""
    words, begins = word_hashes(texts, lower=True)
    runs = run_hashes(words, width)
    sets = []
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        if b - a >= width:
            sets.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            sets.append(mixed(run_hashes(words[a:b], int(b - a)) + U(b - a)))
        else:
            sets.append(np.zeros(0, U))
    return sets


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation of the 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One column of coordinates for each non-empty set."""
    full = [s for s in sets if len(s)]
    out = np.zeros((coordinates, len(full)), np.uint32)
    if not full:
        return out
    places = np.concatenate(full).astype(np.uint32)
    begins = np.concatenate(([0], np.cumsum([len(s) for s in full])[:-1]))
    for k in range(coordinates):
        out[k] = np.minimum.reduceat(_second(places - np.uint32(k)), begins)
    return out


def _signed(batches: Iterator[pa.RecordBatch], spec: Spec) -> Iterator[pa.RecordBatch]:
    for rows, texts in steps(batches, most=STEP_BYTES):
        sets = shingle_sets(texts, spec.width)
        coordinates = signatures(sets, spec.bands * spec.rows).astype(U)
        keys = np.zeros((coordinates.shape[1], spec.bands), U)
        for band in range(spec.bands):
            part = coordinates[band * spec.rows : (band + 1) * spec.rows]
            keys[:, band] = mixed(run_hashes(part.reshape(-1, order="F"), spec.rows)[:: spec.rows] + U(band))
        full = np.array([len(s) > 0 for s in sets])
        offsets = np.concatenate(([0], np.cumsum(full * spec.bands))).astype(np.int32)
        digests = [hashlib.md5(s.tobytes(), usedforsecurity=False).digest() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(keys.reshape(-1))))],
            names=["row", "doc_id", "n_shingles", "digest", "bands"],
        )


def _listed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for rows, texts in steps(batches, most=STEP_BYTES):
        sets = shingle_sets(texts, width)
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(np.concatenate(sets))))], names=["row", "shingles"])


def _sets(rows: DataFrame, texts: DataFrame, spec: Spec) -> DataFrame:
    """(row, shingles) of the texts of (stored) ``rows``."""
    chosen = texts.select("row", "text").join(broadcast_if_small(rows), "row", "left_semi")
    return durable(chosen.mapInArrow(lambda batches: _listed(batches, spec.width), "row bigint, shingles array<bigint>"), "sets")


def similar(pairs: DataFrame, sets: DataFrame, spec: Spec) -> DataFrame:
    """Those of ``pairs`` (a, b: rows) whose full shingle sets (row, shingles) are similar enough."""
    first = sets.select(F.col("row").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("row").alias("b"), F.col("shingles").alias("y"))
    counted = pairs.join(first, "a").join(second, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), F.size("x").alias("n"), F.size("y").alias("m"))
    return counted.where((F.col("common") > 0) & spec.enough(F.col("common"), F.col("n"), F.col("m"))).select("a", "b")


def _prefixes(sets: DataFrame, spec: Spec) -> DataFrame:
    """(row, n, at, shingle): of each set's n shingles, rarest first, those at its first places that others have too.

    A similar set shares at least percent of n, so it has one of the n - that + 1 first ones.
    """
    each = sets.select("row", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    common = durable(each.groupBy("shingle").agg(F.count("*").alias("rows")).where("rows > 1"), "common_shingles")
    ranked = each.join(broadcast_if_small(common), "shingle", "left").select("row", "n", F.struct(F.coalesce("rows", F.lit(1)).alias("rows"), "shingle").alias("s"))
    ordered = ranked.groupBy("row", "n").agg(F.sort_array(F.collect_list("s")).alias("s"))
    first = F.slice("s", F.lit(1), F.col("n") - F.expr(f"({spec.percent} * n + 99) div 100").cast("int") + 1)
    placed = ordered.select("row", "n", F.posexplode(first).alias("at", "s")).where("s.rows > 1")
    return durable(placed.select("row", "n", (F.col("at") + 1).alias("at"), "s.shingle"), "prefixes")


def _sizes_allow(n: str, m: str, spec: Spec) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * spec.percent


def linked(classes: DataFrame, texts: DataFrame, spec: Spec) -> DataFrame:
    """(node, component) of classes (row, n_shingles, bands) joined by links; smallest rows left out."""
    entries = classes.select("row", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min(F.struct("row", "n")).alias("c"), F.count("*").alias("size")).where("size > 1")
    inside = entries.join(shared.select("bucket", F.col("c.row").alias("centre"), F.col("c.n").alias("m")), "bucket").where("row <> centre")
    active = durable(inside, "buckets")
    first = durable(active.where(_sizes_allow("n", "m", spec)).select(F.col("centre").alias("a"), F.col("row").alias("b")).distinct(), "pairs")
    ids = durable(first.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "compared")
    links = durable(similar(first, _sets(ids, texts, spec), spec), "links")
    labels = components(links)
    active, sample, sets, prefixes = active.select("bucket", "row"), SMALL_BUCKET // 4, None, None
    while True:
        known = active.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
        known = durable(known, "known")
        open_ones = known.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("size"), F.min("row").alias("one")).where("least < most").drop("least", "most")
        active = durable(known.join(open_ones, "bucket"), "active")
        if active.isEmpty():
            return labels
        if sets is None:
            sets = _sets(durable(active.select("row").distinct(), "active_rows"), texts, spec)
            prefixes = _prefixes(sets, spec)
        share = F.ceil(F.col("size") / sample)
        chosen = (F.col("size") <= SMALL_BUCKET) | (F.col("row") == F.col("one")) | (F.pmod(F.xxhash64("row", "bucket"), share) == 0)
        # A row chosen in one bucket is compared with all, so it is done with.
        rows = durable(active.groupBy("row").agg(F.max("component").alias("component"), F.max(chosen).alias("chosen")), "open_rows")
        entries = prefixes.join(broadcast_if_small(rows), "row")
        left = entries.where("chosen").select("shingle", F.col("row").alias("x"), F.col("n").alias("m"), F.col("at").alias("place"), F.col("component").alias("other"))
        further = 1 + F.least(F.col("n") - F.col("at"), F.col("m") - F.col("place"))
        once = ~F.col("chosen") | (F.col("x") < F.col("row"))
        met = entries.join(left, "shingle").where((F.col("component") != F.col("other")) & once & _sizes_allow("n", "m", spec) & spec.enough(further, F.col("n"), F.col("m")))
        pairs = durable(met.select(F.least("row", "x").alias("a"), F.greatest("row", "x").alias("b")).distinct(), "pairs")
        found = durable(similar(pairs, sets, spec), "links")
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links)
        done = durable(rows.where("chosen").select("row"), "done")
        active, sample = durable(active.join(broadcast_if_small(done), "row", "left_anti").select("bucket", "row"), "active"), sample * 4
        if active.isEmpty():
            return labels


def grouped(texts: DataFrame, spec: Spec) -> DataFrame:
    """row, doc_id, n_shingles, component_id and kept of keyed texts (see ``near_duplicates``)."""
    signed_rows = durable(texts.select("row", "doc_id", "text").mapInArrow(lambda batches: _signed(batches, spec), "row bigint, doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"), "signatures")
    full = signed_rows.where("n_shingles > 0")
    best = durable(full.groupBy("digest").agg(F.min("row").alias("first"), F.min_by("doc_id", "row").alias("first_id")), "classes")
    # Copies are known before their signatures are moved: only a class's first row goes on.
    classes = durable(full.join(broadcast_if_small(best.select("digest", "first")), "digest").where("row = first").select("row", "n_shingles", "bands"), "class_bands")
    labels = linked(classes, texts, spec).withColumnRenamed("node", "first")
    named = durable(best.join(labels, "first", "left").withColumn("component", F.coalesce("component", "first")), "components")
    heads = named.where("component = first").select(F.col("first").alias("component"), F.col("first_id").alias("component_id"))
    of_class = durable(named.join(heads, "component").select("digest", "component", "component_id"), "component_ids")
    rows = signed_rows.select("row", "doc_id", "n_shingles", "digest").join(broadcast_if_small(of_class), "digest", "left")
    alone = F.col("digest").isNull()
    return rows.select(
        "row", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col("row") == F.col("component"))).alias("kept"),
    )


def near_duplicates(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs``.

    Texts without words have no shingles and are linked with nothing; null texts likewise. Rows with
    equal sets are one class, so repeated rows and copies share a component. ``component_id`` is
    the smallest doc_id of the component (null only if all of its ids are null); one row of each
    component is kept, the first by doc_id, then text.
    """
    return grouped(keyed(docs), spec).drop("row")


def deduplicated(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    texts = packed(docs)
    gone = durable(grouped(texts, spec).where("NOT kept").select("row"), "duplicates")
    return unpacked(texts.join(broadcast_if_small(gone), "row", "left_anti"), docs)
