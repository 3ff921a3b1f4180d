"""Helpers of the corpus operators: row keys, folds, Arrow batches of whole texts.

Intermediate tables are written below ``spark.checkpoint.dir`` (see ``tidewatch.durable``).
"""

import io
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.durable import durable, fresh_path

# Bytes of text that one step of a vectorised function works on (a longer text is a step of its own).
STEP_BYTES = 2 << 20

# A word of the contracts: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_shipped: set[str] = set()

# Bytes of an Arrow batch, if the session does not say: texts have any length, so a number of rows bounds nothing.
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors' Python, once an application, so that they need not have it installed,
    and bounds what goes to Python at once."""
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    _shipped.add(application)
    top = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(top.rglob("*.py")):
            archive.write(file, file.relative_to(top.parent))
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{fresh_path(spark, 'code')}/{top.name}.zip")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    stream.write(data.getvalue())
    stream.close()
    spark.sparkContext.addPyFile(path.toString())


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """True if crc32 of the id as text leaves ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    trimmed = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), rf"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``row`` (long, unique, ascending by doc_id, nulls last, then text), ``doc_id``, ``text`` and ``columns``.

    Where doc_id is unique and never null, it is the key itself. Else rows that share a doc_id are
    documents of their own, ordered by text; equal rows follow each other in a fixed order, which is
    written down.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)
    odd = picked.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        return picked.withColumn("row", F.col("doc_id"))
    order = (F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last())
    ranged = picked.repartitionByRange(*order).sortWithinPartitions(*order)
    return durable(ranged.withColumn("row", F.monotonically_increasing_id()), "keyed")


def packed(docs: DataFrame) -> DataFrame:
    """``keyed`` with all columns but doc_id and text in a struct ``rest``, so that none of them can clash."""
    others = [quoted(c) for c in docs.columns if c not in ("doc_id", "text")]
    return keyed(docs, (F.struct(*others) if others else F.struct(F.lit(0).alias("none"))).alias("rest"))


def unpacked(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from rows of ``packed(docs)``."""
    return texts.select(*(F.col(c if c in ("doc_id", "text") else f"rest.{quoted(c)}").cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut Arrow batches so that the texts of a step have about ``most`` bytes; yields (rows, texts as bytes or None)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        start, size = 0, 0
        lengths = [0 if n is None else n for n in pa.compute.binary_length(column).to_pylist()]
        for i, n in enumerate(lengths):
            if size and size + n > most:
                yield batch.slice(start, i - start), column.slice(start, i - start).to_pylist()
                start, size = i, 0
            size += n
        if start < len(lengths):
            yield batch.slice(start), column.slice(start).to_pylist()
