"""Lineage cuts and size checks.

A result that must be read more than once with exactly the same rows (for example
after range partitioning, whose bounds come from a sample) is written as a Parquet
table below ``spark.checkpoint.dir``. A lost executor then only costs a re-read.
All tables of a run lie below one root; ``clean`` removes it after the final write.
"""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side with at most this many bytes (counted, see ``bytes_of``) may be broadcast.
BROADCAST_BYTES = 8 << 20

_local_root: str | None = None
# The root of each running application, by application id.
_runs: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="tidewatch-")
    return _local_root


def run_root(spark: SparkSession) -> str:
    """The folder of this run's tables."""
    run = spark.sparkContext.applicationId
    if run not in _runs:
        _runs[run] = f"{shared_root(spark)}/tidewatch/{run}-{uuid.uuid4().hex[:8]}"
    return _runs[run]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the run's folder that nobody has used yet."""
    return f"{run_root(spark)}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Deletes the run's tables. Call it after the last result that reads them has been written."""
    root = _runs.pop(spark.sparkContext.applicationId, None)
    if root:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    # Names are quoted, as they may hold dots.
    return spark.read.schema(df.schema).parquet(path).select(*("`" + c.replace("`", "``") + "`" for c in df.columns))


def _width(name: str | Column, kind: T.DataType) -> Column:
    """Bytes that a value takes in a row, about."""
    column = F.col(name) if isinstance(name, str) else name
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        element = kind.elementType
        if isinstance(element, T.StringType | T.BinaryType | T.ArrayType | T.StructType | T.MapType):
            sizes = F.transform(column, lambda x: _width(x, element).cast("long"))
            return F.coalesce(F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)) + 16
        return F.coalesce(F.size(column), F.lit(0)) * 8 + 16
    if isinstance(kind, T.MapType):
        return _width(F.map_keys(column), T.ArrayType(kind.keyType)) + _width(F.map_values(column), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind), F.lit(8))
    return F.lit(8)


def bytes_of(df: DataFrame) -> int:
    """The size of a (stored) table's rows in memory, counted over all rows."""
    row = sum((_width(f.name, f.dataType).cast("long") for f in df.schema), F.lit(8).cast("long"))
    return df.agg(F.sum(row)).first()[0] or 0


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a (stored) table for broadcast if its rows take few bytes; else for a join by key.

    Spark goes by the size of files, and rows of compressed files take many times that in memory and in the driver.
    """
    return F.broadcast(df) if bytes_of(df) <= most else by_key(df)


def by_key(df: DataFrame) -> DataFrame:
    """Mark a table for a join by key, whatever the size of its files."""
    return df.hint("merge")

