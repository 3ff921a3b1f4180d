"""Tables that grow or change run by run, so that a run that fails leaves nothing half done.

A run's part is written beside the others under a hidden name and gets its own, ``run=<number>``, by
one renaming when it is whole. Readers see finished runs only; a repeated run replaces its part.
"""

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def finished(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the finished runs below ``root``, ascending."""
    path, files = _path(spark, root)
    if not files.exists(path):
        return []
    names = (re.fullmatch(r"run=(\d+)", status.getPath().getName()) for status in files.listStatus(path) if status.isDirectory())
    return sorted(int(name[1]) for name in names if name)


def part(root: str, run: int) -> str:
    return f"{root}/run={run}"


def finish(df: DataFrame, root: str, run: int, *partition_by: str) -> DataFrame:
    """Writes ``df`` as the part of a run and returns what was written."""
    spark, hidden = df.sparkSession, f"{root}/_run-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(hidden)
    (source, files), (target, _) = _path(spark, hidden), _path(spark, part(root, run))
    if files.exists(target):
        files.delete(target, True)
    if not files.rename(source, target):
        raise OSError(f"{hidden} can't be renamed to {target}")
    return spark.read.schema(df.schema).parquet(part(root, run))
