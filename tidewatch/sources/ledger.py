"""A directory read again and again: a ledger of the files read, so that each is read once.

``root``/flows has a part for each run, ``root``/files what each read. A run counts once its list of
files is there, which is written last; what a failed run left is written over by the next.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import runs
from tidewatch.sources import files, ingest

_FILE = "path STRING, size BIGINT, modified BIGINT"


def _listing(spark: SparkSession, directory: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    rows = [(status.getPath().toString(), status.getLen(), status.getModificationTime()) for status in found if status.isFile()]
    return spark.createDataFrame([row for row in rows if files.suffix_of(row[0]) in files.SUFFIX_FORMATS], _FILE)


def _read(spark: SparkSession, root: str) -> DataFrame:
    parts = [runs.part(f"{root}/files", run) for run in runs.finished(spark, f"{root}/files")]
    schema = f"{_FILE}, next_id BIGINT"
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def add_new(spark: SparkSession, directory: str, root: str, default_year: int, multiline: bool | None = None) -> int:
    """Reads the files of ``directory`` that no run has read into ``root`` and returns their number.

    Event ids go on from run to run and follow name and line within one. A file that has changed
    since it was read is an error, as its records can't be told from those it had.
    """
    ledger, listed = _read(spark, root), _listing(spark, directory)
    known = ledger.select("path", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"))
    states = listed.join(known, "path", "left")
    changed = states.where("old_size <> size OR old_modified <> modified").select("path").limit(5).collect()
    if changed:
        raise ValueError(f"changed since they were read: {[row.path for row in changed]}")
    # Only what is new comes to the driver, as a list of names.
    fresh = states.where("old_size IS NULL").select("path", "size", "modified").orderBy("path").collect()
    if not fresh:
        return 0
    done = runs.finished(spark, f"{root}/files")
    run, first = (done[-1] + 1 if done else 0), ledger.agg(F.max("next_id")).first()[0] or 0
    flows = ingest.to_flows(ingest.read_listed(spark, [row.path for row in fresh], default_year, multiline))
    written = runs.finish(flows.withColumn("event_id", F.col("event_id") + first), f"{root}/flows", run, "date")
    last = written.agg(F.max("event_id")).first()[0]
    next_id = first if last is None else last + 1
    runs.finish(spark.createDataFrame(fresh, _FILE).withColumn("next_id", F.lit(next_id).cast("long")), f"{root}/files", run)
    return len(fresh)


def flows(spark: SparkSession, root: str) -> DataFrame:
    """The flows of all finished runs."""
    numbers = runs.finished(spark, f"{root}/files")
    if not numbers:
        raise ValueError(f"no finished run below {root}")
    parts = [runs.part(f"{root}/flows", run) for run in numbers]
    return spark.read.option("basePath", f"{root}/flows").parquet(*parts).drop("run")
