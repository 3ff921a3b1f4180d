"""File lists and formats: one short record per file, as in Spark's own file index.

Formats and CSV headers come from the head of each file: it is opened and a bounded number of bytes
read, whatever its size.
"""

import re
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.durable import fresh_path
from tidewatch.sources.layout import WHITE

SUFFIX_FORMATS = {".csv": "csv", ".json": "json", ".log": "syslog", ".syslog": "syslog", ".txt": "syslog"}


def list_files(spark: SparkSession, directory: str) -> list[str]:
    """Files directly inside a directory, by name. Their content is not read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(status.getPath().toString() for status in found if status.isFile())


def _one_slash(file: str) -> str:
    return re.sub("^file:/+", "file:/", file)


def plain(file: str) -> str:
    """A file's own name from what Spark tells, which is encoded and has one or three slashes."""
    return _one_slash(unquote(file))


def _shown(spark: SparkSession, path: str) -> str:
    """The path as rows tell it as their source."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    own = jvm.org.apache.hadoop.fs.Path(path)
    shown = jvm.org.apache.spark.paths.SparkPath.fromPath(own.getFileSystem(conf).makeQualified(own)).urlEncoded()
    return _one_slash(shown)


def readable(spark: SparkSession, path: str, copies: dict[str, str] | None = None) -> str:
    """The file's path for Spark's readers, in which a name with pattern characters is only a name.

    Spark's readers do not see names that start with _ or a dot. Such a file is copied to the shared
    folder, as a stream, under a name that they see; ``copies`` gets what rows tell as the copy's
    name and what they would tell as the file's own.
    """
    folder, _, name = path.rpartition("/")
    if name.startswith(("_", ".")):
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{fresh_path(spark, 'hidden')}/file{name}")
        jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)
        if copies is not None:
            copies[_shown(spark, target.toString())] = _shown(spark, path)
        path = target.toString()
    return escaped(path)


def suffix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name[1:] else ""


# Bytes read at once of a file's head, and of its first line with text at most; heads read at the same time.
HEAD_BYTES, READERS = 64 << 10, 16


def _head(spark: SparkSession, file: str) -> tuple[str, bool] | None:
    """A file's first line with text (without a byte order mark), and whether it goes on; None without text."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        stream = codec.createInputStream(stream) if codec else stream
        kept, ended = b"", False
        while not ended:
            data = bytes(stream.readNBytes(HEAD_BYTES))
            ended = len(data) < HEAD_BYTES
            text = (kept + data).decode("utf-8", "ignore")
            lines = [line.removeprefix("\ufeff") for line in re.split(r"\r\n|\n|\r", text)]
            for line in lines[:-1]:
                if line.strip(WHITE):
                    return line, False
            if ended or len(lines[-1].encode()) >= HEAD_BYTES:
                return (lines[-1], not ended) if lines[-1].strip(WHITE) else None
            kept = lines[-1].encode()
        return None
    finally:
        stream.close()


def _heads(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, bool]]:
    """The head of each file with text below ``paths`` (files, folders or patterns), by its own name."""
    if not paths:
        return {}
    files = sorted(plain(file) for file in spark.read.text(paths).inputFiles())
    with ThreadPoolExecutor(READERS) as readers:
        found = readers.map(lambda file: _head(spark, file), files)
        return {escaped(file): head for file, head in zip(files, found, strict=True) if head}


def headers(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The header line of each CSV file."""
    found = _heads(spark, paths)
    for file, (_, more) in found.items():
        if more:
            raise ValueError(f"the header of {file} has more than {HEAD_BYTES} bytes")
    return {file: line for file, (line, _) in found.items()}


def formats(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """csv, json, json_array or syslog for each file that has a line with text."""
    return {file: _format(line.strip(WHITE)) for file, (line, _) in _heads(spark, paths).items()}


def _format(line: str) -> str:
    if line.startswith(("[", "{")):
        return "json_array" if line[0] == "[" else "json"
    return "csv" if "," in line and not line.startswith("<") else "syslog"


def escaped(file: str) -> str:
    """A file's own name as a path that matches it alone."""
    return "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in file)


def odd_quotes(line: Column) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1


def broken_files(text: DataFrame) -> list[str]:
    """Files of ``text`` (file, value) in which a line has an odd number of quotes: a quoted value may go on in the next line."""
    return [escaped(plain(r.file)) for r in text.where(odd_quotes(F.col("value"))).select("file").distinct().collect()]
