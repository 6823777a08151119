"""Path checks through the Hadoop file system, so they work on any shared store."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _path(spark, path)
    return bool(fs.globStatus(hadoop))


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the entries of a folder."""
    hadoop, fs = _path(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first place that exists, in order of preference."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of these exists: {paths}")


def move(spark: SparkSession, source: str, target: str) -> None:
    hadoop, fs = _path(spark, source)
    destination, _ = _path(spark, target)
    if not fs.rename(hadoop, destination):
        raise OSError(f"could not move {source} to {target}")


def remove(spark: SparkSession, path: str) -> None:
    hadoop, fs = _path(spark, path)
    fs.delete(hadoop, True)


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file; refused if it exists, also where two writers try at once."""
    hadoop, fs = _path(spark, path)
    with_content = fs.create(hadoop, False)
    try:
        with_content.write(bytearray(text.encode()))
    finally:
        with_content.close()


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    hadoop, fs = _path(spark, path)
    stream = fs.open(hadoop)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
