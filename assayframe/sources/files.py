"""Small files and renames in any file system that Spark reaches: for ledgers and manifests, never for data."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder, in order; nothing if there is no such folder."""
    fs, place = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(place)) if fs.exists(place) else []


def publish(spark: SparkSession, staged: str, path: str) -> bool:
    """Moves what was staged to its place by one rename; False, with the staged left alone, where that place is taken.

    The rename has to be atomic, as in HDFS and local file systems; in an object store use one of its committers' stores.
    """
    fs, place = _fs(spark, path)
    if fs.exists(place):
        return False
    fs.mkdirs(place.getParent())
    return fs.rename(_fs(spark, staged)[1], place)


def write_json(spark: SparkSession, value, path: str) -> bool:
    """A JSON file that is there whole or not at all; False where it is there already."""
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    fs, place = _fs(spark, staged)
    out = fs.create(place, False)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    done = publish(spark, staged, path)
    if not done:
        fs.delete(place, False)
    return done


def read_json(spark: SparkSession, path: str):
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
