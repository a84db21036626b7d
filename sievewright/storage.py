"""Small files of a run (contracts, manifests, vocabularies) on whatever file system their path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(str(path))
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _place(spark, path)
    return system.exists(place)


def any_match(spark: SparkSession, pattern: str) -> bool:
    """Whether a glob pattern names at least one file."""
    system, place = _place(spark, pattern)
    found = system.globStatus(place)
    return found is not None and len(found) > 0


def read_text(spark: SparkSession, path: str) -> str:
    system, place = _place(spark, path)
    stream = system.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the path and renames, so a reader never sees a part."""
    system, place = _place(spark, path)
    _, part = _place(spark, f"{path}.part")
    stream = system.create(part, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if system.exists(place):
        system.delete(place, False)
    if not system.rename(part, place):
        raise OSError(f"cannot write {path}")


def move(spark: SparkSession, old: str, new: str) -> None:
    """Renames a file or folder; an existing target is an error."""
    system, place = _place(spark, old)
    _, target = _place(spark, new)
    if system.exists(target):
        raise FileExistsError(new)
    if not system.rename(place, target):
        raise OSError(f"cannot move {old}")
