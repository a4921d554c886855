"""Versioned tables: data goes to a new folder, then one small pointer file is replaced.

Readers follow the pointer, so they see either the old or the new state, never half of one.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "current.json"


def _hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, whatever the scheme."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything."""
    target, files = _hadoop_path(spark, path)
    return bool(files.globStatus(target))


def is_folder(spark: SparkSession, path: str) -> bool:
    target, files = _hadoop_path(spark, path)
    return files.getFileStatus(target).isDirectory()


def live_parts(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders that make up the current state, oldest first."""
    pointer = f"{path}/{POINTER}"
    if not exists(spark, pointer):
        return []
    return json.loads(spark.read.text(pointer, wholetext=True).first().value)


def publish(spark: SparkSession, path: str, parts: list[str]) -> None:
    """Make `parts` the current state in one atomic rename."""
    jvm = spark._jvm
    pointer, files = _hadoop_path(spark, f"{path}/{POINTER}")
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}/.{POINTER}.{jvm.java.util.UUID.randomUUID()}")
    stream = files.create(fresh, True)
    stream.write(bytearray(json.dumps(parts).encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        files.getUri(), spark._jsc.hadoopConfiguration()
    )
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(files.makeQualified(fresh), files.makeQualified(pointer), options)


def part_name(kind: str, version: int, writer: str = "") -> str:
    """A folder that no other attempt uses: what readers see is never written again."""
    return f"{kind}-{version:018d}-{writer}-{uuid.uuid4().hex}"


def part_version(part: str) -> int:
    return int(part.split("-")[1])


def part_writer(part: str) -> str:
    return part.split("-")[2]


def next_version(spark: SparkSession, path: str) -> int:
    parts = live_parts(spark, path)
    return part_version(parts[-1]) + 1 if parts else 0


def _refuse_older(parts: list[str], version: int) -> None:
    if parts and part_version(parts[-1]) > version:
        raise ValueError(f"version {version} comes after version {part_version(parts[-1])}")


def write_record_store(
    df: DataFrame, path: str, version: int | None = None, writer: str = ""
) -> None:
    """Replace the whole state; a version that is the last one already stays as it is."""
    spark = df.sparkSession
    if version is None:
        version = next_version(spark, path)
    parts = live_parts(spark, path)
    _refuse_older(parts, version)
    if len(parts) == 1 and part_version(parts[0]) == version:
        return
    part = part_name("base", version, writer)
    df.write.parquet(f"{path}/{part}")
    publish(spark, path, [part])


def append_part(df: DataFrame, path: str, version: int, writer: str = "") -> None:
    """Add rows to the state. A version that is in already does nothing; one that is missing among
    the earlier ones is an error, as its rows would be lost."""
    parts = live_parts(df.sparkSession, path)
    if version in map(part_version, parts):
        return
    _refuse_older(parts, version)
    part = part_name("delta", version, writer)
    df.write.parquet(f"{path}/{part}")
    publish(df.sparkSession, path, [*parts, part])


def read_parts(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of the current state, None when nothing was published."""
    parts = live_parts(spark, path)
    if not parts:
        return None
    return spark.read.parquet(*[f"{path}/{part}" for part in parts])
