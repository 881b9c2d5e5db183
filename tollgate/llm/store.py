"""Files in the shared folder, written by tasks under temporary names and then renamed.

A task writes below ``<root>/_temporary`` under a name of its own and reports it in
a manifest row. Spark's own committer keeps only the rows of successful attempts, so
files of lost or repeated attempts are never named by a manifest. Renaming a file
twice does nothing the second time.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from tollgate.session import scratch_path


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, as an address that every node can open."""
    path = scratch_path(spark, label)
    return path if "://" in path or path.startswith("file:") else "file://" + path


def opened(address: str) -> tuple[fs.FileSystem, str]:
    if address.startswith("file:/") and not address.startswith("file://"):
        address = "file://" + address[5:]
    return fs.FileSystem.from_uri(address)


def temporary(root: str, name: str) -> str:
    return f"{root}/_temporary/{uuid.uuid4().hex}/{name}"


def create(address: str):
    system, path = opened(address)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def reopen(address: str):
    system, path = opened(address)
    return system.open_input_file(path)


def move(source: str, target: str) -> None:
    """Give a finished file its name; nothing happens if that was done before."""
    system, old = opened(source)
    _, new = opened(target)
    if system.get_file_info(old).type == fs.FileType.NotFound:
        if system.get_file_info(new).type == fs.FileType.NotFound:
            raise FileNotFoundError(source)
        return
    system.create_dir(new.rpartition("/")[0], recursive=True)
    system.move(old, new)


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe when executors are lost."""
    path = path or scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing refers to any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
