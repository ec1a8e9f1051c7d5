"""Replacing rows of a table of files while others append to it.

Appended files stand in the table's folder. A sweep writes the new form of the files it read into a folder of its own,
`_swept/<id>`, which plain readers skip, and the names of those files next to it. It counts from the moment its commit
record `_commits/<number>` exists, which is created only if no one else has taken the number. Readers leave out replaced
files and take the committed folders in; a file that came after the sweep began is in no such list and stays.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import cut_lineage

#: How long a sweep waits for another one that has taken a number and not yet signed it.
WAIT_SECONDS = 60
#: Partition folders and name at the end of a path. It is matched for every row, so it is tried at the start of each
#: segment only, and without backtracking.
FILE = r"(?<![^/])(?:[^/=]++=[^/]*+/)*+[^/]++$"


def _file() -> Column:
    """A row's file by its partition folders and name, the same however the table's path is written."""
    return F.regexp_extract(F.col("_metadata.file_path"), FILE, 0)


def _files(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path, as the cluster names them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _records(spark: SparkSession, path: str) -> list[str]:
    """What each commit record says, in their order: the id of a sweep, or nothing while it is being written."""
    fs, folder = _files(spark, f"{path}/_commits")
    if not fs.exists(folder):
        return []
    said = []
    for record in sorted((status.getPath() for status in fs.listStatus(folder)), key=lambda p: p.getName()):
        stream = fs.open(record)
        said.append(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
    return said


def commits(spark: SparkSession, path: str) -> list[str]:
    """The ids of committed sweeps in their order."""
    return [name for name in _records(spark, path) if name]


def _commit(spark: SparkSession, path: str, number: int, name: str) -> bool:
    """Take the next number for a sweep; false if it is taken. A record is never overwritten."""
    fs, record = _files(spark, f"{path}/_commits/{number:012d}")
    try:
        stream = fs.create(record, False)
    except Py4JJavaError:
        return False
    stream.write(bytearray(name, "ascii"))
    stream.close()
    return True


def _replaced(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return spark.read.schema("file string").parquet(*[f"{path}/_replaced/{name}" for name in names])


def _live(spark: SparkSession, path: str, schema: StructType, names: list[str]) -> DataFrame:
    """The rows of a state with the name of their file."""
    parts = [spark.read.schema(schema).parquet(path)]
    parts += [spark.read.schema(schema).parquet(f"{path}/_swept/{name}") for name in names]
    rows = reduce(DataFrame.unionByName, [part.select("*", _file().alias("_file")) for part in parts])
    if not names:
        return rows
    gone = _replaced(spark, path, names).distinct()
    return rows.join(gone, rows["_file"] == gone["file"], "left_anti")


def current(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table as the last commit leaves it, with everything that was appended."""
    return _live(spark, path, schema, commits(spark, path)).drop("_file")


@dataclass
class Sweep:
    """New files, written but not counted yet."""

    spark: SparkSession
    path: str
    name: str
    seen: list[str]
    rows: int

    def publish(self) -> bool:
        """Make the sweep count; false if another sweep has replaced one of its files since it began."""
        deadline = time.monotonic() + WAIT_SECONDS
        while True:
            now = _records(self.spark, self.path)
            if not all(now):
                if time.monotonic() > deadline:
                    raise RuntimeError(f"an unsigned commit record is left in {self.path}/_commits; remove it if its writer is gone")
                time.sleep(0.5)
                continue
            later = now[len(self.seen) :]
            if later:
                mine = _replaced(self.spark, self.path, [self.name])
                if not mine.join(_replaced(self.spark, self.path, later), "file", "left_semi").isEmpty():
                    return False
            if _commit(self.spark, self.path, len(now), self.name):
                return True


def begin(
    spark: SparkSession, path: str, schema: StructType, due: Column, change: Callable[[DataFrame], DataFrame]
) -> Sweep | None:
    """Write anew, changed, all files that hold a row that is due; None if there is none.

    The old files stay where they are, so a reader that began earlier still finds them.
    """
    seen = commits(spark, path)
    rows = _live(spark, path, schema, seen)
    touched = cut_lineage(rows.where(due).groupBy("_file").agg(F.count(F.lit(1)).alias("n")))
    cleared = touched.agg(F.sum("n")).first()[0]
    if not cleared:
        return None
    name = uuid.uuid4().hex
    parted = [c for c in ("source_id", "observed_date") if c in rows.columns]
    affected = rows.join(touched.select("_file"), "_file", "left_semi").drop("_file")
    change(affected).hint("rebalance", *parted).write.partitionBy(*parted).parquet(f"{path}/_swept/{name}")
    touched.select(F.col("_file").alias("file")).write.parquet(f"{path}/_replaced/{name}")
    return Sweep(spark, path, name, seen, cleared)
