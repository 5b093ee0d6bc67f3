"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Folders that this driver has been given and has not swept.
_GIVEN: list[str] = []
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir.

    Where that setting is missing, one is made and set in a session of a single
    machine, as in tests; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", root)
    _GIVEN.append(f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}")
    return _GIVEN[-1]


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within it an action's shuffle files are deleted when it ends; else they stay until the driver's garbage is collected, which may be never where the driver does little."""
    own = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, own)


def held(df: DataFrame, tag: str) -> tuple[DataFrame, Callable[[], None]]:
    """As saved, for tables of whole records, which take as much disk as their input: packed closer, and with a function that deletes the
    table, to call once its rows are written elsewhere."""
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    with shuffles_go(spark):
        df.write.parquet(path, compression="zstd")

    def drop() -> None:
        if path in _GIVEN:
            _GIVEN.remove(path)
            _delete(spark, path)

    return spark.read.schema(df.schema).parquet(path), drop


def _delete(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession) -> int:
    """Delete all scratch folders of this driver; the number of those that were there.

    For after a result has been written elsewhere: tables that were read from scratch can no longer be. What a job
    that failed left is in the list as well."""
    found = 0
    while _GIVEN:
        found += _delete(spark, _GIVEN.pop())
    return found
