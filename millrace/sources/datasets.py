"""Datasets on disk: every write is a version of its own, published at the end.

A dataset is a folder. A version has its rows as CSV, gzipped unless it is a single file, and texts and tables that
belong to it (statistics, report, profile), each in a folder of the version. A version counts
once its name stands in the folder's log, which one file of one row is appended to at the very end; what a write that
failed left behind is never read. So readers have the old version until the new one is whole.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.session import held, shuffles_go

LOG = "published"


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the published versions, oldest first; none where there is no dataset of versions."""
    try:
        log = spark.read.text(f"{path}/{LOG}").collect()
    except AnalysisException:
        return []
    return sorted(r.value for r in log)


def read(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """Rows of a dataset as strings; only what is empty is empty. Of a version, by default the last; plain CSV files and folders as they are."""
    there = [version] if version else versions(spark, path)[-1:]
    df = spark.read.csv(f"{path}/{there[0]}/data" if there else path, header=True, multiLine=True, escape='"')
    return df.na.fill("")


def text(spark: SparkSession, path: str, name: str, version: str | None = None) -> str:
    return spark.read.text(f"{path}/{version or versions(spark, path)[-1]}/{name}", wholetext=True).first()[0]


def table(spark: SparkSession, path: str, name: str, version: str | None = None) -> DataFrame:
    return spark.read.parquet(f"{path}/{version or versions(spark, path)[-1]}/{name}")


class Draft:
    """A version that is being written. Nothing of it is seen before publish()."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        last = versions(spark, path)
        self.name = f"{int(last[-1].split('-')[0]) + 1 if last else 1:06d}-{uuid.uuid4().hex[:8]}"

    @property
    def folder(self) -> str:
        return f"{self.path}/{self.name}"

    def rows(self, df: DataFrame, order: str = "PSA_ID", single: bool = False, columns: list[str] | None = None) -> None:
        """The rows in order, one gzipped file for each partition of the order. single: all in one plain file, through one task, for datasets that are taken
        elsewhere as a file. columns: those of the dataset, see taken; those that the rows lack are not sorted or sent."""
        df = df.orderBy(order).coalesce(1) if single else df.repartitionByRange(order).sortWithinPartitions(order)
        df = taken(df, columns) if columns else df
        with shuffles_go(self.spark):
            # the fastest level takes half the time of the usual one and a seventh more of disk
            out = df.write if single else df.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
            out.csv(f"{self.folder}/data", header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)

    def text(self, name: str, body: str) -> None:
        self.spark.createDataFrame([(body,)], "value string").coalesce(1).write.option("lineSep", "\n").text(f"{self.folder}/{name}")

    def table(self, name: str, df: DataFrame) -> None:
        df.write.parquet(f"{self.folder}/{name}")

    def publish(self) -> str:
        self.spark.createDataFrame([(self.name,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/{LOG}")
        return self.name


def write(df: DataFrame, path: str, order: str = "PSA_ID", single: bool = False, columns: list[str] | None = None) -> str:
    """A new version that has rows only. They are made once and kept while they are dealt by range, which reads them up to three times to find the bounds.
    columns: those of the dataset, see taken."""
    draft = Draft(df.sparkSession, path)
    own, drop = held(df.select(*(c for c in df.columns if c in columns)) if columns else df, "rows")
    draft.rows(own, order, single, columns)
    drop()
    return draft.publish()


def taken(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in order, as strings without nulls; empty where the rows lack one."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns))
