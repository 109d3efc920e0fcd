"""Exports and materialised tables, each behind a freshness gate."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.versioned import CommitLog

DAY = timedelta(hours=24)


def export_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    """CSV with header, in parallel; ``by`` makes a folder per value of a column, which is then not in the files."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(by) if by else writer).csv(path)


class Gated:
    """A stored result that is built anew when its last commit is ``max_age`` old or older."""

    def __init__(self, spark: SparkSession, path: str, max_age: timedelta = DAY):
        self.spark, self.log, self.max_age = spark, CommitLog(spark, path), max_age

    def refresh(self, build: Callable[[], DataFrame], now: datetime) -> bool:
        """Builds and stores, unless the result is fresh; whether it did. ``build`` is not called for a fresh one."""
        if self.log.fresh(self.max_age, now):
            return False
        df, folder = build(), self.log.new_folder()
        self.write(df, folder)
        self.log.commit({0: (folder, None)}, df.schema, now)
        return True

    def read(self) -> DataFrame:
        """The last committed result, also while a new one is written."""
        (part,) = self.log.latest()
        return self.load(part.folder, T.StructType.fromJson(json.loads(part.schema)))

    def refreshed_at(self) -> datetime | None:
        rows = self.log.latest()
        return rows[0].committed_at if rows else None


class View(Gated):
    """A materialised view, as Parquet."""

    def write(self, df: DataFrame, folder: str) -> None:
        df.write.parquet(folder)

    def load(self, folder: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(folder)


class CsvExport(Gated):
    """An export as CSV."""

    def __init__(self, spark: SparkSession, path: str, max_age: timedelta = DAY, by: str | None = None):
        super().__init__(spark, path, max_age)
        self.by = by

    def write(self, df: DataFrame, folder: str) -> None:
        export_csv(df, folder, self.by)

    def load(self, folder: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(T.StructType([f for f in schema if f.name != self.by])).option("header", True).csv(folder)
