"""Indexes as derived columns that are computed once and stored, sorted, beside the relation."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Index:
    name: str
    relation: str
    columns: tuple[str, ...]
    path: str


class Indexes:
    """A registry.  Results are the same with and without an index; a stored relation is a snapshot, rebuilt by create."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._held: dict[str, Index] = {}

    def create(self, name: str, relation: str, rows: DataFrame, **columns: Column) -> Index:
        """Stores rows with the given expressions as columns, sorted by them, so that Parquet statistics skip what a filter rules out."""
        if name in self._held:
            raise ValueError(f"index {name} exists")
        index = Index(name, relation, tuple(columns), f"{self.folder}/{relation}-{uuid.uuid4().hex}")
        derived = rows.withColumns(columns)
        derived.repartitionByRange(*index.columns).sortWithinPartitions(*index.columns).write.parquet(index.path)
        self._held[name] = index
        return index

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._held[name].path)

    def find(self, name: str, **values: object) -> DataFrame:
        """Rows of which the indexed columns have these values (or are among a list of them), without those columns."""
        index, rows = self._held[name], self.read(name)
        for column, value in values.items():
            rows = rows.where(F.col(column).isin(*value) if isinstance(value, list | tuple | set) else F.col(column).eqNullSafe(F.lit(value)))
        return rows.drop(*index.columns)

    def show(self) -> DataFrame:
        rows = [(i.name, i.relation, ", ".join(i.columns)) for i in self._held.values()]
        return self.spark.createDataFrame(rows, "name string, relation string, columns string")

    def drop(self, name: str) -> None:
        index = self._held.pop(name)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(index.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
