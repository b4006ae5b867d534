"""Named tables for the plans."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from opsloom.session import tune


class Tables:
    """Tables by name: DataFrames, or functions that build one on first use."""

    def __init__(self, spark: SparkSession, sources: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self.spark = tune(spark)
        self._sources = dict(sources)

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, names: list[str]) -> Tables:
        return cls(spark, {n: (lambda n=n: spark.read.parquet(f"{folder}/{n}")) for n in names})

    @classmethod
    def from_catalog(cls, spark: SparkSession, schema: str, names: list[str]) -> Tables:
        return cls(spark, {n: (lambda n=n: spark.table(f"{schema}.{n}")) for n in names})

    def __getitem__(self, name: str) -> DataFrame:
        source = self._sources[name]
        if not isinstance(source, DataFrame):
            source = self._sources[name] = source()
        return source

    def __contains__(self, name: str) -> bool:
        return name in self._sources

    def with_tables(self, **more: DataFrame) -> Tables:
        return Tables(self.spark, {**self._sources, **more})
