"""Lazily opened input tables: one parquet path per table, projected and filtered by Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidra.session import spread

TEXTS = ("documents", "pages")  # scanned with heavy per-row text work
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
         "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._open: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        if name not in self._open:
            df = self.spark.read.parquet(f"{self.path}/{name}.parquet")
            self._open[name] = spread(df) if name in TEXTS else df
        return self._open[name]
