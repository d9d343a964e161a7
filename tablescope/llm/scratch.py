"""Tables in the shared scratch folder that are dropped when nothing reads them any more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import drop_scratch, scratch_path


class Scratch:
    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, rows: DataFrame, label: str, temporary: bool = True) -> DataFrame:
        """``rows`` as a written table; ``drop`` deletes it unless it is one that the result reads."""
        path = scratch_path(self.spark, label)
        rows.write.parquet(path)
        if temporary:
            self.paths.append(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            drop_scratch(self.spark, path)
        self.paths.clear()
