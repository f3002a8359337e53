"""Rolling compaction of accepted batches."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import merged_records


class Compactor:
    """Records of accepted batches, one folder each; every ``every`` folders become one in
    coordinate order.

    Batches come by rising number.  A merged folder is named by its last batch and counts once
    Spark has committed it; from then on the folders that it replaces are not read, so a stop
    at any point loses and doubles nothing, and a new object goes on where the last one ended."""

    def __init__(self, spark: SparkSession, folder: str, every: int = 100, partitions: int = 8):
        self.spark, self.folder, self.every, self.partitions = spark, folder.rstrip("/"), every, partitions

    def _committed(self, kind: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/upto-*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(re.search(r"/upto-(\d+)/_SUCCESS$", str(f.getPath().toString()))[1]) for f in found or [])

    def pending(self) -> list[int]:
        """Numbers of the batches that no merged folder holds yet."""
        last = max(self._committed("merged"), default=-1)
        return [n for n in self._committed("batches") if n > last]

    def add(self, number: int, records: DataFrame) -> None:
        records.write.mode("overwrite").parquet(f"{self.folder}/batches/upto-{number}")
        if len(self.pending()) >= self.every:
            self.compact()

    def compact(self) -> None:
        """Put the pending batches together and delete their folders."""
        if not (numbers := self.pending()):
            return
        parts = [self.spark.read.parquet(f"{self.folder}/batches/upto-{n}") for n in numbers]
        merged_records(*parts, partitions=self.partitions).write.mode("overwrite").parquet(f"{self.folder}/merged/upto-{numbers[-1]}")
        for n in self._committed("batches"):
            if n <= numbers[-1]:
                old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batches/upto-{n}")
                old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)

    def records(self) -> DataFrame:
        """All records of merged and pending batches."""
        paths = [f"{self.folder}/merged/upto-{n}" for n in self._committed("merged")] + [f"{self.folder}/batches/upto-{n}" for n in self.pending()]
        return self.spark.read.parquet(*paths)
