"""Keeping a vectors table up to date from a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from nearfield.operators.mutate import apply_log
from nearfield.sources.store import _fs


class Ingest:
    """Each micro-batch of (id, at, action, ...) makes a new version of the table under path; the newest is read.

    A batch that is run again writes the same version from the one before it, so the result is as if it ran once.
    """

    def __init__(self, spark: SparkSession, path: str, base: DataFrame) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        base.write.mode("overwrite").parquet(f"{self.path}/version=-1")

    def _versions(self) -> list[int]:
        fs, p = _fs(self.spark, self.path)
        found = (s.getPath() for s in fs.listStatus(p))
        done = (x for x in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))
        return sorted(int(x.getName().partition("=")[2]) for x in done)

    def current(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={self._versions()[-1]}")

    def apply(self, batch: DataFrame, number: int) -> None:
        before = max(v for v in self._versions() if v < number)
        apply_log(self.spark.read.parquet(f"{self.path}/version={before}"), batch).write.mode("overwrite").parquet(f"{self.path}/version={number}")

    def start(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
