"""Latest-value tables fed by a stream, as a log of per-batch changes.

Each batch writes only the keys it touched, into a folder named by its number.
A batch that runs again after a failure overwrites its own folder, so every
change counts once. Reading merges the newest compacted base with the batches
after it; folders without a success mark are left out.

What a base covers is removed one compaction later: the last two bases and the
batches after the older one stay, so a reader that began before a compaction
finds all it listed, and a base that was cut off can be done without. However
long a stream runs, it leaves two bases and two intervals of batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import merge_latest
from ..session import removed


class StateLog:
    """`compact_every` None leaves compaction to a job of its own, which calls `compact` while the stream runs on."""

    def __init__(self, path: str, keys: Sequence[str], update: Sequence[str], order: Sequence[str],
                 skip_nulls: bool = False, compact_every: int | None = 100) -> None:
        self.path = path.rstrip("/")
        self.keys = list(keys)
        self.update = list(update)
        self.order = list(order)
        self.skip_nulls = skip_nulls
        self.compact_every = compact_every

    def write(self, changes: DataFrame, batch: int) -> None:
        """Reduce the batch to one row per key and store it.

        Every so many batches the finished ones before this are compacted
        first; this one may still be run again.
        """
        spark = changes.sparkSession
        if self.compact_every and batch and batch % self.compact_every == 0:
            self.compact(spark, batch - 1)
        rows = merge_latest(None, changes, self.keys, self.update, self.order, skip_nulls=self.skip_nulls)
        rows.write.mode("overwrite").parquet(f"{self.path}/log/lote={batch}")

    def read(self, spark: SparkSession, up_to: int | None = None) -> DataFrame:
        """One row per key: later batches win, field by field."""
        bases = [n for n in self._finished(spark, "base") if up_to is None or n <= up_to]
        base = max(bases, default=-1)
        log = [n for n in self._finished(spark, "log") if n > base and (up_to is None or n <= up_to)]
        parts = [self._folder(spark, "base", [base])] if bases else []
        if log:
            parts.append(self._folder(spark, "log", log))
        if not parts:
            raise ValueError(f"no finished batch below {self.path}")
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return merge_latest(None, rows, self.keys, self.update, ["lote"], skip_nulls=self.skip_nulls)

    def compact(self, spark: SparkSession, up_to: int | None = None) -> None:
        """Write the merged state as a new base, which readers take once it is complete, and remove what the base before it covers.

        Beside a running stream, pass the number of a batch that will not be run again.
        """
        bases = self._finished(spark, "base")
        done = [n for n in self._finished(spark, "log") if n > max(bases, default=-1) and (up_to is None or n <= up_to)]
        if not done:
            return
        self.read(spark, max(done)).write.mode("overwrite").parquet(f"{self.path}/base/lote={max(done)}")
        if bases:
            for n in bases[:-1]:
                removed(spark, f"{self.path}/base/lote={n}")
            for n in self._finished(spark, "log"):
                if n <= bases[-1]:
                    removed(spark, f"{self.path}/log/lote={n}")

    def _folder(self, spark: SparkSession, kind: str, batches: list[int]) -> DataFrame:
        paths = [f"{self.path}/{kind}/lote={n}" for n in batches]
        rows = spark.read.option("basePath", f"{self.path}/{kind}").parquet(*paths)
        return rows.withColumn("lote", F.col("lote").cast("bigint"))

    def _finished(self, spark: SparkSession, kind: str) -> list[int]:
        """Numbers of the batches whose write completed."""
        hadoop = spark._jvm.org.apache.hadoop.fs
        pattern = hadoop.Path(f"{self.path}/{kind}/lote=*/_SUCCESS")
        found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])
