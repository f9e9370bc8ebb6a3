"""A table of each key's last row, fed by a stream exactly once, of which a batch rewrites the buckets that it changes and no others."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class LastRows:
    """Where the table is. ``data/<batch>/bucket=<n>`` holds what a batch wrote; ``manifest/<batch>`` says for each bucket which batch wrote it last.

    A manifest counts once it is whole (Spark's ``_SUCCESS`` is in it). Until then the table is what the one before says, so a batch that breaks off at any
    point is as if it had not been; Spark runs it again under its number, and what it left behind is overwritten. A batch whose manifest is whole is not
    run again. Folders that neither the last ``keep`` manifests name are deleted, so readers of these go on.
    """

    path: str
    key: str
    order: tuple[str, ...]
    schema: T.StructType
    buckets: int = 64
    keep: int = 2

    def _fs(self, spark: SparkSession):
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path

    def committed(self, spark: SparkSession) -> list[int]:
        """Numbers of the batches whose manifests are whole, the last one last."""
        fs, path = self._fs(spark)
        root = path(f"{self.path}/manifest")
        found = [int(s.getPath().getName()) for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n for n in found if fs.exists(path(f"{self.path}/manifest/{n}/_SUCCESS")))

    def _manifest(self, spark: SparkSession, batch: int) -> dict[int, int]:
        return {r.bucket: r.batch for r in spark.read.parquet(f"{self.path}/manifest/{batch}").collect()}  # a row a bucket

    def _read(self, spark: SparkSession, where: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/{batch}/bucket={bucket}" for bucket, batch in sorted(where.items())]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def read(self, spark: SparkSession) -> DataFrame:
        done = self.committed(spark)
        return self._read(spark, self._manifest(spark, done[-1]) if done else {})

    def _last(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c not in (self.key, *self.order)]
        return rows.groupBy(self.key).agg(F.max(F.struct(*self.order, *rest)).alias("v")).select(self.key, "v.*").select(*self.schema.names)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def write(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``. Of rows of one key the last by ``order`` stays; rows without a key are left out."""
        spark = batch.sparkSession
        done = self.committed(spark)
        if number in done:
            return
        before = self._manifest(spark, done[-1]) if done else {}
        rows = batch.where(F.col(self.key).isNotNull()).select(*self.schema.names)
        touched = [r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        if touched:
            old = self._read(spark, {b: n for b, n in before.items() if b in touched})
            merged = self._last(rows.unionByName(old)).withColumn("bucket", self._bucket())
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{number}")
        now = before | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{number}")
        self._clean(spark, [*done, number])

    def _clean(self, spark: SparkSession, done: list[int]) -> None:
        """Deletes manifests before the last ``keep``, and data folders' buckets that those kept do not name."""
        fs, path = self._fs(spark)
        named = {(b, n) for m in done[-self.keep :] for b, n in self._manifest(spark, m).items()}
        for m in done[: -self.keep]:
            for b, n in self._manifest(spark, m).items():
                if (b, n) not in named:
                    fs.delete(path(f"{self.path}/data/{n}/bucket={b}"), True)
            fs.delete(path(f"{self.path}/manifest/{m}"), True)


def run(stream: DataFrame, table: LastRows, checkpoint: str, write: Callable[[DataFrame, int], None] | None = None):
    """Starts the stream into the table. Started again with its checkpoint, it goes on where it was."""
    return stream.writeStream.foreachBatch(write or table.write).option("checkpointLocation", checkpoint).start()


def unfinished(targets: DataFrame, table: LastRows) -> DataFrame:
    """Of ``targets`` those whose key is not in the table: what a run that goes on has still to do."""
    return targets.join(table.read(targets.sparkSession).select(table.key), table.key, "left_anti")
