"""Helpers that the training-data operators share: tables, shared scratch space, Arrow maps."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20
_OWN: dict[str, str] = {}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale or script."""
    return F.translate(c, UPPER, LOWER)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # a session of this machine's own, as in tests
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        base = _OWN[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a table made by ``materialize`` that nothing reads any more."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps, which else wait for the driver's next garbage collections.

    Python lets go of its handles in the first round, and the JVM of what they held in the second.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def _bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, unless the session has a bound of its own: two copies of a batch are in the JVM and several in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's default
        spark.conf.set(name, str(BATCH_BYTES))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` by a function of one batch."""
    arrow = to_arrow_schema(schema)
    _bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield from pa.table(out).select(arrow.names).cast(arrow).combine_chunks().to_batches() if isinstance(out, pa.Table) else [out]
            del batch, out
            pa.default_memory_pool().release_unused()  # a worker goes on to other stages, and keeps what its pool keeps

    return df.mapInArrow(run, schema)


def append_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], new: T.StructType) -> DataFrame:
    """``df`` with columns computed from each Arrow batch; a new column takes the place of one that has its name."""
    kept = [f for f in df.schema.fields if f.name.lower() not in {x.name.lower() for x in new.fields}]
    schema = T.StructType([*kept, *new.fields])
    names, arrow = [f.name for f in kept], to_arrow_schema(new)

    def one(batch: pa.RecordBatch) -> pa.Table:
        out = fn(batch)
        cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
        return pa.table(cols + [pa.array(out[f.name], f.type) if not isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else out[f.name].cast(f.type) for f in arrow], names=[*names, *arrow.names])

    return map_batches(df, one, schema)


def hash_buckets(df: DataFrame, *cols: str, n: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n))


def hash_sample(df: DataFrame, key: str, most: int, salt: str, by: str | None = None, counts: dict | None = None) -> DataFrame:
    """About ``most`` rows, chosen by a hash of ``key``: the same rows each time, with no sort and no shuffle of them.

    With ``by``, about ``most`` rows of each value in ``counts``, which has the values' numbers of rows.
    """
    counts = list(counts.items()) if by else [(None, df.count())]
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(salt)), F.lit(1 << 30))
    share = F.lit(0)
    for value, n in counts:
        part = F.lit(min(1 << 30, (most << 30) // max(n, 1)))
        share = part if by is None else F.when(F.col(by) == value, part).otherwise(share)
    return df.where(draw < share)
