"""Node and edge facts as streams: each micro-batch is merged into tables kept as parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..graph import canonical_id

BUCKETS = 32


def bucket(c: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def merge_first(kept: DataFrame | None, batch: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the first by ``order`` of what is kept and what arrives; repeats change nothing."""
    rows = batch if kept is None else kept.unionByName(batch, allowMissingColumns=True)
    columns = [c for c in rows.columns if c != key]
    one = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(order, *[c for c in columns if c != order])).alias("r"))
    return one.select(key, *[f"r.{c}" for c in columns])


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "id", order: str = "seq", buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the first row of each key of a stream under ``path``, by hash buckets of the key.

    A micro-batch reads and writes only the buckets it touches, into a new version beside the old;
    the version that the marker names is the current one. A batch that is repeated after a failure
    writes the same version again, so a restart loses and doubles nothing.
    """
    spark = stream.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn(key, canonical_id(key)).withColumn("bucket", bucket(key, buckets))
        touched = [r.bucket for r in batch.select("bucket").distinct().collect()]
        for b in touched:  # at most ``buckets`` of them
            at = f"{path}/bucket={b}"
            versions = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(hadoop.Path(at))) if fs.exists(hadoop.Path(at)) else []
            before = [v for v in versions if v < number]
            kept = spark.read.parquet(f"{at}/version={before[-1]}") if before else None
            merge_first(kept, batch.filter(F.col("bucket") == b).drop("bucket"), key, order).write.mode("overwrite").parquet(f"{at}/version={number}")
            for old in before[:-1]:
                fs.delete(hadoop.Path(f"{at}/version={old}"), True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserts(spark, path: str, schema: StructType) -> DataFrame:
    """The rows kept by :func:`upsert_stream`."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = []
    for b in fs.listStatus(hadoop.Path(path)) if fs.exists(hadoop.Path(path)) else []:
        if b.isDirectory() and b.getPath().getName().startswith("bucket="):
            versions = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(b.getPath())]
            parts.append(f"{path}/{b.getPath().getName()}/version={max(versions)}")
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
