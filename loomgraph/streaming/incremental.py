"""L5 as a stream: micro-batches add the keys that the store does not hold yet, or newer versions of their rows."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loomgraph.operators.evidence import newest


def has_rows(spark: SparkSession, store: str) -> bool:
    """Whether the folder is there, asked of the file system that it lies in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def append_new_keys(incoming: DataFrame, store: str, keys: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Append rows of ``incoming`` with unseen keys to the parquet store, one folder per batch.

    A folder is named by the checkpoint and the batch. A repeated batch overwrites its own folder and is
    compared with all others, so a restart after a lost driver leaves no duplicates, and a new
    checkpoint on a store that exists neither erases rows nor adds known keys.
    """
    keys = list(keys)
    schema = incoming.schema
    run = md5(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        first = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else batch.distinct()
        own = f"{run}-{number}"
        if has_rows(spark, store):
            stored = spark.read.schema(StructType([*schema.fields, StructField("batch", StringType())])).option("basePath", store).parquet(store)
            first = first.join(stored.where(F.col("batch") != own).select(*keys), keys, "left_anti")
        first.write.mode("overwrite").parquet(f"{store}/batch={own}")

    return incoming.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, store: str, schema: StructType) -> DataFrame:
    full = StructType([*schema.fields, StructField("version", LongType()), StructField("batch", StringType())])
    return spark.read.schema(full).option("basePath", store).parquet(store)


def append_versions(incoming: DataFrame, store: str, keys: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Append every row of ``incoming`` as a newer version of its key, one folder per batch; read with ``read_newest``.

    Of rows with one key in a batch the largest stays. Versions count up over all batches of the store. A repeated batch
    takes the place of its own folder and keeps its number, so a restart changes nothing.
    """
    keys = list(keys)
    schema = incoming.schema
    run = md5(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own, version = f"{run}-{number}", 1
        if has_rows(spark, store):
            known = _versions(spark, store, schema).agg(
                F.max(F.when(F.col("batch") == own, F.col("version"))).alias("own"), F.max(F.when(F.col("batch") != own, F.col("version"))).alias("last")
            ).first()
            version = known["own"] or (known["last"] or 0) + 1
        rows = newest(batch.withColumn("version", F.lit(version)), keys).select(*batch.columns, F.lit(version).cast("long").alias("version"))
        rows.write.mode("overwrite").parquet(f"{store}/batch={own}")

    return incoming.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_newest(spark: SparkSession, store: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """The newest row of every key in a store of versions; ``schema`` is that of the rows."""
    return newest(_versions(spark, store, schema).drop("batch"), list(keys)).select(*schema.names)


def compact(spark: SparkSession, store: str, schema: StructType, keys: Sequence[str], target: str) -> None:
    """Write the newest rows of ``store`` to a new store ``target``, with their versions, so that later batches count on."""
    keys = list(keys)
    rest = [c for c in schema.names if c not in keys]
    best = _versions(spark, store, schema).groupBy(*keys).agg(F.max(F.struct("version", *rest)).alias("r"))
    best.select(*keys, "r.*").select(*schema.names, "version").write.parquet(f"{target}/batch=compacted")
