"""Incremental load of newly arrived files with upsert by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.collections import latest, upsert
from ..storage import read_manifest, removed, shared_folder, stored, write_manifest

#: Bucket of rows without a key.
KEYLESS = -1


def read_target(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The table that the newest manifest of a target names; empty before the first one."""
    live = read_manifest(spark, target)[1]
    paths = [f"{target}/{p}" for own in live.values() for p in own]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge_batch(spark: SparkSession, batch: DataFrame, n: int, key: str, order_col: str, target: str, buckets: int) -> None:
    """Merge batch number n into the target: only buckets (of the key's hash) that the batch has rows of are read and written anew, then a manifest names the live folders of all.

    Until the manifest stands, the target is what it was: a batch that failed runs again over the same buckets, and one whose manifest stands is passed over. Folders that
    neither this manifest nor the one before it names are removed. Rows without a key are added.
    """
    at, live = read_manifest(spark, target)
    if at is not None and at >= n:
        return
    bucket = F.when(F.col(key).isNull(), KEYLESS).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    fresh, fresh_at = stored(batch.withColumn("__bucket", bucket), "fresh")
    touched = sorted(r[0] for r in fresh.select("__bucket").distinct().collect())  # buckets + 1 rows at most
    old = [f"{target}/{p}" for b in touched if b != KEYLESS for p in live.get(str(b), [])]
    keyed = fresh.where(F.col("__bucket") != KEYLESS)
    rows = upsert(spark.read.schema(batch.schema).parquet(*old).withColumn("__bucket", bucket), keyed, key, order_col) if old else latest(keyed, key, F.desc(order_col))
    rows = rows.unionByName(fresh.where(F.col("__bucket") == KEYLESS))
    rows.repartition(max(1, len(touched)), "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{target}/data/{n}")
    now = {**live, **{str(b): [*(live.get(str(b), []) if b == KEYLESS else []), f"data/{n}/__bucket={b}"] for b in touched}}
    before = read_manifest(spark, target, 1)[1]
    write_manifest(spark, target, n, now)
    named = {p for m in (live, now) for own in m.values() for p in own}
    removed(spark, fresh_at, *(f"{target}/{p}" for own in before.values() for p in own if p not in named))


def stream_upsert(spark: SparkSession, source: str, schema: StructType, key: str, order_col: str, target: str | None = None, buckets: int = 64) -> DataFrame:
    """Load what has newly arrived in source (a Parquet file or folder) into the target table and return the table; latest row wins.

    The stream runs until all files present are loaded; its checkpoint lies beside the target, so the next call takes only newer files. Each batch is merged as in merge_batch, so its cost goes with the
    buckets it touches; a table that was returned stays readable until two more batches are merged. A target that never got a file is empty. `buckets` stays the same for a target.
    """
    target = target or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    run = (
        reader.parquet(source).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{target}/_checkpoint")
        .foreachBatch(lambda batch, n: merge_batch(spark, batch, n, key, order_col, target, buckets)).start()
    )
    run.awaitTermination()
    return read_target(spark, target, schema)
