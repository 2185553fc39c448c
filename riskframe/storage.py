"""Tables between steps: Parquet in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a session of one machine gets a fresh local one; on a cluster that
    is an error, since its machines don't see each other's folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-riskframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as a Parquet table in the shared folder; the table and its path. Lineage ends here, so executors may be lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, name: str) -> DataFrame:
    """The table of stored()."""
    return stored(df, name)[0]


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it doesn't exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []


def write_manifest(spark: SparkSession, folder: str, n: int, content: dict) -> None:
    """Manifest number n of a folder: written beside its place, then renamed, so it is there whole or not at all."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_manifest/{n}.json")
    half = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_manifest/_{n}-{uuid.uuid4().hex}")
    store = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = store.create(half, True)
    out.write(json.dumps(content).encode())
    out.close()
    if not store.rename(half, at):
        raise OSError(f"could not rename {half} to {at}")


def read_manifest(spark: SparkSession, folder: str, back: int = 0) -> tuple[int | None, dict]:
    """(number, content) of the newest manifest of a folder, or of the one that many before it; (None, {}) where there is none."""
    numbers = sorted(int(x.removesuffix(".json")) for x in listed(spark, f"{folder}/_manifest") if x.endswith(".json") and x[0] != "_")
    if len(numbers) <= back:
        return None, {}
    n = numbers[-1 - back]
    return n, json.loads("".join(r.value for r in spark.read.text(f"{folder}/_manifest/{n}.json").collect()))  # one short file
