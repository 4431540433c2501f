"""The session settings that the engine's results rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results or layout; everything else stays the cluster's. A union that keeps its inputs' partitioning pairs them by number, which fails (or
#: pairs wrong rows) once an adaptive join reads one of them by map task. Batches for Python are
#: bounded by their bytes, so that a worker's memory does not follow the length of the texts.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.chunkBase64String.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to a running session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session, as tests and bench use it."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("docloom")
    for key, value in {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, with its store named, or one of our own where none is named and the session is a local one.

    What spark.checkpoint.dir names is shared by its meaning: without a scheme it lies in the default store, be that a disk that all machines mount.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-docloom-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    path = spark._jvm.org.apache.hadoop.fs.Path(named)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


#: Lists that take the paths of tables written meanwhile.
_RECORDS: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    for record in _RECORDS:
        record.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_alone(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s result written; the tables that were written on the way are deleted, also if it fails."""
    record: list[str] = []
    _RECORDS.append(record)
    done = 0
    try:
        out = written(make(), name)
        done = 1
        return out
    finally:
        _RECORDS.remove(record)
        for path in record[: len(record) - done]:
            removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch data, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
