"""Session settings the operators rely on."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A tile is hundreds of kilobytes, and what is read of it several times that: 10,000 rows are no measure of a batch.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}

# Stateful streams keep their state in RocksDB, off the JVM heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        # Scoring costs far more per byte than a plain aggregate: on small
        # tables exchanges keep their parallelism.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    A folder of our own is taken only where that is unset and Spark is one process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="certflume-")


def written(df: DataFrame) -> DataFrame:
    """The frame as it is now, from a copy in the folder of ``spark.checkpoint.dir``; for what
    several later steps read and is dear to make."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint()


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are over: it does so when the driver's garbage is collected,
    for which a large heap may wait until they fill a disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def landed(df: DataFrame, name: str) -> DataFrame:
    """The same as Parquet: smaller for rows with much in them, and made in one pass, so that what is
    observed of them is counted once."""
    folder = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    released(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _fits_parquet(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        names = [f.name.lower() for f in kind.fields]
        return len(names) > 0 and len(set(names)) == len(names) and all(_fits_parquet(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _fits_parquet(kind.elementType)
    if isinstance(kind, T.MapType):
        return _fits_parquet(kind.keyType) and _fits_parquet(kind.valueType)
    return isinstance(kind, (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def stored(df: DataFrame, name: str) -> DataFrame:
    """A copy that several steps read, each the columns that it needs; as Parquet if that holds what the frame has."""
    return landed(df, name) if _fits_parquet(df.schema) else written(df)
