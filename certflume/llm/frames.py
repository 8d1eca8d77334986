"""Small helpers shared by the operators: added columns, sizes, cut lineage."""

from __future__ import annotations

import pickle
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from .text import slices


#: Rows of one Arrow batch between Spark and Python: with texts of thousands of characters the usual 10,000 take much memory.
BATCH_ROWS = 1000
#: Rows of a few numbers that one task reads.
SMALL_ROWS = 50_000


def small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def without(df: DataFrame, names) -> DataFrame:
    """The frame without columns of these names, case not regarded: the new ones replace them."""
    gone = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in gone])


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same step; at its end the worker process, which stays for later tasks, gives freed memory back to the system."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return released


def extend(df: DataFrame, text: str, make: Callable[[pa.RecordBatch], list[pa.Array]], added: StructType, size: int = 500_000,
           keep: list[str] | None = None) -> DataFrame:
    """Append to each row what `make` gives for a batch of about `size` bytes of text; nothing is shuffled.

    `keep`: columns of the result besides the added ones (all, by default); clashing ones are replaced.
    """
    small_batches(df.sparkSession)
    gone = {f.name.lower() for f in added.fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in gone]
    source = df.select(*[quoted(c) for c in kept], F.col(quoted(text)).cast("string").alias("__text"))
    schema = StructType([*df.select(*[quoted(c) for c in kept]).schema.fields, *added.fields])
    names, n = [f.name for f in schema.fields], len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", size):
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], *make(batch)], names=names)

    return source.mapInArrow(releasing(run), schema)


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def field(name: str, kind) -> StructField:
    return StructField(name, kind)


def total_bytes(df: DataFrame, *columns: str) -> int:
    """Bytes of the given string or binary columns over all rows."""
    small_batches(df.sparkSession)
    size = sum((F.coalesce(F.octet_length(F.col(quoted(c))), F.lit(0)) for c in columns), F.lit(0).cast("long"))
    return df.agg(F.sum(size)).first()[0] or 0


def partitions_for(spark: SparkSession, size: int, each: int) -> int:
    """Groups of about `each` bytes, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for rows of a few numbers: so many as they need, and one for each core at least. A frame of few rows in many
    partitions costs the driver a task for each of them at every step that reads it."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // SMALL_ROWS))


def scratch(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset and Spark is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="certflume-")


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage by a copy in spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir that every executor can reach."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def shipped(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A function that gives `value` inside tasks. It travels as bytes with the code of its classes, so workers need not
    be able to import them; a worker process unpacks it once and remembers the last few."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get() -> Any:
        held = sys.__dict__.setdefault("_certflume_shipped", {})
        key = hash(sent.value)
        if key not in held:
            while len(held) >= 4:
                del held[next(iter(held))]
            held[key] = pickle.loads(sent.value)
        return held[key]

    return get


def noded(docs: DataFrame, doc_id: str, text: str, keep: tuple | list = ()) -> DataFrame | None:
    """(__node, __id, __text and `keep`) where ids stand for one text each; None if the given ids do so already.

    Of an id with several texts that of the least hash keeps the id; the others get negative numbers made of id and text.
    """
    rows = docs.select(F.col(quoted(doc_id)).cast("long").alias("__id"), F.col(quoted(text)).cast("string").alias("__text"), *keep).withColumn("__h", F.xxhash64("__text"))
    several = rows.where("__id IS NOT NULL").groupBy("__id").agg(F.min("__h").alias("__low"), F.max("__h").alias("__high")).where("__low < __high")
    if several.isEmpty():
        return None
    own = F.when(F.col("__low").isNull() | (F.col("__h") == F.col("__low")), F.col("__id")).otherwise(-F.abs(F.xxhash64("__id", "__h") % (1 << 62)) - (1 << 62))
    return rows.join(several.select("__id", "__low"), "__id", "left").select(own.alias("__node"), "__id", "__text", *keep)


def renamed_nodes(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Results of `noded` rows (doc_id and component_id are nodes) by the rows' own ids; a component is named by its smallest id."""
    own = nodes.groupBy("__node").agg(F.min("__id").alias("__id"))
    rows = found.join(own, F.col("doc_id") == F.col("__node"), "left")
    names = rows.where("component_id IS NOT NULL").groupBy(F.col("component_id").alias("__component")).agg(F.min("__id").alias("__name"))
    rows = rows.join(names, F.col("component_id") == F.col("__component"), "left")
    return rows.select(*[F.col("__id").alias(c) if c == "doc_id" else F.col("__name").alias(c) if c == "component_id" else F.col(c) for c in found.columns])


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(quoted(doc_id)).cast("string"), F.lit(""))) % n
