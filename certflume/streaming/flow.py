"""The whole way as streams, from landed pages and tiles to alert log rows, and figures on the way.

Two queries follow each other. The first drops copies (keyed state), parses what is left of a micro-batch and
looks at its names, and writes the findings; the second turns findings into alert and repeat rows (keyed
state). Between them lies a table whose partitions are the first query's micro-batches, so either can stop
and go on from its checkpoint, and a batch that is done again replaces what it wrote.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..functions.names import short_log_name
from ..operators import flow
from ..operators.certificates import fingerprints, parse_certificates
from ..operators.stats import minute_rows
from ..sources.entries import decode_rfc6962, page_entries, tile_rows, union_entries
from .state import append_events, dedup_stream, record_stream, tagged

FINDINGS = "watch_id string, domain string, seen timestamp, seq bigint, body string, batch_id bigint"


def entry_stream(pages: DataFrame, tiles: DataFrame) -> DataFrame:
    """Entries of streams of pages and tiles, with ``seen``, ``sha256`` and ``error``; the progress of a query over it has the
    figures of what was read under ``read``."""
    whole = union_entries(decode_rfc6962(page_entries(pages)), tile_rows(tiles))
    stamped = whole.withColumn("seen", F.col("ts")).withColumn("sha256", F.sha2("der", 256))
    return flow.observed(stamped, "read", flow.read_figures())


@dataclass(frozen=True)
class Folders:
    """Where a flow keeps its findings, its alert log, and both queries' checkpoints; reachable by all executors."""

    base: str

    @property
    def findings(self) -> str:
        return f"{self.base}/findings"

    @property
    def alerts(self) -> str:
        return f"{self.base}/alerts"

    @property
    def counts(self) -> str:
        return f"{self.base}/counts"

    def checkpoint(self, name: str) -> str:
        return f"{self.base}/checkpoint-{name}"


def finding_query(entries: DataFrame, watch, folders: Folders, ttl: str = "15 minutes", lateness: str = "1 minute", recent: DataFrame | None = None) -> DataStreamWriter:
    """From ``entry_stream`` to findings and to the figures of every micro-batch. ``watch`` may be a ``Reloaded``."""
    good = entries.filter("error IS NULL").drop("error", "n", "width")
    kept = dedup_stream(good, ttl=ttl, lateness=lateness, recent=recent)

    def write(batch: DataFrame, batch_id: int) -> None:
        current = watch() if callable(watch) else watch
        parsed = flow.landed(parse_certificates(batch), f"certificates-{batch_id}")
        counts = parsed.agg(*[c.alias(n) for n, c in flow.published_figures().items()])
        append_events(counts, batch_id, folders.counts)
        certs = parsed.filter("parsed IS NOT NULL").withColumn("fingerprints", fingerprints(F.col("der")))
        append_events(flow.finding_rows(certs, current), batch_id, folders.findings)

    return kept.writeStream.foreachBatch(write).option("checkpointLocation", folders.checkpoint("findings"))


def alert_query(spark: SparkSession, folders: Folders, window: str = "24 hours", lateness: str = "1 minute", triage: DataFrame | None = None,
                history: DataFrame | None = None) -> DataStreamWriter:
    """From the findings to alert log rows. ``triage``: a stream as ``tagged`` reads it."""
    found = spark.readStream.schema(FINDINGS).parquet(folders.findings).drop("batch_id")
    rows = record_stream(tagged(found, triage), window, lateness, history=history)

    def write(batch: DataFrame, batch_id: int) -> None:
        append_events(batch, batch_id, folders.alerts)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", folders.checkpoint("alerts"))


def catch_up(entries: DataFrame, watch, folders: Folders, recent: DataFrame | None = None, history: DataFrame | None = None, **options) -> dict[str, int]:
    """Read what has landed since the last call, then stop; returns the figures of what was read."""
    spark = entries.sparkSession
    first = finding_query(entries, watch, folders, recent=recent, **options).trigger(availableNow=True).start()
    first.awaitTermination()
    # Without any finding yet there is no folder to read.
    if _exists(spark, folders.findings):
        second = alert_query(spark, folders, history=history).trigger(availableNow=True).start()
        second.awaitTermination()
    return figures(first, "read")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def figures(query: StreamingQuery, name: str) -> dict[str, int]:
    """What a query observed under a name so far, added up over its micro-batches."""
    total: dict[str, int] = {}
    for progress in query.recentProgress:
        row = progress.observedMetrics.get(name)
        for key, value in (row.asDict() if row is not None else {}).items():
            total[key] = total.get(key, 0) + (value or 0)
    return total


def run_until(query: StreamingQuery, seconds: float | None = None, rows: int | None = None, poll: float = 0.5) -> str:
    """Let a query run for so long, or until it has read so many rows, and stop it; says which it was.

    Rows are counted by the query's own progress, so the micro-batch that reaches the number is finished. ``ended``: it
    came to its end before, or failed, which is raised.
    """
    begin = time.monotonic()
    seen: dict[int, int] = {}
    while query.isActive:
        for progress in query.recentProgress:
            seen[progress.batchId] = max(seen.get(progress.batchId, 0), progress.numInputRows)
        if rows is not None and sum(seen.values()) >= rows:
            query.stop()
            return "rows"
        if seconds is not None and time.monotonic() - begin >= seconds:
            query.stop()
            return "time"
        query.awaitTermination(poll)
    if query.exception() is not None:
        raise query.exception()
    return "ended"


# --- figures ------------------------------------------------------------------

def per_minute_stream(certs: DataFrame, lateness: str = "10 minutes", by: str | None = None) -> DataFrame:
    """Certificates per minute (and ``org`` or ``ending``) as a stream: a minute comes out, once, when the watermark has passed it."""
    rows = minute_rows(certs).withWatermark("seen", lateness)
    keys = [F.window("seen", "1 minute").alias("w"), *([F.col(by)] if by else [])]
    counted = (rows.filter(F.col(by).isNotNull()) if by else rows).groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if("pre").alias("pre"))
    return counted.select(F.col("w.start").alias("minute"), *([by] if by else []), *(["total"] if by else ["total", "pre"]))


def rate_stream(certs: DataFrame, seconds: int = 5, lateness: str = "1 minute") -> DataFrame:
    """Certificates per second over spans of a few seconds, as a stream."""
    per = certs.withWatermark("seen", lateness).groupBy(F.window("seen", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return per.select(F.col("w.start").alias("start"), F.round(F.col("n") / seconds).cast("bigint").alias("per_second"))


def log_rate_stream(certs: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Certificates of each log per minute, as a stream."""
    per = certs.withWatermark("seen", lateness).groupBy(F.window("seen", "1 minute").alias("w"), short_log_name(F.col("log_name")).alias("log")).agg(F.count(F.lit(1)).alias("total"))
    return per.select(F.col("w.start").alias("minute"), "log", "total")
