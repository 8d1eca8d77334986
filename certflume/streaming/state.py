"""Deduplication and alert recording as keyed state.

Both keep one anchored window per key. Within a micro-batch a key's events are
taken in time order, copies at one instant first merged where they are read;
state leaves when the watermark has passed the end of the window. Events later
than the watermark are judged by the state that is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.alerts import alert_id, alert_state
from ..operators.watchlist import CompiledWatchlist, PinnedWatchlist, compile_watchlist, normalize_watchlist, pin
from ..operators.windows import anchored_windows, micros
from ..session import STATE_STORE
from ..sources.files import read_watchlist

_ANCHOR = T.StructType([T.StructField("anchor", T.LongType())])
_ALERT = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("status", T.StringType())])


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class _FirstCopies(StatefulProcessor):
    """Keeps the rows that open a window; drops the others."""

    def __init__(self, length_us: int):
        self.length_us = length_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _ANCHOR)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.open.get() if self.open.exists() else None
        anchor = held[0] if held else None
        batch = pd.concat(list(rows)).sort_values(["at_us", "at_order"], kind="stable")
        kept = []
        for i, us in enumerate(batch["at_us"]):
            if anchor is None or us - anchor >= self.length_us:
                anchor = int(us)
                kept.append(i)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.open.update((anchor,))
        self.handle.registerTimer((anchor + self.length_us) // 1000 + 1)
        yield batch.iloc[kept].drop(columns=["at_us", "at_order"])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        anchor = int(initialState["anchor"].max())
        self.open.update((anchor,))
        self.handle.registerTimer((anchor + self.length_us) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def dedup_stream(entries: DataFrame, key: str = "sha256", ts: str = "seen", ttl: str = "15 minutes",
                 order: tuple[str, ...] = ("log_url", "index"), lateness: str = "1 minute", recent: DataFrame | None = None) -> DataFrame:
    """The first copy of every entry inside the anchored window, as a stream.

    ``recent`` (the key and ``anchor``, see ``open_windows``) are windows that were open when the stream
    begins; it is read with the first batch of a new checkpoint only.

    Only equal instants are merged before the state, which is exact and keeps
    a key that floods one micro-batch from flooding its group.
    """
    use_rocksdb(entries.sparkSession)
    columns = entries.columns
    ranked = entries.withColumn("at_us", F.unix_micros(ts)).withColumn(
        "at_order", F.concat_ws("\x1f", *[F.lpad(F.col(c).cast("string"), 20, F.lit("0")) if str(entries.schema[c].dataType) in (
            "LongType()", "IntegerType()") else F.col(c).cast("string") for c in order]))

    def first_of_instant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.sort_values([key, "at_us", "at_order"], kind="stable").drop_duplicates([key, "at_us"])

    thin = ranked.mapInPandas(first_of_instant, ranked.schema)
    return thin.withWatermark(ts, lateness).groupBy(key).transformWithStateInPandas(
        statefulProcessor=_FirstCopies(micros(ttl)), outputStructType=T.StructType([entries.schema[c] for c in columns]),
        outputMode="Append", timeMode="EventTime", initialState=None if recent is None else recent.select(key, "anchor").groupBy(key))


def open_windows(entries: DataFrame, key: str = "sha256", ts: str = "seen", ttl: str = "15 minutes") -> DataFrame:
    """The last window of each key of a table, for a stream that goes on from it."""
    return anchored_windows(entries, [key], ts, ttl).groupBy(key).agg(F.max("_anchor").alias("anchor"))


def latest_alerts(events: DataFrame) -> DataFrame:
    """The last alert of each entry and name in an event log, for a stream that goes on from it: watch_id, domain, anchor, status."""
    state = alert_state(events).select(F.col("watch.id").alias("watch_id"), "domain", F.unix_micros("created_at").alias("anchor"), "status")
    return state.groupBy("watch_id", "domain").agg(F.max(F.struct("anchor", "status")).alias("s")).select("watch_id", "domain", "s.anchor", "s.status")


class _Recorder(StatefulProcessor):
    """Turns findings and triage of a key into alert and repeat rows."""

    def __init__(self, length_us: int, horizon_us: int | None = None):
        self.length_us, self.horizon_us = length_us, horizon_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", _ALERT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.latest.get() if self.latest.exists() else None
        anchor, status = (held[0], held[1]) if held else (None, None)
        # On equal time triage comes first.
        batch = pd.concat(list(rows)).sort_values(["at_us", "is_finding", "seq"], kind="stable")
        kinds, anchors = [], []
        for us, finding, change, target in zip(batch["at_us"], batch["is_finding"], batch["status"], batch["target_us"]):
            if not finding:
                if anchor is not None and target == anchor and isinstance(change, str):
                    status = change
                kinds.append("status")
                anchors.append(target)
                continue
            quiet = anchor is not None and (status == "false_positive" or us - anchor < self.length_us)
            if not quiet:
                anchor, status = int(us), "new"
            kinds.append("repeat" if quiet else "alert")
            anchors.append(anchor)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if anchor is not None:
            self.latest.update((anchor, status))
            # A mark may come long after its alert, so the key's last alert (two values) stays
            # known; a silenced key stays silent for good.
            if self.horizon_us is not None and status != "false_positive":
                self.handle.registerTimer((anchor + max(self.length_us, self.horizon_us)) // 1000 + 1)
        out = batch[["watch_id", "domain", "seen", "body"]].copy()
        out["type"], out["anchor"] = kinds, anchors
        yield out

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        last = initialState.sort_values("anchor").iloc[-1]
        anchor, status = int(last["anchor"]), last["status"]
        self.latest.update((anchor, status))
        if self.horizon_us is not None and status != "false_positive":
            self.handle.registerTimer((anchor + max(self.length_us, self.horizon_us)) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.latest.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


RECORDED = "watch_id string, domain string, seen timestamp, body string, type string, anchor bigint"


def tagged(findings: DataFrame, triage: DataFrame | None = None) -> DataFrame:
    """Findings (watch_id, domain, seen, seq, body) and triage (watch_id, domain,
    at, target_at, status, seq) as one input for ``record_stream``."""
    left = findings.select("watch_id", "domain", "seen", "seq", "body", F.lit(1).alias("is_finding"),
                           F.lit(None).cast("string").alias("status"), F.lit(0).cast("bigint").alias("target_us"))
    if triage is None:
        return left
    right = triage.select("watch_id", "domain", F.col("at").alias("seen"), "seq", F.lit(None).cast("string").alias("body"),
                          F.lit(0).alias("is_finding"), "status", F.unix_micros("target_at").alias("target_us"))
    return left.unionByName(right)


def record_stream(events: DataFrame, window: str = "24 hours", lateness: str = "1 minute", triage_within: str | None = None,
                  history: DataFrame | None = None) -> DataFrame:
    """Alert log rows of a ``tagged`` stream: alert, repeat and status.

    The last alert of each key is remembered for good, as a false-positive mark
    can arrive at any time; ``triage_within`` forgets it that long after the alert.

    ``history`` (see ``latest_alerts``) are alerts from before the stream: repeats of them raise no
    new one, and silenced keys stay silent. It is read with the first batch of a new checkpoint only.

    The id of an alert is the hash that batch recording gives it, so both
    write the same log.
    """
    use_rocksdb(events.sparkSession)
    stamped = events.withColumn("at_us", F.unix_micros("seen")).withWatermark("seen", lateness)
    recorded = stamped.groupBy("watch_id", "domain").transformWithStateInPandas(
        statefulProcessor=_Recorder(micros(window), None if triage_within is None else micros(triage_within)), outputStructType=RECORDED, outputMode="Append", timeMode="EventTime",
        initialState=None if history is None else history.select("watch_id", "domain", "anchor", "status").groupBy("watch_id", "domain"))
    return recorded.withColumn("id", alert_id(F.col("watch_id"), F.col("domain"), F.col("anchor")))


def append_events(batch: DataFrame, batch_id: int, path: str) -> None:
    """``foreachBatch`` sink: one partition per micro-batch, replaced when the
    batch is replayed, so every event is written once."""
    (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


class Reloaded:
    """A watchlist that is read again when its version changes; called for every micro-batch."""

    def __init__(self, load: Callable[[], CompiledWatchlist], version: Callable[[], object]):
        self.load, self.version = load, version
        self.held: PinnedWatchlist | None = None
        self.known: object = None

    def __call__(self) -> PinnedWatchlist:
        version = self.version()
        if self.held is None or version != self.known:
            self.held, self.known = pin(self.load()), version
        return self.held


def watchlist_file(spark: SparkSession, path: str) -> Reloaded:
    """The watchlist of a file or folder, with the names, times and sizes of its files as version. Entries that break a rule are left out."""
    def version() -> list:
        files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
        return sorted(map(tuple, files.collect()))  # a watchlist is one file or a few

    return Reloaded(lambda: compile_watchlist(normalize_watchlist(read_watchlist(spark, path))[0]), version)


def detect_batch(watch, path: str, keys: tuple[str, ...] = ("sha256", "pos")):
    """A ``foreachBatch`` function that writes the findings of certificate names; ``watch`` may be a ``Reloaded``."""
    from ..operators.detect import best_per_certificate, detect

    def write(batch: DataFrame, batch_id: int) -> None:
        current = watch() if callable(watch) else watch
        found = best_per_certificate(detect(batch, current, keys=keys), keys[:1], keys[1])
        append_events(found, batch_id, path)

    return write
