"""Streams from landed files to alerts: stopped and begun again, seeded from history, with a watchlist that changes; figures on the way."""

import json

import pytest
from pyspark.sql import functions as F

from certflume.operators import flow as batch_flow, stats
from certflume.operators.alerts import alert_log, record_alerts
from certflume.operators.watchlist import compile_watchlist, watchlist_frame
from certflume.plans.certificate_queries import pages, tiles
from certflume.plans.views import certs, watchlist
from certflume.streaming import flow, state

FOLDER = "/root/testdata/sf0.001"
DAY = 86_400


@pytest.fixture(scope="module")
def cut(spark):
    """Pages and tiles of all events, in memory of the driver: they are few."""
    return pages(spark, FOLDER).cache(), tiles(spark, FOLDER).cache()


def land(frames, folder, number, of):
    """The part of the pages and tiles that belongs to one of `of` stretches of indices."""
    paged, tiled = frames
    wide = 1000 // of
    paged.filter(F.floor(F.col("start") / wide) == number).coalesce(1).write.mode("append").parquet(f"{folder}/pages")
    # A tile lands when its first entry does.
    tiled.filter(F.floor(F.col("n") * 256 / wide) == number).coalesce(1).write.mode("append").parquet(f"{folder}/tiles")


def streamed(spark, frames, folder):
    paged, tiled = frames
    return flow.entry_stream(spark.readStream.schema(paged.schema).parquet(f"{folder}/pages"), spark.readStream.schema(tiled.schema).parquet(f"{folder}/tiles"))


def test_three_landings_with_stops_between_give_the_alerts_of_the_batch(spark, cut, tmp_path):
    folders, total = flow.Folders(str(tmp_path / "flow")), {}
    for number in range(3):
        land(cut, tmp_path, number, 3)
        # A new query each time: nothing but the folders is kept. Tiles and pages overlap, so entries come late.
        for k, v in flow.catch_up(streamed(spark, cut, tmp_path), watchlist(spark), folders, lateness="3650 days").items():
            total[k] = total.get(k, 0) + v
    landed = [spark.read.schema(f.schema).parquet(f"{tmp_path}/{n}") for f, n in zip(cut, ("pages", "tiles"), strict=True)]
    none = spark.createDataFrame([], "fp string, der binary")
    published = batch_flow.publish(*landed, none)
    expected = {r.id: r["count"] for r in batch_flow.alerts(*landed, none, watchlist(spark)).collect()}
    rows = spark.read.parquet(folders.alerts)
    got = {r.id: r.n for r in rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == expected and len(got) > 20
    assert rows.filter("type = 'alert'").count() == len(expected)
    assert total == {k: published.counts[k] for k in total} and total["entries"] > 1000
    kept = spark.read.parquet(folders.counts).groupBy().sum("kept", "certificates", "precertificates", "unreadable").first()
    assert tuple(kept) == tuple(published.counts[k] for k in ("kept", "certificates", "precertificates", "unreadable"))


def test_published_counts_equal_a_count_of_the_tables(spark, cut):
    published = batch_flow.publish(*cut, spark.createDataFrame([], "fp string, der binary"))
    c = published.counts
    assert published.certificates.count() == c["certificates"] + c["precertificates"] == c["kept"] - c["unreadable"]
    assert published.rejected.count() == c["skipped"] + c["rejected_tiles"] + c["unreadable"]
    assert c["duplicates"] == c["entries"] - c["kept"] > 500


FINDING = "watch struct<id:string,name:string,kind:string>, domain string, score int, severity string, seq bigint, t bigint"


def _findings(spark, rows):
    return spark.createDataFrame([(("w", "W", "brand"), d, 70, "medium", i, t) for i, (d, t) in enumerate(rows)], FINDING).withColumn("seen", F.timestamp_seconds("t"))


def test_a_stream_goes_on_from_an_alert_log(spark, tmp_path):
    """Begun on day 3: a key silenced on day 1 stays silent, an alert of an hour ago is repeated, an old one is not."""
    old = _findings(spark, [("quiet", 0), ("old", 0), ("fresh", 3 * DAY - 3600)])
    opened = {r.domain: r.id for r in record_alerts(old, order=("seq",)).select("domain", "id").collect()}
    triage = spark.createDataFrame([(opened["quiet"], 3600, "false_positive", None)], "id string, at_s bigint, status string, note string").select("id", F.timestamp_seconds("at_s").alias("at"), "status", "note")
    log = alert_log(old, triage, order=("seq",))
    rank = F.when(F.col("type") == "alert", 0).otherwise(1)
    events = log.withColumn("seq", F.unix_seconds("at") * 10 + rank).withColumn("dns", F.lit(None).cast("string"))
    history = state.latest_alerts(events.drop("dns"))
    assert {(r.domain, r.anchor, r.status) for r in history.collect()} == {("quiet", 0, "false_positive"), ("old", 0, "new"), ("fresh", (3 * DAY - 3600) * 1_000_000, "new")}
    new = _findings(spark, [(d, 3 * DAY) for d in ("quiet", "old", "fresh", "other")]).select(F.col("watch.id").alias("watch_id"), "domain", "seen", "seq", F.lit("{}").alias("body"))
    given = state.tagged(new)
    given.coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = state.record_stream(spark.readStream.schema(given.schema).parquet(f"{tmp_path}/in"), history=history)
    query = rows.writeStream.format("memory").queryName("seeded").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.domain: r.type for r in spark.table("seeded").collect()} == {"quiet": "repeat", "old": "alert", "fresh": "repeat", "other": "alert"}


def test_a_stream_goes_on_from_recent_entries(spark, tmp_path):
    rows = [("l", i, k, t) for i, (k, t) in enumerate([("a", 0), ("a", 800), ("a", 1000), ("b", 100)])]
    schema = "log_url string, index bigint, sha256 string, t bigint"
    old = spark.createDataFrame(rows, schema).withColumn("seen", F.timestamp_seconds("t"))
    recent = state.open_windows(old)
    assert {(r.sha256, r.anchor) for r in recent.collect()} == {("a", 1_000_000_000), ("b", 100_000_000)}
    new = spark.createDataFrame([("l", 10, "a", 1500), ("l", 11, "a", 2000), ("l", 12, "b", 1200), ("l", 13, "c", 1200)], schema).withColumn("seen", F.timestamp_seconds("t"))
    new.coalesce(1).write.parquet(f"{tmp_path}/in")
    kept = state.dedup_stream(spark.readStream.schema(new.schema).parquet(f"{tmp_path}/in"), recent=recent)
    query = kept.writeStream.format("memory").queryName("resumed").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["index"] for r in spark.table("resumed").collect()) == [11, 12, 13]


def test_an_entry_added_between_micro_batches_is_found_in_the_next(spark, tmp_path):
    place = tmp_path / "watch" / "list.json"
    place.parent.mkdir()
    items = [{"id": "one", "kind": "brand", "name": "One", "keywords": ["paypoint"]}]
    place.write_text(json.dumps({"items": items}))
    reloaded = state.watchlist_file(spark, str(place.parent))
    names = spark.createDataFrame([(f"{h}", 0, d) for h, d in (("x", "paypoint.test"), ("y", "casino-win.test"))], "sha256 string, pos int, domain string")
    write = state.detect_batch(reloaded, str(tmp_path / "found"))
    write(names, 0)
    first = reloaded.held
    assert reloaded() is first
    place.write_text(json.dumps({"items": [*items, {"id": "two", "kind": "brand", "name": "Two", "keywords": ["casino"]}]}))
    write(names, 1)
    assert sorted((r.batch_id, r.watch.id, r.domain) for r in spark.read.parquet(str(tmp_path / "found")).select("batch_id", "watch", "domain").collect()) == [
        (0, "one", "paypoint.test"), (1, "one", "paypoint.test"), (1, "two", "casino-win.test")]


def test_minutes_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    """Rows come out of order within the allowed lateness; a last row far ahead closes all minutes."""
    rows = certs(spark, FOLDER)
    end = rows.limit(1).withColumn("seen", F.lit("2031-01-01").cast("timestamp"))
    shuffled = rows.orderBy(F.floor(F.unix_seconds("seen") / (3 * DAY)), F.xxhash64("index"))
    shuffled.coalesce(1).write.option("maxRecordsPerFile", 200).parquet(f"{tmp_path}/in")
    end.write.mode("append").parquet(f"{tmp_path}/in")
    given = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    parts = {"minutes": flow.per_minute_stream(given(), "6 days"), "orgs": flow.per_minute_stream(given(), "6 days", "org"), "rates": flow.rate_stream(given(), 5, "6 days")}
    for name, frame in parts.items():
        query = frame.writeStream.format("memory").outputMode("append").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination(240)
    expected = {"minutes": stats.per_minute(rows), "orgs": stats.per_minute_by(rows, "org").withColumnRenamed("count", "total"), "rates": stats.rate(rows)}
    for name, frame in expected.items():
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, frame.select(*spark.table(name).columns).collect())), name


def test_a_run_ends_by_time_or_by_rows(spark, tmp_path):
    source = spark.readStream.format("rate").option("rowsPerSecond", 200).load()
    start = lambda n: source.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/{n}").start()
    assert flow.run_until(start("time"), seconds=2, rows=10**9) == "time"
    query = start("rows")
    assert flow.run_until(query, seconds=120, rows=100) == "rows" and sum(p.numInputRows for p in query.recentProgress) >= 100
    given = spark.range(10).write.parquet(f"{tmp_path}/in") or spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    ended = given.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/ended").trigger(availableNow=True).start()
    assert flow.run_until(ended, seconds=120) == "ended"


def test_a_watchlist_in_code_stays(spark):
    fixed = state.Reloaded(lambda: compile_watchlist(watchlist_frame(spark, [{"id": "a", "kind": "brand", "name": "A", "keywords": ["aword"]}])), lambda: 1)
    assert fixed() is fixed()
