"""What grows with a table is not shuffled, written or gathered more than its step needs."""

import random

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from certflume.functions.der import outline
from certflume.operators import flow, windows
from certflume.operators.alerts import record_alerts
from certflume.operators.certificates import cert_names, fingerprints, full_messages, parse_certificates
from certflume.operators.detect import best_per_certificate, detect, strongest
from certflume.operators.watchlist import compile_watchlist, watchlist_frame
from certflume.plans.certificate_queries import pages, tiles
from certflume.plans.views import certs, watchlist
from certflume.session import configure, written
from test_der_columns import certificate


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_chains_are_published_without_a_shuffle(spark):
    rng = random.Random(5)
    good = []
    while len(good) < 4:
        if outline(der := certificate(rng))["error"] is None:
            good.append(der)
    a, b, c, d = good
    chains = [[a, b], [b, b"broken", a], [], None, [None, c], [c, c], [b"broken"]]
    rows = [(i, 0, d, chain) for i, chain in enumerate(chains)]
    df = spark.createDataFrame(rows, "index bigint, entry_type int, der binary, chain array<binary>").withColumns(
        {"link": F.lit("l"), "log_name": F.lit("n"), "log_url": F.lit("u"), "seen": F.timestamp_seconds("index")})
    certs = parse_certificates(df).withColumn("fingerprints", fingerprints(F.col("der")))
    messages = full_messages(certs)
    assert "Exchange" not in plan(messages)
    got = {r["cert_index"]: r["chain"] for r in messages.select("message.data.*").collect()}
    alone = {bytes(r["der"]): r for r in parse_certificates(spark.createDataFrame([(x,) for x in good], "der binary")).withColumn("prints", fingerprints(F.col("der"))).withColumn(
        "as_der", F.regexp_replace(F.base64("der"), r"[\r\n]", "")).collect()}
    for i, chain in enumerate(chains):
        readable = [x for x in chain or () if x in alone]
        assert [o["as_der"] for o in got[i]] == [alone[x]["as_der"] for x in readable]
        for o, x in zip(got[i], readable, strict=True):
            whole = alone[x]
            assert (o["fingerprint"], o["sha256"]) == (whole["prints"]["sha1"], whole["prints"]["sha256"])
            assert all(o[f] == whole["parsed"][f] for f in ("subject", "issuer", "extensions", "not_before", "not_after", "serial_number", "signature_algorithm", "is_ca"))


@F.arrow_udf(T.LongType())
def rows_of_batch(data: pa.Array) -> pa.Array:
    return pa.array([len(data)] * len(data), pa.int64())


def test_batches_of_large_rows_are_small(spark):
    configure(spark)
    large = spark.range(0, 40, 1, 1).select(F.encode(F.repeat(F.lit("x"), 1 << 20), "UTF-8").alias("content"))
    assert max(r[0] for r in large.select(rows_of_batch("content")).collect()) < 20


def small_tables(spark, folder) -> str:
    spark.range(600).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 40).alias("ts"), (F.col("id") % 7).alias("user_id"),
                            F.when(F.col("id") % 3 == 0, "view").otherwise("click").alias("event_type")).write.parquet(f"{folder}/events.parquet")
    spark.range(9).select(F.col("id").alias("page_id"), F.format_string("http://p%d.example.com/", "id").alias("url")).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_pages_and_tiles_are_made_behind_the_shuffle(spark, tmp_path):
    folder = small_tables(spark, tmp_path)
    for made in (pages(spark, folder), tiles(spark, folder)):
        above, below = plan(made).split("Exchange", 1)
        assert "date_format(" in above and "date_format(" not in below


def test_kept_entries_are_marked_where_they_are(spark):
    rows = [("u" if i % 3 else "v", i // 2, bytes([i % 251])) for i in range(5000)] + [(None, 1, b"n"), ("u", None, b"n")]
    entries = spark.createDataFrame(rows, "log_url string, index bigint, der binary").repartition(7).withColumn("_no", F.monotonically_increasing_id())
    entries = written(entries)
    kept = spark.createDataFrame([(u, i) for u in ("u", "v", None) for i in range(0, 2500, 7)] + [("u", 0), ("u", None)], "log_url string, index bigint")
    got = flow.standing(entries, kept, 5002)
    same = flow.standing(entries, kept, flow.MARKED + 1)
    listed = lambda df: sorted((r.log_url, r["index"], bytes(r.der)) for r in df.collect())
    assert got.columns == same.columns == ["log_url", "index", "der"]
    assert listed(got) == listed(same) != []
    # Only places and marks are shuffled.
    assert "der" not in "".join(x.split("output=")[-1] for x in plan(got).split("\n") if "Exchange hash" in x)
    assert listed(flow.standing(entries, kept.limit(0), 5002)) == []


def test_rows_of_key_time_and_order_are_shuffled_once(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", *map(str, range(40))]), rng.choice([None, *range(0, 4000, 7)]), rng.choice([None, "x", "y"]), rng.choice([None, 1, 2])) for _ in range(3000)]
    rows += rows[:200]
    df = spark.createDataFrame(rows, "k string, t bigint, log_url string, index bigint").withColumn("seen", F.timestamp_seconds("t")).drop("t")
    args = ["k"], "seen", "100 seconds", ["log_url", "index"]
    listed = lambda df: sorted(map(repr, df.select("k", "seen", "log_url", "index").collect()))
    once = windows.first_of_windows(df, *args)
    assert plan(once).count("Exchange hash") == 1
    assert listed(once) == listed(windows._picked(df, *args)) == listed(windows.first_of_windows(df, *args, many=60))


def test_publishing_drops_the_copies_of_both_kinds_of_log(spark, tmp_path):
    folder = small_tables(spark, tmp_path)
    out = flow.publish(pages(spark, folder), tiles(spark, folder), spark.createDataFrame([], "fp string, der binary"))
    # Every event stands in a page and in a tile; of tiles the first two records are skipped, of pages some last ones lie beyond what was asked for.
    assert sorted(r["index"] for r in out.certificates.select("index").collect()) == list(range(600))
    assert out.counts["entries"] - out.counts["duplicates"] == out.counts["kept"] == 600
    assert "_no" not in out.certificates.columns and out.certificates.schema["sha256"].dataType == T.StringType()


def test_windows_shuffle_hashes_of_their_keys(spark):
    rows = [(k, d, t, i) for i, (k, d, t) in enumerate([(None, "a", 0), ("a", None, 5), (None, None, 7), ("", "a", 9), (None, "a", 20), ("a", None, 200), ("b", "c", 3), ("b", "c", 3)])]
    df = spark.createDataFrame(rows, "k string, d string, t bigint, i bigint").withColumn("seen", F.timestamp_seconds("t")).drop("t")
    got = windows.anchored_window(df, ["k", "d"], "seen", "60 seconds", ["i"])
    assert {r.i: (r.is_first, r.anchor_ts.minute * 60 + r.anchor_ts.second) for r in got.collect()} == {
        0: (True, 0), 1: (True, 5), 2: (True, 7), 3: (True, 9), 4: (False, 0), 5: (True, 200), 6: (True, 3), 7: (False, 3)}
    assert "hashpartitioning(_k1" in plan(got).replace("Exchange ", "") and "hashpartitioning(coalesce(k" not in plan(got)


def test_counts_of_alerts_carry_no_findings(spark):
    df = spark.range(50).select(
        F.struct(F.lit("w").alias("id"), F.lit("W").alias("name"), F.lit("brand").alias("kind")).alias("watch"), F.format_string("n%d.test", F.col("id") % 7).alias("domain"),
        F.lit("u").alias("unicode"), F.lit(50).alias("score"), F.lit("high").alias("severity"), F.array(F.lit("keyword")).alias("reasons"), F.lit("said").alias("evidence"),
        F.timestamp_seconds(F.col("id") * 7200).alias("seen"), F.col("id").alias("seq"), F.struct(F.col("id").alias("cert_index")).alias("cert"))
    alerts = record_alerts(df, order=("seq",))
    assert "severity" not in plan(alerts.agg(F.sum("count")))
    first = {r["id"]: r for r in alerts.collect()}
    assert sum(r["count"] for r in first.values()) == 50
    assert all(r.cert.cert_index * 7200 == r.created_at.timestamp() and (r.evidence, r.score) == ("said", 50) for r in first.values())


def test_the_strongest_findings_alone_are_told(spark, tmp_path):
    folder = small_tables(spark, tmp_path)
    watch = watchlist(spark)
    names = cert_names(certs(spark, folder), *flow.KEY)
    names = names.unionByName(names.limit(20))
    got = strongest(names, watch, flow.KEY)
    want = best_per_certificate(detect(names, watch, (*flow.KEY, "pos")), flow.KEY).drop("pos", "watch_id")
    listed = lambda df: sorted(repr(r) for r in df.select(*want.columns).collect())
    assert sorted(got.columns) == sorted(want.columns)
    assert listed(got) == listed(want) != []
    # What is chosen among is names and scores; the rest is joined once.
    assert "max_by" not in plan(got) and "max_by" in plan(want)
    nothing = compile_watchlist(watchlist_frame(spark, []))
    assert strongest(names, nothing, flow.KEY).count() == 0
