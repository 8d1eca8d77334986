"""Positions, heads, chains, damaged input, event logs and late triage: what must hold outside the queries' own tables."""

import pandas as pd
from pyspark.sql import functions as F

from certflume.functions.der import LeafError, cert_list, leaf_index, outline, seconds, tile_records
from certflume.operators.alerts import alert_id, alert_state, list_alerts, record_alerts
from certflume.operators.certificates import resolve_chains
from certflume.operators.logs import declared_jumps, positions, start_positions
from certflume.operators.search import search
from certflume.sources.entries import decode_rfc6962, read_tiles, union_entries, with_plan
from certflume.sources.files import read_alert_events
from certflume.sources.heads import verify_heads
from certflume.streaming import state

HOUR = 3_600_000_000


def test_positions_stop_at_holes_and_rejected_tiles(spark):
    entries = spark.createDataFrame([("gap", i) for i in (0, 255, 512)] + [("whole", i) for i in (5, 300)] + [("bad", 10), ("bad", 800)], "log_url string, index bigint")
    rejected = spark.createDataFrame([("bad", 2), ("bad", 1), ("never", 7)], "log_url string, n bigint")
    got = {r.log_url: r.next_index for r in positions(entries, rejected).collect()}
    assert got == {"gap": 256, "whole": 301, "bad": 256, "never": 7 * 256}


def test_positions_go_on_after_retries_and_declared_jumps(spark):
    rows = [("retried", i) for i in range(768)] + [("part", i) for i in range(300)] + [("jump", i) for i in [*range(300), *range(10_000, 10_300)]] + [("leap", i) for i in range(20)]
    entries = spark.createDataFrame(rows, "log_url string, index bigint")
    rejected = spark.createDataFrame([("retried", 1), ("part", 1)], "log_url string, n bigint")
    jumps = spark.createDataFrame([("jump", 300, 5_000), ("jump", 4_000, 10_000), ("leap", 10, 900), ("only", 0, 77), ("only", 0, 0)], "log_url string, `from` bigint, `to` bigint")
    got = {r.log_url: r.next_index for r in positions(entries, rejected, jumps).collect()}
    assert got == {"retried": 768, "part": 300, "jump": 10_300, "leap": 900, "only": 77}
    assert {r.log_url: r.next_index for r in positions(entries, rejected).collect()}["jump"] == 512
    started = spark.createDataFrame([("a", 900, 900, 100), ("b", 5, 5, 0)], "log_url string, tree_size bigint, next_index bigint, skipped bigint")
    assert [tuple(r) for r in declared_jumps(started).collect()] == [("a", 800, 900)]


def test_marks_of_one_instant_follow_their_numbers(spark):
    """The later of two marks at one instant decides, in the state, in what stays quiet and in the stream."""
    day = 86_400
    rows = [(("w", "W", "brand"), d, 70, "medium", i, t) for d in ("x", "y") for i, t in enumerate((0, 2 * day))]
    findings = spark.createDataFrame(rows, "watch struct<id:string,name:string,kind:string>, domain string, score int, severity string, seq bigint, t bigint").withColumn("seen", F.timestamp_seconds("t"))
    first = {d: spark.range(1).select(alert_id(F.lit("w"), F.lit(d), F.lit(0).cast("bigint"))).first()[0] for d in ("x", "y")}
    marks = [(first["x"], 100, "false_positive", None, 1), (first["x"], 100, "resolved", "done", 2), (first["y"], 100, "resolved", "a", 1), (first["y"], 100, "false_positive", None, 2)]
    for order in (marks, marks[::-1]):
        triage = spark.createDataFrame(order, "id string, at_s bigint, status string, note string, seq bigint").withColumn("at", F.timestamp_seconds("at_s"))
        got = sorted((r.domain, r["count"], r.status, r.note) for r in record_alerts(findings, triage, order=("seq",)).collect())
        assert got == [("x", 1, "new", ""), ("x", 1, "resolved", "done"), ("y", 2, "false_positive", "a")]


def test_nothing_is_skipped_unless_asked(spark):
    lagging = spark.createDataFrame([("a", 900_000, 1)], "log_url string, tree_size bigint, next_index bigint")
    assert tuple(start_positions(lagging).first()) == ("a", 900_000, 1, 0)
    assert tuple(start_positions(lagging, max_lag=1000).first()) == ("a", 900_000, 900_000, 899_999)


def test_all_alerts_are_listed_unless_asked(spark):
    alerts = spark.range(450).select(F.concat(F.lit("a_"), "id").alias("id"), F.timestamp_seconds("id").alias("created_at"), F.lit("new").alias("status"), F.lit("high").alias("severity"))
    assert list_alerts(alerts).count() == 450
    assert [r.id for r in list_alerts(alerts, "new", "medium", limit=2).collect()] == ["a_449", "a_448"]


def test_equal_heads_stay_apart(spark):
    head = ("http://l/", "o", 5, b"x" * 32, [], [], None, "static")
    heads = spark.createDataFrame([head] * 3, "log_url string, origin string, tree_size bigint, root_hash binary, extensions array<string>, signatures array<struct<name:string,sig:binary>>, error string, kind string")
    assert verify_heads(heads, spark.createDataFrame([("http://l/", None)], "url string, key string")).count() == 3


def test_brought_and_fetched_chains_live_together(spark):
    pages = spark.createDataFrame([(1, [b"own"])], "index int, chain array<binary>")
    tiles = spark.createDataFrame([(2, ["f", "g"]), (3, [])], "index int, chain_fps array<string>")
    got = resolve_chains(union_entries(pages, tiles), spark.createDataFrame([("f", b"F")], "fp string, der binary"))
    assert {r["index"]: [bytes(c) for c in r.chain] for r in got.collect()} == {1: [b"own"], 2: [b"F"], 3: []}


def test_odd_dates_and_broken_certificates_are_errors_of_their_own():
    assert seconds(0x18, b"99991301000000Z") == 253402300800
    assert seconds(0x18, b"20240229120000Z") == 1709208000
    assert seconds(0x18, b"00000101000000Z") < 0
    assert outline(b"0")["error"] and outline(b"")["error"]


def record(kind: int, extensions: bytes = b"", chain: bytes = b"") -> bytes:
    sized = lambda n, b: len(b).to_bytes(n) + b
    head = (7).to_bytes(8) + kind.to_bytes(2) + (b"h" * 32 if kind else b"") + sized(3, b"signed") + sized(2, extensions)
    return head + (sized(3, b"precert") if kind else b"") + sized(2, chain)


def test_tile_records_by_offsets():
    number = b"\x00\x00\x05" + (42).to_bytes(5)
    rows = tile_records(record(0, number, b"a" * 32) + record(1, b"\x07\x00\x01z" + number))
    assert [(r["entry_type"], r["der"], r["leaf_index"], r["chain_fps"]) for r in rows] == [(0, b"signed", 42, [(b"a" * 32).hex()]), (1, b"precert", 42, [])]
    whole = record(1, number, b"c" * 64)
    for cut in range(1, len(whole)):
        try:
            tile_records(whole[:cut])
            raise AssertionError(cut)
        except LeafError:
            pass
    assert cert_list(b"\x00\x00\x08\x00\x00\x01A\x00\x00\x01B") == [b"A", b"B"]
    assert leaf_index(b"") is None


def test_cut_precertificate_leaves_are_told(spark):
    leaf = b"\x00\x00" + (1).to_bytes(8) + b"\x00\x01" + b"h" * 32 + b"\x00\x00\x03tbs" + b"\x00\x00"
    rows = [(n, leaf[:n], b"\x00\x00\x01D") for n in (12, 30, 46, len(leaf) - 1, len(leaf))]
    df = spark.createDataFrame(rows, "index bigint, leaf binary, extra binary").withColumns({"log_url": F.lit("u"), "log_name": F.lit("n"), "link": F.lit("l")})
    assert {r["index"]: r.error for r in decode_rfc6962(df).collect()} == {**{n: "the entry is cut off" for n, _, _ in rows[:-1]}, len(leaf): None}


def test_tiles_find_their_log_and_plan(spark, tmp_path):
    for log in ("one", "two"):
        place = tmp_path / log / "tile" / "data" / "x001"
        place.mkdir(parents=True)
        (place / "002").write_bytes(b"x")
    places = spark.createDataFrame([(str(tmp_path / "one"), "https://log.one/", "One")], "folder string, log_url string, log_name string")
    tiles = read_tiles(spark, str(tmp_path), places=places)
    plan = spark.createDataFrame([("https://log.one/", 1002, 256, 9)], "log_url string, n bigint, width int, skip int")
    assert [(r.log_url, r.log_name, r.n, r.skip) for r in with_plan(tiles, plan).collect()] == [("https://log.one/", "One", 1002, 9)]


def test_every_name_is_searched(spark):
    names = [f"n{i}.test" for i in range(80)]
    df = spark.createDataFrame([(names, 1), (["other.test"], 2)], "all_domains array<string>, index int").select(
        F.struct("all_domains", F.struct(F.lit("Org").alias("O"), F.lit("CA").alias("CN")).alias("issuer")).alias("parsed"), "index",
        F.timestamp_seconds(F.col("index")).alias("seen"), F.lit(0).alias("entry_type"))
    assert [r["index"] for r in search(df, "n70.test").collect()] == [1]
    assert search(df, "n70.test", names=50).count() == 0
    assert [r["index"] for r in search(df, keep=1).collect()] == [2]


def test_event_logs_are_numbered_by_file_and_place(spark, tmp_path):
    alert = '{"seq": 5, "type": "alert", "alert": {"id": "a", "created_at": "2024-01-01T00:00:00Z", "count": 3, "status": "new"}}'
    (tmp_path / "0.json").write_text(alert + "\n" + '{"type": "repeat", "id": "a", "at": "2024-01-01T01:00:00Z"}\n' * 40)
    (tmp_path / "1.json").write_text('{"type": "status", "id": "a", "at": "2024-01-02T00:00:00Z", "status": "resolved"}\n')
    events = read_alert_events(spark, str(tmp_path))
    rows = events.orderBy("seq").select("type").collect()
    assert [r.type for r in rows] == ["alert"] + ["repeat"] * 40 + ["status"]
    state_ = alert_state(events).first()
    assert (state_["count"], state_.status) == (43, "resolved")


class _Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class _Handle:
    def __init__(self):
        self.value, self.timers = _Value(), []

    def getValueState(self, name, schema):  # noqa: N802
        return self.value

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def deleteTimer(self, timer):  # noqa: N802
        self.timers.remove(timer)

    def registerTimer(self, timer):  # noqa: N802
        self.timers.append(timer)


def test_late_triage_silences_the_key():
    def kinds(horizon):
        handle, recorder, out = _Handle(), state._Recorder(24 * HOUR, horizon), []
        recorder.init(handle)
        for hour, finding, status in [(0, 1, None), (96, 0, "false_positive"), (144, 1, None)]:
            for timer in list(handle.timers):
                if timer < hour * 3_600_000:
                    handle.timers.remove(timer)
                    list(recorder.handleExpiredTimer(None, None, None))
            row = {"watch_id": "w", "domain": "d", "seen": pd.Timestamp(0), "seq": 0, "body": "", "is_finding": finding, "status": status, "target_us": 0, "at_us": hour * HOUR}
            out += [t for part in recorder.handleInputRows(None, iter([pd.DataFrame([row])]), None) for t in part["type"]]
        return out

    assert kinds(None) == ["alert", "status", "repeat"]
    assert kinds(24 * HOUR) == ["alert", "status", "alert"]

