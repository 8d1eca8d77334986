"""Decoders on damaged bytes, and tree head signatures."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from certflume.functions.der import LeafError, leaf_index, outline, tile_records
from certflume.operators.certificates import parse_certificates
from certflume.operators.logs import plan_tiles
from certflume.sources import heads as H
from certflume.sources.files import read_alert_events, read_watchlist
from certflume.sources.loglist import custom_logs


def _signed(data: bytes, secret: int) -> bytes:
    k = 0x1234567
    r = H.point_times(k, H._G)[0] % H._N
    s = pow(k, -1, H._N) * (int.from_bytes(hashlib.sha256(data).digest()) + r * secret) % H._N

    def number(n):
        raw = n.to_bytes(33).lstrip(b"\0")
        raw = b"\0" + raw if raw[0] & 128 else raw
        return b"\x02" + bytes([len(raw)]) + raw

    body = number(r) + number(s)
    sig = b"\x30" + bytes([len(body)]) + body
    return b"\x04\x03" + len(sig).to_bytes(2) + sig


def _key(secret: int) -> bytes:
    x, y = H.point_times(secret, H._G)
    return H._EC_HEAD + x.to_bytes(32) + y.to_bytes(32)


def test_tree_heads_verify_and_notice_tampering(spark):
    key, other = _key(77), _key(78)
    root = hashlib.sha256(b"root").digest()
    data = b"\0\1" + (1700000000000).to_bytes(8) + (500).to_bytes(8) + root
    sth = {"tree_size": 500, "timestamp": 1700000000000, "sha256_root_hash": base64.b64encode(root).decode(),
           "tree_head_signature": base64.b64encode(_signed(data, 77)).decode()}
    rows = [("https://a/", json.dumps(sth)), ("https://b/", json.dumps(sth | {"tree_size": 501})), ("https://c/", json.dumps(sth)), ("https://d/", json.dumps(sth))]
    logs = spark.createDataFrame([("https://a/", base64.b64encode(key).decode()), ("https://b/", base64.b64encode(key).decode()),
                                  ("https://c/", base64.b64encode(other).decode()), ("https://d/", None)], "url string, key string")
    read = H.parse_sth(spark.createDataFrame(rows, "log_url string, value string"))
    assert {r.log_url[8]: r.signature_ok for r in H.verify_heads(read, logs).collect()} == {"a": True, "b": False, "c": False, "d": None}

    origin = "log.example/x"
    key_id = hashlib.sha256(origin.encode() + b"\n\x05" + hashlib.sha256(key).digest()).digest()[:4]
    line = base64.b64encode(key_id + (1700000000000).to_bytes(8) + _signed(data, 77)).decode()
    text = f"{origin}\n500\n{base64.b64encode(root).decode()}\n\n— other.example AAAA\n— {origin} {line}\n"
    rows = [("https://a/", text), ("https://b/", text.replace("\n500\n", "\n501\n"))]
    read = H.parse_checkpoints(spark.createDataFrame(rows, "log_url string, value string"))
    assert {r.log_url[8]: (r.signature_ok, r.timestamp) for r in H.verify_heads(read, logs).collect()} == {
        "a": (True, 1700000000000), "b": (False, None)}


def test_damaged_bytes_are_errors():
    for bad in (b"", b"\x30\x00", b"\x30\x82\x01", b"\x30\x85\x01\x01\x01\x01\x01"):
        assert outline(bad)["error"]
    with pytest.raises(LeafError):
        tile_records(b"\0" * 20)
    assert leaf_index(bytes.fromhex("000005003999d800")) == 0x3999D800 and leaf_index(b"") is None


def test_unreadable_certificates_keep_their_error(spark):
    rows = parse_certificates(spark.createDataFrame([(bytearray(b"\x30\x00"),), (None,)], "der binary")).collect()
    assert all(r.parsed is None and r.error for r in rows)


def test_tile_plans(spark):
    df = spark.createDataFrame([("https://a/", 70000, 0), ("https://b/", 70000, 69900), ("https://c/", 512, 266), ("https://d/", 500, 500)],
                               "log_url string, tree_size bigint, next_index bigint")
    plan = plan_tiles(df, True).collect()
    assert [len([r for r in plan if r.log_url == f"https://{c}/"]) for c in "abcd"] == [274, 1, 1, 0]
    assert [(r.n, r.width, r.skip) for r in plan if r.log_url == "https://b/"] == [(273, 112, 12)]
    assert [(r.n, r.skip, r.url) for r in plan if r.log_url == "https://c/"] == [(1, 10, "https://c/tile/data/001")]


def test_files(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"items": [{"name": "A", "domains": ["a.test"], "keywords": "one, two"}]}))
    row = read_watchlist(spark, str(tmp_path / "w.json")).first()
    assert (row.domains, row.keywords) == (["a.test"], ["one", "two"])
    (tmp_path / "e.jsonl").write_text('{"type":"repeat","id":"a1","at":"2024-01-01T00:00:00Z"}\n\n{"type":"rep')
    assert [r.id for r in read_alert_events(spark, str(tmp_path / "e.jsonl")).collect()] == ["a1"]
    kinds = {r.kind: r.url for r in custom_logs(spark, ["static:https://log.example/2026", "https://ct.example/log/"]).collect()}
    assert kinds == {"static": "https://log.example/2026/", "rfc6962": "https://ct.example/log/"}
    with pytest.raises(Exception, match="http"):
        custom_logs(spark, ["static:ftp://nope"]).collect()


def test_sql_names(spark):
    from certflume.sources.entries import tile_rows
    from certflume.sources.sql import register

    register(spark)
    good = (7).to_bytes(8) + b"\x00\x00" + (3).to_bytes(3) + b"der" + b"\x00\x00" + b"\x00\x00"
    rows = [("l", 3, 2, 0, good * 2), ("l", 4, 2, 1, good * 2), ("l", 5, 3, 0, good), ("l", 6, 1, 0, good[:-3]), ("l", 7, 0, 0, b""), ("l", 8, 1, 0, None)]
    tiles = spark.createDataFrame(rows, "log_url string, n bigint, width int, skip int, content binary")
    tiles.createOrReplaceTempView("some_tiles")
    names = ["log_url", "index", "timestamp", "entry_type", "der", "chain_fps", "n", "error"]
    by_sql = spark.sql("SELECT * FROM decode_tile(TABLE(SELECT * FROM some_tiles))").select(*names)
    assert sorted(map(repr, by_sql.collect())) == sorted(map(repr, tile_rows(tiles).filter("error IS NOT NULL OR index IS NOT NULL").select(*names).collect()))
    assert tuple(spark.sql("SELECT shown_domain('xn--mgbh0fb.example') AS a, fold_text('brötchén') AS b").first()) == ("مثال.example", "brotchen")


def test_csv_files_have_header_and_line_ends(spark, tmp_path):
    from certflume.operators.alerts import write_alerts_csv

    alerts = spark.createDataFrame([("a_1", 0, 2, "new", "", "high", 90, ["x"], "d.test", "=1+1")], "id string, t bigint, count bigint, status string, note string, severity string, score int, reasons array<string>, domain string, w string").select(
        "*", F.timestamp_seconds("t").alias("created_at"), F.timestamp_seconds("t").alias("last_seen"), F.lit(None).cast("string").alias("unicode"), F.struct(F.col("w").alias("name")).alias("watch"),
        F.struct(F.lit('Org "A"').alias("issuer"), F.lit("log").alias("log"), F.lit(1).alias("cert_index")).alias("cert"))
    write_alerts_csv(alerts.coalesce(1), str(tmp_path / "csv"))
    text = b"".join(p.read_bytes() for p in (tmp_path / "csv").glob("*.csv")).decode()
    assert text.splitlines(keepends=True)[0] == "created_at,last_seen,count,status,severity,score,domain,unicode,watch,reasons,issuer,log,cert_index,note\r\n"
    assert "'=1+1" in text and '"Org ""A"""' in text and text.count("\r\n") == 2
