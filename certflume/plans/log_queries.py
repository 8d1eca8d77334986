"""Log selection, positions and read plans, from the given tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..operators import logs as L, stats
from ..sources.heads import parse_checkpoints, parse_sth, trust_heads
from ..sources.loglist import narrow_logs, select_logs
from .catalogue import query
from .views import table

NOW = datetime(2024, 1, 15, tzinfo=timezone.utc)


def _listed(spark, folder):
    """Nations as operators, their suppliers as logs."""
    s = table(spark, folder, "supplier")
    state = F.when(F.col("s_suppkey") % 4 == 0, "retired").when(F.col("s_suppkey") % 4 == 1, "qualified").otherwise("usable")
    stamp = F.struct(F.lit("2023-01-01T00:00:00Z").alias("timestamp"))
    interval = F.when(F.col("s_suppkey") % 3 == 0, F.struct(
        F.concat((F.col("s_suppkey") % 7 + 2021).cast("string"), F.lit("-01-01T00:00:00Z")).alias("start_inclusive"),
        F.concat((F.col("s_suppkey") % 7 + 2022).cast("string"), F.lit("-01-01T00:00:00Z")).alias("end_exclusive")))
    url = F.concat(F.lit("https://log"), F.col("s_suppkey").cast("string"), F.lit(".example"))
    # Three suppliers share an id, so later places in the document lose.
    log = F.struct(F.col("s_name").alias("description"), F.floor(F.col("s_suppkey") / 3).cast("string").alias("log_id"), F.lit("k").alias("key"),
                   url.alias("url"), F.lit(None).cast("string").alias("submission_url"), F.concat(url, F.lit("/mon/")).alias("monitoring_url"),
                   F.lit(86400).alias("mmd"), F.create_map(state, stamp).alias("state"), interval.alias("temporal_interval"))
    none = F.filter(F.array(log), lambda x: F.lit(False))
    even = F.col("s_suppkey") % 2 == 0
    # One row per supplier, as an operator with one log, in key order by number.
    op = F.struct(F.concat(F.lit("Op "), F.col("s_nationkey").cast("string")).alias("name"),
                  F.when(even, F.array(log)).otherwise(none).alias("logs"), F.when(even, none).otherwise(F.array(log)).alias("tiled_logs"))
    rows = s.select(F.floor(F.col("s_suppkey") / 1000).alias("doc"), F.struct(F.col("s_suppkey"), op.alias("op")).alias("r"))
    return rows.groupBy("doc").agg(F.array_sort(F.collect_list("r"), lambda a, b: (a["s_suppkey"] - b["s_suppkey"]).cast("int")).alias("r")).select(
        F.transform("r", lambda x: x["op"]).alias("operators"))


_SELECTED = """l AS (SELECT *, s_suppkey // 3 AS log_id, CASE WHEN s_suppkey % 4 = 1 THEN 'qualified' ELSE 'usable' END AS state,
  'https://log' || CAST(s_suppkey AS VARCHAR) || CASE WHEN s_suppkey % 2 = 0 THEN '.example/' ELSE '.example/mon/' END AS url FROM supplier
  WHERE s_suppkey % 4 <> 0 AND (s_suppkey % 3 <> 0 OR (s_suppkey % 7 + 2022 > 2024 AND s_suppkey % 7 + 2021 <= 2025))),
f AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY s_suppkey) AS r FROM l)"""


@query("select_logs", f"""WITH {_SELECTED} SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'rfc6962' ELSE 'static' END AS kind, s_name AS name,
  'Op ' || CAST(s_nationkey AS VARCHAR) AS operator, url, state FROM f WHERE r = 1""")
def selected(spark, folder):
    return select_logs(_listed(spark, folder), NOW).select("kind", "name", "operator", "url", "state")


@query("narrow_logs", f"""WITH {_SELECTED} SELECT s_name AS name FROM f WHERE r = 1 AND (contains(url, '/mon/') OR regexp_matches(s_name, '2$')) AND NOT regexp_matches(s_name, '7$')""")
def narrowed(spark, folder):
    return narrow_logs(select_logs(_listed(spark, folder), NOW), "/MON/|2$", "7$").select("name")


def _heads(spark, folder):
    """Tree heads of customers' logs over their orders; sizes grow with the total price."""
    o = table(spark, folder, "orders")
    return o.select(F.concat(F.lit("https://c"), F.col("o_custkey").cast("string"), F.lit(".example/")).alias("log_url"),
                    (F.col("o_orderkey") * 7 + 3).alias("tree_size"), F.timestamp_seconds(F.col("o_orderkey") * 5).alias("ts"))


def _positions(spark, folder):
    """Two thirds of the customers have a saved position, the others none yet."""
    c = table(spark, folder, "customer")
    return c.select(
        F.concat(F.lit("https://c"), F.col("c_custkey").cast("string"), F.lit(".example/")).alias("log_url"),
        F.when(F.col("c_custkey") % 3 < 2, F.col("c_custkey") * 97).alias("next_index"))


_LAG_SQL = """h AS (SELECT o_custkey AS c, max(o_orderkey) * 7 + 3 AS tree_size FROM orders GROUP BY 1),
lagging AS (SELECT 'https://c' || CAST(h.c AS VARCHAR) || '.example/' AS log_url, tree_size, CASE WHEN k.c_custkey % 3 < 2 THEN k.c_custkey * 97 END AS next_index
  FROM h LEFT JOIN customer k ON k.c_custkey = h.c),
begun AS (SELECT *, CASE WHEN next_index IS NULL OR next_index > tree_size THEN greatest(0, tree_size - 600) ELSE next_index END AS b FROM lagging),
started AS (SELECT log_url, tree_size, CASE WHEN tree_size - b > 50000 THEN tree_size ELSE b END AS next_index,
  CASE WHEN tree_size - b > 50000 THEN tree_size - b ELSE 0 END AS skipped FROM begun)"""


def _started(spark, folder):
    return L.start_positions(L.lag(_heads(spark, folder), _positions(spark, folder)), backfill=600, max_lag=50000)


@query("lag", f"WITH {_LAG_SQL} SELECT log_url, tree_size, next_index, tree_size - next_index AS lag FROM lagging")
def lag(spark, folder):
    return L.lag(_heads(spark, folder), _positions(spark, folder))


@query("start_positions", f"WITH {_LAG_SQL} SELECT log_url, tree_size, next_index, skipped FROM started")
def started(spark, folder):
    return _started(spark, folder)


@query("plan_tiles", f"""WITH {_LAG_SQL}, t AS (SELECT log_url, tree_size, next_index, unnest(generate_series(next_index // 256, tree_size // 256)) AS n FROM started WHERE tree_size > next_index),
p AS (SELECT log_url, n, CAST(CASE WHEN n < tree_size // 256 THEN 256 ELSE tree_size % 256 END AS INTEGER) AS width, CAST(greatest(0, next_index - n * 256) AS INTEGER) AS skip FROM t)
SELECT * FROM p WHERE width > 0 AND skip < width""")
def tiles(spark, folder):
    return L.plan_tiles(_started(spark, folder), True).select("log_url", "n", "width", "skip")


@query("plan_pages", f"""WITH {_LAG_SQL}, t AS (SELECT log_url, tree_size, next_index, unnest(generate_series(next_index // 256, least((tree_size - 1) // 256, next_index // 256 + 3))) AS p FROM started WHERE tree_size > next_index)
SELECT log_url, greatest(next_index, p * 256) AS start, least((p + 1) * 256, tree_size) - 1 AS "end" FROM t""")
def pages(spark, folder):
    return L.plan_pages(_started(spark, folder))


@query("partial_due", """WITH h AS (SELECT o_custkey AS c, o_orderkey AS k, (o_orderkey * 7 + 3) // 256 AS tile, (o_orderkey * 7 + 3) % 256 AS tail FROM orders),
l AS (SELECT c, arg_max(tile, k) AS tile, arg_max(tail, k) AS tail, max(k) AS k FROM h GROUP BY c),
s AS (SELECT c, tile, min(k) AS since FROM h WHERE tail > 0 GROUP BY 1, 2)
SELECT 'https://c' || CAST(l.c AS VARCHAR) || '.example/' AS log_url, l.tile, tail > 0 AND coalesce((l.k - since) * 5 >= 15, false) AS due
FROM l LEFT JOIN s ON s.c = l.c AND s.tile = l.tile""")
def due(spark, folder):
    return L.partial_due(_heads(spark, folder))


@query("positions", """SELECT event_type AS log_url, max(event_id) + 1 AS next_index FROM events GROUP BY 1""")
def positions(spark, folder):
    return L.positions(table(spark, folder, "events").select(F.col("event_type").alias("log_url"), F.col("event_id").alias("index")))


# Tiles of every log in two attempts; of those rejected at first some are accepted later, others are read in part.
_RETRY_SQL = """read AS (SELECT event_type AS log_url, event_id AS i, event_id // 256 AS n FROM events WHERE NOT (event_id // 256 % 7 = 3 AND event_id // 256 % 2 = 0)
  AND NOT (event_id // 256 % 11 = 5 AND event_id % 256 > 100)),
bad AS (SELECT DISTINCT event_type AS log_url, event_id // 256 AS n FROM events WHERE event_id // 256 % 7 = 3 OR event_id // 256 % 11 = 5)"""


def _retried(spark, folder):
    rows = table(spark, folder, "events").select(F.col("event_type").alias("log_url"), F.col("event_id").alias("index"), F.floor(F.col("event_id") / 256).alias("n"))
    rejected = rows.filter("n % 7 = 3 OR n % 11 = 5").select("log_url", "n").distinct()
    return rows.filter("NOT (n % 7 = 3 AND n % 2 = 0) AND NOT (n % 11 = 5 AND index % 256 > 100)").drop("n"), rejected


# Every index below the position is in a tile of which something was read, and which is whole or was never rejected.
@query("positions_after_retry", f"""WITH {_RETRY_SQL},
t AS (SELECT coalesce(r.log_url, b.log_url) AS log_url, coalesce(r.n, b.n) AS n, upto, b.n IS NOT NULL AND coalesce(upto, 0) < (coalesce(r.n, b.n) + 1) * 256 AS cut
  FROM (SELECT log_url, n, max(i) + 1 AS upto FROM read GROUP BY 1, 2) r FULL JOIN bad b ON b.log_url = r.log_url AND b.n = r.n),
o AS (SELECT *, CASE WHEN cut THEN coalesce(upto, n * 256) ELSE (n + 1) * 256 END AS stop, lead(n) OVER w AS next, lead(upto) OVER w AS next_upto,
  max(upto) OVER (PARTITION BY log_url) AS last FROM t WINDOW w AS (PARTITION BY log_url ORDER BY n))
SELECT log_url, least(max(last), min(stop)) AS next_index FROM o WHERE cut OR next IS NULL OR next <> n + 1 GROUP BY log_url""")
def after_retry(spark, folder):
    return L.positions(*_retried(spark, folder))


# Logs that stopped in the middle and went on further up: at the jump that was declared, or not.
@query("positions_after_jump", """WITH read AS (SELECT event_type AS log_url, event_id AS i, max(event_id) OVER (PARTITION BY event_type) AS top FROM events),
two AS (SELECT log_url, i, top FROM read WHERE i < top // 3 OR i >= 2 * (top // 3)),
t AS (SELECT DISTINCT log_url, i // 256 AS n FROM two),
o AS (SELECT *, lead(n) OVER (PARTITION BY log_url ORDER BY n) AS next FROM t),
j AS (SELECT DISTINCT log_url, top // 3 - 10 AS a, 2 * (top // 3) AS b FROM two WHERE log_url <> 'error'),
g AS (SELECT o.log_url, min((n + 1) * 256) AS gap FROM o LEFT JOIN j ON j.log_url = o.log_url AND (n + 1) * 256 >= a AND (n + 1) * 256 < b
  WHERE (next IS NULL OR next <> n + 1) AND j.log_url IS NULL GROUP BY 1),
m AS (SELECT log_url, max(i) + 1 AS last FROM two GROUP BY 1)
SELECT m.log_url, least(last, gap) AS next_index FROM m LEFT JOIN g ON g.log_url = m.log_url""")
def after_jump(spark, folder):
    rows = table(spark, folder, "events").select(F.col("event_type").alias("log_url"), F.col("event_id").alias("index"))
    third = F.floor(F.col("top") / 3)
    tops = rows.groupBy("log_url").agg(F.max("index").alias("top"))
    two = rows.join(tops, "log_url").filter((F.col("index") < third) | (F.col("index") >= 2 * third)).drop("top")
    jumps = tops.filter("log_url <> 'error'").select("log_url", (third - 10).alias("from"), (2 * third).alias("to"))
    return L.positions(two, jumps=jumps)


@query("parse_tree_heads", """SELECT o_orderkey, o_custkey AS tree_size, o_orderkey * 1000 AS timestamp, 32 AS root_bytes, '' AS error FROM orders
UNION ALL SELECT -o_orderkey - 1, NULL, NULL, NULL, 'a tree head without tree_size' FROM orders""")
def sth(spark, folder):
    o = table(spark, folder, "orders")
    good = F.to_json(F.struct(F.col("o_custkey").alias("tree_size"), (F.col("o_orderkey") * 1000).alias("timestamp"),
                              F.base64(F.unhex(F.sha2(F.col("o_orderkey").cast("string"), 256))).alias("sha256_root_hash"), F.lit("BAMA").alias("tree_head_signature")))
    raw = o.select("o_orderkey", good.alias("value")).unionByName(o.select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit('{"error":1}').alias("value")))
    return parse_sth(raw).select("o_orderkey", "tree_size", "timestamp", F.octet_length("root_hash").alias("root_bytes"), F.coalesce("error", F.lit("")).alias("error"))


@query("parse_checkpoints", """SELECT o_orderkey, 'log.example/' || CAST(o_custkey AS VARCHAR) AS origin, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey END AS tree_size,
  'log.example/' || CAST(o_custkey AS VARCHAR) || ' x' AS signer, CASE WHEN o_orderkey % 5 = 0 THEN 'the checkpoint''s first lines cannot be read' ELSE '' END AS error FROM orders""")
def checkpoints(spark, folder):
    o = table(spark, folder, "orders")
    origin = F.concat(F.lit("log.example/"), F.col("o_custkey").cast("string"))
    size = F.when(F.col("o_orderkey") % 5 == 0, "none").otherwise(F.col("o_orderkey").cast("string"))
    text = F.concat(origin, F.lit("\n"), size, F.lit("\n"), F.base64(F.unhex(F.sha2(origin, 256))), F.lit("\nmore\n\n— "), origin, F.lit(" x QUJD\n"))
    read = parse_checkpoints(o.select("o_orderkey", text.alias("value")))
    return read.select("o_orderkey", "origin", "tree_size", F.col("signatures")[0]["name"].alias("signer"), F.coalesce("error", F.lit("")).alias("error"))


@query("trust_heads", """SELECT 'enforce' AS mode, o_orderstatus AS log_url, count(*) FILTER (o_orderkey % 3 > 0) AS used, count(*) FILTER (o_orderkey % 3 = 0) AS failures FROM orders GROUP BY 2
UNION ALL SELECT 'warn', o_orderstatus, count(*), count(*) FILTER (o_orderkey % 3 = 0) FROM orders GROUP BY 2""")
def trusted(spark, folder):
    heads = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("log_url"), (F.col("o_orderkey") % 3 > 0).alias("signature_ok"))
    parts = []
    for mode in ("enforce", "warn"):
        used, failures = trust_heads(heads, mode)
        parts.append(used.groupBy("log_url").agg(F.count(F.lit(1)).alias("used")).join(failures, "log_url", "left").select(
            F.lit(mode).alias("mode"), "log_url", "used", F.coalesce("signature_failures", F.lit(0)).alias("failures")))
    return parts[0].unionByName(parts[1])


@query("order_logs", f"""WITH {_LAG_SQL}, s AS (SELECT log_url, lag, CASE WHEN lag IS NULL THEN 'starting' WHEN lag % 2 = 0 THEN 'ok' ELSE 'backoff' END AS state FROM (SELECT log_url, tree_size - next_index AS lag FROM lagging) x)
SELECT log_url, lag, state, dense_rank() OVER (ORDER BY CASE state WHEN 'backoff' THEN 1 WHEN 'starting' THEN 2 ELSE 3 END, coalesce(lag, 0) DESC) AS place FROM s""")
def ordered(spark, folder):
    state = F.when(F.col("lag").isNull(), "starting").when(F.col("lag") % 2 == 0, "ok").otherwise("backoff")
    listed = stats.order_logs(L.lag(_heads(spark, folder), _positions(spark, folder)).withColumn("state", state)).select("log_url", "lag", "state")
    # The order that the rows came in, written down: logs that are alike share a place.
    rows = listed.collect()  # a row for each log that is read
    places, placed = {}, []
    for r in rows:
        placed.append((r.log_url, r.lag, r.state, places.setdefault((r.state, r.lag or 0), len(places) + 1)))
    return spark.createDataFrame(placed, "log_url string, lag bigint, state string, place bigint")
