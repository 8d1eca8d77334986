"""Copies, alerts and their log, over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators.windows import anchored_window, drop_copies
from .catalogue import query
from .views import FINDINGS_SQL, certs, findings, table


def anchored_sql(source: str, key: str, ts: str, minutes: int) -> str:
    """Windows of a key by walking its events in order."""
    return f"""ord AS (SELECT {key} AS k, epoch_us({ts}) AS us, row_number() OVER (PARTITION BY {key} ORDER BY {ts}, event_id) AS rn, event_id FROM {source}),
walk AS (SELECT k, rn, us, event_id, us AS anchor, true AS is_first FROM ord WHERE rn = 1
  UNION ALL SELECT o.k, o.rn, o.us, o.event_id, CASE WHEN o.us - w.anchor < {minutes}::BIGINT * 60000000 THEN w.anchor ELSE o.us END,
    o.us - w.anchor >= {minutes}::BIGINT * 60000000 FROM walk w JOIN ord o ON o.k = w.k AND o.rn = w.rn + 1)"""


@query("anchored_window", f"""WITH RECURSIVE {anchored_sql('events', 'user_id', 'ts', 720)}
SELECT event_id, anchor AS anchor_us, is_first FROM walk""")
def window(spark, folder):
    rows = anchored_window(table(spark, folder, "events"), ["user_id"], "ts", "12 hours", ["event_id"])
    return rows.select("event_id", F.unix_micros("anchor_ts").alias("anchor_us"), "is_first")


@query("drop_copies", f"""WITH RECURSIVE {anchored_sql('events', 'user_id', 'ts', 15)}
SELECT event_id AS "index" FROM walk WHERE is_first""")
def copies(spark, folder):
    return drop_copies(certs(spark, folder)).select("index")


_KEYED_SQL = FINDINGS_SQL + """,
keyed AS (SELECT *, watch_id || '|' || domain AS key FROM findings)"""
_ID = "'a_' || substr(sha256(k || '|' || CAST(anchor AS VARCHAR)), 1, 16)"


@query("record_alerts", f"""WITH RECURSIVE {_KEYED_SQL}, {anchored_sql('keyed', 'key', 'seen', 1440)}
SELECT {_ID} AS id, k AS key, anchor AS created_us, count(*) AS count, max(us) AS last_us, 'new' AS status FROM walk GROUP BY k, anchor""")
def record(spark, folder):
    rows = A.record_alerts(findings(spark, folder), order=("event_id",))
    return rows.select("id", F.concat_ws("|", "watch.id", "domain").alias("key"), F.unix_micros("created_at").alias("created_us"),
                       "count", F.unix_micros("last_seen").alias("last_us"), "status")


def _triage(spark, folder):
    """A third of the first alerts turn out to be false positives; half of those are lifted later."""
    first = A.record_alerts(findings(spark, folder), order=("event_id",)).select("id", "created_at")
    third = F.unix_micros("created_at") % 3 == 0
    marked = first.filter(third).select("id", (F.col("created_at") + F.expr("interval 1 hour")).alias("at"),
                                        F.lit("false_positive").alias("status"), F.lit("seen before").alias("note"))
    lifted = first.filter(third & (F.unix_micros("created_at") % 2 == 0)).select(
        "id", (F.col("created_at") + F.expr("interval 90 hours")).alias("at"), F.lit("resolved").alias("status"),
        F.lit(None).cast("string").alias("note"))
    return marked.unionByName(lifted)


_HOUR = "3600000000::BIGINT"
# ``known`` tells whether the open window starts where a first alert did, as
# only those were marked.
_SILENCED_SQL = f"""ord2 AS (SELECT k, rn, us, is_first FROM walk),
walk2 AS (SELECT k, rn, us, us AS anchor, is_first AS known FROM ord2 WHERE rn = 1
  UNION ALL SELECT k, rn, us, CASE WHEN quiet THEN anchor ELSE us END, CASE WHEN quiet THEN known ELSE is_first END FROM (
    SELECT o.k, o.rn, o.us, o.is_first, w.anchor, w.known, o.us - w.anchor < 24 * {_HOUR} OR (w.known AND w.anchor % 3 = 0
      AND o.us >= w.anchor + {_HOUR} AND (w.anchor % 2 <> 0 OR o.us < w.anchor + 90 * {_HOUR})) AS quiet
    FROM walk2 w JOIN ord2 o ON o.k = w.k AND o.rn = w.rn + 1) q)"""


@query("record_alerts_triaged", f"""WITH RECURSIVE {_KEYED_SQL}, {anchored_sql('keyed', 'key', 'seen', 1440)}, {_SILENCED_SQL},
first AS (SELECT DISTINCT k, anchor FROM walk)
SELECT {_ID.replace('k ||', 'w.k ||').replace('anchor', 'w.anchor')} AS id, count(*) AS count,
  CASE WHEN f.anchor IS NULL OR f.anchor % 3 <> 0 THEN 'new' WHEN f.anchor % 2 = 0 THEN 'resolved' ELSE 'false_positive' END AS status,
  CASE WHEN f.anchor IS NULL OR f.anchor % 3 <> 0 THEN '' ELSE 'seen before' END AS note
FROM walk2 w LEFT JOIN first f ON f.k = w.k AND f.anchor = w.anchor GROUP BY w.k, w.anchor, f.anchor""")
def triaged(spark, folder):
    valid, _ = A.triage_events(_triage(spark, folder))
    return A.record_alerts(findings(spark, folder), valid, order=("event_id",)).select("id", "count", "status", "note")


@query("alerts_tied_triage", f"""WITH RECURSIVE {_KEYED_SQL}, {anchored_sql('keyed', 'key', 'seen', 1440)},
silent AS (SELECT k, rn, us, us AS anchor FROM ord WHERE rn = 1
  UNION ALL SELECT o.k, o.rn, o.us, CASE WHEN o.us - w.anchor < 24 * {_HOUR} OR (w.anchor % 2 = 0 AND o.us >= w.anchor + {_HOUR}) THEN w.anchor ELSE o.us END
  FROM silent w JOIN ord o ON o.k = w.k AND o.rn = w.rn + 1)
SELECT {_ID} AS id, count(*) AS count, CASE WHEN anchor % 2 = 0 THEN 'false_positive' ELSE 'resolved' END AS status,
  CASE WHEN anchor % 2 = 0 THEN 'first' ELSE 'second' END AS note FROM silent GROUP BY k, anchor""")
def tied(spark, folder):
    """Every alert gets both marks an hour after it opened; which of them is the second follows from its start."""
    rows = findings(spark, folder)
    opened = rows.select(F.col("watch.id").alias("w"), "domain", "seen").distinct()
    even = F.unix_micros("seen") % 2 == 0
    marks = F.array(*[F.struct(F.lit(s).alias("status"), F.when(even if s == "resolved" else ~even, 1).otherwise(2).alias("seq")) for s in ("resolved", "false_positive")])
    triage = opened.select(A.alert_id(F.col("w"), F.col("domain"), F.unix_micros("seen")).alias("id"), (F.col("seen") + F.expr("interval 1 hour")).alias("at"), F.inline(marks))
    # Only resolved ones say something.
    noted = triage.withColumn("note", F.when(F.col("status") == "resolved", F.when(F.col("seq") == 1, "first").otherwise("second")))
    return A.record_alerts(rows, noted, order=("event_id",)).select("id", "count", "status", "note")


def _events(spark, folder):
    """An event log per user: the sign-up is the alert, later events change it."""
    events = table(spark, folder, "events")
    kind = F.when(F.col("event_type") == "signup", "alert").when(F.col("event_type") == "view", "repeat").when(
        F.col("event_type") == "click", "dns").otherwise("status")
    status = F.element_at(F.array(*[F.lit(s) for s in ("new", "acknowledged", "resolved", "false_positive")]), (F.col("event_id") % 4 + 1).cast("int"))
    ident = F.concat(F.lit("a"), F.col("user_id").cast("string"))
    domain = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".test"))
    score = (F.col("event_id") % 61 + 40).cast("int")
    from ..functions.names import severity_of

    alert = F.struct(
        ident.alias("id"), F.col("ts").alias("created_at"), F.col("ts").alias("last_seen"), F.col("ts").alias("updated_at"),
        F.lit(1).cast("bigint").alias("count"), F.lit("new").alias("status"), F.lit("").alias("note"), severity_of(score).alias("severity"),
        score.alias("score"), F.array(F.lit("keyword"), F.lit("lure-word")).alias("reasons"), domain.alias("domain"),
        F.lit(None).cast("string").alias("unicode"), F.struct(F.lit("w").alias("id"), F.lit('A, "B"').alias("name"), F.lit("brand").alias("kind")).alias("watch"),
        F.struct(F.concat(F.lit("@Org "), (F.col("event_id") % 10).cast("string")).alias("issuer"), F.lit("log").alias("log"),
                 F.col("event_id").alias("cert_index")).alias("cert"), F.lit(None).cast(A.DNS).alias("dns"))
    dns = F.struct(F.col("ts").alias("checked_at"), (F.col("event_id") % 2 == 0).alias("resolves"), F.array(F.lit("192.0.2.1")).alias("a"),
                   F.array().cast("array<string>").alias("aaaa"), F.lit(None).cast("string").alias("error")).cast(A.DNS)
    return events.select(
        F.col("event_id").alias("seq"), kind.alias("type"), ident.alias("id"), F.col("ts").alias("at"),
        F.when(kind == "alert", alert).alias("alert"), F.when(kind == "status", status).alias("status"),
        F.when((kind == "status") & (F.col("event_id") % 3 == 0), F.concat(F.lit("note "), F.col("event_id").cast("string"))).alias("note"),
        F.when(kind == "dns", dns).alias("dns"))


_STATE_SQL = """base AS (SELECT user_id, max(event_id) AS base FROM events WHERE event_type = 'signup' GROUP BY user_id),
later AS (SELECT e.*, b.base FROM events e JOIN base b ON b.user_id = e.user_id AND e.event_id > b.base),
folded AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS repeats, max(event_id) FILTER (event_type = 'view') AS last_view,
   max(event_id) FILTER (event_type IN ('error','purchase')) AS last_status,
   max(event_id) FILTER (event_type IN ('error','purchase') AND event_id % 3 = 0) AS last_note,
   max(event_id) FILTER (event_type = 'click') AS last_dns FROM later GROUP BY user_id),
state AS (SELECT 'a' || CAST(b.user_id AS VARCHAR) AS id, b.user_id, b.base, 1 + coalesce(f.repeats, 0) AS count,
   epoch_us(coalesce(v.ts, e.ts)) AS last_us, epoch_us(e.ts) AS created_us, e.ts AS created_at, coalesce(v.ts, e.ts) AS last_seen,
   CASE coalesce(f.last_status, 0) % 4 WHEN 1 THEN 'acknowledged' WHEN 2 THEN 'resolved' WHEN 3 THEN 'false_positive' ELSE 'new' END AS status,
   CASE WHEN f.last_note IS NULL THEN '' ELSE 'note ' || CAST(f.last_note AS VARCHAR) END AS note,
   f.last_dns % 2 = 0 AS resolves, CAST(b.base % 61 + 40 AS INTEGER) AS score,
   CASE WHEN b.base % 61 + 40 >= 80 THEN 'high' WHEN b.base % 61 + 40 >= 60 THEN 'medium' ELSE 'low' END AS severity,
   'u' || CAST(b.user_id AS VARCHAR) || '.test' AS domain, '@Org ' || CAST(b.base % 10 AS VARCHAR) AS issuer
  FROM base b JOIN events e ON e.event_id = b.base LEFT JOIN folded f ON f.user_id = b.user_id LEFT JOIN events v ON v.event_id = f.last_view)"""


@query("alert_state", f"""WITH {_STATE_SQL} SELECT id, count, last_us, status, note, resolves FROM state""")
def state(spark, folder):
    return A.alert_state(_events(spark, folder)).select(
        "id", "count", F.unix_micros("last_seen").alias("last_us"), "status", "note", F.col("dns.resolves").alias("resolves"))


@query("compact_events", f"""WITH {_STATE_SQL} SELECT id, count, status, note FROM state""")
def compacted(spark, folder):
    once = A.compact_events(_events(spark, folder))
    return A.alert_state(once).select("id", "count", "status", "note")


@query("alert_counts", f"""WITH {_STATE_SQL} SELECT count(*) AS total,
  count(*) FILTER (status = 'new') AS "new", count(*) FILTER (status = 'acknowledged') AS acknowledged,
  count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'false_positive') AS false_positive,
  count(*) FILTER (status = 'new' AND severity = 'high') AS new_high, count(*) FILTER (status = 'new' AND severity = 'medium') AS new_medium,
  count(*) FILTER (status = 'new' AND severity = 'low') AS new_low FROM state""")
def counts(spark, folder):
    return A.alert_counts(A.alert_state(_events(spark, folder)))


@query("alert_list", f"""WITH {_STATE_SQL} SELECT id, created_us, severity FROM state
WHERE severity <> 'low' AND status = 'new' AND contains(lower(domain || '  A, "B" ' || issuer), 'org 3')
ORDER BY created_us DESC, id DESC LIMIT 200""")
def listed(spark, folder):
    rows = A.list_alerts(A.alert_state(_events(spark, folder)), "new", "medium", " ORG 3 ", limit=200)
    return rows.select("id", F.unix_micros("created_at").alias("created_us"), "severity")


@query("alerts_csv", f"""WITH {_STATE_SQL} SELECT strftime(created_at, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(created_at) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z,' ||
  strftime(last_seen, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(last_seen) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z,' || CAST(count AS VARCHAR) || ',' || status || ',' ||
  severity || ',' || CAST(score AS VARCHAR) || ',' || domain || ',,' || chr(34) || 'A, ' || chr(34) || chr(34) || 'B' || chr(34) || chr(34) || chr(34) || ',keyword lure-word,' || '''' || issuer || ',log,' || CAST(base AS VARCHAR) || ',' || note AS line
FROM state""")
def csv(spark, folder):
    return A.alerts_csv_lines(A.alert_state(_events(spark, folder)))


@query("alerts_csv_text", f"""WITH {_STATE_SQL}, lines AS (SELECT row_number() OVER (ORDER BY created_us DESC, id DESC) AS place, strftime(created_at, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(created_at) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z,' ||
  strftime(last_seen, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(last_seen) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z,' || CAST(count AS VARCHAR) || ',' || status || ',' ||
  severity || ',' || CAST(score AS VARCHAR) || ',' || domain || ',,' || chr(34) || 'A, ' || chr(34) || chr(34) || 'B' || chr(34) || chr(34) || chr(34) || ',keyword lure-word,' || chr(39) || issuer || ',log,' || CAST(base AS VARCHAR) || ',' || note AS line FROM state)
SELECT place, line || chr(13) || chr(10) AS line FROM lines UNION ALL
SELECT 0, 'created_at,last_seen,count,status,severity,score,domain,unicode,watch,reasons,issuer,log,cert_index,note' || chr(13) || chr(10)""")
def csv_text(spark, folder):
    return A.alerts_csv_text(A.alert_state(_events(spark, folder)))


@query("alerts_retained", f"WITH {_STATE_SQL} SELECT id, created_us FROM state ORDER BY created_us DESC, id DESC LIMIT 25")
def retained(spark, folder):
    return A.retain(A.alert_state(_events(spark, folder)), 25).select("id", F.unix_micros("created_at").alias("created_us"))


_STAMP = "strftime({0}, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us({0}) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z'"
_SIGNED = f"""'sha256=' || sha256(unhex('{(bytes(x ^ 0x5C for x in b"k".ljust(64, bytes(1)))).hex()}') || unhex(sha256(unhex('{(bytes(x ^ 0x36 for x in b"k".ljust(64, bytes(1)))).hex()}') || encode(body))))"""


@query("outbox", f"""WITH {_STATE_SQL}, more AS (SELECT s.*, d.ts AS dns_at, u.ts AS changed_at FROM state s LEFT JOIN folded f ON f.user_id = s.user_id LEFT JOIN events d ON d.event_id = f.last_dns LEFT JOIN events u ON u.event_id = f.last_status),
b AS (SELECT id, 'text' AS format, '{{"text":"[' || severity || '] ' || domain || ' looks like A, \\"B\\", score ' || CAST(score AS VARCHAR) ||
  ' (keyword, lure-word), issued by ' || issuer || '"}}' AS body FROM state WHERE severity <> 'low'
UNION ALL SELECT id, 'json', '{{"event":"alert","alert":{{"id":"' || id || '","created_at":"' || {_STAMP.format('created_at')} || '","last_seen":"' || {_STAMP.format('last_seen')} || '","updated_at":"' || {_STAMP.format('coalesce(changed_at, created_at)')} ||
  '","count":' || CAST(count AS VARCHAR) || ',"status":"' || status || '","note":"' || note || '","severity":"' || severity || '","score":' || CAST(score AS VARCHAR) || ',"reasons":["keyword","lure-word"],"domain":"' || domain ||
  '","unicode":null,"watch":{{"id":"w","name":"A, \\"B\\"","kind":"brand"}},"cert":{{"issuer":"' || issuer || '","log":"log","cert_index":' || CAST(base AS VARCHAR) || '}},"dns":' ||
  coalesce('{{"checked_at":"' || {_STAMP.format('dns_at')} || '","resolves":' || CAST(resolves AS VARCHAR) || ',"a":["192.0.2.1"],"aaaa":[],"error":null}}', 'null') || '}}}}' FROM more WHERE severity <> 'low')
SELECT id, format, body, {_SIGNED} AS signature FROM b""")
def outbox(spark, folder):
    rows = A.outbox(A.alert_state(_events(spark, folder)), ["text:https://hooks.example/t", "https://hooks.example/j"], "medium", "k")
    return rows.select("id", "format", "body", "signature")


@query("alert_dns", f"""WITH {_STATE_SQL}, a AS (SELECT user_id, arg_max(event_id, event_id) AS e FROM events WHERE user_id % 3 > 0 GROUP BY user_id)
SELECT id, coalesce(a.e % 2 = 1, resolves) AS resolves FROM state s LEFT JOIN a ON a.user_id = s.user_id""")
def dns(spark, folder):
    # Every event is an answer; of every third user it is for another name, so their alerts keep what they had.
    name = F.concat(F.when(F.col("user_id") % 3 > 0, "u").otherwise("x"), F.col("user_id").cast("string"), F.lit(".test"))
    answers = table(spark, folder, "events").select(
        name.alias("name"), F.col("ts").alias("checked_at"),
        F.when(F.col("event_id") % 2 == 1, F.array(F.lit("192.0.2.9"))).otherwise(F.array().cast("array<string>")).alias("a"),
        F.array().cast("array<string>").alias("aaaa"), F.lit(None).cast("string").alias("error"))
    return A.with_dns(A.alert_state(_events(spark, folder)), answers).select("id", F.col("dns.resolves").alias("resolves"))
