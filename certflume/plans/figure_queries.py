"""Figures, search and the last hour, over certificates made of events."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..operators import search as S, stats
from ..operators.alerts import outbox, record_alerts
from ..operators.windows import anchored_window
from ..session import stored
from .alert_queries import anchored_sql
from .catalogue import query
from .views import CERTS_SQL, certs, findings, table

NOW = datetime(2024, 1, 15, 12, 30, 20, tzinfo=timezone.utc)
_NOW = "TIMESTAMP '2024-01-15 12:30:20'"
_HOUR = "seen >= TIMESTAMP '2024-01-15 11:31:00' AND seen < TIMESTAMP '2024-01-15 12:31:00'"
_ENDING = "string_split(host, '.')[-1]"


@query("published_by_type", f"""WITH {CERTS_SQL} SELECT CASE WHEN entry_type = 1 THEN 'PrecertLogEntry' ELSE 'X509LogEntry' END AS update_type,
count(*) AS count FROM certs GROUP BY 1""")
def by_type(spark, folder):
    return stats.published_by_type(certs(spark, folder))


@query("per_minute", f"""WITH {CERTS_SQL} SELECT epoch_us(date_trunc('minute', seen)) AS minute_us, count(*) AS total,
count(*) FILTER (entry_type = 1) AS pre FROM certs GROUP BY 1""")
def minutes(spark, folder):
    return stats.per_minute(certs(spark, folder)).select(F.unix_micros("minute").alias("minute_us"), "total", "pre")


@query("per_minute_by_issuer", f"""WITH {CERTS_SQL} SELECT epoch_us(date_trunc('minute', seen)) AS minute_us, org, count(*) AS count FROM certs GROUP BY 1, 2""")
def minutes_by(spark, folder):
    return stats.per_minute_by(certs(spark, folder), "org").select(F.unix_micros("minute").alias("minute_us"), "org", "count")


@query("rate", f"""WITH {CERTS_SQL} SELECT epoch_us(time_bucket(INTERVAL '5 seconds', seen)) AS start_us, CAST(round(count(*) / 5.0) AS BIGINT) AS per_second
FROM certs GROUP BY 1""")
def rate(spark, folder):
    return stats.rate(certs(spark, folder)).select(F.unix_micros("start").alias("start_us"), "per_second")


@query("insights_hour", f"""WITH {CERTS_SQL}, slots AS (SELECT unnest(generate_series(0, 59)) AS slot),
m AS (SELECT date_diff('minute', TIMESTAMP '2024-01-15 11:31:00', date_trunc('minute', seen)) AS slot, count(*) AS n,
  count(*) FILTER (entry_type = 1) AS pre FROM certs WHERE {_HOUR} GROUP BY 1)
SELECT string_agg(CAST(coalesce(n, 0) AS VARCHAR), ' ' ORDER BY s.slot) AS per_minute, CAST(coalesce(sum(n), 0) AS BIGINT) AS total,
  CAST(coalesce(sum(pre), 0) AS BIGINT) AS pre, CAST(coalesce(sum(n), 0) - coalesce(sum(pre), 0) AS BIGINT) AS crt
FROM slots s LEFT JOIN m ON m.slot = s.slot""")
def insights(spark, folder):
    row = stats.insights(certs(spark, folder), NOW)
    return row.select(F.array_join(F.transform("per_minute", lambda n: n.cast("string")), " ").alias("per_minute"), "total", "pre", "crt")


@query("top_issuers", f"""WITH {CERTS_SQL} SELECT org AS name, count(*) AS count FROM certs GROUP BY org ORDER BY count(*) DESC, min(seen) LIMIT 8""")
def issuers(spark, folder):
    return stats.top_issuers(certs(spark, folder))


@query("top_endings_hour", f"""WITH {CERTS_SQL} SELECT {_ENDING} AS name, count(*) AS count FROM certs WHERE {_HOUR}
GROUP BY 1 ORDER BY count(*) DESC, min(seen) LIMIT 8""")
def endings(spark, folder):
    return stats.top_endings(certs(spark, folder), NOW)


@query("live_figures", f"""WITH {CERTS_SQL}, w AS (SELECT * FROM certs WHERE seen > {_NOW} - INTERVAL 60 SECOND AND seen < {_NOW} + INTERVAL 1 SECOND)
SELECT count(*) AS seen, count(*) FILTER (entry_type = 1) AS pre, count(*) FILTER (entry_type <> 1) AS crt, count(*) FILTER (contains(host, 'th')) AS hits,
  (SELECT string_agg(CAST(n AS VARCHAR), ' ' ORDER BY s) FROM (SELECT s, (SELECT count(*) FROM w WHERE date_diff('second', date_trunc('second', seen), {_NOW}) = 59 - s) AS n FROM generate_series(0, 59) t(s)) x) AS per_second,
  CAST(round(count(*) FILTER (date_diff('second', date_trunc('second', seen), {_NOW}) < 5) / 5.0) AS BIGINT) AS rate FROM w""")
def live(spark, folder):
    rows = S.match_names(certs(spark, folder).withColumn("all_domains", F.col("parsed.all_domains")), keywords=["th"])
    return stats.live_figures(rows, NOW, F.col("hit").isNotNull()).select("seen", "pre", "crt", "hits", F.array_join(F.col("per_second").cast("array<string>"), " ").alias("per_second"), "rate")


_FLAGGED = f"""{CERTS_SQL}, {anchored_sql('events', 'user_id', 'ts', 15)},
flagged AS (SELECT c.*, NOT w.is_first AS is_copy, c.idx % 97 = 0 AS unreadable, c.idx % 89 = 5 AS skipped FROM certs c JOIN walk w ON w.event_id = c.idx)"""


def _flagged(spark, folder):
    marked = anchored_window(certs(spark, folder), ["sha256"], "seen", "15 minutes", ["log_url", "index"])
    return marked.withColumn("is_copy", ~F.col("is_first")).withColumn("unreadable", F.col("index") % 97 == 0).withColumn("skipped", F.col("index") % 89 == 5)


_STAGES = """SELECT count(*) FILTER (NOT skipped AND NOT is_copy AND NOT unreadable AND entry_type = 0) AS certificates,
count(*) FILTER (NOT skipped AND NOT is_copy AND NOT unreadable AND entry_type = 1) AS precertificates, count(*) FILTER (NOT skipped AND is_copy) AS duplicates,
count(*) FILTER (NOT skipped AND NOT is_copy AND unreadable) AS unreadable, count(*) FILTER (skipped) AS skipped FROM flagged"""


@query("stage_counts", f"WITH RECURSIVE {_FLAGGED} {_STAGES}")
def stages(spark, folder):
    return stats.stage_counts(_flagged(spark, folder))


def _alerts(spark, folder):
    """The alerts of all findings, written once for all figures that are taken of them."""
    return stored(record_alerts(findings(spark, folder), order=("event_id",)), "alerts")


def _checks(spark, folder, alerts=None):
    found = findings(spark, folder)
    return stats.check_counts(certs(spark, folder), found, _alerts(spark, folder) if alerts is None else alerts)


_KEYS = """found AS (SELECT *, CAST(user_id % 3 AS VARCHAR) || '|' || CAST(user_id AS VARCHAR) AS key FROM events),
f_ord AS (SELECT key AS k, epoch_us(ts) AS us, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS rn FROM found),
f_walk AS (SELECT k, rn, us, us AS anchor FROM f_ord WHERE rn = 1 UNION ALL SELECT o.k, o.rn, o.us,
  CASE WHEN o.us - w.anchor < 86400000000 THEN w.anchor ELSE o.us END FROM f_walk w JOIN f_ord o ON o.k = w.k AND o.rn = w.rn + 1)"""
_CHECKS_SQL = """SELECT 'names' AS measure, CAST(2 * count(*) AS BIGINT) AS value FROM events
UNION ALL SELECT 'findings', count(*) FROM found UNION ALL SELECT 'alerts', count(*) FROM (SELECT DISTINCT k, anchor FROM f_walk) x
UNION ALL SELECT 'repeats', (SELECT count(*) FROM found) - count(*) FROM (SELECT DISTINCT k, anchor FROM f_walk) x"""


@query("check_counts", f"WITH RECURSIVE {_KEYS} {_CHECKS_SQL}")
def checks(spark, folder):
    return _checks(spark, folder)


# Alerts are posted to two addresses; of the attempts some fail, some are repeated, and some posts are never tried.
_POSTS = """posts AS (SELECT DISTINCT k, anchor, h FROM f_walk, (VALUES (0), (1)) v(h)),
delivered AS (SELECT count(*) FILTER (anchor % 5 <> 0 AND anchor % 3 <> h) AS sent, count(*) FILTER (anchor % 5 <> 0 AND anchor % 3 = h) AS failed FROM posts)"""


def _delivered(spark, folder, alerts=None):
    alerts = _alerts(spark, folder) if alerts is None else alerts
    urls = ["https://hooks.example/0", "https://hooks.example/1"]
    posts = outbox(alerts, urls, "low")
    at, hook = F.unix_micros("created_at"), F.substring("url", -1, 1).cast("int")
    tried = alerts.select("id", "created_at").join(posts.select("id", "url"), "id").filter(at % 5 != 0)
    # A first attempt without an answer, then one that tells.
    status = F.when(at % 3 == hook, 503).otherwise(204)
    attempts = tried.select("id", "url", F.inline(F.array(F.struct(F.lit(None).cast("int").alias("status")), F.struct(status.alias("status")))))
    return stats.deliveries(posts, attempts)


@query("pipeline_funnel", f"""WITH RECURSIVE {_FLAGGED}, {_KEYS}, {_POSTS}, s AS ({_STAGES})
SELECT 'logs_total' AS measure, count(DISTINCT log) AS value FROM certs UNION ALL SELECT 'logs_healthy', count(DISTINCT log) FILTER (log <> 'error') FROM certs
UNION ALL SELECT 'entries', certificates + precertificates + duplicates + unreadable FROM s UNION ALL SELECT 'copies', duplicates FROM s
UNION ALL SELECT 'unreadable', unreadable FROM s UNION ALL SELECT 'skipped', skipped FROM s
UNION ALL SELECT 'certificates', certificates + precertificates FROM s UNION ALL SELECT 'watching', 6 UNION ALL SELECT 'webhooks_configured', 2
UNION ALL SELECT 'webhooks_sent', sent FROM delivered UNION ALL SELECT 'webhooks_failed', failed FROM delivered
UNION ALL {_CHECKS_SQL}""")
def funnel(spark, folder):
    logs = certs(spark, folder).groupBy(F.col("log_name")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "state", F.when(F.col("log_name") == "error", "backoff").otherwise("ok"))
    return stats.pipeline_funnel(logs, _flagged(spark, folder), _checks(spark, folder), 6, 2, _delivered(spark, folder))


@query("search", f"""WITH {CERTS_SQL} SELECT idx AS "index", epoch_us(seen) AS seen_us FROM certs
WHERE entry_type = 1 AND (contains(host, 'casino') OR contains(lower('Org ' || substr(org, 5) || ' ' || cn), 'casino'))
ORDER BY seen DESC, idx DESC LIMIT 200""")
def search(spark, folder):
    return S.search(certs(spark, folder), " CASINO ", "pre", limit=200).select("index", F.unix_micros("seen").alias("seen_us"))


@query("search_issuer", f"""WITH {CERTS_SQL} SELECT idx AS "index" FROM certs WHERE contains(lower(org || ' ' || cn), 'org 3 ca 3') ORDER BY seen DESC, idx DESC LIMIT 50""")
def search_issuer(spark, folder):
    return S.search(certs(spark, folder), "org 3 ca 3", limit=50).select("index")


@query("search_window", f"""WITH {CERTS_SQL} SELECT count(*) AS certificates, min(epoch_us(seen)) AS since_us FROM certs""")
def search_window(spark, folder):
    return S.search_window(certs(spark, folder)).select("certificates", F.unix_micros("since").alias("since_us"))


@query("latest", f"""WITH {CERTS_SQL} SELECT idx AS "index" FROM certs ORDER BY seen DESC, idx DESC LIMIT 25""")
def latest(spark, folder):
    return S.latest(certs(spark, folder)).select("index")


def _polls(spark, folder):
    events = table(spark, folder, "events")
    outcome = F.when(F.col("event_id") % 5 == 0, "failed").otherwise("ok")
    return events.select(F.col("event_type").alias("log_url"), F.col("ts").alias("at"), outcome.alias("outcome"),
                         F.when(outcome == "failed", F.concat(F.lit("HTTP "), (F.col("event_id") % 400).cast("string"))).alias("error"))


_HEALTH_SQL = """SELECT event_type AS log_url, CASE WHEN arg_max(event_id, ts) % 5 = 0 THEN 'backoff' ELSE 'ok' END AS state,
 count(*) FILTER (event_id % 5 = 0) AS errors, epoch_us(max(ts) FILTER (event_id % 5 <> 0)) AS success_us,
 'HTTP ' || CAST(arg_max(event_id, ts) FILTER (event_id % 5 = 0) % 400 AS VARCHAR) AS last_error FROM events GROUP BY event_type"""


@query("log_health", _HEALTH_SQL)
def health(spark, folder):
    return stats.log_health(_polls(spark, folder)).select("log_url", "state", "errors", F.unix_micros("last_success").alias("success_us"), "last_error")


@query("metrics", f"""WITH RECURSIVE {_FLAGGED}, {_KEYS}, {_POSTS}, h AS ({_HEALTH_SQL}), c AS ({_CHECKS_SQL}), s AS ({_STAGES}), a AS (SELECT count(DISTINCT k || '/' || CAST(anchor AS VARCHAR)) AS n FROM f_walk),
r AS (SELECT arg_max(per_second, start) AS n FROM (SELECT time_bucket(INTERVAL '5 seconds', seen) AS start, CAST(round(count(*) / 5.0) AS BIGINT) AS per_second FROM certs GROUP BY 1) x),
named(name, kind, help) AS (VALUES ('certificates_total', 'counter', 'How many certificates came out of the pipeline.'), ('certificates_per_second', 'gauge', 'Certificates a second in the last span.'),
  ('skipped_entries_total', 'counter', 'Entries passed over by a jump to the end of a log.'), ('duplicates_total', 'counter', 'Entries left out as copies of an earlier one.'),
  ('unreadable_entries_total', 'counter', 'Entries whose certificate did not decode.'), ('logs', 'gauge', 'How many logs are in each state.'), ('log_errors_total', 'counter', 'Requests to a log without a usable answer.'),
  ('names_checked_total', 'counter', 'Names that went through detection.'), ('findings_total', 'counter', 'Findings of all names and entries.'), ('alerts_raised_total', 'counter', 'Alerts opened by a finding.'),
  ('alerts', 'gauge', 'How many alerts have each status.'), ('webhook_deliveries_total', 'counter', 'Posts to webhooks, by how they ended.'), ('log_lag_entries', 'gauge', 'Distance between a log''s size and the reading position.')),
sample(name, line) AS (
SELECT 'certificates_total', '{{type="certificate"}} ' || CAST(certificates AS VARCHAR) FROM s UNION ALL SELECT 'certificates_total', '{{type="precertificate"}} ' || CAST(precertificates AS VARCHAR) FROM s
UNION ALL SELECT 'certificates_per_second', ' ' || CAST(n AS VARCHAR) FROM r UNION ALL SELECT 'skipped_entries_total', ' ' || CAST(skipped AS VARCHAR) FROM s
UNION ALL SELECT 'duplicates_total', ' ' || CAST(duplicates AS VARCHAR) FROM s UNION ALL SELECT 'unreadable_entries_total', ' ' || CAST(unreadable AS VARCHAR) FROM s
UNION ALL SELECT 'logs', '{{state="' || state || '"}} ' || CAST(count(*) AS VARCHAR) FROM h GROUP BY state
UNION ALL SELECT 'log_errors_total', '{{log="' || log_url || '"}} ' || CAST(errors AS VARCHAR) FROM h
UNION ALL SELECT 'log_lag_entries', '{{log="' || log_url || '"}} ' || CAST(errors * 3 AS VARCHAR) FROM h
UNION ALL SELECT 'names_checked_total', ' ' || CAST(value AS VARCHAR) FROM c WHERE measure = 'names'
UNION ALL SELECT 'findings_total', ' ' || CAST(value AS VARCHAR) FROM c WHERE measure = 'findings'
UNION ALL SELECT 'alerts_raised_total', ' ' || CAST(value AS VARCHAR) FROM c WHERE measure = 'alerts'
UNION ALL SELECT 'alerts', '{{status="' || t || '"}} ' || CAST(CASE WHEN t = 'new' THEN n ELSE 0 END AS VARCHAR) FROM a, (VALUES ('new'),('acknowledged'),('resolved'),('false_positive')) v(t)
UNION ALL SELECT 'webhook_deliveries_total', '{{result="sent"}} ' || CAST(sent AS VARCHAR) FROM delivered UNION ALL SELECT 'webhook_deliveries_total', '{{result="failed"}} ' || CAST(failed AS VARCHAR) FROM delivered)
SELECT 'certflume_' || name AS name, CAST(2 AS INTEGER) AS place, 'certflume_' || name || line AS line FROM sample
UNION ALL SELECT 'certflume_' || name, 0, '# HELP certflume_' || name || ' ' || help FROM named UNION ALL SELECT 'certflume_' || name, 1, '# TYPE certflume_' || name || ' ' || kind FROM named""")
def metrics(spark, folder):
    status = stats.log_health(_polls(spark, folder)).withColumn("name", F.col("log_url")).withColumn("lag", F.col("errors") * 3)
    alerts = _alerts(spark, folder)
    return stats.metrics_page(stats.metrics(stats.stage_counts(_flagged(spark, folder)), status, _checks(spark, folder, alerts), alerts,
                                            rates=stats.rate(certs(spark, folder)), delivered=_delivered(spark, folder, alerts)))
