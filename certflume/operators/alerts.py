"""Alerts: recording findings, triage, current state, lists and exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import fixed_values as fv
from ..functions.names import at_least, issuer_name, short_log_name
from ..functions.render import alert_text, csv_cell, csv_field, sign_body
from .windows import PAUSES, place

DNS = "struct<checked_at:timestamp,resolves:boolean,a:array<string>,aaaa:array<string>,error:string>"
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
_BODY = ("severity", "score", "reasons", "evidence", "domain", "unicode", "watch", "cert")
ALERT_FIELDS = ("id", "created_at", "last_seen", "updated_at", "count", "status", "note", *_BODY, "dns")


def alert_id(watch_id: Column, domain: Column, created_us: Column) -> Column:
    """Id of an alert: a hash of its key and start, equal in batch and stream."""
    text = F.concat_ws("|", watch_id, domain, created_us.cast("string"))
    return F.concat(F.lit("a_"), F.substring(F.sha2(text, 256), 1, 16))


def alert_cert(parsed: Column, update_type: Column, fingerprints: Column, log: Column, index: Column,
               link: Column, leaf: Column, names: int | None = None) -> Column:
    """What an alert keeps of the certificate that raised it; ``names`` keeps the first names only."""
    domains = parsed["all_domains"] if names is None else F.slice(parsed["all_domains"], 1, names)
    return F.struct(
        fingerprints["sha256"].alias("sha256"), update_type.alias("update_type"),
        issuer_name(parsed["issuer"]["O"], parsed["issuer"]["CN"]).alias("issuer"),
        parsed["not_before"].alias("not_before"), parsed["not_after"].alias("not_after"),
        domains.alias("all_domains"), short_log_name(log["name"]).alias("log"),
        log["url"].alias("log_url"), index.alias("cert_index"), link.alias("cert_link"), leaf.alias("leaf"))


def triage_events(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split status changes (id, at, status, note) into valid and rejected ones."""
    error = (F.when(F.col("status").isNotNull() & ~F.col("status").isin(*fv.STATUSES),
                    F.lit("unknown status; known: " + ", ".join(fv.STATUSES)))
             .when(F.length("note") > fv.MAX_NOTE, F.lit(f"notes are at most {fv.MAX_NOTE} characters")))
    checked = rows.withColumn("error", error)
    return checked.filter("error is null").drop("error"), checked.filter("error is not null")


def _mark_order(triage: DataFrame) -> Column:
    """Marks in order: by time, those of one instant by ``seq``, or by what they say where there is none."""
    return F.struct("at", "seq") if "seq" in triage.columns else F.struct("at", F.coalesce("status", F.lit("")), F.coalesce("note", F.lit("")))


def silence(findings: DataFrame, triage: DataFrame) -> DataFrame:
    """Spans in which a false positive keeps its key quiet, per key.

    A span runs from the mark to the alert's next status change; of several marks
    at one instant the last decides (see ``seq`` of ``triage``).
    """
    own = (
        findings.select(F.col("watch.id").alias("watch_id"), "domain", F.unix_micros("seen").alias("anchor")).distinct()
        .withColumn("id", alert_id(F.col("watch_id"), F.col("domain"), F.col("anchor")))
    )
    marks = triage.filter("status is not null")
    until = F.lead(F.unix_micros("at")).over(W.partitionBy("id").orderBy(_mark_order(marks)))
    marked = (
        marks
        .withColumn("to", F.coalesce(until, F.lit((1 << 62)).cast("bigint")))
        .filter("status = 'false_positive'")
        .select("id", F.unix_micros("at").alias("from"), "to").filter("`from` < `to`")
    )
    return own.join(marked, "id").groupBy("watch_id", "domain").agg(
        F.array_sort(F.collect_list(F.struct("anchor", "from", "to"))).cast(PAUSES).alias("pauses"))


def mark_repeats(findings: DataFrame, triage: DataFrame | None = None, window: str = "24 hours") -> DataFrame:
    """Findings with the alert each belongs to: ``watch_id``, ``id``, ``created_at``."""
    keyed = findings.withColumn("watch_id", F.col("watch.id"))
    pauses = None if triage is None else silence(findings, triage)
    placed = place(keyed, ["watch_id", "domain"], "seen", window, pauses)
    return (
        placed.withColumn("id", alert_id(F.col("watch_id"), F.col("domain"), F.col("_anchor")))
        .withColumn("created_at", F.timestamp_micros("_anchor")).drop("_us", "_anchor")
    )


def record_alerts(findings: DataFrame, triage: DataFrame | None = None, window: str = "24 hours",
                  order: tuple[str, ...] = ()) -> DataFrame:
    """Alerts with their repeats counted and their triage applied.

    A finding of a key (entry and name) repeats the key's latest alert while
    that alert is younger than ``window`` or marked a false positive; otherwise
    it raises a new one. Repeats never change what the alert says. ``triage`` (id, at,
    status, note) may have ``seq``, which puts marks of one instant in order, as in the stream.
    """
    # Each column by itself, all of the same first row, so that those nobody reads are not carried along.
    body = [F.min_by(c, F.struct("seen", *order)).alias(c) if c in findings.columns else F.lit(None).cast("string").alias(c) for c in _BODY]
    alerts = (
        mark_repeats(findings, triage, window)
        .groupBy("id", "created_at")
        .agg(F.count(F.lit(1)).alias("count"), F.max("seen").alias("last_seen"), *body)
        .withColumn("dns", F.lit(None).cast(DNS))
    )
    if triage is None:
        settled = alerts.withColumn("status", F.lit("new")).withColumn("note", F.lit("")).withColumn("updated_at", F.col("created_at"))
    else:
        order_ = _mark_order(triage)
        latest = triage.groupBy("id").agg(
            F.max_by("status", F.when(F.col("status").isNotNull(), order_)).alias("status"),
            F.max_by("note", F.when(F.col("note").isNotNull(), order_)).alias("note"), F.max("at").alias("updated_at"))
        settled = alerts.join(latest, "id", "left").withColumns({
            "status": F.coalesce("status", F.lit("new")), "note": F.coalesce("note", F.lit("")),
            "updated_at": F.coalesce("updated_at", "created_at")})
    return settled.select(*ALERT_FIELDS)


# --- event log ---------------------------------------------------------------

def alert_log(findings: DataFrame, triage: DataFrame | None = None, window: str = "24 hours",
              order: tuple[str, ...] = ()) -> DataFrame:
    """The event log of recorded findings: alert, repeat and status rows."""
    alerts = record_alerts(findings, triage, window, order)
    opening = alerts.select(
        F.lit("alert").alias("type"), "id", F.col("created_at").alias("at"),
        F.struct(*[F.lit(1).cast("bigint").alias("count") if c == "count"
                   else F.col("created_at").alias(c) if c in ("last_seen", "updated_at")
                   else F.lit("new").alias(c) if c == "status"
                   else F.lit("").alias(c) if c == "note" else F.col(c) for c in ALERT_FIELDS]).alias("alert"))
    marked = mark_repeats(findings, triage, window)
    ranked = marked.groupBy("id", "seen", "created_at").agg(F.count(F.lit(1)).alias("n"))
    # The row that opened the alert is not a repeat of it.
    again = ranked.withColumn("n", F.col("n") - F.when(F.col("seen") == F.col("created_at"), 1).otherwise(0))
    repeats = again.filter("n > 0").select("id", F.col("seen").alias("at"), F.explode(F.sequence(F.lit(1), F.col("n")))).select(
        F.lit("repeat").alias("type"), "id", "at")
    log = opening.unionByName(repeats, allowMissingColumns=True)
    if triage is not None:
        status = triage.select(F.lit("status").alias("type"), "id", "at", "status", "note")
        log = log.unionByName(status, allowMissingColumns=True)
    return log


def alert_state(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Current alerts from their event log.

    The base of an id is its latest ``alert`` row; only later rows count. Rows
    of ids without a base are ignored.
    """
    base = events.filter("type = 'alert'").groupBy("id").agg(
        F.max_by("alert", seq).alias("alert"), F.max(seq).alias("_base"))
    later = events.filter("type <> 'alert'").join(base.select("id", "_base"), "id").filter(F.col(seq) > F.col("_base"))

    def latest(column: str, kind: str, present: str = "true") -> Column:
        return F.max_by(column, F.expr(f"CASE WHEN type = '{kind}' AND {present} THEN `{seq}` END"))

    for column in ("status", "note"):
        if column not in events.columns:
            later = later.withColumn(column, F.lit(None).cast("string"))
    has_dns = "dns" in events.columns
    folded = later.groupBy("id").agg(
        F.count_if(F.col("type") == "repeat").alias("_repeats"), latest("at", "repeat").alias("_seen"),
        latest("status", "status").alias("_status"), latest("note", "status", "note is not null").alias("_note"),
        latest("at", "status").alias("_updated"),
        *([latest("dns", "dns").alias("_dns"), F.max(F.col("type") == "dns").alias("_has_dns")] if has_dns else []))
    fields = [f"alert.{n}" for n in events.schema["alert"].dataType.names if n != "id"]
    joined = base.join(folded, "id", "left").select("id", *fields, *[c for c in folded.columns if c != "id"])
    changes = {
        "count": F.col("count") + F.coalesce("_repeats", F.lit(0)), "last_seen": F.coalesce("_seen", "last_seen"),
        "status": F.coalesce("_status", "status"), "note": F.coalesce("_note", "note"),
        "updated_at": F.coalesce("_updated", "updated_at"),
    }
    if has_dns:
        changes["dns"] = F.when(F.coalesce("_has_dns", F.lit(False)), F.col("_dns")).otherwise(F.col("dns"))
    return joined.withColumns(changes).drop("_repeats", "_seen", "_status", "_note", "_updated", "_dns", "_has_dns")


def needs_compaction(events: DataFrame) -> bool:
    """True when a log is long and mostly made of spent events."""
    row = events.agg(F.count(F.lit(1)).alias("lines"),
                     F.count_distinct(F.when(F.col("type") == "alert", F.col("id"))).alias("alerts")).first()
    return row.lines > 1000 and row.lines > 2 * row.alerts


def compact_events(events: DataFrame, seq: str = "seq") -> DataFrame:
    """The same state as one ``alert`` row per alert."""
    state = alert_state(events, seq)
    return state.select(F.lit("alert").alias("type"), "id", F.col("updated_at").alias("at"),
                        F.struct(*state.columns).alias("alert"), F.lit(0).cast("bigint").alias(seq))


# --- reading -----------------------------------------------------------------

def with_dns(alerts: DataFrame, dns: DataFrame) -> DataFrame:
    """Attach the latest answer for an alert's name (without its wildcard)."""
    addresses = F.coalesce(F.size("a"), F.lit(0)) + F.coalesce(F.size("aaaa"), F.lit(0))
    answer = F.struct("checked_at", (addresses > 0).alias("resolves"), "a", "aaaa", "error").cast(DNS)
    latest = dns.groupBy("name").agg(F.max_by(answer, "checked_at").alias("_dns"))
    name = F.regexp_replace("domain", r"^\*\.", "")
    return (
        alerts.withColumn("name", name).join(latest, "name", "left")
        .withColumn("dns", F.coalesce("_dns", "dns")).drop("name", "_dns")
    )


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Total, per status, and new ones per severity, as one row."""
    new = F.col("status") == "new"
    return alerts.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in fv.STATUSES],
        *[F.count_if(new & (F.col("severity") == s)).alias(f"new_{s}") for s in reversed(fv.SEVERITY_RANK)])


def alert_text_match(q: str) -> Column:
    """Alerts whose name, Unicode form, entry or issuer holds the text."""
    text = F.concat_ws(" ", "domain", F.coalesce("unicode", F.lit("")), F.col("watch.name"),
                       F.coalesce(F.col("cert.issuer"), F.lit("")))
    return F.contains(F.lower(text), F.lit(q.strip().lower()))


def list_alerts(alerts: DataFrame, status: str = "all", severity: str = "all", q: str = "", limit: int | None = None) -> DataFrame:
    """The alert list, newest first (all without `limit`); status is exact, severity is at least."""
    if status != "all":
        alerts = alerts.filter(F.col("status") == status)
    if severity != "all":
        alerts = alerts.filter(at_least(F.col("severity"), severity))
    if q.strip():
        alerts = alerts.filter(alert_text_match(q))
    found = alerts.orderBy(F.col("created_at").desc(), F.col("id").desc())
    return found if limit is None else found.limit(limit)


# --- exports -----------------------------------------------------------------

def _csv_values(alerts: DataFrame) -> dict[str, Column]:
    values = {c: F.col(c) for c in fv.CSV_COLUMNS if c in alerts.columns}
    stamps = {c: F.date_format(c, ISO) for c in ("created_at", "last_seen")}
    return values | stamps | {
        "watch": F.col("watch.name"), "reasons": F.array_join("reasons", " "),
        "issuer": F.col("cert.issuer"), "log": F.col("cert.log"), "cert_index": F.col("cert.cert_index")}


def alerts_csv(alerts: DataFrame) -> DataFrame:
    """Export columns with formulas defused; quoting is left to the writer."""
    values = _csv_values(alerts)
    return alerts.select(*[csv_cell(values[c]).alias(c) for c in fv.CSV_COLUMNS])


def alerts_csv_lines(alerts: DataFrame) -> DataFrame:
    """The export as finished lines, one per alert."""
    values = _csv_values(alerts)
    return alerts.select(F.concat_ws(",", *[csv_field(values[c]) for c in fv.CSV_COLUMNS]).alias("line"))


def alerts_csv_text(alerts: DataFrame) -> DataFrame:
    """The export as (place, line): the header as place 0, then the alerts, newest first; lines end with CR and LF."""
    ordered = alerts_csv_lines_placed(alerts)
    header = alerts.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("place"), F.lit(",".join(fv.CSV_COLUMNS) + "\r\n").alias("line"))
    return header.unionByName(ordered.select("place", F.concat("line", F.lit("\r\n")).alias("line")))


def alerts_csv_lines_placed(alerts: DataFrame) -> DataFrame:
    """Lines with their places from 1, newest alert first: places are counted by days, not in one window over all alerts."""
    values = _csv_values(alerts)
    line = F.concat_ws(",", *[csv_field(values[c]) for c in fv.CSV_COLUMNS])
    rows = alerts.select(F.to_date("created_at").alias("_day"), "created_at", "id", line.alias("line"))
    # As many rows as there are days; the sum over them is one small window.
    days = rows.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    before = days.select("_day", (F.sum("_n").over(W.orderBy(F.col("_day").desc())) - F.col("_n")).alias("_before"))
    in_day = F.row_number().over(W.partitionBy("_day").orderBy(F.col("created_at").desc(), F.col("id").desc()))
    return rows.withColumn("_at", in_day).join(F.broadcast(before), "_day").select((F.col("_before") + F.col("_at")).alias("place"), "line")


def retain(alerts: DataFrame, keep: int) -> DataFrame:
    """The newest `keep` alerts, by when they opened; what is older is forgotten, and may be raised anew."""
    place = F.struct("created_at", "id")
    # Two columns of `keep` rows at most are sorted to find the last place that stays.
    edge = alerts.select(place.alias("p")).orderBy(F.col("p").desc()).limit(keep).agg(F.min("p").alias("_edge"))
    return alerts.join(F.broadcast(edge), place >= F.col("_edge")).drop("_edge")


def write_alerts_csv(alerts: DataFrame, path: str) -> None:
    (alerts_csv(alerts).write.option("header", True).option("lineSep", "\r\n").option("quote", '"')
     .option("escape", '"').option("emptyValue", "").mode("overwrite").csv(path))


def parse_hook(spec: str) -> dict[str, str]:
    """``json:URL``, ``text:URL`` or a bare URL."""
    head, _, rest = spec.partition(":")
    form, url = (head, rest) if head in ("json", "text") and rest else ("json", spec)
    if not re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*:", url):
        raise ValueError(f"no address to post to: {spec}")
    if not re.match(r"^https?://[^/?#]", url):
        raise ValueError(f"only http and https addresses are posted to, not {spec}")
    return {"format": form, "url": url}


def outbox(alerts: DataFrame, hooks: list[str], minimum: str = "medium", secret: str | None = None) -> DataFrame:
    """One row per alert and webhook: what to post, and its signature."""
    parsed = [parse_hook(h) for h in hooks]
    if not parsed:
        return alerts.limit(0).select("id", F.lit("").alias("format"), F.lit("").alias("url"),
                                      F.lit("").alias("body"), F.lit("").alias("signature"))
    targets = F.array(*[F.struct(F.lit(h["format"]).alias("format"), F.lit(h["url"]).alias("url")) for h in parsed])
    full = F.to_json(F.struct(F.lit("alert").alias("event"), F.struct(*alerts.columns).alias("alert")),
                     {"ignoreNullFields": "false", "timestampFormat": ISO})
    line = alert_text(F.col("severity"), F.col("domain"), F.col("unicode"), F.col("watch.name"), F.col("score"),
                      F.col("reasons"), F.col("cert.issuer"))
    posted = (
        alerts.filter(at_least(F.col("severity"), minimum))
        .withColumn("_text", F.to_json(F.struct(line.alias("text")))).withColumn("_full", full)
        .select("id", "_text", "_full", F.explode(targets).alias("hook"))
        .select("id", "hook.format", "hook.url",
                F.when(F.col("hook.format") == "text", F.col("_text")).otherwise(F.col("_full")).alias("body"))
    )
    signature = F.lit(None).cast("string") if secret is None else sign_body(F.col("body"), secret)
    return posted.withColumn("signature", signature)


def alert_messages(alerts: DataFrame, message_type: str = "alert") -> DataFrame:
    """Alert stream messages: ``alert`` for new ones, ``alert_update`` for changes."""
    return alerts.select(F.to_json(F.struct(F.lit(message_type).alias("message_type"), F.struct(*alerts.columns).alias("data")),
                                   {"ignoreNullFields": "false", "timestampFormat": ISO}).alias("value"))

