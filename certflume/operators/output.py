"""Certificates as lines: text, JSON messages, full messages or bare names, narrowed by names and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import issuer_name, short_log_name
from ..functions.render import finding_line, text_line
from ..functions.unicode import unicode_domain
from .certificates import full_messages, lite_messages
from .search import match_names

KEY = ("log_url", "index")
FORMS = ("text", "json", "full", "domains")


def _with_findings(json: Column, listed: Column) -> Column:
    """A JSON object with its findings as one more field."""
    more = F.concat(F.substring(json, F.lit(1), F.length(json) - 1), F.lit(',"findings":'), F.to_json(listed), F.lit("}"))
    return F.when(listed.isNull(), json).otherwise(more)


def lines(certs: DataFrame, form: str = "text", findings: DataFrame | None = None, patterns: tuple[str, ...] = (), keywords: tuple[str, ...] = ()) -> DataFrame:
    """One ``value`` per certificate to be written as text.

    ``findings`` (with log_url, index and pos) belong to the certificates. With findings, patterns or
    keywords only certificates that have one or match are kept; a certificate
    with findings prints a line for each of them as text, and carries them as JSON.
    """
    if form not in FORMS:
        raise ValueError(f"unknown form {form}; known: {', '.join(FORMS)}")
    rows = match_names(certs, patterns, keywords, names="parsed.all_domains")
    if findings is None:
        rows = rows.withColumn("_found", F.lit(None))
    else:
        fields = [c for c in findings.columns if c not in (*KEY, "pos")]
        own = findings.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("watch.id").alias("_w"), F.struct(*fields).alias("f")))).alias("_s"))
        rows = rows.join(own.select(*KEY, F.transform("_s", lambda s: s["f"]).alias("_found")), list(KEY), "left")
    if patterns or keywords or findings is not None:
        rows = rows.filter(F.col("hit").isNotNull() | F.col("_found").isNotNull())
    if form == "domains":
        return rows.select(F.array_join("parsed.all_domains", "\n").alias("value"))
    if form == "text":
        return rows.select(_text(rows, findings is not None).alias("value"))
    messages = (full_messages if form == "full" else lite_messages)(rows, carry=("_found",))
    json = F.to_json("message", {"ignoreNullFields": "false"})
    return messages.select((json if findings is None else _with_findings(json, F.col("_found"))).alias("value"))


def _text(rows: DataFrame, found: bool) -> Column:
    issuer = issuer_name(F.col("parsed.issuer.O"), F.col("parsed.issuer.CN"))
    log = short_log_name(F.col("log_name"))
    named = "subject" in rows.schema["parsed"].dataType.names
    cn = F.col("parsed.subject.CN") if named else F.lit(None).cast("string")
    lead = F.coalesce("hit", F.get("parsed.all_domains", F.lit(0)))
    plain = text_line(F.col("seen"), F.col("entry_type"), F.col("parsed.all_domains"), unicode_domain(lead), F.col("hit"), cn, issuer, log)
    if not found:
        return plain
    own = F.transform("_found", lambda f: finding_line(f["severity"], f["score"], f["domain"], f["unicode"], f["watch"]["name"], f["reasons"], F.col("seen"), issuer, log))
    return F.when(F.col("_found").isNull(), plain).otherwise(F.array_join(own, "\n"))
