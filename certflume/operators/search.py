"""Recent certificates: filters, search and the flat summary."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import issuer_name, short_log_name
from ..functions.unicode import unicode_domains
from .watchlist import usable_patterns


def _contains_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def with_shown(df: DataFrame, names: str = "all_domains", into: str = "shown") -> DataFrame:
    """Add the Unicode forms of a list of names, position by position."""
    return df.withColumn(into, unicode_domains(F.col(names)))


def match_names(df: DataFrame, patterns: tuple[str, ...] = (), keywords: tuple[str, ...] = (), names: str = "all_domains",
                into: str = "hit", fallback: str | None = None) -> DataFrame:
    """Add the first name that matches a pattern or holds a keyword.

    Coded names are also read in Unicode. With no criteria nothing is filtered
    and the hit is null. ``fallback="substring"`` reads a pattern that is not a
    valid regular expression as plain text, as a live filter does.
    """
    words = [w.strip().lower() for k in keywords for w in k.split(",") if w.strip()]
    good = usable_patterns(df.sparkSession, list(patterns))
    bad = [p for p in patterns if p not in good]
    if bad and fallback != "substring":
        raise ValueError(f"not a valid regular expression: {bad[0]}")
    words += [p.lower() for p in bad]
    regexes = ["(?iu)" + p for p in patterns if p in good]
    if not words and not regexes:
        return df.withColumn(into, F.lit(None).cast("string"))

    def matches(form: Column) -> Column:
        hit = _contains_any(F.lower(form), words)
        for r in regexes:
            hit = hit | form.rlike(r)
        return hit

    shown = with_shown(df, names, "_shown")
    pairs = F.arrays_zip(F.col(names).alias("name"), F.col("_shown").alias("shown"))
    found = F.filter(pairs, lambda p: matches(p["name"]) | ((p["name"] != p["shown"]) & matches(p["shown"])))
    return shown.withColumn(into, F.get(found, F.lit(0))["name"]).drop("_shown")


def of_type(df: DataFrame, kind: str = "all") -> DataFrame:
    if kind == "all":
        return df
    return df.filter(F.col("entry_type") == 1 if kind == "pre" else F.col("entry_type") != 1)


def cert_summary(df: DataFrame) -> DataFrame:
    """A flat row per certificate."""
    ext = "parsed.extensions"
    return df.select(
        F.col("parsed.all_domains").alias("domains"), (F.col("entry_type") == 1).alias("pre"),
        issuer_name(F.col("parsed.issuer.O"), F.col("parsed.issuer.CN")).alias("issuer"),
        "parsed.not_before", "parsed.not_after", F.col("parsed.serial_number").alias("serial"),
        F.col("fingerprints.sha256").alias("sha256"),
        F.concat_ws(", ", F.nullif(F.col(f"{ext}.keyUsage"), F.lit("")),
                    F.nullif(F.col(f"{ext}.extendedKeyUsage"), F.lit(""))).alias("usage"),
        short_log_name(F.col("log_name")).alias("log"), "index", "link", "seen")


def recent(df: DataFrame, keep: int | None) -> DataFrame:
    """The newest certificates, by time and position in their log; all of them in that order without ``keep``."""
    ordered = df.orderBy(F.col("seen").desc(), F.col("index").desc())
    return ordered if keep is None else ordered.limit(keep)


def newest(df: DataFrame, keep: int) -> DataFrame:
    """The certificates from the ``keep``-th newest place on, in no order.

    Only the two columns of the order meet in one task; rows that tie with the
    last place stay, all of them.
    """
    place = F.struct("seen", "index")
    edge = df.select(place.alias("p")).orderBy(F.col("p").desc()).limit(keep).agg(F.min("p").alias("_edge"))
    return df.join(F.broadcast(edge), place >= F.col("_edge")).drop("_edge")


def search(certs: DataFrame, q: str = "", kind: str = "all", limit: int | None = None, keep: int | None = None,
           names: int | None = None) -> DataFrame:
    """Certificates whose names or issuer hold a text, newest first.

    ``keep`` narrows the search to the newest certificates first, ``names`` to
    the first names of each; without them everything is searched. ``limit`` cuts
    the answer. The needle is matched per name.
    """
    rows = certs if keep is None else newest(certs, keep)
    rows = of_type(rows, kind)
    needle = re.sub(r"^\s+|\s+$", "", q).lower()
    if needle:
        searched = F.col("parsed.all_domains") if names is None else F.slice("parsed.all_domains", 1, names)
        shown = with_shown(rows.withColumn("_names", searched), "_names", "_shown")
        issuer = F.lower(issuer_name(F.col("parsed.issuer.O"), F.col("parsed.issuer.CN")))
        held = (F.exists("_names", lambda n: F.contains(n, F.lit(needle)))
                | F.exists(F.filter(F.arrays_zip(F.col("_names").alias("n"), F.col("_shown").alias("s")), lambda p: p["n"] != p["s"]),
                           lambda p: F.contains(F.lower(p["s"]), F.lit(needle)))
                | F.contains(issuer, F.lit(needle)))
        rows = shown.filter(held).drop("_names", "_shown")
    return recent(rows, limit)


def search_window(certs: DataFrame, keep: int | None = None) -> DataFrame:
    """How many certificates a search covers, and since when."""
    rows = certs if keep is None else newest(certs, keep)
    return rows.agg(F.count(F.lit(1)).alias("certificates"), F.min("seen").alias("since"))


def latest(certs: DataFrame, n: int = 25) -> DataFrame:
    """The last certificates, oldest of them first."""
    return recent(certs, n).orderBy("seen", "index")


def example(certs: DataFrame) -> DataFrame:
    return recent(certs, 1)
