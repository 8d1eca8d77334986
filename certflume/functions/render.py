"""Readable lines, export cells, signatures and tile addresses."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv


def _named(domain: Column, shown: Column) -> Column:
    return F.when(shown.isNotNull(), F.concat(domain, F.lit(" ("), shown, F.lit(")"))).otherwise(domain)


def alert_text(severity, domain, shown, watch_name, score, reasons, issuer) -> Column:
    return F.concat(
        F.lit("["), severity, F.lit("] "), _named(domain, shown), F.lit(" looks like "), watch_name,
        F.lit(", score "), score.cast("string"), F.lit(" ("), F.array_join(reasons, ", "),
        F.lit("), issued by "), F.coalesce(issuer, F.lit("")),
    )


def _clock(seen: Column) -> Column:
    return F.date_format(seen, "HH:mm:ss")


def text_line(seen, entry_type, domains, shown, hit, cn, issuer, log) -> Column:
    """One line per certificate; ``shown`` is the Unicode form of the leading name."""
    lead = F.coalesce(hit, F.get(domains, F.lit(0)), F.nullif(cn, F.lit("")), F.lit("(no name)"))
    more = F.when(F.size(domains) > 1, F.concat(F.lit(" +"), (F.size(domains) - 1).cast("string"))).otherwise("")
    return F.concat(
        _clock(seen), F.lit("  "), F.when(entry_type == 1, "pre").otherwise("crt"), F.lit("  "),
        _named(lead, F.when(shown != lead, shown)), more, F.lit("  "), issuer, F.lit("  "), log,
    )


def finding_line(severity, score, domain, shown, watch_name, reasons, seen=None, issuer=None, log=None) -> Column:
    body = F.concat(
        severity, F.lit(" "), score.cast("string"), F.lit("  "), _named(domain, shown),
        F.lit("  looks like "), watch_name, F.lit("  ("), F.array_join(reasons, ", "), F.lit(")"),
    )
    if seen is None:
        return body
    return F.concat(_clock(seen), F.lit("  "), body, F.lit("  "), issuer, F.lit("  "), log)


def csv_cell(value: Column) -> Column:
    """A cell that a spreadsheet will not run as a formula."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_field(value: Column) -> Column:
    """A defused cell, quoted where a comma, quote or line feed needs it."""
    cell = csv_cell(value)
    quoted = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(cell.rlike('[",\n]'), quoted).otherwise(cell)


def sign_body(body: Column, secret: str) -> Column:
    """``sha256=`` and the HMAC-SHA-256 of a body, by two nested hashes."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(inner, F.encode(body, "UTF-8")), 256)
    return F.concat(F.lit("sha256="), F.sha2(F.concat(outer, F.unhex(first)), 256))


def tile_path(n: Column) -> Column:
    """Tile number in groups of three digits, all but the last led by ``x``."""
    digits = n.cast("string")
    padded = F.lpad(digits, (F.ceil(F.length(digits) / 3) * 3).cast("int"), F.lit("0"))
    return F.regexp_replace(padded, r"(\d{3})(?=\d)", "x$1/")


def tile_url(prefix: Column, n: Column, width: Column) -> Column:
    part = F.when(width == fv.TILE_WIDTH, "").otherwise(F.concat(F.lit(".p/"), width.cast("string")))
    return F.concat(prefix, F.lit("tile/data/"), tile_path(n), part)


def mark_name(name: Column, evidence: Column, ascii_shown: Column) -> Column:
    """Runs of a name with the marks its evidence puts on them.

    ``ev-brand`` covers the part that names the brand, ``ev-odd`` the
    look-alike or swapped characters, ``ev-lure`` lure words. A combining mark
    takes the marks of the character before it.
    """
    chars = F.regexp_extract_all(name, F.lit("(?s)."), F.lit(0))
    n = F.size(chars)
    spots = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def covered(spans: Column):
        return lambda i: F.exists(spans, lambda s: (s["from"] <= i) & (i < s["to"]))

    def spans_of(rows: Column, make) -> Column:
        return F.filter(F.transform(rows, make), lambda s: s.isNotNull())

    brand_rows = F.filter(evidence, lambda e: e["reason"].isin("keyword", "embedded-domain", "typo", "swap", "homoglyph")
                          | ((e["reason"] == "pattern") & ((e["on"] == "ascii") == ascii_shown)))
    brand = covered(spans_of(brand_rows, lambda e: e["at"]))

    def span(at: Column, width: Column) -> Column:
        return F.struct(at.alias("from"), (at + width).alias("to"))

    empty = F.array().cast("array<struct<from:int,to:int>>")
    glyphs = F.flatten(F.transform(F.filter(evidence, lambda e: e["reason"] == "homoglyph"), lambda e: F.coalesce(
        F.transform(e["chars"], lambda c: span(c["at"], F.lit(1))), empty)))
    swaps = F.flatten(F.transform(F.filter(evidence, lambda e: e["reason"] == "swap"), lambda e: F.coalesce(
        F.transform(e["swaps"], lambda s: span(s["at"], F.length(s["from"]))), empty)))
    lures = F.flatten(F.transform(F.filter(evidence, lambda e: e["reason"] == "lure-word"),
                                  lambda e: F.coalesce(e["spans"], empty)))
    odd, lure = covered(F.concat(glyphs, swaps)), covered(lures)

    def marks(i: Column) -> Column:
        return F.concat_ws(" ", F.when(brand(i), "ev-brand"), F.when(lure(i), "ev-lure"), F.when(odd(i), "ev-odd"))

    def add(runs: Column, i: Column) -> Column:
        last = F.element_at(runs, -1)
        ch = chars[i]
        own = F.when((F.size(runs) > 0) & ch.rlike(r"^\p{M}"), F.try_element_at(runs, F.lit(-1))["marks"]).otherwise(marks(i))
        joined = F.struct(F.concat(last["text"], ch).alias("text"), last["marks"].alias("marks"))
        fresh = F.struct(ch.alias("text"), own.alias("marks"))
        return (F.when(F.size(runs) == 0, F.array(fresh))
                .when(F.element_at(runs, -1)["marks"] == own,
                      F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(joined)))
                .otherwise(F.concat(runs, F.array(fresh))))

    return F.aggregate(spots, F.array().cast("array<struct<text:string,marks:string>>"), add)
